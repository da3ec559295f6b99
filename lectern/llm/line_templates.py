"""Line dedup by a log-template tree.

Variable fields of a line (numbers, addresses, times, identifiers) become `<*>`; the result is its masked line. A tree
of fixed depth sorts the masked lines: by their number of tokens, then by their leading tokens. In a leaf, lines that
agree in AGREE of their tokens are of one template. A line recurs if it and the lines of its template stand in many
unlike documents; it is dropped from all of them.

What counts is not the number of documents but that of unlike ones. Copies, which have the same five-word shingles,
count as one; of the others each has a signature, and those whose signatures agree in ALIKE of their symbols count as
one too. A template recurs if it stands in min_docs documents that are unlike each other, however many others there
are: a group of copies never makes its own lines recur, and never keeps a line that recurs elsewhere.

Two lines of n tokens that agree differ in d = n / 4 positions at most. The positions behind the leading tokens are cut
into d + 1 parts, so the two are equal in one part at least: every line is keyed by each of its parts, and all lines
that agree meet under a key, at every size of a leaf and every length of a line. A key with more than BLOCK lines is
cut into blocks; lines that have not been found to recur inside their block then meet all blocks of the key.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialise, quoted, sized, small_batches
from .neardup import Shingler, _groups

LEADING = 3
#: Share of tokens in which lines of one template agree.
AGREE = 0.75
BROADCAST_TEMPLATES = 1_000_000
#: Symbols of a document's signature, and the share of them from which two documents count as one.
SYMBOLS, ALIKE = 64, 0.6
#: Rows of one key that a task compares at a time.
BLOCK = 512
#: Lines that a task holds before it hands them on.
_PACK = 20_000
_NONE = np.uint64((1 << 64) - 1)
_DIGIT = re.compile(r"\d")


def mask_line(line: str) -> str:
    """Tokens with a digit become <*>, white space one space. A line that would lose most of its tokens (a row of
    figures) says nothing without them and is left as it is."""
    tokens = line.split()
    if _DIGIT.search(line):
        masked = ["<*>" if _DIGIT.search(t) else t for t in tokens]
        tokens = masked if 2 * masked.count("<*>") <= len(masked) else tokens
    return " ".join(tokens)


class LineHasher:
    def __init__(self) -> None:
        from xxhash import xxh3_64_intdigest

        self.hash = xxh3_64_intdigest

    def __call__(self, text: str, seed: int = 0) -> int:
        h = self.hash(text.encode("utf-8"), seed=seed)
        return h - (1 << 64) if h >= 1 << 63 else h


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least shingle in each of SYMBOLS equal ranges of hashes, the largest number for an empty range."""
    least = np.full(SYMBOLS, _NONE, np.uint64)
    np.minimum.at(least, (shingles >> np.uint64(58)).astype(np.intp), shingles)
    return least


def symbols(least: np.ndarray) -> bytes:
    """A byte for each of a signature's numbers, 0 for an empty range."""
    return np.where(least == _NONE, np.uint64(0), least % np.uint64(255) + np.uint64(1)).astype(np.uint8).tobytes()


def unlike(sigs: np.ndarray, most: int) -> list[int]:
    """Numbers of rows unlike each other, each the first that is unlike all before it, until there are most."""
    alive, out = np.ones(len(sigs), bool), []
    while len(out) < most and alive.any():
        first = int(alive.argmax())
        out.append(first)
        own = sigs[first]
        filled = (sigs != 0) | (own != 0)
        alive &= ((sigs == own) & filled).sum(axis=1) < ALIKE * filled.sum(axis=1)
    return out


def masked_lines(docs: DataFrame) -> DataFrame:
    """leaf (0 for lines too short to differ), template (hash of the masked line), doc (hash of the signature: documents
    of the same shingles have the same), line: once for each document; sig, its symbols, in the first row only."""
    kinds = [("leaf", pa.int64()), ("template", pa.int64()), ("doc", pa.int64()), ("line", pa.string()), ("sig", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        hashed, shingle = LineHasher(), Shingler(5)
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            leaves, templates, docs_, lines, sigs = columns
            for text in batch.column(0):
                text = text.as_py()
                own = list({m for m in map(mask_line, text.split("\n")) if m})
                if not own:
                    continue
                least = signature(shingle.rolled(text))
                for masked in own:
                    tokens = masked.split(" ", LEADING)
                    n = masked.count(" ") + 1
                    leaves.append(hashed(" ".join(tokens[:LEADING]), n) if n > LEADING else 0)
                    templates.append(hashed(masked))
                docs_ += [xxh3_64_intdigest(least.tobytes()) >> 1] * len(own)
                lines += own
                sigs += [symbols(least), *[None] * (len(own) - 1)]
                if len(lines) > _PACK:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], [k for k, _ in kinds])
                    for c in columns:
                        c.clear()
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], [k for k, _ in kinds])

    return small_batches(docs).filter("text is not null").select("text").mapInArrow(run, "leaf long, template long, doc long, line string, sig binary")


def unlike_docs(rows: DataFrame, min_docs: int) -> DataFrame:
    """key, sig: of each key's documents (key, sig) as many unlike ones as there are, up to min_docs. Keys of many rows
    go through blocks, again and again, until one block holds what is left of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _groups(batches, ["key", "block"]):
            key, block = part["key"].to_numpy(), part["block"].to_numpy()
            sigs = np.frombuffer(b"".join(part["sig"]), np.uint8).reshape(-1, SYMBOLS)
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (block[1:] != block[:-1])])
            kept = [s + i for s, e in zip(starts, np.r_[starts[1:], len(key)], strict=True) for i in unlike(sigs[s:e], min_docs)]
            yield part.iloc[kept][["key", "sig"]]

    size = max(BLOCK, 4 * min_docs)  # a full block leaves min_docs rows at most
    while True:
        big = sized(rows.groupBy("key").agg(F.count("*").alias("n")).filter(f"n > {size}"), 24)
        large = big.limit(1).count()
        if large:
            blocks = F.coalesce(F.ceil(F.col("n") / size), F.lit(1)).cast("long")
            blocked = rows.join(big, "key", "left").withColumn("block", F.pmod(F.xxhash64("sig", "key"), blocks).cast("int"))
        else:
            blocked = rows.withColumn("block", F.lit(0))
        dealt = blocked.select("key", "block", "sig").repartition("key", "block").sortWithinPartitions("key", "block", "sig")
        rows = materialise(dealt.mapInPandas(run, "key long, sig binary"))
        if not large:
            return rows


def _enough(rows: DataFrame, min_docs: int) -> DataFrame:
    """template: keys with min_docs unlike documents."""
    return rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs).select(F.col("key").alias("template"))


def part_keys(tokens: Column, leaf: Column) -> Column:
    """A key for each part of the positions behind the leading tokens; lines that agree share one of them."""
    rest, parts = F.size(tokens) - LEADING, F.floor((1 - AGREE) * F.size(tokens)).cast("int") + 1
    cut = lambda i: F.floor(i * rest / parts).cast("int")
    key = lambda i: F.xxhash64(leaf, i, F.slice(tokens, LEADING + 1 + cut(i), cut(i + 1) - cut(i)))
    return F.transform(F.sequence(F.lit(0), parts - 1), key)


def _meet(rows: DataFrame, lines: DataFrame, min_docs: int) -> DataFrame:
    """template, sig: unlike documents of the lines that agree with an asking line, a null sig if there are min_docs.

    rows: key, block, slice, template, home, ask; in each key, block and slice the asking lines meet those at home.
    lines: template, width (number of tokens), tokens, sigs.
    """
    group = ["key", "width", "block", "slice"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _groups(batches, group):
            codes = part.groupby(group, sort=False).ngroup().to_numpy()
            starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            template, home, ask, sigs = (part[c].to_numpy() for c in ("template", "home", "ask", "sigs"))
            out = []
            for start, end in zip(starts, np.r_[starts[1:], len(codes)], strict=True):
                tokens = np.stack(part["tokens"].iloc[start:end].to_numpy())
                hosts = np.flatnonzero(home[start:end])
                known: dict[bytes, list[bytes | None]] = {}
                for i in np.flatnonzero(ask[start:end]):
                    near = (tokens[hosts] == tokens[i]).sum(axis=1) >= AGREE * tokens.shape[1]
                    found = known.get(near.tobytes())
                    if found is None:
                        all_ = [x for h in hosts[near] for x in sigs[start + h]]
                        at = unlike(np.frombuffer(b"".join(all_), np.uint8).reshape(-1, SYMBOLS), min_docs)
                        found = known[near.tobytes()] = [None] if len(at) >= min_docs else [all_[x] for x in at]
                    out += [(template[start + i], x) for x in found]
            yield pd.DataFrame(out, columns=["template", "sig"])

    full = rows.join(lines, "template").repartition(*group).sortWithinPartitions(*group, "template")
    return full.select(*group, "template", "home", "ask", "tokens", "sigs").mapInPandas(run, "template long, sig binary").distinct()


def merged_templates(lines: DataFrame, min_docs: int) -> DataFrame:
    """template: lines that do not recur alone but together with the lines that agree with them.

    lines: leaf, template, width, tokens, sigs (unlike documents, min_docs at most).
    """
    alone = F.size("sigs") >= min_docs
    keyed = materialise(lines.select("template", alone.alias("alone"), F.explode(part_keys(F.col("tokens"), F.col("leaf"))).alias("key")))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("alone").alias("done")).filter("n > 1 and not done")
    members = materialise(keyed.join(sized(sizes.select("key", "n"), 24), "key"))
    members = members.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    block = F.pmod(F.xxhash64("template", "key"), F.col("blocks").cast("long")).cast("int").alias("block")
    lines = materialise(lines.drop("leaf"))
    own = members.select("key", block, F.lit(0).alias("slice"), "template", F.lit(True).alias("home"), (~F.col("alone")).alias("ask"))
    seen = materialise(_meet(own, lines, min_docs))
    large = members.filter("blocks > 1")
    if large.limit(1).count():
        done = sized(seen.filter("sig is null").select("template"), 16)
        guests = materialise(large.filter("not alone").join(done, "template", "left_anti"))
        asked = guests.groupBy("key").agg(F.ceil(F.count("*") / (2 * BLOCK)).cast("int").alias("slices"))
        asked = sized(asked, 24)
        slices = F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")
        hosts = large.join(asked, "key").select("key", block, slices, "template", F.lit(True).alias("home"), F.lit(False).alias("ask"))
        all_blocks = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
        slice_ = F.pmod(F.xxhash64("template", F.lit(2)), F.col("slices").cast("long")).cast("int").alias("slice")
        guests = guests.join(asked, "key").select("key", all_blocks, slice_, "template", F.lit(False).alias("home"), F.lit(True).alias("ask"))
        seen = materialise(seen.unionByName(_meet(hosts.unionByName(guests), lines, min_docs)))
    done = seen.filter("sig is null").select("template").distinct()
    rest = seen.filter("sig is not null").distinct().join(sized(done, 16), "template", "left_anti")
    return done.unionByName(_enough(unlike_docs(rest.withColumnRenamed("template", "key"), min_docs), min_docs))


def recurring_templates(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """template, head: hashes of the masked lines whose template recurs in min_docs unlike documents or more, and the
    first tokens of these lines."""
    seen = materialise(masked_lines(docs))
    sigs = materialise(seen.filter("sig is not null").groupBy("doc").agg(F.min("sig").alias("sig")))
    by_doc = materialise(seen.select("leaf", "template", "doc").distinct())
    counts = by_doc.groupBy("leaf", "template").agg(F.count("*").alias("n"))
    leaves = counts.filter("leaf <> 0").groupBy("leaf").agg(F.count("*").alias("lines"), F.sum("n").alias("n"))
    leaves = sized(leaves.filter((F.col("lines") > 1) & (F.col("n") >= min_docs)).select("leaf"), 16)
    often = sized(counts.filter(F.col("n") >= min_docs).select("template"), 16)
    asked = by_doc.join(leaves, "leaf").unionByName(by_doc.join(leaves, "leaf", "left_anti").join(often, "template").select(*by_doc.columns))
    own = unlike_docs(asked.join(sigs, "doc").select(F.col("template").alias("key"), "sig"), min_docs)
    alone = _enough(own, min_docs)
    # grouped by template, not by leaf, so that the many lines of one leaf are summed up before they are dealt out
    texts = seen.join(leaves, "leaf").groupBy("template").agg(F.first("leaf").alias("leaf"), F.first("line").alias("line"))
    packed = own.groupBy(F.col("key").alias("template")).agg(F.collect_list("sig").alias("sigs"))
    lines = materialise(texts.join(packed, "template"))
    # a leaf of fewer unlike documents has no line that recurs
    by_leaf = unlike_docs(lines.select(F.col("leaf").alias("key"), F.explode("sigs").alias("sig")), min_docs)
    lines = lines.join(sized(_enough(by_leaf, min_docs).withColumnRenamed("template", "leaf"), 16), "leaf")
    lines = lines.withColumn("tokens", F.transform(F.split("line", " "), lambda t: F.xxhash64(t)))
    lines = lines.select("leaf", "template", F.size("tokens").alias("width"), "tokens", "sigs")
    found = sized(alone.unionByName(merged_templates(lines, min_docs)).distinct(), 16)
    heads = seen.select("template", F.substring_index("line", " ", 1).alias("head")).join(found, "template")
    return materialise(heads.groupBy("template").agg(F.first("head").alias("head")))


def drop_recurring_lines(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """The rows of docs with recurring lines dropped from text, and n_lines and dropped (line numbers from 0) added.

    Lines are what stands between line feeds; blank lines never recur. A text may end up empty, its row stays. A null
    text stays null, with 0 lines and none dropped; texts of any length are read whole. Of lines that tie none comes
    first: all or none of a template's lines go. Repeated rows are treated alike; columns of docs named n_lines or
    dropped are replaced, all others come through, whatever their names. An empty table gives no row.
    """
    recurring = recurring_templates(docs, min_docs)
    rows = docs.drop("n_lines", "dropped")
    split = F.split("text", "\n", -1)
    rows = rows.withColumn("n_lines", F.coalesce(F.size(split), F.lit(0)))
    if recurring.count() > BROADCAST_TEMPLATES:
        return _drop_by_join(rows, recurring)
    found = recurring.collect()
    known, heads = frozenset(r.template for r in found), frozenset(r.head for r in found)
    shared = docs.sparkSession.sparkContext.broadcast((known, heads))

    def numbers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        (known, heads), hashed = shared.value, LineHasher()
        for texts in batches:
            out = []
            for text in texts:
                own = []
                for i, line in enumerate(text.split("\n") if text is not None else ()):
                    first = line.split(None, 1)[:1]
                    # most lines are told apart from all that recur by their first token
                    if first and (first[0] in heads or _DIGIT.search(first[0])) and hashed(mask_line(line)) in known:
                        own.append(i)
                out.append(own)
            yield pd.Series(out)

    rows = rows.withColumn("dropped", F.pandas_udf(numbers, "array<int>")("text"))
    return rows.withColumn("text", _without("text", "dropped")).select(*map(quoted, docs.drop("n_lines", "dropped").columns), "n_lines", "dropped")


def _without(text: str, dropped: str) -> Column:
    """text without the lines of these numbers."""
    kept = F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(dropped, i))
    return F.when(F.size(dropped) > 0, F.array_join(kept, "\n")).otherwise(F.col(text))


def _drop_by_join(rows: DataFrame, recurring: DataFrame) -> DataFrame:
    """dropped, and text without these lines, by a shuffle, for more templates than a broadcast may hold."""

    def hashes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashed = LineHasher()
        for texts in batches:
            yield texts.map(lambda t: [hashed(m) if (m := mask_line(x)) else None for x in t.split("\n")])

    of = F.pandas_udf(hashes, "array<long>")
    key = free_name(rows, "text_key")
    texts = rows.filter("text is not null").select("text").distinct().withColumn(key, F.sha2("text", 256))
    lines = texts.select(key, F.posexplode(of("text")).alias("line_no", "template")).filter("template is not null")
    gone = lines.join(recurring.select("template"), "template").groupBy(key).agg(F.array_sort(F.collect_list("line_no")).alias("dropped"))
    out = rows.withColumn(key, F.sha2("text", 256)).join(gone, key, "left").drop(key)
    out = out.withColumn("dropped", F.coalesce("dropped", F.array().cast("array<int>")))
    return out.withColumn("text", _without("text", "dropped"))

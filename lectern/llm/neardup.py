"""MinHash near-duplicates by a multi-index Hamming join.

Each document has a signature of SYMBOLS b-bit symbols, one MinHash value each. The signature is cut into CHUNKS
chunks; two signatures that differ in at most RADIUS = 2 * CHUNKS - 1 symbols have, by the pigeonhole principle, a
chunk with at most one differing symbol. So every chunk is keyed once for each way to leave one symbol out, and any two
documents within the radius share a key: no such pair is missed. At a similarity of 0.85 a pair lies outside the radius
with a probability of 3e-6, and outside all keys with 2e-8. What shares a key is compared on a longer signature of
FINE symbols of one byte, which tells similarities apart better; at 0.85 a pair lies beyond FINE_RADIUS with a
probability of 1e-6.

Exact copies are joined first by a digest of the whole shingle set; what follows sees one representative of each set.
Under a key, the links of a minimum spanning forest by signature distance are confirmed on the full sets, at most one
pair for each further member. Then, in every key whose members still lie in several components, all pairs within the
radius that would join two of them are checked where they are found, on the full sets; only links leave the task.
Pairs inside a component need no proof, so no group is expanded into all its pairs, and no link between components is
lost. Keys with many members are cut into blocks; a block meets only the members outside the key's largest component.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import materialise, sized, small_batches

SYMBOLS, CHUNKS = 32, 8
PER_CHUNK = SYMBOLS // CHUNKS
RADIUS = 2 * CHUNKS - 1
FINE = 192


def fine_radius(percent: int) -> int:
    """Differing symbols of the long signature up to which a pair is looked at: five standard deviations beyond the
    mean at the least similarity of a link."""
    miss = 1 - percent / 100
    return int(FINE * miss + 5.1 * (FINE * miss * (1 - miss)) ** 0.5)


#: Members of one key that a task compares at a time.
BLOCK = 512
#: Ids up to this number are sent to all executors (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Bytes of a text that are hashed at a time.
_TEXT_BLOCK = 1 << 18
_BREAK = re.compile(b"[\x20\x09-\x0d]")
_SPACE = np.isin(np.arange(256), [0x20, *range(9, 14)])
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BYTE = np.random.default_rng(19).integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_ODD = np.random.default_rng(20).integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) | np.uint64(1)
_FINE_ODD = np.random.default_rng(21).integers(1, 1 << 31, FINE, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of the word shingles of texts.

    A word's hash is a polynomial in its bytes, taken from running sums over the whole text, so that numpy does all the
    work; long texts go through it in blocks that end between words.
    """

    def __init__(self, width: int) -> None:
        self.width, self.powers, self.inverse = width, np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def _grow(self, n: int) -> None:
        n = 1 << max(16, n.bit_length())
        self.powers, self.inverse = np.full(n, _BASE, np.uint64), np.full(n, pow(int(_BASE), -1, 1 << 64), np.uint64)
        self.powers[0] = self.inverse[0] = 1
        np.multiply.accumulate(self.powers, out=self.powers)
        np.multiply.accumulate(self.inverse, out=self.inverse)

    def _block(self, raw: bytes) -> np.ndarray:
        codes = np.frombuffer(raw, np.uint8)
        if len(codes) > len(self.powers):
            self._grow(len(codes))
        space = np.ones(len(codes) + 2, bool)
        space[1:-1] = _SPACE[codes]
        edges = np.flatnonzero(space[1:] != space[:-1])
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(_BYTE[codes] * self.powers[: len(codes)], out=sums[1:])
        return _scramble((sums[edges[1::2]] - sums[edges[::2]]) * self.inverse[edges[::2]])

    def words(self, text: str) -> np.ndarray:
        """Hashes of the words in order: runs of anything but the six ASCII spaces, A-Z as a-z."""
        raw, found, at = text.encode("utf-8"), [], 0
        while at < len(raw):
            end = _BREAK.search(raw, at + _TEXT_BLOCK)
            end = end.start() if end else len(raw)
            found.append(self._block(raw[at:end]))
            at = end
        return found[0] if len(found) == 1 else np.concatenate([np.zeros(0, np.uint64), *found])

    def rolled(self, text: str | None) -> np.ndarray:
        """Hashes of the shingles in order."""
        h = self.words(text) if text else np.zeros(0, np.uint64)
        if not len(h):
            return h
        width = min(self.width, len(h))
        n = len(h) - width + 1
        total = h[:n].copy()
        for k in range(1, width):
            total = total * _STEP + h[k : k + n]
        return _scramble(total + np.uint64(width))

    def __call__(self, text: str | None) -> np.ndarray:
        return np.unique(self.rolled(text))


def signature(shingles: np.ndarray) -> np.ndarray:
    """SYMBOLS values of 16 bits; shingles are not empty."""
    least = np.full(SYMBOLS, (1 << 64) - 1, np.uint64)
    for start in range(0, len(shingles), 2048):
        np.minimum(least, (shingles[start : start + 2048, None] * _ODD[None, :]).min(axis=0), out=least)
    return (least >> np.uint64(24) & np.uint64(0xFFFF)).astype(np.int64)


def fine_signature(shingles: np.ndarray) -> bytes:
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(FINE, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(low), 2048):
        np.minimum(least, (low[start : start + 2048, None] * _FINE_ODD[None, :]).min(axis=0), out=least)
    return (least * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8).tobytes()


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null without shingles), sig, fine."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_128_hexdigest

        shingle = Shingler(width)
        for texts in batches:
            rows = []
            for text in texts:
                own = shingle(text)
                rows.append((len(own), xxh3_128_hexdigest(own.tobytes()), signature(own).tolist(), fine_signature(own)) if len(own) else (0, None, None, None))
            yield pd.DataFrame(rows, columns=["n_shingles", "digest", "sig", "fine"])

    # ids stay in the JVM: pandas would turn a column with a null into floating point
    made = F.pandas_udf(run, "n_shingles long, digest string, sig array<int>, fine binary")("text")
    return small_batches(docs).select("doc_id", made.alias("made")).select("doc_id", "made.*")


def chunk_keys(sig: str = "sig") -> F.Column:
    """Each chunk keyed once for each symbol left out."""
    keys = []
    for chunk in range(CHUNKS):
        for out in range(PER_CHUNK):
            kept = [F.col(sig)[chunk * PER_CHUNK + i] for i in range(PER_CHUNK) if i != out]
            keys.append(F.xxhash64(F.lit(chunk * PER_CHUNK + out), *kept))
    return F.array(*keys)


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[list[pd.DataFrame]]:
    """Batches sorted by keys, cut so that no group of equal keys is cut."""
    rest = None
    for batch in batches:
        batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        last = (batch[keys] == batch[keys].iloc[-1]).all(axis=1).to_numpy()
        cut = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
        if cut:
            yield batch.iloc[:cut]
        rest = batch.iloc[cut:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest


def _forest(sig: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of a minimum spanning forest over pairs within the radius (Prim's algorithm, ties to lower numbers)."""
    n = len(sig)
    best, parent = np.full(n, FINE + 1), np.full(n, -1)
    inside = np.zeros(n, bool)
    links = []
    for _ in range(n):
        open_ = np.where(inside, FINE + 2, best)
        v = int(open_.argmin())
        if parent[v] >= 0 and best[v] <= radius:
            links.append((int(parent[v]), v))
        inside[v] = True
        d = (sig != sig[v]).sum(axis=1)
        closer = ~inside & (d < best)
        best[closer], parent[closer] = d[closer], v
    return links


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, FINE)


def nearest_pairs(members: DataFrame, radius: int) -> DataFrame:
    """a, b: links of each block's spanning forest. members: key, block, rep, fine."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _groups(batches, ["key", "block"]):
            key, block, rep = (rows[c].to_numpy() for c in ("key", "block", "rep"))
            sig = _matrix(rows["fine"])
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (block[1:] != block[:-1])])
            sizes = np.diff(np.r_[starts, len(key)])
            two = starts[sizes == 2]
            near = two[(sig[two] != sig[two + 1]).sum(axis=1) <= radius]
            a, b = [rep[near]], [rep[near + 1]]
            for start, size in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
                for i, j in _forest(sig[start : start + size], radius):
                    a.append(rep[start + i : start + i + 1])
                    b.append(rep[start + j : start + j + 1])
            a, b = np.concatenate(a), np.concatenate(b)
            yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    dealt = members.repartition("key", "block").sortWithinPartitions("key", "block", "rep")
    return dealt.select("key", "block", "rep", "fine").mapInPandas(run, "a long, b long").filter("a < b").distinct()


def _first_key(sig: np.ndarray, other: np.ndarray) -> np.ndarray:
    """For each row of sig the number of the first key that it shares with other, -1 without one."""
    same = (sig == other).reshape(len(sig), CHUNKS, PER_CHUNK)
    n = same.sum(axis=2)
    chunk = (n >= PER_CHUNK - 1).argmax(axis=1)
    rows = np.arange(len(sig))
    out = np.where(n[rows, chunk] == PER_CHUNK, 0, same[rows, chunk].argmin(axis=1))
    return np.where(n[rows, chunk] >= PER_CHUNK - 1, chunk * PER_CHUNK + out, -1)


def crossing_links(docs: DataFrame, members: DataFrame, components: DataFrame, sigs: DataFrame, width: int, percent: int) -> DataFrame:
    """a, b: links between different components, enough of them to join all that are linked.

    members: key, key_no, rep. In each key with several components every pair of different components within the long
    signature's radius is checked on the full sets, where it is found: no pair leaves the task but a link. A pair is
    looked at under the first key that it shares, the nearest first, and not if a link has joined its components.
    """
    radius = fine_radius(percent)
    placed = members.join(components.withColumnRenamed("node", "rep"), "rep", "left")
    placed = placed.withColumn("comp", F.coalesce("comp", "rep"))
    sizes = placed.groupBy("key", "comp").agg(F.count("*").alias("n"))
    keys = sizes.groupBy("key").agg(F.sum("n").alias("all"), F.max(F.struct("n", "comp")).alias("top")).filter("all > top.n")
    mixed = placed.join(keys.select("key", "all", F.col("top.comp").alias("main"), (F.col("all") - F.col("top.n")).alias("others")), "key")
    blocks = F.ceil(F.col("all") / BLOCK).cast("int")
    slices = F.ceil(F.col("others") / (2 * BLOCK)).cast("int")
    place = lambda n, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), n.cast("long")).cast("int")
    mixed = mixed.withColumns({"blocks": blocks, "slices": slices, "guest": F.col("comp") != F.col("main")})
    # at home in one block (in each slice of the guests), and a guest in all blocks if outside the largest component
    base = ("key", "key_no", "rep", "comp")
    home = mixed.select(*base, place(blocks, 1).alias("block"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(True).alias("home"))
    guest = mixed.filter("guest").select(*base, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), place(slices, 2).alias("slice"), F.lit(False).alias("home"))
    rows = materialise(home.unionByName(guest))
    sets = full_sets(docs, rows.select(F.col("rep").alias("doc_id")).distinct(), width).withColumnRenamed("doc_id", "rep")
    rows = rows.join(sigs.join(sets, "rep"), "rep")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group = ["key", "block", "slice"]
        for part in _groups(batches, group):
            rep, comp, at_home, number = (part[c].to_numpy() for c in ("rep", "comp", "home", "key_no"))
            fine, sets = _matrix(part["fine"]), part["h"].to_numpy()
            sig = np.stack(part["sig"].to_numpy())
            codes = part.groupby(group, sort=False).ngroup().to_numpy()
            starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            found = []
            for start, end in zip(starts, np.r_[starts[1:], len(codes)], strict=True):
                hosts = np.arange(start, end)[at_home[start:end]]
                tries = []
                for g in np.arange(start, end)[~at_home[start:end]]:
                    away = (fine[hosts] != fine[g]).sum(axis=1)
                    near = (comp[hosts] != comp[g]) & (away <= radius)
                    near[near] = _first_key(sig[hosts[near]], sig[g]) == number[g]
                    tries += [(d, g, h) for d, h in zip(away[near].tolist(), hosts[near].tolist(), strict=True)]
                joined: dict[int, int] = {}
                for _, g, h in sorted(tries):
                    x, y = _root(joined, int(comp[g])), _root(joined, int(comp[h]))
                    if x != y and _alike(sets[g], sets[h], percent):
                        joined[max(x, y)] = min(x, y)
                        found.append((min(rep[g], rep[h]), max(rep[g], rep[h])))
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    dealt = rows.repartition("key", "block", "slice").sortWithinPartitions("key", "block", "slice", "rep")
    columns = (*base, "block", "slice", "home", "sig", "fine", "h")
    return dealt.select(*columns).mapInPandas(run, "a long, b long").filter("a < b").distinct()


def _root(joined: dict[int, int], x: int) -> int:
    while x in joined:
        x = joined[x]
    return x


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    low, high = min(len(a), len(b)), max(len(a), len(b))
    if 100 * low < percent * high:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def full_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """doc_id, h (hashes of the whole shingle set) of the documents with these ids."""
    ids = materialise(ids)
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(width)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "h": [shingle(t).view(np.int64) for t in batch["text"]]})

    texts = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi")
    return texts.mapInPandas(run, "doc_id long, h array<long>")


def confirm(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """a, b, linked for every pair, by the full shingle sets."""
    sets = full_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), width)
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("h").alias("ha")), "a")
    both = both.join(sets.select(F.col("doc_id").alias("b"), F.col("h").alias("hb")), "b")
    common = F.size(F.array_intersect("ha", "hb"))
    union = F.size("ha") + F.size("hb") - common
    linked = (common > 0) & (100 * common >= percent * union)
    return both.select("a", "b", linked.alias("linked")).groupBy("a", "b").agg(F.max("linked").alias("linked"))


def components(links: DataFrame) -> DataFrame:
    """node, comp: the smallest node reachable over the links (a, b), for every node of a link.

    Every round a node takes the smallest label of its neighbours and then that label's own label, so long chains
    halve; rounds go on until nothing changes.
    """
    edges = materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialise(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")))
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        next_ = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        next_ = next_.join(jump, "comp", "left").select("node", "old", F.least("comp", F.coalesce("further", "comp")).alias("comp"))
        next_ = materialise(next_)
        labels = next_.select("node", "comp")
        if not next_.filter("comp < old").limit(1).count():
            return labels


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Words are runs of anything but ASCII white space, A-Z lower-cased; shingles are `width` words, a shorter text is
    one shingle. Documents are linked if their sets share at least `percent` per cent of their union; component_id is
    the smallest doc_id reachable, kept says whether it is the document's own. Null or empty texts have no shingles
    and no links; rows without doc_id have neither component nor links and are not kept. Texts of any length are read
    whole. Repeated rows are copies of each other; rows of one doc_id with different texts are one document with several
    texts: they have one component, which holds all that is linked to any of the texts. An empty table gives no row;
    other columns are not read.
    """
    sketches = materialise(sketch(docs, width))
    known = sketches.filter("doc_id is not null and digest is not null")
    reps = known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("fine").alias("fine"))
    reps = materialise(reps)
    keyed = reps.select("rep", F.posexplode(chunk_keys()).alias("key_no", "key")).distinct()
    shared = keyed.withColumn("n", F.count("*").over(Window.partitionBy("key"))).filter("n > 1")
    members = materialise(shared)
    sigs, radius = reps.select("rep", "fine"), fine_radius(percent)
    blocks = F.ceil(F.col("n") / BLOCK)
    blocked = members.withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int")).join(sigs, "rep")
    linked = confirm(docs, materialise(nearest_pairs(blocked, radius)), width, percent).filter("linked").select("a", "b")
    # documents of several texts, the empty one included, join the representatives of all of them
    several = sketches.filter("doc_id is not null").groupBy("doc_id")
    several = several.agg(F.min(F.coalesce("digest", F.lit(""))).alias("least"), F.max(F.coalesce("digest", F.lit(""))).alias("most"))
    several = sized(several.filter("least <> most").select("doc_id"), 16)
    texts = known.join(several, "doc_id").select("doc_id", "digest").distinct().join(reps.select("digest", "rep"), "digest")
    own = texts.filter("rep <> doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    linked = materialise(linked.unionByName(own).distinct())
    found = components(linked)
    more = materialise(crossing_links(docs, members, found, reps.select("rep", "sig", "fine"), width, percent))
    if more.limit(1).count():
        found = components(linked.unionByName(more))
    named = reps.select("digest", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("digest", F.coalesce("comp", "rep").alias("class_id"))
    out = sketches.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("component_id")
    out = out.select("doc_id", "n_shingles", component)
    if several.limit(1).count():  # their empty rows
        least = out.join(several, "doc_id").groupBy("doc_id").agg(F.min("component_id").alias("least"))
        out = out.join(least, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("least", "component_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))

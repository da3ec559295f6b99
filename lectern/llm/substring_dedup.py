"""Substring dedup by digests of passages.

A text is its words in lower case; a character of Chinese or Japanese is a word. A passage is min_words words in a row. Of
every min_words + SLACK words in a row one passage is digested, chosen by these words alone (mod-minimizer: the place of
the least hash of a few words, modulo SLACK + 1), so two texts that share so many words share a digest, wherever these stand
and whatever stands around them. Passages at the start of a line and at both ends of a text are digested too. Digests are
grouped over all documents; the passage of the document with the lowest doc_id stays, all others are marked. Marked passages
that overlap or touch make a span (fewer than LEAST_WORDS words between them belong to it). Offsets are those of the
original text.

min_words of 42 finds all shared runs of 50 words, at most 8 words short at each end, and none under 42.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, small_batches

_CJK = "\u3041-\u3096\u309d-\u309f\u30a1-\u30fa\u30fc-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORDS = re.compile(rf"([^\W_{_CJK}]+|[{_CJK}])")
_MARKS = re.compile(r"\S*")
LEAST_WORDS = 4
CUT = 4
_CACHE = 100_000
_ODD = 0x9E3779B97F4A7C15
#: Passages that a task holds before it hands them on.
_PACK = 65_536
_COLUMNS = ("start", "end", "n_words", "before", "digest")
#: Words that a shared run may need beyond min_words, and words (at least) whose hash chooses the passage.
SLACK = 8
_SEED = 4
_INVERSE = pow(_ODD, -1, 1 << 64)


class Units:
    """start, end (code points), n_words, before (words of the text before it) and digest of every unit of a text: a unit
    ends at the end of the line, or behind a word whose hash is divisible by CUT, but never before it has LEAST_WORDS words.
    A rest that is too short for a unit belongs to the last one; a text of fewer words has no unit."""

    def __init__(self) -> None:
        from xxhash import xxh3_64_intdigest

        self.hash, self.known = xxh3_64_intdigest, {}

    def _word(self, word: str) -> int:
        value = self.known[word] = self.hash(word.lower().encode("utf-8"))
        return value

    def _hashes(self, words: list[str]) -> np.ndarray:
        if len(self.known) > _CACHE:
            self.known.clear()
        get = self.known.get
        return np.array([h if (h := get(w)) is not None else self._word(w) for w in words], np.uint64)

    def __call__(self, text: str) -> np.ndarray:
        parts = _WORDS.split(text)  # what stands between words at even places, words at odd ones
        words = parts[1::2]
        if len(words) < LEAST_WORDS:
            return np.zeros((0, len(_COLUMNS)), np.int64)
        hashes = self._hashes(words)
        at = _places(parts)
        ends_line = np.fromiter(("\n" in x for x in parts[2::2]), bool, len(words))
        ends_line[-1] = True
        cuts, last = [], -1
        for i in np.flatnonzero(ends_line | (hashes % np.uint64(CUT) == 0)).tolist():
            if i - last >= LEAST_WORDS:
                cuts.append(i)
                last = i
        cuts[-1:] = [len(words) - 1]
        stop = np.array(cuts, np.int64)
        first = np.r_[0, stop[:-1] + 1]
        size = stop - first + 1
        place = np.arange(len(words)) - np.repeat(first, size)
        digest = np.add.reduceat(hashes * _powers(_ODD, int(size.max()))[place], first) ^ (size.astype(np.uint64) << np.uint64(1))
        return np.stack([at[2 * first], at[2 * stop + 1] + _marks(parts, cuts), size, first, digest.view(np.int64)], axis=1)


class Passages(Units):
    """The same columns for the passages of n_words words of a text that stand for all others. A text of fewer words has
    none."""

    def __init__(self, n_words: int) -> None:
        super().__init__()
        self.n, self.window = n_words, n_words + SLACK
        least = min(_SEED, n_words)
        self.seed = least + (n_words - least) % (SLACK + 1)
        self.up = self.down = np.ones(1, np.uint64)

    def chosen(self, hashes: np.ndarray) -> np.ndarray:
        """Of every self.window words in a row the start of one passage inside them; a place may come several times."""
        if len(hashes) < self.window:
            return np.zeros(0, np.int64)
        n = len(hashes) - self.seed + 1
        seeds = sum(hashes[j : n + j] * power for j, power in enumerate(_powers(_ODD, self.seed)))
        least = (seeds >> np.uint64(32) << np.uint64(32)) + np.arange(n, dtype=np.uint64)  # of equal hashes the first
        n, width = self.window - self.seed + 1, 1
        while 2 * width <= n:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        starts = np.arange(len(hashes) - self.window + 1)
        least = np.minimum(least[: len(starts)], least[n - width : n - width + len(starts)])
        return starts + ((least & np.uint64(0xFFFFFFFF)).astype(np.int64) - starts) % (SLACK + 1)

    def __call__(self, text: str) -> np.ndarray:
        parts = _WORDS.split(text)
        words = parts[1::2]
        last = len(words) - self.n
        if last < 0:
            return np.zeros((0, len(_COLUMNS)), np.int64)
        hashes = self._hashes(words)
        taken = np.zeros(len(words), bool)
        taken[self.chosen(hashes)] = True
        taken[1:] |= np.fromiter(("\n" in x for x in parts[2:-1:2]), bool, len(words) - 1)
        taken[[0, last]] = True
        first = np.flatnonzero(taken[: last + 1])
        if len(self.up) <= len(words):
            self.up, self.down = (_powers(p, 2 * len(words)) for p in (_ODD, _INVERSE))
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(hashes * self.up[: len(words)], out=sums[1:])
        digest = (sums[first + self.n] - sums[first]) * self.down[first]
        at, stop = _places(parts), first + self.n - 1
        size = np.full(len(first), self.n)
        return np.stack([at[2 * first], at[2 * stop + 1] + _marks(parts, stop.tolist()), size, first, digest.view(np.int64)], axis=1)


def _powers(base: int, n: int) -> np.ndarray:
    powers = np.full(n, base, np.uint64)
    powers[0] = 1
    return np.multiply.accumulate(powers, out=powers)


def _places(parts: list[str]) -> np.ndarray:
    return np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))


def _marks(parts: list[str], words: list[int]) -> list[int]:
    """Characters of the marks right behind each of the words: what ends with a word ends behind its marks."""
    return [_MARKS.match(parts[2 * i + 2]).end() for i in words]


def passages(docs: DataFrame, n_words: int) -> DataFrame:
    """doc_id, text_id (hash of the text) and the columns of Passages for every text."""
    schema = ", ".join(f"{c} long" for c in ("doc_id", "text_id", *_COLUMNS))

    def pack(batch: pa.RecordBatch, rows: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
        take = pa.array(np.repeat(rows, [len(f) for f in found]))
        columns = np.concatenate(found) if found else np.zeros((0, len(_COLUMNS)), np.int64)
        own = [batch.column(i).take(take) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([*own, *map(pa.array, columns.T.copy())], ["doc_id", "text_id", *_COLUMNS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Passages(n_words)
        for batch in batches:
            rows, found, n = [], [], 0
            for i, text in enumerate(batch.column(2)):
                if len(own := cut(text.as_py())):
                    rows.append(i)
                    found.append(own)
                    n += len(own)
                if n > _PACK:
                    yield pack(batch, rows, found)
                    rows, found, n = [], [], 0
            if rows:
                yield pack(batch, rows, found)

    ready = small_batches(docs).filter("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("text_id"), "text")
    return ready.mapInArrow(run, schema)


def repeated_spans(docs: DataFrame, min_words: int = 42, within: bool = False) -> DataFrame:
    """doc_id, text_id, start, end, n_words, first_doc_id: the spans to remove, several per document at most.

    first_doc_id holds the earliest occurrence of the span's first passage, which is never marked: of exact copies the one
    of the lowest doc_id stays whole. A document's repeats of its own text are left alone, unless `within` asks for
    them: then the earliest place counts instead of the earliest document. Null ids or texts, empty texts and texts
    without words have no spans; texts of any length are read whole. A run of min_words + SLACK words that two places
    share is always found, and no span has fewer than min_words. Rows that repeat doc_id and text count as one
    document; rows of one doc_id with different texts are told apart by text_id, and repeat nothing of each other unless
    `within`. Other columns are not read; an empty table gives no row.
    """
    found = materialise(passages(docs, min_words))
    rank = F.struct("doc_id", "text_id", "start") if within else F.col("doc_id")
    # a digest of many rows is summed up before the shuffle here, and split by the join below, which reads the digests that
    # recur from a table: Spark splits no join above an aggregation
    firsts = found.groupBy("digest").agg(F.min(rank).alias("first"), F.max(rank).alias("last"))
    firsts = materialise(firsts.filter("first <> last").select("digest", "first"))
    marked = found.join(firsts, "digest").filter(rank != F.col("first"))
    first_doc = F.col("first.doc_id") if within else F.col("first")
    # one document's passages are bounded by its text
    of_text = Window.partitionBy("doc_id", "text_id").orderBy("start")
    gap = F.col("before") - F.lag(F.col("before") + F.col("n_words"), 1, 0).over(of_text)
    marked = marked.withColumn("first_doc_id", first_doc).withColumn("cut", (gap >= LEAST_WORDS).cast("long"))
    spans = marked.withColumn("island", F.sum("cut").over(of_text)).groupBy("doc_id", "text_id", "island").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        (F.max(F.col("before") + F.col("n_words")) - F.min("before")).alias("n_words"),
        F.min_by("first_doc_id", "start").alias("first_doc_id"),
    )
    return spans.filter(F.col("n_words") >= min_words).drop("island")


def remove_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with the spans cut out of text; removed lists them with their original offsets (null without any). Columns
    of docs named text_id or removed are replaced; all others come through, whatever their names."""
    cuts = spans.groupBy("doc_id", "text_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("removed"))
    rows = docs.drop("text_id", "removed").withColumn("text_id", F.xxhash64("text"))
    rows = rows.join(cuts, ["doc_id", "text_id"], "left").drop("text_id")
    edges = F.concat(F.array(F.lit(0).cast("long")), F.col("removed.end"))
    starts = F.concat(F.col("removed.start"), F.array(F.length("text").cast("long")))
    kept = F.array_join(F.zip_with(edges, starts, lambda a, b: F.substr(F.col("text"), a + 1, b - a)), "")
    return rows.withColumn("text", F.when(F.col("removed").isNotNull(), kept).otherwise(F.col("text")))

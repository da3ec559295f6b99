"""Language identification by a bit-sliced Bloom filter of n-grams.

A filter holds, for each language, the n-grams of letters that a share of its documents have. The filters of all languages
lie across each other: row i of the table is a mask that says which languages' filters have bit i set. The rows that an
n-gram hashes to, combined by AND, are the mask of all languages that contain it, whatever their number. A text's n-grams
are looked up, the masks are counted language by language, and each count is corrected by what a filter as full as that
language's lets through by chance.

Learning is Spark's: n-grams of a bounded sample of documents are counted by language, shuffled as hashes, and become rows
of the table by an aggregation with OR; the table's size follows from the number of n-grams and the error rate asked for,
and is checked before it is sent to the executors.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, free_name, materialise, quoted, sized, small_batches

#: Lengths of n-grams, in letters; a word's ends count as spaces.
LENGTHS = (2, 3, 4)
#: Letters of a text that are looked up at once.
BLOCK = 1 << 18
_SPACE = 32
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def learnable(doc_id: Column) -> Column:
    """True for the documents to learn from; a null id is none."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def fold_table() -> np.ndarray:
    """For each code point its lower-case letter, or a space for what is no letter. Marks within a word (category M) are
    kept as they are."""
    out = np.full(0x110000, _SPACE, np.uint32)
    for code in range(0x110000):
        char = chr(code)
        if unicodedata.category(char)[0] in "LM":
            low = char.lower()
            out[code] = ord(low) if len(low) == 1 else code
    return out


class GramHashes:
    """Hashes of the n-grams of texts. The state is one table for each worker."""

    def __init__(self) -> None:
        self.fold = fold_table()

    def letters(self, text: str) -> np.ndarray:
        """Lower-case letters, one space for whatever stands between them, and at both ends; empty without a letter."""
        codes = self.fold[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        space = codes == _SPACE
        if space.all():
            return codes[:0]
        keep = ~space
        keep[1:] |= ~space[:-1]  # the first space behind a letter
        inner = codes[keep]
        ends = np.array([_SPACE], np.uint32)
        inner = inner[1:] if inner[0] == _SPACE else inner
        return np.concatenate([ends, inner, ends[: int(inner[-1] != _SPACE)]])

    def hashes(self, letters: np.ndarray) -> np.ndarray:
        """One for each n-gram, repeats included, but for those of spaces alone; grams across a space count too."""
        wide = letters.astype(np.uint64)
        out = []
        for n in LENGTHS:
            if len(wide) < n:
                continue
            gram = wide[: len(wide) - n + 1].copy()
            for i in range(1, n):
                gram = gram * np.uint64(0x110001) + wide[i : len(wide) - n + 1 + i]
            out.append(_mixed(gram + np.uint64(n)))
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MULTIPLIER
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


@dataclass(frozen=True)
class SlicedFilter:
    """rows[w, i]: bit b tells whether bit i of the filter of language 8 * w + b is set. passed: how often a filter lets
    an n-gram through that it does not hold."""

    languages: list[str]
    rows: np.ndarray
    probes: int
    passed: np.ndarray
    fallback: int

    def positions(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        """The rows of each n-gram, one probe after the other."""
        yield from probe_positions(hashes, self.probes, self.rows.shape[1])

    def masks(self, hashes: np.ndarray) -> list[np.ndarray]:
        """For each n-gram the languages that contain it, a byte for every eight languages."""
        at = list(self.positions(hashes))
        out = []
        for word in self.rows:
            found = word[at[0]]
            for more in at[1:]:
                found &= word[more]
            out.append(found)
        return out

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        """For each language how many of the n-grams it contains."""
        bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
        per = [np.bincount(mask, minlength=256) @ bits for mask in self.masks(hashes)]
        return np.concatenate(per)[: len(self.languages)].astype(float)

    def decide(self, hashes: Iterator[np.ndarray]) -> tuple[int, float]:
        """The number of the language and its share of all corrected counts; the fallback and 0 if none is left."""
        seen, n = np.zeros(len(self.languages)), 0
        for block in hashes:
            seen += self.counts(block)
            n += len(block)
        true = np.clip((seen - self.passed * n) / (1 - self.passed), 0, None)
        total = true.sum()
        if total <= 0:
            return self.fallback, 0.0
        best = int(true.argmax())  # of equal ones the first in the alphabet
        return best, float(true[best] / total)


def probe_positions(hashes: np.ndarray, probes: int, size: int) -> Iterator[np.ndarray]:
    """size is a power of two."""
    step = (hashes >> np.uint64(40)) | np.uint64(1)
    for i in range(probes):
        yield ((hashes + np.uint64(i) * step) & np.uint64(size - 1)).astype(np.int64)


def text_blocks(grams: GramHashes, text: str) -> Iterator[np.ndarray]:
    """The n-gram hashes of a whole text, block by block, without a gap at the blocks' ends."""
    letters = grams.letters(text)
    overlap = max(LENGTHS) - 1
    if len(letters) <= BLOCK:
        yield grams.hashes(letters)
        return
    for start in range(0, len(letters), BLOCK):
        part = letters[start : start + BLOCK + overlap]
        hashes = grams.hashes(part)
        extra = len(part) - min(BLOCK, len(part))  # the next block's grams
        if extra:
            keep, begin = [], 0
            for n in LENGTHS:
                here = len(part) - n + 1
                keep.append(hashes[begin : begin + min(here, BLOCK)])
                begin += here
            hashes = np.concatenate(keep)
        yield hashes


def labelled_sample(docs: DataFrame, lang: str, text: str, learn: Column, per_language: int) -> DataFrame:
    """lang, text of about per_language documents of each language (all, where there are no more): those whose hash is
    low. The share is the same for all documents of a language, so no language's rows need to meet in one task. Copies
    have the same hash: they are sampled together, and then count once."""
    rows = docs.select(quoted(lang).cast("string").alias("lang"), quoted(text).alias("text"), learn.alias("learn"))
    rows = rows.filter(F.col("learn") & F.col("lang").isNotNull())
    sizes = sized(rows.groupBy("lang").agg(F.count("*").alias("n")), 16 + F.length("lang"))
    share = F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("n"))
    key = F.xxhash64("text")
    picked = F.pmod(key, F.lit(1 << 30)) < share * (1 << 30)
    found = rows.join(sizes, "lang").filter(picked & F.col("text").isNotNull())
    return found.groupBy("lang", key.alias("key")).agg(F.min("text").alias("text")).select("lang", "text")


def learn(
    docs: DataFrame, learn_from: Column, lang: str = "lang", text: str = "text", per_language: int = 2_000, min_share: float = 0.02, error: float = 0.01, probes: int = 4
) -> SlicedFilter:
    """The filters of all languages of docs.

    An n-gram belongs to a language if at least min_share of its sampled documents (and two of them, if there are two)
    have it. The number of such n-grams of a language is below the mean number of different n-grams of a document divided
    by min_share, whatever the corpus. error: the false positives that the fullest filter may let through.
    """
    sample = materialise(labelled_sample(docs, lang, text, learn_from, per_language))
    sizes = {r["lang"]: r["n"] for r in sample.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    languages = sorted(sizes)
    if not languages:
        return SlicedFilter([], np.zeros((1, 8), np.uint8), 1, np.zeros(0), -1)
    number = {name: i for i, name in enumerate(languages)}

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = GramHashes()
        for batch in batches:
            for name, part in batch.groupby("lang"):
                held, counts, waiting, n = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0
                for own in part["text"]:
                    waiting.append(np.unique(np.concatenate(list(text_blocks(grams, own)))))
                    n += len(waiting[-1])
                    if n > 1 << 21:  # folded as it grows, so that memory holds different n-grams only
                        held, counts = _folded(held, counts, waiting)
                        waiting, n = [], 0
                held, counts = _folded(held, counts, waiting)
                yield pd.DataFrame({"language": number[name], "gram": held.view(np.int64), "n": counts})

    seen = small_batches(sample).mapInPandas(tally, "language int, gram long, n long").groupBy("language", "gram").agg(F.sum("n").alias("n"))
    least = F.lit(1.0)
    for name, i in number.items():
        least = F.when(F.col("language") == i, max(min_share * sizes[name], min(2, sizes[name]))).otherwise(least)
    held = materialise(seen.filter(F.col("n") >= least).select("language", "gram"))
    fullest = held.groupBy("language").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    size = 1 << max(3, math.ceil(math.log2(-probes * fullest / math.log1p(-(error ** (1 / probes))))))
    words = (len(languages) + 7) // 8
    if size * words > BROADCAST_BYTES:
        raise ValueError(f"a filter of {size * words} bytes for {len(languages)} languages is over {BROADCAST_BYTES}: raise min_share or error")

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes = batch["gram"].to_numpy(np.int64).view(np.uint64)
            language = batch["language"].to_numpy()
            for at in probe_positions(hashes, probes, size):
                yield pd.DataFrame({"row": at, "word": language // 8, "mask": 1 << (language % 8)})

    table = np.zeros((words, size), np.uint8)
    found = held.mapInPandas(bits, "row long, word int, mask int").groupBy("row", "word").agg(F.bit_or("mask").alias("mask")).toPandas()
    table[found["word"].to_numpy(), found["row"].to_numpy()] = found["mask"].to_numpy()  # no more rows than the checked size
    filled = np.array([((table[i // 8] >> (i % 8)) & 1).mean() for i in range(len(languages))])
    common = max(languages, key=lambda name: (sizes[name], [-ord(c) for c in name]))
    return SlicedFilter(languages, table, probes, filled**probes, number[common])


def _folded(held: np.ndarray, counts: np.ndarray, waiting: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not waiting:
        return held, counts
    every = np.concatenate([held, *waiting])
    weight = np.concatenate([counts, np.ones(len(every) - len(held), np.int64)])
    kinds, at = np.unique(every, return_inverse=True)
    return kinds, np.bincount(at, weights=weight, minlength=len(kinds)).astype(np.int64)


def with_language(docs: DataFrame, model: SlicedFilter, text: str = "text") -> DataFrame:
    """docs with lang_pred and score, which replace columns of these names.

    lang_pred is `und`, with score 0, for a null text, a text without a letter, and every text if nothing was learned. A
    text whose n-grams no language holds takes the language with most sampled documents, with score 0. Texts of any
    length are read whole, in blocks; columns of any names come through, rows do not meet each other.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size has been checked

    def decide(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own, grams = shared.value, GramHashes()
        for texts in batches:
            rows = []
            for one in texts:
                if not own.languages or not one or not any(map(str.isalpha, one)):
                    rows.append(("und", 0.0))
                    continue
                best, score = own.decide(text_blocks(grams, one))
                rows.append((own.languages[best], score))
            yield pd.DataFrame(rows, columns=["lang_pred", "score"])

    name = free_name(docs, "found")
    made = small_batches(docs).withColumn(name, F.pandas_udf(decide, "lang_pred string, score double")(quoted(text)))
    own = [quoted(c) for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    return made.select(*own, F.col(f"{name}.lang_pred").alias("lang_pred"), F.col(f"{name}.score").alias("score"))


def document_languages(docs: DataFrame, **options: float) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs, learned from those rows of docs that are not held out and
    have a lang. A null doc_id is not held out, and nothing is learned from its row. Repeated rows are judged each for
    itself; an empty table gives no row; a null or empty lang column leaves every text `und`. Other columns are not
    read."""
    model = learn(docs, learnable(F.col("doc_id")), **options)
    judged = with_language(docs.select("doc_id", "text"), model)
    held = F.col("doc_id").isNotNull() & ~learnable(F.col("doc_id"))
    return judged.select("doc_id", held.alias("held_out"), "lang_pred", "score")

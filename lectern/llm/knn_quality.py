"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

A text is described by hashed counts of its words and of the shapes of its words (`Word,` and `WORD!!` have different
shapes), by how often a word repeats the one before it, and by repeated lines. A truncated singular value decomposition
of the labelled texts gives the latent directions. The labelled vectors (at most 2 x sample_per_class, a fixed number
whatever the corpus) are broadcast; each block of documents takes one matrix product with them, exact cosines of every
document with every labelled text, and the nearest vote with their similarity.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, small_batches

WORDS, SHAPES, EXTRAS = 1024, 512, 4
WIDTH = WORDS + SHAPES + EXTRAS
#: Weight of each block of a text's vector, which has length one in each.
_WEIGHTS = (0.5, 1.0, 1.0)
_CACHE = 150_000


def word_shape(word: str) -> str:
    """Runs of capitals, small letters and digits become one A, a or 0; runs of the same other character one of it."""
    out = []
    for c in word:
        kind = "a" if c.islower() else "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != kind or (kind == "A" and len(out) < 2):
            out.append(kind)
    return "".join(out[:10])


class TextVectors:
    """Rows of WIDTH numbers for texts."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def _buckets(self, word: str) -> int:
        if len(self.known) > _CACHE:
            self.known.clear()
        core = "".join(filter(str.isalnum, word)).lower()
        a = zlib.crc32(core.encode("utf-8")) % WORDS
        b = zlib.crc32(word_shape(word).encode("utf-8")) % SHAPES
        self.known[word] = code = a << 16 | b
        return code

    def row(self, text: str | None) -> np.ndarray:
        out = np.zeros(WIDTH, np.float32)
        words = text.split() if text else []
        if not words:
            return out
        get = self.known.get
        codes = np.fromiter([c if (c := get(w)) is not None else self._buckets(w) for w in words], np.int64, len(words))
        n = len(words)
        out[:WORDS] = _unit(np.sqrt(np.bincount(codes >> 16, minlength=WORDS) / n))
        out[WORDS : WORDS + SHAPES] = _unit(np.sqrt(np.bincount(codes & 0xFFFF, minlength=SHAPES) / n))
        lines = [x for x in text.split("\n") if x.strip()]
        again = float((codes[1:] == codes[:-1]).mean()) if n > 1 else 0.0
        spread = len(np.unique(codes >> 16)) / min(n, WORDS)
        extras = (again, 1 - len(set(lines)) / max(1, len(lines)), 1 - min(1.0, spread), 1 / (1 + n / 20))
        out[WORDS + SHAPES :] = np.array(extras, np.float32)
        out[:WORDS] *= _WEIGHTS[0]
        out[WORDS : WORDS + SHAPES] *= _WEIGHTS[1]
        out[WORDS + SHAPES :] *= _WEIGHTS[2]
        return out


def _unit(v: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(v, axis=-1, keepdims=True)
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def labelled_sample(labels: DataFrame, label: Column, per_class: int) -> DataFrame:
    """doc_id, y of at most per_class documents of each class, in order of a hash of the id; held-out ids are left out.

    A document with labels of both classes, or without id or label, is in neither.
    """
    rows = labels.select("doc_id", label.cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    rows = rows.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("top"))
    rows = rows.filter("y = top").select("doc_id", "y", F.xxhash64("doc_id").alias("at"))
    each = [rows.filter(f"y = {y}").orderBy("at", "doc_id").limit(per_class) for y in (0, 1)]
    return each[0].unionByName(each[1]).select("doc_id", "y")


def text_key(text: str | None) -> int:
    return zlib.crc32(text.encode("utf-8")) << 31 | len(text) if text else 0


def fit(docs: DataFrame, labels: DataFrame, sample_per_class: int, rank: int) -> dict:
    """Latent directions; of each labelled text, in order of the ids, its vector, the weight that it votes with (the
    classes weigh the same), its label and its key."""
    sample = labelled_sample(labels, F.col("quality"), sample_per_class)

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vectors = TextVectors()
        for batch in batches:
            rows = [vectors.row(t) for t in batch["text"]]
            at = [np.flatnonzero(r) for r in rows]
            values = [r[i].tolist() for r, i in zip(rows, at, strict=True)]
            keys = [text_key(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "y": batch["y"], "key": keys, "at": [i.tolist() for i in at], "value": values})

    # the sample's ids are bounded by 2 * sample_per_class, so they are the side to broadcast; of several texts of a
    # doc_id the first in the alphabet counts
    texts = small_batches(docs).select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    found = texts.mapInPandas(sparse, "doc_id long, y int, key long, at array<int>, value array<float>")
    rows = found.toPandas().sort_values("doc_id")
    rows = rows[rows["at"].map(len) > 0]
    x = np.zeros((len(rows), WIDTH), np.float32)
    for i, (at, value) in enumerate(zip(rows["at"], rows["value"], strict=True)):
        x[i, np.asarray(at, int)] = value
    y = rows["y"].to_numpy(np.float32)
    spread = x.T @ x  # WIDTH x WIDTH, whatever the sample
    values, directions = np.linalg.eigh(spread)
    directions = np.ascontiguousarray(directions[:, ::-1][:, :rank])
    good = max(1.0, float(y.sum())), max(1.0, float((1 - y).sum()))
    weight = np.where(y > 0, 1 / good[0], 1 / good[1]) * len(y) / 2
    by_key: dict[int, list[int]] = {}
    for i, key in enumerate(rows["key"].tolist()):
        by_key.setdefault(key, []).append(i)
    return {"directions": directions, "vectors": _unit(x @ directions), "y": y, "weight": weight.astype(np.float32), "by_key": by_key}


def nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest numbers of each row, ties to the lower column."""
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(cosine, near, axis=1).min(axis=1)
    for i in np.flatnonzero((cosine >= least[:, None]).sum(axis=1) > k):
        near[i] = np.argsort(-cosine[i], kind="stable")[:k]
    return near


def vote(model: dict, texts: Sequence[str | None], vectors: TextVectors, neighbours: int) -> np.ndarray:
    """The scores of a block of texts."""
    y = model["y"]
    z = _unit(np.stack([vectors.row(t) for t in texts]) @ model["directions"])
    out = np.full(len(texts), 0.5)
    if len(y):
        cosine = z @ model["vectors"].T
        for i, text in enumerate(texts):  # no labelled text votes on itself or a copy
            cosine[i, model["by_key"].get(text_key(text), [])] = -1
        near = nearest(cosine, min(neighbours, len(y)))
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0) ** 8 * model["weight"][near]
        total = weight.sum(axis=1)
        votes = (weight * y[near]).sum(axis=1)
        out = np.where(total > 0, votes / np.where(total > 0, total, 1), 0.5)
    out[[not (t and t.split()) for t in texts]] = 0.0
    return np.clip(out, 0.0, 1.0)


def with_scores(
    docs: DataFrame,
    labels: DataFrame,
    sample_per_class: int = 1500,
    rank: int = 48,
    neighbours: int = 15,
) -> DataFrame:
    """The rows of docs, all columns, with score (which replaces a column of that name).

    score is the share of good ones among the nearest labelled texts, weighted by similarity and so that both classes of
    the sample weigh the same. A labelled text has no vote on itself or on its exact copies. A text without words (null,
    empty, blank) scores 0: it is of no use, whatever its neighbours; a text that resembles nothing labelled, and every
    text if nothing is labelled, 0.5. Ties in similarity go to the labelled text of lower id; of several texts of a
    labelled doc_id the first in the alphabet is learned from. Texts of any length are read whole. Repeated rows are
    scored each for itself, null ids too. Columns other than doc_id and text are not looked at; an empty table gives no
    row.
    """
    model = fit(docs, labels, sample_per_class, rank)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vectors = TextVectors()
        for texts in batches:
            own = texts.tolist()
            parts = [vote(shared.value, own[i : i + 512], vectors, neighbours) for i in range(0, len(own), 512)]
            yield pd.Series(np.concatenate([np.zeros(0), *parts]))

    return docs.withColumn("score", F.pandas_udf(score, "double")("text"))


def quality_scores(docs: DataFrame, labels: DataFrame, **options: int) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; predicted is 1 from 0.5 on. A null doc_id is not held
    out. The rest is as with_scores says."""
    scored = with_scores(docs.select("doc_id", "text"), labels, **options)
    # the score is computed once: both columns that use it are made above its projection
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )

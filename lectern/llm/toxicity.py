"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The features of a text are densities of three lexicons (a given list of insults, and words and word beginnings that
the labels show to stand in toxic texts), how near they stand to a second person, capitals, exclamation marks and other punctuation, and
the rate of obfuscated spellings (`1d1ot`, `i-d-i-o-t`, `stuuupid`, letters set apart). Labels are learned from a
bounded sample of the rows that are not held out, cross-fitted in FOLDS parts by a hash of the id: a part's features come
from a lexicon, and the margins that it is calibrated by from trees, that have not seen its labels. So every label serves
all three, and no part checks itself; few labels are enough.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, materialise, small_batches

INSULTS = (
    "idiot moron stupid dumb loser scum trash pathetic worthless disgusting clown imbecile fool jerk bastard bitch "
    "asshole shit fuck fucking crap whore slut retard vermin parasite filth garbage ugly hate kill die "
    "dummkopf arschloch trottel abschaum wertlos arsch schlampe connard salope imbécile débile ordure crétin pute "
    "imbécil estúpido estúpida basura inútil gilipollas cabrón puta asqueroso pendejo"
).split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti usted ustedes tus vosotros".split()
FEATURES = (
    "log_words", "insults", "insults_log", "learned", "learned_log", "obfuscated", "obfuscated_log",
    "second_person", "near_second_person", "capitals", "exclamations", "punctuation", "mixed_digits", "apart",
    "stems", "stems_log",
)
_LEET = str.maketrans("013457@$!|", "oieastasil")
_REPEATS = re.compile(r"(.)\1+")
_CACHE = 150_000
_NEAR = 5
#: Letters of a word's beginning.
STEM = 5
#: Parts of the labelled sample; and the weight of the trees' own probability beside the calibrated one.
FOLDS, SMOOTH = 3, 0.25


def _core(word: str) -> str:
    return word.strip("".join({c for c in word if not c.isalnum()})).lower()


class ToxicFeatures:
    """Rows of FEATURES for texts; insults and learned hold lower-case words, learned also beginnings like `idio*`."""

    FLAGS = 9  # insult, learned, obfuscated, second person, capitals, exclamations, punctuation, mixed digits, stem

    def __init__(self, insults: Sequence[str], learned: Sequence[str]) -> None:
        self.insults, self.learned = set(insults), {w for w in learned if w[-1:] != "*"}
        self.stems = {w[:-1] for w in learned if w[-1:] == "*"}
        self.squeezed = {_REPEATS.sub(r"\1", w) for w in self.insults | self.learned if len(w) > 3}
        self.persons = set(SECOND_PERSON)
        self.known: dict[str, int] = {}
        self.flags = np.zeros((1024, self.FLAGS), np.float32)

    def _number(self, word: str) -> int:
        if len(self.known) >= _CACHE:
            self.known.clear()
        n = len(self.known)
        if n >= len(self.flags):
            self.flags = np.concatenate([self.flags, np.zeros_like(self.flags)])
        core = _core(word)
        hit, taught = core in self.insults, core in self.learned
        plain = "".join(filter(str.isalpha, core.translate(_LEET)))
        hidden = len(core) > 3 and not (hit or taught) and _REPEATS.sub(r"\1", plain) in self.squeezed
        letters = sum(map(str.isalpha, word))
        marks = sum(not c.isalnum() for c in word)
        mixed = letters > 0 and any(map(str.isdigit, word))
        capital = letters > 1 and word.isupper()
        self.flags[n] = (hit, taught, hidden, core in self.persons, capital, word.count("!"), marks, mixed, core[:STEM] in self.stems)
        self.known[word] = n
        return n

    def _apart(self, words: list[str], numbers: np.ndarray) -> int:
        """Insults whose letters stand apart: runs of one-letter words are joined and looked up."""
        short = np.fromiter((len(w) < 3 for w in words), bool, len(words))
        if short.sum() < 4:
            return 0
        found, run = 0, ""
        for word, is_short in zip([*words, "   "], [*short, False], strict=True):
            letter = _core(word) if is_short else ""
            if len(letter) == 1:
                run += letter
            else:
                found += any(w in run for w in self.insults if len(w) > 3) if len(run) > 3 else 0
                run = ""
        return found

    def row(self, text: str | None) -> list[float]:
        words = text.split() if text else []
        if not words:
            return [0.0] * len(FEATURES)
        get, n = self.known.get, len(words)
        if len(self.known) + n >= _CACHE:
            self.known.clear()  # before a text, so that all its words keep their numbers
        if n >= _CACHE:
            return self._long_row(words)
        numbers = np.fromiter([i if (i := get(w)) is not None else self._number(w) for w in words], np.int64, n)
        return self._finish(self.flags[numbers], words, numbers)

    def _long_row(self, words: list[str]) -> list[float]:
        flags = []
        for start in range(0, len(words), _CACHE // 2):
            self.known.clear()
            part = [self.known[w] if w in self.known else self._number(w) for w in words[start : start + _CACHE // 2]]
            flags.append(self.flags[np.array(part)])
        return self._finish(np.concatenate(flags), words, None)

    def _finish(self, flags: np.ndarray, words: list[str], numbers: np.ndarray | None) -> list[float]:
        n = len(words)
        insult, taught, hidden, person, capital, calls, marks, mixed, stem = flags.sum(axis=0, dtype=np.float64)
        hits = np.flatnonzero(flags[:, :3].any(axis=1))
        near = 0
        if len(hits) and person:
            persons = np.flatnonzero(flags[:, 3])
            at = np.searchsorted(persons, hits)
            left = np.abs(hits - persons[np.maximum(at - 1, 0)])
            right = np.abs(persons[np.minimum(at, len(persons) - 1)] - hits)
            near = int((np.minimum(left, right) <= _NEAR).sum())
        apart = self._apart(words, numbers)
        return [
            np.log1p(n), 100 * insult / n, np.log1p(insult), 100 * taught / n, np.log1p(taught),
            100 * (hidden + apart) / n, np.log1p(hidden + apart), 100 * person / n, np.log1p(near),
            capital / n, calls / n, marks / n, mixed / n, np.log1p(apart), 100 * stem / n, np.log1p(stem),
        ]


def features(docs: DataFrame, keep: Sequence[str], learned: Sequence[str], insults: Sequence[str] = INSULTS) -> DataFrame:
    """keep and the features as an array column x, for every row."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = ToxicFeatures(insults, learned)
        for texts in batches:
            yield pd.Series([[float(v) for v in of.row(t)] for t in texts])

    return small_batches(docs).select(*keep, F.pandas_udf(run, "array<double>")("text").alias("x"))


def learn_lexicon(texts: DataFrame, size: int, least: int = 3) -> list[str]:
    """The words, and beginnings of words (with a star), whose texts are toxic far more often than others: at most size
    of each. texts: text, y."""
    total = texts.agg(F.avg("y")).first()[0] or 0.0
    words = F.filter(F.split(F.lower("text"), "[^\\p{L}\\p{N}]+"), lambda w: F.length(w) > 2)
    stems = F.transform(F.filter(words, lambda w: F.length(w) > STEM), lambda w: F.concat(w.substr(1, STEM), F.lit("*")))
    units = F.array_union(words, stems)
    seen = texts.select("y", F.explode(units).alias("unit")).groupBy("unit").agg(F.sum("y").alias("toxic"), F.count("*").alias("n"))
    share = F.col("toxic") / F.col("n")
    is_stem = F.endswith("unit", F.lit("*"))
    enough = F.when(is_stem, share >= min(0.7, 3 * total)).otherwise(share >= 0.7)
    seen = seen.filter((F.col("toxic") >= least) & enough).withColumn("is_stem", is_stem)
    ranked = seen.orderBy((F.col("toxic") * share).desc(), "unit")
    return [r["unit"] for kind in (False, True) for r in ranked.filter(F.col("is_stem") == kind).limit(size).collect()]


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    sample: int = 12_000,
    lexicon_size: int = 200,
    trees: int = 12,
    depth: int = 3,
    threshold: float = 0.7,
) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    score is the calibrated probability of toxic = 1. At most `sample` labelled rows that are not held out, in order
    of a hash of their id, are learned from; where they lack a class, or have one in a single part only, every score is
    the share of toxic ones among them (0 without any). A null or
    empty text has all features zero and is scored like any other; texts of any length are read whole. Texts of the same
    features tie in score. Of several texts of a labelled doc_id the first in the alphabet is learned from, and the
    document is toxic if any of its labels is. Repeated rows are scored each for itself, null ids too. Other columns are
    not read; an empty table gives no row.
    """
    rows = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    rows = rows.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    texts = materialise(texts.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)).cast("int")))
    grouped = texts.groupBy("y").agg(F.count("*").alias("n"), F.count_distinct("part").alias("parts")).collect()
    counts = {r["y"]: r["n"] for r in grouped}
    held = held_out(F.col("doc_id")).alias("held_out")
    if len(counts) < 2 or min(r["parts"] for r in grouped) < 2:  # some part would have nothing to learn a class from
        n = sum(counts.values())
        scored = docs.select("doc_id", held, F.lit(counts.get(1, 0) / n if n else 0.0).alias("score"))
        return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    vector = array_to_vector("x").alias("features")
    # each part's features come from a lexicon, and its margins from trees, that have not seen its labels
    known = None
    for part in range(FOLDS):
        others = learn_lexicon(texts.filter(F.col("part") != part), lexicon_size)
        own = features(texts.filter(F.col("part") == part), ["y", "part"], others)
        known = own if known is None else known.unionByName(own)
    known = materialise(known.coalesce(8))
    fitted = known.select(F.col("y").cast("double").alias("label"), "part", vector).coalesce(2)
    margin = vector_to_array("probability")[1].alias("margin")
    boosted = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7, labelCol="label")
    unseen = None
    for part in range(FOLDS):
        judged = boosted.fit(fitted.filter(F.col("part") != part)).transform(fitted.filter(F.col("part") == part)).select("label", margin)
        unseen = judged if unseen is None else unseen.unionByName(judged)
    calibrator = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="score").fit(materialise(unseen))
    model = boosted.fit(fitted)
    learned = learn_lexicon(texts, lexicon_size)
    scored = calibrator.transform(model.transform(features(docs, ["doc_id"], learned).select("doc_id", vector)).select("doc_id", margin))
    # the mean with the trees' own probability: steps of few rows are rough, and ties within a step keep their order
    smooth = (1 - SMOOTH) * F.col("score") + SMOOTH * F.col("margin")
    scored = scored.select("doc_id", held, F.least(F.greatest(smooth, F.lit(0.0)), F.lit(1.0)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

"""Periodic runs of words by seeds on diagonals.

A run of period q and length L matches itself shifted by q over L - q words: one stretch of the diagonal of lag q. Lags
are taken in tiers from 2^t to 2^(t+1) - 1. Every run whose period q is in the tier has at least k words on its diagonal,
the least of max(min_length - q, (exponent - 1) * q), so k-grams are its seeds. As k is no less than any such period, two
places of a k-gram inside a run stand a multiple of the period apart; so it is enough to look at neighbouring places of
each k-gram, of which there are as many as words, and never at all pairs of places. A seed is extended along its diagonal
unless the table of how far each lag has been covered says that it lies in a stretch that is known already.

K-grams are told apart exactly: grams of twice the length are numbered by the pairs of numbers of their halves. A text of
n words takes time in proportion to n log^2 n at most, and stops at the first tier of which no gram occurs twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, quoted, small_batches

Run = tuple[int, int, int]


def word_numbers(words: list[bytes]) -> np.ndarray:
    """A number for each word, the same for equal words."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def _numbered(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A number below n for each of the n pairs, the same for equal pairs."""
    pairs = left * (int(right.max()) + 1) + right  # numbers are below n, so the product fits
    return np.unique(pairs, return_inverse=True)[1]


def _seeds(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each place of a gram and how far behind it the next place of the same gram is."""
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    same = ranked[1:] == ranked[:-1]
    return order[:-1][same], (order[1:] - order[:-1])[same]


def _end_of_match(ids: np.ndarray, at: int, lag: int) -> int:
    """The first place from `at` on where the diagonal does not match."""
    step, last = 32, len(ids) - lag
    while at < last:
        to = min(last, at + step)
        differs = ids[at:to] != ids[at + lag : to + lag]
        first = int(differs.argmax())
        if differs[first]:
            return at + first
        at, step = to, step * 2
    return last


def _start_of_match(ids: np.ndarray, at: int, lag: int) -> int:
    """The first place of the matching stretch that ends before `at`."""
    step = 32
    while at > 0:
        to = max(0, at - step)
        differs = ids[to:at][::-1] != ids[to + lag : at + lag][::-1]
        first = int(differs.argmax())
        if differs[first]:
            return at - first
        at, step = to, step * 2
    return 0


def find_runs(ids: np.ndarray, min_length: int = 6, exponent: int = 4) -> list[Run]:
    """(start, length, period) of all runs, by start, then period: stretches of smallest period q and of max(min_length,
    exponent * q) numbers at least that cannot be extended to either side with that period."""
    n = len(ids)
    periods: dict[tuple[int, int], int] = {}
    covered: dict[int, int] = {}
    levels = [ids]  # levels[j]: numbers of the grams of 2^j words
    low, turn = 1, min_length // exponent  # up to `turn` the guaranteed overlap falls with the period, then it rises
    while n >= max(min_length, exponent * low):
        k = min(max(min_length - q, (exponent - 1) * q) for q in (low, turn, turn + 1, 2 * low - 1) if low <= q < 2 * low)
        while 2 ** len(levels) <= k:
            half, width = levels[-1], 2 ** (len(levels) - 1)
            levels.append(_numbered(half[:-width], half[width:]))
        j = k.bit_length() - 1
        grams, rest = levels[j], k - 2**j
        if rest:
            grams = _numbered(grams[: len(grams) - rest], grams[rest:])
        at, lags = _seeds(grams)
        if not len(at) and low > turn:
            break  # longer grams do not occur twice either
        fits = (lags >= low) & (lags < 2 * low)
        at, lags = at[fits], lags[fits]
        order = np.lexsort((at, lags))
        at, lags = at[order], lags[order]
        # seeds that touch the one before on the same diagonal belong to its stretch
        heads = np.ones(len(at), bool)
        heads[1:] = (lags[1:] != lags[:-1]) | (at[1:] > at[:-1] + k)
        for start, lag in zip(at[heads].tolist(), lags[heads].tolist(), strict=True):
            if start < covered.get(lag, -1):
                continue
            end = _end_of_match(ids, start + k, lag)
            start = _start_of_match(ids, start, lag)
            covered[lag] = end
            length = end - start + lag
            if length >= max(min_length, exponent * lag):
                periods[start, length] = min(lag, periods.get((start, length), lag))
        low *= 2
    return sorted((start, length, period) for (start, length), period in periods.items())


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """False for each of the n words that some run contains behind its first period."""
    steps = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return steps.cumsum()[:n] == 0


def periodic_runs(docs: DataFrame, text: str = "text", min_length: int = 6, exponent: int = 4) -> DataFrame:
    """docs with n_words, runs (an array of start, length, period, by start and period, counted in words) and collapsed
    (the words that no run repeats, joined by single spaces), which replace columns of these names.

    Words are what stands between ASCII white space. A null, empty or blank text has no words, no runs and an empty
    collapsed text. Of a run its first period is kept, unless another run repeats it. exponent is 3 or more: with less a
    seed could be shorter than a period. Texts of any length are read whole, each in the task that holds its row; rows do
    not meet each other, so repeated rows, ties and null ids come through as they are, as do columns of any names. An
    empty table gives no row.
    """
    if exponent < 3 or min_length < 1:
        raise ValueError("exponent must be 3 or more, min_length 1 or more")

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for own in texts:
                words = own.encode().split() if own else []  # bytes are split at ASCII white space
                runs = find_runs(word_numbers(words), min_length, exponent) if words else []
                if runs:
                    words_left = [w for w, stays in zip(words, kept_words(len(words), runs).tolist(), strict=True) if stays]
                else:
                    words_left = words
                starts, lengths, periods = ([r[i] for r in runs] for i in range(3))
                rows.append((len(words), starts, lengths, periods, b" ".join(words_left).decode()))
            yield pd.DataFrame(rows, columns=["n_words", "start", "length", "period", "collapsed"])

    schema = "n_words long, start array<long>, length array<long>, period array<long>, collapsed string"
    found = F.pandas_udf(run, schema)(quoted(text))
    name = free_name(docs, "found")
    made = small_batches(docs).withColumn(name, found)
    own = [quoted(c) for c in docs.columns if c.lower() not in ("n_words", "runs", "collapsed")]
    runs = F.arrays_zip(f"{name}.start", f"{name}.length", f"{name}.period").alias("runs")
    return made.select(*own, F.col(f"{name}.n_words").alias("n_words"), runs, F.col(f"{name}.collapsed").alias("collapsed"))


def strongest(runs: Column) -> Column:
    """The run of the greatest length / period, compared exactly; of equal ones the first in order; null without runs."""
    better = lambda a, b: a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"])
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    return F.reduce(runs, none, lambda a, b: F.when(better(a, b), b).otherwise(a))

"""Quality rules with risk-controlled thresholds.

Each rule rejects documents whose metric exceeds a cutoff. The cutoffs are not guessed. A ladder of settings, fixed
beforehand, goes from loose to strict: on each step all rules tighten together along their grids. On labelled good
documents the false rejections of a step are counted, of all its rules together, and the exact (Clopper-Pearson) upper
bound of their rate is tested against the allowed risk; the last step before the first failure is taken. Going through
a fixed sequence needs no correction along it.

Two families of tests share the error level. Half of it is divided over the strata (Bonferroni): with probability
1 - delta for all strata together, the share of rejected good documents of a stratum with labels enough is max_risk at
most; if its own first step fails, the rules reject nothing in it. The other half goes to one ladder over all documents:
only a stratum with so few labels that it could not pass a step without a single error takes the cutoffs found there, for
which the guarantee holds over all documents together. Where that fails too, for want of labels, the rules reject
nothing. All this provided that the labelled documents are drawn like the others; exact copies among them count as one
trial.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, quoted, sized, small_batches

_SYMBOLS = re.compile(r"[#*$%&|<>]")
#: Metric (higher is worse) and its cutoffs from the loosest to the strictest; the ladder's steps are their numbers.
RULES: dict[str, Sequence[float]] = {
    "symbols_per_word": tuple(x / 100 for x in range(200, 4, -5)),
    "dup_line_share": tuple(x / 100 for x in range(98, 19, -2)),
    "repeat_share": tuple(x / 100 for x in range(49, 9, -1)),
    "upper_share": tuple(x / 100 for x in range(98, 19, -2)),
}
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


def text_counts(text: str | None) -> tuple[int, ...]:
    """The counts of _COUNTS for one whole text; zeros for null or empty.

    Words are runs of anything but the ASCII white space 20, 09-0D. A word counts as repeated if it lies in a window
    of three words that occurs at least twice in the text.
    """
    if not text:
        return (0,) * len(_COUNTS)
    raw = text.encode("utf-8")
    words = raw.split()  # bytes.split cuts at exactly these six characters
    spaces = sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    lines = [line for line in raw.split(b"\n") if line.split()]
    upper = sum(map(bytes.isupper, words))
    return (
        len(words), len(text) - spaces, len(_SYMBOLS.findall(text)), len(lines) - len(set(lines)),
        _repeated_words(words), len(lines), upper,
    )


def _repeated_words(words: list[bytes]) -> int:
    if len(words) < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    n = len(numbers)
    if n < 2_000_000:
        windows = (ids[:-2] * n + ids[1:-1]) * n + ids[2:]
        order = np.argsort(windows, kind="stable")
        ranked = windows[order]
        same = ranked[1:] == ranked[:-1]
        twice = np.zeros(len(windows), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
    else:  # the product of three numbers would not fit into 63 bits
        keys = list(zip(ids[:-2].tolist(), ids[1:-1].tolist(), ids[2:].tolist(), strict=True))
        seen = Counter(keys)
        twice = np.fromiter((seen[k] > 1 for k in keys), bool, len(keys))
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + len(twice)] |= twice
    return int(covered.sum())


def count_texts() -> Callable[[str], Column]:
    """A function from the name of a text column to the struct of its counts."""

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(map(text_counts, texts), columns=_COUNTS, dtype="int64")

    return F.pandas_udf(count, T.StructType([T.StructField(c, T.LongType()) for c in _COUNTS]))


def metrics() -> dict[str, Column]:
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "symbols_per_word": per("n_symbols", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_share": per("n_repeat_words", "n_words"),
        "upper_share": per("n_upper", "n_words"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_upper(errors: int, n: int, level: float) -> float:
    """Exact one-sided upper confidence bound (Clopper-Pearson) for a rate with `errors` in `n` trials."""
    if errors >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) for k in range(errors + 1)]
    low, high = errors / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        terms = [c + k * math.log(p) + (n - k) * math.log1p(-p) for k, c in enumerate(logs)] if 0 < p < 1 else [0.0]
        top = max(terms)
        tail = top + math.log(sum(math.exp(t - top) for t in terms))
        low, high = (p, high) if tail > math.log(level) else (low, p)
    return high


def last_step(n: int, errors: Sequence[int], max_risk: float, level: float) -> int:
    """The number of steps that pass before the first failure: errors[i] of n good documents are rejected on step i."""
    for i, wrong in enumerate(errors):
        if n < 1 or wrong >= max_risk * n or binomial_upper(wrong, n, level) > max_risk:
            return i
    return len(errors)


def own_step(n: int, errors: Sequence[int], max_risk: float, level: float) -> int | None:
    """last_step of a stratum; None if it has too few good documents for any step, however few errors they show."""
    return last_step(n, errors, max_risk, level) if n > 0 and binomial_upper(0, n, level) <= max_risk else None


def choose_steps(counts: DataFrame, steps: int, max_risk: float, delta: float) -> tuple[DataFrame, int]:
    """stratum, taken: the steps of each stratum with labels enough; and those found over all documents, for the others.

    counts: stratum, n (its good documents) and e0, e1, ... (their false rejections on each step), a row for each
    stratum. Rows stay on the executors; only sums reach the driver."""
    total = counts.agg(F.count("*").alias("strata"), F.sum("n").alias("n"), *(F.sum(f"e{i}").alias(f"e{i}") for i in range(steps))).first()
    overall = last_step(total["n"] or 0, [total[f"e{i}"] for i in range(steps)], max_risk, delta / 2) if total["strata"] else 0
    level = delta / 2 / max(1, total["strata"])

    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ns, errors in batches:
            yield pd.Series([own_step(int(n), list(e), max_risk, level) for n, e in zip(ns, errors, strict=True)], dtype="Int64")

    taken = F.pandas_udf(judge, "int")("n", F.array(*(F.col(f"e{i}") for i in range(steps))))
    return counts.select("stratum", taken.alias("taken")).filter("taken is not null"), overall


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    stratum: str = "lang",
    max_risk: float = 0.02,
    delta: float = 0.05,
    rules: Mapping[str, Sequence[float]] = RULES,
) -> DataFrame:
    """doc_id, the counts, base_failed, failed_rule (first rule that rejects, else null), kept: one row per row of docs.

    stratum names a column; null is a stratum of its own, and one with too few labels takes the cutoffs found over all
    documents. Good documents are
    those with labels.quality = 1 that pass the base; a doc_id labelled twice counts once, as good if any of its labels
    is. Null or empty texts have zero counts and fail the base; texts of any length are counted whole; a metric equal to
    its cutoff passes. Repeated rows are judged each for itself, null ids too. Empty docs give no row; empty labels leave
    the base alone. Other columns are not read. The rules' grids must have the same number of cutoffs.
    """
    (steps,) = {len(grid) for grid in rules.values()} or {0}
    counted = small_batches(docs).select("doc_id", F.coalesce(quoted(stratum).cast("string"), F.lit("")).alias("stratum"), "text")
    counted = counted.withColumn("counts", count_texts()("text")).withColumn("copy", F.xxhash64("text"))
    counted = materialise(counted.select("doc_id", "stratum", "copy", "counts.*"))  # read twice; a few numbers for each document
    good = labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct()
    passed = counted.filter(~base_failed()).join(good, "doc_id", "left_semi").dropDuplicates(["stratum", "copy"])

    def rejected(step: int) -> Column:
        return reduce(Column.__or__, (metrics()[rule] > grid[step] for rule, grid in rules.items()))

    counts = passed.groupBy("stratum").agg(F.count("*").alias("n"), *(F.count_if(rejected(i)).alias(f"e{i}") for i in range(steps)))
    chosen, overall = choose_steps(materialise(counts), steps, max_risk, delta)
    # a row for each stratum with labels: sent to all executors if they are measured to be few
    counted = counted.join(sized(chosen, F.length("stratum") + 16), "stratum", "left")
    counted = counted.withColumn("taken", F.coalesce("taken", F.lit(overall)))
    failed = F.lit(None).cast("string")
    for rule in reversed(list(rules)):
        cutoff = F.element_at(F.array(F.lit(float("inf")), *map(F.lit, rules[rule])), F.col("taken") + 1)
        failed = F.when(metrics()[rule] > cutoff, rule).otherwise(failed)
    judged = counted.select("doc_id", *_COUNTS, base_failed().alias("base_failed"), failed.alias("failed_rule"))
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("failed_rule").isNull())

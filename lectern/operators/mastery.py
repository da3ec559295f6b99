"""Mastery of knowledge points, folded from answer events in the order of time, then event id."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as X

#: Score at the start; weights by difficulty; bounds of the levels; days to the next review by level.
START = 50
WEIGHTS = {"easy": 0.75, "normal": 1.0, "hard": 1.25}


def score_delta(correct: Column, difficulty: Column, confidence: Column, score: Column, streak: Column) -> Column:
    """Change of the score by one answer, rounded half to even."""
    weight = F.when(difficulty == "easy", 0.75).when(difficulty == "hard", 1.25).otherwise(1.0)
    sure = F.when(confidence.isNull(), 1.0).otherwise(0.75 + 0.5 * F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0)))
    room = F.greatest(F.lit(0.35), (100 - score) / 100.0)
    gain = F.greatest(F.lit(1.0), F.rint((8 + F.least(F.greatest(streak, F.lit(0)), F.lit(3))) * weight * sure * room))
    loss = F.greatest(F.lit(4.0), F.rint(12 * weight * sure * F.greatest(F.lit(0.5), score / 100.0)))
    return F.when(correct, gain).otherwise(-loss).cast("int")


def mastery_level(score: Column) -> Column:
    return F.when(score < 40, "weak").when(score < 60, "building").when(score < 80, "familiar").otherwise("mastered")


def review_days(score: Column, correct: Column) -> Column:
    """Days to the next review; a wrong answer is due the next day."""
    by_score = F.when(score < 40, 1).when(score < 60, 2).when(score < 80, 4).otherwise(7)
    return F.when(correct, by_score).otherwise(1)


def fold_delta(correct: bool, difficulty: str | None, confidence: float | None, score: int, streak: int) -> int:
    """score_delta for one answer; round() goes half to even as rint does."""
    weight = {"easy": 0.75, "hard": 1.25}.get(difficulty, 1.0)
    known = confidence is not None and confidence == confidence
    sure = 0.75 + 0.5 * min(max(confidence, 0.0), 1.0) if known else 1.0
    if correct:
        return max(1, round((8 + min(max(streak, 0), 3)) * weight * sure * max(0.35, (100 - score) / 100.0)))
    return -max(4, round(12 * weight * sure * max(0.5, score / 100.0)))


_FOLDED = ("score", "attempts", "correct_count", "wrong_count", "streak")
#: What an answer depends on of all before it: the score, and the streak up to 3.
STATES = 101 * 4


class AnswerFunction:
    """A slice of a point's answers as one function from the state before to the state behind it.

    All states are carried through the slice at once; equal ones are merged as they meet, which a wrong answer does to
    the streaks and rounding to the scores, so a long slice soon carries a few only."""

    def __init__(self) -> None:
        self.image = np.arange(STATES)
        self.kinds = self.image

    def add(self, correct: bool, difficulty: str | None, confidence: float | None) -> None:
        score, streak = self.kinds // 4, self.kinds % 4
        weight = {"easy": 0.75, "hard": 1.25}.get(difficulty, 1.0)
        known = confidence is not None and confidence == confidence
        sure = 0.75 + 0.5 * min(max(confidence, 0.0), 1.0) if known else 1.0
        if correct:
            change = np.maximum(1, np.rint((8 + streak) * weight * sure * np.maximum(0.35, (100 - score) / 100.0)))
            streak = np.minimum(streak + 1, 3)
        else:
            change = -np.maximum(4, np.rint(12 * weight * sure * np.maximum(0.5, score / 100.0)))
            streak = np.zeros_like(streak)
        after = np.clip(score + change, 0, 100).astype(np.int64) * 4 + streak
        self.kinds, merged = np.unique(after, return_inverse=True)
        self.image = merged[self.image]

    def table(self) -> list[int]:
        return self.kinds[self.image].tolist()


class _Slice:
    """Answers of a point that follow each other: their numbers, and what becomes of the score and the streak."""

    def __init__(self, begin: list[int] | None) -> None:
        """begin: the state to go on from; None where an earlier slice may precede."""
        self.known = begin is not None
        self.score, self.attempts, self.right, self.wrong, self.streak = begin or [0] * 5
        self.function = None if self.known else AnswerFunction()
        self.all_right, self.last, self.at = True, None, None

    def add(self, at: str, correct: bool, difficulty: str | None, confidence: float | None) -> None:
        if self.known:
            self.score = min(max(self.score + fold_delta(correct, difficulty, confidence, self.score, self.streak), 0), 100)
        else:
            self.function.add(correct, difficulty, confidence)
        self.attempts, self.right, self.wrong = self.attempts + 1, self.right + correct, self.wrong + (not correct)
        self.streak = self.streak + 1 if correct else 0
        self.all_right, self.last, self.at = self.all_right and correct, correct, at

    def row(self) -> tuple:
        table = [] if self.known else self.function.table()
        return (self.score, self.attempts, self.right, self.wrong, self.streak, self.all_right, self.last, self.at, table)


_SLICE = ", ".join(f"{n} int" for n in _FOLDED) + ", all_right boolean, right boolean, at string, table array<int>"


def fold_answers(events: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """course_id, point_id, score, level, attempts, correct_count, wrong_count, streak, last_result, last_answered_at,
    review_interval_days, next_review_at. events: course_id, point_id, event_id, ts, correct, difficulty, confidence;
    initial: course_id, point_id, score, attempts, correct_count, wrong_count, streak to go on from.

    Each answer depends on the score before it, yet a point with a third of all answers is spread over many tasks: rows
    are sorted by ranges of point and time, and what a task has of a point that may have begun in an earlier range
    becomes a function on the STATES that matter. Only these functions, one for each range at most, meet to be applied
    in order; all other points are folded where they are, holding one state.
    """
    kinds = dict(events.dtypes)
    key = ["course_id", "point_id"]
    instant = kinds["ts"] == "timestamp"
    at = (F.unix_micros("ts") if instant else F.col("ts")).cast("string").alias("at")
    correct = F.coalesce("correct", F.lit(False)).alias("correct")
    none = F.lit(None).cast("array<int>").alias("begin")
    rows = events.select(*key, F.lit(1).alias("kind"), "ts", "event_id", at, correct, "difficulty", F.col("confidence").cast("double").alias("confidence"), none)
    if initial is not None:  # a row before all answers of its point
        have = {n: F.lit(None).cast(t).alias(n) for n, t in rows.dtypes}
        have |= {"kind": F.lit(0).alias("kind"), "begin": F.array(*(F.col(n).cast("int") for n in _FOLDED)).alias("begin")}
        have |= {c: F.col(c).cast(kinds[c]).alias(c) for c in key}
        rows = rows.unionByName(initial.select(*have.values()))
    order = [*key, "kind", "ts", "event_id"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # ids and times as text: pandas would change what has a null beside it
    plain = dealt.select(*(F.col(c).cast("string").alias(c) for c in key), "at", "correct", "difficulty", "confidence", "begin", F.spark_partition_id().alias("part"))
    default = [START, 0, 0, 0, 0]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, own, part, first = None, None, 0, True
        columns = [*key, "part", *(c.split()[0] for c in _SLICE.split(", "))]
        for batch in batches:
            done = []
            for course, point, at, correct, difficulty, confidence, begin, part in batch.itertuples(index=False, name=None):
                if current != (course, point):
                    if current is not None:
                        done.append((*current, part, *own.row()))
                    own = _Slice(list(map(int, begin)) if begin is not None else None if first else default)
                    current, first = (course, point), False
                if begin is None:
                    own.add(at, bool(correct), difficulty, confidence)
            yield pd.DataFrame(done, columns=columns)
        if current is not None:
            yield pd.DataFrame([(*current, part, *own.row())], columns=columns)

    slices = plain.mapInPandas(fold, f"course_id string, point_id string, part int, {_SLICE}")

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            done = []
            for course, point, _, score, attempts, right, wrong, streak, all_right, last, at, table in batch.itertuples(index=False, name=None):
                if current != (course, point):
                    if current is not None and state[5] is not None:
                        done.append((*current, *state))
                    current, state = (course, point), [*default, None, None]
                if len(table):
                    score = int(table[state[0] * 4 + min(max(state[4], 0), 3)]) // 4
                    counts = [state[1] + attempts, state[2] + right, state[3] + wrong]
                    streak = state[4] + streak if all_right else streak
                else:
                    counts = [attempts, right, wrong]
                state = [score, *counts, streak, *((last, at) if last is not None else state[5:])]
            yield pd.DataFrame(done, columns=[*key, *_FOLDED, "right", "at"])
        if current is not None and state[5] is not None:
            yield pd.DataFrame([(*current, *state)], columns=[*key, *_FOLDED, "right", "at"])

    # at most one row for each point and range
    met = slices.repartition(*key).sortWithinPartitions(*key, "part")
    folded = met.mapInPandas(join, "course_id string, point_id string, " + ", ".join(f"{n} int" for n in _FOLDED) + ", right boolean, at string")
    last = F.timestamp_micros(F.col("at").cast("long")) if instant else F.col("at").cast(kinds["ts"])
    days = review_days(F.col("score"), F.col("right"))
    return folded.select(
        *(F.col(c).cast(kinds[c]).alias(c) for c in key), *_FOLDED, mastery_level(F.col("score")).alias("level"),
        F.when(F.col("right"), "correct").otherwise("wrong").alias("last_result"), last.alias("last_answered_at"),
        days.alias("review_interval_days"), (last + F.make_interval(days=days)).alias("next_review_at"),
    )


def mistakes(events: DataFrame) -> DataFrame:
    """mistake_id, course_id, point_id, question, status, review_count, created_at for each wrong answer."""
    question = F.coalesce(F.nullif(X.clip_text(F.col("question"), 1000), F.lit("")), F.lit("未记录题目"))
    at = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    rows = events.filter(~F.col("correct")).withColumn("question", question)
    return rows.select(
        X.mistake_id(F.col("point_id"), F.col("question"), at).alias("mistake_id"), "course_id", "point_id", "question",
        F.lit("open").alias("status"), F.lit(0).alias("review_count"), F.col("ts").alias("created_at"),
    )


def resolve_mistakes(mistakes: DataFrame, resolutions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """mistakes with the resolutions (mistake_id, resolved_at) applied, and the resolutions of unknown ids."""
    done = resolutions.groupBy("mistake_id").agg(F.max("resolved_at").alias("resolved_at"))
    hit = F.col("resolved_at").isNotNull()
    out = mistakes.join(done, "mistake_id", "left").withColumns(
        {"status": F.when(hit, "resolved").otherwise(F.col("status")), "review_count": F.col("review_count") + hit.cast("int")}
    )
    return out, resolutions.join(mistakes.select("mistake_id").distinct(), "mistake_id", "left_anti")


def upsert_points(points: DataFrame, new: DataFrame) -> DataFrame:
    """points (point_id, title, aliases, source_refs, created_at, updated_at) with new rows: new fields win, created_at
    stays, aliases (24 at most, cut at 80) and references are merged in order."""
    rows = points.withColumn("gen", F.lit(0)).unionByName(new.withColumn("gen", F.lit(1)))
    order = F.struct("gen", "updated_at")
    merged = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("gen", "updated_at", c))), lambda x: x[c])))
    return rows.groupBy("point_id").agg(
        F.max_by("title", order).alias("title"),
        F.slice(F.array_distinct(F.transform(merged("aliases"), lambda a: F.substr(F.trim(a), F.lit(1), F.lit(80)))), 1, 24).alias("aliases"),
        merged("source_refs").alias("source_refs"), F.min_by("created_at", order).alias("created_at"), F.max("updated_at").alias("updated_at"),
    )


def default_records(points: DataFrame, mastery: DataFrame) -> DataFrame:
    """A record at the start for every point without one."""
    return points.select("point_id").distinct().join(mastery, "point_id", "left_anti").select("point_id", F.lit(START).alias("score"), F.lit("building").alias("level"), F.lit(0).alias("attempts"))


_STATE = """knowledge_points array<struct<id string, title string, aliases array<string>>>,
    mastery map<string, struct<score string, attempts string, correct_count string, wrong_count string, streak string>>,
    mistakes array<struct<id string, point_id string, question string, status string, created_at string>>"""


def normalize_mastery(states: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Points, records and mistakes of raw JSON states (course_id, state), with defaults for what is bad."""
    rows = states.select("course_id", F.from_json("state", _STATE).alias("s"))
    points = rows.select("course_id", F.explode("s.knowledge_points").alias("p"))
    title = F.coalesce(F.nullif(X.clip_text(F.col("p.title"), 120), F.lit("")), F.lit("未命名知识点"))
    points = points.select("course_id", F.coalesce(F.nullif(F.col("p.id"), F.lit("")), X.point_id(title)).alias("point_id"), title.alias("title"), F.slice(F.array_distinct(F.coalesce("p.aliases", X.empty_strings())), 1, 12).alias("aliases"))
    records = rows.select("course_id", F.explode("s.mastery").alias("point_id", "m"))
    counts = [X.coerce_int(F.col(f"m.{c}"), 0, 0).alias(c) for c in ("attempts", "correct_count", "wrong_count", "streak")]
    records = records.select("course_id", "point_id", X.coerce_score(F.col("m.score")).alias("score"), *counts)
    wrong = rows.select("course_id", F.explode("s.mistakes").alias("m"))
    ident = F.coalesce(F.nullif(F.col("m.id"), F.lit("")), X.mistake_id(F.col("m.point_id"), F.col("m.question"), X.text_or_empty(F.col("m.created_at"))))
    wrong = wrong.select("course_id", ident.alias("mistake_id"), "m.point_id", "m.question", X.coerce_choice(F.col("m.status"), ("open", "resolved"), "open").alias("status"))
    return points, records.withColumn("level", mastery_level(F.col("score"))), wrong

"""The fold of answers by functions of slices against the fold one by one."""

import random

import numpy as np
from pyspark.sql import functions as F

from lectern.operators import mastery

SCHEMA = "course_id string, point_id string, event_id long, s long, correct boolean, difficulty string, confidence double"


def one_by_one(rows, begin=None):
    state = {}
    for course, point, event, s, correct, difficulty, confidence in sorted(rows, key=lambda r: (r[0] or "", r[1] or "", r[3], r[2])):
        score, n, right, wrong, streak, _, _ = state.get((course, point)) or (*(begin or {}).get((course, point), (50, 0, 0, 0, 0)), None, None)
        score = min(max(score + mastery.fold_delta(bool(correct), difficulty, confidence, score, streak), 0), 100)
        state[course, point] = (score, n + 1, right + bool(correct), wrong + (not correct), streak + 1 if correct else 0, "correct" if correct else "wrong", s)
    return state


def events(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds("s")).drop("s")


def folded(df):
    rows = df.withColumn("s", F.unix_seconds("last_answered_at")).collect()
    return {(r.course_id, r.point_id): (r.score, r.attempts, r.correct_count, r.wrong_count, r.streak, r.last_result, r.s) for r in rows}


def answers(rnd, n, points, share=0.6):
    return [(f"c{p % 2}", f"p{p}", i, 1_700_000_000 + rnd.randrange(n // 2), rnd.random() < share, rnd.choice(["easy", "normal", "hard", None]), rnd.choice([None, rnd.random()])) for i in range(n) for p in [rnd.choice(points)]]


def test_a_slice_as_a_function_equals_its_answers():
    rnd = random.Random(3)
    for _ in range(40):
        rows = answers(rnd, rnd.randint(2, 60), [0], rnd.choice([0.2, 0.6, 1.0]))
        f = mastery.AnswerFunction()
        for r in rows:
            f.add(*r[4:])
        table = np.array(f.table())
        for state in rnd.sample(range(mastery.STATES), 60):
            score, streak = divmod(state, 4)
            for _, _, _, _, correct, difficulty, confidence in rows:
                score = min(max(score + mastery.fold_delta(correct, difficulty, confidence, score, streak), 0), 100)
                streak = streak + 1 if correct else 0
            assert table[state] == score * 4 + min(streak, 3)


def test_a_hot_point_is_spread_and_folds_to_the_same(spark):
    rnd = random.Random(4)
    rows = answers(rnd, 3000, [0] * 40 + [1, 2, 3, 4, 5], 0.8)
    table = events(spark, rows).repartition(3).cache()
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        assert folded(mastery.fold_answers(table)) == one_by_one(rows)
        begin = {("c0", "p0"): (17, 9, 4, 5, 2), ("c1", "p3"): (99, 3, 3, 0, 3), ("c9", "p9"): (1, 1, 0, 1, 0)}
        initial = spark.createDataFrame([(*k, *v) for k, v in begin.items()], "course_id string, point_id string, score int, attempts int, correct_count int, wrong_count int, streak int")
        assert folded(mastery.fold_answers(table, initial)) == one_by_one(rows, begin)
        order = ["course_id", "point_id", "ts", "event_id"]
        parts = table.repartitionByRange(*order).filter("point_id = 'p0'").groupBy(F.spark_partition_id()).count().collect()
        assert len(parts) > 12 and max(r["count"] for r in parts) < 600
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_all_right_slices_carry_the_streak_on(spark):
    rows = [("c", "p", i, 1_700_000_000 + i, True, "easy", None) for i in range(400)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        ((score, n, right, wrong, streak, last, _),) = folded(mastery.fold_answers(events(spark, rows))).values()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert (score, n, right, wrong, streak, last) == (100, 400, 400, 0, 400, "correct")

"""Approximate search and sketches, held against the exact results on all rows."""

import bisect
import datetime
import random

import numpy as np
from pyspark.sql import functions as F

from lectern.operators import evaluation, vector

SF = "/root/testdata/sf0.01"


def test_inverted_file_finds_nine_of_ten(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    index = rows.select(F.col("vec_id").cast("string").alias("doc_id"), F.lit("c").alias("course_id"), F.col("vec_id").alias("ord"), "vector").cache()
    queries = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.lit("c").alias("course_id"), "vector")
    centres = vector.fit_cells(index, cells=64)
    cells = vector.cell_index(index, centres).cache()
    assert cells.count() == index.count() and 16 < cells.select("cell").distinct().count() <= 64
    exact = {(r.query_id, r.doc_id): r.score for r in vector.vector_search(queries, index, 5).collect()}
    found = {(r.query_id, r.doc_id): r.score for r in vector.approximate_search(queries, cells, centres, 5).collect()}
    assert len(set(exact) & set(found)) >= 0.9 * len(exact)
    assert all(abs(found[k] - exact[k]) < 1e-9 for k in set(exact) & set(found))
    whole = vector.approximate_search(queries, cells, centres, 5, probes=64)
    assert {(r.query_id, r.doc_id, r["rank"]) for r in whole.collect()} == {(r.query_id, r.doc_id, r["rank"]) for r in vector.vector_search(queries, index, 5).collect()}


def test_inverted_file_on_odd_rows(spark):
    rows = [("a", None, 1, [1.0, 0.0]), ("b", "c", 2, [0.0, 0.0]), ("d", "c", 3, None), ("e", "c", 4, [0.0, 1.0]), ("f", "c", 4, [0.0, 1.0])]
    index = spark.createDataFrame(rows, "doc_id string, course_id string, ord long, vector array<double>")
    centres = vector.fit_cells(index.filter("vector is not null"), cells=4)
    cells = vector.cell_index(index.filter("vector is not null"), centres)
    queries = spark.createDataFrame([(1, "c", [0.0, 2.0]), (2, "x", [1.0, 0.0])], "query_id int, course_id string, vector array<double>")
    out = vector.approximate_search(queries, cells, centres, 2, probes=1).collect()
    assert [(r.query_id, r.doc_id) for r in sorted(out, key=lambda r: r["rank"])] in ([(1, "e"), (1, "f")], [(1, "f"), (1, "e")])
    none = vector.fit_cells(index.limit(0))
    assert none.shape[0] == 1


def observations(spark, n=40_000):
    rnd = random.Random(2)
    start = datetime.datetime(2026, 1, 1)
    rows = [("llm", "latency", start + datetime.timedelta(minutes=3 * i % 8000), rnd.lognormvariate(3, 1)) for i in range(n)]
    rows += [("index", "files", start, float(rnd.choice([1, 1, 1, 2, 7]))) for _ in range(500)] + [("llm", "latency", start, None), (None, "odd", start, float("nan")), (None, "odd", start, 2.5)]
    return rows, spark.createDataFrame(rows, "stage string, name string, ts timestamp, value double")


def test_sketches_of_days_merge_to_the_quantiles_of_all(spark):
    rows, table = observations(spark)
    days = evaluation.observation_sketches(table).cache()
    assert days.filter("name = 'latency'").count() > 5 and days.select(F.max(F.length("sketch"))).first()[0] < 8_000
    merged = evaluation.merge_sketches(days)
    again = evaluation.merge_sketches(merged.unionByName(merged.limit(0)))
    out = {r.name: r for r in evaluation.sketch_summary(again).collect()}
    values = sorted(r[3] for r in rows if r[1] == "latency" and r[3] is not None)
    got = out["latency"]
    assert (got.n, got.low, got.high, got.avg) == (len(values), values[0], values[-1], round(sum(values) / len(values), 3))
    for q, value in ((0.5, got.p50), (0.9, got.p90), (0.99, got.p99)):
        assert value in values and abs(bisect.bisect_left(values, value) / len(values) - q) < 0.02
    assert out["files"].p50 == 1.0 and out["odd"].n == 1


def test_maps_are_of_few_values_and_common_values_are_exact(spark, monkeypatch):
    rows, table = observations(spark, 3_000)
    out = {r.name: r for r in evaluation.observation_summary(table.filter("value is not null and not isnan(value)")).collect()}
    counts = {k: sum(r[3] == float(k) for r in rows if r[1] == "files") for k in ("1", "2", "7")}
    assert out["files"].distribution == counts and out["latency"].distribution is None and out["latency"]["count"] == 3_000
    found = {(r.name, r.value): r.n for r in evaluation.frequent_values(table.filter("value is not null and not isnan(value)"), 0.05).collect()}
    assert found == {**{("files", float(k)): n for k, n in counts.items() if n >= 25}, ("odd", 2.5): 1}
    assert np.isfinite(out["latency"].avg)

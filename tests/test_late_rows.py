"""Sliding and session windows over shuffled streams with late rows, which are kept aside."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import evaluation
from lectern.streaming import jobs

T0 = datetime.datetime(2026, 1, 1)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "user_id int, stage string, status string, ts timestamp"


@pytest.fixture(scope="module")
def split(spark, tmp_path_factory):
    """Files of shuffled rows, some of them late, run through the split twice."""
    rnd, root = random.Random(7), str(tmp_path_factory.mktemp("late"))
    rows = [(rnd.randrange(4), rnd.choice("ab"), rnd.choice(["ok", "error"]), T0 + datetime.timedelta(minutes=rnd.randrange(2, 14) * (k // 60 + 1))) for k in range(420)]
    rows += [(9, "a", "ok", None)]
    batches = [rows[k : k + 60] for k in range(0, len(rows), 60)] + [[(9, "a", "ok", T0 + datetime.timedelta(days=9))]]
    high, on_time, late = None, [], []
    for batch in batches:
        for r in batch:
            behind = r[3] is None or (high is not None and r[3] < high - datetime.timedelta(minutes=10))
            (late if behind else on_time).append(r)
        high = max([high] * (high is not None) + [r[3] for r in batch if r[3] is not None])
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/in")
        name = max((f for f in os.listdir(f"{root}/in") if f.endswith(".parquet")), key=lambda f: os.path.getmtime(f"{root}/in/{f}"))
        os.utime(f"{root}/in/{name}", (1_700_000_000 + k, 1_700_000_000 + k))
    for _ in range(2):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        query = jobs.split_late(stream, f"{root}/on_time", f"{root}/late", f"{root}/ck", "10 minutes")
        query.awaitTermination(180)
        assert query.exception() is None
    return root, on_time, late


def drained(frame, root, name, mode):
    frame.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{root}/ck_{name}").trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None
    return frame.sparkSession.table(name).collect()


def test_every_row_is_in_time_or_late(spark, split):
    root, on_time, late = split
    key = lambda rows: sorted(map(str, (tuple(r)[:4] for r in rows)))
    assert len(late) > 20 and key(spark.read.schema(SCHEMA).parquet(f"{root}/late").collect()) == key(late)
    assert key(spark.read.schema(SCHEMA).parquet(f"{root}/on_time").collect()) == key(on_time)


def test_sliding_windows_equal_the_batch(spark, split):
    root, on_time, _ = split
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(f"{root}/on_time").withWatermark("ts", "10 minutes")
    found = drained(jobs.stage_counters(stream, "20 minutes", "5 minutes"), root, "sliding", "append")
    batch = jobs.stage_counters(spark.createDataFrame(on_time, SCHEMA), "20 minutes", "5 minutes").filter(F.col("window_start") < F.lit(T0 + datetime.timedelta(days=8)))
    assert sorted(map(tuple, found)) == sorted(map(tuple, batch.collect())) and len(found) > 20


def test_sessions_equal_the_batch(spark, split):
    root, on_time, _ = split
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(f"{root}/on_time").withWatermark("ts", "10 minutes")
    found = drained(evaluation.chat_sessions(stream, "7 minutes"), root, "sessions", "append")
    batch = evaluation.chat_sessions(spark.createDataFrame(on_time, SCHEMA), "7 minutes").filter("user_id <> 9")
    assert sorted(map(tuple, found)) == sorted(map(tuple, batch.collect())) and len(found) > 5

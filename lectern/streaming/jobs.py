"""Streaming jobs, each with the result of its batch twin on the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lectern.functions import params as P
from lectern.operators import conversations, quality
from lectern.operators.mastery import fold_delta
from lectern.sources import store
from lectern.sources.scratch import materialise


def stage_counters(telemetry: DataFrame, size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """window_start, stage, n, errors; for a stream give telemetry a watermark on ts."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = telemetry.groupBy(window.alias("w"), "stage").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "error").alias("errors"))
    return out.select(F.col("w.start").alias("window_start"), "stage", "n", "errors")


def split_late(rows: DataFrame, on_time_path: str, late_path: str, checkpoint: str, delay: str = "10 minutes", time: str = "ts") -> StreamingQuery:
    """A stream of rows as two tables: those in time for windows, and the late ones, which window operators would drop
    unseen. A row is late if its time lies more than `delay` before the latest time of earlier batches, or is null.

    Windows with a watermark of the same delay over a stream of on_time_path drop nothing. Each batch is a folder
    batch=<number> of both tables; one that is run again writes the same rows in place of the old, and one that was
    finished is left alone, so the stream behind reads each row once.
    """
    spark = rows.sparkSession
    shape = rows.schema

    def step(batch: DataFrame, number: int) -> None:
        files, make = store.hadoop_files(spark, on_time_path)
        done = f"{on_time_path}/batch={number}"
        if files.exists(make(f"{done}/_SUCCESS")):
            return
        marks = f"{late_path}/_marks"
        names = [s.getPath().getName() for s in files.listStatus(make(marks))] if files.exists(make(marks)) else []
        earlier = [int(n.split("=")[1]) for n in names if n.startswith("mark=") and int(n.split("=")[1]) < number]
        high = batch.sparkSession.read.schema("high timestamp").parquet(f"{marks}/mark={max(earlier)}") if earlier else batch.sparkSession.sql("SELECT CAST(NULL AS TIMESTAMP) AS high")
        # the mark is one row
        judged = batch.crossJoin(F.broadcast(high.withColumn("high", F.col("high") - F.expr(f"INTERVAL {delay}"))))
        kept = materialise(judged.withColumn("is_late", F.col(time).isNull() | F.coalesce(F.col(time) < F.col("high"), F.lit(False))))
        kept.filter("is_late").select(*shape.names).write.mode("overwrite").parquet(f"{late_path}/batch={number}")
        reached = kept.agg(F.max(time).alias("high")).unionByName(high).agg(F.max("high").alias("high"))
        reached.write.mode("overwrite").parquet(f"{marks}/mark={number}")
        kept.filter("not is_late").select(*shape.names).write.mode("overwrite").parquet(done)

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_ingest(
    spark: SparkSession, folder: str, index_path: str, checkpoint: str, max_files: int = 1000, report_path: str | None = None, pdf: store.PdfReader | None = None
) -> StreamingQuery:
    """New files of a folder become chunks of the index, one course each first-level folder: text, DOCX, images and, with
    a reader, PDF, as read_pages brings them; files of other kinds are not opened. A batch that is run again finds its
    number in the index and changes nothing. With report_path, the quality of each batch's files is written under
    batch=<number> there; a repeated batch writes it anew."""
    kinds = store.extension_glob(P.EXTENSIONS)
    source = spark.readStream.format("binaryFile").schema(store.FILE_SCHEMA).option("recursiveFileLookup", True)
    files = source.option("pathGlobFilter", kinds).option("maxFilesPerTrigger", max_files).load(folder)

    def upsert(batch: DataFrame, number: int) -> None:
        pages = materialise(store.pages_of_files(batch, folder, pdf))
        if report_path is not None:
            quality.parser_quality(pages).write.mode("overwrite").parquet(f"{report_path}/batch={number}")
        store.upsert_chunks(batch.sparkSession, index_path, pages, writer=checkpoint, batch=number)

    return files.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class MasteryFold(StatefulProcessor):
    """Answers of one point: rows wait for the watermark, then are folded in the order of time and id. Rows behind the
    time up to which has been folded are counted as late and left out; a row at that very time is not late."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "score int, attempts int, correct_count int, wrong_count int, streak int, late int, done double")
        self.waiting = handle.getListState("waiting", "ts double, event_id long, correct boolean, difficulty string, confidence double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        state = list(self.state.get()) if self.state.exists() else [50, 0, 0, 0, 0, 0, -1.0]
        new = []
        for batch in rows:
            for r in batch.itertuples():
                ts = pd.Timestamp(r.ts).timestamp()
                if ts < state[6]:
                    state[5] += 1
                    continue
                new.append((ts, int(r.event_id), bool(r.correct), r.difficulty, float(r.confidence)))
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(int(max(h[0] for h in new) * 1000) + 1)
        self.state.update(tuple(state))
        yield pd.DataFrame(columns=_MASTERY_COLUMNS)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        state = list(self.state.get())
        until = expiredTimerInfo.getExpiryTimeInMs() / 1000
        held = list(self.waiting.get()) if self.waiting.exists() else []
        ready = sorted(h for h in held if h[0] < until)  # the watermark has reached until, so no more of these come
        for ts, _, correct, difficulty, confidence in ready:
            state[0] = min(max(state[0] + fold_delta(correct, difficulty, confidence, state[0], state[4]), 0), 100)
            state[1] += 1
            state[2 if correct else 3] += 1
            state[4] = state[4] + 1 if correct else 0
        state[6] = max(state[6], until)
        rest = [h for h in held if h[0] >= until]
        self.waiting.put(rest) if rest else self.waiting.clear()
        self.state.update(tuple(state))
        if ready:
            yield pd.DataFrame([(*key, *state[:6])], columns=_MASTERY_COLUMNS)

    def close(self) -> None:
        pass


_MASTERY_COLUMNS = ["course_id", "point_id", "score", "attempts", "correct_count", "wrong_count", "streak", "late"]


def stream_mastery(answers: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The state of a point each time that rows of it are folded; the batch twin is fold_answers. answers: a stream of
    course_id, point_id, event_id, ts, correct, difficulty, confidence."""
    kinds = dict(answers.dtypes)
    schema = f"course_id {kinds['course_id']}, point_id {kinds['point_id']}, " + ", ".join(f"{c} int" for c in _MASTERY_COLUMNS[2:])
    return answers.withWatermark("ts", delay).groupBy("course_id", "point_id").transformWithStateInPandas(MasteryFold(), schema, "Append", "EventTime")


class MemoryFold(StatefulProcessor):
    """The topics of one conversation, with what falls out of the limit forgotten at each question."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getListState("items", "topic string, count long, sample string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        items = [tuple(i) for i in self.items.get()] if self.items.exists() else []
        found = pd.concat(list(rows)).sort_values("ord")
        for question, topic in zip(found["question"], found["topic"], strict=True):
            items = conversations.fold_memory(items, question, topic)
        self.items.put(items)
        yield pd.DataFrame([(key[0], *i, k) for k, i in enumerate(items, 1)], columns=["conv_id", "topic", "count", "sample", "rank"])

    def close(self) -> None:
        pass


def stream_memory_topics(questions: DataFrame) -> DataFrame:
    """conv_id, topic, count, sample, rank after each batch. questions: a stream of conv_id, ord, question."""
    kind = dict(questions.dtypes)["conv_id"]
    rows = questions.withColumn("topic", conversations.memory_topic(F.col("question")))
    schema = f"conv_id {kind}, topic string, count long, sample string, rank int"
    return rows.groupBy("conv_id").transformWithStateInPandas(MemoryFold(), schema, "Update", "None")

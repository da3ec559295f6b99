"""The tables as the operators expect them, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows of fewer files than cores are dealt out, or one core would cut all texts of a small table."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows.inputFiles()) < cores else rows


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is a file of one page in the course of its source."""
    kinds = F.array(*map(F.lit, ("chapter", "lecture", "quiz", "note", "doc")))
    name = F.concat(F.element_at(kinds, (F.col("doc_id") % 5 + 1).cast("int")), F.lit("-"), F.col("doc_id"), F.lit(".md"))
    return spread(read(spark, sf_dir, "documents")).select(
        F.col("source").alias("course_id"),
        F.col("doc_id").cast("string").alias("file_id"),
        name.alias("file_name"),
        F.concat_ws("/", "source", name).alias("path"),
        F.col("doc_id").alias("file_ord"),
        F.lit(None).cast("int").alias("page"),
        F.lit(0).alias("page_seq"),
        "text",
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark text is a question to one of the 20 courses."""
    course = F.concat(F.lit("src"), F.col("item_id") % 20)
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), course.alias("course_id"), F.col("text").alias("question"))


def named_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that name a kind of file and a course."""
    kinds = F.array(*map(F.lit, ("chapter", "lecture", "quiz", "note", "doc")))
    named = F.concat_ws(" ", "question", F.element_at(kinds, (F.col("query_id") % 5 + 1).cast("int")), "course_id")
    return questions(spark, sf_dir).withColumn("question", named)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.lower("role").alias("role"), F.col("text").alias("content"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event answers a question about one of ten points of its user's course."""
    k = F.get_json_object("props", "$.k").cast("int")
    difficulty = F.when(F.col("value") < 20, "easy").when(F.col("value") < 60, "normal").otherwise("hard")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("course_id"),
        F.concat(F.lit("kp-"), k % 10).alias("point_id"),
        "event_id",
        "ts",
        (F.col("event_type") != "error").alias("correct"),
        difficulty.alias("difficulty"),
        (k / 100.0).alias("confidence"),
    )


PAGES_SQL = """pages_in AS (
    SELECT source AS course_id, CAST(doc_id AS VARCHAR) AS file_id,
           ['chapter', 'lecture', 'quiz', 'note', 'doc'][doc_id % 5 + 1] || '-' || doc_id || '.md' AS file_name,
           source || '/' || ['chapter', 'lecture', 'quiz', 'note', 'doc'][doc_id % 5 + 1] || '-' || doc_id || '.md' AS path,
           doc_id AS file_ord, text FROM documents)"""
WINDOWS_SQL = """clean AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS c FROM pages_in),
    windows AS (SELECT course_id, file_id, file_name, path, file_ord, w, substr(c, w * 440 + 1, 520) AS text
        FROM (SELECT *, unnest(range(CASE WHEN c = '' THEN 0 ELSE CAST(ceil(greatest(length(c) - 520, 0) / 440.0) AS INTEGER) + 1 END)) AS w FROM clean))"""
CHUNKS_SQL = f"""{PAGES_SQL}, {WINDOWS_SQL},
    chunks AS (SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY file_ord, w) AS chunk_index,
        CASE WHEN regexp_matches(lower(path || '/' || file_name), 'quiz|exercise') THEN 'practice'
             WHEN regexp_matches(lower(path || '/' || file_name), 'slides|ppt|lecture') THEN 'slides'
             WHEN regexp_matches(lower(path || '/' || file_name), 'book|chapter') THEN 'textbook'
             WHEN regexp_matches(lower(path || '/' || file_name), 'note') THEN 'notes' ELSE 'material' END AS material_type
        FROM windows)"""


def tokens_sql(text: str) -> str:
    return f"list_transform(regexp_extract_all({text}, '[A-Za-z0-9_]+'), lambda x: lower(x))"


ASKED_SQL = f"""asked AS (SELECT item_id AS query_id, 'src' || (item_id % 20) AS course_id, text AS question,
        list_filter({tokens_sql("text")}, lambda t: NOT regexp_full_match(t, '[0-9]{{1,3}}')) AS tokens FROM benchmark)"""
_NAMED = "(text || ' ' || ['chapter', 'lecture', 'quiz', 'note', 'doc'][item_id % 5 + 1] || ' src' || (item_id % 20))"
NAMED_SQL = ASKED_SQL.replace("text AS question", f"{_NAMED} AS question").replace("regexp_extract_all(text", f"regexp_extract_all({_NAMED}")
ANSWERS_SQL = """answers AS (SELECT user_id AS course_id, 'kp-' || (CAST(json_extract_string(props, '$.k') AS INTEGER) % 10) AS point_id,
        event_id, ts, event_type <> 'error' AS correct,
        CASE WHEN value < 20 THEN 'easy' WHEN value < 60 THEN 'normal' ELSE 'hard' END AS difficulty,
        CAST(json_extract_string(props, '$.k') AS INTEGER) / 100.0 AS confidence FROM events)"""

"""From raw documents to token ids: five stages, each over all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, decontamination, knn_quality, line_templates, neardup
from lectern.llm.common import materialise, quoted, table


#: The columns that stages work on; all others pass through them, whatever their names.
OWN = ("doc_id", "text", "lang", "source", "n_chars")


def _beside(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """stage's rows with exactly the columns of docs. Columns that it does not work on are one struct meanwhile, so no
    name that an operator uses can clash with theirs."""
    more = [c for c in docs.columns if c not in OWN]
    own = [quoted(c) for c in docs.columns if c in OWN]
    out = stage(docs.select(*own, F.struct(*map(quoted, more)).alias("carried")) if more else docs)
    return out.select(*(quoted(c) if c in OWN else F.col("carried").getField(c).alias(c) for c in docs.columns))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes for good (score 0.5 or more). Each row is judged by its own text, so of
    several rows of a doc_id those with bad texts go; null ids are scored like the others, and texts without words go."""
    labels = table(spark, sf_dir, "labels")
    return _beside(docs, lambda rows: knn_quality.with_scores(rows, labels).filter("score >= 0.5"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without recurring lines; n_chars follows the text."""
    length = F.coalesce(F.length("text").cast("long"), F.col("n_chars"))
    return _beside(docs, lambda rows: line_templates.drop_recurring_lines(rows).withColumn("n_chars", length))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the lowest id of each group of near copies, with all its rows, and all documents without shingles
    or id. A doc_id with several texts is one document: it stays or goes as a whole, and one of its group always stays."""
    found = neardup.near_duplicates(docs.select("doc_id", "text"))
    gone = materialise(found.filter("doc_id is not null and not kept").select("doc_id").distinct())
    gone = F.broadcast(gone) if gone.count() <= neardup.BROADCAST_IDS else gone
    return _beside(docs, lambda rows: rows.join(gone, "doc_id", "left_anti"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    benchmark = table(spark, sf_dir, "benchmark")
    return _beside(docs, lambda rows: decontamination.decontaminate(rows, benchmark))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_documents(docs, path, public_tokenizers.PATTERN, emit_ids=False)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_lines),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("byte-level BPE", encode),
]

#: No SQL: learned scores, MinHash and BPE are beyond it; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs)
    return docs

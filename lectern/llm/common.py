"""Shared helpers of the training-data operators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.scratch import materialise

#: ASCII white space, as the word rules of the operators define it.
WORD = "[^\\x20\\x09-\\x0D]+"
_ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ASCII_BREAKS = re.compile("[\x20\x09-\x0d]")
#: Bytes, as estimated from the rows, up to which a side is sent to all executors.
BROADCAST_BYTES = 32 << 20
BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: str) -> str:
    return text.translate(_ASCII_LOWER)


def held_out(doc_id: Column) -> Column:
    """True for the third of the documents whose labels no model may see."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def small_batches(df: DataFrame) -> DataFrame:
    """df, to be passed to Python. Ten thousand texts, Spark's default for a batch, can be many times a worker's memory;
    where the session has not chosen another number, batches have BATCH_ROWS rows from here on."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH) == "10000":
        conf.set(_BATCH, str(BATCH_ROWS))
    return df


def sized(df: DataFrame, row_bytes: Column | int) -> DataFrame:
    """df written out, and to be broadcast if its rows are measured to be small enough; else joins shuffle it.
    row_bytes: the bytes of a row, or a column that tells them."""
    df = materialise(df)
    width = F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes
    total = df.agg(F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores behind it until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")

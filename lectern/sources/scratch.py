"""Intermediate tables in the folder that the session names in spark.checkpoint.dir."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. A local master is one machine, so a temporary
    folder is set where none is named; a cluster must name one, since executors see no folder of the driver's."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", named := tempfile.mkdtemp(prefix="spark-lectern-"))
    return named


def own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lectern-{spark.sparkContext.applicationId}"


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows as Parquet to the shared folder and read them again."""
    path = f"{own_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete what materialise has written for this application. DataFrames that the operators returned still read it:
    write them first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)

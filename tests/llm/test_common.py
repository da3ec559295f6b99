import pytest

from lectern.llm import common
from lectern.sources import scratch


def test_tables_are_released_and_clusters_must_name_a_folder(spark):
    rows = common.materialise(spark.range(5))
    assert rows.count() == 5 and common.sized(rows, 8).count() == 5
    folder = scratch.own_folder(spark)
    scratch.release(spark)
    with pytest.raises(Exception):
        spark.read.parquet(folder)


def test_names_with_any_characters(spark):
    table = spark.range(1).selectExpr("id as `a``b`", "id as r")
    assert common.free_name(table, "R") == "R_" and table.select(common.quoted("a`b")).columns == ["a`b"]

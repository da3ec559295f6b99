"""Kinds of files against the SQL twin, on odd texts and ids."""

import pytest

from lectern.plans import registry


def test_kinds_are_counted_over_the_files_with_a_text_as_in_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    texts = ["a text", "", None, " \n\t ", "\u3000 \xa0", "\x0b", "x", "x", " ", "# a heading", "\u200b"]
    rows = [(i, t, "src1") for i, t in enumerate(texts)]
    rows += [(6, "again", "src1"), (6, "elsewhere", "quiz"), (None, "no id", "book"), (15, "no course", None), (20, " ", "book")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in registry.QUERIES["material_type"](spark, str(tmp_path)).collect()}
    with duckdb.connect() as sql:
        sql.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        assert got == set(sql.sql(registry.ORACLES["material_type"]).fetchall())

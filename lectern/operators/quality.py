"""Extraction quality of files, and reports about built indexes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import params as P
from lectern.functions import text as X


def _usable(text: Column) -> Column:
    out = text
    for pattern in P.IMAGE_PATTERNS + P.OCR_PATTERNS:
        out = F.regexp_replace(out, f"(?i){re.escape(pattern)}", "")
    return F.length(X.strip(out))


def page_flags(pages: DataFrame, short: int = 30) -> DataFrame:
    """pages with one flag for each kind of fault; an empty page has only that one."""
    stripped = X.strip(F.col("text"))
    low, usable, filled = F.lower(stripped), _usable(stripped), stripped != ""
    image = X.contains_any(low, P.IMAGE_PATTERNS)
    return pages.withColumns(
        {
            "empty_page": ~filled,
            "usable": F.when(filled, usable).otherwise(0),
            "error_page": filled & X.contains_any(low, P.ERROR_PATTERNS),
            "image_page": filled & image,
            "ocr_page": filled & X.contains_any(low, P.OCR_PATTERNS),
            "short_page": filled & (usable > 0) & (usable < short) & ~image,
        }
    )


def parser_quality(pages: DataFrame, expected: DataFrame | None = None, short: int = 30) -> DataFrame:
    """One row for each file: counts, coverage, score, status, warnings. pages: file_id, page, page_seq, text;
    expected: file_id, expected_pages. A file of `expected` without pages has failed."""
    flags = ["empty_page", "short_page", "error_page", "image_page", "ocr_page"]
    flagged = page_flags(pages, short)
    codes = {"empty_page": "empty_text", "error_page": "error_message", "image_page": "image_placeholder", "ocr_page": "ocr_placeholder", "short_page": "short_page"}
    warned = F.filter(
        F.array(*[F.when(F.col(f), F.struct(F.col("page_seq"), F.lit(i).alias("rank"), F.lit(c).alias("code"), F.col("page"))) for i, (f, c) in enumerate(codes.items())]),
        lambda w: w.isNotNull(),
    )
    out = flagged.groupBy("file_id").agg(
        F.count("*").alias("page_count"),
        *[F.count_if(f).alias(f"{f}s") for f in flags],
        F.sum("usable").alias("text_characters"),
        F.countDistinct(F.when(~F.col("empty_page"), F.col("page"))).alias("numbers"),
        F.max(F.when(F.col("page") > 0, F.col("page"))).alias("last_page"),
        F.flatten(F.array_sort(F.collect_list(warned))).alias("page_warnings"),
    )
    if expected is not None:
        out = expected.select("file_id", "expected_pages").join(out, "file_id", "full_outer")
    else:
        out = out.withColumn("expected_pages", F.lit(None).cast("int"))
    out = out.fillna(0, ["page_count", *[f"{f}s" for f in flags], "text_characters", "numbers"])
    filled = F.col("page_count") - F.col("empty_pages")
    covered = F.when(F.col("numbers") > 0, F.col("numbers")).otherwise(filled)
    total = F.coalesce(F.greatest("expected_pages", F.lit(0)), "last_page", "page_count")
    n = F.greatest(F.col("page_count"), F.lit(1))
    coverage = F.when(F.col("page_count") == 0, 0.0).when(total > 0, F.least(F.lit(1.0), covered / total)).otherwise(filled / n)
    out = out.withColumn("coverage", coverage)
    loss = sum(
        (F.col(f"{f}s") / n * weight for f, weight in zip(flags, (0.3, 0.15, 0.45, 0.25, 0.2), strict=True)),
        F.when(F.col("coverage") < 0.8, (0.8 - F.col("coverage")) * 0.5).otherwise(0.0),
    )
    score = F.when(F.col("page_count") == 0, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - loss)), 3))
    more = F.when(F.col("page_count") == 0, F.array(F.lit("empty_text"))).when(F.col("coverage") < 0.8, F.array(F.lit("low_page_coverage")))
    warnings = F.concat(
        F.coalesce(F.transform("page_warnings", lambda w: F.struct(w.code.alias("code"), w.page.alias("page"))), F.array().cast("array<struct<code:string,page:int>>")),
        F.transform(F.coalesce(more, X.empty_strings()), lambda c: F.struct(c.alias("code"), F.lit(None).cast("int").alias("page"))),
    )
    out = out.withColumns({"score": score, "warnings": warnings})
    status = F.when((F.col("score") <= 0.2) | (F.col("text_characters") == 0), "failed")
    status = status.when((F.size("warnings") > 0) | (F.col("score") < 0.85), "warning").otherwise("ok")
    return out.withColumn("status", status).drop("numbers", "last_page", "page_warnings")


def index_build_report(chunks: DataFrame, quality: DataFrame) -> DataFrame:
    """course_id, files, chunks, ok, warning, failed. chunks: course_id, file_id, file_name; quality: course_id,
    status."""
    key = F.coalesce(F.when(F.col("file_id") != "", F.col("file_id")), "file_name")
    built = chunks.groupBy("course_id").agg(F.countDistinct(key).alias("files"), F.count("*").alias("chunks"))
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("ok", "warning", "failed")]
    judged = quality.groupBy("course_id").agg(*counts)
    return built.join(judged, "course_id", "full_outer").fillna(0)

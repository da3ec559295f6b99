"""Summaries and quizzes from representative chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import text as X
from lectern.operators.lexical import sized
from lectern.sources.scratch import materialise


def representative_chunks(chunks: DataFrame, limit: int = 6) -> DataFrame:
    """The chunks of each course that say most and differ: the first of a file or keyword in the order of distinct
    tokens and length, then the others in that order. chunks: course_id, chunk_index, file_id, tokens, text."""
    variety = F.size(F.array_distinct(F.filter("tokens", lambda t: F.length(t) > 1))).alias("variety")
    # the tokens of a chunk without a title are those of its text
    known = F.when(X.text_or_empty(F.col("section_title")) == "", F.col("tokens")) if "section_title" in chunks.columns else None
    # a few numbers of each chunk; the texts of the few that are chosen are fetched at the end
    rows = materialise(chunks.select("course_id", "chunk_index", "file_id", variety, F.length("text").alias("n_chars"), X.pick_keyword(F.col("text"), known).alias("keyword")))
    best = F.struct((-F.col("variety")).alias("less"), (-F.col("n_chars")).alias("shorter"), "chunk_index", "variety", "keyword").alias("c")
    top = lambda df, n, *by: df.withColumn("position", F.row_number().over(Window.partitionBy("course_id").orderBy(*by, "c"))).filter(F.col("position") <= n)
    # firsts are found by aggregations, which combine a hot file or keyword before they shuffle
    firsts = [rows.groupBy("course_id", by).agg(F.min(best).alias("c")).select("course_id", "c") for by in ("file_id", "keyword")]
    fresh = materialise(top(firsts[0].union(firsts[1]).distinct(), limit).select("course_id", "c"))
    # where fresh ones are too few, the best 2 * limit of all hold enough others
    others = top(rows.select("course_id", best), 2 * limit).select("course_id", "c").join(sized(fresh), ["course_id", "c"], "left_anti")
    chosen = top(fresh.withColumn("stale", F.lit(0)).union(others.withColumn("stale", F.lit(1))), limit, "stale")
    return chunks.join(sized(chosen.select("course_id", "c.chunk_index", "c.variety", "c.keyword", "position")), ["course_id", "chunk_index"])


def summary_evidence(chunks: DataFrame, max_chars: int = 900) -> DataFrame:
    """course_id, position, label, file_id, file_name, section_title, chunk_index, text; chunks: with position. Labels
    count blanks, which then go."""
    text = X.strip(F.col("text"))
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    rows = chunks.filter(text != "").select(
        "course_id", "position", F.concat(F.lit("S"), F.col("position")).alias("label"), F.coalesce(filled("file_id"), filled("file_name"), F.lit("unknown")).alias("file_id"),
        F.coalesce(filled("file_name"), F.lit("未知文件")).alias("file_name"), X.text_or_empty(F.col("section_title")).alias("section_title"),
        F.coalesce(F.col("chunk_index").cast("long"), F.col("position").cast("long")).alias("chunk_index"), X.compact_text(text, max_chars).alias("text"),
    )
    return rows


def group_evidence(evidence: DataFrame, max_groups: int = 12, per_group: int = 5) -> DataFrame:
    """course_id, group_id, file_id, section_title, labels, texts: by file and section, in order of appearance."""
    items = F.slice(F.array_sort(F.collect_list(F.struct("position", "label", "text"))), 1, per_group)
    rows = evidence.groupBy("course_id", "file_id", "section_title").agg(F.min("position").alias("first"), items.alias("items"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("course_id").orderBy("first"))).filter(F.col("n") <= max_groups)
    return rows.select("course_id", F.concat(F.lit("G"), F.col("n")).alias("group_id"), "file_id", "section_title", F.transform("items", lambda i: i.label).alias("labels"), F.transform("items", lambda i: i.text).alias("texts"))


def _asking(generate: Callable[[str], str]) -> Callable[[F.Column], F.Column]:
    """generate as a column function; a broken model's answer is empty."""

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            out = []
            for prompt in prompts:
                try:
                    out.append(generate(prompt) or "")
                except Exception:  # noqa: BLE001  a broken model is a failed group, not a failed job
                    out.append("")
            yield pd.Series(out)

    return ask


def map_reduce_summary(groups: DataFrame, courses: DataFrame, generate: Callable[[str], str] | None) -> DataFrame:
    """course_id, status, reason, content. generate: prompt to text, called once for each group and course, in
    parallel. Statuses: used, disabled (no generator), empty (no group), failed (an empty or broken answer)."""
    if generate is None:
        return courses.select("course_id", F.lit("disabled").alias("status"), F.lit("no generator").alias("reason"), F.lit("").alias("content"))

    ask = _asking(generate)
    evidence = F.array_join(F.zip_with("labels", "texts", lambda a, b: F.concat(F.lit("["), a, F.lit("] "), b)), "\n")
    mapped = groups.repartition("course_id", "group_id").select("course_id", "group_id", ask(F.concat(F.lit("分组 "), F.col("group_id"), F.lit("：\n"), evidence)).alias("part"))
    number = F.substr("group_id", F.lit(2), F.lit(9)).cast("int")
    parts = mapped.groupBy("course_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(number.alias("n"), "part"))), lambda x: x.part).alias("parts"), F.bool_or(X.strip(F.col("part")) == "").alias("broken")
    )
    good = parts.filter("not broken").select("course_id", ask(F.concat(F.lit("汇总：\n"), F.array_join("parts", "\n"))).alias("content"))
    rows = courses.select("course_id").join(parts.select("course_id", "broken"), "course_id", "left").join(good, "course_id", "left")
    empty, failed = F.col("broken").isNull(), F.col("broken") | (X.strip(F.col("content")) == "")
    return rows.select(
        "course_id", F.when(empty, "empty").when(failed, "failed").otherwise("used").alias("status"),
        F.when(empty, "no evidence").when(failed, "empty answer").otherwise("").alias("reason"), F.when(~empty & ~failed, F.col("content")).otherwise("").alias("content"),
    )


def course_summary(chunks: DataFrame, courses: DataFrame, generate: Callable[[str], str] | None, limit: int = 8) -> DataFrame:
    """course_id, content, llm_status, summary_method, fallback_reason: of each course the first that works of a summary
    by groups, one from a single prompt over the representative chunks, and extracts of these. chunks: an index of
    chunks; courses: course_id, name. A course without chunks is `skipped`; one without a model's answer is `fallback`,
    or `disabled` if there is no model."""
    chosen = materialise(representative_chunks(chunks, limit))
    groups = materialise(group_evidence(summary_evidence(chosen)))
    reduced = materialise(map_reduce_summary(groups, courses, generate))
    rest = materialise(reduced.filter("status <> 'used'").select("course_id", F.when(F.col("status") == "empty", "no_summary_chunks").when(F.col("status") == "disabled", "llm_disabled").otherwise("map_reduce_failed").alias("fallback_reason")))
    evidence = summary_evidence(chosen).join(rest, "course_id", "left_semi")
    lines = F.concat(F.lit("["), F.col("label"), F.lit("] "), F.col("text"))
    prompts = evidence.groupBy("course_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", lines.alias("line")))), lambda x: x.line), "\n").alias("evidence"))
    prompts = prompts.join(courses.select("course_id", X.text_or_empty(F.col("name")).alias("name")), "course_id")
    prompt = F.concat(F.lit("课程《"), F.col("name"), F.lit("》复习摘要：\n"), F.col("evidence"))
    said = F.lit("") if generate is None else _asking(generate)(prompt)
    single = materialise(prompts.repartition("course_id").select("course_id", said.alias("single")))
    extracts = extractive_summary(chosen.join(rest, "course_id", "left_semi")).withColumnRenamed("content", "extract")
    out = courses.select("course_id").join(reduced.select("course_id", "status", "content"), "course_id").join(rest, "course_id", "left")
    out = out.join(single, "course_id", "left").join(extracts, "course_id", "left")
    used, prompted, bare = F.col("status") == "used", X.strip(F.col("single")) != "", F.col("extract").isNull()
    return out.select(
        "course_id",
        F.when(used, F.col("content")).when(prompted, F.col("single")).otherwise(X.text_or_empty(F.col("extract"))).alias("content"),
        F.when(used | prompted, "used").when(bare, "skipped").when(F.lit(generate is None), "disabled").otherwise("fallback").alias("llm_status"),
        F.when(used, "map_reduce").when(prompted, "single_prompt").otherwise("extractive").alias("summary_method"),
        X.text_or_empty(F.col("fallback_reason")).alias("fallback_reason"),
    )


def _listed(chunks: DataFrame, line: F.Column) -> F.Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))), lambda x: x.line)


def extractive_summary(chunks: DataFrame) -> DataFrame:
    """course_id, content from representative chunks (position, file_name, text)."""
    line = F.concat(F.lit("- "), X.pick_keyword(F.col("text")), F.lit("："), X.compact_sentence(F.col("text")), F.lit("（来源：《"), F.col("file_name"), F.lit("》）"))
    head = F.array(*map(F.lit, ("课程复习摘要", "", "## 核心知识点")))
    tail = F.array(*map(F.lit, ("", "## 复习建议", "- 先按上面的核心知识点复述定义，再回到来源文件核对例子、条件和易错边界。")))
    return chunks.groupBy("course_id").agg(_listed(chunks, line).alias("lines")).select("course_id", F.array_join(F.concat(head, "lines", tail), "\n").alias("content"))


def extractive_quiz(chunks: DataFrame) -> DataFrame:
    """course_id, content: one basic and one applied question for each representative chunk."""
    keyword = X.pick_keyword(F.col("text"))
    line = F.concat(
        F.col("position").cast("string"), F.lit(". 基础题：说明“"), keyword, F.lit("”的含义或作用，并指出它解决了什么问题。\n   应用题：结合《"), F.col("file_name"),
        F.lit("》中的材料，举一个使用“"), keyword, F.lit("”的场景。\n   参考要点："), X.compact_sentence(F.col("text")),
    )
    return chunks.groupBy("course_id").agg(_listed(chunks, line).alias("lines")).select("course_id", F.array_join(F.concat(F.array(F.lit("课程自测题")), "lines"), "\n\n").alias("content"))

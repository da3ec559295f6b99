"""Answers from hits, their citations, and the check of claims against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import params as P
from lectern.functions import text as X

NO_BASIS = "未找到课程资料依据。"
_LABEL = r"\[([A-Za-z]?\d+)\]"


def grounded_answers(queries: DataFrame, hits: DataFrame, limit: int = 4) -> DataFrame:
    """query_id, mode, answer, citations of each question. hits: query_id, rank, file_id, file_name, section_title,
    material_type, page, chunk_index, score, text, context_text. Without a hit the mode is no_basis."""
    fields = ("rank", "file_id", "file_name", "section_title", "material_type", "page", "chunk_index", "score", "text")
    quote = F.substr(F.coalesce("context_text", "text"), F.lit(1), F.lit(600)).alias("quote")
    top = hits.filter(F.col("rank") <= limit).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*fields, quote))).alias("hits"))
    rows = queries.select("query_id", "question").join(top, "query_id", "left")
    first = F.get("hits", F.lit(0))
    text = F.when(F.length(first["text"]) > 260, F.concat(F.substr(first["text"], F.lit(1), F.lit(260)), F.lit("..."))).otherwise(first["text"])
    head = F.concat(F.lit("问题“"), F.col("question"), F.lit("”与资料《"), first["file_name"], F.lit("》中的内容最相关。"), text)
    lines = F.transform("hits", lambda h, i: F.concat((i + 1).cast("string"), F.lit(". "), h.quote))
    answer = F.when(F.col("hits").isNull(), NO_BASIS).otherwise(F.concat_ws("\n", head, F.array_join(lines, "\n")))
    return rows.select("query_id", F.when(F.col("hits").isNull(), "no_basis").otherwise("template").alias("mode"), answer.alias("answer"), F.col("hits").alias("citations"))


def label_citations(citations: DataFrame) -> DataFrame:
    """answer_id, label, quote. citations: answer_id, ord, source_type, label, quote. An explicit label counts alone;
    others are numbered by type and among themselves; of equal labels the last counts."""
    explicit = F.upper(F.regexp_replace(X.strip(F.col("label")), r"^[\[\]]+|[\[\]]+$", ""))
    kind = F.when(F.col("source_type") == "web", "W").when(F.col("source_type") == "summary", "S").otherwise("L")
    rows = citations.withColumns({"explicit": explicit, "kind": kind}).withColumn("free", F.col("explicit") == "")
    number = lambda *by: F.row_number().over(Window.partitionBy("answer_id", "free", *by).orderBy("ord")).cast("string")
    rows = rows.withColumns({"by_kind": F.concat("kind", number("kind")), "plain": number()})
    labels = F.when(F.col("free"), F.array("by_kind", "plain")).otherwise(F.array("explicit"))
    out = rows.select("answer_id", "ord", X.text_or_empty(F.col("quote")).alias("quote"), F.posexplode(labels).alias("at", "label"))
    return out.groupBy("answer_id", "label").agg(F.max_by("quote", F.struct("ord", "at")).alias("quote"))


def label_order(label: Column) -> Column:
    """Sort key: letters, then the number."""
    return F.struct(F.regexp_extract(label, "^([A-Z]*)", 1), F.coalesce(F.regexp_extract(label, "(\\d+)$", 1).try_cast("int"), F.lit(0)))


def assertive(claim: Column, n_tokens: Column, min_tokens: int) -> Column:
    text = X.strip(claim)
    hedged = F.lit(False)
    for marker in P.HEDGES:
        hedged = hedged | text.startswith(marker)
    return (n_tokens >= min_tokens) & (text != "") & ~text.rlike("[?？]$") & ~X.contains_any(text, P.SUPPLEMENTS) & ~hedged


def check_claims(answers: DataFrame, labels: DataFrame, min_overlap: float = 0.18, min_tokens: int = 4) -> DataFrame:
    """answer_id, claim_ord, sentence, labels, assertive, token_count, max_overlap, overlaps, supported, reason.
    answers: answer_id, answer; labels: answer_id, label, quote."""
    rows = answers.select("answer_id", F.posexplode(X.split_sentences(F.col("answer"))).alias("claim_ord", "sentence"))
    claim = X.strip(F.regexp_replace("sentence", _LABEL, ""))
    rows = rows.withColumns({"labels": F.transform(F.regexp_extract_all("sentence", F.lit(_LABEL), F.lit(1)), F.upper), "claim": claim})
    rows = rows.withColumn("own", F.array_distinct(X.tokenize_citation(F.col("claim"))))
    quotes = labels.select("answer_id", "label", F.array_distinct(X.tokenize_citation(F.col("quote"))).alias("quote_tokens"))
    each = rows.select("*", F.explode_outer("labels").alias("label")).join(quotes, ["answer_id", "label"], "left")
    overlap = F.coalesce(F.size(F.array_intersect("own", "quote_tokens")) / F.nullif(F.size("own"), F.lit(0)), F.lit(0.0))
    each = each.withColumn("overlap", F.when(F.col("quote_tokens").isNull(), 0.0).otherwise(overlap))
    out = each.groupBy("answer_id", "claim_ord").agg(
        F.first("sentence").alias("sentence"), F.first("labels").alias("labels"), F.first("claim").alias("claim"), F.first("own").alias("own"),
        F.coalesce(F.max(F.when(F.col("label").isNotNull(), F.col("overlap"))), F.lit(0.0)).alias("max_overlap"),
        F.coalesce(F.bool_or(F.col("label").isNotNull() & F.col("quote_tokens").isNull()), F.lit(False)).alias("unknown"),
        F.array_distinct(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("label", "overlap")))).alias("pairs"),
    )
    n = F.size("own")
    out = out.withColumns({"token_count": n, "assertive": assertive(F.col("claim"), n, min_tokens), "overlaps": F.map_from_entries("pairs")})
    reason = F.when(~F.col("assertive"), "non_assertive").when(F.size("labels") == 0, "missing_citation").when(F.col("unknown"), "unknown_citation")
    reason = reason.when(F.col("max_overlap") < min_overlap, "low_overlap").otherwise("ok")
    out = out.withColumn("reason", reason).withColumn("supported", F.col("reason").isin("ok", "non_assertive"))
    return out.drop("claim", "own", "unknown", "pairs")


def citation_report(claims: DataFrame) -> DataFrame:
    """answer_id, supported, claim_count, assertive_claim_count, unsupported_count, uncited_count."""
    bad = F.col("assertive") & ~F.col("supported")
    return claims.groupBy("answer_id").agg(
        (F.count_if(bad) == 0).alias("supported"), F.count("*").alias("claim_count"), F.count_if("assertive").alias("assertive_claim_count"),
        F.count_if(bad).alias("unsupported_count"), F.count_if(bad & (F.col("reason") == "missing_citation")).alias("uncited_count"),
    )


def annotate_unsupported(answers: DataFrame, claims: DataFrame, marker: str = "（未核实）") -> DataFrame:
    """answer_id, answer with the marker behind the first occurrence of each unsupported sentence."""
    bad = claims.filter(F.col("assertive") & ~F.col("supported")).groupBy("answer_id")
    bad = bad.agg(F.transform(F.array_sort(F.collect_list(F.struct("claim_ord", "sentence"))), lambda x: x.sentence).alias("bad"))

    def mark(text: Column, sentence: Column) -> Column:
        at = F.locate("", text) * 0 + F.call_function("instr", text, sentence)
        end = at + F.length(sentence) - 1
        return F.when(at > 0, F.concat(F.substr(text, F.lit(1), end), F.lit(marker), F.substr(text, end + 1, F.length(text)))).otherwise(text)

    rows = answers.join(bad, "answer_id", "left")
    return rows.select("answer_id", F.aggregate(F.coalesce("bad", X.empty_strings()), F.col("answer"), mark).alias("answer"))


def build_prompts(queries: DataFrame, evidence: DataFrame, history: DataFrame, memory: DataFrame | None = None, template: str | None = None) -> DataFrame:
    """query_id, prompt. evidence: query_id, ord, source_type, label, quote; history: query_id, turn, role, content (the
    last six count, cut at 320 characters); memory: query_id, topic. template has {policy} {memory} {history}
    {evidence} {question}."""
    template = template or "{policy}\n\n关注主题：{memory}\n\n最近对话：\n{history}\n\n资料：\n{evidence}\n\n问题：{question}"
    block = F.concat(F.lit("["), F.col("label"), F.lit("] "), F.col("quote"))
    cited = evidence.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", block.alias("b")))), lambda x: x.b), "\n").alias("evidence"),
        F.bool_or(F.col("source_type") == "web").alias("web"), F.bool_or(F.col("source_type") != "web").alias("local"),
    )
    last = history.withColumn("back", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("turn")))).filter("back <= 6")
    line = F.concat(F.col("role"), F.lit(": "), F.substr(X.collapse(F.col("content")), F.lit(1), F.lit(320)))
    said = last.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x.l), "\n").alias("history"))
    rows = queries.select("query_id", "question").join(cited, "query_id", "left").join(said, "query_id", "left")
    if memory is not None:
        rows = rows.join(memory.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("topic")), "；").alias("memory")), "query_id", "left")
    policy = F.when(F.col("web") & F.col("local"), "优先课程资料，网络资料只作补充。").when(F.col("web"), "只有网络资料，请注明来源。")
    policy = policy.when(F.col("local"), "只依据课程资料回答并标注编号。").otherwise("没有资料，请说明依据不足。")
    parts = {"policy": policy, "memory": F.col("memory") if memory is not None else F.lit(""), "history": F.col("history"), "evidence": F.col("evidence"), "question": F.col("question")}
    prompt = F.lit(template)
    for name, value in parts.items():
        prompt = F.replace(prompt, F.lit("{" + name + "}"), X.text_or_empty(value))
    return rows.select("query_id", prompt.alias("prompt"))

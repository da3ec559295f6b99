"""Evaluation of answers, checks of payloads, telemetry and web sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import params as P
from lectern.functions import text as X

_QUALITY = ("none", "partial", "sufficient")


def _base(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def eval_cases(cases: DataFrame, answers: DataFrame, citations: DataFrame, claims: DataFrame) -> DataFrame:
    """One row for each case. cases: case_id, expected_files, min_quality, expected_terms, forbidden_terms,
    min_answer_term_rate, max_unsupported_claims; answers: case_id, answer, quality, top_score; citations: case_id, ord,
    file_name; claims: case_id, unsupported_count. Expected terms ignore case, forbidden ones do not."""
    files = citations.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "file_name"))), lambda x: x.file_name).alias("cited"))
    rows = cases.join(answers, "case_id", "left").join(files, "case_id", "left").join(claims.select("case_id", "unsupported_count"), "case_id", "left")
    none = X.empty_strings()
    expected, cited = F.coalesce("expected_files", none), F.coalesce("cited", none)
    match = lambda f: F.exists(expected, lambda e: (f == e) | (_base(f) == _base(e)))
    hit = F.when(F.size(expected) == 0, F.size(cited) > 0).otherwise(F.exists(cited, match))
    first = F.when(F.size(cited) == 0, False).when(F.size(expected) == 0, True).otherwise(match(F.get(cited, F.lit(0))))
    place = lambda c: F.array_position(F.array(*map(F.lit, _QUALITY)), F.coalesce(c, F.lit("none")))
    answer = X.text_or_empty(F.col("answer"))
    terms = F.coalesce("expected_terms", none)
    rate = F.when(F.size(terms) == 0, 1.0).otherwise(F.size(F.filter(terms, lambda t: F.lower(answer).contains(F.lower(t)))) / F.size(terms))
    forbidden = F.filter(F.coalesce("forbidden_terms", none), lambda t: answer.contains(t))
    budget = F.col("max_unsupported_claims").isNull() | (F.coalesce("unsupported_count", F.lit(0)) <= F.col("max_unsupported_claims"))
    checks = {
        "citation_hit": hit, "first_citation_hit": first, "quality_pass": place(F.col("quality")) >= place(F.col("min_quality")), "term_rate": rate,
        "terms_pass": rate >= F.coalesce("min_answer_term_rate", F.lit(1.0)), "forbidden_found": forbidden, "forbidden_pass": F.size(forbidden) == 0, "unsupported_pass": budget,
    }
    out = rows.select("case_id", F.coalesce("quality", F.lit("none")).alias("quality"), "top_score", *[c.alias(n) for n, c in checks.items()])
    return out.withColumn("passed", F.col("citation_hit") & F.col("quality_pass") & F.col("terms_pass") & F.col("forbidden_pass") & F.col("unsupported_pass"))


def eval_summary(results: DataFrame) -> DataFrame:
    """One row: cases, passed, rates at four digits, counts by quality (zeros too), mean top score."""
    rate = lambda c: F.coalesce(F.round(F.avg(F.col(c).cast("double")), 4), F.lit(0.0))
    return results.agg(
        F.count("*").alias("cases"), F.count_if("passed").alias("passed"), rate("citation_hit").alias("citation_hit_rate"),
        rate("first_citation_hit").alias("first_citation_hit_rate"), rate("term_rate").alias("term_rate"),
        *[F.count_if(F.col("quality") == q).alias(q) for q in _QUALITY], F.round(F.avg("top_score"), 4).alias("mean_top_score"),
    )


def payload_checks(payloads: DataFrame, rules: Mapping[str, Column | tuple[Column, Column]]) -> DataFrame:
    """id, check, passed for every payload (id, payload as JSON text) and rule. A rule is a condition, or a pair of when
    it applies and the condition; a condition that is null has failed."""
    each = []
    for name, rule in rules.items():
        applies, passed = rule if isinstance(rule, tuple) else (F.lit(True), rule)
        each.append(F.when(F.coalesce(applies, F.lit(False)), F.struct(F.lit(name).alias("check"), F.coalesce(passed, F.lit(False)).alias("passed"))))
    return payloads.select("id", F.explode(F.array_compact(F.array(*each))).alias("c")).select("id", "c.check", "c.passed")


# Fixed values of payload checks.
LLM_STATUSES = ("used", "fallback", "disabled", "skipped", "failed", "empty", "client_error", "summary_error")
WEB_STATUSES = ("used", "empty", "failed", "disabled", "skipped", "clarification")
SUMMARY_METHODS = ("map_reduce", "single_prompt", "extractive")
TRACE_LABELS = ("感知", "读取", "上下文", "检索", "联网", "回答", "记忆")
TELEMETRY_STAGES = ("retrieval", "web", "llm", "citation_check")
ANSWER_FIELDS = ("answer", "citations", "trace", "retrieval_trace", "citation_check", "llm_status", "web_search_status", "telemetry")
SUMMARY_FIELDS = ("content", "citations", "llm_status", "summary_method")


def _field(path: str, of: str | Column = "payload") -> Column:
    return F.get_json_object(of, path)


def _items(path: str, of: str | Column = "payload") -> Column:
    """The items of a JSON list as JSON texts; none where there is no list."""
    value = _field(path, of)
    return F.when(X.text_or_empty(value).startswith("["), F.coalesce(F.from_json(value, "array<string>"), X.empty_strings())).otherwise(X.empty_strings())


def _objects(path: str, of: str | Column = "payload") -> Column:
    return F.filter(_items(path, of), lambda x: x.startswith("{"))


def _keys(path: str) -> Column:
    return F.coalesce(F.json_object_keys(_field(path)), X.empty_strings())


def _text(path: str, of: str | Column = "payload") -> Column:
    return X.text_or_empty(_field(path, of))


def _truthy(value: Column) -> Column:
    """Anything but what is empty, zero, false or null."""
    return ~X.text_or_empty(value).isin("", "false", "0", "0.0", "[]", "{}", "null")


def answer_payload_checks(payloads: DataFrame, min_citations: int = 1, max_unsupported: int | None = None, expect_contextual: bool | None = None) -> DataFrame:
    """id, check, passed: what an answer's payload must have. With expect_contextual, whether the question was to be
    rewritten from its context; with max_unsupported, how many claims may lack support."""
    has = F.coalesce(F.json_object_keys("payload"), X.empty_strings())
    citations = _items("$.citations")
    mapped = F.filter(citations, lambda c: c.startswith("{"))
    labels = F.transform(mapped, lambda c: X.strip(_text("$.reference_label", c)))
    shown = F.transform(_objects("$.trace"), lambda t: _text("$.label", t))
    context = "$.retrieval_trace.contextual_query"
    used, rewritten = _truthy(_field(f"{context}.used")), _text(f"{context}.retrieval_query") != _text(f"{context}.original_query")
    unsupported = F.coalesce(_field("$.citation_check.stats.unsupported_count").try_cast("int"), F.lit(0))
    stages = F.array(*map(F.lit, TELEMETRY_STAGES))
    rules = {f"chatflow_field:{name}": F.array_contains(has, name) for name in ANSWER_FIELDS}
    rules |= {
        "chatflow_answer_nonempty": X.strip(_text("$.answer")) != "",
        "chatflow_min_citations": F.size(citations) >= min_citations,
        "chatflow_citation_labels_present": F.size(mapped) == F.size(citations),
        "chatflow_citation_labels_unique": F.size(F.array_distinct(labels)) == F.size(labels),
        "chatflow_llm_status_known": _text("$.llm_status").isin(*LLM_STATUSES),
        "chatflow_web_status_known": _text("$.web_search_status").isin(*WEB_STATUSES),
        "chatflow_trace_stage_coverage": F.size(F.array_except(F.array(*map(F.lit, TRACE_LABELS)), shown)) == 0,
        "chatflow_contextual_trace_present": F.size(_keys(context)) > 0,
        "chatflow_citation_check_stats": F.size(_keys("$.citation_check.stats")) > 0,
        "chatflow_telemetry_stage_coverage": F.size(F.array_except(stages, _keys("$.telemetry.summary"))) == 0,
    }
    if expect_contextual is not None:
        rules["chatflow_contextual_expected_usage"] = used == expect_contextual
    if expect_contextual:
        rules["chatflow_contextual_signals"] = _truthy(_field(f"{context}.signals"))
        rules["chatflow_contextual_turns"] = F.coalesce(_field(f"{context}.context_turns_used").try_cast("int"), F.lit(0)) > 0
        rules["chatflow_contextual_rewrite"] = rewritten
    if max_unsupported is not None:
        rules["chatflow_unsupported_claim_budget"] = unsupported <= max_unsupported
    return payload_checks(payloads, rules)


def summary_payload_checks(payloads: DataFrame, min_quote_rate: float = 1.0, min_label_rate: float = 0.0, expected_method: str | None = None) -> DataFrame:
    """id, check, passed: what a summary's payload must have; some rules apply to one method only."""
    has = F.coalesce(F.json_object_keys("payload"), X.empty_strings())
    citations, groups, parts = _items("$.citations"), _items("$.evidence_groups"), _items("$.map_summaries")
    quoted = F.size(F.filter(citations, lambda c: X.strip(_text("$.quote", c)) != ""))
    rate = lambda n, total: F.when(total > 0, F.round(n / total, 4)).otherwise(0.0)
    method, reason = _text("$.summary_method"), _text("$.fallback_reason")
    status = F.coalesce(F.nullif(_field("$.llm_status"), F.lit("")), _text("$.status"))
    given = F.flatten(F.transform(_objects("$.evidence_groups"), lambda g: F.transform(_objects("$.evidence", g), lambda e: X.strip(_text("$.label", e)))))
    given = F.array_distinct(F.filter(given, lambda x: x != ""))
    mapped = F.transform(_objects("$.map_summaries"), lambda m: F.concat_ws("\n", _text("$.content", m), F.array_join(_items("$.evidence_labels", m), "\n")))
    said = F.regexp_extract_all(F.concat_ws("\n", _text("$.content"), F.array_join(mapped, "\n")), F.lit(r"(?U)\b(S\d+)\b"), F.lit(1))
    reduced, extracted = method == "map_reduce", method == "extractive"
    rules: dict[str, Column | tuple[Column, Column]] = {f"summary_field:{name}": F.array_contains(has, name) for name in SUMMARY_FIELDS}
    rules |= {
        "summary_content_nonempty": (X.strip(_text("$.content")) != "") | (status == "empty"),
        "summary_method_known": method.isin(*SUMMARY_METHODS),
        "summary_llm_status_known": status.isin(*LLM_STATUSES),
        "summary_citation_quote_coverage": rate(quoted, F.size(citations)) >= min_quote_rate,
        "summary_evidence_label_coverage": (F.size(given) > 0, rate(F.size(F.array_intersect(given, said)), F.size(given)) >= min_label_rate),
        "summary_map_reduce_status_used": (reduced, status == "used"),
        "summary_map_reduce_evidence_groups": (reduced, F.size(groups) > 0),
        "summary_map_reduce_map_outputs": (reduced, F.size(parts) > 0),
        "summary_map_reduce_no_fallback_reason": (reduced, reason == ""),
        "summary_extractive_fallback_reason": (extracted & (F.size(citations) > 0), (reason != "") | status.isin("skipped", "empty")),
        "summary_single_prompt_citations": (method == "single_prompt", F.size(citations) > 0),
    }
    if expected_method is not None:
        rules["summary_expected_method"] = method == expected_method
    return payload_checks(payloads, rules)


def summarize_checks(checks: DataFrame) -> DataFrame:
    """section, check, total, failed, pass_rate, gate: by check, by section and over all (nulls). checks: section, check,
    passed."""
    out = checks.rollup("section", "check").agg(F.count("*").alias("total"), F.count_if(~F.col("passed")).alias("failed"))
    return out.withColumns({"pass_rate": F.round((F.col("total") - F.col("failed")) / F.col("total"), 4), "gate": F.col("failed") == 0})


# telemetry: kind (event, span, counter, observation), name, stage, ts, duration_ms, status, value, attributes


def stage_summary(telemetry: DataFrame) -> DataFrame:
    span = (F.col("kind") == "span") & F.col("duration_ms").isNotNull()
    duration = F.when(span, F.col("duration_ms"))
    return telemetry.groupBy(F.coalesce("stage", F.lit("general")).alias("stage")).agg(
        F.count_if(F.col("kind") == "event").alias("events"), F.count_if(F.col("kind") == "span").alias("spans"),
        F.count_if((F.col("kind") == "span") & (F.col("status") == "error")).alias("error_spans"), F.count(duration).alias("durations"),
        *[F.round(f(duration), 3).alias(n) for n, f in (("total_ms", F.sum), ("min_ms", F.min), ("max_ms", F.max), ("avg_ms", F.avg))],
        F.coalesce(F.sum(F.when(F.col("kind") == "counter", F.col("value"))), F.lit(0.0)).alias("counted"),
    )


def observation_values(observations: DataFrame) -> DataFrame:
    """stage, name, value, n: a row for each different value, however many there are."""
    return observations.groupBy("stage", "name", "value").agg(F.count("*").alias("n"))


def observation_summary(observations: DataFrame) -> DataFrame:
    """stage, name, count, min, max, avg, distribution (value, whole numbers without .0, to count, in numeric order).

    The distribution of a name is one map: it is listed for measurements of at most DISTINCT_VALUES different values,
    such as counts, and is null for others, whose quantiles observation_sketches has and whose common values
    frequent_values.
    """
    each = observation_values(observations)
    text = F.when(F.col("value") == F.floor("value"), F.col("value").cast("long").cast("string")).otherwise(F.col("value").cast("string"))
    figures = each.groupBy("stage", "name").agg(
        F.sum("n").alias("count"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.round(F.sum(F.col("value") * F.col("n")) / F.sum("n"), 3).alias("avg"), F.count("*").alias("kinds"),
    )
    few = figures.filter(F.col("kinds") <= DISTINCT_VALUES).select(F.col("stage").alias("f_stage"), F.col("name").alias("f_name"))
    same = lambda p: F.col("stage").eqNullSafe(F.col(f"{p}_stage")) & F.col("name").eqNullSafe(F.col(f"{p}_name"))
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("value", text.alias("text"), "n"))), lambda p: F.struct(p.text, p.n))
    listed = each.join(few, same("f"), "left_semi").groupBy("stage", "name").agg(F.map_from_entries(pairs).alias("distribution"))
    out = figures.join(listed.withColumnsRenamed({"stage": "l_stage", "name": "l_name"}), same("l"), "left")
    return out.select("stage", "name", "count", "min", "max", "avg", "distribution")


#: Parameter of the quantile sketches: the rank of a quantile is off by 1.33 / k^0.9 of all values or so, 1.3 % for 200.
SKETCH_K = 200


def observation_sketches(observations: DataFrame, size: str = "1 day", k: int = SKETCH_K) -> DataFrame:
    """stage, name, window_start, n, low, high, total, sketch: the measurements of each window of time (observations:
    stage, name, ts, value) as a quantile sketch of a fixed size, whatever their number. Rows can be stored and merged
    with those of other windows, runs and clusters. NaN and null values are left out."""
    known = observations.filter(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")))
    value = F.col("value").cast("double")
    out = known.groupBy("stage", "name", F.window("ts", size).alias("w")).agg(
        F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.sum(value).alias("total"), F.kll_sketch_agg_double(value, F.lit(k)).alias("sketch")
    )
    return out.select("stage", "name", F.col("w.start").alias("window_start"), "n", "low", "high", "total", "sketch")


def merge_sketches(sketches: DataFrame, by: Sequence[str] = ("stage", "name"), k: int = SKETCH_K) -> DataFrame:
    """Sketch rows brought together by the given columns; the result can be merged again."""
    return sketches.groupBy(*by).agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch")
    )


def sketch_summary(sketches: DataFrame, quantiles: Sequence[float] = (0.5, 0.9, 0.99)) -> DataFrame:
    """Sketch rows with avg and the quantiles (p50, p90, p99): values that were seen, whose rank is that of the quantile
    within the sketch's error. Count, lowest, highest and mean are exact."""
    found = {f"p{100 * q:g}": F.kll_sketch_get_quantile_double("sketch", F.lit(q)) for q in quantiles}
    return sketches.withColumns({"avg": F.round(F.col("total") / F.col("n"), 3), **found}).drop("sketch", "total")


def frequent_values(observations: DataFrame, least_share: float = 0.01) -> DataFrame:
    """stage, name, value, n: the values that make up at least that share of their name's measurements, with their exact
    counts; at most 1 / least_share rows a name. Rare values never leave the tasks that counted them."""
    each = observation_values(observations)
    total = each.groupBy("stage", "name").agg(F.sum("n").alias("all_n"))
    same = F.col("stage").eqNullSafe(F.col("t_stage")) & F.col("name").eqNullSafe(F.col("t_name"))
    rows = each.join(total.withColumnsRenamed({"stage": "t_stage", "name": "t_name"}), same)
    return rows.filter(F.col("n") >= least_share * F.col("all_n")).select("stage", "name", "value", "n")


#: Values up to which observation_summary lists a name's distribution.
DISTINCT_VALUES = 1_000


def counters(increments: DataFrame) -> DataFrame:
    """stage, name, value; a negative increment is an error."""
    checked = F.when(F.col("value") < 0, F.raise_error(F.lit("negative increment")).cast("double")).otherwise(F.col("value"))
    return increments.groupBy(F.coalesce("stage", F.lit("general")).alias("stage"), "name").agg(F.sum(checked).alias("value"))


def normalize_results(payloads: DataFrame) -> DataFrame:
    """kind, id, name, value, status: measures of result payloads (id, kind in index, retrieval, llm; payload JSON). Of
    alias keys the first that is not null counts; a list counts its items."""
    first = lambda *paths: F.coalesce(*[_field(p) for p in paths])
    number = lambda *paths: F.coalesce(first(*paths).try_cast("double"), F.json_array_length(first(*paths)).cast("double"), F.lit(0.0))
    tokens = F.coalesce(_field("$.usage.total_tokens").try_cast("double"), number("$.usage.prompt_tokens") + number("$.usage.completion_tokens"))
    kinds = {
        "index": {"files": number("$.indexed_files", "$.files"), "chunks": number("$.total_chunks", "$.chunks"), "failed": number("$.failed_files", "$.failed", "$.errors")},
        "retrieval": {"hits": number("$.hit_count", "$.hits", "$.citations"), "top_score": number("$.top_score", "$.score"), "coverage": number("$.coverage", "$.query_coverage")},
        "llm": {"tokens": tokens, "latency_ms": number("$.latency_ms", "$.duration_ms"), "retries": number("$.retries", "$.attempts")},
    }
    word = F.lower(X.text_or_empty(first("$.status", "$.llm_status", "$.retrieval_quality", "$.state")))
    status = F.when(word.isin("error", "failed", "timeout"), "error").when(word.isin("fallback", "partial", "warning", "degraded"), "degraded").when(word.isin("none", "empty", "disabled"), "empty").otherwise("ok")
    each = F.array().cast("array<struct<name:string,value:double>>")
    for kind, measures in kinds.items():
        each = F.when(F.col("kind") == kind, F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in measures.items()])).otherwise(each)
    return payloads.select("id", "kind", status.alias("status"), F.explode(each).alias("m")).select("id", "kind", "m.name", "m.value", "status")


_ERROR_WORDS, _OK_WORDS = ("error", "failed", "failure", "timeout"), ("ok", "success", "succeeded", "completed", "ready")
_TRUE_WORDS, _FALSE_WORDS = ("true", "yes", "1", "ok", "sufficient"), ("false", "no", "0", "insufficient", "empty")


#: All keys that record_results reads.
_RESULT_KEYS = (
    "base_url", "candidate_count", "candidates", "candidates_count", "chunk_count", "chunks", "chunks_total",
    "citation_count", "citations", "citations_count", "completion_tokens", "course", "course_id", "duration_ms",
    "elapsed_ms", "error", "error_message", "error_type", "evidence_quality", "evidence_sufficient", "failed_files",
    "fallback", "fallback_reason", "fallback_to", "fallback_used", "files_failed", "files_indexed", "files_skipped",
    "files_total", "index_duration_ms", "index_schema_version", "indexed_files", "input_tokens", "is_sufficient", "k",
    "latency_ms", "limit", "llm_status", "matches", "material_count", "message", "model", "model_name",
    "output_tokens", "parse_failed", "processed_files", "prompt_tokens", "provider", "purpose", "quality",
    "recalled_count", "rerank_count", "reranked_count", "results", "retrieval_duration_ms", "retrieval_quality",
    "retrieval_strategy", "retrieval_trace", "route", "schema_version", "skipped_files", "sources", "status",
    "strategy", "sufficient", "task", "tokens_total", "topK", "top_k", "total_files", "total_tokens", "trace",
    "used_fallback",
)


def _unpacked(payloads: DataFrame) -> DataFrame:
    """id, kind and the result keys of each payload as texts, null where it lacks them: a payload is parsed once, however
    many keys and aliases are asked for. Of a key that stands twice the last counts."""
    return payloads.select("id", "kind", F.json_tuple("payload", *_RESULT_KEYS).alias(*(f"at_{k}" for k in _RESULT_KEYS)))


def _present(*keys: str) -> Column:
    """The first of the keys that is not null, as text; of rows that _unpacked made."""
    return F.coalesce(*(F.col(f"at_{k}") for k in keys))


def _listed(*keys: str) -> Column:
    """The items of the first of the keys that is not null, as JSON texts; null if that is no list."""
    value = _present(*keys)
    return F.when(value.startswith("["), F.from_json(value, "array<string>"))


def _amount(*keys: str) -> Column:
    """As a number: of a list its length, of true and false 1 and 0."""
    value = _present(*keys)
    return F.coalesce(F.size(_listed(*keys)).cast("double"), value.try_cast("double"), F.when(value == "true", 1.0).when(value == "false", 0.0))


def _yes(*keys: str) -> Column:
    value = _present(*keys)
    word = F.lower(X.strip(value))
    return F.when(value.isNull(), F.lit(None).cast("boolean")).when(word.isin(*_TRUE_WORDS), True).when(word.isin(*_FALSE_WORDS), False).otherwise(_truthy(value))


def _result_status() -> Column:
    word = F.lower(X.strip(_present("status", "llm_status")))
    return F.when(word.isin(*_ERROR_WORDS), "error").when(word.isin(*_OK_WORDS), "ok").when(_truthy(_present("error", "error_message")), "error").otherwise("ok")


def record_results(payloads: DataFrame) -> DataFrame:
    """kind (event, counter, observation), name, stage, value, attributes: the telemetry of result payloads (id, kind in
    index, retrieval, llm; payload JSON), an event with the payload's id, counters and observations for each. Of alias
    keys the first that is not null counts; what a payload lacks is not observed. Rows fit stage_summary, counters and
    observation_summary; payloads of other kinds give none."""
    duration = lambda own: _amount("duration_ms", "elapsed_ms", own)
    failed = _result_status() == "error"
    files_failed, chunks = _amount("files_failed", "failed_files", "parse_failed"), _amount("chunks_total", "chunk_count", "chunks")
    trace = _listed("retrieval_trace", "trace")
    n_trace = F.size(trace).cast("double")
    of = lambda *keys: F.size(_listed(*keys)).cast("double")
    counted = lambda c: F.when(c >= 0, c)  # noqa: E731  the size of null is -1 where ANSI is off
    quality, sufficient = _present("retrieval_quality", "quality", "evidence_quality"), _yes("sufficient", "is_sufficient", "evidence_sufficient")
    poor = F.coalesce(~sufficient, F.lit(False)) | F.coalesce(quality.isin("insufficient", "empty"), F.lit(False))
    asked, answered = _amount("prompt_tokens", "input_tokens"), _amount("completion_tokens", "output_tokens")
    both = F.when(asked.isNotNull() | answered.isNotNull(), F.coalesce(asked, F.lit(0.0)) + F.coalesce(answered, F.lit(0.0)))
    reason = _present("fallback_reason", "fallback", "fallback_to")
    fell_back = _truthy(reason) | _truthy(_present("used_fallback", "fallback_used"))

    def seen(key: str) -> Column:
        values = F.array_distinct(F.transform(F.coalesce(trace, X.empty_strings()), lambda t: F.when(t.startswith("{"), F.get_json_object(t, f"$.{key}"))))
        values = F.slice(F.array_compact(values), 1, 8)
        return F.when(F.size(values) > 0, F.to_json(values))

    error = _present("error", "error_message", "message")
    kinds = {
        "index": (
            "indexing",
            {"index_jobs_total": F.lit(1.0), "index_jobs_failed": F.when(failed, 1.0), "index_jobs_succeeded": F.when(~failed, 1.0), "index_files_failed": F.when(files_failed > 0, files_failed), "index_chunks_total": F.when(chunks > 0, chunks)},
            {"files_total": _amount("files_total", "total_files", "material_count"), "files_indexed": _amount("files_indexed", "indexed_files", "processed_files"), "files_skipped": _amount("files_skipped", "skipped_files"),
             "files_failed": files_failed, "chunks_total": chunks, "duration_ms": duration("index_duration_ms")},
            {"status": _result_status(), "course_id": _present("course_id", "course"), "schema_version": _present("schema_version", "index_schema_version"), "error": error},
        ),
        "retrieval": (
            "retrieval",
            {"retrieval_queries_total": F.lit(1.0), "retrieval_queries_insufficient": F.when(poor, 1.0), "retrieval_queries_with_evidence": F.when(~poor, 1.0)},
            {"top_k": F.coalesce(_amount("top_k", "topK", "k", "limit"), counted(n_trace)), "candidate_count": F.coalesce(_amount("candidate_count", "candidates_count", "recalled_count"), counted(of("candidates", "results", "matches"))),
             "reranked_count": F.coalesce(_amount("reranked_count", "rerank_count"), counted(n_trace)), "citation_count": F.coalesce(_amount("citation_count", "citations_count"), counted(of("citations", "sources"))),
             "duration_ms": duration("retrieval_duration_ms")},
            {"strategy": _present("strategy", "retrieval_strategy"), "quality": quality, "sufficient": sufficient.cast("string"), "methods": seen("method"), "files": seen("file_name")},
        ),
        "llm": (
            "llm",
            {"llm_calls_total": F.lit(1.0), "llm_calls_failed": F.when(failed, 1.0), "llm_calls_succeeded": F.when(~failed, 1.0), "llm_calls_fallback": F.when(fell_back, 1.0)},
            {"duration_ms": duration("latency_ms"), "prompt_tokens": asked, "completion_tokens": answered, "total_tokens": F.coalesce(_amount("total_tokens", "tokens_total"), both)},
            {"status": _result_status(), "route": _present("route", "task", "purpose"), "model": _present("model", "model_name"), "provider": _present("provider", "base_url"), "fallback_reason": reason,
             "error_type": _present("error_type"), "error": error},
        ),
    }
    rows = F.array().cast("array<struct<kind:string,name:string,stage:string,value:double,attributes:map<string,string>>>")
    none = F.lit(None).cast("map<string,string>")
    for kind, (stage, counts, measures, texts) in kinds.items():
        row = lambda of, name, value, attributes: F.struct(F.lit(of).alias("kind"), F.lit(name).alias("name"), F.lit(stage).alias("stage"), value.cast("double").alias("value"), attributes.alias("attributes"))  # noqa: B023, E731
        entries = [F.when(v.isNotNull(), F.struct(F.lit(k).alias("k"), v.cast("string").alias("v"))) for k, v in (texts | measures).items()]
        made = [row("event", f"{kind}-result", F.lit(None), F.map_from_entries(F.array_compact(F.array(*entries))))]
        made += [F.when(v.isNotNull(), row("counter", n, v, none)) for n, v in counts.items()]
        made += [F.when(v.isNotNull(), row("observation", f"{kind}_{n}", v, none)) for n, v in measures.items()]
        rows = F.when(F.col("kind") == kind, F.array_compact(F.array(*made))).otherwise(rows)
    return _unpacked(payloads).select("id", F.explode(rows).alias("r")).select("id", "r.*")


# web sources


_SOURCE_FIELDS = ("url", "link", "uri", "title", "name", "content", "snippet", "description", "text", "score")
_SOURCE = ", ".join(f"{n}: string" for n in _SOURCE_FIELDS)
_LISTS = ("results", "items", "sources", "data")


def _sources(json: Column) -> Column:
    """The sources of a JSON list; null if it is none."""
    found = F.filter(F.from_json(json, "array<string>"), lambda s: s.startswith("{"))
    return F.when(X.text_or_empty(json).rlike(r"^\s*\["), F.transform(found, lambda s: F.from_json(s, _SOURCE.replace(":", ""))))


def _labelled_sources(text: Column) -> Column:
    """Sources of blocks between lines of ---, with a title, a URL and what follows a line of `Highlights:`."""

    def one(block: Column) -> Column:
        found = {"title": F.trim(F.regexp_extract(block, r"(?m)^Title:\s*(.+)$", 1)), "url": F.regexp_extract(block, r"(?m)^URL:\s*(https?://\S+)$", 1)}
        found["content"] = X.strip(F.regexp_extract(block, r"(?ms)^Highlights:\s*?$(.*)\z", 1))
        return F.struct(*(found.get(n, F.lit(None).cast("string")).alias(n) for n in _SOURCE_FIELDS))

    return F.filter(F.transform(F.split(text, r"\n\s*---\s*\n"), one), lambda s: (s.title != "") & (s.url != ""))


def parse_search_results(raw: DataFrame) -> DataFrame:
    """query_id, ord, url, title, snippet, score of tool results (query_id, result as JSON text), in order: all lists of
    structuredContent (results, items, sources, data), or the object itself if it has none and a URL; then of content
    the resource links, the resources, and the texts. A text is a JSON list of sources, an object with such a list or a
    source itself, or labelled blocks. Of alias fields the first that is not empty counts; a missing score is 0."""
    none = F.array().cast(f"array<struct<{_SOURCE}>>")
    structured = F.get_json_object("result", "$.structuredContent")
    listed = F.flatten(F.array(*(F.coalesce(_sources(F.get_json_object("result", f"$.structuredContent.{n}")), none) for n in _LISTS)))
    itself = F.from_json(structured, _SOURCE.replace(":", ""))
    alone = F.coalesce(itself.url, itself.link, itself.uri).isNotNull()
    listed = X.let(listed, lambda found: F.when((F.size(found) == 0) & alone, F.array(itself)).otherwise(found))
    kind = f"type string, resource struct<{_SOURCE}>, " + _SOURCE.replace(":", "")
    items = F.transform(_objects("$.content", "result"), lambda x: F.from_json(x, kind))

    def of_text(text: Column) -> Column:
        nested = F.coalesce(*(_sources(F.get_json_object(text, f"$.{n}")) for n in _LISTS), F.array(F.from_json(text, _SOURCE.replace(":", ""))))
        parsed = F.when(text.rlike(r"^\s*\{"), nested).otherwise(F.coalesce(_sources(text), none))
        return F.when(F.get_json_object(text, "$").isNotNull(), parsed).otherwise(_labelled_sources(text))

    def of_item(item: Column) -> Column:
        link = F.array(F.struct(*(item[n].alias(n) for n in _SOURCE_FIELDS)))
        resource = F.when(item.resource.isNotNull(), F.array(item.resource)).otherwise(none)
        return F.when(item.type == "resource_link", link).when(item.type == "resource", resource).when(item.type == "text", of_text(X.text_or_empty(item.text))).otherwise(none)

    found = F.concat(F.coalesce(listed, none), F.coalesce(F.flatten(F.transform(items, of_item)), none))
    first = lambda *names: F.coalesce(*(F.nullif(F.col(f"c.{n}"), F.lit("")) for n in names))
    rows = raw.select("query_id", F.posexplode(found).alias("ord", "c"))
    return rows.select(
        "query_id", "ord", F.trim(X.text_or_empty(first("url", "link", "uri"))).alias("url"), first("title", "name").alias("title"),
        X.strip(first("content", "snippet", "description", "text")).alias("snippet"), F.coalesce(F.col("c.score").try_cast("double"), F.lit(0.0)).alias("score"),
    )


def source_quality(url: Column, title: Column, snippet: Column) -> Column:
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit("")))
    add = lambda c, n: F.when(c, n).otherwise(0.0)
    return (
        add(host.endswith(".edu") | host.contains(".edu."), 2.0) + add(host.endswith(".gov") | host.contains(".gov."), 2.0)
        + add(X.contains_any(host, ("docs.", "developer.", "wikipedia.org", "python.org")), 1.0) + add(url.startswith("https://"), 0.25)
        + add(F.length(X.strip(snippet)) >= 80, 0.5) + add(X.text_or_empty(title).rlike("(?i)官方|文档|documentation|reference|specification"), 0.5)
    )


def source_relevance(query: Column, title: Column, snippet: Column) -> Column:
    """Share of the query's tokens in title and snippet; 0 without tokens."""
    hay = F.lower(F.concat_ws("\n", X.text_or_empty(title), X.text_or_empty(snippet)))
    return X.let(X.tokenize_web_query(query), lambda ts: F.when(F.size(ts) == 0, 0.0).otherwise(F.size(F.filter(ts, lambda t: hay.contains(t))) / F.size(ts)))


def normalize_sources(candidates: DataFrame, max_results: int | None = None) -> DataFrame:
    """query_id, position, file_id, file_name, url, score, source_quality, quote. candidates: query_id, query, ord, url,
    title, snippet, score. The first of a URL counts; those that do not bear on the query go."""
    url = F.trim(X.text_or_empty(F.col("url")))
    host = F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit(""))
    rows = candidates.withColumn("url", url).filter(F.col("url").rlike("^https?://") & (host != ""))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "url").orderBy("ord"))).filter("n = 1").drop("n")
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.try_parse_url("url", F.lit("AUTHORITY")))
    rows = rows.withColumns({"title": title, "snippet": X.strip(F.col("snippet"))})
    n = F.size(X.tokenize_web_query(F.col("query")))
    relevant = (n == 0) | (source_relevance(F.col("query"), F.col("title"), F.col("snippet")) >= F.least(F.lit(0.34), 1 / F.greatest(n, F.lit(1))))
    rows = rows.filter(relevant).select(
        "query_id", "ord", F.concat(F.lit("web-"), X.stable_id(F.col("url"))).alias("file_id"), F.substr("title", F.lit(1), F.lit(180)).alias("file_name"), "url",
        F.coalesce("score", F.lit(0.0)).alias("score"), source_quality(F.col("url"), F.col("title"), F.col("snippet")).alias("source_quality"),
        F.substr("snippet", F.lit(1), F.lit(360)).alias("quote"),
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("source_quality"), F.desc("score"), F.desc(F.length("quote")), "ord")
    rows = rows.withColumn("position", F.row_number().over(w))
    return rows.drop("ord") if max_results is None else rows.filter(F.col("position") <= max_results).drop("ord")


def chat_sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """user_id, started_at, ended_at, events: activity with pauses below the gap. Works on streams with a watermark."""
    window = F.session_window("ts", gap)
    return events.groupBy("user_id", window.alias("w")).agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("started_at"), F.col("w.end").alias("ended_at"), "events")


def retain_uploads(uploads: DataFrame, now: Column, max_age_days: int = 7, max_files: int = 80) -> DataFrame:
    """The uploads (course_id, name, mtime) that stay: not older than the age, and of these the newest of each course."""
    fresh = uploads.filter(F.col("mtime") >= now - F.make_interval(days=F.lit(max_age_days)))
    w = Window.partitionBy("course_id").orderBy(F.desc("mtime"), "name")
    return fresh.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= max_files).drop("n")

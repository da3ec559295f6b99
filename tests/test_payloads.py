"""Tool results, payload checks, query intents and the chain of summaries on literal rows."""

import json

import pytest

from lectern.operators import chunking, conversations, evaluation, summaries

ANSWER = {
    "answer": "x", "citations": [{"reference_label": "L1"}, {"reference_label": "L2"}], "trace": [{"label": x} for x in evaluation.TRACE_LABELS],
    "retrieval_trace": {"contextual_query": {"used": True, "signals": ["pronoun"], "context_turns_used": 2, "retrieval_query": "a b", "original_query": "b"}},
    "citation_check": {"stats": {"unsupported_count": 0}}, "llm_status": "used", "web_search_status": "skipped",
    "telemetry": {"summary": {x: {} for x in evaluation.TELEMETRY_STAGES}},
}
CONTEXT = ANSWER["retrieval_trace"]["contextual_query"]


def with_context(**changes):
    return ANSWER | {"retrieval_trace": {"contextual_query": CONTEXT | changes}}


BROKEN_ANSWERS = {
    "answer_nonempty": ANSWER | {"answer": "  "},
    "min_citations": ANSWER | {"citations": []},
    "citation_labels_present": ANSWER | {"citations": ["L1", {"reference_label": "L2"}]},
    "citation_labels_unique": ANSWER | {"citations": [{"reference_label": "L1"}, {"reference_label": " L1 "}]},
    "llm_status_known": ANSWER | {"llm_status": "odd"},
    "web_status_known": ANSWER | {"web_search_status": None},
    "trace_stage_coverage": ANSWER | {"trace": ANSWER["trace"][1:]},
    "citation_check_stats": ANSWER | {"citation_check": {"stats": {}}},
    "telemetry_stage_coverage": ANSWER | {"telemetry": {"summary": {"llm": {}, "web": {}, "retrieval": {}}}},
    "contextual_expected_usage": with_context(used=False),
    "contextual_signals": with_context(signals=[]),
    "contextual_turns": with_context(context_turns_used=0),
    "contextual_rewrite": with_context(retrieval_query="b"),
    "unsupported_claim_budget": ANSWER | {"citation_check": {"stats": {"unsupported_count": 2}}},
}


def failures(spark, check, payloads, **options):
    rows = spark.createDataFrame([(k, v if isinstance(v, str) else json.dumps(v)) for k, v in payloads.items()], "id string, payload string")
    out = {k: set() for k in payloads}
    for r in check(rows, **options).filter("not passed").collect():
        out[r.id].add(r.check)
    return out


def test_each_rule_of_answers_has_a_payload_that_fails_it(spark):
    found = failures(spark, evaluation.answer_payload_checks, {"good": ANSWER, **BROKEN_ANSWERS}, max_unsupported=1, expect_contextual=True)
    assert found["good"] == set()
    assert all(found[k] == {f"chatflow_{k}"} for k in BROKEN_ANSWERS), found
    missing = {name: {k: v for k, v in ANSWER.items() if k != name} for name in evaluation.ANSWER_FIELDS}
    found = failures(spark, evaluation.answer_payload_checks, missing, min_citations=0)
    assert all(f"chatflow_field:{name}" in found[name] for name in missing)
    assert found["retrieval_trace"] == {"chatflow_field:retrieval_trace", "chatflow_contextual_trace_present"}
    bad = failures(spark, evaluation.answer_payload_checks, {"text": "no json", "list": "[]", "null": "null", "empty": ""}, min_citations=0)
    assert all(len(v) > 10 for v in bad.values())
    plain = failures(spark, evaluation.answer_payload_checks, {"x": with_context(used=0)}, expect_contextual=False)
    assert plain == {"x": set()}


SUMMARY = {
    "content": "as S1 says", "citations": [{"quote": "q"}], "llm_status": "used", "summary_method": "map_reduce",
    "evidence_groups": [{"evidence": [{"label": "S1"}, {"label": "S2"}]}], "map_summaries": [{"content": "c", "evidence_labels": ["S2"]}],
}
BROKEN_SUMMARIES = {
    "content_nonempty": SUMMARY | {"content": " ", "map_summaries": [{"content": "S1 and S2"}]},
    "method_known": SUMMARY | {"summary_method": "odd"},
    "llm_status_known": SUMMARY | {"llm_status": "odd", "summary_method": "single_prompt"},
    "citation_quote_coverage": SUMMARY | {"citations": [{"quote": "q"}, {"quote": " "}]},
    "evidence_label_coverage": SUMMARY | {"map_summaries": [{"content": "XS2"}]},
    "map_reduce_status_used": SUMMARY | {"llm_status": "failed"},
    "map_reduce_evidence_groups": SUMMARY | {"evidence_groups": []},
    "map_reduce_map_outputs": SUMMARY | {"content": "S1 S2", "map_summaries": []},
    "map_reduce_no_fallback_reason": SUMMARY | {"fallback_reason": "why"},
    "extractive_fallback_reason": SUMMARY | {"summary_method": "extractive", "llm_status": "fallback"},
    "single_prompt_citations": SUMMARY | {"summary_method": "single_prompt", "citations": []},
}


def test_each_rule_of_summaries_has_a_payload_that_fails_it(spark):
    found = failures(spark, evaluation.summary_payload_checks, {"good": SUMMARY, **BROKEN_SUMMARIES}, min_label_rate=1.0)
    assert found["good"] == set()
    for name in BROKEN_SUMMARIES:
        assert f"summary_{name}" in found[name] and len(found[name]) <= 2, (name, found[name])
    empty = {"e": {"content": "", "citations": [], "status": "empty", "summary_method": "extractive"}}
    assert failures(spark, evaluation.summary_payload_checks, empty, min_quote_rate=0.0) == {"e": {"summary_field:llm_status"}}
    assert failures(spark, evaluation.summary_payload_checks, {"x": SUMMARY}, expected_method="extractive") == {"x": {"summary_expected_method"}}


RESULTS = {
    "all lists": ({"structuredContent": {"data": [{"uri": "u4"}], "results": [{"url": "u1", "title": "t", "score": 0.5}], "items": [{"link": "u2", "name": "n"}], "sources": [{"url": "", "uri": "u3", "content": "", "text": " s "}]}}, [("u1", "t", "", 0.5), ("u2", "n", "", 0.0), ("u3", None, "s", 0.0), ("u4", None, "", 0.0)]),
    "alone": ({"structuredContent": {"link": "u", "title": "t"}}, [("u", "t", "", 0.0)]),
    "links beside lists": ({"structuredContent": {"results": [{"url": "u1"}]}, "content": [{"type": "resource_link", "uri": "u2", "name": "n", "description": "d"}]}, [("u1", None, "", 0.0), ("u2", "n", "d", 0.0)]),
    "resource": ({"content": [{"type": "resource", "resource": {"uri": "u", "text": "x", "score": "0.25"}}, {"type": "resource"}, {"type": "image", "url": "no"}, "odd"]}, [("u", None, "x", 0.25)]),
    "texts": ({"content": [{"type": "text", "text": json.dumps({"results": [{"url": "a"}]})}, {"type": "text", "text": json.dumps([{"url": "b"}, {"url": "c"}])}, {"type": "text", "text": json.dumps({"url": "d", "snippet": "s"})}, {"type": "text", "text": json.dumps({"items": []})}, {"type": "text", "text": "17"}]}, [("a", None, "", 0.0), ("b", None, "", 0.0), ("c", None, "", 0.0), ("d", None, "s", 0.0)]),
    "empty list, good text": ({"structuredContent": {"results": []}, "content": [{"type": "text", "text": "Title: T\nURL: https://e.org/x\nHighlights:\none\ntwo\n"}]}, [("https://e.org/x", "T", "one\ntwo", 0.0)]),
    "blocks": ({"content": [{"type": "text", "text": "Title: A\nURL: http://a.org\n --- \nTitle: B\nno url\n---\nURL: http://c.org\n\n---\nTitle:  D \nURL:   http://d.org\nHighlights: same line"}]}, [("http://a.org", "A", "", 0.0), ("http://d.org", "D", "", 0.0)]),
    "nothing": ({"content": []}, []),
}


def test_every_shape_of_tool_results(spark):
    rows = spark.createDataFrame([(k, json.dumps(v)) for k, (v, _) in RESULTS.items()] + [("broken", "{"), ("null", None)], "query_id string, result string")
    out = {k: [] for k in [*RESULTS, "broken", "null"]}
    for r in evaluation.parse_search_results(rows).collect():
        out[r.query_id].append((r.ord, r.url, r.title, r.snippet, r.score))
    for k, (_, expected) in RESULTS.items():
        assert [x[1:] for x in sorted(out[k])] == expected, k
    assert out["broken"] == out["null"] == []


@pytest.mark.parametrize("question, quality, intent, search", [
    ("", "partial", "clarification", False), ("12", "partial", "clarification", False), ("第三题？！", "none", "general_question", True), ("三十", None, "clarification", False),
    ("你好！", "none", "light_followup", False), ("最新进展", "sufficient", "web_lookup", True), ("2024 年的考试", "sufficient", "web_lookup", True), ("search the docs", "sufficient", "web_lookup", True),
    ("解释页表", "none", "course_explain", False), ("summarize it", "none", "course_explain", False), ("stack?", None, "general_question", True), ("stack?", "partial", "course_question", False),
])
def test_intents(spark, question, quality, intent, search):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(question, quality)], "q string, quality string")
    got = row.select(conversations.query_intent(F.col("q"), F.col("quality")).alias("i"), conversations.should_search_web(F.col("q"), F.col("quality")).alias("s")).first()
    assert (got.i, got.s) == (intent, search)


def test_the_chain_of_summaries(spark):
    page = "course_id string, file_id string, file_name string, path string, file_ord string, page int, page_seq int, text string"
    rows = [(c, f"f{c}", f"{c}.md", f"{c}/{c}.md", "1", None, 0, f"the stack of {c} grows. it shrinks.") for c in ("a", "b")]
    chunks = chunking.build_chunks(spark.createDataFrame(rows, page))
    courses = spark.createDataFrame([("a", "A"), ("b", None), ("c", "C")], "course_id string, name string")

    def outcome(generate):
        return {r.course_id: (r.summary_method, r.llm_status, r.fallback_reason, bool(r.content)) for r in summaries.course_summary(chunks, courses, generate).collect()}

    none = ("extractive", "skipped", "no_summary_chunks", False)
    assert outcome(lambda p: "S1 says") == {"a": ("map_reduce", "used", "", True), "b": ("map_reduce", "used", "", True), "c": none}
    one = outcome(lambda p: "done" if p.startswith("课程《A") else "")
    assert one == {"a": ("single_prompt", "used", "map_reduce_failed", True), "b": ("extractive", "fallback", "map_reduce_failed", True), "c": none}
    assert outcome(None) == {"a": ("extractive", "disabled", "llm_disabled", True), "b": ("extractive", "disabled", "llm_disabled", True), "c": ("extractive", "skipped", "llm_disabled", False)}


def test_telemetry_of_results(spark):
    payloads = {
        ("index", "failed"): {"status": "Failed", "files_total": 5, "indexed_files": ["a", "b"], "parse_failed": "3", "chunk_count": 0, "error": "boom", "course": "c", "elapsed_ms": 12.5},
        ("retrieval", "partial"): {"quality": "partial", "is_sufficient": "yes", "trace": [{"method": "bm25", "file_name": "f"}, {"method": "bm25"}, {"method": "mmr"}, 3], "sources": [1, 2], "limit": 4},
        ("retrieval", "minimal"): {},
        ("retrieval", "poor"): {"sufficient": False, "candidates": [], "retrieval_duration_ms": True},
        ("retrieval", "empty"): {"retrieval_quality": "empty"},
        ("llm", "fallback"): {"llm_status": "ok", "fallback": "local", "input_tokens": 7, "model": "m"},
        ("llm", "timeout"): {"status": "timeout", "prompt_tokens": 3, "output_tokens": 4, "latency_ms": "9"},
        ("llm", "silent"): {"status": "odd", "error_message": "x", "total_tokens": 11},
        ("other", "none"): {"status": "ok"},
    }
    rows = spark.createDataFrame([(i, k, json.dumps(v)) for (k, i), v in payloads.items()], "id string, kind string, payload string")
    found = {}
    for r in evaluation.record_results(rows).collect():
        found.setdefault(r.id, {})[r.kind, r.name] = r.attributes if r.kind == "event" else r.value
    stage = {"index": "indexing", "retrieval": "retrieval", "llm": "llm"}
    assert {(r.kind, r.stage) for r in evaluation.record_results(rows).select("kind", "stage").collect()} <= {(k, s) for k in ("event", "counter", "observation") for s in stage.values()}

    def split(id_):
        own = found[id_]
        return {n: v for (k, n), v in own.items() if k == "counter"}, {n: v for (k, n), v in own.items() if k == "observation"}, next(v for (k, _), v in own.items() if k == "event")

    assert split("failed") == (
        {"index_jobs_total": 1, "index_jobs_failed": 1, "index_files_failed": 3},
        {"index_files_total": 5, "index_files_indexed": 2, "index_files_failed": 3, "index_chunks_total": 0, "index_duration_ms": 12.5},
        {"status": "error", "course_id": "c", "error": "boom", "files_total": "5.0", "files_indexed": "2.0", "files_failed": "3.0", "chunks_total": "0.0", "duration_ms": "12.5"},
    )
    counts, seen, event = split("partial")
    assert counts == {"retrieval_queries_total": 1, "retrieval_queries_with_evidence": 1}
    assert seen == {"retrieval_top_k": 4, "retrieval_reranked_count": 4, "retrieval_citation_count": 2}
    assert json.loads(event["methods"]) == ["bm25", "mmr"] and json.loads(event["files"]) == ["f"] and event["sufficient"] == "true"
    assert split("minimal") == ({"retrieval_queries_total": 1, "retrieval_queries_with_evidence": 1}, {}, {})
    assert split("poor")[:2] == ({"retrieval_queries_total": 1, "retrieval_queries_insufficient": 1}, {"retrieval_candidate_count": 0, "retrieval_duration_ms": 1})
    assert split("empty")[0] == {"retrieval_queries_total": 1, "retrieval_queries_insufficient": 1}
    assert split("fallback")[:2] == ({"llm_calls_total": 1, "llm_calls_succeeded": 1, "llm_calls_fallback": 1}, {"llm_prompt_tokens": 7, "llm_total_tokens": 7})
    assert split("timeout")[:2] == ({"llm_calls_total": 1, "llm_calls_failed": 1}, {"llm_prompt_tokens": 3, "llm_completion_tokens": 4, "llm_total_tokens": 7, "llm_duration_ms": 9})
    assert split("silent")[0] == {"llm_calls_total": 1, "llm_calls_failed": 1} and split("silent")[1] == {"llm_total_tokens": 11}
    assert "none" not in found


def test_a_result_payload_is_parsed_once(spark):
    rows = spark.createDataFrame([("a", "llm", '{"status": "ok", "status": "failed", "topK": 1}'), ("b", "llm", "["), ("c", "index", None)], "id string, kind string, payload string")
    out = evaluation.record_results(rows)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("json_tuple(payload") == 1 and "get_json_object(payload" not in plan
    # what the JSON says last counts, and what is no object has no keys
    names = {(r.id, r.name) for r in out.filter("kind = 'counter'").collect()}
    assert names == {(i, n) for i, n in [("a", "llm_calls_total"), ("a", "llm_calls_failed"), ("b", "llm_calls_total"), ("b", "llm_calls_succeeded"), ("c", "index_jobs_total"), ("c", "index_jobs_succeeded")]}

"""Queries over answers, conversations, mastery, dashboards, summaries, evaluation, telemetry, web sources and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import text as X
from lectern.operators import answers as A
from lectern.operators import changes as G
from lectern.operators import conversations as C
from lectern.operators import dashboard as D
from lectern.operators import evaluation as E
from lectern.operators import lexical
from lectern.operators import mastery as M
from lectern.operators import summaries as S
from lectern.operators import vector as V
from lectern.plans import inputs as I
from lectern.plans import retrieval as R
from lectern.sources.scratch import materialise

NOW = "2024-03-01 00:00:00"


# mastery


def score_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    score, streak = (F.col("event_id") % 101).cast("int"), (F.col("event_id") % 5).cast("int")
    rows = I.answers(spark, sf_dir)
    delta = M.score_delta(F.col("correct"), F.col("difficulty"), F.col("confidence"), score, streak)
    return rows.select("event_id", delta.alias("delta"), M.mastery_level(score).alias("level"), M.review_days(score, F.col("correct")).alias("days"))


def fold_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.fold_answers(I.answers(spark, sf_dir))
    return out.select("course_id", "point_id", "score", "level", "attempts", "correct_count", "wrong_count", "streak", "last_result", "review_interval_days", F.date_format("next_review_at", "yyyy-MM-dd HH:mm:ss").alias("next_review_at"))


def _mistakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.mistakes(I.answers(spark, sf_dir).withColumn("question", F.concat(F.lit("q "), F.col("event_id"))))


def mistakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mistakes(spark, sf_dir).select("mistake_id", "course_id", "point_id", "question", "status")


def resolve_mistakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _mistakes(spark, sf_dir)
    done = rows.filter("course_id % 2 = 0").select("mistake_id", F.col("created_at").alias("resolved_at"))
    out, _ = M.resolve_mistakes(rows, done)
    return out.groupBy("course_id", "status").agg(F.count("*").alias("n"), F.sum("review_count").alias("reviews"))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.answers(spark, sf_dir).select("point_id", F.concat(F.lit("title "), F.col("event_id")).alias("title"), F.array(F.concat(F.lit("a"), F.col("event_id") % 7)).alias("aliases"), F.array(F.lit("r")).alias("source_refs"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"), "event_id")
    return rows


def upsert_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _points(spark, sf_dir)
    out = M.upsert_points(rows.filter("event_id % 2 = 0").drop("event_id"), rows.filter("event_id % 2 = 1").drop("event_id"))
    return out.select("point_id", "title", F.size("aliases").cast("long").alias("n_aliases"), F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


# dashboard


def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "doing").otherwise("todo")
    kind = F.when(F.col("o_orderpriority").startswith("1"), "review").when(F.col("o_orderpriority").startswith("2"), "practice").otherwise("read")
    return I.read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("course_id"), F.col("o_orderkey").alias("id"), F.concat(F.lit("order "), F.col("o_orderkey")).alias("title"), kind.alias("kind"), status.alias("status"),
        (5 + F.col("o_orderkey") % 60).alias("estimated_minutes"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"), F.lit(None).cast("timestamp").alias("completed_at"),
    )


_PLAN = """plan AS (SELECT o_custkey AS course_id, o_orderkey AS id, 'order ' || o_orderkey AS title,
    CASE WHEN o_orderpriority LIKE '1%' THEN 'review' WHEN o_orderpriority LIKE '2%' THEN 'practice' ELSE 'read' END AS kind,
    CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'doing' ELSE 'todo' END AS status, 5 + o_orderkey % 60 AS estimated_minutes, o_orderdate AS created_at FROM orders)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.pages(spark, sf_dir).join(I.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_ord"), F.col("n_chars").alias("size")), "file_ord")
    path = F.when(F.col("file_ord") % 6 == 0, F.concat_ws("/", "course_id", F.lit("AI生成"), "file_name")).otherwise(F.col("path"))
    return rows.select("course_id", "file_id", "file_name", path.alias("path"), "size", F.timestamp_seconds(1_700_000_000 + F.col("file_ord")).alias("modified_at"))


_FILES = f"""{I.PAGES_SQL}, files AS (SELECT p.course_id, p.file_id, p.file_name, p.file_ord % 6 = 0 AS made, d.n_chars AS size, p.file_ord FROM pages_in p JOIN documents d ON d.doc_id = p.file_ord)"""


def learning_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.learning_progress(plan(spark, sf_dir))


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.review_queue(plan(spark, sf_dir)).select("course_id", "position", "id", "kind", "status")


def mastery_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = D.mastery_summary(M.fold_answers(I.answers(spark, sf_dir)), None, _mistakes(spark, sf_dir), F.lit(NOW).cast("timestamp"))
    return out.select("course_id", "points", "weak", "building", "familiar", "mastered", "average_score", "due_count", "open_mistakes", F.array_join("weakest", ",").alias("weakest"))


def materials_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = D.materials_stats(files(spark, sf_dir))
    return out.select("course_id", "file_count", "generated_file_count", "total_bytes", F.element_at("by_extension", ".md").alias("md_files"))


def generated_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.generated_artifacts(files(spark, sf_dir)).select("course_id", "total", "summaries", "quizzes", "other", "latest")


def recent_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, events = plan(spark, sf_dir), I.read(spark, sf_dir, "events")
    notes = p.select("course_id", F.concat(F.lit("note "), F.col("id")).alias("title"), "created_at")
    messages = events.select(F.col("user_id").alias("course_id"), F.col("event_type").alias("role"), F.concat(F.lit("said "), F.col("event_id")).alias("content"), F.col("ts").alias("created_at"))
    made_at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("file_id").cast("long"))
    f = files(spark, sf_dir).withColumns({"course_id": F.substr("course_id", F.lit(4)).cast("long"), "modified_at": made_at})
    return D.recent_activity(messages, notes, p, f, 100).select("course_id", "position", "type", "title")


def course_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    courses = I.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("course_id"))
    mastery = D.mastery_summary(M.fold_answers(I.answers(spark, sf_dir)), None, None, F.lit(NOW).cast("timestamp")).select("course_id", "points", "average_score")
    out = D.course_dashboard(courses, {"progress": D.learning_progress(plan(spark, sf_dir)), "mastery": mastery})
    return out.select("course_id", "progress.total", "progress.done", "progress.progress_percent", "mastery.points", "mastery.average_score")


def default_study_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.default_study_plan(files(spark, sf_dir)).select("course_id", "id", "kind", "estimated_minutes", "source_file_id")


def apply_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = plan(spark, sf_dir).select("course_id", "id", "title", "status")
    change = F.when(F.col("id") % 5 == 0, "delete").when(F.col("id") % 5 == 1, "update").otherwise("add")
    changes = rows.withColumns({"op": change, "seq": F.col("id")}).withColumn("status", F.when(F.col("op") == "update", "done").otherwise(F.col("status"))).withColumn("title", F.when(F.col("op") == "add", F.col("title")))
    out, _ = D.apply_changes(rows, changes, ["title", "status"])
    return out.groupBy("course_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "done").alias("done"), F.max("id").alias("top"))


def plan_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of changes of every kind to the plan items, and what they are behind it."""
    rows = plan(spark, sf_dir).withColumns({c: F.col(c).cast("timestamp") for c in ("created_at", "updated_at", "completed_at")})
    steps = (
        (3, "update", ["status"], None, None, "done", None), (4, "update", ["title", "kind", "estimated_minutes"], "  ", "odd", None, "999"),
        (6, "update", ["status"], None, None, "doing", None), (12, "update", None, None, None, "done", None),
        (7, "delete", None, None, None, None, None), (14, "update", ["title"], "late", None, None, None), (10, "add", None, "new", None, None, "1"),
    )
    changes = None
    for n, (every, op, sets, title, kind, status, minutes) in enumerate(steps, 1):
        text = lambda v: F.lit(v).cast("string")
        named = F.lit(None).cast("array<string>") if sets is None else F.array(*map(F.lit, sets))
        one = rows.filter(F.col("id") % every == 0).select(
            "course_id", (F.lit(None).cast("long") if op == "add" else F.col("id")).alias("id"), F.lit(op).alias("op"), (10 * F.col("id") + n).alias("seq"), F.lit(f"2024-01-0{n}").cast("timestamp").alias("at"),
            named.alias("sets"), text(title).alias("title"), text(kind).alias("kind"), text(status).alias("status"), text(minutes).alias("estimated_minutes"),
        )
        changes = one if changes is None else changes.unionByName(one)
    out, _ = G.fold_changes(rows, changes, G.PLAN_ITEMS)
    return out.select("course_id", "id", "title", "kind", "status", "estimated_minutes", F.date_format("completed_at", "yyyy-MM-dd").alias("completed"))


def retain_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    uploads = I.read(spark, sf_dir, "events").select(F.col("user_id").alias("course_id"), F.col("event_id").cast("string").alias("name"), F.col("ts").alias("mtime"))
    now = uploads.agg(F.max("mtime")).first()[0]
    return E.retain_uploads(uploads, F.lit(now).cast("timestamp"), 7, 20).select("course_id", "name")


# conversations


def pair_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.pair_turns(I.messages(spark, sf_dir))
    return out.select("conv_id", "turn", F.md5("user_text").alias("user_digest"), F.md5("assistant_text").alias("assistant_digest"))


def recent_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.recent_turns(C.pair_turns(I.messages(spark, sf_dir)))
    return out.select("conv_id", "n_turns", F.md5(F.array_join("texts", "|")).alias("digest"), (F.length("context") <= 650).alias("bounded"))


def contextual_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = I.messages(spark, sf_dir)
    asked = m.filter("role = 'user'").groupBy("conv_id").agg(F.max_by("content", "turn").alias("question"))
    asked = asked.select(F.col("conv_id").alias("query_id"), "conv_id", F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("这个 "), F.col("question"))).otherwise(F.col("question")).alias("question"))
    out = C.contextual_query(asked, m)
    return out.select("query_id", "is_follow_up", F.array_join("signals", ",").alias("signals"), "context_turns_used", (F.length("retrieval_query") <= 900).alias("bounded"))


def follow_up_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.concat(F.lit("第 "), F.col("conv_id") % 9, F.lit(" 题 这个 "), F.col("content"))
    return I.messages(spark, sf_dir).select("conv_id", "turn", F.array_join(C.follow_up_signals(words), ",").alias("signals"))


def conversation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.conversation_stats(I.messages(spark, sf_dir), I.messages(spark, sf_dir).select("conv_id").distinct().withColumn("last_read", F.lit(2).cast("long")))


def conversation_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    course = F.concat(F.lit("src"), F.col("conv_id") % 20).alias("course_id")
    rows = I.messages(spark, sf_dir).select(course, "conv_id", "role", "content", F.timestamp_seconds(1_700_000_000 + F.col("conv_id") * 7919 % 100_003 + F.col("turn")).alias("created_at"))
    reads = rows.groupBy("course_id", "conv_id").agg(F.min("created_at").alias("last_read_at")).filter("conv_id % 3 <> 0")
    return C.conversation_list(rows, reads).select("course_id", "conv_id", "title", "message_count", "unread_count", "position")


def _user_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.messages(spark, sf_dir).filter("role = 'user'").select((F.col("conv_id") % 20).alias("conv_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.col("content").alias("question"))


def memory_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.memory_topics(_user_questions(spark, sf_dir)).select("conv_id", "topic", "count", "rank", F.md5("sample").alias("digest"))


def memory_topics_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.memory_topics_folded(_user_questions(spark, sf_dir))


def plan_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("turn") % 3 == 0, F.lit("hello!")).when(F.col("turn") % 3 == 1, (F.col("conv_id") % 30).cast("string")).otherwise(F.col("content"))
    return I.messages(spark, sf_dir).select("conv_id", "turn", C.plan_action(text, F.col("turn") > 4, F.lit(False)).alias("action"))


def query_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(*map(F.lit, ("latest ", "explain ", "hello", "12", "", "in 2024 ")))
    k = (F.col("conv_id") + F.col("turn")) % 6
    text = F.when(k.isin(2, 3), F.get(words, k.cast("int"))).otherwise(F.concat(F.get(words, k.cast("int")), F.regexp_replace(F.lower("content"), "current|latest|today|recent|search", "")))
    rows = I.messages(spark, sf_dir).withColumns({"q": text, "quality": F.when(F.col("conv_id") % 2 == 0, "partial")})
    return rows.select("conv_id", "turn", C.query_intent(F.col("q"), F.col("quality")).alias("intent"), C.should_search_web(F.col("q"), F.col("quality")).alias("search"))


def count_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.messages(spark, sf_dir).withColumn("content", F.concat(F.when(F.col("conv_id") % 2 == 0, "因为 ").otherwise(""), F.col("content")))
    return C.count_attempts(rows)


# answers and citations


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question with the best chunk found for it."""
    a, c = R.asked(spark, sf_dir), R.index(spark, sf_dir)
    top = lexical.bm25_rank(a, c, 2).select("query_id", "course_id", "chunk_index", "rank", "score")
    return top.join(c, ["course_id", "chunk_index"]).join(a.select("query_id", "question"), "query_id")


def grounded_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _pairs(spark, sf_dir).withColumn("context_text", F.col("text"))
    out = A.grounded_answers(I.questions(spark, sf_dir), hits)
    return out.select("query_id", "mode", F.md5("answer").alias("digest"), F.coalesce(F.size("citations"), F.lit(0)).cast("long").alias("n_citations"))


def _citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select(F.col("query_id").alias("answer_id"), F.col("rank").alias("ord"), F.when(F.col("rank") == 2, "web").otherwise("local").alias("source_type"), F.lit("").alias("label"), F.col("text").alias("quote"))


def label_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.label_citations(_citations(spark, sf_dir)).select("answer_id", "label", F.md5("quote").alias("digest"))


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("query_id") % 4 == 0, "").when(F.col("query_id") % 4 == 1, " [X9]").otherwise(" [L1]")
    text = F.regexp_replace("question", "[!?;\\n]", " ")
    rows = I.questions(spark, sf_dir).select(F.col("query_id").alias("answer_id"), F.concat(text, F.lit("!"), label).alias("answer"))
    return A.check_claims(rows, A.label_citations(_citations(spark, sf_dir)))


def check_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _claims(spark, sf_dir).select("answer_id", "claim_ord", "assertive", "token_count", F.round("max_overlap", 6).alias("max_overlap"), "supported", "reason")


def citation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.citation_report(_claims(spark, sf_dir))


def annotate_unsupported(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = _claims(spark, sf_dir)
    rows = claims.groupBy("answer_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("claim_ord", "sentence"))), lambda s: s.sentence), " ").alias("answer"))
    return A.annotate_unsupported(rows, claims, "(?)").select("answer_id", F.col("answer").endswith("(?)").alias("marked"))


def build_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = _citations(spark, sf_dir).select(F.col("answer_id").alias("query_id"), "ord", "source_type", F.concat(F.lit("L"), "ord").alias("label"), "quote")
    history = I.messages(spark, sf_dir).withColumnRenamed("conv_id", "query_id")
    return A.build_prompts(I.questions(spark, sf_dir), evidence, history)


# summaries


def _representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.representative_chunks(R.index(spark, sf_dir))


def representative_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _representative(spark, sf_dir).select("course_id", "position", "chunk_index", "variety", F.md5("keyword").alias("keyword"))


def summary_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.summary_evidence(_representative(spark, sf_dir)).select("course_id", "label", "file_id", "chunk_index", F.length("text").alias("n_chars"))


def group_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.group_evidence(S.summary_evidence(_representative(spark, sf_dir)))
    return out.select("course_id", "group_id", "file_id", F.array_join("labels", ",").alias("labels"))


def map_reduce_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = R.index(spark, sf_dir)
    # read twice, for the parts and for the statuses
    groups = materialise(S.group_evidence(S.summary_evidence(S.representative_chunks(chunks))))
    return S.map_reduce_summary(groups, chunks.select("course_id").distinct(), lambda prompt: prompt.split("\n")[0] + f" {len(prompt)}")


def course_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = R.index(spark, sf_dir)
    courses = chunks.select("course_id", F.col("course_id").alias("name")).distinct()
    # a model that answers some prompts only, so that all three ways are taken
    return S.course_summary(chunks, courses, lambda p: f"S1 {len(p)}" if len(p) % 3 else "")


def extractive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.extractive_summary(_representative(spark, sf_dir))


def extractive_quiz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.extractive_quiz(_representative(spark, sf_dir))


# evaluation and telemetry


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir)
    q = I.questions(spark, sf_dir)
    course = F.element_at(F.array(*map(F.lit, ("none", "partial", "sufficient"))), (F.col("query_id") % 3 + 1).cast("int"))
    first = F.lower(F.substring_index("question", " ", 1))
    cases = q.select(
        F.col("query_id").alias("case_id"), F.array(F.concat(F.col("course_id"), F.lit("/lecture-1.md"))).alias("expected_files"), F.lit("partial").alias("min_quality"),
        F.array(first, F.lit("zzz")).alias("expected_terms"), F.array(F.lit("zzz")).alias("forbidden_terms"), F.lit(0.5).alias("min_answer_term_rate"), F.lit(1).alias("max_unsupported_claims"),
    )
    answers = q.select(F.col("query_id").alias("case_id"), F.col("question").alias("answer"), course.alias("quality"), (F.col("query_id") % 50 / 10.0).alias("top_score"))
    cited = pairs.select(F.col("query_id").alias("case_id"), F.col("rank").alias("ord"), "file_name")
    claims = q.select(F.col("query_id").alias("case_id"), (F.col("query_id") % 4).alias("unsupported_count"))
    return E.eval_cases(cases, answers, cited, claims)


def eval_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).select("case_id", "quality", "citation_hit", "first_citation_hit", "term_rate", "forbidden_pass", "unsupported_pass", "passed")


def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.eval_summary(_results(spark, sf_dir))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("event", "span", "counter", "span"))), (F.col("event_id") % 4 + 1).cast("int"))
    return I.read(spark, sf_dir, "events").select(
        kind.alias("kind"), F.concat(F.lit("n"), F.col("user_id") % 5).alias("name"), F.col("event_type").alias("stage"), "ts", F.col("value").alias("duration_ms"),
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"), (F.col("event_id") % 9).cast("double").alias("value"),
    )


_TELEMETRY = """telemetry AS (SELECT ['event', 'span', 'counter', 'span'][event_id % 4 + 1] AS kind, 'n' || (user_id % 5) AS name, event_type AS stage, ts,
    value AS duration_ms, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, (event_id % 9)::DOUBLE AS value FROM events)"""


def stage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.stage_summary(telemetry(spark, sf_dir)).select("stage", "events", "spans", "error_spans", "durations", F.round("total_ms", 1).alias("total_ms"), "min_ms", "max_ms", F.round("avg_ms", 2).alias("avg_ms"), "counted")


def observation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.observation_summary(telemetry(spark, sf_dir))
    parts = F.transform(F.map_entries("distribution"), lambda e: F.concat_ws(":", e.key, e.value.cast("string")))
    return out.select("stage", "name", "count", "min", "max", "avg", F.array_join(parts, ",").alias("distribution"))


def observation_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = E.observation_sketches(telemetry(spark, sf_dir).withColumn("value", F.col("duration_ms")))
    return E.sketch_summary(E.merge_sketches(days)).select("stage", "name", "n", "low", "high", F.round("avg", 2).alias("avg"), (F.col("p50").between(F.col("low"), F.col("high")) & (F.col("p50") <= F.col("p99"))).alias("ordered"))


def frequent_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.frequent_values(telemetry(spark, sf_dir), 0.12)


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.counters(telemetry(spark, sf_dir).filter("kind = 'counter'").select("stage", "name", "value"))


def stage_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.streaming.jobs import stage_counters

    out = stage_counters(telemetry(spark, sf_dir), "1 hour")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "stage", "n", "errors")


def chat_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.chat_sessions(I.read(spark, sf_dir, "events"))
    return out.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("events").alias("longest"), F.sum("events").alias("events"))


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, ("ok", "failed", "fallback"))), (F.col("event_id") % 3 + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ("index", "retrieval", "llm"))), (F.col("event_id") % 3 + 1).cast("int"))
    body = F.to_json(F.struct(status.alias("status"), F.col("value").alias("top_score"), (F.col("event_id") % 7).alias("files"), F.array("event_type").alias("hits"), F.struct((F.col("event_id") % 5).alias("prompt_tokens"), F.lit(2).alias("completion_tokens")).alias("usage")))
    return I.read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), kind.alias("kind"), body.alias("payload"))


def normalize_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.normalize_results(_payloads(spark, sf_dir))
    return out.groupBy("kind", "name", "status").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def record_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.record_results(_payloads(spark, sf_dir)).groupBy("kind", "name", "stage").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def answer_payload_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir).groupBy("query_id").agg(F.first("question").alias("question"), F.collect_list(F.struct(F.concat(F.lit("L"), "rank").alias("reference_label"), F.col("text").alias("quote"))).alias("citations"))
    stages = F.array(*(F.struct(F.lit(x).alias("label")) for x in E.TRACE_LABELS[:-1]))
    body = F.to_json(F.struct(F.col("question").alias("answer"), F.lit("used").alias("llm_status"), "citations", stages.alias("trace")))
    return E.answer_payload_checks(pairs.select(F.col("query_id").alias("id"), body.alias("payload")), 2)


def summary_payload_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.summary_evidence(_representative(spark, sf_dir)).groupBy("course_id").agg(F.sort_array(F.collect_list("label")).alias("labels"), F.collect_list(F.struct(F.col("text").alias("quote"))).alias("citations"), F.collect_list(F.struct("label")).alias("evidence"))
    body = F.to_json(F.struct(F.array_join("labels", " ").alias("content"), F.lit("map_reduce").alias("summary_method"), F.lit("used").alias("llm_status"), F.array(F.struct("evidence")).alias("evidence_groups"), "citations"))
    return E.summary_payload_checks(rows.select(F.col("course_id").alias("id"), body.alias("payload")))


def summarize_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.read(spark, sf_dir, "events").select(F.col("event_type").alias("section"), F.concat(F.lit("c"), F.col("user_id") % 4).alias("check"), (F.col("value") < 90).alias("passed"))
    return E.summarize_checks(rows)


# web


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1)
    snippet = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), "\\s+", " "))
    return I.read(spark, sf_dir, "pages").select((F.col("page_id") % 25).alias("query_id"), F.lit("the what of").alias("query"), F.col("page_id").alias("ord"), "url", title.alias("title"), snippet.alias("snippet"), (F.col("page_id") % 10 / 10.0).alias("score"))


_WEB = """cand AS (SELECT page_id % 25 AS query_id, page_id AS ord, url, trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) AS title0,
        trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS snippet, page_id % 10 / 10.0 AS score FROM pages),
    named AS (SELECT *, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, CASE WHEN title0 = '' THEN regexp_extract(url, '^https?://([^/?#]*)', 1) ELSE title0 END AS title FROM cand),
    scored AS (SELECT *, CASE WHEN starts_with(url, 'https://') THEN 0.25 ELSE 0 END + CASE WHEN length(snippet) >= 80 THEN 0.5 ELSE 0 END
            + CASE WHEN regexp_matches(title, '(?i)documentation|reference|specification') THEN 0.5 ELSE 0 END
            + CASE WHEN regexp_matches(lower(host), 'docs\\.|developer\\.|wikipedia\\.org|python\\.org') THEN 1 ELSE 0 END AS source_quality,
        (contains(lower(title || chr(10) || snippet), 'the')::INT + contains(lower(title || chr(10) || snippet), 'of')::INT) / 2.0 AS relevance FROM named)"""


def source_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _candidates(spark, sf_dir)
    return rows.select("ord", E.source_quality(F.col("url"), F.col("title"), F.col("snippet")).alias("source_quality"))


def source_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).select("ord", E.source_relevance(F.col("query"), F.col("title"), F.col("snippet")).alias("relevance"))


def normalize_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.normalize_sources(_candidates(spark, sf_dir), 10)
    return out.select("query_id", "position", "file_id", "url", F.round("score", 3).alias("score"), "source_quality", F.md5("quote").alias("digest"))


def parse_search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _candidates(spark, sf_dir)
    block = F.concat(F.lit("Title: t"), F.col("ord"), F.lit("\nURL: "), F.col("url"), F.lit("\nHighlights:\n"), F.col("snippet"))
    body = F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), block.alias("text"))).alias("content")))
    out = E.parse_search_results(rows.select(F.col("ord").alias("query_id"), body.alias("result")))
    return out.select("query_id", "ord", "url", "title", F.md5("snippet").alias("snippet"))


# vectors


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.read(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("doc_id"), F.lit(0).alias("course_id"), F.col("vec_id").alias("ord"), F.col("embedding").cast("array<double>").alias("vector"))


def cosine_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    after = rows.select((F.col("doc_id") - 1).alias("doc_id"), F.col("vector").alias("next_vector"))
    return rows.join(after, "doc_id").select("doc_id", F.round(V.cosine_similarity(F.col("vector"), F.col("next_vector")), 6).alias("cosine"))


def unit_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir).select("doc_id", V.unit_vector(F.col("vector")).alias("u"))
    return rows.select("doc_id", F.round(V.dot(F.col("u"), F.col("u")), 6).alias("norm"), F.round(F.get("u", F.lit(0)), 6).alias("first"))


def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _vectors(spark, sf_dir)
    asked = index.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "course_id", "vector")
    out = V.vector_search(asked, index, 5)
    return out.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def upsert_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _vectors(spark, sf_dir).select("doc_id", "ord", F.lit(1).alias("version"), "vector")
    new = old.filter("doc_id % 3 = 0").select("doc_id", (F.col("ord") + 100000).alias("ord"), F.lit(2).alias("version"), F.transform("vector", lambda x: -x).alias("vector"))
    return V.upsert_vectors(old, new).select("doc_id", "ord", "version", F.round(F.get("vector", F.lit(0)), 6).alias("first"))


def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.hash_embed(I.read(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", F.size("vector").alias("dims"), F.round(V.dot(F.col("vector"), F.col("vector")), 6).alias("norm"))


def embed_with(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = lambda texts: [[len(t), t.count(" ") + 1.0] for t in texts]
    return V.embed_with(I.read(spark, sf_dir, "documents"), "doc_id", "text", model).select("doc_id", F.round(V.dot(F.col("vector"), F.col("vector")), 6).alias("norm"))


def build_vector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = V.build_vector_index(R.chunks(spark, sf_dir))
    return out.select("doc_id", F.length("text").alias("n_chars"), F.element_at("metadata", "course_id").alias("course_id"))


def hybrid_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir).select((F.col("doc_id") % 10).alias("query_id"), F.col("doc_id").cast("string").alias("id"), (F.floor(F.col("doc_id") / 10) + 1).alias("rank"), F.get("vector", F.lit(0)).alias("score"))
    # both lists rank all vectors: one by number, one by the first coordinate
    by_value = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    out = V.hybrid_merge(v, v.withColumn("rank", by_value.cast("long")), 12)
    return out.select("query_id", "id", "rank", "retrieval_method", F.round("hybrid_rrf_score", 6).alias("score"))


def approximate_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialise(_vectors(spark, sf_dir))
    centres = V.fit_cells(rows)
    queries = rows.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "course_id", "vector")
    return V.approximate_search(queries, V.cell_index(rows, centres), centres).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = materialise(R.chunks(spark, sf_dir).drop("tokens"))  # its tokens are those of the texts
    vectors = V.hash_embed(chunks, ["id", "course_id", "chunk_index"]).withColumnsRenamed({"id": "doc_id", "chunk_index": "ord"})
    hits = V.hybrid_search(I.questions(spark, sf_dir), chunks, vectors)
    terms = F.array_join("matched_terms", " ").alias("matched_terms")
    return hits.select("query_id", "rank", "id", "retrieval_method", "score", "query_coverage", terms, F.md5("context_text").alias("context"))


_NAMES = """score_delta fold_answers mistakes resolve_mistakes upsert_points learning_progress review_queue mastery_summary
    materials_stats generated_artifacts recent_activity course_dashboard default_study_plan apply_changes plan_changes retain_uploads pair_turns
    recent_turns contextual_query follow_up_signals conversation_stats conversation_list memory_topics memory_topics_folded plan_action query_intent count_attempts
    grounded_answers label_citations check_claims citation_report annotate_unsupported build_prompts representative_chunks
    summary_evidence group_evidence map_reduce_summary course_summary extractive_summary extractive_quiz eval_cases eval_summary stage_summary
    observation_summary observation_sketches frequent_values counters stage_windows chat_sessions normalize_results record_results answer_payload_checks summary_payload_checks
    summarize_checks source_quality source_relevance normalize_sources parse_search_results cosine_similarity unit_vector
    vector_search upsert_vectors hash_embed embed_with build_vector_index approximate_search hybrid_merge hybrid_search""".split()
QUERIES = {name: globals()[name] for name in _NAMES}

_DELTA = """CASE WHEN {c} THEN greatest(1, round_even((8 + least(greatest({streak}, 0), 3)) * {w} * {f} * greatest(0.35::DOUBLE, (100 - {s}) / 100.0::DOUBLE), 0))
    ELSE -greatest(4, round_even(12 * {w} * {f} * greatest(0.5::DOUBLE, {s} / 100.0::DOUBLE), 0)) END"""
_W = "CASE {d} WHEN 'easy' THEN 0.75::DOUBLE WHEN 'hard' THEN 1.25::DOUBLE ELSE 1.0::DOUBLE END"
_EVENT_DELTA = _DELTA.format(c="correct", streak="(event_id % 5)", w="(" + _W.format(d="difficulty") + ")", f="(0.75 + 0.5 * confidence::DOUBLE)", s="(event_id % 101)")
_FOLD = f"""{I.ANSWERS_SQL}, ordered AS (SELECT *, row_number() OVER (PARTITION BY course_id, point_id ORDER BY ts, event_id) AS n FROM answers),
    fold AS (SELECT course_id, point_id, n, 50::BIGINT AS s0, ts, correct, 0::BIGINT AS streak0, NULL::BIGINT AS score, NULL::BIGINT AS streak FROM ordered WHERE false)"""
_REC = f"""WITH RECURSIVE {I.ANSWERS_SQL}, ordered AS (SELECT *, row_number() OVER (PARTITION BY course_id, point_id ORDER BY ts, event_id) AS n FROM answers),
    steps AS (SELECT course_id, point_id, 0::BIGINT AS n, 50::BIGINT AS score, 0::BIGINT AS streak, 0::BIGINT AS right_n, NULL::TIMESTAMP AS ts, NULL::BOOLEAN AS correct FROM (SELECT DISTINCT course_id, point_id FROM ordered)
        UNION ALL
        SELECT s.course_id, s.point_id, o.n, least(greatest(s.score + CAST({_DELTA.format(c="o.correct", streak="s.streak", w="(" + _W.format(d="o.difficulty") + ")", f="(0.75 + 0.5 * o.confidence::DOUBLE)", s="s.score")} AS BIGINT), 0), 100),
            CASE WHEN o.correct THEN s.streak + 1 ELSE 0 END, s.right_n + o.correct::BIGINT, o.ts, o.correct
        FROM steps s JOIN ordered o ON o.course_id = s.course_id AND o.point_id = s.point_id AND o.n = s.n + 1),
    folded AS (SELECT course_id, point_id, score, n AS attempts, right_n AS correct_count, n - right_n AS wrong_count, streak, correct, ts,
        CASE WHEN score < 40 THEN 'weak' WHEN score < 60 THEN 'building' WHEN score < 80 THEN 'familiar' ELSE 'mastered' END AS level,
        CASE WHEN NOT correct THEN 1 WHEN score < 40 THEN 1 WHEN score < 60 THEN 2 WHEN score < 80 THEN 4 ELSE 7 END AS days
        FROM (SELECT *, row_number() OVER (PARTITION BY course_id, point_id ORDER BY n DESC) AS last FROM steps) WHERE last = 1 AND n > 0)"""
_MISTAKES = f"{I.ANSWERS_SQL}, wrong AS (SELECT course_id, point_id, 'q ' || event_id AS question, ts, 'mistake-' || substr(sha1(point_id || '|q ' || event_id || '|' || strftime(ts, '%Y-%m-%d %H:%M:%S')), 1, 12) AS mistake_id FROM answers WHERE NOT correct)"
_CLEANED = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
_TURNS = f"""msgs AS (SELECT conv_id, turn, lower(role) AS role, {_CLEANED} AS t FROM conversations WHERE lower(role) IN ('user', 'assistant') AND {_CLEANED} <> ''),
    nexts AS (SELECT *, lead(role) OVER w AS nr, lead(t) OVER w AS nt FROM msgs WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    turns AS (SELECT conv_id, turn, t AS u, CASE WHEN nr = 'assistant' THEN nt ELSE '' END AS a FROM nexts WHERE role = 'user')"""
_TOP2 = R._TOP.replace(f"rank <= {R.LIMIT}", "rank <= 2")
_CITED = f"""{_TOP2}, labels AS (SELECT query_id AS answer_id, CASE WHEN rank = 2 THEN 'W1' ELSE 'L1' END AS label, text AS quote FROM hits UNION ALL SELECT query_id, rank::VARCHAR, text FROM hits)"""
_CLAIM_TOKENS = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9_]+'), lambda t: length(t) > 1))"
_CLAIMS = f"""{_CITED}, claims0 AS (SELECT query_id AS answer_id, trim(regexp_replace(question, '[!?;\\n]', ' ', 'g')) || '!' AS claim,
        CASE query_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'X9' ELSE 'L1' END AS label FROM asked),
    claims1 AS (SELECT c.*, {_CLAIM_TOKENS.format("claim")} AS own, l.quote FROM claims0 c LEFT JOIN labels l ON l.answer_id = c.answer_id AND l.label = c.label),
    claims2 AS (SELECT *, len(own) AS n, len(own) >= 4 AS assertive, CASE WHEN quote IS NULL THEN 0 ELSE len(list_intersect(own, {_CLAIM_TOKENS.format("quote")})) / greatest(len(own), 1)::DOUBLE END AS o FROM claims1),
    claims AS (SELECT *, CASE WHEN NOT assertive THEN 'non_assertive' WHEN label = '' THEN 'missing_citation' WHEN quote IS NULL THEN 'unknown_citation' WHEN o < 0.18 THEN 'low_overlap' ELSE 'ok' END AS reason FROM claims2)"""
_LONG = f"list_filter({I.tokens_sql('text')}, lambda t: length(t) > 1)"
_REPRESENTATIVE = f"""{I.CHUNKS_SQL}, tk AS (SELECT course_id, chunk_index, file_id, text, {_LONG} AS toks FROM chunks),
    ex AS (SELECT course_id, chunk_index, unnest(toks) AS tok, unnest(range(len(toks))) AS pos FROM tk),
    kw0 AS (SELECT course_id, chunk_index, tok, count(*) AS n, min(pos) AS first FROM ex GROUP BY 1, 2, 3),
    kw AS (SELECT course_id, chunk_index, arg_min(tok, first - n * 100000000) AS keyword FROM kw0 GROUP BY 1, 2),
    rk AS (SELECT t.*, len(list_distinct(toks)) AS variety, coalesce(keyword, '核心概念') AS keyword FROM tk t LEFT JOIN kw USING (course_id, chunk_index)),
    fr AS (SELECT *, row_number() OVER (PARTITION BY course_id, file_id ORDER BY variety DESC, length(text) DESC, chunk_index) = 1
            OR row_number() OVER (PARTITION BY course_id, keyword ORDER BY variety DESC, length(text) DESC, chunk_index) = 1 AS fresh FROM rk),
    rep AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY fresh DESC, variety DESC, length(text) DESC, chunk_index) AS position FROM fr) WHERE position <= 6)"""
_EVAL = f"""{_TOP2}, cited AS (SELECT query_id, list(file_name ORDER BY rank) AS files FROM hits GROUP BY 1),
    res AS (SELECT a.query_id AS case_id, ['none', 'partial', 'sufficient'][a.query_id % 3 + 1] AS quality, coalesce(list_contains(files, 'lecture-1.md'), false) AS hit,
        coalesce(files[1] = 'lecture-1.md', false) AS first_hit, ((contains(lower(question), lower(split_part(question, ' ', 1))))::INT + contains(lower(question), 'zzz')::INT) / 2.0 AS rate,
        NOT contains(question, 'zzz') AS forb, a.query_id % 4 <= 1 AS unsup, a.query_id % 50 / 10.0 AS top FROM asked a LEFT JOIN cited USING (query_id))"""

ORACLES = {
    "score_delta": f"""WITH {I.ANSWERS_SQL} SELECT event_id, CAST({_EVENT_DELTA} AS INTEGER) AS delta,
        CASE WHEN event_id % 101 < 40 THEN 'weak' WHEN event_id % 101 < 60 THEN 'building' WHEN event_id % 101 < 80 THEN 'familiar' ELSE 'mastered' END AS level,
        CASE WHEN NOT correct THEN 1 WHEN event_id % 101 < 40 THEN 1 WHEN event_id % 101 < 60 THEN 2 WHEN event_id % 101 < 80 THEN 4 ELSE 7 END AS days FROM answers""",
    "fold_answers": f"""{_REC} SELECT course_id, point_id, score, level, attempts, correct_count, wrong_count, streak, CASE WHEN correct THEN 'correct' ELSE 'wrong' END AS last_result,
        days AS review_interval_days, strftime(ts + to_days(days), '%Y-%m-%d %H:%M:%S') AS next_review_at FROM folded""",
    "mistakes": f"WITH {_MISTAKES} SELECT mistake_id, course_id, point_id, question, 'open' AS status FROM wrong",
    "resolve_mistakes": f"WITH {_MISTAKES} SELECT course_id, CASE WHEN course_id % 2 = 0 THEN 'resolved' ELSE 'open' END AS status, count(*) AS n, sum(CASE WHEN course_id % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS reviews FROM wrong GROUP BY 1, 2",
    "upsert_points": f"""WITH {I.ANSWERS_SQL} SELECT point_id, arg_max('title ' || event_id, (event_id % 2, ts)) AS title, count(DISTINCT event_id % 7) AS n_aliases,
        strftime(coalesce(min(ts) FILTER (WHERE event_id % 2 = 0), min(ts)), '%Y-%m-%d %H:%M:%S') AS created_at FROM answers GROUP BY 1""",
    "learning_progress": f"""WITH {_PLAN}, a AS (SELECT course_id, count(*) AS total, count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'doing') AS doing, count(*) FILTER (WHERE status = 'todo') AS todo,
            coalesce(sum(estimated_minutes) FILTER (WHERE status <> 'done'), 0)::BIGINT AS remaining_minutes, coalesce(sum(estimated_minutes) FILTER (WHERE status = 'done'), 0)::BIGINT AS completed_minutes,
            coalesce(min(id) FILTER (WHERE status = 'doing'), min(id) FILTER (WHERE status = 'todo')) AS next_item_id FROM plan GROUP BY 1)
        SELECT *, CAST(round_even(100 * done / total, 0) AS INTEGER) AS progress_percent, coalesce('order ' || next_item_id, '') AS next_item_title FROM a""",
    "review_queue": f"""WITH {_PLAN}, o AS (SELECT *, kind = 'review' OR status = 'doing' AS due FROM plan WHERE status <> 'done'), m AS (SELECT *, max(due) OVER (PARTITION BY course_id) AS any_due FROM o),
        r AS (SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY CASE status WHEN 'doing' THEN 0 ELSE 1 END, id) AS position FROM m WHERE due OR NOT any_due)
        SELECT course_id, position, id, kind, status FROM r WHERE position <= 5""",
    "mastery_summary": f"""{_REC}, w AS (SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY score, ts, point_id) AS k FROM folded),
        m AS (SELECT course_id, count(*) AS open_mistakes FROM answers WHERE NOT correct GROUP BY 1)
        SELECT w.course_id, count(*) AS points, count(*) FILTER (WHERE level = 'weak') AS weak, count(*) FILTER (WHERE level = 'building') AS building, count(*) FILTER (WHERE level = 'familiar') AS familiar,
            count(*) FILTER (WHERE level = 'mastered') AS mastered, CAST(round_even(avg(score), 0) AS INTEGER) AS average_score, count(*) FILTER (WHERE ts + to_days(days) <= TIMESTAMP '2024-03-01 00:00:00') AS due_count,
            coalesce(any_value(open_mistakes), 0) AS open_mistakes, string_agg(point_id, ',' ORDER BY k) FILTER (WHERE k <= 5) AS weakest
        FROM w LEFT JOIN m USING (course_id) GROUP BY 1""",
    "materials_stats": f"""WITH {_FILES} SELECT course_id, count(*) FILTER (WHERE NOT made) AS file_count, count(*) FILTER (WHERE made) AS generated_file_count,
        coalesce(sum(size) FILTER (WHERE NOT made), 0)::BIGINT AS total_bytes, nullif(count(*) FILTER (WHERE NOT made), 0) AS md_files FROM files GROUP BY 1""",
    "generated_artifacts": f"""WITH {_FILES} SELECT course_id, count(*) AS total, 0 AS summaries, count(*) FILTER (WHERE contains(file_name, 'quiz')) AS quizzes, count(*) FILTER (WHERE NOT contains(file_name, 'quiz')) AS other,
        arg_max(file_name, file_ord) AS latest FROM files WHERE made GROUP BY 1""",
    "recent_activity": f"""WITH {_FILES}, {_PLAN}, u AS (SELECT user_id AS course_id, 'message:' || event_type AS type, 'said ' || event_id AS title, ts AS created_at FROM events UNION ALL SELECT course_id, 'note', 'note ' || id, created_at FROM plan
            UNION ALL SELECT course_id, 'plan:' || status, title, created_at FROM plan
            UNION ALL SELECT substr(course_id, 4)::BIGINT, 'generated_artifact', file_name, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(file_ord) FROM files WHERE made),
            r AS (SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY created_at DESC, type, title) AS position FROM u)
        SELECT course_id, position, type, title FROM r WHERE position <= 100""",
    "course_dashboard": f"""{_REC}, {_PLAN}, p AS (SELECT course_id, count(*) AS total, count(*) FILTER (WHERE status = 'done') AS done FROM plan GROUP BY 1), m AS (SELECT course_id, count(*) AS points, CAST(round_even(avg(score), 0) AS INTEGER) AS average_score FROM folded GROUP BY 1)
        SELECT c_custkey AS course_id, coalesce(total, 0) AS total, coalesce(done, 0) AS done, coalesce(CAST(round_even(100 * done / total, 0) AS INTEGER), 0) AS progress_percent, coalesce(points, 0) AS points, coalesce(average_score, 0) AS average_score
        FROM customer LEFT JOIN p ON p.course_id = c_custkey LEFT JOIN m ON m.course_id = c_custkey""",
    "default_study_plan": f"""WITH {_FILES}, o AS (SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY CASE WHEN regexp_matches(file_name, 'chapter|lecture') THEN 0 WHEN contains(file_name, 'quiz') THEN 1 ELSE 2 END, file_name, file_id) AS id FROM files WHERE NOT made),
        k AS (SELECT course_id, id, CASE WHEN contains(file_name, 'quiz') THEN 'practice' ELSE 'read' END AS kind, CASE WHEN contains(file_name, 'quiz') THEN 35 ELSE 30 END AS estimated_minutes, file_id AS source_file_id FROM o WHERE id <= 8)
        SELECT * FROM k UNION ALL SELECT course_id, max(id) + 1, 'review', 30, '' FROM k GROUP BY 1""",
    "apply_changes": f"""WITH {_PLAN}, adds AS (SELECT course_id, status, row_number() OVER (PARTITION BY course_id ORDER BY id) AS n FROM plan WHERE id % 5 NOT IN (0, 1)), tops AS (SELECT course_id, max(id) AS top FROM plan GROUP BY 1),
        r AS (SELECT course_id, id, CASE WHEN id % 5 = 1 THEN 'done' ELSE status END AS status FROM plan WHERE id % 5 <> 0 UNION ALL SELECT course_id, top + n, status FROM adds JOIN tops USING (course_id))
        SELECT course_id, count(*) AS n, count(*) FILTER (WHERE status = 'done') AS done, max(id) AS top FROM r GROUP BY 1""",
    "retain_uploads": """WITH f AS (SELECT user_id, event_id::VARCHAR AS name, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY),
        r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, name) AS n FROM f) SELECT user_id AS course_id, name FROM r WHERE n <= 20""",
    "pair_turns": f"WITH {_TURNS} SELECT conv_id, turn, md5(u) AS user_digest, md5(a) AS assistant_digest FROM turns",
    "recent_turns": f"""WITH {_TURNS}, b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM turns)
        SELECT conv_id, count(*) AS n_turns, md5(string_agg('用户：' || u || CASE WHEN a <> '' THEN chr(10) || '助手：' || a ELSE '' END, '|' ORDER BY turn)) AS digest, true AS bounded FROM b WHERE back <= 3 GROUP BY 1""",
    "contextual_query": f"""WITH {_TURNS}, n AS (SELECT conv_id, least(count(*), 3) AS k FROM turns GROUP BY 1), q AS (SELECT DISTINCT conv_id FROM conversations WHERE lower(role) = 'user')
        SELECT conv_id AS query_id, conv_id % 3 = 0 AND k IS NOT NULL AS is_follow_up, CASE WHEN conv_id % 3 = 0 THEN '这个' ELSE '' END AS signals, CASE WHEN conv_id % 3 = 0 THEN coalesce(k, 0) ELSE 0 END AS context_turns_used, true AS bounded
        FROM q LEFT JOIN n USING (conv_id)""",
    "follow_up_signals": "SELECT conv_id, turn, '这个,第' || (conv_id % 9) || '问' AS signals FROM conversations",
    "conversation_stats": """SELECT conv_id, coalesce(arg_min(substr(trim(text, chr(10) || ' '), 1, 24), turn) FILTER (WHERE lower(role) = 'user'), '') AS title, count(*) AS message_count, max(turn) AS last_turn,
        count(*) FILTER (WHERE lower(role) = 'assistant' AND turn > 2) AS unread_count FROM conversations GROUP BY 1""",
    "memory_topics": """WITH q AS (SELECT conv_id % 20 AS conv_id, conv_id * 1000 + turn AS ord, text, list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda t: NOT regexp_full_match(t, '[0-9]+')) AS u FROM conversations WHERE lower(role) = 'user'),
        t AS (SELECT *, CASE WHEN len(u) > 0 THEN array_to_string(u[1:3], ' / ') ELSE substr(text, 1, 24) END AS topic FROM q),
        c AS (SELECT conv_id, topic, count(*) AS count, md5(substr(arg_max(text, ord), 1, 80)) AS digest, max(ord) AS last FROM t GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY count DESC, last DESC) AS rank FROM c) SELECT conv_id, topic, count, rank, digest FROM r WHERE rank <= 8""",
    "conversation_list": """WITH m AS (SELECT 'src' || (conv_id % 20) AS course_id, conv_id, lower(role) AS role, trim(text, chr(10) || ' ') AS said, conv_id * 7919 % 100003 + turn AS t FROM conversations),
        f AS (SELECT conv_id, min(t) AS first_at FROM m WHERE conv_id % 3 <> 0 GROUP BY 1),
        g AS (SELECT course_id, m.conv_id, coalesce(arg_min(substr(said, 1, 24), t) FILTER (WHERE role = 'user' AND said <> ''), '新对话') AS title, count(*) FILTER (WHERE role IN ('user', 'assistant')) AS message_count,
            count(*) FILTER (WHERE role = 'assistant' AND (first_at IS NULL OR t > first_at)) AS unread_count, max(t) AS last FROM m LEFT JOIN f USING (conv_id) GROUP BY 1, 2)
        SELECT course_id, conv_id, title, message_count, unread_count, row_number() OVER (PARTITION BY course_id ORDER BY last DESC, conv_id) AS position FROM g""",
    "query_intent": """WITH m AS (SELECT conv_id, turn, (conv_id + turn) % 6 AS k, regexp_replace(lower(text), 'current|latest|today|recent|search', '', 'g') AS t FROM conversations),
        q AS (SELECT conv_id, turn, k, CASE WHEN k = 2 THEN 'hello' WHEN k = 3 THEN '12' ELSE ['latest ', 'explain ', '', '', '', 'in 2024 '][k + 1] || t END AS q FROM m),
        i AS (SELECT conv_id, turn, CASE WHEN k = 3 OR regexp_replace(q, '[^0-9A-Za-zÀ-ɏ_]+', '', 'g') = '' THEN 'clarification' WHEN k = 2 THEN 'light_followup'
            WHEN k = 0 OR regexp_matches(q, '20[0-9][0-9]') THEN 'web_lookup' WHEN regexp_matches(q, 'what is|explain|summari[sz]e') THEN 'course_explain'
            WHEN conv_id % 2 <> 0 THEN 'general_question' ELSE 'course_question' END AS intent FROM q)
        SELECT conv_id, turn, intent, intent IN ('web_lookup', 'general_question') AS search FROM i""",
    "plan_action": """SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN 'clarify' WHEN turn > 4 THEN 'course_search' WHEN turn % 3 = 0 THEN 'final' ELSE 'course_search' END AS action FROM conversations""",
    "count_attempts": """WITH a AS (SELECT conv_id, count(*) FILTER (WHERE lower(role) = 'user' AND conv_id % 2 = 0 AND length('因为 ' || text) >= 12) AS attempts FROM conversations GROUP BY 1) SELECT conv_id, attempts, attempts >= 2 AS disclosure_allowed FROM a""",
    "grounded_answers": f"""WITH {_TOP2}, h AS (SELECT query_id, question, list(text ORDER BY rank) AS t, list(file_name ORDER BY rank) AS f FROM hits GROUP BY 1, 2)
        SELECT a.query_id, CASE WHEN t IS NULL THEN 'no_basis' ELSE 'template' END AS mode, md5(CASE WHEN t IS NULL THEN '未找到课程资料依据。' ELSE '问题“' || a.question || '”与资料《' || f[1] || '》中的内容最相关。' ||
            CASE WHEN length(t[1]) > 260 THEN substr(t[1], 1, 260) || '...' ELSE t[1] END || chr(10) || array_to_string(list_transform(range(1, len(t) + 1), lambda i: i || '. ' || substr(t[i], 1, 600)), chr(10)) END) AS digest, coalesce(len(t), 0) AS n_citations
        FROM asked a LEFT JOIN h USING (query_id)""",
    "label_citations": f"WITH {_CITED} SELECT answer_id, label, md5(quote) AS digest FROM labels",
    "check_claims": f"WITH {_CLAIMS} SELECT answer_id, 0 AS claim_ord, assertive, n AS token_count, round(o, 6)::DOUBLE AS max_overlap, reason IN ('ok', 'non_assertive') AS supported, reason FROM claims",
    "citation_report": f"""WITH {_CLAIMS} SELECT answer_id, reason IN ('ok', 'non_assertive') AS supported, 1 AS claim_count, assertive::BIGINT AS assertive_claim_count, (reason NOT IN ('ok', 'non_assertive'))::BIGINT AS unsupported_count,
        (reason = 'missing_citation')::BIGINT AS uncited_count FROM claims""",
    "annotate_unsupported": f"WITH {_CLAIMS} SELECT answer_id, reason NOT IN ('ok', 'non_assertive') AS marked FROM claims",
    "representative_chunks": f"WITH {_REPRESENTATIVE} SELECT course_id, position, chunk_index, variety, md5(keyword) AS keyword FROM rep",
    "summary_evidence": f"WITH {_REPRESENTATIVE} SELECT course_id, 'S' || position AS label, file_id, chunk_index, length(trim(text)) AS n_chars FROM rep",
    "group_evidence": f"""WITH {_REPRESENTATIVE}, g AS (SELECT course_id, file_id, min(position) AS first, string_agg('S' || position, ',' ORDER BY position) FILTER (WHERE k <= 5) AS labels
            FROM (SELECT *, row_number() OVER (PARTITION BY course_id, file_id ORDER BY position) AS k FROM rep) GROUP BY 1, 2)
        SELECT course_id, 'G' || row_number() OVER (PARTITION BY course_id ORDER BY first) AS group_id, file_id, labels FROM g""",
    "eval_cases": f"""WITH {_EVAL} SELECT case_id, quality, hit AS citation_hit, first_hit AS first_citation_hit, rate::DOUBLE AS term_rate, forb AS forbidden_pass, unsup AS unsupported_pass,
        hit AND quality <> 'none' AND rate >= 0.5 AND forb AND unsup AS passed FROM res""",
    "eval_summary": f"""WITH {_EVAL} SELECT count(*) AS cases, count(*) FILTER (WHERE hit AND quality <> 'none' AND rate >= 0.5 AND forb AND unsup) AS passed, round(avg(hit::INT), 4)::DOUBLE AS citation_hit_rate,
        round(avg(first_hit::INT), 4)::DOUBLE AS first_citation_hit_rate, round(avg(rate), 4)::DOUBLE AS term_rate, count(*) FILTER (WHERE quality = 'none') AS none, count(*) FILTER (WHERE quality = 'partial') AS partial,
        count(*) FILTER (WHERE quality = 'sufficient') AS sufficient, round(avg(top), 4)::DOUBLE AS mean_top_score FROM res""",
    "stage_summary": f"""WITH {_TELEMETRY} SELECT stage, count(*) FILTER (WHERE kind = 'event') AS events, count(*) FILTER (WHERE kind = 'span') AS spans, count(*) FILTER (WHERE kind = 'span' AND status = 'error') AS error_spans,
        count(*) FILTER (WHERE kind = 'span') AS durations, round(round(sum(duration_ms) FILTER (WHERE kind = 'span'), 3), 1) AS total_ms, round(min(duration_ms) FILTER (WHERE kind = 'span'), 3) AS min_ms,
        round(max(duration_ms) FILTER (WHERE kind = 'span'), 3) AS max_ms, round(round(avg(duration_ms) FILTER (WHERE kind = 'span'), 3), 2) AS avg_ms, coalesce(sum(value) FILTER (WHERE kind = 'counter'), 0) AS counted FROM telemetry GROUP BY 1""",
    "observation_summary": f"""WITH {_TELEMETRY}, v AS (SELECT stage, name, value, count(*) AS n FROM telemetry GROUP BY 1, 2, 3)
        SELECT stage, name, sum(n)::BIGINT AS count, min(value) AS min, max(value) AS max, round(sum(value * n) / sum(n), 3) AS avg, string_agg(value::BIGINT || ':' || n, ',' ORDER BY value) AS distribution FROM v GROUP BY 1, 2""",
    "observation_sketches": f"""WITH {_TELEMETRY} SELECT stage, name, count(*) AS n, min(duration_ms) AS low, max(duration_ms) AS high, round(round(sum(duration_ms) / count(*), 3), 2) AS avg, true AS ordered
        FROM telemetry WHERE duration_ms IS NOT NULL GROUP BY 1, 2""",
    "frequent_values": f"""WITH {_TELEMETRY}, v AS (SELECT stage, name, value, count(*) AS n FROM telemetry GROUP BY 1, 2, 3), t AS (SELECT stage, name, sum(n) AS all_n FROM v GROUP BY 1, 2)
        SELECT stage, name, value, n FROM v JOIN t USING (stage, name) WHERE n >= 0.12 * all_n""",
    "plan_changes": f"""WITH {_PLAN}, tops AS (SELECT course_id, max(id) AS top FROM plan GROUP BY 1),
        kept AS (SELECT course_id, id, CASE WHEN id % 4 = 0 THEN '未命名学习项' ELSE title END AS title, CASE WHEN id % 4 = 0 THEN 'read' ELSE kind END AS kind,
            CASE WHEN id % 12 = 0 THEN 'done' WHEN id % 6 = 0 THEN 'doing' WHEN id % 3 = 0 THEN 'done' ELSE status END AS status, CASE WHEN id % 4 = 0 THEN 240 ELSE estimated_minutes END AS estimated_minutes,
            CASE WHEN id % 12 = 0 THEN '2024-01-04' WHEN id % 6 = 0 THEN NULL WHEN id % 3 = 0 THEN '2024-01-01' WHEN id % 4 = 0 AND status = 'done' THEN '2024-01-02' END AS completed FROM plan WHERE id % 7 <> 0)
        SELECT * FROM kept UNION ALL
        SELECT course_id, top + row_number() OVER (PARTITION BY course_id ORDER BY id), 'new', 'read', 'todo', 5, NULL FROM plan JOIN tops USING (course_id) WHERE id % 10 = 0""",
    "counters": f"WITH {_TELEMETRY} SELECT stage, name, sum(value) AS value FROM telemetry WHERE kind = 'counter' GROUP BY 1, 2",
    "stage_windows": f"WITH {_TELEMETRY} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, stage, count(*) AS n, count(*) FILTER (WHERE status = 'error') AS errors FROM telemetry GROUP BY 1, 2",
    "chat_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, sum(starts) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2)
        SELECT user_id, count(*) AS sessions, max(n) AS longest, sum(n)::BIGINT AS events FROM c GROUP BY 1""",
    "record_results": """WITH p AS (SELECT event_id % 3 AS m, event_id % 7 AS files, event_id % 3 = 1 AS bad FROM events),
        r AS (SELECT 'event' AS kind, ['index', 'retrieval', 'llm'][m + 1] || '-result' AS name, m, NULL::DOUBLE AS v FROM p
            UNION ALL SELECT 'counter', unnest(['index_jobs_total', 'index_jobs_succeeded']), m, 1 FROM p WHERE m = 0
            UNION ALL SELECT 'counter', unnest(['retrieval_queries_total', 'retrieval_queries_with_evidence']), m, 1 FROM p WHERE m = 1
            UNION ALL SELECT 'counter', unnest(['llm_calls_total', 'llm_calls_succeeded']), m, 1 FROM p WHERE m = 2)
        SELECT kind, name, ['indexing', 'retrieval', 'llm'][m + 1] AS stage, count(*) AS n, sum(v) AS total FROM r GROUP BY ALL""",
    "normalize_results": """WITH p AS (SELECT event_id % 3 AS m, ['ok', 'error', 'degraded'][event_id % 3 + 1] AS status, event_id, value FROM events),
        r AS (SELECT 'index' AS kind, unnest(['files', 'chunks', 'failed']) AS name, unnest([event_id % 7, 0, 0])::DOUBLE AS v, status FROM p WHERE m = 0
            UNION ALL SELECT 'retrieval', unnest(['hits', 'top_score', 'coverage']), unnest([1, value, 0])::DOUBLE, status FROM p WHERE m = 1
            UNION ALL SELECT 'llm', unnest(['tokens', 'latency_ms', 'retries']), unnest([event_id % 5 + 2, 0, 0])::DOUBLE, status FROM p WHERE m = 2)
        SELECT kind, name, status, count(*) AS n, round(sum(v), 2) AS total FROM r GROUP BY 1, 2, 3""",
    "summarize_checks": """WITH c AS (SELECT event_type AS section, 'c' || (user_id % 4) AS "check", value < 90 AS passed FROM events)
        SELECT section, "check", count(*) AS total, count(*) FILTER (WHERE NOT passed) AS failed, round(count(*) FILTER (WHERE passed) / count(*)::DOUBLE, 4) AS pass_rate, count(*) FILTER (WHERE NOT passed) = 0 AS gate FROM c GROUP BY ROLLUP (section, "check")""",
    "source_quality": f"WITH {_WEB} SELECT ord, source_quality::DOUBLE AS source_quality FROM scored",
    "source_relevance": f"WITH {_WEB} SELECT ord, relevance::DOUBLE AS relevance FROM scored",
    "normalize_sources": f"""WITH {_WEB}, f AS (SELECT *, row_number() OVER (PARTITION BY query_id, url ORDER BY ord) AS k FROM scored), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY source_quality DESC, score DESC, length(substr(snippet, 1, 360)) DESC, ord) AS position
            FROM f WHERE k = 1 AND relevance >= 0.34)
        SELECT query_id, position, 'web-' || substr(sha1(url), 1, 16) AS file_id, url, round(score, 3)::DOUBLE AS score, source_quality::DOUBLE AS source_quality, md5(substr(snippet, 1, 360)) AS digest FROM r WHERE position <= 10""",
    "parse_search_results": f"WITH {_WEB} SELECT ord AS query_id, 0 AS ord, url, 't' || ord AS title, md5(snippet) AS snippet FROM cand",
    "cosine_similarity": "SELECT a.vec_id AS doc_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "unit_vector": "SELECT vec_id AS doc_id, 1.0::DOUBLE AS norm, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS first FROM embeddings",
    "vector_search": """WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) SELECT query_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5""",
    "upsert_vectors": "SELECT vec_id AS doc_id, vec_id AS ord, CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END AS version, round(CASE WHEN vec_id % 3 = 0 THEN -embedding[1]::DOUBLE ELSE embedding[1]::DOUBLE END, 6) AS first FROM embeddings",
    "embed_with": "SELECT doc_id, 1.0::DOUBLE AS norm FROM documents",
    "build_vector_index": f"WITH {I.CHUNKS_SQL} SELECT file_id || '-text-' || chunk_index AS doc_id, length(text) AS n_chars, course_id FROM chunks",
    "hybrid_merge": """WITH v AS (SELECT vec_id % 10 AS query_id, vec_id::VARCHAR AS id, vec_id // 10 + 1 AS rank, embedding[1]::DOUBLE AS score FROM embeddings),
        b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS by_value FROM v),
        f AS (SELECT *, 1.0::DOUBLE / (60 + rank) + 1.0::DOUBLE / (60 + by_value) AS s FROM b),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, round(score, 9) DESC, id) AS k FROM f)
        SELECT query_id, id, k AS rank, 'hybrid' AS retrieval_method, round(s, 6)::DOUBLE AS score FROM r WHERE k <= 12""",
}

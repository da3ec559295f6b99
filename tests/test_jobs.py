import json
import os

from pyspark.sql import functions as F

import __spark_entry__
from lectern.operators import dashboard, evaluation, lexical, mastery, summaries, vector
from lectern.sources import store
from lectern.streaming import jobs

SF = "/root/testdata/sf0.001"


def pages(spark, rows):
    return spark.createDataFrame(rows, "course_id string, file_id string, file_name string, path string, file_ord string, page int, page_seq int, text string")


def test_every_query_has_a_callable_and_oracles_name_queries():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and all(callable(q) for q in queries.values()) and len(queries) > 90


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_search_stays_in_its_course(spark):
    chunks = store.chunking.build_chunks(
        pages(spark, [("a", "f1", "stack.md", "a/stack.md", "1", None, 0, "a stack is lifo " * 3), ("b", "f2", "tree.md", "b/tree.md", "1", None, 0, "a stack tree")])
    )
    asked = spark.createDataFrame([(1, "b", "stack lifo"), (2, "c", "stack")], "query_id int, course_id string, question string")
    hits = lexical.lexical_search(asked, chunks, 2).collect()
    assert [(h.query_id, h.file_id) for h in hits] == [(1, "f2")]


def test_fold_of_a_cut_log_is_the_fold_of_the_whole(spark):
    rows = [(1, "p", i, i % 3 != 0, ("easy", "normal", "hard")[i % 3], i / 10 if i % 4 else None) for i in range(12)]
    events = spark.createDataFrame(rows, "course_id int, point_id string, event_id int, correct boolean, difficulty string, confidence double")
    events = events.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("event_id")))
    whole = mastery.fold_answers(events)
    first = mastery.fold_answers(events.filter("event_id < 5"))
    then = mastery.fold_answers(events.filter("event_id >= 5"), first)
    assert whole.collect() == then.collect()
    score, streak = 50, 0
    for _, _, _, correct, difficulty, confidence in rows:
        score = min(max(score + jobs.fold_delta(correct, difficulty, float("nan") if confidence is None else confidence, score, streak), 0), 100)
        streak = streak + 1 if correct else 0
    assert whole.first().score == score


def test_bad_mastery_state_gets_defaults(spark):
    state = json.dumps({"knowledge_points": [{"title": "T"}], "mastery": {"p": {"score": "bad", "attempts": -3}}, "mistakes": [{"point_id": "p", "question": "q", "status": "odd"}]})
    points, records, wrong = mastery.normalize_mastery(spark.createDataFrame([("c", state), ("d", "{"), ("e", None)], "course_id string, state string"))
    assert records.select("score", "attempts", "level").collect() == [(50, 0, "building")]
    assert points.first().point_id.startswith("kp-") and wrong.first().status == "open"


def test_rerank_hook_keeps_order_when_the_scorer_fails(spark):
    rows = spark.createDataFrame([(1, "q", i, f"t{i}") for i in range(3)], "query_id int, question string, ordinal int, rerank_text string")

    def broken(question, texts):
        raise RuntimeError

    same = lexical.rerank_hook(rows, broken, 3).orderBy("rank").collect()
    assert [r.ordinal for r in same] == [0, 1, 2]
    turned = lexical.rerank_hook(rows, lambda q, t: range(len(t)), 3).orderBy("rank").collect()
    assert [r.ordinal for r in turned] == [2, 1, 0]


def test_vectors(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, ""), (3, "栈 队列")], "id int, text string")
    first = {r.id: r.vector for r in vector.hash_embed(rows, ["id"]).collect()}
    assert first == {r.id: r.vector for r in vector.hash_embed(rows.repartition(3), ["id"]).collect()}
    assert not any(first[2]) and abs(sum(x * x for x in first[3]) - 1) < 1e-9


def test_chunk_index_upsert_replaces_the_same_page(spark, tmp_path):
    path = str(tmp_path / "index")
    base = [("a", "f", "f.md", "a/f.md", "1", None, 0, "old words here"), ("b", "g", "g.md", "b/g.md", "1", 1, 0, "other")]
    store.write_chunk_index(store.chunking.build_chunks(pages(spark, base)), path)
    store.upsert_chunks(spark, path, pages(spark, [("a", "f", "f.md", "a/f.md", "1", None, 0, "new words")]))
    out = {(r.course_id, r.text) for r in store.read_chunk_index(spark, path).collect()}
    assert out == {("a", "new words"), ("b", "other")}


def test_catalog_and_stream_ingest(spark, tmp_path):
    root = tmp_path / "courses"
    for name, text in {"c1/week 1/a.md": "# T\nhello stack", "c1/.hidden/x.md": "no", "c1/v.mp4": "no", "top.md": "no", "c2/b.TXT": "queue"}.items():
        file = root / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
    found = store.scan_catalog(spark, str(root)).collect()
    assert {(r.course, r.file_name) for r in found} == {("c1", "a.md"), ("c2", "b.TXT")}
    text = {r.file_name: r.text for r in store.read_text_pages(spark, str(root)).collect()}
    assert "hello stack" in text["a.md"]
    index = str(tmp_path / "index")
    jobs.stream_ingest(spark, str(root / "c1" / "week 1"), index, str(tmp_path / "ck1")).awaitTermination(60)
    query = jobs.stream_ingest(spark, str(root), index, str(tmp_path / "ck2"))
    query.awaitTermination(90)
    assert query.exception() is None
    assert {r.course_id for r in store.read_chunk_index(spark, index).collect()} >= {"c1", "c2"}


def test_evaluation_inputs(spark, tmp_path):
    path = str(tmp_path / "cases.json")
    with open(path, "w") as f:
        json.dump({"cases": [{"question": "What?", "expected_reference_files": "a.md", "expected_answer_terms": ["X"]}]}, f)
    case = store.read_eval_cases(spark, path).first()
    assert case.case_id == "What?" and case.expected_files == ["a.md"] and case.expected_terms == ["X"] and case.max_unsupported_claims is None
    rows = spark.createDataFrame([("s", "c", True), ("s", "c", False)], "section string, check string, passed boolean")
    assert evaluation.summarize_checks(rows).filter("section is null").first().pass_rate == 0.5


def test_summary_states(spark):
    groups = spark.createDataFrame([("a", "G1", "f", "", ["S1"], ["text"])], "course_id string, group_id string, file_id string, section_title string, labels array<string>, texts array<string>")
    courses = spark.createDataFrame([("a",), ("b",)], "course_id string")
    used = {r.course_id: r.status for r in summaries.map_reduce_summary(groups, courses, lambda p: p[:3]).collect()}
    assert used == {"a": "used", "b": "empty"}
    assert summaries.map_reduce_summary(groups, courses, None).first().status == "disabled"
    assert {r.status for r in summaries.map_reduce_summary(groups, courses, lambda p: "").collect()} == {"failed", "empty"}


def test_changes_and_plan(spark):
    rows = spark.createDataFrame([("c", 1, "a", "todo"), ("c", 2, "b", "done")], "course_id string, id long, title string, status string")
    changes = spark.createDataFrame([("c", 1, "update", 1, None, "done"), ("c", 2, "delete", 2, None, None), ("c", None, "add", 3, "n", "todo"), ("c", 9, "update", 4, "x", None)], "course_id string, id long, op string, seq int, title string, status string")
    out, unknown = dashboard.apply_changes(rows, changes, ["title", "status"])
    assert {(r.id, r.title, r.status) for r in out.collect()} == {(1, "a", "done"), (3, "n", "todo")} and unknown.first().id == 9


def test_stream_memory_equals_the_batch_fold(spark, tmp_path):
    from lectern.operators.conversations import memory_topics_folded

    rows = [(1, i, q) for i, q in enumerate(["page table", "stack", "page table", "what"])]
    batch = spark.createDataFrame(rows, "conv_id int, ord int, question string")
    batch.write.parquet(os.path.join(tmp_path, "in"))
    stream = spark.readStream.schema(batch.schema).parquet(os.path.join(tmp_path, "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    query = jobs.stream_memory_topics(stream).writeStream.format("memory").queryName("memory_out").outputMode("update").option("checkpointLocation", os.path.join(tmp_path, "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    assert sorted(map(tuple, spark.table("memory_out").collect())) == sorted(map(tuple, memory_topics_folded(batch).collect()))


def test_postings_are_counted_where_their_chunk_stands(spark):
    rows = [("a", 1, "f1.md", "a/f1.md", "", "stack stack queue"), ("a", 2, "f2.md", "a/f2.md", "Stack", ""), ("b", 1, None, None, None, None)]
    chunks = spark.createDataFrame(rows, "course_id string, chunk_index long, file_name string, path string, section_title string, text string")
    postings = lexical.build_postings(chunks)
    assert "Exchange" not in postings._jdf.queryExecution().executedPlan().toString()
    found = {(r.course_id, r.chunk_index, r.token): (r.tf, r.dl) for r in postings.collect()}
    assert found == {
        ("a", 1, "stack"): (2, 8), ("a", 1, "queue"): (1, 8), ("a", 1, "f1"): (2, 8), ("a", 1, "md"): (2, 8), ("a", 1, "a"): (1, 8),
        ("a", 2, "stack"): (1, 6), ("a", 2, "f2"): (2, 6), ("a", 2, "md"): (2, 6), ("a", 2, "a"): (1, 6),
    }


def test_an_index_is_built_once_for_the_summaries_of_its_groups(spark, monkeypatch):
    from lectern.plans import retrieval

    built = []
    chunks = retrieval.chunks
    monkeypatch.setattr(retrieval, "chunks", lambda *args: built.append(1) or chunks(*args))
    assert __spark_entry__.queries()["map_reduce_summary"](spark, SF).count() > 0 and len(built) == 1


def test_hits_are_found_once_for_their_rerank_scores(spark):
    plan = __spark_entry__.queries()["apply_rerank_scores"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "qtf" not in plan and "idf" not in plan and plan.count("Window") == 1

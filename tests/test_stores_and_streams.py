"""Round trips of the stores, streams against their batch twins, and plain searches against the retrieval plans."""

import hashlib
import io
import json
import math
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import text as X
from lectern.operators import answers, chunking, evaluation, lexical, mastery, summaries, vector
from lectern.sources import store
from lectern.streaming import jobs

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def pages(spark, rows):
    return spark.createDataFrame(rows, "course_id string, file_id string, file_name string, path string, file_ord string, page int, page_seq int, text string")


def drained(frame, tmp_path, mode):
    frame.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    name = "out_" + os.path.basename(tmp_path).replace("-", "_")
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", os.path.join(tmp_path, "ck")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None
    return frame.sparkSession.table(name).collect()


def test_lexical_tokens_of_any_text(spark):
    import re

    rnd = random.Random(1)
    texts = ["".join(rnd.choice(["a", "B", "_", "9", " ", "-", "栈", "队列", "K", "İ", "\n"]) for _ in range(rnd.randint(0, 24))) for _ in range(300)]

    def tokens(text):
        out = []
        for run in re.findall("[A-Za-z0-9_]+|[一-鿿]+", text):
            if run[0] < "\x80":
                out.append(run.lower())
                continue
            out += [run] if len(run) <= 8 else []
            out += [run] if len(run) == 1 else [run[i : i + n] for n in (2, 3) for i in range(len(run) - n + 1)]
        return out

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    assert {r.id: r.t for r in rows.select("id", X.tokenize_lexical(F.col("text")).alias("t")).collect()} == {i: tokens(t) for i, t in enumerate(texts)}


def test_a_course_that_is_left_without_chunks_leaves_the_index(spark, tmp_path):
    path = str(tmp_path / "index")
    one = ("a b", "f", "f.md", "a/f.md", "1", None, 0, "old words here")
    store.write_chunk_index(chunking.build_chunks(pages(spark, [one, ("c", "g", "g.md", "c/g.md", "1", None, 0, "stays")])), path)
    store.upsert_chunks(spark, path, pages(spark, [(*one[:7], "  \n ")]))
    assert [(r.course_id, r.text) for r in store.read_chunk_index(spark, path).collect()] == [("c", "stays")]


def test_vector_index_round_trip(spark, tmp_path):
    path = str(tmp_path / "vectors")
    chunks = chunking.build_chunks(pages(spark, [("a", "f", "f.md", "a/f.md", "1", None, 0, "stack and queue")]))
    index = vector.build_vector_index(chunks, 16)
    mark = spark.range(1).select(store.fingerprint(F.lit("p"), F.lit("u"), F.lit("m")).alias("x")).first().x
    assert mark == "sha256:" + hashlib.sha256(b"p\nu\nm").hexdigest()[:16]
    store.write_vector_index(index, path, "hash", 16, mark)
    (row,) = store.read_vector_index(spark, path, "hash", 16, mark, chunks=1).collect()
    assert row.doc_id == "f-text-1" and row.vector == index.first().vector and row.metadata["course_id"] == "a"
    for wrong in (("hash", 24, mark, None), ("other", 16, mark, None), ("hash", 16, "sha256:0", None), ("hash", 16, mark, 2)):
        with pytest.raises(ValueError):
            store.read_vector_index(spark, path, *wrong)


def test_docx_pages(spark):
    word = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = f'<w:document xmlns:w="{word}"><w:body><w:p><w:r><w:t>one</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>three</w:t><w:br/><w:t>four</w:t></w:r></w:p></w:body></w:document>'
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", body)
    files = spark.createDataFrame([("a.docx", bytearray(raw.getvalue())), ("b.docx", bytearray(b"no zip")), ("c.PNG", bytearray(b""))], "path string, content binary")
    out = {r.path: r.text for r in store.extract_docx_pages(files).collect()}
    assert out["a.docx"] == "one\ttwo\nthree\nfour" and "解析失败" in out["b.docx"] and "OCR" in out["c.PNG"]


def test_state_files(spark, tmp_path):
    item = T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType())])
    for name, text in {"list": json.dumps([{"id": "a", "text": "x"}]), "object": json.dumps({"chunks": [{"id": "b"}, {"text": "no id"}]}), "broken": "{"}.items():
        (tmp_path / f"{name}.json").write_text(text)
    read = lambda name: [(r.id, r.text) for r in store.read_state_json(spark, str(tmp_path / f"{name}.json"), item).collect()]
    assert read("list") == [("a", "x")] and read("object") == [("b", None)] and read("broken") == read("missing") == []


def test_manifest_and_safe_paths(spark, tmp_path):
    for name, text in {"course_memory/c/notes.json": "{}", "indexes/c.json": '{"schema_version": 3}', "config.example.json": "{}", "other/x.txt": "no"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    out = {r.path: (r.kind, r.index_version, r.sha256) for r in store.file_manifest(spark, str(tmp_path)).collect()}
    assert {k: v[0] for k, v in out.items()} == {"course_memory/c/notes.json": "memory", "indexes/c.json": "index", "config.example.json": "config"}
    assert out["indexes/c.json"][1] == 3 and out["config.example.json"][2] == hashlib.sha256(b"{}").hexdigest()
    paths = {"a/b": True, "/a": False, "a/../b": False, "./a": False, "a//b": False, "a\\b": False, "": False, "a..b/c": True}
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", store.safe_path(F.col("p")).alias("ok"))
    assert {r.p: r.ok for r in rows.collect()} == paths


def _answers(spark, n=60):
    rnd = random.Random(6)
    rows = [(f"c{i % 2}", f"p{i % 3}", i, 1_700_000_000 + 37 * i, rnd.random() < 0.6, rnd.choice(["easy", "normal", "hard"]), rnd.random()) for i in range(n)]
    return spark.createDataFrame(rows, "course_id string, point_id string, event_id long, s long, correct boolean, difficulty string, confidence double").withColumn("ts", F.timestamp_seconds("s")).drop("s")


def test_stream_mastery_equals_the_batch_fold(spark, tmp_path):
    events = _answers(spark)
    later = spark.createDataFrame([("zz", "z", 999, 1_800_000_000, True, "easy", 0.5)], "course_id string, point_id string, event_id long, s long, correct boolean, difficulty string, confidence double")
    folder = os.path.join(tmp_path, "in")
    for part in (events.filter("event_id % 2 = 0"), events.filter("event_id % 2 = 1"), later.withColumn("ts", F.timestamp_seconds("s")).drop("s")):
        part.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    last = {}
    for r in drained(jobs.stream_mastery(stream, "2 hours"), str(tmp_path), "append"):
        key = (r.course_id, r.point_id)
        last[key] = max(last.get(key, (0,)), (r.attempts, r.score, r.correct_count, r.wrong_count, r.streak, r.late))
    batch = {(r.course_id, r.point_id): (r.attempts, r.score, r.correct_count, r.wrong_count, r.streak, 0) for r in mastery.fold_answers(events).collect()}
    assert batch == {k: v for k, v in last.items() if k[0] != "zz"}


def test_stream_counters_equal_the_batch_counts(spark, tmp_path):
    rows = _answers(spark).select("ts", F.col("point_id").alias("stage"), F.when(F.col("correct"), "ok").otherwise("error").alias("status"))
    rows.coalesce(1).write.parquet(os.path.join(tmp_path, "in"))
    stream = spark.readStream.schema(rows.schema).parquet(os.path.join(tmp_path, "in")).withWatermark("ts", "1 minute")
    found = {(r.window_start, r.stage): (r.n, r.errors) for r in drained(jobs.stage_counters(stream, "10 minutes"), str(tmp_path), "update")}
    assert found == {(r.window_start, r.stage): (r.n, r.errors) for r in jobs.stage_counters(rows, "10 minutes").collect()}


def test_the_fold_in_order_equals_the_columns(spark):
    rnd = random.Random(8)
    rows = [(i, rnd.random() < 0.5, rnd.choice(["easy", "normal", "hard", None]), rnd.choice([None, -1.0, 0.3, 0.5, 2.0]), rnd.randrange(101), rnd.randrange(-1, 6)) for i in range(400)]
    table = spark.createDataFrame(rows, "id int, correct boolean, difficulty string, confidence double, score int, streak int")
    delta = mastery.score_delta(F.col("correct"), F.col("difficulty"), F.col("confidence"), F.col("score"), F.col("streak"))
    got = {r.id: r.d for r in table.select("id", delta.alias("d")).collect()}
    assert got == {i: mastery.fold_delta(*rest) for i, *rest in rows}


def test_large_and_null_keys_of_the_fold(spark):
    rows = [(None, "p", 1, True), (2**53 + 1, "p", 2, True), (2**53, None, 3, False), (2**53 + 1, "p", 4, None)]
    events = spark.createDataFrame(rows, "course_id long, point_id string, event_id long, correct boolean").withColumns({"ts": F.timestamp_seconds("event_id"), "difficulty": F.lit("easy"), "confidence": F.lit(None).cast("double")})
    out = {(r.course_id, r.point_id): (r.attempts, r.last_result) for r in mastery.fold_answers(events).collect()}
    assert out == {(None, "p"): (1, "correct"), (2**53 + 1, "p"): (2, "wrong"), (2**53, None): (1, "wrong")}
    assert mastery.fold_answers(events.limit(0)).count() == 0


def test_vector_search_in_blocks_equals_a_search_of_all(spark):
    rnd = random.Random(5)
    docs = [(f"d{i}", i % 3 if i % 7 else None, i, [float(rnd.randrange(-2, 3)) for _ in range(4)]) for i in range(300)]
    index = spark.createDataFrame(docs, "doc_id string, course_id int, ord int, vector array<double>")
    asked = [(2**53 + i, i % 4, [float(rnd.randrange(-2, 3)) for _ in range(4)]) for i in range(40)]
    queries = spark.createDataFrame(asked, "query_id long, course_id int, vector array<double>")

    def cosine(a, b):
        norm = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return round(sum(x * y for x, y in zip(a, b)) / norm, 9) if norm else 0.0

    for least in (None, 0.5):
        out = {}
        for r in vector.vector_search(queries, index, 5, least, block=16).collect():
            out.setdefault(r.query_id, []).append((r["rank"], r.doc_id))
        for q, course, v in asked:
            best = sorted((-cosine(v, w), o, d) for d, c, o, w in docs if c == course)
            best = [d for s, _, d in best if least is None or -s >= least - 1e-9][:5]
            assert [d for _, d in sorted(out.get(q, []))] == best
    assert vector.vector_search(queries, index, 0).count() == 0 == vector.vector_search(queries.limit(0), index).count()


def test_diverse_choice_equals_the_greedy_rule(spark):
    rnd = random.Random(12)
    rows = [(q, i, rnd.choice(["f", "g", None]), [rnd.choice("abcdef") for _ in range(rnd.randint(0, 4))], rnd.choice([0.5, 0.25, 0.125]), rnd.choice([0.1, 0.2])) for q in range(8) for i in range(rnd.randint(1, 9))]
    table = spark.createDataFrame(rows, "query_id int, ordinal int, file_id string, tokens array<string>, rrf_score double, rerank_score double")
    got = {}
    for r in lexical.select_diverse(table, 4).collect():
        got.setdefault(r.query_id, []).append((r.picked, r.ordinal))
    for q in range(8):
        own = [r for r in rows if r[0] == q]
        top, chosen = max(r[4] for r in own), []
        while len(chosen) < min(4, len(own)):
            def value(r):
                like = max((len(set(r[3]) & set(c[3])) / len(set(r[3]) | set(c[3])) if set(r[3]) | set(c[3]) else 0.0 for c in chosen), default=0.0)
                return 0.56 * r[4] / top + 0.28 * r[5] - 0.22 * like + (0.12 if chosen and all(r[2] != c[2] for c in chosen) else 0.0)

            rest = [r for r in own if r not in chosen]
            most = max(map(value, rest))
            chosen.append(next(r for r in rest if value(r) > most - 1e-12))
        assert [o for _, o in sorted(got[q])] == [c[1] for c in chosen]


def test_representative_chunks_rank_thin_rows(spark):
    rows = [("a", 1, "f", ["x", "yy", "zz"], "yy zz"), ("a", 2, "f", ["yy"], "yy"), ("a", 3, "g", ["yy", "zz", "ww"], "yy zz ww"), ("b", 1, "h", [], "")]
    chunks = spark.createDataFrame(rows, "course_id string, chunk_index int, file_id string, tokens array<string>, text string")
    out = summaries.representative_chunks(chunks, 2).collect()
    assert sorted((r.course_id, r.position, r.chunk_index, r.text) for r in out) == [("a", 1, 3, "yy zz ww"), ("a", 2, 1, "yy zz"), ("b", 1, 1, "")]


def test_prompts_and_extracts(spark):
    queries = spark.createDataFrame([(1, "why?"), (2, "how?")], "query_id int, question string")
    evidence = spark.createDataFrame([(1, 2, "course", "L2", "second"), (1, 1, "web", "W1", "first")], "query_id int, ord int, source_type string, label string, quote string")
    history = spark.createDataFrame([(1, t, "user", f"said  {t} " + "x" * 400) for t in range(8)], "query_id int, turn int, role string, content string")
    memory = spark.createDataFrame([(1, "b"), (1, "a")], "query_id int, topic string")
    out = {r.query_id: r.prompt for r in answers.build_prompts(queries, evidence, history, memory, "{policy}|{memory}|{history}|{evidence}|{question}").collect()}
    policy, topics, said, cited, question = out[1].split("|")
    assert topics == "a；b" and cited == "[W1] first\n[L2] second" and question == "why?" and policy != out[2].split("|")[0]
    lines = said.split("\n")
    assert len(lines) == 6 and lines[0].startswith("user: said 2 x") and all(len(x) == len("user: ") + 320 for x in lines)
    chunks = spark.createDataFrame([("c", 2, "g.md", "queue text. more"), ("c", 1, "f.md", "stack text. more")], "course_id string, position int, file_name string, text string")
    (summary,), (quiz,) = summaries.extractive_summary(chunks).collect(), summaries.extractive_quiz(chunks).collect()
    assert summary.content.index("f.md") < summary.content.index("g.md") and summary.content.count("\n- ") == 3 and "f.md" in quiz.content

"""The pass over all chunks for one batch of questions against scores of all pairs, on odd texts."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import batch, lexical, vector

WORDS = ["de", "aa", "aaa", "banana", "ana", "the", "a", "x9", "12", "2024", "stack", "internationalisation", "internationally", "queue_item", "Straße", "İstanbul", "Kelvin"]
ODD = ["队列", "后进先出", "缓存页表", "栈", "tlb页", "\U0001f600\U0001f600", "什么", "程" * 9]
GAPS = [" ", "  ", "\t", "\n", "\xa0", "　", "\x1c", "\x0b", " ", "", "-"]
CHUNK = "course_id int, chunk_index int, file_name string, path string, section_title string, material_type string, text string"


@pytest.fixture(scope="module")
def odd(spark):
    rnd = random.Random(4)

    def text(words, n):
        return "".join(rnd.choice(words) + rnd.choice(GAPS) for _ in range(n))

    rows = []
    for i in range(240):
        words = WORDS + ODD * (i % 4 == 0)
        name = rnd.choice(["", None, f"{text(WORDS, 2)}.md", "quiz.md"])
        rows.append((i % 3 or None, i, name, rnd.choice(["c/quiz.md", None]), rnd.choice(["", "Title aa", None]), rnd.choice(["notes", None]), rnd.choice(["", None, "copy of the banana", *[text(words, rnd.choice([1, 4, 40]))] * 9])))
    asked = [(i, i % 4, text(WORDS + ODD * (i % 2), rnd.randint(1, 6))) for i in range(40)]
    asked += [(50, 1, "缓存页表 后进先出 lifo"), (51, 2, "banana banana ana quiz notes"), (52, None, "stack"), (53, 9, "stack")]
    queries = lexical.prepare_queries(spark.createDataFrame(asked, "query_id long, course_id int, question string"))
    return spark.createDataFrame(rows, CHUNK).cache(), queries.cache()


def ranks(scored, limit):
    return {(r.query_id, r.course_id, r["rank"], r.chunk_index, round(r.score, 8)) for r in lexical.ranked(scored, limit).collect()}


@pytest.fixture(params=[2_000_000, 1])
def found(odd, monkeypatch, request):
    monkeypatch.setattr(batch, "CELLS", request.param)
    chunks, queries = odd
    return lambda limit: batch.best_chunks(("bm25", "phrase", "metadata", "semantic"), queries, chunks.repartition(3), limit).cache()


def test_each_leg_equals_all_pairs(odd, found):
    chunks, queries = odd
    pairs = lexical.leg_scores(chunks.join(queries, "course_id"))
    got = found(7)
    for leg in ("phrase", "metadata", "semantic"):
        plain = pairs.select("query_id", "course_id", "chunk_index", F.col(f"{leg}_score").cast("double").alias("score"))
        own = ranks(got.filter(F.col("leg") == leg), 7)
        assert own == ranks(plain, 7) and len(own) > 40, leg
    own = ranks(got.filter("leg = 'bm25'"), 7)
    assert own == ranks(lexical.bm25_scores(queries, lexical.build_postings(chunks), lexical.corpus_stats(chunks)), 7) and len(own) > 40


def test_tokens_and_features_are_those_of_the_columns(odd):
    chunks, _ = odd
    low = F.lower(lexical.search_text())
    rows = chunks.select(lexical.search_text().alias("raw"), low.alias("low"), X.tokenize_lexical(lexical.search_text()).alias("t"), X.tokenize_lexical(low).alias("u"), X.semantic_features(low).alias("f"))
    for r in rows.collect():
        assert sorted(batch.raw_tokens(r.raw)) == sorted(r.t)
        own = batch.tokens_of(batch._RUN.findall(r.low), r.low)
        assert sorted(own) == sorted(r.u) and batch.features_of(own, r.low) == set(r.f)


def test_a_task_gives_few_rows_and_ties_go_by_chunk(spark):
    chunks = spark.range(1, 3001, 1, 2).select(F.lit("c").alias("course_id"), F.col("id").alias("chunk_index"), F.lit("").alias("file_name"), F.lit("").alias("path"), F.lit("").alias("section_title"), F.lit("").alias("material_type"), F.concat(F.lit("a stack "), F.col("id") % 3).alias("text"))
    queries = lexical.prepare_queries(spark.createDataFrame([(1, "c", "stack")], "query_id int, course_id string, question string"))
    found = batch.best_chunks(["semantic"], queries, chunks, 4)
    assert found.count() <= 2 * 4 * 3
    assert [r.chunk_index for r in lexical.ranked(found.drop("leg"), 4).orderBy("rank").collect()] == [1, 2, 3, 4]
    plan = lexical.leg_rank("semantic", queries, chunks, 4)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan


def test_questions_of_too_many_terms_are_scored_as_before(odd, monkeypatch):
    chunks, queries = odd
    own = {tuple(r) for r in lexical.leg_rank("semantic", queries, chunks, 5).select("query_id", "rank", "chunk_index").collect()}
    monkeypatch.setattr(batch, "ASKED_TERMS", 3)
    assert batch.best_chunks(["semantic"], queries, chunks, 5) is None
    assert own == {tuple(r) for r in lexical.leg_rank("semantic", queries, chunks, 5).select("query_id", "rank", "chunk_index").collect()} and len(own) > 40


@pytest.mark.parametrize("least", [None, 0.2])
def test_a_search_of_few_vectors_equals_the_search_in_blocks(spark, least):
    rnd = random.Random(2)
    some = [[rnd.choice([-1.0, 0.0, 1.0]) for _ in range(4)] for _ in range(12)] + [[0.0] * 4]
    index = spark.createDataFrame([(f"d{i}", f"c{i % 3}", i, rnd.choice(some)) for i in range(400)], "doc_id string, course_id string, ord long, vector array<double>").repartition(3)
    queries = spark.createDataFrame([(2**53 + 2 * i + 1, f"c{i % 4}", some[i]) for i in range(13)] + [(7, None, some[0])], "query_id long, course_id string, vector array<double>")
    read = spark.sparkContext.accumulator(0)

    def seen(n):
        read.add(1)
        return n

    once = index.withColumn("ord", F.udf(seen, "long").asNondeterministic()("ord"))
    got = {(r.query_id, r["rank"], r.doc_id, r.ord, round(r.score, 9)) for r in vector.search_few(queries, once, 5, least).collect()}
    assert read.value == 400 and len(got) > 30
    assert got == {(r.query_id, r["rank"], r.doc_id, r.ord, round(r.score, 9)) for r in vector.vector_search(queries, index, 5, least, block=64).collect()}


def test_a_search_of_many_vectors_goes_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector, "FEW_BYTES", 8)
    queries = spark.createDataFrame([(1, "c", [1.0, 0.0])], "query_id int, course_id string, vector array<double>")
    assert vector.search_few(queries, queries.select(F.col("query_id").alias("doc_id"), "course_id", F.lit(1).alias("ord"), "vector"), 5) is None


def test_vectors_of_texts_without_tokens_and_null_ids(spark):
    rows = spark.createDataFrame([(2**53 + 1, "alpha beta alpha"), (None, ""), (3, None), (4, "栈 x 队")], "id long, text string")
    got = {r.id: r.vector for r in vector.hash_embed(rows, ["id"], dims=8).collect()}
    assert set(got) == {2**53 + 1, None, 3, 4} and got[None] == got[3] == [0.0] * 8
    v = [0.0] * 8
    for token in ("alpha", "beta", "alpha"):
        at, sign = vector.token_hash(token)
        v[at % 8] += sign
    norm = sum(x * x for x in v) ** 0.5
    assert got[2**53 + 1] == pytest.approx([x / norm for x in v])

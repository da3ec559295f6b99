"""Search from indexes with block maxima against scores of all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import chunking, impact, lexical, vector
from lectern.sources.scratch import materialise

PAGE = "course_id string, file_id string, file_name string, path string, file_ord string, page int, page_seq int, text string"
WORDS = ["stack", "heap", "tree", "of", "the", "page", "other", "队列", "栈", "后进先出", "tlb", "页表"]


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(9)
    rows = []
    for i in range(60):
        name = f"{rnd.choice(WORDS[:6])}{i}.md"
        own = " ".join(rnd.choice(WORDS if i % 5 else WORDS[:4]) + rnd.choice(["", "x"]) for _ in range(rnd.choice([3, 30, 200])))
        rows.append((f"c{i % 3}", f"f{i}", name, f"c/{rnd.choice(WORDS)}/{name}", f"{i:03}", None, 0, own))
    rows.append(("c0", "gen", "练习题-20260101-000000.md", "c/g.md", "999", None, 0, "stack heap tree of the page"))
    chunks = chunking.build_chunks(spark.createDataFrame(rows, PAGE)).cache()
    asked = [(i, f"c{i % 4}", " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 5)))) for i in range(30)]
    asked += [(40, "c0", "缓存页表 后进先出"), (41, "c0", ""), (42, "c1", "stack stack 12"), (43, None, "stack")]
    queries = spark.createDataFrame(asked, "query_id int, course_id string, question string")
    return chunks, queries, lexical.prepare_queries(queries).cache()


def all_pairs(chunks, queries, column):
    """Ranks of every question with every chunk of its course, scored one by one."""
    scored = lexical.leg_scores(chunks.drop("tokens").join(queries, "course_id"))
    return lexical.ranked(scored.select("query_id", "course_id", "chunk_index", F.col(column).cast("double").alias("score")), 7)


def as_set(rows):
    return {(r.query_id, r["rank"], r.chunk_index, round(r.score, 9)) for r in rows.collect()}


@pytest.mark.parametrize("leg", ["phrase", "metadata", "semantic"])
@pytest.mark.parametrize("block", [4, 64])
def test_legs_equal_all_pairs(tables, monkeypatch, leg, block):
    chunks, _, queries = tables
    monkeypatch.setattr(impact, "BLOCK", block)
    got = lexical.leg_rank(leg, queries, chunks, 7)
    assert as_set(got) == as_set(all_pairs(chunks, queries, f"{leg}_score")) and got.count() > 40


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(impact, "BLOCK", 4)


def test_an_index_moves_texts_and_no_postings(tables):
    chunks = materialise(tables[0])
    for postings in (impact.token_postings, impact.name_postings, impact.feature_postings, impact.gram_postings):
        plan = impact.build_blocks(postings(chunks))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1, plan


def test_stored_blocks_serve_bm25_without_moving_a_posting(spark, tables, small_blocks):
    chunks, _, queries = tables
    impact.write_blocks(impact.build_blocks(impact.token_postings(chunks)), "token_blocks", 4)
    blocks = impact.read_blocks(spark, "token_blocks")
    try:
        asked = impact.token_questions(queries, blocks, lexical.corpus_stats(chunks)).cache()
        got = impact.top_k(asked, blocks, 7)
        assert as_set(got) == as_set(lexical.bm25_rank(queries, chunks, 7))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        plan = blocks.join(asked.repartition(3), impact.KEY)._jdf.queryExecution().executedPlan().toString()
        side = plan[plan.index("FileScan") - 400 :] if "Join" in plan else ""
        assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning(course_id") == 1 and "Bucketed: true" in side
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.sql("DROP TABLE token_blocks")


def test_only_pairs_with_a_shared_term_meet_and_weak_blocks_stay_shut(spark, tables, small_blocks):
    chunks, _, queries = tables
    asked = impact.feature_questions(queries).cache()
    blocks = impact.build_blocks(impact.feature_postings(chunks, asked)).cache()
    everything = impact.bounds(asked, blocks).select("query_id", "course_id", "block_no")
    met = impact.opened(asked, blocks, everything)
    share = chunks.select("course_id", "chunk_index", F.lower(lexical.search_text()).alias("t")).join(queries, "course_id")
    share = share.filter(lexical.semantic_score(F.col("normalized"), F.col("tokens"), F.col("t")) > 0)
    assert {tuple(r) for r in met.select("query_id", "chunk_index").collect()} == {tuple(r) for r in share.select("query_id", "chunk_index").collect()}
    few = impact.best_blocks(asked, blocks, 2)
    assert 0 < few.count() < 0.8 * everything.count()


def test_phrases_are_read_where_all_their_grams_stand(spark, tables, small_blocks):
    chunks, _, _ = tables
    phrases = spark.createDataFrame([("c0", "othe"), ("c0", "of"), ("c0", "zzz"), ("c1", "页表")], "course_id string, phrase string")
    grams = impact.build_blocks(impact.gram_postings(chunks))
    found = {tuple(r) for r in impact.phrase_candidates(phrases, grams).select("phrase", "course_id", "chunk_index").collect()}
    texts = chunks.select("course_id", "chunk_index", F.lower(lexical.search_text()).alias("t")).collect()
    assert found == {(p, c, r.chunk_index) for c, p in (("c0", "othe"), ("c0", "of"), ("c1", "页表")) for r in texts if r.course_id == c and p in r.t}


def test_empty_sides(tables):
    chunks, queries, ready = tables
    for leg in ("phrase", "metadata", "semantic"):
        assert lexical.leg_rank(leg, ready.limit(0), chunks, 3).count() == 0 == lexical.leg_rank(leg, ready, chunks.limit(0), 3).count()


def plain_search(chunks, query, course, limit, expand):
    """The whole search for one question, from lists of scores."""
    own = lexical.prepare_queries(query, expand=expand)
    usable = chunking.exclude_generated(chunks)
    pairs = lexical.leg_scores(usable.drop("tokens").join(own, "course_id")).withColumn("own", X.tokenize_lexical(lexical.search_text()))
    pairs = pairs.withColumn("rerank", lexical.local_rerank_score()).collect()
    cut, bm25 = max(6 * limit, 18), {r.chunk_index: r.score for r in lexical.bm25_rank(own, usable, 10_000).collect()}
    rrf = {}
    legs = [bm25] + [{r.chunk_index: float(r[c]) for r in pairs} for c in ("phrase_score", "metadata_score", "semantic_score")]
    for number, scores in enumerate(legs):
        best = sorted((i for i, s in scores.items() if s > 0), key=lambda i: (-round(scores[i], 9), i))[:cut]
        for rank, i in enumerate(best, 1):
            at = rrf.setdefault(i, [0.0, (number, rank)])
            at[0] += 1 / (60 + rank)
    kept = sorted(rrf, key=lambda i: (-round(rrf[i][0], 12), rrf[i][1]))[:cut]
    rows = {r.chunk_index: r for r in pairs}
    kept.sort(key=lambda i: (-rows[i].rerank, -round(rrf[i][0], 12), i))
    return rows, rrf, kept


def diverse(kept, relevance, rerank, tokens, files, limit):
    top, chosen, left = max((relevance[i] for i in kept), default=1), [], list(kept)
    while left and len(chosen) < limit:

        def worth(i):
            like = max((len(tokens[i] & tokens[j]) / len(tokens[i] | tokens[j]) if tokens[i] | tokens[j] else 0 for j in chosen), default=0)
            fresh = 0.12 if chosen and all(files[i] != files[j] for j in chosen) else 0
            return 0.56 * relevance[i] / top + 0.28 * rerank[i] - 0.22 * like + fresh

        best = left[0]
        for i in left[1:]:
            best = i if worth(i) > worth(best) + 1e-12 else best
        chosen.append(best)
        left.remove(best)
    return chosen


def test_lexical_search_equals_a_search_one_by_one(tables):
    chunks, queries, _ = tables
    hits = {}
    for r in lexical.lexical_search(queries, chunks, 3).collect():
        hits.setdefault(r.query_id, []).append(r)
    assert 41 not in hits and 43 not in hits
    for q in (0, 5, 9, 40):
        rows, rrf, kept = plain_search(chunks, queries.filter(f"query_id = {q}"), None, 3, expand=False)
        sets = {i: set(rows[i].own) for i in kept}
        best = diverse(kept, {i: rrf[i][0] for i in kept}, {i: rows[i].rerank for i in kept}, sets, {i: rows[i].file_id for i in kept}, 3)
        got = sorted(hits[q], key=lambda r: r["rank"])
        assert [r.chunk_index for r in got] == best and all(r.file_id != "gen" for r in got)
        for r in got:
            asked = set(rows[r.chunk_index].plain)
            assert r.retrieval_method == "bm25_rrf_mmr" and abs(r.score - round(1000 * rrf[r.chunk_index][0], 4)) < 1e-3
            assert r.matched_terms == sorted(asked & sets[r.chunk_index])[:12]
            assert r.text in r.context_text


def test_hybrid_search_equals_a_search_one_by_one(spark, tables):
    chunks, queries, _ = tables
    vectors = vector.hash_embed(chunks, ["id", "course_id", "chunk_index"]).withColumnsRenamed({"id": "doc_id", "chunk_index": "ord"}).cache()
    some = vectors.filter("course_id <> 'c2'")
    hits = {}
    for r in vector.hybrid_search(queries, chunks, some, 3).collect():
        hits.setdefault(r.query_id, []).append(r)
    own = {r.query_id: r.vector for r in vector.hash_embed(lexical.prepare_queries(queries), ["query_id"], "normalized").collect()}
    stored = some.collect()
    for q, course in ((0, "c0"), (9, "c1"), (40, "c0"), (2, "c2")):
        rows, rrf, kept = plain_search(chunks, queries.filter(f"query_id = {q}"), course, 3, expand=True)
        ids = {rows[i].id: i for i in rows}
        sets = {i: set(rows[i].own) for i in kept}
        first = diverse(kept, {i: rrf[i][0] for i in kept}, {i: rows[i].rerank for i in kept}, sets, {i: rows[i].file_id for i in kept}, 6)
        cosine = {ids[r.doc_id]: sum(a * b for a, b in zip(own[q], r.vector)) for r in stored if r.course_id == course and r.doc_id in ids}
        near = sorted((i for i in cosine if cosine[i] >= 0.2), key=lambda i: (-round(cosine[i], 9), i))[:12]
        got = sorted(hits[q], key=lambda r: r["rank"])
        if not near:
            assert course == "c2" and [r.chunk_index for r in got] == first[:3] and {r.retrieval_method for r in got} == {"hybrid_bm25_semantic_rrf_mmr"}
            continue
        both = {i: sum(1 / (61 + lst.index(i)) for lst in (first, near) if i in lst) for i in {*first, *near}}
        order = sorted(both, key=lambda i: (-round(both[i], 12), i not in first, -round(cosine[i] if i in near else 0, 9), -round(rrf[i][0] * 1000 if i in first else 0, 9), rows[i].id))[:12]
        rerank = {i: rows[i].rerank if i in first else min(max(cosine[i], 0), 1) for i in order}
        best = diverse(order, both, rerank, {i: sets[i] if i in first else set() for i in order}, {i: rows[i].file_id for i in order}, 3)
        assert [r.chunk_index for r in got] == best
        for r in got:
            assert abs(r.score - 1000 * both[r.chunk_index]) < 1e-3
            shared = set(rows[r.chunk_index].plain) & (sets[r.chunk_index] if r.chunk_index in first else set())
            assert r.matched_terms == sorted(shared)[:12] and r.text in r.context_text


def test_a_batch_of_questions_moves_no_postings(tables):
    chunks, _, queries = tables
    chunks, queries = materialise(chunks), materialise(queries)
    postings = r"(?s)Exchange hashpartitioning\(course_id#\d+, (term#\d+, block_no|block_no#\d+L?, term)"
    for leg in ("phrase", "metadata", "semantic"):
        plan = lexical.leg_rank(leg, queries, chunks, 7)._jdf.queryExecution().executedPlan().toString()
        assert "entries" not in plan and not re.search(postings, plan), plan


def test_phrases_of_many_questions_in_parts_and_with_runs_that_are_not_kept(tables, monkeypatch):
    chunks, _, queries = tables
    for name, value in (("ASKED_AT_ONCE", 3), ("COUNTERS", 1)):
        monkeypatch.setattr(impact, name, value)
    monkeypatch.setattr(impact._PhraseCounter, "KEPT", 40)
    assert as_set(lexical.leg_rank("phrase", queries, chunks, 7)) == as_set(all_pairs(chunks, queries, "phrase_score"))


def test_a_phrase_counts_apart_from_itself_and_inside_runs():
    counter = impact._PhraseCounter([["aa", "ana"], ["栈"*2], ["aa"]], [[1.0, 2.0], [1.0], [3.0]])
    assert counter.scores(["aaaa banana", "栈栈栈 x", ""]) == [[10.0, 0.0, 0.0], [0.0, 2.0, 0.0], [12.0, 0.0, 0.0]]


def test_bm25_rank_reads_a_chunk_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def read(text):
        seen.add(1)
        return text

    rows = [("c", i, "a.md", "c/a.md", "", f"alpha {'beta ' * (i % 3)}gamma") for i in range(1, 21)] + [("d", 1, "b.md", "d/b.md", "", "alpha")]
    chunks = spark.createDataFrame(rows, "course_id string, chunk_index long, file_name string, path string, section_title string, text string")
    once = chunks.withColumn("text", F.udf(read, "string").asNondeterministic()(F.col("text")))
    queries = lexical.prepare_queries(spark.createDataFrame([(1, "c", "beta")], "query_id long, course_id string, question string"))
    got = [(r.chunk_index, r.rank) for r in lexical.bm25_rank(queries, once, 3).orderBy("rank").collect()]
    assert got == [(2, 1), (5, 2), (8, 3)] and seen.value == len(rows)
    plain = lexical.bm25_scores(queries, lexical.build_postings(chunks), lexical.corpus_stats(chunks))
    assert [(r.chunk_index, round(r.score, 9)) for r in lexical.ranked(plain, 3).orderBy("rank").collect()] == [
        (r.chunk_index, round(r.score, 9)) for r in lexical.bm25_rank(queries, chunks, 3).orderBy("rank").collect()
    ]

"""Lexical retrieval for a table of questions over all chunks of their courses.

chunks: course_id, chunk_index, id, file_id, file_name, path, section_title, material_type, page, text.
queries: query_id, course_id, question. Every join carries the course, so nothing crosses courses.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lectern.functions import params as P
from lectern.functions import text as X
from lectern.sources.scratch import materialise

#: Rows and bytes (of their JSON) up to which a side is sent to all executors.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The side of a join, written out and sent to all executors if it is measured to be small enough, in rows and in
    bytes."""
    df = materialise(df)
    width = F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0))
    n, size = df.limit(rows + 1).agg(F.count("*"), width).first()
    return F.broadcast(df) if n <= rows and size <= BROADCAST_BYTES else df


def search_text() -> Column:
    """What a chunk is found by: name, path, title and text, without the empty ones."""
    parts = [F.when(F.col(c) != "", F.col(c)) for c in ("file_name", "path", "section_title", "text")]
    return F.concat_ws("\n", *parts)


def prepare_queries(queries: DataFrame, expand: bool = True, synonyms: Mapping[str, Sequence[str]] = P.SYNONYMS) -> DataFrame:
    """queries with normalized, plain (tokens), tokens (expanded) and phrases; those without a token are left out."""
    out = queries.withColumn("normalized", X.normalize_query(F.col("question")))
    out = out.withColumn("plain", X.query_tokens(F.col("normalized"))).filter(F.size("plain") > 0)
    tokens = X.expand_query(F.col("question"), F.col("plain"), synonyms) if expand else F.col("plain")
    return out.withColumn("tokens", tokens).withColumn("phrases", X.query_phrases(F.col("normalized")))


def search_tokens(chunks: DataFrame) -> Column:
    """The lexical tokens of the search text. A chunk table has those of title and text already; name and path are put
    before them."""
    if "tokens" not in chunks.columns:
        return X.tokenize_lexical(search_text())
    return F.concat(X.tokenize_lexical(F.concat_ws("\n", "file_name", "path")), F.col("tokens"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """course_id, n_chunks, avg_tokens over the search texts."""
    n = F.size(search_tokens(chunks))
    return chunks.groupBy("course_id").agg(F.count("*").alias("n_chunks"), F.avg(n).alias("avg_tokens"))


def document_frequency(chunks: DataFrame) -> DataFrame:
    """course_id, token, df."""
    tokens = chunks.select("course_id", F.explode(F.array_distinct(search_tokens(chunks))).alias("token"))
    return tokens.groupBy("course_id", "token").agg(F.count("*").alias("df"))


def build_postings(chunks: DataFrame) -> DataFrame:
    """course_id, token, chunk_index, tf, dl. A chunk counts its own tokens, so no posting leaves its task."""
    tokens = chunks.select("course_id", "chunk_index", search_tokens(chunks).alias("tokens"))
    rows = tokens.select("course_id", "chunk_index", F.size("tokens").alias("dl"), F.explode(X.counted(F.col("tokens"))).alias("t"))
    return rows.select("course_id", F.col("t.token").alias("token"), "chunk_index", F.col("t.n").cast("long").alias("tf"), "dl")


def ranked(scored: DataFrame, limit: int) -> DataFrame:
    """rank by score, then chunk order; scores compared at 9 digits, so the order of a sum does not matter."""
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "chunk_index")
    return scored.filter("score > 0").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def bm25_scores(queries: DataFrame, postings: DataFrame, stats: DataFrame) -> DataFrame:
    """query_id, course_id, chunk_index, score. queries: prepared. The questions' tokens are the small side; document
    frequencies come from the same postings, for these tokens only."""
    asked = queries.select("query_id", "course_id", F.explode("tokens").alias("token"))
    asked = asked.groupBy("query_id", "course_id", "token").agg(F.count("*").alias("qtf"))
    wanted = postings.join(sized(asked.select("course_id", "token").distinct()), ["course_id", "token"], "left_semi")
    df = wanted.groupBy("course_id", "token").agg(F.count("*").alias("df"))
    weights = asked.join(df, ["course_id", "token"]).join(stats, "course_id")
    idf = F.log(1 + (F.col("n_chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = sized(weights.select("query_id", "course_id", "token", (F.col("qtf") * idf).alias("w"), "avg_tokens"))
    length = 1 - P.B + P.B * F.col("dl") / F.greatest("avg_tokens", F.lit(1.0))
    part = F.col("w") * F.col("tf") * (P.K1 + 1) / (F.col("tf") + P.K1 * length)
    return wanted.join(weights, ["course_id", "token"]).groupBy("query_id", "course_id", "chunk_index").agg(F.sum(part).alias("score"))


def bm25_rank(queries: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """query_id, course_id, chunk_index, score, rank. Only the tokens that are asked for are counted per chunk. The chunks are
    read once: an empty token, which no text has, stands for the chunk itself and tells its length to the statistics."""
    asked = queries.select("course_id", F.explode("tokens").alias("token")).filter("token <> ''").distinct()
    asked = materialise(asked)  # the courses are those of the same rows
    wanted = asked.unionByName(asked.select("course_id", F.lit("").alias("token")).distinct())
    tokens = chunks.select("course_id", "chunk_index", search_tokens(chunks).alias("tokens"))
    rows = tokens.select("course_id", "chunk_index", F.size("tokens").alias("dl"), F.explode(F.concat(F.array(F.lit("")), "tokens")).alias("token"))
    # all tokens of a chunk go to one task, which so sums up its scores: a question and a chunk are one row in the next shuffle
    rows = rows.join(sized(wanted), ["course_id", "token"], "left_semi").repartition("course_id", "chunk_index")
    # these few postings are read three times: for the statistics, the document frequencies and the scores
    counted = materialise(rows.groupBy("course_id", "token", "chunk_index").agg(F.count("*").alias("tf"), F.first("dl").alias("dl")))
    lengths = counted.filter("token = ''").groupBy("course_id")
    stats = lengths.agg(F.sum("tf").alias("n_chunks"), (F.sum(F.col("tf") * F.col("dl")) / F.sum("tf")).alias("avg_tokens"))
    return ranked(bm25_scores(queries, counted.filter("token <> ''"), stats), limit)


def phrase_score(text: Column, phrases: Column) -> Column:
    """Sum over the phrases of the characters that their occurrences, apart from each other, take."""
    taken = F.transform(phrases, lambda p: F.length(text) - F.length(F.replace(text, p, F.lit(""))))
    return F.aggregate(taken, F.lit(0), lambda a, b: a + b)


def name_tokens() -> Column:
    return X.tokenize_lexical(F.concat_ws(" ", *[X.text_or_empty(F.col(c)) for c in ("file_name", "path", "section_title", "material_type")]))


def metadata_score(tokens: Column, own: Column | None = None) -> Column:
    """How often the distinct tokens stand in name, path, title and kind."""
    return F.size(F.filter(name_tokens() if own is None else own, lambda t: F.array_contains(tokens, t)))


def semantic_score(query: Column, tokens: Column, text: Column, own: Column | None = None, aliases: Mapping[str, Sequence[str]] = P.ALIASES) -> Column:
    """Related terms of fired aliases in the text, and the cosine of the two feature sets (own: the text's)."""
    bonus = F.lit(0.0)
    for trigger, related in aliases.items():
        fires = query.contains(trigger) | F.arrays_overlap(tokens, X.constant_tokens(trigger))
        hits = sum((text.contains(term.lower()).cast("double") for term in related), F.lit(0.0))
        bonus = bonus + F.when(fires, hits).otherwise(0.0)
    asked, own = X.semantic_features(query), X.semantic_features(text) if own is None else own
    both = F.size(F.array_intersect(asked, own)) / F.sqrt(F.size(asked) * F.size(own).cast("double"))
    return bonus + F.when((F.size(asked) > 0) & (F.size(own) > 0), both).otherwise(0.0)


def leg_scores(pairs: DataFrame) -> DataFrame:
    """pairs (query and chunk columns) with phrase, metadata and semantic scores."""
    text = F.lower(search_text())
    return pairs.withColumns(
        {
            "phrase_score": phrase_score(text, F.col("phrases")),
            "metadata_score": metadata_score(F.col("tokens")),
            "semantic_score": semantic_score(F.col("normalized"), F.col("tokens"), text),
        }
    )


def leg_rank(leg: str, queries: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """query_id, course_id, chunk_index, score, rank by one leg (phrase, metadata or semantic), in one pass over the
    chunks: a question meets only chunks that share a phrase, a name token or a feature with it."""
    from lectern.operators import batch
    from lectern.operators import impact as M

    if leg not in ("phrase", "metadata", "semantic"):
        raise ValueError(leg)
    if leg == "phrase":
        return ranked(M.phrase_scores(queries, chunks), limit)
    if leg == "semantic" and (found := batch.best_chunks([leg], queries, chunks, limit)) is not None:
        return ranked(found.drop("leg"), limit)
    asked = materialise(M.name_questions(queries) if leg == "metadata" else M.feature_questions(queries))
    met = chunks.join(sized(asked.select("course_id").distinct()), "course_id", "left_semi")
    postings = M.name_terms(met, ["course_id", "chunk_index"]) if leg == "metadata" else M.feature_terms(met, ["course_id", "chunk_index"])
    return ranked(M.batch_scores(asked, postings), limit)


def reciprocal_rank_fusion(lists: Sequence[DataFrame], limit: int, k: int = P.RRF_K) -> DataFrame:
    """query_id, course_id, chunk_index, rrf_score, rank: sum of 1 / (k + rank) over the lists; ties go to the earlier
    list, then the earlier rank."""
    rows = None
    for number, ranked in enumerate(lists):
        one = ranked.select("query_id", "course_id", "chunk_index", "rank", F.lit(number).alias("list_no"))
        rows = one if rows is None else rows.unionByName(one)
    fused = rows.groupBy("query_id", "course_id", "chunk_index").agg(
        F.sum(1 / (k + F.col("rank"))).alias("rrf_score"), F.min(F.struct("list_no", "rank")).alias("first")
    )
    w = Window.partitionBy("query_id").orderBy(F.round("rrf_score", 12).desc(), "first.list_no", "first.rank")
    return fused.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).drop("first")


def local_rerank_score() -> Column:
    """Of rows with plain tokens, chunk columns and the leg scores; at four digits."""
    asked, own = F.array_distinct("tokens"), X.tokenize_lexical(search_text())
    coverage = F.size(F.array_intersect(asked, own)) / F.greatest(F.size(asked), F.lit(1))
    title = F.when(F.arrays_overlap(asked, X.tokenize_lexical(F.col("section_title"))), 0.12).otherwise(0.0)
    kind = F.when(F.col("material_type").isin("textbook", "slides"), 0.06).otherwise(0.0)
    legs = 0.22 * F.least(F.col("phrase_score") / 20, F.lit(1.0)) + 0.16 * F.least("semantic_score", F.lit(1.0))
    return F.round(0.42 * coverage + legs + 0.12 * F.least(F.col("metadata_score") / 3, F.lit(1.0)) + title + kind, 4)


def apply_rerank_scores(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """candidates (query_id, ordinal, rrf_score, local_rerank_score) with rerank_score, the external one where scores
    (query_id, ordinal, score) has it, and their new rank."""
    out = candidates.join(scores.withColumnRenamed("score", "external_rerank_score"), ["query_id", "ordinal"], "left")
    out = out.withColumn("rerank_score", F.coalesce("external_rerank_score", "local_rerank_score"))
    w = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), F.round("rrf_score", 12).desc(), "ordinal")
    return out.withColumn("rank", F.row_number().over(w))


def rerank_hook(candidates: DataFrame, scorer: Callable[[str, list[str]], Sequence[float]] | None, top_n: int) -> DataFrame:
    """The first top_n candidates of each question in the scorer's order. candidates: query_id, question, ordinal,
    rerank_text; scorer: question and texts to scores. A scorer that fails, or that gives another number of scores,
    leaves the order unchanged; without a scorer the list is only cut."""
    cut = candidates.filter(F.col("ordinal") < top_n)
    if scorer is None:
        return cut.withColumns({"external_score": F.lit(None).cast("double"), "rank": F.col("ordinal") + 1})
    schema = T.StructType([*cut.schema.fields, T.StructField("external_score", T.DoubleType()), T.StructField("rank", T.IntegerType())])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ordinal", kind="stable").reset_index(drop=True)
        try:
            scores = list(scorer(rows["question"].iloc[0], rows["rerank_text"].tolist()))
        except Exception:  # noqa: BLE001  a model that is down must not stop the job; the old order is the result then
            scores = []
        if len(scores) != len(rows):
            return rows.assign(external_score=None, rank=range(1, len(rows) + 1)).astype({"external_score": "float64"})
        rows["external_score"] = [float(s) for s in scores]
        rows = rows.sort_values("external_score", ascending=False, kind="stable")
        return rows.assign(rank=range(1, len(rows) + 1))

    # a question has at most top_n rows here
    return cut.groupBy("query_id").applyInPandas(run, schema)


def token_jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def select_diverse(candidates: DataFrame, limit: int) -> DataFrame:
    """candidates (query_id, ordinal, file_id, tokens, rrf_score, rerank_score) with picked (1, 2, ...): greedy choice
    of the most relevant that is least like what is chosen. A question has few candidates: the lists are cut before."""
    schema = T.StructType([*candidates.schema.fields, T.StructField("picked", T.IntegerType())])

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ordinal", kind="stable").reset_index(drop=True)
        sets = [set(t) if t is not None else set() for t in rows["tokens"]]
        top = max(float(rows["rrf_score"].max()), 1e-12)
        base = (0.56 * rows["rrf_score"] / top + 0.28 * rows["rerank_score"]).tolist()
        chosen: list[int] = []
        while len(chosen) < min(limit, len(rows)):
            best, best_value = -1, float("-inf")
            for i in range(len(rows)):
                if i in chosen:
                    continue
                like = max((len(sets[i] & sets[j]) / len(sets[i] | sets[j]) if sets[i] | sets[j] else 0.0 for j in chosen), default=0.0)
                fresh = 0.12 if chosen and all(rows["file_id"][i] != rows["file_id"][j] for j in chosen) else 0.0
                value = base[i] - 0.22 * like + fresh
                if value > best_value + 1e-12:
                    best, best_value = i, value
            chosen.append(best)
        return rows.iloc[chosen].assign(picked=range(1, len(chosen) + 1))

    return candidates.groupBy("query_id").applyInPandas(pick, schema)


def enrich_hits(selected: DataFrame, method: str) -> DataFrame:
    """selected (plain, chunk columns, rrf_score) with score, query_coverage, matched_terms and retrieval_method."""
    asked, own = F.array_distinct("plain"), X.tokenize_lexical(search_text())
    both = F.array_intersect(asked, own)
    return selected.withColumns(
        {
            "score": F.round(1000 * F.col("rrf_score"), 4),
            "query_coverage": F.size(both) / F.greatest(F.size(asked), F.lit(1)),
            "matched_terms": F.slice(F.array_sort(both), 1, 12),
            "retrieval_method": F.lit(method),
        }
    )


def retrieval_quality(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, quality: none without a hit, sufficient from the coverage (or coverage and score) on, else partial."""
    best = hits.groupBy("query_id").agg(F.max("query_coverage").alias("c"), F.max("score").alias("s"))
    good = (F.col("c") >= 0.33) | ((F.col("c") >= 0.24) & (F.col("s") >= 45))
    word = F.when(F.col("c").isNull(), "none").when(good, "sufficient").otherwise("partial")
    return queries.select("query_id").distinct().join(best, "query_id", "left").select("query_id", word.alias("quality"))


def fused_candidates(queries: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """The four legs cut and fused, with chunk and question columns, leg scores, rerank_score and ordinal. Texts are
    fetched for the cut only. queries (prepared) and chunks are read several times: keep them."""
    from lectern.operators import batch

    cut, names = max(6 * limit, 18), ("bm25", "phrase", "metadata", "semantic")
    found = batch.best_chunks(names, queries, chunks, cut)
    if found is None:
        legs = [bm25_rank(queries, chunks, cut)]
        legs += [leg_rank(leg, queries, chunks, cut) for leg in names[1:]]
    else:
        found = materialise(found)  # read once for each leg
        legs = [ranked(found.filter(F.col("leg") == leg).drop("leg"), cut) for leg in names]
    fused = sized(reciprocal_rank_fusion(legs, cut).drop("rank"))
    rows = chunks.drop("tokens").join(fused, ["course_id", "chunk_index"]).join(sized(queries), ["query_id", "course_id"])
    rows = leg_scores(rows).withColumn("rerank_score", local_rerank_score())
    w = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), F.round("rrf_score", 12).desc(), "chunk_index")
    return rows.withColumn("ordinal", F.row_number().over(w) - 1)


def with_context(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """hits (course_id, chunk_index) with context_text; the windows run over the files of the hits only."""
    from lectern.operators.chunking import neighbor_context

    page = ["course_id", "file_id"]
    files = sized(hits.select(*page).distinct())
    context = neighbor_context(chunks.select(*page, "page", "chunk_index", "text").join(files, page, "left_semi"))
    return hits.join(context.select("course_id", "chunk_index", "context_text"), ["course_id", "chunk_index"])


def lexical_search(queries: DataFrame, chunks: DataFrame, limit: int = 5) -> DataFrame:
    """The hits of every question, ranked: query_id, rank, chunk columns, scores, context_text. queries are raw; their
    tokens are searched as they stand, without synonyms."""
    from lectern.operators.chunking import exclude_generated

    usable = exclude_generated(chunks)
    asked = materialise(prepare_queries(queries, expand=False))
    candidates = fused_candidates(asked, usable, limit).withColumn("tokens", X.tokenize_lexical(search_text()))
    hits = materialise(select_diverse(candidates, limit).withColumnRenamed("picked", "rank"))
    return enrich_hits(with_context(hits, usable), "bm25_rrf_mmr")

"""Vectors of chunks and exact search over them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import params as P
from lectern.functions import text as X
from lectern.operators.lexical import sized
from lectern.sources.scratch import materialise

BATCH = 32


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit_vector(v: Column) -> Column:
    """Length one; a zero vector stays."""

    def scale(x: Column) -> Column:
        norm = F.sqrt(dot(x, x))
        return X.let(norm, lambda n: F.transform(x, lambda c: F.when(n > 0, c / n).otherwise(c)))

    return X.let(v.cast("array<double>"), scale)


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 for an empty or zero vector; vectors of different lengths are an error."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)
    wrong = F.raise_error(F.lit("vectors of different lengths")).cast("double")
    return F.when(F.size(a) != F.size(b), wrong).otherwise(value)


def token_hash(token: str) -> tuple[int, float]:
    """The 8-byte digest of a token: its first four bytes as a number, and a sign from the fifth."""
    raw = hashlib.blake2b(token.encode("utf-8"), digest_size=8).digest()
    return int.from_bytes(raw[:4], "big"), 1.0 if raw[4] % 2 == 0 else -1.0


def hash_embed(rows: DataFrame, keys: Sequence[str], text: str = "text", dims: int = 64) -> DataFrame:
    """keys, vector: signed counts of hashed tokens, length one. Distinct tokens are hashed once for each task."""

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, float]] = {}
        for batch in batches:
            if len(known) > 200_000:
                known.clear()
            lists = batch.column("tokens")
            rows = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            coded = lists.flatten().dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            for t in distinct:
                if t not in known:
                    known[t] = token_hash(t)
            hashed = np.array([known[t] for t in distinct]).reshape(-1, 2)[coded.indices.to_numpy(zero_copy_only=False)]
            v = np.bincount(rows * dims + hashed[:, 0].astype(np.int64) % dims, hashed[:, 1], len(lists) * dims).reshape(-1, dims).astype(float)  # of no tokens numpy counts integers
            norms = np.linalg.norm(v, axis=1, keepdims=True)
            v = np.divide(v, norms, out=v, where=norms > 0)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, dims), pa.int32()), pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), vectors], names=[*keys, "vector"])

    ready = rows.select(*keys, X.tokenize_embedding(F.col(text)).alias("tokens"))
    schema = ", ".join(f"{c} {t}" for c, t in ready.drop("tokens").dtypes)
    return ready.mapInArrow(embed, f"{schema}, vector array<double>")


def embed_with(rows: DataFrame, key: str, text: str, model: Callable[[Sequence[str]], Sequence[Sequence[float]]], batch: int = BATCH) -> DataFrame:
    """key, vector by a model of one's own, in batches. Another number of vectors than texts, or of dimensions than
    before, is an error."""

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        dims = None
        for texts in batches:
            out = []
            for start in range(0, len(texts), batch):
                part = texts.iloc[start : start + batch].tolist()
                got = np.asarray(model(part), float)
                if got.ndim != 2 or len(got) != len(part) or (dims is not None and got.shape[1] != dims):
                    raise ValueError("the model gave another number of vectors or dimensions")
                dims = got.shape[1]
                norms = np.linalg.norm(got, axis=1, keepdims=True)
                out += np.divide(got, norms, out=got.copy(), where=norms > 0).tolist()
            yield pd.Series(out)

    return rows.select(key, embed(F.col(text)).alias("vector"))


def build_vector_index(chunks: DataFrame, dims: int = 64) -> DataFrame:
    """doc_id, text, metadata, vector of the chunks with text. The text falls back to context_text and content, the id
    to file-page-index."""
    have = set(chunks.columns)
    col = lambda c: F.col(c).cast("string") if c in have else F.lit(None).cast("string")
    filled = lambda c: F.when(X.strip(col(c)) != "", col(c))
    text = F.coalesce(filled("text"), filled("context_text"), filled("content"))
    page = F.coalesce(F.when(col("page") != "0", col("page")), F.lit("text"))
    doc_id = F.coalesce(F.when(col("id") != "", col("id")), F.concat_ws("-", col("file_id"), page, col("chunk_index")))
    rest = [c for c in chunks.columns if c not in ("tokens", "context_text")]
    metadata = F.map_from_arrays(F.array(*map(F.lit, rest)), F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rest]))
    rows = chunks.filter(text.isNotNull()).select(doc_id.alias("doc_id"), text.alias("text"), F.to_json(metadata).alias("metadata"))
    embedded = hash_embed(rows, ["doc_id", "text", "metadata"], "text", dims)
    return embedded.withColumn("metadata", F.from_json("metadata", "map<string,string>"))


def upsert_vectors(index: DataFrame, new: DataFrame) -> DataFrame:
    """index (doc_id, ord, version, vector) with new rows: the last version of an id wins and keeps its first place."""
    rows = index.unionByName(new)
    return rows.groupBy("doc_id").agg(F.min("ord").alias("ord"), F.max("version").alias("version"), F.max_by("vector", "version").alias("vector"))


def vector_search(queries: DataFrame, index: DataFrame, limit: int = 5, min_score: float | None = None, block: int = 4096) -> DataFrame:
    """query_id, doc_id, ord, score, rank: exact cosines of every query with every vector of its course.

    queries: query_id, course_id, vector; index: doc_id, course_id, ord, vector. Both sides of a course are cut into
    blocks of about `block` rows by a hash of their ids, however large the course is; each pair of blocks is one matrix
    product in a task, which keeps the best `limit` of its rows for each query, and the partial winners are merged. The
    queries are a stated set; nothing passes through the driver.
    """
    kinds = {**dict(index.dtypes), **{"query_id": dict(queries.dtypes)["query_id"]}}
    text = lambda c: F.col(c).cast("string").alias(c)  # noqa: E731  ids keep their digits in pandas
    near, asked = index.select(text("doc_id"), "course_id", text("ord"), "vector"), queries.select(text("query_id"), "course_id", "vector")
    blocks = lambda rows, name: rows.groupBy("course_id").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    sizes = sized(blocks(asked, "query_blocks").join(blocks(near, "index_blocks"), "course_id"))
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # other names than the index has: the queries may be some of its rows
    left = asked.join(sizes, "course_id").select(F.col("course_id").alias("asked_course"), own("query_id", "query_blocks").alias("asked_qb"), each("index_blocks").alias("asked_ib"), "query_id", F.col("vector").alias("asked"))
    right = near.join(sizes, "course_id").select("course_id", each("query_blocks").alias("qb"), own("doc_id", "index_blocks").alias("ib"), "doc_id", "ord", "vector")
    pairs = left.groupBy("asked_course", "asked_qb", "asked_ib").cogroup(right.groupBy("course_id", "qb", "ib"))
    found = pairs.applyInPandas(_best_of(limit, min_score), "query_id string, doc_id string, ord string, score double")
    found = found.select(*(F.col(c).cast(kinds[c]).alias(c) for c in ("query_id", "doc_id", "ord")), "score")
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "ord")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


#: Bytes of the vectors of queries that are sent to all tasks.
FEW_BYTES = 16 << 20


def search_few(queries: DataFrame, index: DataFrame, limit: int, min_score: float | None = None) -> DataFrame | None:
    """vector_search for queries whose vectors may be sent to all tasks, else None: the index is read once where it is, and
    of each query a task gives only what may be among its best. ord: a number."""
    width = F.coalesce(F.sum(F.size("vector") * 8 + F.length(F.col("course_id").cast("string"))), F.lit(0))
    asked = materialise(queries.select("query_id", "course_id", "vector").filter(F.col("course_id").isNotNull() & F.col("vector").isNotNull()).withColumn("number", F.monotonically_increasing_id()))
    if asked.agg(width).first()[0] > FEW_BYTES:
        return None
    own = asked.select("number", F.col("course_id").cast("string").alias("course"), "vector").toPandas()  # bounded above
    shared = asked.sparkSession.sparkContext.broadcast({c: (rows["number"].to_numpy(), _unit_rows(rows["vector"])) for c, rows in own.groupby("course")})
    kinds = dict(index.dtypes)
    near = index.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("course_id").cast("string").alias("course"), F.col("ord").cast("long").alias("ord"), "vector")
    names = ["number", "doc_id", "ord", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            courses, docs, ords = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("course", "doc_id", "ord"))
            vectors = batch.column("vector")
            flat, sizes = vectors.flatten().to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            for course in set(courses.tolist()) & shared.value.keys():
                numbers, wanted = shared.value[course]
                at = np.flatnonzero(courses == course)
                if not (sizes[at] == wanted.shape[1]).all():
                    raise ValueError("vectors of different lengths")
                scores = np.round(wanted @ _unit_rows(flat[(ends[at] - wanted.shape[1])[:, None] + np.arange(wanted.shape[1])]).T, 12)
                for number, row in zip(numbers.tolist(), scores, strict=True):
                    good = np.flatnonzero(row >= max(best[number][0].min() - 2e-9 if number in best and len(best[number][0]) >= limit else -2, -2 if min_score is None else min_score))
                    if len(good):
                        s, o, d = (np.concatenate(x) for x in zip(best.get(number, (np.empty(0), np.empty(0, np.int64), np.empty(0, object))), (row[good], ords[at[good]], docs[at[good]]), strict=True))
                        best[number] = _first_of(s, o, d, limit)
        for number, (s, o, d) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(s), pa.int64()), pa.array(d, pa.string()), pa.array(o, pa.int64()), pa.array(s, pa.float64())], names=names)

    found = near.mapInArrow(run, "number long, doc_id string, ord long, score double")
    found = found.join(F.broadcast(asked.select("number", "query_id")), "number")
    found = found.select("query_id", *(F.col(c).cast(kinds[c]).alias(c) for c in ("doc_id", "ord")), "score")
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "ord")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def _first_of(s: np.ndarray, o: np.ndarray, d: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores, numbers and ids of those that may be among the first `limit` by score at nine digits, then number."""
    if len(s) > limit:
        order = np.lexsort((o, -s))
        s, o, d = s[order], o[order], d[order]
        at = np.arange(len(s))
        same = at - np.maximum.accumulate(np.where(np.concatenate([[True], s[1:] != s[:-1]]), at, 0))
        keep = (s >= s[limit - 1] - 2e-9) & (same < limit)
        s, o, d = s[keep], o[keep], d[keep]
    return s, o, d


#: Bytes of centroids up to which they are sent to all executors.
CENTROID_BYTES = 32 << 20


def fit_cells(index: DataFrame, cells: int = 64, sample: int = 20_000, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centroids for assign_cells, by spherical k-means over at most `sample` vectors of the index, those of the
    lowest hash of doc_id. Fewer vectors than cells give as many cells as vectors."""
    rows = index.select("doc_id", "vector").orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(sample).toPandas()  # bounded by sample
    x = _unit_rows(rows["vector"]) if len(rows) else np.zeros((0, 1))
    x = x[np.abs(x).sum(axis=1) > 0]
    if not len(x):
        return np.zeros((1, x.shape[1] if x.ndim == 2 else 1))
    centres = x[np.random.default_rng(seed).permutation(len(x))[:cells]].copy()
    if centres.nbytes > CENTROID_BYTES:
        raise ValueError(f"centroids of {centres.nbytes} bytes are over {CENTROID_BYTES}: take fewer cells")
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)  # an empty cell stays where it was
    return centres


def assign_cells(rows: DataFrame, centres: np.ndarray, nearest: int = 1) -> DataFrame:
    """rows (vector, ...) with cells: the numbers of the nearest cells, best first. A null or zero vector is in cell 0."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)  # its size has been checked

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for batch in batches:
            x = _unit_rows([v if v is not None else np.zeros(own.shape[1]) for v in batch]) if len(batch) else np.zeros((0, own.shape[1]))
            yield pd.Series(np.argsort(-np.round(x @ own.T, 9), axis=1, kind="stable")[:, :nearest].tolist())

    return rows.withColumn("cells", F.pandas_udf(run, "array<int>")("vector"))


def cell_index(index: DataFrame, centres: np.ndarray) -> DataFrame:
    """The inverted file: every row of the index with its cell. To be stored, partitioned or bucketed by course and cell."""
    return assign_cells(index, centres).withColumn("cell", F.get("cells", F.lit(0))).drop("cells")


def approximate_search(queries: DataFrame, cells: DataFrame, centres: np.ndarray, limit: int = 5, probes: int = 32, min_score: float | None = None, block: int = 4096) -> DataFrame:
    """query_id, doc_id, ord, score, rank of the best in the `probes` nearest cells of each query, scored exactly. cells:
    cell_index of vector_search's index. The same blocks as there, by course and cell: a cell with a third of all vectors
    is many blocks. With as many probes as cells the result is vector_search's; with fewer, vectors in other cells are
    missed: of vectors without any clusters half the 64 cells hold 0.93 of the best five, of clustered ones few cells do.
    Exact search stays the default of everything else."""
    place = F.when(F.col("course_id").isNotNull(), F.concat_ws("/", F.col("course_id").cast("string"), "cell")).alias("course_id")
    asked = assign_cells(queries.select("query_id", "course_id", "vector"), centres, probes)
    asked = asked.select("query_id", "course_id", F.explode("cells").alias("cell"), "vector").select("query_id", place, "vector")
    return vector_search(asked, cells.select("doc_id", place, "ord", "vector"), limit, min_score, block)


def _unit_rows(vectors: Sequence) -> np.ndarray:
    m = np.array([np.asarray(v, float) for v in vectors], float)
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def _best_of(limit: int, min_score: float | None) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(rows) and limit > 0:
            # all rows as good as the last winner go on: the merge orders ties, and it alone knows how
            scores = np.round(_unit_rows(asked["asked"]) @ _unit_rows(rows["vector"]).T, 12)
            docs, ords, most = rows["doc_id"].to_numpy(), rows["ord"].to_numpy(), min(limit, len(rows))
            for q, row in zip(asked["query_id"], scores, strict=True):
                least = np.round(np.partition(row, -most)[-most], 9) - 1e-9
                good = row >= (least if min_score is None else max(least, min_score))
                out += [(q, docs[i], ords[i], row[i]) for i in np.flatnonzero(good)]
        return pd.DataFrame(out, columns=["query_id", "doc_id", "ord", "score"])

    return run


def hybrid_merge(lexical: DataFrame, vectors: DataFrame, limit: int = 5, k: int = P.RRF_K) -> DataFrame:
    """query_id, id, ranks, scores, sources, method, rank of two ranked lists (query_id, id, rank, score)."""
    a = lexical.select("query_id", "id", F.col("rank").alias("lexical_rank"), F.col("score").alias("lexical_score"))
    b = vectors.select("query_id", "id", F.col("rank").alias("vector_rank"), F.col("score").alias("vector_score"))
    both = a.join(b, ["query_id", "id"], "full_outer")
    part = lambda c: F.coalesce(1 / (k + F.col(c)), F.lit(0.0))
    sources = F.array_compact(F.array(F.when(F.col("lexical_rank").isNotNull(), "lexical"), F.when(F.col("vector_rank").isNotNull(), "vector")))
    out = both.withColumns({"hybrid_rrf_score": part("lexical_rank") + part("vector_rank"), "retrieval_sources": sources})
    method = F.when(F.size("retrieval_sources") == 2, "hybrid").otherwise(F.get("retrieval_sources", F.lit(0)))
    w = Window.partitionBy("query_id").orderBy(
        F.round("hybrid_rrf_score", 12).desc(), F.col("lexical_rank").isNull(), F.round(F.coalesce("vector_score", F.lit(0.0)), 9).desc(),
        F.round(F.coalesce("lexical_score", F.lit(0.0)), 9).desc(), "id",
    )
    out = out.withColumns({"retrieval_method": method, "rank": F.row_number().over(w)})
    return out.filter(F.col("rank") <= limit)


def hybrid_search(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, limit: int = 5, dims: int = 64) -> DataFrame:
    """Fused lexical and vector hits of raw queries: query_id, rank, the chunk's columns, hybrid_rrf_score, score,
    query_coverage, matched_terms, retrieval_method, context_text. vectors: doc_id (chunk id), course_id, ord, vector.

    Tokens are expanded by synonyms for the search, and coverage is of the plain ones. Generated files are left out of
    both lists. A question without a vector hit keeps its lexical hits; one without a token has none."""
    from lectern.operators import lexical as L
    from lectern.operators.chunking import exclude_generated, is_generated

    usable = exclude_generated(chunks)
    generated = materialise(chunks.filter(is_generated()).select(F.col("id").alias("doc_id")))
    kept = usable.select(F.col("id").alias("doc_id")).join(L.sized(generated), "doc_id", "left_semi")  # ids of both kinds of files
    generated = L.sized(generated.join(kept, "doc_id", "left_anti"))
    asked = materialise(L.prepare_queries(queries))
    candidates = L.fused_candidates(asked, usable, limit).withColumn("tokens", X.tokenize_lexical(L.search_text()))
    first = materialise(L.select_diverse(candidates, 2 * limit))
    lexical = first.select("query_id", "id", F.col("picked").alias("rank"), (1000 * F.col("rrf_score")).alias("score"))
    embedded = hash_embed(asked, ["query_id", "course_id"], "normalized", dims)
    near, most = vectors.join(generated, "doc_id", "left_anti"), max(4 * limit, 12)
    few = search_few(embedded, near, most, 0.2) if dict(vectors.dtypes)["ord"] in ("int", "bigint") else None
    near = materialise((vector_search(embedded, near, most, 0.2) if few is None else few).withColumnRenamed("doc_id", "id"))
    merged = hybrid_merge(lexical, near, max(4 * limit, 12))
    met = merged.join(near.select("query_id").distinct(), "query_id", "left_semi")
    known = met.join(first.select("query_id", "id", "tokens", "rerank_score"), ["query_id", "id"], "left")
    files = usable.select("id", "file_id").join(L.sized(met.select("id").distinct()), "id", "left_semi")
    ready = known.join(L.sized(files), "id").select(
        "query_id", "id", "file_id", "retrieval_method", "hybrid_rrf_score",
        F.coalesce("tokens", X.empty_strings()).alias("tokens"),
        F.col("hybrid_rrf_score").alias("rrf_score"),
        F.coalesce("rerank_score", F.least(F.greatest(F.col("vector_score"), F.lit(0.0)), F.lit(1.0)), F.lit(0.0)).alias("rerank_score"),
        (F.col("rank") - 1).alias("ordinal"),
    )
    shown = ["query_id", "id", F.col("picked").alias("rank"), "retrieval_method", "hybrid_rrf_score", "rrf_score", "tokens"]
    fused = L.select_diverse(ready, limit).select(*shown)
    alone = first.filter(F.col("picked") <= limit).join(near.select("query_id").distinct(), "query_id", "left_anti")
    alone = alone.withColumns({"retrieval_method": F.lit("hybrid_bm25_semantic_rrf_mmr"), "hybrid_rrf_score": F.lit(None).cast("double")})
    hits = L.sized(fused.unionByName(alone.select(*shown)))
    rows = usable.drop("tokens").join(hits, "id").join(L.sized(asked.select("query_id", "plain")), "query_id")
    plain, both = F.array_distinct("plain"), F.array_intersect("plain", "tokens")
    rows = rows.withColumns(
        {
            "score": F.round(1000 * F.col("rrf_score"), 4),
            "query_coverage": F.round(F.size(both) / F.greatest(F.size(plain), F.lit(1)), 4),
            "matched_terms": F.slice(F.array_sort(both), 1, 12),
        }
    )
    return L.with_context(rows.drop("plain", "tokens", "rrf_score"), usable)

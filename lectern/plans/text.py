"""Queries of the text functions, over documents and questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.plans import inputs as I


def _list(column: Callable[[Column], Column], name: str = "documents", ordered: bool = True):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = "doc_id" if name == "documents" else "item_id"
        rows = I.read(spark, sf_dir, name).select(F.col(key).alias("id"), column(F.col("text")).alias("x"))
        items = F.col("x") if ordered else F.array_sort("x")
        return rows.select("id", F.size("x").cast("long").alias("n"), F.md5(F.array_join(items, "|")).alias("digest"))

    return query


def _value(column: Callable[[Column], Column], name: str = "documents"):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = "doc_id" if name == "documents" else "item_id"
        return I.read(spark, sf_dir, name).select(F.col(key).alias("id"), F.md5(column(F.col("text"))).alias("digest"))

    return query


def _list_sql(expr: str, name: str = "documents", ordered: bool = True) -> str:
    key = "doc_id" if name == "documents" else "item_id"
    items = "x" if ordered else "list_sort(x)"
    return f"SELECT id, len(x) AS n, md5(array_to_string({items}, '|')) AS digest FROM (SELECT {key} AS id, {expr} AS x FROM {name})"


def _value_sql(expr: str, name: str = "documents") -> str:
    key = "doc_id" if name == "documents" else "item_id"
    return f"SELECT {key} AS id, md5({expr}) AS digest FROM {name}"


def coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 3 == 0, F.lit("n/a")).otherwise(F.get_json_object("props", "$.k"))
    return I.read(spark, sf_dir, "events").select(
        "event_id",
        X.coerce_int(raw, 25, 5, 60).alias("minutes"),
        X.coerce_score(F.col("value").cast("string")).alias("score"),
        X.coerce_choice(F.col("event_type"), ("click", "view"), "todo").alias("status"),
    )


def ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.substr("text", F.lit(1), F.lit(60))
    return I.read(spark, sf_dir, "documents").select("doc_id", X.stable_id(F.col("text")).alias("file_id"), X.point_id(title).alias("point_id"), X.mistake_id(F.col("source"), F.col("lang"), F.lit("t")).alias("mistake_id"))


def expand_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    synonyms = {"the": ("fifo queue",), "de la": ("stack", "lifo 2")}
    tokens = X.expand_query(F.col("text"), X.query_tokens(X.normalize_query(F.col("text"))), synonyms)
    return I.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.size(tokens).cast("long").alias("n"), F.md5(F.array_join(tokens, "|")).alias("digest"))


_CLEAN = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
_TOKENS = I.tokens_sql("text")
_COMPACT = "regexp_replace(lower(text), '\\s+', '', 'g')"
_HEAD = f"substr({_CLEAN}, 1, 150)"
_LAST = f"(CASE WHEN strpos(reverse({_HEAD}), '.') > 0 THEN length({_HEAD}) - strpos(reverse({_HEAD}), '.') + 1 ELSE 0 END)"
_PREFIX = f"array_to_string((regexp_extract_all({_CLEAN}, '[A-Za-z0-9_]+'))[1:18], ' ')"
_LONG = f"list_filter({_TOKENS}, lambda t: length(t) > 1)"

QUERIES = {
    "tokenize_lexical": _list(X.tokenize_lexical),
    "tokenize_embedding": _list(X.tokenize_embedding),
    "tokenize_citation": _list(X.tokenize_citation),
    "tokenize_web_query": _list(X.tokenize_web_query, ordered=False),
    "normalize_query": _value(X.normalize_query, "benchmark"),
    "query_tokens": _list(lambda c: X.query_tokens(X.normalize_query(c))),
    "expand_query": expand_query,
    "query_phrases": _list(X.query_phrases),
    "semantic_features": _list(X.semantic_features, "benchmark", ordered=False),
    "compact_sentence": _value(X.compact_sentence),
    "compact_text": _value(lambda c: X.compact_text(c, 900)),
    "clip_text": _value(lambda c: X.clip_text(c, 80)),
    "compress_text": _value(X.compress_text),
    "bounded_join": _value(lambda c: X.bounded_join(F.split(c, "\n"), 400)),
    "pick_keyword": _value(X.pick_keyword),
    "split_sentences": _list(X.split_sentences),
    "redact_secrets": _value(X.redact_secrets),
    "stable_id": ids,
    "coerce": coerce,
}
ORACLES = {
    "tokenize_lexical": _list_sql(_TOKENS),
    "tokenize_embedding": _list_sql("regexp_extract_all(lower(text), '[a-z0-9]+')"),
    "tokenize_citation": _list_sql("list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda t: length(t) > 1)"),
    "tokenize_web_query": _list_sql(
        "list_filter(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]{2,}'), lambda t: lower(t))), lambda t: t NOT IN ('please', 'about', 'what', 'with', 'from', 'search', 'latest'))",
        ordered=False,
    ),
    "normalize_query": _value_sql("lower(text)", "benchmark"),
    "query_tokens": _list_sql(f"list_filter({_TOKENS}, lambda t: NOT regexp_full_match(t, '[0-9]{{1,3}}'))"),
    "expand_query": _list_sql(
        f"list_concat(list_filter({_TOKENS}, lambda t: NOT regexp_full_match(t, '[0-9]{{1,3}}')), CASE WHEN contains(lower(text), 'the') OR list_contains({_TOKENS}, 'the') THEN ['fifo', 'queue'] ELSE [] END, "
        f"CASE WHEN contains(lower(text), 'de la') OR list_has_any({_TOKENS}, ['de', 'la']) THEN ['stack', 'lifo', '2'] ELSE [] END)",
        "benchmark",
    ),
    "query_phrases": _list_sql("list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda t: length(t) >= 2)"),
    "semantic_features": _list_sql(f"list_distinct(list_concat({_LONG}, list_transform(range(1, greatest(length({_COMPACT}) - 2, 1)), lambda i: substr({_COMPACT}, i, 4))))", "benchmark", False),
    "compact_sentence": _value_sql(f"CASE WHEN length({_CLEAN}) <= 150 THEN {_CLEAN} WHEN {_LAST} > 40 THEN substr({_CLEAN}, 1, {_LAST}) ELSE rtrim({_HEAD}) || '...' END"),
    "compact_text": _value_sql(f"CASE WHEN length({_CLEAN}) <= 900 THEN {_CLEAN} ELSE rtrim(substr({_CLEAN}, 1, 900)) || '...' END"),
    "clip_text": _value_sql("substr(trim(text, chr(10) || ' ' || chr(9) || chr(13)), 1, 80)"),
    "compress_text": _value_sql(
        f"CASE WHEN length({_CLEAN}) <= 260 THEN {_CLEAN} WHEN {_PREFIX} <> '' AND 256 - length({_PREFIX}) > 30 THEN {_PREFIX} || ' ... ' || right({_CLEAN}, 256 - length({_PREFIX})) ELSE substr({_CLEAN}, 1, 259) || '…' END"
    ),
    "pick_keyword": f"""WITH t AS (SELECT doc_id, {_LONG} AS toks FROM documents),
        e AS (SELECT doc_id, unnest(toks) AS tok, unnest(range(len(toks))) AS pos FROM t),
        c AS (SELECT doc_id, tok, count(*) AS n, min(pos) AS first FROM e GROUP BY 1, 2),
        b AS (SELECT doc_id, arg_min(tok, first - n * 100000000) AS tok FROM c GROUP BY 1)
        SELECT doc_id AS id, md5(coalesce(b.tok, '核心概念')) AS digest FROM documents LEFT JOIN b USING (doc_id)""",
    "redact_secrets": _value_sql("substr(trim(regexp_replace(regexp_replace(text, 'sk-[A-Za-z0-9_\\-]+', 'sk-***', 'g'), '\\s+', ' ', 'g')), 1, 300)"),
    "stable_id": """SELECT doc_id, substr(sha1(text), 1, 16) AS file_id, 'kp-' || substr(sha1(lower(trim(substr(text, 1, 60), chr(10) || ' '))), 1, 12) AS point_id,
        'mistake-' || substr(sha1(source || '|' || lang || '|t'), 1, 12) AS mistake_id FROM documents""",
    "coerce": """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 25 ELSE least(greatest(CAST(json_extract_string(props, '$.k') AS BIGINT), 5), 60) END AS minutes,
        CAST(least(greatest(round_even(value, 0), 0), 100) AS INTEGER) AS score, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'todo' END AS status FROM events""",
}

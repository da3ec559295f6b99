"""The registered queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import let

from . import (
    bpe,
    chat_format,
    conversation_repair,
    decontamination,
    knn_quality,
    language_id,
    line_templates,
    neardup,
    periodic_runs,
    quality_rules,
    substring_dedup,
    toxicity,
    url_filters,
)
from .common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filters.filter_urls(table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    digests = chat_format.conversation_digests(chat_format.format_turns(rows))
    return digests.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, emit_ids=False)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *columns)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = substring_dedup.repeated_spans(table(spark, sf_dir, "documents"), within=True)
    return spans.select("doc_id", "start", "end", "n_words", "first_doc_id")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_templates.drop_recurring_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", F.size("dropped").alias("n_dropped"), "dropped", F.length("text").alias("n_chars"))


def with_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text, in which every tenth document (by a checksum of its id) goes on in periods from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("int")

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = F.when(n > 0, g % n).otherwise(0)
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("int")
        whole = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a), whole), F.lit(1), n), " ")

    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    planted = F.when(h % 10 == 0, let(words, lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise("")))
    return docs.select("doc_id", F.coalesce(planted, "text").alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_periods(table(spark, sf_dir, "documents")))
    best = periodic_runs.strongest(F.col("runs"))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    found = found.withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def damaged(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with faults planted by a checksum of conversation and turn, and every conv_id."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"))
    kind = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    out = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(1), times)).alias("copy"))
    return out.drop("copy"), conversations.select("conv_id").distinct()


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_report(*damaged(table(spark, sf_dir, "conversations")))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.document_languages(table(spark, sf_dir, "documents"))


def _glob_regex(glob: str) -> str:
    parts = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    out, i = [], 0
    while i < len(glob):
        step = 2 if glob[i : i + 2] == "**" else 1
        piece = glob[i : i + step]
        out.append(parts.get(piece) or (piece if piece.isalnum() else "\\" + piece))
        i += step
    return "(?s)^" + "".join(out) + "$"


def _url_sql() -> str:
    rules = []
    for rule, verdict in sorted(url_filters.HOST_RULES, key=lambda r: -len(r[0])):
        host, _, path = rule.partition("/")
        fits = f"('.' || host) LIKE '%.{host}' AND starts_with(path, '/{path}')"
        rules.append((fits, rule, verdict))
    whens = " ".join(f"WHEN {fits} THEN '{rule}'" for fits, rule, _ in rules)
    said = " ".join(f"WHEN '{rule}' THEN '{verdict}'" for _, rule, verdict in rules)
    globs = " OR ".join(f"regexp_matches('.' || host || path, '{_glob_regex(g)}')" for g in url_filters.BLOCK_GLOBS)
    return f"""
    WITH cut AS (
        SELECT page_id,
               coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
               coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
        FROM pages),
    ruled AS (SELECT *, CASE {whens} END AS rule FROM cut)
    SELECT page_id, host, path, rule,
           CASE rule {said} ELSE CASE WHEN {globs} THEN 'block' ELSE 'allow' END END AS verdict
    FROM ruled"""


def _chat_sql() -> str:
    def broken(column: str) -> str:
        out = f"replace({column}, '\\', '\\\\')"
        for mark in chat_format.CONTROL:
            out = f"replace({out}, '{mark}', '{mark[0]}\\{mark[1:]}')"
        return out

    frame = " ".join(f"WHEN '{role}' THEN {len(a) + len(b)}" for role, (a, b) in chat_format._MARKS.items())
    return f"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
        UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
           sum(length({broken('text')}) + CASE role {frame}
               ELSE length(replace({broken('role')}, chr(10), '\\n')) + 15 END)::BIGINT AS formatted_chars
    FROM turns GROUP BY conv_id"""


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    bit = "xor(x >> 1, 3988292384 * (x & 1))"
    byte = f"list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: {bit})"
    codes = f"list_transform(string_split({text}, ''), lambda c: ord(c)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda a, b: {byte}), 4294967295::BIGINT)"


_RUNS_SQL = f"""
    WITH cut AS (SELECT doc_id, {_crc32("doc_id::VARCHAR")} AS h, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    placed AS (SELECT *, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) ELSE 0 END AS a, (h // 10) % 8 AS e FROM cut),
    period AS (SELECT *, 1 + (n - a) // (3 + e) AS p FROM placed),
    docs AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE w END AS w FROM period),
    words AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS x FROM docs),
    matches AS (SELECT l.doc_id, r.i - l.i AS q, l.i FROM words l JOIN words r ON l.doc_id = r.doc_id AND l.x = r.x AND r.i > l.i WHERE 4 * (r.i - l.i) <= l.n),
    islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM matches),
    found AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
    runs AS (SELECT doc_id, start, length, min(q) AS period FROM found GROUP BY 1, 2, 3),
    best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) AS k FROM runs),
    listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM runs GROUP BY 1),
    gone AS (SELECT DISTINCT w.doc_id, w.i FROM words w JOIN runs r ON w.doc_id = r.doc_id AND w.i >= r.start + r.period AND w.i < r.start + r.length),
    kept AS (SELECT w.doc_id, string_agg(w.x, ' ' ORDER BY w.i) AS collapsed FROM words w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.i = g.i WHERE g.i IS NULL GROUP BY 1)
    SELECT d.doc_id, coalesce(l.n_runs, 0)::BIGINT AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli,
           sha256(coalesce(l.runs, '')) AS runs_sha256, sha256(coalesce(k.collapsed, '')) AS collapsed_sha256
    FROM docs d LEFT JOIN listed l USING (doc_id) LEFT JOIN best b ON b.doc_id = d.doc_id AND b.k = 1 LEFT JOIN kept k ON k.doc_id = d.doc_id"""


def _repair_sql() -> str:
    """The repair as a walk over the rows with the cheapest way into each state of the grammar: nothing yet (s0), behind a
    system (s1), user (s2) or assistant (s3) row."""
    pack = lambda cost, audit, out: f"struct_pack(cost := {cost}, audit := {audit}, out := {out})"
    step = lambda s, cost, letter, line: f"CASE WHEN {s} IS NOT NULL THEN {pack(f'{s}.cost + {cost}', f"{s}.audit || '{letter}'", f'{s}.out || {line}')} END"
    insert = lambda s, role: step(s, 2, "I", f"chr(10) || '{role}:'")
    delete = lambda s: step(s, 3, "D", "''")
    keep = lambda s, first: f"CASE WHEN ok AND letter = '{first}' THEN {step(s, 'more', 'K', "chr(10) || role || ':' || text")} END"
    change = lambda s, role: f"CASE WHEN ok THEN {step(s, '2 + more', 'R', f"chr(10) || '{role}:' || text")} END"
    least = lambda *ways: f"list_min([{', '.join(ways)}])"
    user = [w for s in ("s0", "s1", "s3") for w in (keep(s, "u"), change(s, "user"))]
    start = pack("0", "''", "''")
    return f"""
    WITH RECURSIVE known AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            {_crc32("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS d FROM conversations),
    damaged AS (SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
            unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM known),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k FROM damaged),
    flagged AS (SELECT *, substr(role, 1, 1) AS letter, regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS last,
            row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) AS nth, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM placed),
    judged AS (SELECT *, CASE WHEN last = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM flagged),
    ready AS (SELECT *, fault IN ('', 'truncated') AS ok, CASE fault WHEN 'truncated' THEN 1 ELSE 0 END AS more FROM judged),
    ids AS (SELECT DISTINCT conv_id FROM conversations),
    walk AS (SELECT conv_id, 0::BIGINT AS k, {start} AS s0, CASE WHEN false THEN {start} END AS s1, {pack("2", "'I'", "chr(10) || 'user:'")} AS s2,
            {pack("4", "'II'", "chr(10) || 'user:' || chr(10) || 'assistant:'")} AS s3 FROM ids
        UNION ALL
        SELECT conv_id, k, r0, r1, t2, {least("r3", insert("t2", "assistant"))}
        FROM (SELECT *, {least("r2", insert("r0", "user"), insert("r1", "user"), insert("r3", "user"))} AS t2
            FROM (SELECT w.conv_id, r.k, {delete("s0")} AS r0, {least(delete("s1"), keep("s0", "s"))} AS r1, {least(delete("s2"), *user)} AS r2,
                    {least(delete("s3"), keep("s2", "a"), change("s2", "assistant"))} AS r3
                FROM walk w JOIN ready r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.k = w.k + 1))),
    ends AS (SELECT conv_id, arg_max(list_min([s0, s3]), k) AS e FROM walk GROUP BY 1),
    figures AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
            count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE k > 1 AND (before || letter) NOT IN ('su', 'ua', 'au')) AS illegal FROM ready GROUP BY 1)
    SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
           coalesce(illegal, 0)::BIGINT AS illegal, (e.cost)::BIGINT AS cost, e.audit AS audit, sha256(substr(e.out, 2)) AS repaired_sha256
    FROM ids i LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM i.conv_id"""


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_url_filters": op2_url_filters,
    "op3_chat_format": op3_chat_format,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_bpe": op5_bpe,
    "op6_quality_rules": op6_quality_rules,
    "op7_toxicity": op7_toxicity,
    "op8_minhash_neardup": op8_minhash_neardup,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_line_dedup": op10_line_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_language_id": op13_language_id,
}
ORACLES = {
    "op2_url_filters": _url_sql(),
    "op3_chat_format": _chat_sql(),
    "op11_periodic_runs": _RUNS_SQL,
    "op12_conversation_repair": _repair_sql(),
}

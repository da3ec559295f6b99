import re

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import answers, chunking, conversations


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()[0]


def test_lexical_tokens_of_mixed_text(spark):
    got = one(spark, "虚拟内存 Page table 栈", X.tokenize_lexical)
    assert got == ["虚拟内存", "虚拟", "拟内", "内存", "虚拟内", "拟内存", "page", "table", "栈", "栈"]


def test_tokens_of_constants_are_the_same(spark):
    for text in ("", "虚拟内存 Page table 栈", "一二三四五六七八九", "a_B-9 İK", *(w for ws in (X.P.SYNONYMS, X.P.ALIASES) for k, v in ws.items() for w in (k, *v))):
        assert one(spark, text, X.tokenize_lexical) == one(spark, text, lambda c, t=text: X.constant_tokens(t))


def test_long_cjk_runs_give_grams_only(spark):
    got = one(spark, "一二三四五六七八九", X.tokenize_lexical)
    assert "一二三四五六七八九" not in got and len(got) == 8 + 7


@pytest.mark.parametrize("value", [None, "", "   "])
def test_empty_texts(spark, value):
    for f in (X.tokenize_lexical, X.tokenize_embedding, X.tokenize_citation, X.query_phrases, X.split_sentences, chunking.window_text):
        assert one(spark, value, f) == []
    assert one(spark, value, X.pick_keyword) == "核心概念"


def test_embedding_tokens_pair_across_gaps(spark):
    assert one(spark, "A_b 页x表", X.tokenize_embedding) == ["a", "b", "页", "x", "表", "页表"]


def test_citation_tokens_drop_stop_chars_but_not_their_pairs(spark):
    assert one(spark, "栈是 a ok", X.tokenize_citation) == ["栈", "栈是", "ok"]


def test_query_normalisation(spark):
    assert one(spark, "请问什么是 TLB", X.normalize_query).split() == ["是", "tlb"]
    assert one(spark, "第3 章 2024", lambda c: X.query_tokens(X.normalize_query(c))) == ["第", "第", "章", "章", "2024"]
    assert one(spark, "如何映射地址 ab", X.query_phrases) == ["映射地址", "ab"]


def test_expansion_by_trigger_and_shared_token(spark):
    got = one(spark, "映射", lambda c: X.expand_query(c, X.tokenize_lexical(c)))
    assert got[0] == "映射" and "页表" in got and "地址转换" in got


def test_sentences_keep_labels(spark):
    text = "# 标题\n- 栈是后进先出。[L1] [W2] 队列不同！\n1. 版本 3.14 很好"
    assert one(spark, text, X.split_sentences) == ["栈是后进先出。[L1] [W2]", "队列不同！", "版本 3.14 很好"]


def test_compact_sentence_and_compress(spark):
    assert one(spark, "a" * 50 + ". " + "b" * 200, X.compact_sentence) == "a" * 50 + "."
    assert one(spark, "b" * 200, X.compact_sentence) == "b" * 150 + "..."
    long = " ".join(f"w{i}" for i in range(200))
    got = one(spark, long, X.compress_text)
    assert len(got) == 261 and " ... " in got and got.endswith("w199")


def test_bounded_join_clips_and_stops(spark):
    got = spark.createDataFrame([(["ab", "", "cdef", "gh"],)], "p array<string>").select(X.bounded_join(F.col("p"), 6).alias("x")).first()[0]
    assert got == "ab\ncd…"


def test_coercions(spark):
    rows = spark.createDataFrame([("7",), ("x",), (None,), ("999",)], "t string")
    assert [r[0] for r in rows.select(X.coerce_int(F.col("t"), 25, 5, 240)).collect()] == [7, 25, 25, 240]
    assert [r[0] for r in rows.select(X.coerce_score(F.col("t"))).collect()] == [7, 50, 50, 100]


def test_sections_and_windows(spark):
    text = "intro\n# One\nbody\n\n## Two \nmore"
    got = one(spark, text, chunking.split_sections)
    assert [(s.title, s.text) for s in got] == [("", "intro"), ("One", "One\nbody"), ("Two", "Two\nmore")]
    windows = one(spark, "x" * 1000, chunking.window_text)
    assert [len(w) for w in windows] == [520, 520, 120]


def test_follow_up_signals_and_numbered_reference(spark):
    assert one(spark, "这道 第 二 题 怎么做", conversations.follow_up_signals) == ["这道", "第二问"]
    assert one(spark, "复杂度呢？", conversations.follow_up_signals) == ["short_follow_up"]
    turns = spark.createDataFrame([("第2题怎么做", ["1. 旧的一 2. 旧的二", "1. 证明 A 2. 求 B 的值"])], "q string, t array<string>")
    assert turns.select(conversations.extract_reference(F.col("q"), F.col("t"))).first()[0] == "求 B 的值"
    assert [one(spark, n, conversations.numeral) for n in ("7", "三", "十", "十二", "二十", "四十五")] == [7, 3, 10, 12, 20, 45]


def test_claims_have_four_reasons(spark):
    labels = spark.createDataFrame([(1, "L1", "stack push pop order lifo")], "answer_id int, label string, quote string")
    rows = [(1, "stack push pop order lifo! [L1] alpha beta gamma delta! [L1] stack push pop order! [W9] stack push pop order! ok?")]
    out = answers.check_claims(spark.createDataFrame(rows, "answer_id int, answer string"), labels).orderBy("claim_ord").collect()
    assert [r.reason for r in out] == ["ok", "low_overlap", "unknown_citation", "missing_citation", "non_assertive"]


def test_white_space_of_any_kind(spark):
    import random
    import re

    rnd = random.Random(3)
    spaces = " \t\n\r\x0b\x0c\x85\xa0     　"
    values = ["".join(rnd.choice(spaces + "   ab\x1c​栈") for _ in range(rnd.randint(0, 16))) for _ in range(300)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    out = {r.i: (r.c, r.s) for r in rows.select("i", X.collapse(F.col("t")).alias("c"), X.strip(F.col("t")).alias("s")).collect()}
    run = f"[{spaces}]+"
    assert out == {i: (re.sub(run, " ", v).strip(" "), re.sub(f"^{run}|{run}$", "", v)) for i, v in enumerate(values)}


def test_texts_of_every_white_space_collapse_alike(spark):
    odd = "\t\n\x0b\x0c\r\x85\xa0       　"
    texts = [f"a{s}b {s}c{s} d  e{s}" for s in odd] + [" a b ", "a\n\nb", "a​b", "", "  "]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.text: r.c for r in rows.select("text", X.collapse(F.col("text")).alias("c")).collect()}
    assert got == {t: re.sub(f"[ {odd}]+", " ", t).strip(" ") for t in texts}


def test_a_text_of_line_feeds_only_is_cut_like_any_other(spark):
    texts = ["# a\nb\n\n## c\nd", "x\n# y", "#no\n\n", "a\r\n# b\rc"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [[(s.title, s.text) for s in r.s] for r in rows.select(chunking.split_sections(F.col("text")).alias("s")).collect()]
    assert got == [[("a", "a\nb"), ("c", "c\nd")], [("", "x"), ("y", "y")], [("", "#no")], [("", "a"), ("b", "b\nc")]]


def test_sentences_are_cut_like_by_one_pattern(spark):
    import random

    rnd = random.Random(5)
    pieces = ["stack", " ", ".", "!", "?", "；", "。", "[L1]", "[2]", " [W3]", "\n", "\r\n", "- ", "1. ", "# x", "栈", "\u3000", "$1", "\\"]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 25))) for _ in range(400)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r.s for r in rows.select("i", X.split_sentences(F.col("text")).alias("s")).collect()}

    def plain(text):
        out = []
        for line in re.split(r"\r\n|[\n\r]", text):
            line = line.strip(" \t\u3000")
            if line and not line.startswith("#"):
                line = re.sub(r"(?a)^\s*\d+[.)、]\s+", "", re.sub(r"(?a)^\s*[-*+]\s+", "", line))
                out += re.findall(r"([^。！？!?；;]*[。！？!?；;](?:\s*\[[A-Za-z]?\d+\])*|[^。！？!?；;]+$)", line)
        return [s for s in (p.strip(" \t\u3000") for p in out) if s]

    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_a_long_line_without_stops_is_one_sentence(spark):
    import time

    line = "栈 push. " * 400_000
    began = time.perf_counter()
    assert one(spark, line, X.split_sentences) == [line.strip()]
    assert time.perf_counter() - began < 10


def test_counted_tokens_and_keywords(spark):
    from collections import Counter
    import random

    rnd = random.Random(7)
    texts = [" ".join(rnd.choice(("a", "bb", "Cc", "dd", "ee_1", "F")) for _ in range(rnd.randint(0, 12))) for _ in range(200)] + ["\u0130b \u212aB KB", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("tokens", X.tokenize_lexical(F.col("text")))
    for r in rows.select("text", "tokens", X.counted(F.col("tokens")).alias("c"), X.pick_keyword(F.col("text")).alias("k"), X.pick_keyword(F.col("text"), F.col("tokens")).alias("known")).distinct().collect():
        assert r.tokens == [t.lower() for t in re.findall("[A-Za-z0-9_]+", r.text)]
        assert [(c.token, c.n) for c in r.c] == sorted(Counter(r.tokens).items())
        seen = [t for t in r.tokens if len(t) > 1]
        assert r.k == r.known == (max(seen, key=Counter(seen).get) if seen else "核心概念"), r

"""Every operator on null and large ids, clashing column names, empty tables, repeated rows and very long texts."""

import random

import public_tokenizers
import pytest

from lectern.llm import bpe, chat_format, decontamination, knn_quality, line_templates, neardup, quality_rules, substring_dedup, toxicity, url_filters

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BIG = 2**53
rnd = random.Random(77)
LONG = " ".join(f"w{rnd.randrange(5000)}x" for _ in range(120_000))
PLAIN = " ".join(f"w{rnd.randrange(5000)}x" for _ in range(90))
IDS = [None, BIG, BIG + 1, 1, 1, 2, 3, 4, None]
TEXTS = [PLAIN, PLAIN + " y", "other words " * 9, "same", "same", None, "", LONG, " \n\t "]
#: Names that the operators use inside, and one that no schema string could hold.
CLASH = ["score", "digest", "rep", "h", "key", "at", "start", "leaf", "template", "judged", "coded", "made", "counts", "stratum", "a`b", "a b.c"]
ROWS = {
    4: lambda d, b, y: knn_quality.quality_scores(d, y),
    5: lambda d, b, y: bpe.encode_documents(d, PATH, public_tokenizers.PATTERN),
    6: lambda d, b, y: quality_rules.quality_rules(d, y),
    7: lambda d, b, y: toxicity.toxicity_scores(d, y),
    8: lambda d, b, y: neardup.near_duplicates(d),
    10: lambda d, b, y: line_templates.drop_recurring_lines(d),
}
FOUND = {1: lambda d, b, y: decontamination.find_leaks(d, b), 9: lambda d, b, y: substring_dedup.repeated_spans(d)}


@pytest.fixture(scope="module")
def tables(spark):
    schema = "doc_id long, text string, lang string, " + ", ".join(f"`{c.replace('`', '``')}` int" for c in CLASH)
    docs = spark.createDataFrame([(i, t, "en" if t else None, *range(len(CLASH))) for i, t in zip(IDS, TEXTS)], schema)
    bench = spark.createDataFrame([(BIG + 1, PLAIN, 0), (None, PLAIN, 0), (BIG, None, 0)], "item_id long, text string, h int")
    labels = spark.createDataFrame([(1, 1, 0, 5), (BIG, 0, 1, 5), (None, 1, 1, 5), (2, None, None, 5)], "doc_id long, quality int, toxic int, y int")
    return docs, bench, labels


def order(ids):
    return sorted(ids, key=lambda i: (i is None, i or 0))


@pytest.mark.parametrize("n", ROWS)
def test_every_row_comes_through_with_its_id(tables, n):
    out = ROWS[n](*tables).collect()
    assert order(r.doc_id for r in out) == order(IDS)


@pytest.mark.parametrize("n", [*ROWS, *FOUND])
def test_empty_tables_give_no_row(tables, n):
    docs, bench, labels = tables
    run = {**ROWS, **FOUND}[n]
    assert run(docs.limit(0), bench, labels).count() == 0
    if n in FOUND:
        assert n == 9 or run(docs, bench.limit(0), labels).count() == 0
    else:
        assert run(docs, bench, labels.limit(0)).count() == len(IDS)


def test_lines_are_dropped_beside_any_columns(tables):
    docs, _, _ = tables
    out = line_templates.drop_recurring_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "dropped"] and {r["a`b"] for r in out.collect()} == {CLASH.index("a`b")}


def test_scores_and_leaks_keep_all_columns(tables):
    docs, bench, labels = tables
    assert sorted(knn_quality.with_scores(docs, labels).columns) == sorted(docs.columns)
    kept = decontamination.decontaminate(docs, bench)
    assert kept.columns == docs.columns and order(r.doc_id for r in kept.collect()) == [1, 1, 2, 3, 4, BIG + 1, None, None]


def test_leaks_and_spans_name_the_right_ids(tables):
    docs, bench, _ = tables
    assert [(r.doc_id, r.item_id) for r in decontamination.find_leaks(docs, bench).collect()] == [(BIG, BIG + 1)]
    rows = docs.filter("doc_id is not null").unionByName(docs.filter(f"doc_id = {BIG}").selectExpr(f"{BIG} + 1 as doc_id", *[f"`{c.replace('`', '``')}`" for c in docs.columns[1:]]))
    assert {(r.doc_id, r.first_doc_id) for r in substring_dedup.repeated_spans(rows).collect()} == {(BIG + 1, BIG)}


def test_urls_keep_their_ids(spark):
    rows = [(None, "http://a.net/", 1), (BIG, None, 1), (BIG + 1, "http://b.org/fr/", 1), (BIG + 1, "http://b.org/fr/", 1), (5, "", 1), (6, "http://c.com/" + "d/" * 100_000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, judged int")
    out = url_filters.filter_urls(pages)
    assert order(r.page_id for r in out.collect()) == order(r[0] for r in rows) and url_filters.filter_urls(pages.limit(0)).count() == 0


def test_conversations_keep_their_ids(spark):
    rows = [(None, 0, "user", "a", 1), (BIG, 0, "user", "b", 1), (BIG + 1, 0, "user", LONG, 1), (BIG + 1, 0, "user", LONG, 1), (BIG + 1, None, None, None, 1)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece int")
    out = chat_format.conversation_digests(chat_format.format_turns(table)).collect()
    assert {r.conv_id: r.n_turns for r in out} == {None: 1, BIG: 1, BIG + 1: 3}
    assert chat_format.conversation_digests(chat_format.format_turns(table.limit(0))).count() == 0


def test_conversations_of_text_ids(spark):
    rows = [("a-1", 0, "user", "x"), ("a-1", 1, "assistant", "y"), ("007", 0, "user", "z"), (None, 0, "user", "w")]
    table = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    out = chat_format.conversation_digests(chat_format.format_turns(table)).collect()
    assert {r.conv_id: r.n_turns for r in out} == {"a-1": 2, "007": 1, None: 1}


def test_a_template_that_breaks_its_declaration_late_is_an_error():
    late = chat_format.Template(lambda turns: "".join(f"<{t}{'!' if turns.index((r, t)) > 0 and t == 'k30' else ''}>" for r, t in turns), reach=0)
    renderer = chat_format.Renderer(late)
    with pytest.raises(ValueError):
        for k in range(40):
            renderer.add(("user", f"k{k}"), False)
    steady = chat_format.Renderer(chat_format.INST_TEMPLATE)
    pieces = [steady.add(("user", f"k{k}"), True) for k in range(200)]
    assert all(p[1] == sum(len(q[0]) for q in pieces[:k]) for k, p in enumerate(pieces)) and len(steady.turns) <= 2


def test_local_and_whole_rendering_agree_on_both_sides_of_the_probe():
    texts = ["</s>[INST] ok", "a\\b", "", "[TURN x\n"]
    for n in (chat_format.PROBE - 1, chat_format.PROBE, chat_format.PROBE + 1, 3 * chat_format.PROBE):
        local, whole = chat_format.Renderer(chat_format.INST_TEMPLATE), chat_format.Renderer(chat_format.Template(chat_format.INST_TEMPLATE.render))
        for k in range(n):
            turn = (("user", "assistant", "system", "odd\n")[k % 4], texts[k * 7 % 4])
            assert local.add(turn, True) == whole.add(turn, True)

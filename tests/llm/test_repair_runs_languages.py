"""Operators 11 to 13 against plain searches and held-out labels, and on odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import conversation_repair, language_id, periodic_runs, queries

SF = "/root/testdata/sf0.001"
BIG = 2**53
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


# 11: periodic runs


def plain_runs(words, least=6, exponent=4):
    """Every lag, every stretch."""
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i > start and i - start + q >= max(least, exponent * q):
                found.setdefault((start, i - start + q), q)
            i += i == start or i + q < n
    return sorted((s, n, q) for (s, n), q in found.items())


def test_runs_equal_a_search_of_all_lags():
    rnd = random.Random(11)
    for _ in range(1500):
        n, kinds = rnd.randint(0, 120), rnd.randint(1, 5)
        own = [rnd.randrange(kinds) for _ in range(n)]
        for _ in range(rnd.randint(0, 2)):
            if n > 8:
                a, p = rnd.randrange(n), rnd.randint(1, 12)
                for i in range(a, min(n, a + rnd.randint(5, 70))):
                    own[i] = own[a + (i - a) % p]
        least, exponent = (6, 4) if rnd.random() < 0.5 else (rnd.randint(1, 40), rnd.randint(3, 6))
        assert periodic_runs.find_runs(np.array(own, np.int64), least, exponent) == plain_runs(own, least, exponent)


def test_runs_of_giant_texts_end_soon():
    for own in (np.zeros(300_000, np.int64), np.tile(np.arange(33_333), 9)):
        ((start, length, period),) = periodic_runs.find_runs(own)
        assert (start, length) == (0, len(own)) and period in (1, 33_333)


def planted(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n or doc_id is None:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected_runs(doc_id, text):
    words = planted(doc_id, text)
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    milli = 1000 * best[1] // best[2] if runs else None
    return (len(runs), *best, milli, sha(listed), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_equals_the_plain_search_on_a_table(spark):
    texts = {(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r.text or "") < 20_000}
    ids = {i for i, _ in texts}
    out = {r.doc_id: tuple(r)[1:] for r in queries.op11_periodic_runs(spark, SF).collect()}
    assert len(texts) > 150 and sum(out[i][0] > 0 for i in ids) > 15
    for i, text in texts:
        assert out[i] == expected_runs(i, text), i


def test_runs_of_odd_rows(spark):
    long = " ".join(f"w{k % 977}" for k in range(60_000))
    rows = [(None, "a a a a a a a"), (BIG + 1, None), (BIG, ""), (1, " \n\t "), (1, " \n\t "), (2, "x y x y " * 3), (3, long), (4, "a a a a a b")]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, found int, runs int, `a b.c` int")
    out = periodic_runs.periodic_runs(docs)
    assert out.columns == ["doc_id", "text", "found", "a b.c", "n_words", "runs", "collapsed"]
    got = {(r.doc_id, r.text): ([tuple(x) for x in r.runs], r.collapsed, r.n_words, r["a b.c"]) for r in out.collect()}
    assert out.count() == len(rows) and got[None, "a a a a a a a"] == ([(0, 7, 1)], "a", 7, 3)
    assert got[BIG + 1, None] == got[BIG, ""] == got[1, " \n\t "] == ([], "", 0, 3)
    assert got[2, rows[5][1]][0] == [(0, 6, 1)] and got[4, "a a a a a b"][0] == []
    assert got[3, long][:1] == ([(0, 60_000, 977)],) and len(got[3, long][1].split()) == 977
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(docs, exponent=2)


# 12: repair of conversations


def row_faults(rows):
    """The first fault of each (role, text)."""
    seen, out = set(), []
    for role, text in rows:
        marks = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not marks else "duplicate" if (role, text) in seen else "" if marks[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def every_repair(rows, found, most=2):
    """(cost, audit, roles) by trying all edits, with up to `most` insertions at each place."""
    choices = []
    for (role, _), fault in zip(rows, found, strict=True):
        own = [(3, "D", [])]
        if fault not in ("blank", "duplicate"):
            more = int(fault == "truncated")
            own += [(more, "K", [role])] + [(2 + more, "R", [r]) for r in ("user", "assistant")]
        choices.append(own)
    added = [(2 * n, "I" * n, list(roles)) for n in range(most + 1) for roles in itertools.product(("user", "assistant"), repeat=n)]
    slots = [added]
    for own in choices:
        slots += [own, added]
    for way in itertools.product(*slots):
        roles = [r for _, _, new in way for r in new]
        if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r in roles)):
            yield sum(c for c, _, _ in way), "".join(a for _, a, _ in way), roles


def by_states(rows, found):
    """The least (cost, audit) and the repaired rows, row by row over the states of the language, with insertions."""
    move = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    roles = {"u": "user", "a": "assistant"}

    def inserted(best):
        for _ in range(3):
            for state, (cost, audit, out) in list(best.items()):
                for letter, role in roles.items():
                    to = move.get((state, letter))
                    if to and (cost + 2, audit + "I") < best.get(to, (1e9, ""))[:2]:
                        best[to] = (cost + 2, audit + "I", [*out, role + ":"])
        return best

    best = inserted({"": (0, "", [])})
    for (role, text), fault in zip(rows, found, strict=True):
        after = {}
        for state, (cost, audit, out) in best.items():
            ways = [(3, "D", state, [])]
            if fault not in ("blank", "duplicate"):
                more = int(fault == "truncated")
                if role and (state, role[0]) in move:
                    ways.append((more, "K", move[state, role[0]], [f"{role}:{text}"]))
                ways += [(2 + more, "R", move[state, x], [f"{r}:{text}"]) for x, r in roles.items() if (state, x) in move]
            for add, letter, to, line in ways:
                if (cost + add, audit + letter) < after.get(to, (1e9, ""))[:2]:
                    after[to] = (cost + add, audit + letter, out + line)
        best = inserted(after)
    return min(best[s] for s in ("", "a") if s in best)


def test_audits_equal_trying_all_edits():
    rnd = random.Random(12)
    parser = conversation_repair.Parser(conversation_repair.RepairGrammar())
    codes = {"": 0, "truncated": 1, "duplicate": 2, "blank": 3}
    for n in (0, 1, 1, 1, 2, 2, 2, 2, 3, 3):
        rows = [(rnd.choice(["system", "user", "assistant", "tool", ""]), rnd.choice(["Yes.", "No", "", "Well!"])) for _ in range(n)]
        found = row_faults(rows)
        least = min((c, a) for c, a, _ in every_repair(rows, found, 1 if n > 2 else 2))
        assert by_states(rows, found)[:2] == least
        if rows:
            cost, parts = parser.parts([parser.leaf(r[:1], codes[f]) for (r, _), f in zip(rows, found, strict=True)])
            assert (cost, "".join(a for _, a in parts)) == least, rows


def test_every_cut_into_pieces_gives_the_same_audit():
    rnd = random.Random(5)
    parser = conversation_repair.Parser(conversation_repair.RepairGrammar())
    names = {"s": "system", "u": "user", "a": "assistant", "t": "tool"}
    kinds = ["", "truncated", "duplicate", "blank"]
    for _ in range(150):
        rows = [(rnd.choice("suuuaaat"), rnd.choice([0, 0, 0, 1, 2, 3])) for _ in range(rnd.randint(1, 40))]
        leaves = [parser.leaf(*r) for r in rows]
        cuts = sorted({0, len(rows), *(rnd.randrange(len(rows)) for _ in range(3))})
        cells = [parser.levels(leaves[a:b])[-1][0] for a, b in zip(cuts, cuts[1:], strict=False)]
        cost, parts = parser.parts(cells)
        plain = by_states([(names[x], f"{i}") for i, (x, _) in enumerate(rows)], [kinds[f] for _, f in rows])
        assert (cost, "".join(a for _, a in parts)) == plain[:2]
        lines = []
        for (state, audit), a, b in zip(parts, cuts, cuts[1:], strict=False):
            for at, edit, given in parser.replay(state, audit, "".join(x for x, _ in rows[a:b])):
                if edit != "D":
                    lines.append((given or names[rows[a + at][0]]) + ":" + ("" if edit == "I" else str(a + at)))
        assert lines == plain[2]


def damaged_rows(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text, kind = role if role is not None else " ", text if text is not None else " ", zlib.crc32(key.encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def expected_report(rows, ids):
    out = {}
    for conv in ids:
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))
        turns = {r[0] for r in own if r[0] is not None}
        pairs = [r[1:] for r in own]
        found = row_faults(pairs)
        cost, audit, lines = by_states(pairs, found)
        letters = [r[:1] for r, _ in pairs]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(lines)))
    return out


def test_query_equals_the_plain_repair_on_a_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = {r[0]: tuple(r)[1:] for r in queries.op12_conversation_repair(spark, "/root/testdata/sf0.01").collect()}
    assert out == expected_report(damaged_rows(rows), {r[0] for r in rows})


def test_repair_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(conversation_repair, "PIECE", 4)  # conversations in many pieces
    rnd = random.Random(8)
    rows = [(None, 0, "user", "Hi."), (BIG + 1, None, None, None), (BIG, 3, "assistant", "x " * 50_000), (5, None, "user", "b."), (5, None, "user", "a.")]
    rows += [(7, rnd.choice([None, *range(40)]), rnd.choice(["user", "assistant", "tool", ""]), rnd.choice(["One.", "Two", "", f"{k}."])) for k in range(90)]
    rows += [(8, 1, "user", "same.")] * 30 + [(9, 0, "assistant", " \n")]
    schema = "conv_id long, turn long, role string, text string, at int, piece int, `a b.c` int"
    table = spark.createDataFrame([(*r, 1, 1, 1) for r in rows], schema)
    ids = spark.createDataFrame([(i,) for i in (None, BIG + 1, BIG, 5, 7, 8, 9, 11)], "conv_id long")
    out = {r[0]: tuple(r)[1:] for r in conversation_repair.repair_report(table, ids).collect()}
    plain = [tuple(" " if x is None and k > 1 else x for k, x in enumerate(r)) for r in rows]
    assert out == expected_report(plain, [r[0] for r in ids.collect()])
    assert out[11] == (0, 0, 0, 0, 0, 0, "", sha(""))
    empty = conversation_repair.repair_conversations(table.limit(0))
    assert empty.rows().count() == 0 and empty.figures.count() == 0
    texts = table.withColumn("conv_id", F.concat(F.lit("c"), F.coalesce(F.col("conv_id").cast("string"), F.lit("?"))))
    repaired = conversation_repair.repair_conversations(texts).rows().filter("conv_id = 'c8'").collect()
    assert [(r.role, r.text, r.edit) for r in sorted(repaired, key=lambda r: (r["at"], r.k))][:1] == [("user", "same.", "K")]


def test_a_grammar_of_other_roles():
    grammar = conversation_repair.RepairGrammar(3, 0, (0, 2), {(0, "q"): 1, (1, "r"): 2, (2, "q"): 1}, ("question", "reply"))
    parser = conversation_repair.Parser(grammar)
    cost, parts = parser.parts([parser.leaf(x, 0) for x in "qqr"])
    assert (cost, "".join(a for _, a in parts)) == (2, "KIKK")
    with pytest.raises(ValueError):
        conversation_repair.RepairGrammar(moves={(0, "u"): 3, (0, "a"): 3})


# 13: languages


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.document_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(out) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r.held_out]
    assert len(held) > 150 and sum(r.lang_pred == r.lang for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in out)


def test_labels_of_held_out_rows_and_other_columns_do_not_matter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = ~language_id.learnable(F.col("doc_id"))
    other = docs.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    first, second = ({tuple(r) for r in language_id.document_languages(d).collect()} for d in (docs, other))
    assert first == second


def test_the_filter_holds_all_grams_and_few_others(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter(language_id.learnable(F.col("doc_id")))
    model = language_id.learn(docs, F.lit(True), min_share=0.1)
    grams = language_id.GramHashes()
    rows = docs.select("lang", "text").distinct().collect()
    noise = np.random.default_rng(3).integers(0, 2**63, 100_000).astype(np.uint64)
    for i, lang in enumerate(model.languages):
        seen, n = {}, 0
        for r in rows:
            if r.lang == lang:
                n += 1
                for h in set(np.concatenate(list(language_id.text_blocks(grams, r.text))).tolist()):
                    seen[h] = seen.get(h, 0) + 1
        kept = np.array([h for h, c in seen.items() if c >= max(0.1 * n, min(2, n))], np.uint64)
        assert len(kept) and model.counts(kept)[i] == len(kept)
        assert model.counts(noise)[i] / len(noise) <= 2 * model.passed[i] + 1e-4 <= 0.03
    found = [m | 0 for m in model.masks(noise[:100])]
    assert len(found) == 1 and found[0].dtype == np.uint8


def test_more_languages_than_a_byte_has_bits(spark):
    rnd = random.Random(4)
    letters = "абвгдежзийклмнопрстуфхцчшщъыьэюя" + "αβγδεζηθικλμνξοπρστυφχψω" + "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for k in range(20):
        own = [letters[4 * k % 80 + j] for j in range(4)]
        rows += [(100 * k + i, " ".join("".join(rnd.choice(own) for _ in range(5)) for _ in range(60)), f"l{k:02d}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in language_id.document_languages(docs).collect()}
    assert all(out[i].lang_pred == lang for i, _, lang in rows)


def test_languages_of_odd_rows(spark):
    long = "der die das und nicht " * 30_000
    rows = [(i, f"der die das und nicht {i}", "de") for i in range(20)] + [(i, f"the of and with that {i}", "en") for i in range(20, 50)]
    odd = [(None, "the of"), (BIG + 1, None), (BIG, ""), (60, "12 34 !"), (61, long), (61, long), (62, "日本語"), (63, " ")]
    schema = "doc_id long, text string, lang string, found int, score int, `a b.c` int"
    docs = spark.createDataFrame([(*r, 1, 1, 1) for r in [*rows, *((i, t, None) for i, t in odd)]], schema)
    out = language_id.document_languages(docs)
    got = {r.doc_id: (r.lang_pred, r.held_out) for r in out.collect()}
    assert out.count() == len(rows) + len(odd) and got[None] == ("en", False) and got[61][0] == "de" and got[62][0] == "en"
    assert {got[i][0] for i in (BIG + 1, BIG, 60, 63)} == {"und"}
    model = language_id.learn(docs, F.lit(True))
    assert language_id.with_language(docs, model).columns == ["doc_id", "text", "lang", "found", "a b.c", "lang_pred", "score"]
    assert language_id.document_languages(docs.limit(0)).count() == 0
    nothing = language_id.document_languages(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


def test_blocks_of_a_text_hold_each_gram_once(monkeypatch):
    grams, rnd = language_id.GramHashes(), random.Random(1)
    text = "".join(rnd.choice("abc d1É") for _ in range(5000))
    whole = np.sort(np.concatenate(list(language_id.text_blocks(grams, text))))
    monkeypatch.setattr(language_id, "BLOCK", 700)
    assert np.array_equal(whole, np.sort(np.concatenate(list(language_id.text_blocks(grams, text)))))

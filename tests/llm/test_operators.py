import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lectern.llm import (
    bpe,
    chat_format,
    decontamination,
    knn_quality,
    line_templates,
    neardup,
    quality_rules,
    substring_dedup,
    toxicity,
    url_filters,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def docs(spark, texts, extra=""):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in (texts.items() if isinstance(texts, dict) else enumerate(texts))]
    return spark.createDataFrame(rows, DOCS)


def words(rnd, n, size=400):
    return " ".join(f"w{rnd.randrange(size)}x" for _ in range(n))


EDGE = {0: None, 1: "", 2: "  \n\t ", 3: "one", 4: "one", 5: "ÀÉ ß 日本語 😀", 6: "a " * 30_000}


# 5: byte-level BPE


def test_bpe_equals_the_library_and_comes_back():
    import tiktoken

    coder = bpe.load_encoder(PATH, public_tokenizers.PATTERN)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    rnd = random.Random(3)
    letters = list("abcdefgh 'st\n\t.,!12é日　\x1c\x85\xa0😀ñß")
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 80))) for _ in range(3000)]
    texts += ["a" * 3000, " " * 500, "don't we'll", "x\r\n\r\n y ", "".join(rnd.choice("abcdefghij") for _ in range(4000))]
    for text in texts:
        ids = coder.encode(text)
        assert ids == own.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()


def test_bpe_rows(spark):
    out = {r.doc_id: r for r in bpe.encode_documents(docs(spark, EDGE), PATH, public_tokenizers.PATTERN).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert out[0].n_tokens == 0 and out[0].ids_sha256 == empty == out[1].decoded_sha256
    assert out[3].ids == out[4].ids and out[6].n_tokens == len(out[6].ids)
    back = bpe.decode_documents(spark.createDataFrame([(r.doc_id, r.ids) for r in out.values()], "doc_id long, ids array<int>"), PATH, public_tokenizers.PATTERN)
    assert {r.doc_id: r.text for r in back.collect()} == {k: v or "" for k, v in EDGE.items()}
    assert bpe.encode_documents(docs(spark, []), PATH, public_tokenizers.PATTERN).count() == 0


# 2: URL filters


def test_url_rules_and_globs(spark):
    urls = ["https://a.example.net/en/1", "http://example.net/fr", "http://example.net", "HTTP://X.EXAMPLE.com/de/y?u=/q", None, "no url", "http://foo.org/fr/ads/x",
            "http://foo.com/x.net/y", "http://foo.com/a/ads/b", "http://foo.com/b.exe", "http://foo.com/" + "a/" * 20_000 + "login", "http://notexample.net.com/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, html string")
    out = {r.page_id: (r.host, r.rule, r.verdict) for r in url_filters.filter_urls(pages).collect()}
    assert out[0] == ("a.example.net", "example.net/en/", "allow") and out[1][1:] == ("net/", "block")
    assert out[2] == ("example.net", None, "allow")  # its path does not begin with /
    assert out[3] == ("x.example.com", "example.com/de/", "block") and out[4] == out[5] == ("", None, "allow")
    assert out[6][1:] == ("org/fr/", "allow") and out[7][1:] == (None, "allow")
    assert [out[i][2] for i in (8, 9, 10, 11)] == ["block", "block", "block", "allow"]


def test_automaton_equals_regular_expressions():
    import re

    from lectern.llm.queries import _glob_regex

    rnd = random.Random(5)
    globs = ["".join(rnd.choice(["a", "b", "/", "*", "**", "?"]) for _ in range(rnd.randint(1, 9))).replace("***", "**") for _ in range(60)]
    urls = ["".join(rnd.choice("ab/") for _ in range(rnd.randint(0, 12))) for _ in range(300)]
    got = url_filters.GlobAutomaton(globs).match([u.encode() for u in urls])
    for j, glob in enumerate(globs):
        pattern = re.compile(_glob_regex(glob))
        assert [bool(pattern.match(u)) for u in urls] == got[:, j].tolist()


# 3: chat formatting


def test_chat_round_trip_and_control_strings(spark):
    tricky = "</s>[INST] ok [/INST] \\ \\\\ <\\s> [TURN x"
    rows = [(1, 0, "user", tricky), (1, 1, "assistant", tricky), (2, 0, "tool", None), (2, 1, None, "x"), (None, 0, "user", "u"), (3, 0, "assistant", "a"), (3, 0, "assistant", "a")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = chat_format.format_turns(table)
    out = {r.conv_id: r for r in chat_format.conversation_digests(turns).collect()}
    expected = hashlib.sha256(f"user\n{tricky}\nassistant\n{tricky}\n".encode()).hexdigest()
    assert out[1].turns_sha256 == expected and out[1].loss_sha256 == hashlib.sha256(tricky.encode()).hexdigest()
    assert out[1].loss_chars == len(tricky) and out[2].n_turns == 2 and out[3].n_turns == 2 and out[None].n_turns == 1
    text = "".join(r.piece for r in turns.filter("conv_id = 1").orderBy("ord").collect())
    assert len(text) == out[1].formatted_chars and text.count("</s>") == 1


def _conversation(spark, n, conv=1):
    rows = [(conv, k, "user" if k % 2 == 0 else "assistant", f"think{k}|say{k}") for k in range(n)]
    return [r[2:] for r in rows], spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def _rebuilt(rows):
    """The outputs after each turn, from the rows' starts and pieces alone."""
    text, out = "", []
    for r in rows:
        text = text[: r.start] + r.piece
        assert len(text) == r.end
        out.append(text)
    return out


def test_rewriting_templates_are_found(spark):
    def render(turns):  # shows reasoning in the last turn only
        return "".join(f"<{r}>{t if i == len(turns) - 1 else t.split('|')[-1]};" for i, (r, t) in enumerate(turns))

    turns, table = _conversation(spark, 4)
    for reach in (None, 0, 2):  # a wrong declaration is noticed
        out = chat_format.format_turns(table, chat_format.Template(render, reach)).orderBy("ord").collect()
        assert [r.rewrites_history for r in out] == [False, True, True, True]
        assert _rebuilt(out) == [render(turns[: k + 1]) for k in range(4)]
        assert [o[r.loss_start : r.loss_end] for r, o in zip(out, _rebuilt(out)) if r.role == "assistant"] == [turns[1][1], turns[3][1]]
        assert all((r.loss_start is None) == (r.role == "user") for r in out)


def test_a_late_rewrite_and_a_template_that_counts(spark):
    def late(turns):  # hides the first turn once there are more than 20
        return "".join("gone;" if i == 0 and len(turns) > 20 else f"{r}:{t};" for i, (r, t) in enumerate(turns))

    def counting(turns):
        return "".join(f"#{i} {r}:{t};" for i, (r, t) in enumerate(turns))

    turns, table = _conversation(spark, 24)
    out = chat_format.format_turns(table, chat_format.Template(late)).orderBy("ord").collect()
    assert [r.ord for r in out if r.rewrites_history] == [20] and _rebuilt(out)[-1] == late(turns)
    for reach in (None, 1):
        out = chat_format.format_turns(table, chat_format.Template(counting, reach)).orderBy("ord").collect()
        assert not any(r.rewrites_history for r in out) and _rebuilt(out)[-1] == counting(turns)
        assert all(counting(turns)[r.loss_start : r.loss_end] == turns[r.ord][1] for r in out if r.role == "assistant")


def test_templates_that_look_back_a_turn(spark):
    def render(turns):  # names the role before
        return "".join(f"({turns[i - 1][0] if i else ''}>{r}) {t};" for i, (r, t) in enumerate(turns))

    turns, table = _conversation(spark, 60)
    out = chat_format.format_turns(table, chat_format.Template(render, reach=1)).orderBy("ord").collect()
    assert _rebuilt(out)[-1] == render(turns) and all(render(turns)[r.loss_start : r.loss_end] == turns[r.ord][1] for r in out if r.role == "assistant")


def test_texts_that_a_template_does_not_show_have_no_span(spark):
    _, table = _conversation(spark, 2)
    out = chat_format.format_turns(table, chat_format.Template(lambda turns: "".join(f"{r} says {len(t)};" for r, t in turns))).collect()
    assert all(r.loss_start is None and r.loss_end is None for r in out)


def test_roles_with_line_breaks_come_back(spark):
    roles = ["a\nb", "\\n", "x\\\ny", "[TURN", "user"]
    rows = [(1, k, r, f"t{k}") for k, r in enumerate(roles)]
    turns = chat_format.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    (out,) = chat_format.conversation_digests(turns).collect()
    assert out.turns_sha256 == hashlib.sha256("".join(f"{r}\nt{k}\n" for k, r in enumerate(roles)).encode()).hexdigest()


def test_long_conversations_take_the_same_spans(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"t{k}") for k in range(60)]
    out = chat_format.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("ord").collect()
    assert "".join(r.piece for r in out) == chat_format.INST_TEMPLATE.render([(r[2], r[3]) for r in rows])


# 6: quality rules


def test_counts_against_the_definition():
    rnd = random.Random(2)
    for _ in range(200):
        text = "".join(rnd.choice(["a", "b", "c", " ", " ", "\n", "#", "é", "\x0b"]) for _ in range(rnd.randint(0, 60)))
        n_words, chars, symbols, dups, repeated, *_ = quality_rules.text_counts(text)
        import re

        own = re.findall("[^\x20\x09-\x0d]+", text)
        windows = [tuple(own[i : i + 3]) for i in range(len(own) - 2)]
        covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        assert (n_words, chars, symbols, repeated) == (len(own), sum(map(len, own)), text.count("#"), len(covered))
        assert dups == sum(x in lines[:i] for i, x in enumerate(lines))


def test_binomial_bound_is_exact():
    assert abs(quality_rules.binomial_upper(0, 100, 0.05) - (1 - 0.05**0.01)) < 1e-9
    upper = quality_rules.binomial_upper(3, 50, 0.05)
    import math

    assert abs(sum(math.comb(50, k) * upper**k * (1 - upper) ** (50 - k) for k in range(4)) - 0.05) < 1e-9
    assert quality_rules.binomial_upper(5, 5, 0.05) == 1.0


def test_rules_keep_good_and_drop_bad(spark):
    rnd = random.Random(1)
    good = {i: words(rnd, 80, 5000) for i in range(900)}
    bad = {1000 + i: " ".join(w + "###" for w in words(rnd, 80, 5000).split()) for i in range(20)}
    labels = spark.createDataFrame([(i, 1, 0) for i in good] + [(i, 0, 0) for i in bad], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality_rules.quality_rules(docs(spark, {**good, **bad, 2000: None, 2001: ""}), labels).collect()}
    assert all(out[i].kept for i in good) and not any(out[i].kept for i in bad)
    assert out[2000].base_failed and not out[2001].kept


def test_rules_work_on_few_labels_and_copies_are_one_trial(spark):
    rnd = random.Random(3)
    good = {i: words(rnd, 80, 5000) for i in range(250)}
    bad = {1000 + i: " ".join(w + "###" for w in words(rnd, 80, 5000).split()) for i in range(20)}
    labels = spark.createDataFrame([(i, 1, 0) for i in good], "doc_id long, quality int, toxic int")
    out = quality_rules.quality_rules(docs(spark, {**good, **bad}), labels).collect()
    assert all(r.kept == (r.doc_id in good) for r in out)
    copies = docs(spark, {**{i: good[0] for i in range(250)}, **bad})
    assert all(r.kept for r in quality_rules.quality_rules(copies, labels).collect())


def test_any_number_of_strata(spark):
    rnd = random.Random(4)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(600)], "doc_id long, quality int, toxic int")
    out = quality_rules.quality_rules(docs(spark, [words(rnd, 60, 5000) for _ in range(600)]), labels, stratum="doc_id")
    assert out.count() == 600 and all(r.kept for r in out.collect())


def test_a_bad_stratum_under_many_clean_ones_keeps_its_guarantee(spark):
    """Of stratum b 5 % of the good documents are in capitals; its own bound fails, whatever the others allow."""
    rnd = random.Random(6)
    texts = {i: words(rnd, 55, 5000) for i in range(4400)}
    for i in range(4000, 4020):
        texts[i] = texts[i].upper()
    rows = [(i, t, "b" if i >= 4000 else "a", "s", len(t)) for i, t in texts.items()]
    junk = [(5000 + i, words(rnd, 55, 5000).upper(), lang, "s", 1) for i, lang in enumerate("ab")]
    labels = spark.createDataFrame([(i, 1, 0) for i in texts], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame(rows + junk, DOCS), labels).collect()}
    rejected = {s: sum(not out[i] for i in texts if (i >= 4000) == (s == "b")) for s in "ab"}
    assert rejected["a"] <= 0.02 * 4000 and rejected["b"] <= 0.02 * 400
    assert not out[5000]  # in a, where the rules are certified, junk goes


def test_cutoffs_equal_a_search_by_the_binomial_law(spark):
    import math

    def bound_holds(wrong, n, risk, level):  # the chance of so few errors, were the risk at its limit
        return sum(math.comb(n, k) * risk**k * (1 - risk) ** (n - k) for k in range(wrong + 1)) <= level

    def passed(n, errors, level):
        return next((i for i, e in enumerate(errors) if e >= 0.02 * n or not bound_holds(e, n, 0.02, level)), len(errors))

    rnd = random.Random(5)
    for _ in range(12):
        counts = {s: (n, sorted(min(n, rnd.choice([0, 0, 1, 3, 9, 40])) for _ in range(6))) for s in ["a", "b", "c", "d"][: rnd.randint(1, 4)] for n in [rnd.randint(1, 900)]}
        table = spark.createDataFrame([(s, n, *e) for s, (n, e) in counts.items()], "stratum string, n long, " + ", ".join(f"e{i} long" for i in range(6)))
        chosen, overall = quality_rules.choose_steps(table, 6, 0.02, 0.05)
        got = {r.stratum: r.taken for r in chosen.collect()}
        level = 0.025 / len(counts)
        assert got == {s: passed(n, e, level) for s, (n, e) in counts.items() if bound_holds(0, n, 0.02, level)}
        assert overall == passed(sum(n for n, _ in counts.values()), [sum(e[i] for _, e in counts.values()) for i in range(6)], 0.025)
    none, overall = quality_rules.choose_steps(table.limit(0), 6, 0.02, 0.05)
    assert none.count() == 0 and overall == 0


# 4 and 7: classifiers


@pytest.fixture(scope="module")
def labelled(spark):
    rnd = random.Random(7)
    texts, labels = {}, []
    for i in range(500):
        junk, rude = i % 4 == 0, i % 5 == 0
        own = words(rnd, 60, 3000).split()
        if junk:
            own = [w.upper() + "!!" for w in own]
        if rude:
            own[5], own[30], own[40] = "idiot", "1d1ot", "you"
        texts[i] = " ".join(own)
        labels.append((i, int(not junk), int(rude)))
    rows = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return docs(spark, {**texts, 9001: None, 9002: "", 9003: "word"}), rows


def test_quality_on_held_out(spark, labelled):
    table, labels = labelled
    out = knn_quality.quality_scores(table, labels)
    both = out.join(labels, "doc_id").filter("held_out").collect()
    assert len(both) > 100 and sum(r.predicted == r.quality for r in both) >= 0.97 * len(both)
    assert all(0 <= r.score <= 1 for r in out.collect()) and out.count() == table.count()
    assert {r.score for r in knn_quality.quality_scores(table.limit(3), labels.limit(0)).collect()} == {0.5}


def test_scores_equal_a_plain_vote(spark, labelled):
    table, labels = labelled
    model = knn_quality.fit(table, labels, 1500, 48)
    out = {r.doc_id: r.score for r in knn_quality.quality_scores(table, labels).collect()}
    texts = {r.doc_id: r.text for r in table.collect()}
    sample = sorted((r.doc_id, r.quality) for r in labels.collect() if not (zlib.crc32(str(r.doc_id).encode()) % 3 == 1))
    vectors = knn_quality.TextVectors()
    n = [sum(q == y for _, q in sample) for y in (0, 1)]
    latent = {i: vectors.row(texts[i]) @ model["directions"] for i in texts}
    for i in [*range(0, 500, 25), 9003]:
        def cosine(j):
            return float(latent[i] @ latent[j] / (np.linalg.norm(latent[i]) * np.linalg.norm(latent[j])))

        near = sorted(((-cosine(j), j, y) for j, y in sample if texts[j] != texts[i]))[:15]
        votes = [(max(-c, 0) ** 8 / n[y], y) for c, _, y in near]
        assert abs(out[i] - sum(w for w, y in votes if y) / sum(w for w, _ in votes)) < 1e-3, i
    assert out[9001] == out[9002] == 0.0


def test_ties_go_to_the_lower_column():
    rnd = np.random.default_rng(2)
    cosine = rnd.integers(0, 5, (50, 30)).astype(np.float32)
    got = knn_quality.nearest(cosine, 7)
    for row, near in zip(cosine, got, strict=True):
        assert set(near.tolist()) == set(sorted(range(30), key=lambda c: (-row[c], c))[:7])


def test_toxic_features_against_the_definition():
    rnd = random.Random(31)
    of = toxicity.ToxicFeatures(["idiot", "moron"], ["blick", "idiom*"])
    names = toxicity.FEATURES
    for _ in range(200):
        own = [rnd.choice(["idiot", "Moron!", "you", "the", "BLICK", "1d1ot", "fine", "OK!!", "x2", "a", "idiomatic"]) for _ in range(rnd.randint(1, 30))]
        row = dict(zip(names, of.row(" ".join(own)), strict=True))
        core = [w.strip("!").lower() for w in own]
        hits = [i for i, w in enumerate(core) if w in ("idiot", "moron", "blick", "1d1ot")]
        persons = [i for i, w in enumerate(core) if w == "you"]
        n = len(own)
        expected = {
            "insults": 100 * sum(w in ("idiot", "moron") for w in core) / n,
            "learned": 100 * core.count("blick") / n,
            "obfuscated": 100 * core.count("1d1ot") / n,
            "second_person": 100 * len(persons) / n,
            "near_second_person": np.log1p(sum(any(abs(h - p) <= 5 for p in persons) for h in hits)),
            "capitals": sum(w in ("BLICK", "OK!!") for w in own) / n,
            "exclamations": sum(w.count("!") for w in own) / n,
            "punctuation": sum(w.count("!") for w in own) / n,
            "mixed_digits": sum(w in ("1d1ot", "x2") for w in own) / n,
            "stems": 100 * core.count("idiomatic") / n,
        }
        assert all(abs(row[k] - v) < 1e-5 for k, v in expected.items()), own


def test_toxicity_on_held_out(spark, labelled):
    table, labels = labelled
    out = toxicity.toxicity_scores(table, labels, trees=4)
    both = out.join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.toxic for r in both) >= 0.97 * len(both)
    assert all(0 <= r.score <= 1 for r in out.collect()) and out.count() == table.count()
    assert {r.score for r in toxicity.toxicity_scores(table, labels.limit(0)).collect()} == {0.0}


# 8: near duplicates


def brute_components(texts, width, percent):
    sets = {}
    for i, t in texts.items():
        own = [w.decode() for w in (t or "").encode().lower().split()]
        sets[i] = {tuple(own[k : k + width]) for k in range(len(own) - width + 1)} if len(own) >= width else ({tuple(own)} if own else set())
    comp = {i: i for i in texts}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                comp[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def test_near_duplicates_equal_brute_force(spark):
    rnd = random.Random(11)
    texts = dict(EDGE)
    for group in range(12):
        base = words(rnd, rnd.choice([4, 20, 60, 200]), 5000).split()
        for _ in range(12):
            own = [w if rnd.random() > 0.03 else f"z{rnd.randrange(999)}" for w in base]
            texts[len(texts) + 100] = " ".join(own) if rnd.random() > 0.2 else " ".join(base)
    table = docs(spark, texts)
    for width, percent in ((3, 85), (5, 80)):
        out = {r.doc_id: r for r in neardup.near_duplicates(table, width, percent).collect()}
        expected, sizes = brute_components(texts, width, percent)
        assert {i: r.component_id for i, r in out.items()} == expected
        assert {i: r.n_shingles for i, r in out.items()} == sizes
        assert all(r.kept == (r.component_id == i) for i, r in out.items())


def test_near_duplicates_of_nothing_and_of_null_ids(spark):
    assert neardup.near_duplicates(docs(spark, [])).count() == 0
    rows = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c")], "doc_id long, text string")
    assert sorted((str(r.component_id), r.kept) for r in neardup.near_duplicates(rows).collect()) == [("1", True), ("1", True), ("None", False)]


def test_texts_of_one_id_are_one_document(spark):
    a, b, c = (f"{x} b c d e f g h i j {x}" for x in ("one", "two", "three"))
    rows = [(3, a), (5, a), (5, b), (7, b), (5, ""), (9, c), (9, c), (11, None), (2**53 + 1, c), (2**53, "own text here"), (None, a)]
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((r.doc_id, r.component_id, r.kept) for r in out if r.doc_id is not None)
    big = 2**53
    assert got == [(3, 3, True), (5, 3, False), (5, 3, False), (5, 3, False), (7, 3, False), (9, 9, True), (9, 9, True), (11, 11, True), (big, big, True), (big + 1, 9, False)]


# 9: substring dedup


def test_repeated_passages_are_cut_once_kept_once(spark):
    rnd = random.Random(4)
    passage = ". ".join(words(rnd, 10, 9000) for _ in range(6)) + "."
    texts = {0: words(rnd, 30) + ".\n" + passage, 1: passage + " " + words(rnd, 30) + ".", 2: words(rnd, 90, 9000), 3: None, 4: "", 5: "short line.", 6: "short line."}
    table = docs(spark, texts).selectExpr("*", "1 as start", "2 as digest", "3 as `a``b`")
    spans = substring_dedup.repeated_spans(table)
    (found,) = spans.collect()
    assert (found.doc_id, found.first_doc_id, found.start) == (1, 0, 0) and 0.8 * len(passage) < found.end <= len(passage)
    out = {r.doc_id: r for r in substring_dedup.remove_spans(table, spans).collect()}
    assert out[1].text == texts[1][found.end :] and all(out[i].text == texts[i] for i in texts if i != 1)
    assert substring_dedup.repeated_spans(docs(spark, [])).count() == 0


def test_copies_leave_the_first_whole(spark):
    rnd = random.Random(9)
    text = ". ".join(words(rnd, 12, 9000) for _ in range(5)) + "."
    rows = [(2**53 + 1, text), (7, text), (3, text), (3, text), (None, text), (2**53, text)]
    found = substring_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.start, r.end, r.first_doc_id) for r in found) == [(i, 0, len(text), 3) for i in (7, 2**53, 2**53 + 1)]


def test_short_sentences_and_characters_belong_to_the_passage(spark):
    rnd = random.Random(21)
    long = [words(rnd, 9, 90_000) + "." for _ in range(4)]
    passage = " ".join(["Not so.", long[0], "Oh yes.", "It is.", long[1], "Who knows?", long[2], "We do.", "You too.", long[3], "All right."])
    short = "\n".join(f"{words(rnd, 2, 90_000)}." for _ in range(30))
    han = "".join(chr(0x4E00 + rnd.randrange(9_000)) + ("\u3002" if i % 12 == 11 else "") for i in range(60))
    shout = " ".join(w.upper() + "!!" for w in words(rnd, 60, 90_000).split())
    for i, part in enumerate([passage, short, han, shout]):
        own = [words(rnd, 30, 90_000) + "." for _ in range(4)]
        texts = {1: f"{own[0]}\n{part}\n{own[1]}", 2: f"{own[2]}\n{part}\n{own[3]}"}
        found = substring_dedup.repeated_spans(docs(spark, texts)).collect()
        assert [(r.doc_id, r.first_doc_id) for r in found] == [(2, 1)], i
        cut = texts[2][found[0].start : found[0].end]
        assert cut.strip() in part and len(cut) > 0.8 * len(part)
    # own units between repeated ones are no part of a passage
    apart = {1: " ".join(long[:2]), 2: f"{long[0]} {short} {long[1]}"}
    assert not substring_dedup.repeated_spans(docs(spark, apart)).collect()


def test_repeats_within_a_text_count_if_asked_for(spark):
    rnd = random.Random(10)
    line = words(rnd, 60, 90_000)
    table = docs(spark, {1: f"{line}\n{words(rnd, 50, 90_000)}\n{line}"})
    assert substring_dedup.repeated_spans(table).count() == 0
    (found,) = substring_dedup.repeated_spans(table, within=True).collect()
    assert found.start > len(line) and found.first_doc_id == 1


def test_units_are_the_text(spark):
    rnd = random.Random(14)
    cut = substring_dedup.Units()
    for _ in range(300):
        text = "".join(rnd.choice(["ab", "c", "\u4e00", "D", "!", ".", " ", " ", "\n", "_"]) for _ in range(rnd.randint(0, 90)))
        found = cut(text)
        own = substring_dedup._WORDS.findall(text)
        assert found[:, 2].sum() == (len(own) if len(own) >= 4 else 0) and (found[:, 2] >= 4).all()
        for start, end, n, before, _ in found.tolist():
            assert substring_dedup._WORDS.findall(text[start:end]) == own[before : before + n]


def test_runs_of_fifty_words_are_found_wherever_they_stand(spark):
    rnd = random.Random(31)
    texts, places = {}, {}
    for k in range(30):
        passage = words(rnd, 50, 90_000)
        for i in range(4 * k, 4 * k + 4):
            before = words(rnd, rnd.randint(0, 60), 90_000)
            texts[i] = f"{before} {passage.upper() if i % 4 == 1 else passage} {words(rnd, rnd.randint(0, 60), 90_000)}"
            places[i] = (len(before), len(before) + 1 + len(passage))
    found = substring_dedup.repeated_spans(docs(spark, texts), within=True).collect()
    assert sorted((r.doc_id, r.first_doc_id) for r in found) == [(i, i - i % 4) for i in texts if i % 4]
    assert all(places[r.doc_id][0] <= r.start and r.end <= places[r.doc_id][1] and 42 <= r.n_words <= 50 for r in found)


def test_texts_that_share_a_run_share_a_passage():
    rnd = random.Random(32)
    for n_words in (1, 5, 42):
        cut = substring_dedup.Passages(n_words)
        for _ in range(200):
            few = rnd.choice([2, 9, 9_000])
            run = words(rnd, n_words + substring_dedup.SLACK, few)
            one, other = (f"{words(rnd, rnd.randint(0, 90), few)} {run} {words(rnd, rnd.randint(0, 90), few)}" for _ in range(2))
            shared = {}
            for i, text in enumerate((one, other)):
                own = substring_dedup._WORDS.findall(text)
                for start, end, n, before, digest in cut(text).tolist():
                    assert substring_dedup._WORDS.findall(text[start:end]) == own[before : before + n] and n == n_words
                    shared.setdefault(digest, ({}, {}))[i][tuple(own[before : before + n])] = True
            assert any(a and b for a, b in shared.values())
            assert all(len(a | b) == 1 for a, b in shared.values())  # equal digests are equal words


def test_planted_runs_are_found_in_whole_tables(spark):
    """Recall and false alarms against a search for all runs of 50 words that two documents share, word by word."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    seen, texts = {}, {}
    for r in table.orderBy("doc_id").collect():
        own = [m for m in substring_dedup._WORDS.finditer(r.text or "")]
        texts[r.doc_id] = own
        for i in range(len(own) - 49):
            run = tuple(m[0].lower() for m in own[i : i + 50])
            if len(set(run)) >= 15:  # not one word over and over
                seen.setdefault(hash(run), []).append((r.doc_id, own[i].start(), own[i + 49].end()))
    repeats, shares = {}, set()
    for places in seen.values():
        if len({d for d, _, _ in places}) > 1:
            shares |= {d for d, _, _ in places}
            for d, a, b in places:
                if d != places[0][0]:
                    repeats.setdefault(d, []).append((a, b))
    spans = {}
    for r in substring_dedup.repeated_spans(table).collect():
        spans.setdefault(r.doc_id, []).append((r.start, r.end))
    within = lambda m, all_: any(a <= m.start() and m.end() <= b for a, b in all_)
    caught = 0
    for d, runs in repeats.items():
        inside = [m for m in texts[d] if within(m, runs)]
        caught += sum(within(m, spans.get(d, [])) for m in inside) >= len(inside) / 2
    clean = [d for d in texts if d not in shares]
    assert len(repeats) > 100 and caught >= 0.95 * len(repeats)
    assert sum(d in spans for d in clean) <= 0.02 * len(clean)


# 10: line dedup


def test_recurring_lines_go_and_copies_stay(spark):
    rnd = random.Random(6)
    texts = {i: f"{words(rnd, 40, 90_000)}\nPage {i} of 99 printed\n{words(rnd, 30, 90_000)}" for i in range(30)}
    copy = words(rnd, 20, 90_000) + "\nown line of the copy\n" + words(rnd, 20, 90_000)
    texts |= {100 + i: copy for i in range(60)} | {200: None, 201: "", 202: "Page 5 of 99 printed"}
    out = {r.doc_id: r for r in line_templates.drop_recurring_lines(docs(spark, texts)).collect()}
    assert all(out[i].dropped == [1] and "printed" not in out[i].text for i in range(30))
    assert all(out[100 + i].text == copy for i in range(60))
    assert out[200].text is None and out[201].text == "" and out[202].text == "" and len(out) == len(texts)


def test_line_dedup_by_join_gives_the_same(spark, monkeypatch):
    rnd = random.Random(8)
    table = docs(spark, {**{i: f"{words(rnd, 40, 90_000)}\nsame foot line\n{words(rnd, 9, 90_000)}" for i in range(15)}, 50: None, 51: "x"})
    first = sorted(map(str, line_templates.drop_recurring_lines(table).collect()))
    monkeypatch.setattr(line_templates, "BROADCAST_TEMPLATES", 0)
    assert sorted(map(str, line_templates.drop_recurring_lines(table).collect())) == first


def test_copies_do_not_keep_a_line_that_recurs_elsewhere(spark):
    rnd = random.Random(15)
    line = "read more about our terms"
    texts = {i: f"{words(rnd, 60, 90_000)}\n{line}\n{words(rnd, 60, 90_000)}" for i in range(12)}
    base = words(rnd, 150, 90_000).split()
    for i in range(100, 300):  # near copies of each other, all different
        own = list(base)
        own[rnd.randrange(150)] = f"own{i}x"
        texts[i] = " ".join(own[:75]) + f"\nfoot of the copies only\n{line}\n" + " ".join(own[75:])
    out = line_templates.drop_recurring_lines(docs(spark, texts)).collect()
    assert all(r.dropped == [2 if r.doc_id >= 100 else 1] for r in out)


def test_templates_of_large_leaves_and_long_lines_recur(spark):
    rnd = random.Random(17)
    names = [f"n{''.join(rnd.choice('abcdefgh') for _ in range(9))}" for _ in range(1_100)]
    long = words(rnd, 80, 90_000).replace("w", "").split()
    long = ["".join("abcdefghij"[int(c)] for c in t if c.isdigit()) for t in long]
    texts = {}
    for i, name in enumerate(names):
        texts[i] = f"{words(rnd, 30, 90_000)}\nSign in as {name} to reply now please\n{words(rnd, 30, 90_000)}"
    for i in range(2_000, 2_012):
        own = list(long)
        own[70] = names[i - 2_000]
        texts[i] = f"{words(rnd, 120, 90_000)}\n{' '.join(own)}\n{words(rnd, 120, 90_000)}"
    # ten lines of one template in a leaf, under a key, of many others that agree with none
    for i in range(3_000, 4_200):
        tail = "x y" if i >= 4_188 else " ".join(rnd.choice(names) for _ in range(2))
        texts[i] = f"{words(rnd, 30, 90_000)}\nSee also the {rnd.choice(names) if i < 4_188 else names[i - 4_188]} page {tail} end\n{words(rnd, 30, 90_000)}"
    out = {r.doc_id: r.dropped for r in line_templates.drop_recurring_lines(docs(spark, texts)).collect()}
    assert all(out[i] == [1] for i in texts if i < 3_000 or i >= 4_188)
    line = {i: texts[i].split("\n")[1].split() for i in range(3_000, 4_188)}
    for i in range(3_000, 4_188, 97):
        agree = sum(sum(a == b for a, b in zip(line[i], texts[j].split("\n")[1].split())) >= 6 for j in range(3_000, 4_200))
        assert out[i] == ([1] if agree >= 10 else [])


def test_lines_meet_across_the_blocks_of_a_key(spark, monkeypatch):
    rnd = random.Random(23)
    line = {i: ["Go", "to", "the"] + [f"{rnd.choice('abcd')}q" for _ in range(5)] for i in range(150)}
    texts = {i: f"{words(rnd, 40, 90_000)}\n{' '.join(t)}\n{words(rnd, 40, 90_000)}" for i, t in line.items()}
    monkeypatch.setattr(line_templates, "BLOCK", 8)
    out = {r.doc_id: r.dropped for r in line_templates.drop_recurring_lines(docs(spark, texts)).collect()}
    agree = {i: sum(sum(a == b for a, b in zip(line[i], t)) >= 6 for t in line.values()) for i in line}
    assert {len(x) for x in out.values()} == {0, 1} and all(out[i] == ([1] if agree[i] >= 10 else []) for i in line)


def test_dropped_lines_equal_a_search_of_all_templates(spark):
    rnd = random.Random(52)
    vocabulary = ["ba", "be", "bi", "bo"]
    texts = {}
    for i in range(160):
        own = [words(rnd, 40, 90_000)]
        for _ in range(rnd.randint(0, 3)):
            lead = rnd.choice(["Go to the", "See all of"])
            own.append(" ".join([lead, *(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 7)))]))
        if rnd.random() < 0.3:
            own.append(f"Page {rnd.randrange(99)} of ours")
        texts[i] = "\n".join([*own, words(rnd, 40, 90_000)])
    masked = {i: [line_templates.mask_line(x) for x in t.split("\n")] for i, t in texts.items()}
    stands = {}
    for i, lines in masked.items():
        for x in lines:
            stands.setdefault(x, set()).add(i)

    def together(a, b):
        x, y = a.split(" "), b.split(" ")
        return a == b or len(x) == len(y) > 3 and x[:3] == y[:3] and sum(map(str.__eq__, x, y)) >= 0.75 * len(x)

    recurs = {a: len(set().union(*(s for b, s in stands.items() if together(a, b)))) >= 10 for a in stands}
    assert {True, False} == {v for a, v in recurs.items() if a.startswith("Go")}
    out = {r.doc_id: r.dropped for r in line_templates.drop_recurring_lines(docs(spark, texts)).collect()}
    assert all(out[i] == [k for k, x in enumerate(lines) if recurs[x]] for i, lines in masked.items())


# 1: decontamination


def test_leaks_exact_upper_case_and_with_other_parameters(spark):
    item = "if Anna buys 12 apples for 3 euros and later sells half of the apples how many euros does Anna get back"
    other = item.replace("Anna", "Bert").replace("12", "50")
    rnd = random.Random(1)
    coins = "so we give 7 coins and then 7 more coins to him"
    texts = {0: words(rnd, 30) + " " + item + ". " + words(rnd, 30), 1: words(rnd, 9) + " " + other, 2: coins.replace("then 7", "then 8"), 3: words(rnd, 200), 4: None, 5: "", 6: "how many euros does", 7: "two words"}
    texts |= {8: "two words more", 9: f"x {coins.replace('7', '9')} y"}
    benchmark = spark.createDataFrame([(1, item), (2, "two words"), (3, None), (4, ""), (None, item), (5, coins), (5, coins)], "item_id long, text string")
    out = {(r.doc_id, r.item_id): r for r in decontamination.find_leaks(docs(spark, texts), benchmark).collect()}
    assert set(out) == {(0, 1), (1, 1), (7, 2), (9, 5)} and out[0, 1].exact and not out[1, 1].exact
    kept = decontamination.decontaminate(docs(spark, texts), benchmark)
    assert {r.doc_id for r in kept.collect()} == {2, 3, 4, 5, 6, 8} and kept.columns == docs(spark, texts).columns


def _brute_leaks(spark, texts, items):
    """Every alignment, every run in it, by the words of the definition."""
    d = decontamination

    def tokens(rows):
        table = spark.createDataFrame(list(rows.items()), "id long, text string").withColumn("raw", d.raw_tokens(F.col("text")))
        return {r.id: (r.raw, r.tokens) for r in table.select("id", "raw", d.template_tokens(F.col("raw")).alias("tokens")).collect()}

    slots = {d.NUMBER, d.NAME, d.UNIT}
    out = set()
    for i, (item_raw, item) in tokens(items).items():
        need, words_ = min(13, len(item)), max(1, min(5, sum(t not in slots for t in item)))
        for j, (raw, own) in tokens(texts).items():
            for shift in range(-len(item) + 1, len(own)):
                if len(item) < 3 and (len(own) != len(item) or shift):
                    continue
                for first in range(len(item)):
                    one, other, n_words = {}, {}, 0
                    for at in range(first, len(item)):
                        k = at + shift
                        if not 0 <= k < len(own) or own[k] != item[at]:
                            break
                        if item[at] in slots:
                            if one.setdefault(item_raw[at], raw[k]) != raw[k] or other.setdefault(raw[k], item_raw[at]) != item_raw[at]:
                                break
                        else:
                            n_words += 1
                        if at - first + 1 >= need and n_words >= words_:
                            out.add((j, i))
    return out


def test_leaks_equal_a_search_of_all_runs_with_slots(spark):
    rnd = random.Random(41)
    items = {}
    for n in [*range(1, 16), 20, 25, 30]:
        items[n] = " ".join(rnd.choice([f"w{rnd.randrange(90)}x".replace("w", "abcdefgh"[rnd.randrange(8)]), str(rnd.randrange(4)), "of"]) for _ in range(n))
        items[n] = items[n].translate(str.maketrans("0123456789", "0123456789")) if n % 2 else "".join(c for c in items[n])
    texts = {}
    for offset in range(13):
        for n, item in items.items():
            own = item.split()
            if rnd.random() < 0.6:  # other parameters, consistent or not
                by = {str(k): str(rnd.randrange(4, 7)) for k in range(4)}
                own = [by.get(t, t) if rnd.random() < 0.95 else t for t in own]
            if rnd.random() < 0.3:
                own = own[: rnd.randint(1, len(own))]
            pad = lambda k: " ".join(f"pad{rnd.choice('abcdef')}" if rnd.random() < 0.8 else str(rnd.randrange(5)) for _ in range(k))
            texts[len(texts)] = f"{pad(offset)} {' '.join(own)} {pad(rnd.randint(0, 6))}".strip()
    expected = _brute_leaks(spark, texts, items)
    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(docs(spark, texts), benchmark).collect()}
    assert got == expected and len({i for _, i in got}) >= 12


def test_a_number_behind_the_leak_does_not_hide_it(spark):
    item = "if Anna buys 12 apples for 3 euros and later sells half of the apples how many does Anna get 12 times"
    leak = " ".join(item.split()[:-2]) + " 77 more"  # its last slot contradicts an earlier one
    both = item.replace("12", "3")  # two values of the item became one
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = {r.doc_id for r in decontamination.find_leaks(docs(spark, {0: leak, 1: item, 2: "x " * 20_000 + item}), benchmark).collect()}
    assert out == {0, 1, 2} == out | _ids(_brute_leaks(spark, {0: leak}, {1: item}))
    assert _ids(_brute_leaks(spark, {5: both}, {1: item})) == {r.doc_id for r in decontamination.find_leaks(docs(spark, {5: both}), benchmark).collect()}


def _ids(pairs):
    return {d for d, _ in pairs}


def test_leaks_equal_a_search_for_runs(spark):
    rnd = random.Random(12)
    items = {i: words(rnd, rnd.randint(14, 40), 90_000) for i in range(10)}
    texts, expected = {}, set()
    for d in range(60):
        own = words(rnd, 50, 90_000).split()
        i, n = rnd.randrange(10), rnd.randint(5, 30)
        part = items[i].split()[:n]
        own[20:20] = part
        texts[d] = " ".join(own)
        if len(part) >= 13:
            expected.add((d, i))
    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.find_leaks(docs(spark, texts), benchmark).collect()} == expected


def test_toxicity_learns_from_few_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs_, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    rows = toxicity.toxicity_scores(docs_, labels).join(labels, "doc_id").filter("held_out").collect()
    toxic, clean = ([r.predicted for r in rows if r.toxic == y] for y in (1, 0))
    assert len(toxic) > 10 and sum(toxic) >= 0.7 * len(toxic) and sum(clean) <= 0.02 * len(clean)

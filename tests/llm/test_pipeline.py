import corpus_pipeline
from lectern.llm import bpe, decontamination, knn_quality, line_templates, neardup

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.cache()
        docs = stage(spark, before, SF).cache()
        assert docs.columns == columns, name
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "quality classifier":
            scores = knn_quality.quality_scores(before, spark.read.parquet(f"{SF}/labels.parquet"))
            assert ids == {r.doc_id for r in scores.filter("predicted = 1").collect()}
        if name == "line dedup":
            cleaned = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
            shown = {r.doc_id: r.text for r in line_templates.drop_recurring_lines(before).collect()}
            assert cleaned == {i: (t, len(t)) for i, t in shown.items()} and set(shown) == {r.doc_id for r in before.collect()}
        if name == "near-duplicates":
            assert ids == {r.doc_id for r in neardup.near_duplicates(before).filter("kept").collect()}
            # and against every pair of word sets, compared one by one
            sets = {}
            for r in before.collect():
                own = r.text.encode().lower().split()
                sets[r.doc_id] = {tuple(own[k : k + 5]) for k in range(len(own) - 4)} if len(own) > 4 else {tuple(own)} - {()}
            links = [(a, b) for a in sets for b in sets if a < b and sets[a] & sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
            group = {i: i for i in sets}
            for _ in range(len(sets)):
                for a, b in links:
                    group[a] = group[b] = min(group[a], group[b])
            assert ids == {i for i, g in group.items() if i == g}
        if name == "decontamination":
            leaks = decontamination.find_leaks(before, spark.read.parquet(f"{SF}/benchmark.parquet"))
            assert ids == {r.doc_id for r in before.select("doc_id").collect()} - {r.doc_id for r in leaks.collect()}
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in out} == ids
    texts = {r.doc_id: r.text for r in docs.collect()}
    coder = bpe.load_encoder(corpus_pipeline.public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), corpus_pipeline.public_tokenizers.PATTERN)
    assert all(r.n_tokens == len(coder.encode(texts[r.doc_id] or "")) for r in out)


def test_ids_with_several_texts_go_or_stay_as_a_whole(spark):
    a, b = ("one two three four five six seven eight nine " + x for x in ("ten", "eleven twelve"))
    rows = [(3, a), (5, a), (5, b), (7, b), (None, a), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source", "length(text) as n_chars")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == [(0, a), (3, a), (8, "")] and out.columns == docs.columns


def test_extra_columns_of_any_name_and_empty_tables_pass_all_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    names = ["score", "n_lines", "dropped", "carried", "b.c", "a`b", "kept", "component_id"]
    wide = docs
    for k, name in enumerate(names):
        wide = wide.withColumn(name, docs["doc_id"] + k)
    wide = wide.cache()
    for rows in (wide, wide.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before, rows = rows, stage(spark, rows, SF).cache()
            assert rows.columns == wide.columns and rows.count() <= before.count(), name
            assert all(r[n] == r.doc_id + k for r in rows.collect() for k, n in enumerate(names)), name
        assert corpus_pipeline.STAGES[-1][1](spark, rows, SF).count() == rows.count()

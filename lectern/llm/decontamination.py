"""Benchmark decontamination by template canonicalisation, DataFrame functions only.

Numbers, names and units become typed placeholders, so that a question whose parameters were changed keeps its
template. Every window of WINDOW template tokens of the benchmark is hashed; of the documents every STRIDE-th window
is, so that any run of SHORT = WINDOW + STRIDE - 1 equal tokens shares a hash. Items of fewer than SHORT tokens are
hashed whole, and the documents' windows of their lengths at every position. Matching windows propose an alignment of a
document with an item. There the tokens are compared one by one: a leak is a run of at least MIN_RUN equal template
tokens (or the whole of a shorter item), enough of them words, with consistent slots inside the run: the same value of
the item always stands for the same value in the document, and the other way round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, sized

WINDOW, STRIDE, MIN_RUN, LEAST_WORDS, LEAST_ITEM = 8, 4, 13, 5, 3
SHORT = WINDOW + STRIDE - 1
UNITS = (
    "km m cm mm mi ft in kg g mg lb oz l ml h min s ms hz khz mhz ghz w kw mw v a k c f mph kmh percent "
    "euro euros dollar dollars usd eur gbp hours minutes seconds days weeks months years"
).split()
#: Marks of a number, a name and a unit, from the private use area; in texts they count as white space.
NUMBER, NAME, UNIT = "\ue001", "\ue002", "\ue003"


def raw_tokens(text: Column) -> Column:
    """Words in lower case; names and units carry their mark in front, numbers begin with a digit."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{NUMBER}-{UNIT}]", " ")
    t = F.regexp_replace(t, r"(?<=\p{N})[.,:/](?=\p{N})", "_")
    t = F.regexp_replace(t, r"(?<=[\p{Ll},;] )(?=\p{Lu}\p{Ll})", NAME)
    t = F.regexp_replace(t, rf"(?<=\p{{N}} )(?=(?:{'|'.join(UNITS)})\b)", UNIT)
    return F.array_remove(F.split(F.lower(t), rf"[^\p{{L}}\p{{N}}_{NUMBER}-{UNIT}]+"), "")


def template_token(token: Column) -> Column:
    first = token.substr(1, 1)
    return F.when(first.isin(NAME, UNIT), first).when(first.between("0", "9"), F.lit(NUMBER)).otherwise(token)


def template_tokens(raw: Column) -> Column:
    return F.transform(raw, template_token)


def _is_slot(token: Column) -> Column:
    return token.isin(NUMBER, NAME, UNIT)


def _windows(tokens: Column, width: int, step: int) -> Column:
    """Hashes of the windows of this width at 0, step, ...; none where there are fewer tokens."""
    starts = F.sequence(F.lit(0), F.size(tokens) - width, F.lit(step))
    return F.when(F.size(tokens) >= width, F.transform(starts, lambda i: F.xxhash64(F.slice(tokens, i + 1, width))))


def _proposals(tokens: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, shift of the alignments that a shared window proposes. tokens: doc_id, tokens; items: item_id,
    item. For each window length (WINDOW and those of the short items, fewer than SHORT in all) one join of hashes."""
    short = F.size("item") < SHORT
    lengths = sorted(r[0] for r in items.filter(short & (F.size("item") >= LEAST_ITEM)).select(F.size("item")).distinct().collect())
    long = items.filter(~short).select("item_id", F.posexplode(_windows(F.col("item"), WINDOW, 1)).alias("item_at", "h")).distinct()
    seen = tokens.select("doc_id", F.posexplode(_windows(F.col("tokens"), WINDOW, STRIDE)).alias("at", "h"))
    found = seen.join(sized(long, 40), "h").select("doc_id", "item_id", (F.col("at") * STRIDE - F.col("item_at")).alias("shift"))
    for n in lengths:
        whole = items.filter(F.size("item") == n).select("item_id", F.xxhash64("item").alias("h"))
        seen = tokens.select("doc_id", F.posexplode(_windows(F.col("tokens"), n, 1)).alias("shift", "h"))
        found = found.unionByName(seen.join(sized(whole, 32), "h").select("doc_id", "item_id", "shift"))
    tiny = items.filter(F.size("item") < LEAST_ITEM).select("item_id", F.xxhash64("item").alias("h"))
    if tiny.limit(1).count():
        whole = tokens.filter(F.size("tokens") < LEAST_ITEM).select("doc_id", F.xxhash64("tokens").alias("h"), F.lit(0).alias("shift"))
        found = found.unionByName(whole.join(sized(tiny, 32), "h").select("doc_id", "item_id", "shift"))
    return found.distinct()


def _best_run(pairs: Column, need_run: Column, need_words: Column) -> Column:
    """run, n_slots, exact of the longest run that qualifies; run 0 without one.

    pairs: same (whether the templates agree), slot, i and d (the item's and the document's values) for each position.
    Position by position, first is where the longest consistent run that ends there begins: behind the last position
    that differs, and behind the last slot of the run whose values contradict those of this position.
    """
    kept = "array<struct<at:int,i:string,d:string>>"
    none = F.struct(F.lit(0).alias("run"), F.lit(0).alias("n_slots"), F.lit(False).alias("exact"))
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("first"), F.array().cast(kept).alias("slots"), none.alias("best"))

    def step(state: Column, p: Column) -> Column:
        wrong = F.transform(F.filter(state.slots, lambda s: (s.i == p.i) != (s.d == p.d)), lambda s: s.at + 1)
        first = F.when(~p.same, state.at + 1).when(p.slot, F.greatest(state.first, F.coalesce(F.array_max(wrong), F.lit(0)))).otherwise(state.first)
        slots = F.filter(state.slots, lambda s: s.at >= first)
        own = F.array(F.struct(state.at.alias("at"), p.i.alias("i"), p.d.alias("d"))).cast(kept)
        slots = F.when(p.same & p.slot, F.concat(slots, own)).otherwise(slots)
        return F.struct((state.at + 1).alias("at"), first.alias("first"), slots.alias("slots"), state.best.alias("best"))

    def judged(state: Column, p: Column) -> Column:
        # the run is judged on the state that has taken the position in, bound once
        after = F.transform(F.array(step(state, p)), _judge)
        return F.element_at(after, 1)

    def _judge(s: Column) -> Column:
        run = s.at - s.first
        enough = (run >= need_run) & (run - F.size(s.slots) >= need_words) & (run > s.best.run)
        values = F.size(F.array_distinct(F.transform(s.slots, lambda x: x.i)))
        own = F.struct(run.alias("run"), values.alias("n_slots"), (~F.exists(s.slots, lambda x: x.i != x.d)).alias("exact"))
        return F.struct(s.at.alias("at"), s.first.alias("first"), s.slots.alias("slots"), F.when(enough, own).otherwise(s.best).alias("best"))

    return F.aggregate(pairs, zero, judged, lambda s: s.best)


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, run (longest qualifying run), n_tokens (of the item), n_slots (its different values in the run),
    exact (whether the run's placeholders hold the item's own values): one row for each document and the item it leaks.

    A run needs MIN_RUN tokens, LEAST_WORDS of them words (of a shorter item all, its words). An item of fewer than
    LEAST_ITEM tokens says too little and leaks only through a text that consists of it; one without words never does.
    An item that leaks in several places or texts of a doc_id has one row, that of its longest run (of runs that tie, an
    exact one). Null ids on either side never match; null or empty texts have no tokens; texts of any length are searched
    whole. Repeated rows count once. Empty tables give no row; other columns are not read.
    """
    items = benchmark.filter("item_id is not null").select("item_id", raw_tokens(F.col("text")).alias("item_raw"))
    items = items.withColumn("item", template_tokens(F.col("item_raw"))).filter(F.size("item") > 0).distinct()
    items = sized(items, 32 + 2 * F.length(F.concat_ws("  ", "item_raw")) + 16 * F.size("item"))
    texts = docs.filter("doc_id is not null and text is not null").select("doc_id", "text")
    tokens = texts.select("doc_id", template_tokens(raw_tokens(F.col("text"))).alias("tokens"))
    hits = sized(_proposals(tokens, items), 40)
    aligned = texts.join(hits, "doc_id").join(items, "item_id")
    aligned = aligned.withColumn("doc_raw", raw_tokens(F.col("text"))).drop("text")
    skip = F.greatest(-F.col("shift"), F.lit(0))
    doc_part = F.slice("doc_raw", F.col("shift") + skip + 1, F.size("item") - skip)
    aligned = aligned.withColumn("doc_part", doc_part).withColumn("skip", skip).drop("doc_raw")
    pairs = F.transform(
        F.arrays_zip(
            F.col("doc_part").alias("d"),
            F.slice("item_raw", F.col("skip") + 1, F.size("doc_part")).alias("i"),
            F.slice("item", F.col("skip") + 1, F.size("doc_part")).alias("t"),
        ),
        lambda p: F.struct((template_token(p.d) == p.t).alias("same"), _is_slot(p.t).alias("slot"), p.i.alias("i"), p.d.alias("d")),
    )
    n_words = F.size(F.filter("item", lambda t: ~_is_slot(t)))
    need_run = F.least(F.lit(MIN_RUN), F.size("item"))
    need_words = F.greatest(F.lit(1), F.least(F.lit(LEAST_WORDS), n_words))
    judged = aligned.select("doc_id", "item_id", F.size("item").alias("n_tokens"), need_run.alias("need_run"), need_words.alias("need_words"), pairs.alias("pairs"))
    judged = judged.withColumn("best", _best_run(F.col("pairs"), F.col("need_run"), F.col("need_words"))).filter("best.run > 0")
    best = judged.groupBy("doc_id", "item_id").agg(F.max("n_tokens").alias("n_tokens"), F.max(F.struct("best.run", "best.exact", "best.n_slots")).alias("best"))
    return best.select("doc_id", "item_id", "best.run", "n_tokens", "best.n_slots", "best.exact")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose doc_id leaks no item; rows without doc_id stay. The rest is as find_leaks
    says."""
    leaking = sized(find_leaks(docs, benchmark).select("doc_id").distinct(), 16)
    return docs.join(leaking, "doc_id", "left_anti").select(*map(quoted, docs.columns))

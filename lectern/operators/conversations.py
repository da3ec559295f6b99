"""Conversations: turns, follow-up questions, statistics, memory of topics.

messages: conv_id, turn, role, content, and created_at where times are needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import params as P
from lectern.functions import text as X


def pair_turns(messages: DataFrame) -> DataFrame:
    """conv_id, turn, user_text, assistant_text, turn_text: every user message with the answer right behind it."""
    text = X.collapse(F.col("content"))
    rows = messages.select("conv_id", "turn", F.lower("role").alias("role"), text.alias("text")).filter("text <> '' and role in ('user', 'assistant')")
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = rows.withColumns({"next_role": F.lead("role").over(w), "next_text": F.lead("text").over(w)}).filter("role = 'user'")
    answer = F.when(F.col("next_role") == "assistant", F.col("next_text")).otherwise("")
    rows = rows.select("conv_id", "turn", F.col("text").alias("user_text"), answer.alias("assistant_text"))
    both = F.concat(F.lit("用户："), F.col("user_text"))
    return rows.withColumn("turn_text", F.when(F.col("assistant_text") != "", F.concat(both, F.lit("\n助手："), F.col("assistant_text"))).otherwise(both))


def recent_turns(turns: DataFrame, n: int = 3, max_chars: int = 650) -> DataFrame:
    """conv_id, n_turns, context: the last n turns of each conversation, compressed and joined."""
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    last = turns.withColumn("back", back).filter(F.col("back") <= n).groupBy("conv_id")
    texts = last.agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "turn_text"))), lambda x: x.turn_text).alias("texts"))
    return texts.select("conv_id", F.size("texts").alias("n_turns"), "texts", X.bounded_join(F.transform("texts", X.compress_text), max_chars).alias("context"))


def follow_up_signals(question: Column) -> Column:
    """What marks a question as a follow-up, in order, each once."""
    text = X.collapse(question)
    number = F.regexp_extract(text, P.QUESTION_REFERENCE, 1)
    found = [F.when(text.contains(t), F.lit(t)) for t in P.FOLLOW_UP_TERMS]
    found.append(F.when(number != "", F.concat(F.lit("第"), number, F.lit("问"))))
    short = text.rlike(P.SHORT_FOLLOW_UP) | ((F.length(text) <= 8) & text.endswith("呢"))
    found.append(F.when(short, F.lit("short_follow_up")))
    return F.array_distinct(F.array_compact(F.array(*found)))


def numeral(text: Column) -> Column:
    """Arabic digits, or Chinese numerals up to 99; null for others."""
    digits = "一二三四五六七八九"
    value = lambda c: F.when(c != "", F.nullif(F.call_function("instr", F.lit(digits), c), F.lit(0)))
    left, right = F.substring_index(text, "十", 1), F.substring_index(text, "十", -1)
    tens = F.coalesce(value(left), F.lit(1)) * 10 + F.coalesce(value(right), F.lit(0))
    return F.when(text.rlike(r"^\d+$"), text.try_cast("int")).when(text.contains("十"), tens).otherwise(value(text))


def numbered_items(text: Column) -> Column:
    """array<struct<number, content>> of a text's numbered items."""
    mark = r"(?:^|(?<=[\s:：。；;？?！!]))第?\s*([一二三四五六七八九十\d]+)[.、)）]"
    split = F.split(text, r"(?:^|(?<=[\s:：。；;？?！!]))(?=第?\s*[一二三四五六七八九十\d]+[.、)）])")
    parts = F.filter(split, lambda p: p.rlike("^" + mark))
    return F.transform(parts, lambda p: F.struct(numeral(F.regexp_extract(p, mark, 1)).alias("number"), X.collapse(F.regexp_replace(p, "^" + mark, "")).alias("content")))


def extract_reference(question: Column, turns: Column, max_chars: int = 420) -> Column:
    """The item that the question names by number, of the newest turn that has it; '' without one. turns: old to new."""
    wanted = numeral(F.regexp_extract(X.text_or_empty(question), P.QUESTION_REFERENCE, 1))
    items = F.transform(F.reverse(turns), lambda t: F.try_element_at(F.filter(numbered_items(t), lambda i: (i.number == wanted) & (i.content != "")), F.lit(-1)).content)
    return X.let(F.filter(items, lambda i: i.isNotNull()), lambda found: X.bounded_join(F.slice(found, 1, 1), max_chars))


def contextual_query(questions: DataFrame, messages: DataFrame, n: int = 3, max_chars: int = 900) -> DataFrame:
    """query_id, retrieval_query, is_follow_up, signals, context_turns_used, referenced_text. questions: query_id,
    conv_id, question."""
    spark_turns = recent_turns(pair_turns(messages), n)
    rows = questions.join(spark_turns, "conv_id", "left").withColumn("original", X.collapse(F.col("question")))
    rows = rows.withColumn("signals", follow_up_signals(F.col("original")))
    rows = rows.withColumn("follows", (F.size("signals") > 0) & (F.coalesce("n_turns", F.lit(0)) > 0))
    referenced = F.when(F.col("follows"), extract_reference(F.col("original"), F.coalesce("texts", X.empty_strings()))).otherwise("")
    rows = rows.withColumn("referenced_text", referenced)
    context = F.when(F.col("referenced_text") != "", F.col("referenced_text")).otherwise(F.col("context"))
    joined = X.bounded_join(F.array(F.lit("对话上下文"), context, F.lit("当前追问"), F.col("original")), max_chars)
    return rows.select(
        "query_id", F.when(F.col("follows"), joined).otherwise(F.col("original")).alias("retrieval_query"), F.col("follows").alias("is_follow_up"),
        "signals", F.when(F.col("follows"), F.col("n_turns")).otherwise(0).alias("context_turns_used"), "referenced_text",
    )


def conversation_stats(messages: DataFrame, reads: DataFrame | None = None) -> DataFrame:
    """conv_id, title, message_count, last_turn, unread_count. reads: conv_id, last_read (a turn); without a row all
    answers are unread."""
    rows = messages if reads is None else messages.join(reads, "conv_id", "left")
    seen = F.lit(None).cast("long") if reads is None else F.col("last_read")
    unread = (F.lower("role") == "assistant") & (seen.isNull() | (F.col("turn") > seen))
    title = F.min_by(F.when(F.lower("role") == "user", F.substr(X.strip(F.col("content")), F.lit(1), F.lit(24))), F.when(F.lower("role") == "user", F.col("turn")))
    return rows.groupBy("conv_id").agg(
        F.coalesce(title, F.lit("")).alias("title"), F.count("*").alias("message_count"), F.max("turn").alias("last_turn"), F.count_if(unread).alias("unread_count")
    )


def conversation_list(messages: DataFrame, reads: DataFrame | None = None) -> DataFrame:
    """course_id, conv_id, title, message_count, unread_count, updated_at, position: the conversations of each course,
    the last active first. messages: course_id, conv_id, role, content, created_at; reads: course_id, conv_id,
    last_read_at. Messages of users and assistants count; a conversation is named by its first question that is not
    blank, else 新对话; answers later than the last reading are unread."""
    key = ["course_id", "conv_id"]
    rows = messages if reads is None else messages.join(reads, key, "left")
    read_at = F.lit(None).cast("timestamp") if reads is None else F.col("last_read_at")
    role, said = F.lower("role"), X.strip(F.col("content"))
    asks = (role == "user") & (said != "")
    unread = (role == "assistant") & (read_at.isNull() | (F.col("created_at") > read_at))
    title = F.min_by(F.when(asks, F.substr(said, F.lit(1), F.lit(24))), F.when(asks, F.col("created_at")))
    out = rows.groupBy(*key).agg(
        F.coalesce(title, F.lit("新对话")).alias("title"), F.count_if(role.isin("user", "assistant")).alias("message_count"), F.count_if(unread).alias("unread_count"), F.max("created_at").alias("updated_at")
    )
    return out.withColumn("position", F.row_number().over(Window.partitionBy("course_id").orderBy(F.desc("updated_at"), "conv_id")))


def memory_topic(question: Column) -> Column:
    """The first three terms that are neither stop terms nor numbers; else the first 24 characters."""
    terms = F.regexp_extract_all(F.lower(X.text_or_empty(question)), F.lit(r"([A-Za-z0-9_]+|[一-鿿]{2,})"), F.lit(1))
    useful = F.filter(terms, lambda t: ~t.isin(*P.MEMORY_STOPS) & ~t.rlike(r"^\d+$"))
    topic = F.array_join(F.slice(useful, 1, 3), " / ")
    head = F.substr(X.text_or_empty(question), F.lit(1), F.lit(24))
    return F.when(topic != "", topic).when(head != "", head).otherwise("未命名问题")


def memory_topics(questions: DataFrame, limit: int = 8) -> DataFrame:
    """conv_id, topic, count, sample, last_ord, rank: the most frequent topics of each conversation, later ones first
    among equals, counted over all its questions. questions: conv_id, ord, question."""
    rows = questions.withColumn("topic", memory_topic(F.col("question"))).groupBy("conv_id", "topic")
    sample = F.substr(F.max_by("question", "ord"), F.lit(1), F.lit(80))
    rows = rows.agg(F.count("*").alias("count"), sample.alias("sample"), F.max("ord").alias("last_ord"))
    w = Window.partitionBy("conv_id").orderBy(F.desc("count"), F.desc("last_ord"))
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def fold_memory(items: list[tuple[str, int, str]], question: str, topic: str, limit: int = 8) -> list[tuple[str, int, str]]:
    """One question added to (topic, count, sample) rows; what falls out of the limit is forgotten."""
    items = [list(i) for i in items]
    for item in items:
        if item[0] == topic:
            item[1], item[2] = item[1] + 1, question[:80]
            break
    else:
        items.append([topic, 1, question[:80]])
    order = sorted(range(len(items)), key=lambda i: (items[i][1], i), reverse=True)[:limit]
    return [tuple(items[i]) for i in order]


def memory_topics_folded(questions: DataFrame, limit: int = 8) -> DataFrame:
    """conv_id, topic, count, sample, rank by the ordered fold that forgets at each step; rows stream by conversation."""
    ready = questions.select("conv_id", "ord", "question", memory_topic(F.col("question")).alias("topic"))
    kind = dict(ready.dtypes)["conv_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, items = None, []
        for batch in batches:
            done = []
            for conv, question, topic in zip(batch["conv_id"], batch["question"], batch["topic"], strict=True):
                if conv != current:
                    done += [(current, *i, k) for k, i in enumerate(items, 1)]
                    current, items = conv, []
                items = fold_memory(items, question, topic, limit)
            yield pd.DataFrame(done, columns=["conv_id", "topic", "count", "sample", "rank"])
        yield pd.DataFrame([(current, *i, k) for k, i in enumerate(items, 1)], columns=["conv_id", "topic", "count", "sample", "rank"])

    return ready.repartition("conv_id").sortWithinPartitions("conv_id", "ord").mapInPandas(run, f"conv_id {kind}, topic string, count long, sample string, rank int")


def plan_action(question: Column, has_history: Column, has_attachment: Column) -> Column:
    text = X.strip(question)
    greeting = text.rlike(P.LIGHT_CHAT) & ~has_attachment
    return F.when(text.rlike(r"^[\d一二三四五六七八九十]+[.。]?$"), "clarify").when(has_history, "course_search").when(greeting, "final").otherwise("course_search")


def query_intent(question: Column, quality: Column) -> Column:
    """clarification, light_followup, web_lookup, course_explain, general_question or course_question, the first that
    fits; quality is that of the retrieval (null: none)."""
    text = X.text_or_empty(question)
    compact = F.regexp_replace(text, r"(?U)[^\w\u3400-\u9fff]+", "")
    unclear = (compact == "") | compact.rlike(r"(?U)^(?:\d+|[零〇一二三四五六七八九十百千万亿]+)$")
    return (
        F.when(unclear, "clarification").when(X.strip(text).rlike(P.LIGHT_CHAT), "light_followup")
        .when(text.rlike(P.FRESHNESS) | text.rlike(P.WEB_INTENT), "web_lookup").when(text.rlike(P.COURSE_EXPLAIN), "course_explain")
        .when(F.coalesce(quality, F.lit("none")) == "none", "general_question").otherwise("course_question")
    )


def should_search_web(question: Column, quality: Column) -> Column:
    """Questions for the web, and those of which the course knows nothing."""
    return query_intent(question, quality).isin("web_lookup", "general_question")


def count_attempts(messages: DataFrame, needed: int = 2) -> DataFrame:
    """conv_id, attempts, disclosure_allowed: whether the last user message asks for the answer, or enough earlier ones
    show an attempt."""
    text = X.text_or_empty(F.col("content"))
    user = F.lower("role") == "user"
    tried = user & (F.length(X.strip(text)) >= 12) & X.contains_any(text, P.ATTEMPT_MARKERS)
    asks = F.lit(False)
    for pattern in P.DISCLOSURE:
        asks = asks | text.rlike(pattern)
    rows = messages.withColumns({"tried": tried, "asks": F.when(user, asks)})
    out = rows.groupBy("conv_id").agg(F.count_if("tried").alias("attempts"), F.max_by("asks", F.when(user, F.col("turn"))).alias("asks"))
    return out.select("conv_id", "attempts", ((F.col("attempts") >= needed) | F.coalesce("asks", F.lit(False))).alias("disclosure_allowed"))

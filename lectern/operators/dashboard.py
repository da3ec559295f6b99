"""Dashboards and study plans of courses.

plan: course_id, id, title, kind, status, estimated_minutes, created_at, updated_at, completed_at.
files: course_id, file_id, file_name, path, size, modified_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import params as P
from lectern.functions import text as X


def _rank(status: Column) -> Column:
    return F.when(status == "doing", 0).when(status == "todo", 1).when(status == "done", 2).otherwise(3)


def learning_progress(plan: DataFrame) -> DataFrame:
    done = F.col("status") == "done"
    minutes = lambda c: F.coalesce(F.sum(F.when(c, F.col("estimated_minutes"))), F.lit(0))
    first = lambda status: F.min_by(F.struct("id", "title"), F.when(F.col("status") == status, F.col("id")))
    has = lambda status: F.count_if(F.col("status") == status)
    out = plan.groupBy("course_id").agg(
        F.count("*").alias("total"), has("done").alias("done"), has("doing").alias("doing"), has("todo").alias("todo"),
        minutes(~done).alias("remaining_minutes"), minutes(done).alias("completed_minutes"),
        F.coalesce(F.when(has("doing") > 0, first("doing")), F.when(has("todo") > 0, first("todo"))).alias("next"),
    )
    percent = F.rint(100 * F.col("done") / F.col("total")).cast("int")
    return out.withColumn("progress_percent", percent).withColumns({"next_item_id": F.col("next.id"), "next_item_title": X.text_or_empty(F.col("next.title"))}).drop("next")


def review_queue(plan: DataFrame, limit: int = 5) -> DataFrame:
    """Open items that are reviews or begun; all open items where there is none."""
    rows = plan.filter("status <> 'done'").withColumn("due", (F.col("kind") == "review") | (F.col("status") == "doing"))
    rows = rows.withColumn("any_due", F.max("due").over(Window.partitionBy("course_id"))).filter("due or not any_due")
    w = Window.partitionBy("course_id").orderBy(_rank(F.col("status")), "id")
    return rows.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= limit).select("course_id", "position", "id", "title", "kind", "status", "estimated_minutes")


def mastery_summary(mastery: DataFrame, points: DataFrame | None, mistakes: DataFrame | None, now: Column, limit: int = 5) -> DataFrame:
    """One row for each course: counts by level, mean score, due, open mistakes, the weakest and the due points."""
    rows = mastery if points is None else mastery.join(points.select("course_id", "point_id", "title"), ["course_id", "point_id"], "left")
    title = F.col("point_id") if points is None else F.coalesce("title", "point_id")
    due = F.col("next_review_at") <= now
    by_score = F.row_number().over(Window.partitionBy("course_id").orderBy("score", "last_answered_at", "point_id"))
    by_time = F.row_number().over(Window.partitionBy("course_id").orderBy(~due, "next_review_at", "score", "point_id"))
    rows = rows.withColumns({"title": title, "due": due, "w": by_score, "d": by_time})
    pick = lambda order, ok: F.transform(F.array_sort(F.array_compact(F.collect_list(F.when(ok, F.struct(order, "point_id", "title"))))), lambda x: x.title)
    levels = [F.count_if(F.col("level") == x).alias(x) for x in ("weak", "building", "familiar", "mastered")]
    out = rows.groupBy("course_id").agg(
        F.count("*").alias("points"), *levels, F.rint(F.avg("score")).cast("int").alias("average_score"), F.count_if("due").alias("due_count"),
        pick("w", F.col("w") <= limit).alias("weakest"), pick("d", (F.col("d") <= limit) & F.col("due")).alias("due_points"),
    )
    if mistakes is None:
        return out.withColumn("open_mistakes", F.lit(0).cast("long"))
    open_ = mistakes.groupBy("course_id").agg(F.count_if(F.col("status") == "open").alias("open_mistakes"))
    return out.join(open_, "course_id", "left").fillna(0, ["open_mistakes"])


def is_generated() -> Column:
    return F.array_contains(F.split(F.coalesce("path", F.lit("")), "/"), P.GENERATED_FOLDER)


def extension(name: Column) -> Column:
    found = F.lower(F.regexp_extract(X.text_or_empty(name), r"[^.](\.[^.]+)$", 1))
    return F.when(found == "", "unknown").otherwise(found)


def materials_stats(files: DataFrame, index_stats: DataFrame | None = None) -> DataFrame:
    """course_id, file_count, generated_file_count, total_bytes, by_extension and the counts of the index."""
    made = is_generated()
    each = files.groupBy("course_id", F.when(~made, extension(F.col("file_name"))).alias("ext")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    known = F.col("ext").isNotNull()
    out = each.groupBy("course_id").agg(
        F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("file_count"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("generated_file_count"),
        F.coalesce(F.sum(F.when(known, F.col("bytes"))), F.lit(0)).alias("total_bytes"),
        F.map_from_entries(F.array_sort(F.array_compact(F.collect_list(F.when(known, F.struct("ext", "n")))))).alias("by_extension"),
    )
    return out if index_stats is None else out.join(index_stats, "course_id", "left").fillna(0)


def generated_artifacts(files: DataFrame) -> DataFrame:
    low = F.lower("file_name")
    summary = X.contains_any(low, P.SUMMARY_NAMES)
    quiz = ~summary & X.contains_any(low, P.QUIZ_NAMES)
    rows = files.filter(is_generated()).withColumns({"summary": summary, "quiz": quiz})
    return rows.groupBy("course_id").agg(
        F.count("*").alias("total"), F.count_if("summary").alias("summaries"), F.count_if("quiz").alias("quizzes"),
        F.count_if(~F.col("summary") & ~F.col("quiz")).alias("other"), F.max_by("file_name", F.struct("modified_at", "file_name")).alias("latest"),
    )


def recent_activity(messages: DataFrame, notes: DataFrame, plan: DataFrame, files: DataFrame, limit: int = 8) -> DataFrame:
    """course_id, position, type, title, created_at: the newest of messages (role, content, created_at), notes (title,
    created_at), plan items and generated files. Equal times go by type and title."""
    title = lambda c, default: F.coalesce(F.nullif(c, F.lit("")), F.lit(default)).alias("title")
    item_time = F.coalesce("completed_at", "updated_at", "created_at").alias("created_at")
    rows = messages.select("course_id", F.concat(F.lit("message:"), F.coalesce("role", F.lit("unknown"))).alias("type"), title(X.compact_text(F.col("content"), 80), "空消息"), "created_at")
    rows = rows.unionByName(notes.select("course_id", F.lit("note").alias("type"), title(F.col("title"), "未命名笔记"), "created_at"))
    rows = rows.unionByName(plan.select("course_id", F.concat(F.lit("plan:"), F.coalesce("status", F.lit("todo"))).alias("type"), title(F.col("title"), "未命名学习项"), item_time))
    rows = rows.unionByName(files.filter(is_generated()).select("course_id", F.lit("generated_artifact").alias("type"), title(F.col("file_name"), "未命名文件"), F.col("modified_at").alias("created_at")))
    w = Window.partitionBy("course_id").orderBy(F.desc("created_at"), "type", "title")
    return rows.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= limit)


def course_dashboard(courses: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """courses (course_id) with one struct column for each part (one row per course at most); numbers are zero where a
    course has none."""
    out = courses.select("course_id").distinct()
    for name, rows in parts.items():
        filled = [c for c in rows.columns if c != "course_id"]
        out = out.join(rows.select("course_id", F.struct(*filled).alias(name)), "course_id", "left")
        kinds = dict(rows.dtypes)
        zero = [(F.coalesce(F.col(f"{name}.{c}"), F.lit(0).cast(kinds[c])) if kinds[c] in ("int", "bigint", "double") else F.col(f"{name}.{c}")).alias(c) for c in filled]
        out = out.withColumn(name, F.struct(*zero))
    return out


def default_study_plan(files: DataFrame, courses: DataFrame | None = None, limit: int = 8) -> DataFrame:
    """course_id, id, title, kind, status, estimated_minutes, source_file_id: the first files by kind and name, and one
    review; a course (course_id, name) without files gets one item to put its material in order."""
    low = F.lower("file_name")
    order = F.when(X.contains_any(low, P.PLAN_FIRST), 0).when(X.contains_any(low, P.PLAN_SECOND), 1).otherwise(2)
    usable = files.filter(~is_generated() & F.lower("file_name").rlike(r"\.(pdf|md|markdown|txt|docx)$"))
    w = Window.partitionBy("course_id").orderBy(order, low, "file_id")
    rows = usable.withColumn("id", F.row_number().over(w)).filter(F.col("id") <= limit)
    practice, review = X.contains_any(low, P.PLAN_PRACTICE), X.contains_any(low, P.PLAN_REVIEW)
    rows = rows.select(
        "course_id", F.col("id").cast("long").alias("id"),
        F.concat(F.when(practice, "完成并订正 ").when(review, "复盘 ").otherwise("阅读并提炼 "), F.col("file_name")).alias("title"),
        F.when(practice, "practice").when(review, "review").otherwise("read").alias("kind"), F.lit("todo").alias("status"),
        F.when(practice, 35).when(review, 25).otherwise(30).alias("estimated_minutes"), F.col("file_id").alias("source_file_id"),
    )
    item = lambda df, title, kind, minutes: df.select("course_id", F.col("id").cast("long").alias("id"), title.alias("title"), F.lit(kind).alias("kind"), F.lit("todo").alias("status"), F.lit(minutes).alias("estimated_minutes"), F.lit("").alias("source_file_id"))
    last = rows.groupBy("course_id").agg((F.max("id") + 1).alias("id"))
    out = rows.unionByName(item(last, F.lit("完成一次错题与薄弱点复盘"), "review", 30))
    if courses is not None:
        bare = courses.join(rows.select("course_id").distinct(), "course_id", "left_anti").withColumn("id", F.lit(1))
        out = out.unionByName(item(bare, F.concat(F.lit("整理《"), F.col("name"), F.lit("》资料目录")), "read", 25))
    return out


def apply_changes(rows: DataFrame, changes: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows (course_id, id, fields) after the changes (course_id, id, op, seq, fields), and the changes of unknown ids.

    op is add, update or delete. The last change of an id counts; null fields of an update keep what was there; added
    rows get the ids behind the highest of their course, in the order of seq.
    """
    key = ["course_id", "id"]
    last = changes.filter("op <> 'add'").withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("seq")))).filter("n = 1")
    new = last.select(*key, "op", *[F.col(f).alias(f"new_{f}") for f in fields])
    kept = rows.join(new, key, "left").filter("op is null or op <> 'delete'")
    kept = kept.select(*key, *[F.coalesce(f"new_{f}", f).alias(f) for f in fields])
    top = rows.groupBy("course_id").agg(F.max("id").alias("top"))
    added = changes.filter("op = 'add'").withColumn("n", F.row_number().over(Window.partitionBy("course_id").orderBy("seq"))).join(top, "course_id", "left")
    added = added.select("course_id", (F.coalesce("top", F.lit(0)) + F.col("n")).cast("long").alias("id"), *fields)
    unknown = last.join(rows.select(*key), key, "left_anti").select(*key, "op")
    return kept.withColumn("id", F.col("id").cast("long")).unionByName(added), unknown

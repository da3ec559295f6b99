"""Change logs of notes, plan items and conversations, folded in the order of seq.

A change names the fields that it sets. Of each field the last change counts, and what else depends on the order (when an
item was completed) is found from a few extremes of seq, so a log is folded by aggregations that combine before they
shuffle: an item with a third of all changes is no single task's work.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import text as X
from lectern.sources.scratch import materialise

KEY = ["course_id", "id"]
_TIME = "timestamp"


@dataclass(frozen=True)
class Kind:
    """fields: the name of each field a change may set, to what becomes of a new value; a null counts as no change.
    defaults: of an added row. completes: status done has a time."""

    fields: dict
    defaults: dict = field(default_factory=dict)
    completes: bool = False
    times: tuple[str, ...] = ("created_at", "updated_at")


def _choice(*allowed: str) -> object:
    return lambda c: F.when(c.cast("string").isin(*allowed), c.cast("string")).otherwise(F.lit(allowed[0]))


def _title(limit: int | None, default: str | None) -> object:
    def rule(c: Column) -> Column:
        out = X.strip(c.cast("string"))
        out = F.substr(out, F.lit(1), F.lit(limit)) if limit else out
        return F.when(out != "", out).otherwise(F.lit(default))

    return rule


NOTES = Kind({"title": _title(None, "学习笔记"), "content": lambda c: X.strip(c.cast("string"))}, {"title": "学习笔记", "content": ""})
PLAN_ITEMS = Kind(
    {
        "title": _title(120, "未命名学习项"),
        "kind": _choice("read", "review", "practice"),
        "status": _choice("todo", "doing", "done"),
        "estimated_minutes": lambda c: X.coerce_int(c, 25, 5, 240).cast("int"),
    },
    {"title": "未命名学习项", "kind": "read", "status": "todo", "estimated_minutes": 25},
    completes=True,
    times=("created_at", "updated_at", "completed_at"),
)
#: A blank title leaves the old one.
CONVERSATIONS = Kind({"title": _title(64, None)}, {"title": "新对话"})


def _empty(name: str, kind: Kind) -> Column:
    return F.lit(kind.defaults.get(name))


def numbered(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """changes in which an added row has its id: the next behind the highest of its course, in the order of seq. An id
    that was deleted is not given again. Later changes of the log may name it."""
    top = rows.groupBy(F.col("course_id").alias("top_course")).agg(F.max("id").alias("top"))
    w = Window.partitionBy("course_id").orderBy("seq")
    added = changes.filter("op = 'add'").withColumn("nth", F.row_number().over(w)).join(top, F.col("course_id").eqNullSafe(F.col("top_course")), "left")
    added = added.withColumn("id", (F.coalesce("top", F.lit(0)) + F.col("nth")).cast("long")).select(*changes.columns)
    return changes.filter("op <> 'add'").withColumn("id", F.col("id").cast("long")).unionByName(added)


def fold_changes(rows: DataFrame, changes: DataFrame, kind: Kind) -> tuple[DataFrame, DataFrame]:
    """rows (course_id, id, the kind's fields and times) after the changes (course_id, id, op, seq, at, sets and the
    fields), and of the changes those of unknown ids (course_id, id, op, seq).

    op is add, update or delete; seq orders the changes of a course and is unique there; at is the time of a change; sets
    names the fields that an update sets (null: those that are not null). An add takes defaults for what it lacks.
    updated_at is the time of the last update, for adds of plan items that of the add. A plan item that becomes done gets
    completed_at, once; one that is not done has none. A change of a row that has been deleted, or that is added later,
    is unknown. Columns of rows that the kind does not name come through, null for added rows.
    """
    names, key = list(kind.fields), ["course_id", "id"]
    log = materialise(numbered(rows, changes))
    born = log.filter("op = 'add'").select(*key, F.col("seq").alias("born"))
    old = rows.select("course_id", F.col("id").cast("long").alias("id"), F.lit(None).cast(dict(log.dtypes)["seq"]).alias("born"))
    life = old.unionByName(born)
    def beside(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        right = right.withColumnsRenamed({"course_id": "r_course", "id": "r_id"})
        same = F.col("course_id").eqNullSafe(F.col("r_course")) & F.col("id").eqNullSafe(F.col("r_id"))
        joined = left.join(right, same, how)
        return joined if how in ("left_semi", "left_anti") else joined.drop("r_course", "r_id")

    deletes = beside(log.filter("op = 'delete'").select(*key, "seq"), life, "inner").filter("born is null or seq > born")
    life = materialise(beside(life, deletes.groupBy(*key).agg(F.min("seq").alias("died")), "left"))
    known = beside(log, life.withColumn("here", F.lit(True)), "left")
    in_life = F.coalesce("here", F.lit(False)) & (F.col("born").isNull() | (F.col("seq") >= F.col("born"))) & (F.col("died").isNull() | (F.col("seq") <= F.col("died")))
    known = materialise(known.withColumn("in_life", in_life))
    unknown = known.filter("not in_life").select(*key, "op", "seq")
    live = known.filter("in_life and died is null")

    def is_set(name: str) -> Column:
        named = F.when(F.col("op") == "add", F.col(name).isNotNull()).otherwise(F.when(F.col("sets").isNull(), F.col(name).isNotNull()).otherwise(F.array_contains("sets", name)))
        return named & kind.fields[name](F.col(name)).isNotNull()

    lasts = [F.max_by(F.struct(kind.fields[n](F.col(n)).alias("v")), F.when(is_set(n), F.col("seq"))).alias(f"last_{n}") for n in names]
    update = F.col("op") == "update"
    extremes = [F.max_by("at", F.when(update, F.col("seq"))).alias("last_at"), F.min(F.when(F.col("op") == "add", F.col("at"))).alias("born_at")]
    if kind.completes:
        raw = F.coalesce(F.col("status").cast("string"), F.lit(""))
        extremes += [F.max(F.when(F.col("op") == "add", raw == "done")).alias("born_done"), F.max(F.when(is_set("status") & (raw != "done"), F.col("seq"))).alias("open_seq"), F.min(F.when(update, F.struct("seq", "at"))).alias("first_update")]
    folded = live.groupBy(*key).agg(*lasts, *extremes)
    stays = life.filter("died is null").select(*key, "born")
    rest = [c for c in rows.columns if c not in key]
    base = beside(stays, rows.withColumn("id", F.col("id").cast("long")), "left")
    out = beside(base, folded, "left")
    value = {n: F.when(F.col(f"last_{n}").isNotNull(), F.col(f"last_{n}.v")).when(F.col("born").isNotNull(), _empty(n, kind)).otherwise(F.col(n)) for n in names}
    value["created_at"] = F.coalesce("born_at", "created_at")
    at_birth = F.col("born_at") if kind.completes else F.lit(None).cast(_TIME)
    value["updated_at"] = F.coalesce("last_at", "updated_at", at_birth)
    if kind.completes:
        # done since the first update behind the last change to something else; else since it was done before the log
        firsts = beside(live.filter(update), folded.select(*key, "open_seq"), "left")
        done = is_set("status") & (F.col("status").cast("string") == "done") & (F.col("seq") > F.coalesce("open_seq", F.lit(-(2**62))))
        since = firsts.filter(done).groupBy(*key).agg(F.min(F.struct("seq", "at")).alias("done_at"))
        out = beside(out, since, "left")
        before = F.coalesce(F.col("completed_at"), F.when((F.col("status") == "done") & F.col("born").isNull(), F.col("first_update.at")))
        born_done = F.when(F.col("born_done"), F.col("first_update.at"))
        since_when = F.when(F.col("open_seq").isNotNull(), F.col("done_at.at")).otherwise(F.coalesce(F.when(F.col("status") == "done", before), born_done, F.col("done_at.at")))
        value["completed_at"] = F.when(value["status"] == "done", since_when)
    return out.select(*key, *(value.get(c, F.col(c)).cast(dict(rows.dtypes)[c]).alias(c) for c in rest)), unknown


def with_default_conversation(conversations: DataFrame, courses: DataFrame) -> DataFrame:
    """conversations, and a new one (id 1, the default title) for each of the courses (course_id) that has none left."""
    bare = courses.select("course_id").distinct().join(conversations.select("course_id").distinct(), "course_id", "left_anti")
    named = {"id": F.lit(1), "title": F.lit(CONVERSATIONS.defaults["title"]), "course_id": F.col("course_id")}
    kinds = dict(conversations.dtypes)
    return conversations.unionByName(bare.select(*(named.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in conversations.columns)))

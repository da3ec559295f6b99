"""Change logs folded by aggregations against a fold one by one."""

import datetime
import random

import pytest

from lectern.operators import changes as C

T0 = datetime.datetime(2026, 1, 1)
LOG = "course_id string, id long, op string, seq long, at timestamp, sets array<string>, "
SHAPES = {
    "notes": (C.NOTES, "title string, content string", "created_at timestamp, updated_at timestamp"),
    "plan": (C.PLAN_ITEMS, "title string, kind string, status string, estimated_minutes string", "created_at timestamp, updated_at timestamp, completed_at timestamp"),
    "conversations": (C.CONVERSATIONS, "title string", "created_at timestamp, updated_at timestamp"),
}


def plan_value(name, value):
    if name == "title":
        return (value or "").strip()[:120] or "未命名学习项"
    if name == "kind":
        return value if value in ("read", "review", "practice") else "read"
    if name == "status":
        return value if value in ("todo", "doing", "done") else "todo"
    try:
        return min(max(int(value), 5), 240)
    except (TypeError, ValueError):
        return 25


def one_by_one(what, rows, log, names):
    state = {(r["course_id"], r["id"]): dict(r) for r in rows}
    top, unknown = {}, []
    for r in rows:
        top[r["course_id"]] = max(top.get(r["course_id"], 0), r["id"])
    for c in sorted(log, key=lambda c: c["seq"]):
        course = c["course_id"]
        if c["op"] == "add":
            top[course] = top.get(course, 0) + 1
            item = {"course_id": course, "id": top[course], "created_at": c["at"], "updated_at": c["at"] if what == "plan" else None}
            for n in names:
                v = c[n]
                if what == "plan":
                    item[n] = plan_value(n, v) if v is not None else {"title": "未命名学习项", "kind": "read", "status": "todo", "estimated_minutes": 25}[n]
                elif what == "notes":
                    item[n] = ((v or "").strip() or ("学习笔记" if n == "title" else ""))
                else:
                    item[n] = ((v or "").strip())[:64] or "新对话"
            if what == "plan":
                item["completed_at"] = None
            state[course, top[course]] = item
            continue
        item = state.get((course, c["id"]))
        if item is None:
            unknown.append((course, c["id"], c["op"], c["seq"]))
        elif c["op"] == "delete":
            del state[course, c["id"]]
        else:
            named = c["sets"] if c["sets"] is not None else [n for n in names if c[n] is not None]
            raw = {n: c[n] if n in named else item[n] for n in names}
            item["updated_at"] = c["at"]
            if what == "plan":
                if raw["status"] == "done":
                    item["completed_at"] = item["completed_at"] or c["at"]
                else:
                    item["completed_at"] = None
                item |= {n: plan_value(n, raw[n]) for n in names}
            elif what == "notes":
                item |= {n: (raw[n] or "").strip() or ("学习笔记" if n == "title" else "") for n in named if n in names}
            elif (raw["title"] or "").strip():
                item["title"] = raw["title"].strip()[:64]
    return state, sorted(unknown, key=str)


@pytest.mark.parametrize("what", SHAPES)
def test_any_log_folds_to_the_same(spark, what):
    kind, fields, times = SHAPES[what]
    names = [f.split()[0] for f in fields.split(", ")]
    rnd = random.Random(sum(map(ord, what)))
    words = {"title": ["A", " b ", "", "  ", "x" * 200], "content": ["text ", ""], "kind": ["read", "review", "odd"], "status": ["todo", "doing", "done", "done", "odd"], "estimated_minutes": ["1", "30", "999", "no"]}
    rows, seq = [], 0
    for course in ("a", "b", None):
        for i in range(1, 7):
            item = {"course_id": course, "id": i, "title": "T", "content": "c", "kind": "read", "status": rnd.choice(["todo", "done"]), "estimated_minutes": 25}
            item |= {"created_at": T0, "updated_at": None, "completed_at": T0 if item["status"] == "done" and rnd.random() < 0.6 else None, "extra": i}
            rows.append(item)
    log = []
    for seq in range(240):
        op = rnd.choice(["add", "update", "update", "update", "update", "delete"] if seq % 3 else ["update"])
        change = {"course_id": rnd.choice(["a", "a", "b", None, "new"]), "id": None if op == "add" else rnd.randint(1, 14), "op": op, "seq": seq, "at": T0 + datetime.timedelta(minutes=seq + 1)}
        change |= {n: rnd.choice([None, *words[n]]) for n in names}
        change["sets"] = rnd.choice([None, rnd.sample(names, rnd.randint(1, len(names)))])
        if what == "plan" and change["sets"] and "title" in change["sets"] and change["title"] is None:
            change["title"] = "B"
        log.append(change)
    columns = ["course_id", "id", *names, *(t.split()[0] for t in times.split(", ")), "extra"]
    types = f"course_id string, id long, {fields}, {times}, extra int".replace("estimated_minutes string", "estimated_minutes int")
    table = spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], types)
    shuffled = rnd.sample(log, len(log))
    changes = spark.createDataFrame([tuple(c[n] for n in ("course_id", "id", "op", "seq", "at", "sets", *names)) for c in shuffled], LOG + fields)
    out, unknown = C.fold_changes(table, changes, kind)
    expected, lost = one_by_one(what, rows, log, names)
    got = {(r.course_id, r.id): r for r in out.collect()}
    assert set(got) == set(expected)
    for key, item in expected.items():
        for c in columns[2:-1]:
            assert got[key][c] == item[c], (key, c)
        assert got[key].extra == item.get("extra")
    assert sorted(((r.course_id, r.id, r.op, r.seq) for r in unknown.collect()), key=str) == lost


def test_a_course_without_conversations_gets_one(spark):
    rows = spark.createDataFrame([("a", 1, "T", T0)], "course_id string, id long, title string, created_at timestamp")
    courses = spark.createDataFrame([("a",), ("b",)], "course_id string")
    out = {(r.course_id, r.id, r.title) for r in C.with_default_conversation(rows, courses).collect()}
    assert out == {("a", 1, "T"), ("b", 1, "新对话")}

"""Streams of calls, edits and renumberings equal their tables, in any split into batches."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from test_operators import NODE
from test_refresh import _batches

from arborea.operators import content, rewrite, tree as t
from arborea.streaming import edits as ed
from arborea.streaming.edits import _OpenSession

START = datetime(2024, 5, 1)
CALLS = "doc_id long, seq long, ts timestamp, cmd string, node_id long"


def _calls(rnd, n, docs=3):
    at, rows = START, []
    for i in range(n):
        at += timedelta(seconds=rnd.choice([1, 20, 60, 119, 120, 400]))
        rows.append((rnd.randrange(docs), i, at, rnd.choice(["begin", "edit", "edit", "delete", "read", "end", "stop"]), rnd.randrange(6)))
    return rows


def _plain_sessions(rows, idle=120):
    out = []
    for doc in {r[0] for r in rows}:
        now = None
        for _, _, at, cmd, node in sorted((r for r in rows if r[0] == doc), key=lambda r: (r[2], r[1])):
            if now and at - now[1] >= timedelta(seconds=idle):
                out.append((doc, now[0], now[1] + timedelta(seconds=idle), "quiet", now[2], len(now[3]), now[4]))
                now = None
            if not now and cmd == "begin":
                now = [at, at, 0, set(), 0]
            if now:
                now[1] = at
                now[2] += cmd in ("edit", "delete")
                now[4] += cmd == "delete"
                if cmd == "edit":
                    now[3].add(node)
                if cmd in ("end", "stop"):
                    out.append((doc, now[0], at, {"end": "ended", "stop": "stopped"}[cmd], now[2], len(now[3]), now[4]))
                    now = None
        if now:
            out.append((doc, now[0], now[1] + timedelta(seconds=idle), "quiet", now[2], len(now[3]), now[4]))
    return sorted(out)


def test_sessions_of_a_table(spark):
    rows = _calls(random.Random(4), 300)
    assert sorted(map(tuple, ed.call_sessions(spark.createDataFrame(rows, CALLS)).collect())) == _plain_sessions(rows)


def test_sessions_of_a_stream_with_late_calls(spark):
    rows = _calls(random.Random(9), 60)
    late = rows[:]
    # a call may come some places late, well within the watermark
    for i in range(0, len(late) - 2, 7):
        late[i], late[i + 2] = late[i + 2], late[i]
    far = [(d, 1000 + d, START + timedelta(days=1 + i), "read", 0) for i in range(2) for d in range(3)]
    got = _batches(spark, CALLS, [late[:15], late[15:31], late[31:], far[:3], far[3:]], ed.call_sessions, "append", "calls")
    assert sorted(map(tuple, got)) == _plain_sessions(rows)


def test_sessions_close_by_themselves():
    s = _OpenSession([(0, 1, "begin", None), (5_000, 2, "edit", 4)], None)
    assert list(s.upto(6_000, 120_000)) == [] and s.open[:3] == [0, 5_000, 1]
    assert [x[2:] for x in s.upto(125_000, 120_000)] == [("quiet", 1, 1, 0)] and s.open is None


EVENTS = "doc_id long, seq long, kind string, revision long, boundary long, node_id long"


def test_judged_edits_in_any_split(spark):
    rnd, rows = random.Random(2), []
    for i in range(120):
        doc = rnd.randrange(2)
        rows.append((doc, i, "renumbering", i, rnd.randrange(30), None) if rnd.random() < 0.4 else (doc, i, "edit", max(0, i - rnd.randrange(40)), None, rnd.randrange(30)))
    table = ed.judged_edits(spark.createDataFrame(rows, EVENTS), 5)
    want = sorted(map(tuple, table.collect()))
    assert {x[2] for x in want} == {"fresh", "stale", "future"}
    log = {0: [], 1: []}
    plain = []
    for doc, seq, kind, revision, boundary, node in rows:
        if kind == "renumbering":
            log[doc].append((revision, boundary))
            continue
        held = log[doc][-5:]
        verdict = "future" if revision > (held[-1][0] if held else 0) else "stale" if (len(log[doc]) > 5 and revision < held[0][0] - 1) or any(b <= node for at, b in held if at > revision) else "fresh"
        plain.append((doc, seq, verdict))
    assert want == sorted(plain)
    for i, cut in enumerate(([40, 41, 90], [60])):
        parts = [rows[a:b] for a, b in zip([0, *cut], [*cut, len(rows)])]
        assert sorted(map(tuple, _batches(spark, EVENTS, parts, lambda x: ed.judged_edits(x, 5), "append", f"judged{i}"))) == want


def test_undo_owner_of_a_stream(spark):
    rows = [(1, 1, "a", True), (1, 2, None, True), (2, 3, "b", True), (1, 4, "c", False), (2, 5, "b", True), (1, 6, "a", True)]
    schema = "doc_id long, seq long, undo_group string, changes boolean"
    got = _batches(spark, schema, [rows[:2], rows[2:5], rows[5:]], ed.undo_owner_stream, "update", "owners")
    assert [tuple(r) for r in got if r.doc_id == 1] == [(1, None), (1, "a")] and {r.undo_group for r in got if r.doc_id == 2} == {"b"}
    table = {r.doc_id: r.undo_group for r in ed.undo_owner(spark.createDataFrame(rows, schema)).collect()}
    assert table == {1: "a", 2: "b"}


def _tree(spark, extra=()):
    e = lambda i, up, role: (1, i, up, i, "element", "element", role, None, None, None, 1, False, 0 if i == 1 else None, None, None)
    c = lambda i, up, mcid: (1, i, up, i, "content", "content-int", None, None, None, None, 1, False, None, mcid, None)
    o = lambda i, up, target: (1, i, up, i, "object-ref", "content-dict", None, None, None, None, 1, False, None, None, target)
    rows = [(1, 0, None, 0, "root", "root", None, None, None, None, 1, False, None, None, None), e(1, 0, "Document"), e(2, 1, "P"), c(3, 2, 0), e(4, 1, "Link"), o(5, 4, 77), o(6, 4, 70), c(7, 4, 2), *extra(e, c, o)] if extra else [(1, 0, None, 0, "root", "root", None, None, None, None, 1, False, None, None, None), e(1, 0, "Document"), e(2, 1, "P"), c(3, 2, 0), e(4, 1, "Link"), o(5, 4, 77), o(6, 4, 70), c(7, 4, 2)]
    return t.tree_keys(spark.createDataFrame(rows, NODE))


def test_keys_stay_over_versions(spark):
    none = lambda kind, name: spark.createDataFrame([], f"doc_id long, {name} {kind}, key long")
    declared = spark.createDataFrame([(1, 4)], "doc_id long, next long")
    first = t.parent_tree(_tree(spark), none("int", "page"), none("long", "target_id"), declared)
    rows = {(r.kind, r.id): (r.key, r.owners, r.next) for r in first.collect()}
    assert rows == {("page", 0): (4, "2,,4", 7), ("object", 77): (5, "4", 7), ("object", 70): (6, "4", 7)}
    second = _tree(spark, lambda e, c, o: [e(8, 1, "Link"), o(9, 8, 80), o(10, 8, 70)])
    pages, objects = (first.filter(f"kind = '{k}'").select("doc_id", F.col("id").cast(kind).alias(name), "key") for k, name, kind in (("page", "page", "int"), ("object", "target_id", "long")))
    again = {(r.kind, r.id): (r.key, r.owners, r.next) for r in t.parent_tree(second, pages, objects, first.select("doc_id", "next").distinct()).collect()}
    # keys stay, the moved object belongs to its last owner, the new one gets the next key
    assert again == {("page", 0): (4, "2,,4", 8), ("object", 77): (5, "4", 8), ("object", 70): (6, "8", 8), ("object", 80): (7, "8", 8)}


def test_script_keeps_what_was_done(spark):
    tree = _tree(spark)
    done, ops, said = rewrite.run_steps(tree, [{"type": "replace_role", "find": "P", "put": "H2"}, {"type": "shift_headings", "by": "x"}, {"type": "replace_role", "find": "Link", "put": "P"}])
    assert [s["type"] for s in said] == ["replace_role", "shift_headings"] and said[0]["error"] is None and said[1]["error"].startswith("shift_headings: ")
    assert [r.role for r in done.filter("node_id IN (2, 4)").orderBy("node_id").collect()] == ["H2", "Link"]
    for step in ({"type": "smartifact"}, {"type": "repair_orphans"}, {"type": "unheard"}, {}):
        assert rewrite.run_steps(tree, [step])[2][0]["error"]
    page = spark.createDataFrame([(1, 0, 0, "BDC", "P", 0), (1, 0, 1, "Tj", None, None), (1, 0, 2, "EMC", None, None), (1, 0, 3, "BDC", "P", 2)], "doc_id long, page int, op_idx long, op string, tag string, mcid int")
    on = spark.createDataFrame([(1, 0, 0)], "doc_id long, page int, mcid int")
    done, ops, said = rewrite.run_steps(tree, [{"type": "smartifact"}], ops=page, backgrounds=on)
    assert said == [{"type": "smartifact", "error": None}] and done.filter("node_id = 3").isEmpty()
    assert [(r.tag, r.mcid) for r in ops.orderBy("op_idx").collect()] == [("Artifact", None), (None, None), (None, None), ("P", 2)]


def test_artifacts_by_the_last_opening(spark):
    """A nested artifact is part of the outer one; what follows a closed one belongs to none."""
    ops = [(1, i, op, tag, None, text, 10.0 * i, 0.0, 10.0 * i + 9, 0.0, 10.0, i, 0, i + 1, 5) for i, (op, tag, text) in enumerate([("BDC", "Artifact", None), ("Tj", None, "a"), ("BDC", "Artifact", None), ("Tj", None, "b"), ("EMC", None, None), ("f", None, None), ("EMC", None, None), ("Tj", None, "c"), ("BMC", "Artifact", None), ("EMC", None, None), ("BMC", "Artifact", None), ("EMC", None, None)])]
    deep = content.with_depth(spark.createDataFrame(ops, "doc_id long, op_idx long, op string, tag string, mcid int, text string, x double, y double, end_x double, end_y double, size double, x0 int, y0 int, x1 int, y1 int"))
    stated = spark.createDataFrame([(1, 8, "Footer", 1.0, 2.0, 3.0, 4.0), (1, 0, "Header", None, None, None, None)], "doc_id long, open_idx long, subtype string, d0 double, d1 double, d2 double, d3 double")
    got = [(r.open_idx, r.kind, r.subtype, r.text, r.x0, r.x1, r.d2) for r in content.artifact_details(deep, content.spans(deep), stated).orderBy("open_idx").collect()]
    assert got == [(0, "mixed", "Header", "a b", 1, 6, None), (8, "region", "Footer", "", None, None, 3.0)]

"""Operators on written fixtures, by hand and by brute force."""

import random
import re
import time

from pyspark.sql import functions as F

from arborea.plans.corpus import Corpus
from arborea.operators import audit, content, geometry, rewrite, tables, text, tree as t
from arborea.sources import documents as src
from arborea.streaming import edits as ed

NODE = "doc_id long, node_id long, parent_id long, ord long, type string, kind string, role string, alt string, actual_text string, scope string, col_span int, has_bbox boolean, own_page int, mcid int, target_id long"


def node(i, parent, type_, role=None, page=None, mcid=None, alt=None, target=None, ord_=None):
    kind = {"content": "content-int", "object-ref": "content-dict"}.get(type_, type_)
    return (1, i, parent, i if ord_ is None else ord_, type_, kind, role, alt, None, None, 1, False, page, mcid, target)


#: A document with wrong headings, lists, links, figures and empty tags.
AUDIT = [
    node(0, None, "root"), node(1, 0, "element", "Document"), node(2, 1, "element", "H2", 0), node(3, 2, "content", mcid=0), node(4, 1, "element", "P", 0), node(5, 4, "content", mcid=1),
    node(6, 1, "element", "L", 0), node(7, 6, "element", "LI", 0), node(8, 7, "element", "Lbl", 0), node(9, 8, "content", mcid=2), node(10, 7, "content", mcid=3), node(11, 1, "element", "P", 0),
    node(12, 11, "element", "Link", 0), node(13, 12, "content", mcid=4), node(14, 12, "object-ref", target=101), node(15, 1, "element", "P", 0), node(16, 15, "element", "Link", 0), node(17, 16, "content", mcid=5),
    node(18, 16, "object-ref", target=102), node(19, 1, "element", "Figure", 0, alt="A figure"), node(20, 19, "content", mcid=6), node(21, 1, "element", "P", 1), node(22, 21, "content", mcid=0), node(23, 1, "element", "H3", 1), node(24, 1, "element", "Div", 1),
]


def test_audit_fixture(spark):
    tree = t.tree_keys(spark.createDataFrame(AUDIT, NODE))
    annotations = spark.createDataFrame([(1, 0, 101, "Example website"), (1, 0, 102, None), (1, 0, 103, None)], "doc_id long, page int, annot_id long, contents string")
    pages = spark.createDataFrame([(1, 0, None), (1, 1, "S")], "doc_id long, page int, tabs string")
    found = {(r.check_id, r.node_id, r.detail) for r in audit.instances(tree, pages, annotations, audit.empty_nodes(tree)).collect()}
    assert found == {("tab-order", None, ""), ("heading-levels", 2, "0"), ("heading-content", 23, ""), ("tag-content", 24, ""), ("list-contents", 7, "label but no body"), ("list-contents", 7, "1 directly"), ("links-tagged", None, ""), ("links-described", 16, ""), ("links-described", None, "")}
    assert {(r.node_id, r.pre) for r in tree.collect()} == {(i, i + 1) for i in range(25)}


def test_audit_report_of_the_fixture(spark):
    """Every rule's status, for the document and for one without a tree, without facts and without link annotations."""
    nodes = spark.createDataFrame(AUDIT, NODE)
    other = spark.createDataFrame([node(0, None, "root"), node(1, 0, "element", "Document"), node(2, 1, "element", "H1", 0), node(3, 2, "content", mcid=0)], NODE)
    nodes = nodes.unionByName(other.withColumn("doc_id", F.lit(3).cast("long"))).unionByName(other.withColumn("doc_id", F.lit(4).cast("long")))
    annotations = spark.createDataFrame([(1, 0, 101, "Example website"), (1, 0, 102, None), (1, 0, 103, None), (3, 0, 104, None)], "doc_id long, page int, annot_id long, contents string")
    pages = spark.createDataFrame([(1, 0, None), (1, 1, "S"), (4, 0, "S")], "doc_id long, page int, tabs string")
    info = spark.createDataFrame([(1, None, "en-US", True, None, None, 2, True), (2, "T", "en", True, None, "1", 25, True), (3, "T", "en", True, False, "1", 2, False), (4, "T", "en", True, None, None, 2, True)],
                                 "doc_id long, title string, lang string, marked_tagged boolean, accessibility_permission boolean, pdfua_part string, page_count int, has_facts boolean")
    outline = spark.createDataFrame([], "doc_id long, bookmark_id long")
    # text of every leaf is shown in its own span; document 1 has no stray content, document 4 paints outside every span
    leaves = [(1, 0, m, True) for m in range(7)] + [(1, 1, 0, True), (3, 0, 0, True), (4, 0, 0, True)]
    ops = [(d, pg, 10 * m + k, op, "P" if k == 0 else None, m if k == 0 else None, v and k == 1) for d, pg, m, v in leaves for k, op in enumerate(("BDC", "Tj", "EMC"))] + [(4, 0, 90, "Do", None, None, False)]
    corpus = Corpus(nodes, info=info, pages=pages, annotations=annotations, outline=outline, ops=spark.createDataFrame(ops, "doc_id long, page int, op_idx long, op string, tag string, mcid int, visible boolean"),
                    claimed=spark.createDataFrame([x[:3] for x in leaves], "doc_id long, page int, mcid int"))
    report = corpus.verify()
    got = {}
    for r in report.collect():
        got.setdefault(r.doc_id, {})[r.check_id] = (r.status, r.n)
    clean = dict.fromkeys(["heading-levels", "heading-content", "tag-content", "list-nesting", "list-contents", "row-parent", "cell-parent", "table-regularity", "table-headers", "alt-text"], ("pass", 0))
    assert got[1] == clean | {
        "tagged": ("pass", 0), "title": ("fail", 0), "language": ("pass", 0), "permission": ("pass", 0), "tab-order": ("fail", 1), "identifier": ("fail", 0), "bookmarks": ("na", 0), "heading-levels": ("fail", 1), "h1": ("fail", 0), "heading-content": ("fail", 1),
        "tag-content": ("fail", 1), "list-contents": ("fail", 2), "links-tagged": ("fail", 1), "links-described": ("fail", 2), "figure-text": ("warn", 1), "orphaned-content": ("pass", 0)}
    assert got[2] == {"tagged": ("fail", 0), "title": ("pass", 0), "language": ("pass", 0), "permission": ("pass", 0), "tab-order": ("pass", 0), "identifier": ("pass", 0), "bookmarks": ("warn", 0), "structure": ("na", 0)}
    assert got[3] == clean | {"tagged": ("pass", 0), "title": ("pass", 0), "language": ("pass", 0), "permission": ("fail", 0), "tab-order": ("na", 0), "identifier": ("na", 0), "bookmarks": ("na", 0), "h1": ("pass", 0), "links": ("na", 0), "orphaned-content": ("pass", 0)}
    assert got[4] == clean | {"tagged": ("pass", 0), "title": ("pass", 0), "language": ("pass", 0), "permission": ("pass", 0), "tab-order": ("pass", 0), "identifier": ("fail", 0), "bookmarks": ("na", 0), "h1": ("pass", 0), "links": ("na", 0), "figure-text": ("pass", 0), "orphaned-content": ("fail", 1)}
    assert {r.doc_id: r.fixable for r in audit.identifier_gate(report).collect()} == {1: False, 4: False}


def test_orphan_streams(spark):
    """Short streams with what is claimed: marked content without a tag, untagged spans, paint outside every span."""
    cases = [
        ("BDC P 7, Tj, EMC", (), (1, 0, 0)), ("BMC Span, Tj, EMC", (), (0, 1, 0)), ("BDC H1 -, BDC H1 -, BDC H1 3, Tj, EMC, EMC, EMC", (3,), (0, 0, 0)), ("BDC P 1, BMC Span, Tj, EMC, EMC", (1,), (0, 0, 0)),
        ("q, Do, Q", (), (0, 0, 1)), ("BMC Artifact, f, EMC", (), (0, 0, 0)), ("q, cm, Q", (), (0, 0, 0))]
    ops, claimed = [], []
    for d, (stream, owned, _) in enumerate(cases):
        for i, x in enumerate(stream.split(", ")):
            op, tag, mcid = (*x.split(), None, None)[:3]
            ops.append((d, i, op, tag, int(mcid) if mcid not in (None, "-") else None))
        claimed += [(d, m) for m in owned]
    got = {r.doc_id: (r.n_mcids, r.n_spans, r.n_runs) for r in content.orphan_totals(spark.createDataFrame(ops, "doc_id long, op_idx long, op string, tag string, mcid int"), spark.createDataFrame(claimed, "doc_id long, mcid int")).collect()}
    assert got == {d: n for d, (_, _, n) in enumerate(cases) if any(n)}


def _page(rows):
    """Glyphs 6 by 10 of rows {y: [(x, phrase)]}."""
    return [(1, y, i, float(x + 6 * i), float(y), float(x + 6 * i + 6), float(y + 10)) for y, phrases in rows.items() for x, p in phrases for i, c in enumerate(p) if c != " "]


def test_seed_grids(spark):
    """Dividers of rows and columns of small tables."""
    plain = lambda y: (y, [(0, "Alpha"), (100, "Beta"), (200, "Gamma"), (300, "Delta")])
    schema = "doc_id long, line long, col int, x0 double, y0 double, x1 double, y1 double"

    def seeds(rows):
        boxes = spark.createDataFrame(_page(dict(rows)), schema)
        frame = spark.createDataFrame([(1, -10.0, -10.0, 400.0, 90.0)], "doc_id long, x double, y double, width double, height double")
        found = geometry.seed_grid(boxes, frame).collect()
        return [sorted(r["at"] for r in found if r.axis == axis) for axis in ("x", "y")]

    near = lambda got, want: len(got) == len(want) and all(abs(a - b) <= 2 for a, b in zip(got, want))
    for rows, xs, ys in [
        ([(0, [(0, "Name"), (100, "Quarterly results for the region")]), plain(20), plain(40), plain(60)], [65, 162, 265], [15, 35, 55]),
        ([plain(0), (12, [(100, "continued")]), plain(40), plain(60)], [65, 177, 265], [31, 55]),
        ([plain(y) for y in (0, 20, 40, 60)], None, [15, 35, 55]),
        ([plain(0), (20, [(100, "Beta")]), plain(40), plain(60)], [65, 162, 265], [15, 35, 55]),
    ]:
        got = seeds(rows)
        assert near(got[1], ys) and (xs is None or near(got[0], xs)), (got, xs, ys)


def test_pages_and_flatten_keep_content(spark):
    rows = [node(0, None, "root"), node(1, 0, "element", "Document"), node(2, 1, "element", "P"), node(3, 2, "element", "Div"), node(4, 3, "element", "Span", 1), node(5, 4, "content", mcid=3), node(6, 2, "content", mcid=9), node(7, 1, "element", "Sub", 0), node(8, 7, "content", mcid=3)]
    tree = t.tree_keys(spark.createDataFrame(rows, NODE))
    flat = t.tree_keys(rewrite.flatten(tree, tree.filter("depth = 1").select("doc_id", "node_id")))
    assert {r.role for r in flat.collect()} == {None, "Document", "P"}
    assert rewrite.content_fingerprint(flat).first().fingerprint == rewrite.content_fingerprint(tree).first().fingerprint == "1:3 -:9 0:3"


def _brute_stream(ops):
    """Spans and depths of one page by a stack."""
    stack, spans, depth = [], [], []
    for i, op in ops:
        if op == "BDC":
            stack.append(i)
        elif op == "EMC" and stack:
            spans.append((stack.pop(), i))
        depth.append(len(stack))
    return depth, sorted(spans + [(i, None) for i in stack])


def test_instruction_streams_against_a_stack(spark):
    rnd, rows, want = random.Random(3), [], {}
    for doc in range(40):
        ops = [(i, rnd.choice(["BDC", "EMC", "Tj", "q"])) for i in range(30)]
        want[doc] = _brute_stream(ops)
        rows += [(doc, i, op, "P" if op == "BDC" else None, None) for i, op in ops]
    deep = content.with_depth(spark.createDataFrame(rows, "doc_id long, op_idx long, op string, tag string, mcid int"))
    got = {}
    for r in deep.orderBy("doc_id", "op_idx").collect():
        got.setdefault(r.doc_id, []).append(r.depth)
    spans = {}
    for r in content.spans(deep).collect():
        spans.setdefault(r.doc_id, []).append((r.open_idx, r.close_idx))
    for doc, (depth, s) in want.items():
        assert got[doc] == depth and sorted(spans.get(doc, [])) == s


def test_streams_of_fixed_cases(spark):
    cases = {1: [("BDC", "P", 7), ("Tj", None, None), ("EMC", None, None)], 2: [("BMC", "Span", None), ("Tj", None, None), ("EMC", None, None)], 3: [("BDC", "H1", None), ("BDC", "H1", None), ("BDC", "H1", 3), ("Tj", None, None), *[("EMC", None, None)] * 3], 4: [("q", None, None), ("Do", None, None), ("Q", None, None)], 5: [("BMC", "Artifact", None), ("f", None, None), ("EMC", None, None)], 6: [("q", None, None), ("cm", None, None), ("Q", None, None)]}
    ops = spark.createDataFrame([(d, i, *o) for d, os in cases.items() for i, o in enumerate(os)], "doc_id long, op_idx long, op string, tag string, mcid int")
    claimed = spark.createDataFrame([(3, 3)], "doc_id long, mcid int")
    assert {r.doc_id: (r.n_mcids, r.n_spans, r.n_runs) for r in content.orphan_totals(ops, claimed).collect()} == {1: (1, 0, 0), 2: (0, 1, 0), 4: (0, 0, 1)}
    assert content.orphan_totals(content.repaired(ops, claimed), claimed).count() == 0


def _plain_alignment(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            out.append(("common", a[i]))
            i, j = i + 1, j + 1
        elif j == len(b) or (i < len(a) and best[i + 1][j] >= best[i][j + 1]):
            out.append(("removed", a[i]))
            i += 1
        else:
            out.append(("added", b[j]))
            j += 1
    return out


def test_word_difference(spark):
    named = lambda a, b: [((("common", "removed", "added")[o % 3]), (b if o % 3 == text.ADDED else a)[o // 3]) for o in text.align(a, b)]
    assert named(["a", " ", "b", " ", "c"], ["a", " ", "x", " ", "c"]) == [("common", "a"), ("common", " "), ("removed", "b"), ("added", "x"), ("common", " "), ("common", "c")]
    rnd, cases = random.Random(1), []
    for _ in range(3_000):
        a = [rnd.choice("abcd"[: rnd.randint(2, 4)]) for _ in range(rnd.randint(0, 14))]
        b = [x for x in a if rnd.random() < 0.8] + [rnd.choice("ab") for _ in range(rnd.randint(0, 3))] if rnd.random() < 0.5 else [rnd.choice("abcd") for _ in range(rnd.randint(0, 14))]
        assert named(a, b) == _plain_alignment(a, b)
        cases.append((" ".join(a), "\t".join(b)))
    odd = [(None, "a"), ("a", None), ("", "a b"), ("a\xa0b", "a b"), ("same", "same"), ("x " * 5_000, "y " * 5_000)]
    got = text.word_diff(spark.createDataFrame([(i, *c) for i, c in enumerate(cases[:200] + odd)], "k long, a string, b string")).orderBy("k").collect()
    for r in got[:200]:
        words = lambda t: re.findall(r"[ \t]+|[^ \t]+", t)
        assert [(o.type, o.text) for o in r.ops] == _plain_alignment(words(r.a), words(r.b))
    assert [r.status for r in got[200:]] == ["long", "long", "aligned", "aligned", "equal", "long"] and got[202].ops[0].type == "added" and got[205].ops is None


def test_diff_regions(spark):
    pairs = spark.createDataFrame([(1, "one two three", "one 2 three"), (2, "one three", "one two three"), (3, "same", "same")], "k long, a string, b string")
    got = {(r.k, r.start, r.end, r.inserted) for r in text.diff_regions(text.word_diff(pairs), "k").collect()}
    assert {x for x in got if x[0] == 1} == {(1, 4, 7, False)} and all(x[3] for x in got if x[0] == 2) and not any(x[0] == 3 for x in got)


def test_lenient_replies(spark):
    rows = [('x ```json\n{"a": 1}\n``` y', '{"a": 1}\n'), ('[1, 2]', "[1, 2]"), ('see {"a": "}"} end', '{"a": "}"}'), ("none", None)]
    got = [r[0] for r in spark.createDataFrame(rows, "reply string, want string").select(text.lenient_json(F.col("reply"))).collect()]
    assert [g and g.strip() for g in got] == [w and w.strip() for _, w in rows]


def test_grid_places():
    assert tables.place([[(1, 2), (1, 1)], [(1, 1)]]) == ([[0, 1], [1]], 2, None)
    assert tables.place([[(2, 1)], [(1, 1)]])[2] == "ragged width"
    assert tables.place([[(1, 1), (1, 2)], [(2, 1)]])[2] == "overlap"
    assert tables.place([[(1, 3)], [(1, 1)]])[2] == "past the last row"


def test_table_of_glyphs(spark):
    plain, lines = ["Alpha", "Beta", "Gamma", "Delta"], []
    for y in range(4):
        lines.append((1, y, "".join(w.ljust(17) for w in plain)))
    glyphs = geometry.glyphs(spark.createDataFrame(lines, "doc_id long, line int, text string"))
    assert sorted(r.y for r in geometry.row_dividers(geometry.line_clusters(glyphs)).collect()) == [15, 35, 55]
    assert sorted(r.x for r in geometry.column_dividers(geometry.phrases(glyphs)).collect()) == [66, 165, 270]


def test_streaming_equals_batch(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(d, i, 1_700_000_000 + i * 37 + d, rnd.choice(["edit", "edit", "undo", "redo"]), rnd.choice([None, "a"]), True) for d in range(4) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, seq long, s long, cmd string, undo_group string, changes boolean").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    df.coalesce(1).write.parquet(str(tmp_path / "edits"))
    for name, run, mode in (("sessions", ed.sessions, "complete"), ("undo_redo", ed.undo_redo, "append"), ("autosave_ticks", ed.autosave_ticks, "complete")):
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "edits"))
        q = run(stream).writeStream.outputMode(mode).format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
        assert sorted(map(str, spark.table(name).collect())) == sorted(map(str, run(spark.read.parquet(str(tmp_path / "edits"))).collect()))


def test_undo_redo():
    got = ed.replay([(1, "edit"), (2, "edit"), (3, "undo"), (4, "redo"), (5, "undo"), (6, "edit"), (7, "redo")], [], [])
    assert [(v, r) for _, v, _, _, r in got] == [(1, False), (2, False), (1, False), (2, False), (1, False), (6, False), (6, True)]


def test_markup_and_versions(spark, tmp_path):
    html = '<body><h1>T</h1><p>one<b>two<p>three<script>var t="</p>";</script><ul><li>x<li>y</ul><img alt="pic">'
    got = [(r.role, r.parent_id, r.text) for r in src.markup_nodes(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).orderBy("node_id").collect()]
    assert [g[0] for g in got if g[0]] == ["Document", "H1", "P", "Span", "P", "L", "LI", "LI", "Figure"]
    root = str(tmp_path / "v")
    src.save_version(spark.range(1), root, 1, "2024-01-01 00:00:00")
    src.save_version(spark.range(2), root, 2, "2024-02-01 00:00:00")
    assert src.open_version(spark, root).count() == 2 and src.open_version(spark, root, 1).count() == 1
    assert [r.version for r in src.expired_versions(spark.read.parquet(f"{root}/versions"), "2024-03-01 00:00:00").collect()] == [1]


def test_a_keys_rows_stay_in_one_task_behind_a_join(spark):
    """The small side comes late, so that the join becomes one by broadcast when the large side is already dealt by key."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "8KB", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    late = F.udf(lambda x: time.sleep(0.5) or 3.5, "double")
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        levels = spark.range(0, 4000, 1, 8).selectExpr("id % 20 AS doc_id", "floor(id / 20) * 20.0 AS mid", "10.0 AS h", "1L AS n", "0.0 AS top", "1.0 AS bottom")
        small = spark.range(0, 20, 1, 2).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 0, late("id")).otherwise(3.5).alias("tolerance")).groupBy("doc_id").agg(F.max("tolerance").alias("tolerance"))
        got = geometry.fold(levels.join(small, "doc_id"), ["doc_id"], ["mid", "h"], geometry._Lines, "doc_id long, line_no long, n long, top double, bottom double").collect()
        assert sorted((r.doc_id, r.line_no) for r in got) == [(d, n) for d in range(20) for n in range(200)]
    finally:
        for k in conf:
            spark.conf.unset(k)


def test_a_tree_is_read_by_document_without_a_shuffle(spark):
    nodes = spark.createDataFrame([node(1, None, "root"), node(2, 1, "element", "Document"), node(3, 2, "element", "P"), node(4, 3, "content", page=0, mcid=1), node(5, 2, "element", "P")], NODE)
    tree = t.tree_keys(nodes)
    assert [(r.node_id, r.depth, r.pre, r.last_pre) for r in tree.orderBy("pre").collect()] == [(1, 0, 1, 5), (2, 1, 2, 5), (3, 2, 3, 4), (4, 3, 4, 4), (5, 2, 5, 5)]
    for df in (t.leaves(tree), t.page_of(tree), tree.groupBy("doc_id", "parent_id").count()):
        assert "Exchange hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()


def test_tasks_grow_with_rows(spark, monkeypatch):
    from arborea.operators import layout, regions
    from arborea.sources import scratch
    monkeypatch.setattr(scratch, "ROWS", 10)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    paints = spark.range(20 * least).selectExpr("id DIV 2 AS doc_id", "id AS op_idx", "0D AS x0", "0D AS y0", "9D AS x1", "9D AS y1")
    clips = spark.createDataFrame([(0, 0, 2, 1.0, 1.0, 5.0, 5.0), (0, 0, 9, 2.0, 0.0, 8.0, 4.0), (1, 9, 9, 7.0, 7.0, 8.0, 8.0), (2, 3, 9, 9.0, 0.0, 9.5, 9.0)], "doc_id long, open_idx long, close_idx long, x0 double, y0 double, x1 double, y1 double")
    cut = layout.clipped(paints, clips)
    assert cut.rdd.getNumPartitions() == 2 * least
    rows = {r.op_idx: tuple(r)[2:] for r in cut.collect()}
    assert rows[0] == (0, 0, 9, 9) and rows[1] == (2, 1, 5, 4) and rows[2] == (0, 0, 9, 9) and 4 not in rows and len(rows) == 20 * least - 2
    lines = spark.range(20 * least).selectExpr("id DIV 4 AS region_id", "0L AS leaf", "CAST(id % 4 AS INT) AS line_no", "IF(id % 2 = 0, 10D, 30D) AS x", "id % 4 * 12D AS y", "id % 4 * 7 AS start", "id % 4 * 7 + 7 AS end")
    entries = regions.hanging_entries(lines)
    assert entries.rdd.getNumPartitions() == 2 * least
    assert sorted((r.start, r.end, r.item_no) for r in entries.filter("region_id = 3").collect()) == [(0, 14, 1), (14, 28, 2)]


def test_a_tree_leaves_no_other_table(spark, monkeypatch):
    from pathlib import Path

    import pytest
    from arborea.sources.scratch import shared_dir
    monkeypatch.setattr(t, "BUCKET", 3)
    rows = [(d, *node(*x)[1:]) for d in range(4) for x in ((1, None, "root"), (2, 1, "element", "Document"), (3, 2, "element", "P"), (4, 3, "content"), (9, 8, "element", "P"))]
    before = set(Path(shared_dir(spark)).iterdir())
    tree = t.tree_keys(spark.createDataFrame(rows, NODE))
    made = set(Path(shared_dir(spark)).iterdir()) - before
    assert [x.name.split("_")[0] for x in made] == ["tree"]
    assert sorted((r.doc_id, r.node_id, r.pre, r.last_pre) for r in tree.collect()) == [(d, n, n, 4) for d in range(4) for n in range(1, 5)]
    assert t.tree_keys(tree, rows=16, most_levels=4).count() == 16
    with pytest.raises(ValueError):
        t.tree_keys(tree, most_levels=3)


def test_a_tree_is_small_on_disk(spark, monkeypatch):
    from pathlib import Path

    from arborea.plans import adapters
    from arborea.sources import scratch
    monkeypatch.setattr(t, "KIDS", 4)
    before = {x.name for x in Path(scratch.shared_dir(spark)).iterdir()}
    rows = [node(1, None, "root"), node(2, 1, "element", "Document"), *(node(n, 2, "element", "P") for n in range(3, 13))]
    tree = t.tree_keys(spark.createDataFrame(rows, NODE))
    assert [(r.node_id, r.pre, r.last_pre, [(s.node_id, s.parent_id) for s in r.path]) for r in tree.orderBy("pre").collect()] == [
        (n, n, 12 if n < 3 else n, [(1, None), (2, 1), (n, 2)][:min(n, 3)]) for n in range(1, 13)]
    # siblings share a row and its path, but no row holds more than a few of them
    held = spark.read.parquet(str(next(x for x in Path(scratch.shared_dir(spark)).iterdir() if x.name not in before)))
    assert max(r.n for r in held.selectExpr("size(kids) AS n").collect()) == 4 and held.count() == 6
    # the nodes of the given tables are read where their lines lie, and the tree's table alone stays
    nodes = adapters.view(spark, "/root/testdata/sf0.001", adapters.NODES)
    assert "Exchange" not in nodes.groupBy("doc_id", "parent_id").count()._jdf.queryExecution().executedPlan().toString()


def test_a_write_keeps_no_shuffle(spark):
    from pathlib import Path

    from arborea.sources import scratch

    def shuffles() -> set[str]:
        return {x.name for top in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs() for x in Path(top.getPath()).rglob("shuffle_*.data")}

    key, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", shuffles()
    rows = spark.range(1000).repartition(3, "id")
    told = spark.conf.get(key)
    made = [scratch.written(rows, "rows"), scratch.Dealt(spark, "dealt", "id", 3).add(spark.range(1000))]
    deadline = time.time() + 20
    while shuffles() - before and time.time() < deadline:
        time.sleep(0.2)
    assert not shuffles() - before and spark.conf.get(key) == told
    assert [x.count() for x in made] == [1000, 1000]


def test_an_alignment_stays_in_its_row(spark):
    pairs = spark.createDataFrame([(1, "a b  c d", "a X  c Y Z"), (2, "same", "same"), (3, None, "a"), (4, "one two", "one and two"), (5, "x y", "x  y")], "doc_id long, a string, b string")
    diff = text.word_diff(pairs)
    side = diff.filter("ops IS NOT NULL").select("doc_id", text.new_side(F.col("ops")).alias("side")).select("doc_id", F.size("side"), F.col("side.text"))
    regions = text.diff_regions(diff, "doc_id")
    for df in (diff, side, regions):
        plan = df._jdf.queryExecution().executedPlan().toString()
        # neither dealt token by token nor cut to tokens for each of them
        assert "Exchange" not in plan and not re.search(r"element_at\(regexp_extract_all", plan)
    assert sorted(map(tuple, regions.collect())) == [(1, 2, 3, False), (1, 7, 8, False), (4, 4, 4, True)]
    assert {r.doc_id: r.text for r in side.collect()} == {1: ["a", " ", "X", "  ", "c", " ", "Y", " ", "Z"], 2: ["same"], 4: ["one", " ", "and", " ", "two"], 5: ["x", "  ", "y"]}


def test_boxes_of_glyphs_stay_with_their_document(spark, monkeypatch):
    monkeypatch.setattr(geometry, "CHARACTERS", 10)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = spark.createDataFrame([(d, n, f"ab  c{n} d") for d in range(40) for n in range(3)], "doc_id long, line int, text string")
    boxes = geometry.glyphs(lines)
    assert boxes.rdd.getNumPartitions() == 96 > least
    for df in (geometry.words(boxes), geometry.phrases(boxes).groupBy("doc_id").agg(F.count("*").alias("n"))):
        # lines alone are dealt, before there is a row a glyph
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan
    assert sorted(tuple(r) for r in geometry.words(boxes).filter("doc_id = 7").collect()) == [(7, i + 1, n) for i, n in enumerate([2, 2, 1] * 3)]
    assert geometry.phrases(boxes).filter("doc_id = 7").count() == 6


def test_streams_and_findings_stay_with_their_document(spark):
    from arborea.operators import content as c
    from arborea.plans import adapters
    ops = adapters.view(spark, "/root/testdata/sf0.001", adapters.LEAF_OPS)
    assert "Exchange hashpartitioning" not in c.shown_text(ops)._jdf.queryExecution().executedPlan().toString()
    tree = adapters.tree(spark, "/root/testdata/sf0.001")
    flat = t.tree_keys(rewrite.flatten(tree, tree.filter("depth = 1").select("doc_id", "node_id")), buckets=tree.rdd.getNumPartitions())
    assert flat.rdd.getNumPartitions() == tree.rdd.getNumPartitions() and flat.filter("depth = 0").count() == tree.filter("depth = 0").count()


def test_a_tree_is_numbered_in_arrays(spark, monkeypatch):
    from arborea.operators import keys
    rows = [(d, *node(*x)[1:]) for d in range(5) for x in ((1, None, "root"), (2, 1, "element", "Document"), (9, 2, "element", "P"), (4, 9, "content"), (5, 2, "element", "Figure"), (6, 1, "element", "P"), (8, 7, "element", "P"))]
    rows += [(7, *node(n, n - 1 or None, "element", "Div")[1:]) for n in range(1, 9)]
    nodes = spark.createDataFrame(rows, NODE)
    shown = lambda tree: sorted((r.doc_id, r.node_id, r.depth, r.pre, r.last_pre, r.above_role, r.above_type, r.above_page, r.above_bbox, r.leafy, str(r.path)) for r in tree.collect())
    by_level, asked = t._by_level, []
    monkeypatch.setattr(t, "_by_level", lambda *x: asked.append(x) or by_level(*x))
    arrays = shown(t.tree_keys(nodes, buckets=1))
    assert not asked and len(arrays) == 38 and [x[5:10] for x in arrays if x[0] == 0] == [
        (None, None, None, False, True), (None, "root", None, False, True), ("P", "element", None, False, True), ("Document", "element", None, False, False), (None, "root", None, False, False), ("Document", "element", None, False, True)]
    # too many nodes for a task, in one batch and in many, and too long a path: level by level, with the same keys
    monkeypatch.setattr(keys, "STEP", 4)
    for most in (5, 7, 8):
        monkeypatch.setattr(keys, "MOST", most)
        assert shown(t.tree_keys(nodes, buckets=1)) == arrays
    assert len(asked) == 3
    # an id that occurs twice has its children below each
    twice = spark.createDataFrame([(1, *node(*x)[1:]) for x in ((1, None, "root"), (2, 1, "element", "P"), (2, 1, "element", "P"), (3, 2, "content"))], NODE)
    assert sorted((r.node_id, r.depth) for r in t.tree_keys(twice, buckets=1).collect()).count((3, 2)) == 2 and len(asked) == 4


def test_regions_of_pairs_of_any_length(spark):
    import random
    many = [f"w{n}" for n in range(3000)]
    pairs = spark.createDataFrame([(1, " ".join(many), " ".join(["X", *many[1:-1], "Y"])), (2, "a b", "a c")], "doc_id long, a string, b string")
    assert [r.status for r in text.word_diff(pairs).orderBy("doc_id").collect()] == ["long", "aligned"]
    got = text.diff_regions(text.word_diff(pairs, every=True), "doc_id").collect()
    end = len(" ".join(many))
    assert sorted(map(tuple, got)) == [(1, 0, 2, False), (1, end - 5, end, False), (2, 2, 3, False)]

    def plain(a, b):
        size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                size[i][j] = size[i + 1][j + 1] + 1 if a[i] == b[j] else max(size[i + 1][j], size[i][j + 1])
        return size[0][0]

    draw = random.Random(5)
    for n in range(200):
        a, b = ([draw.choice("abcd") for _ in range(draw.randrange(40))] for _ in range(2))
        ops = text.align(a, b)
        assert [a[o // 3] for o in ops if o % 3 < 2] == a and [a[o // 3] if o % 3 == 0 else b[o // 3] for o in ops if o % 3 != 1] == b
        assert sum(o % 3 == 0 for o in ops) == plain(a, b)

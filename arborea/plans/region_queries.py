"""Queries of regions, anchors, affine maps and cells, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import content as c
from ..operators import geometry as g
from ..operators import regions as n
from ..operators import tables as b
from ..operators import tagging as g_
from ..operators import tree as t
from ..sources.scratch import written
from .adapters import LEAF_OPS, OUTLINE, PAGE_CLAIMED, PAGE_OPS, RECTS, oracle, view
from .content_queries import PAGE_ORPHANS, PAGE_STREAMS
from .registry import register
from .table_queries import _CELLS
from .tree_queries import _OWNERS, on_tree

#: Glyphs of a run: an order's lines.
RUNS = "SELECT l_orderkey AS run_id, CAST(l_linenumber AS INT) AS seq, CAST(max(l_partkey) % 50 AS DOUBLE) AS x, CAST(max(l_partkey) % 4 AS DOUBLE) * 0.9 AS y, CAST(max(l_suppkey) % 7 + 1 AS BIGINT) AS n_chars FROM {lineitem} GROUP BY l_orderkey, l_linenumber"
_RUNS = f"runs AS ({oracle(RUNS)})"
register("run_lines", lambda s, d: n.run_lines(view(s, d, RUNS)), f"""WITH RECURSIVE {_RUNS}, k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS k, coalesce(sum(n_chars) OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM runs),
 w AS (SELECT *, y AS fy, 0 AS line_no FROM k WHERE k = 1 UNION ALL SELECT k.*, CASE WHEN abs(k.y - w.fy) > 1.5 THEN k.y ELSE w.fy END, CASE WHEN abs(k.y - w.fy) > 1.5 THEN w.line_no + 1 ELSE w.line_no END FROM w JOIN k ON k.run_id = w.run_id AND k.k = w.k + 1)
 SELECT run_id, CAST(line_no AS INT) AS line_no, min(x) AS x, min_by(y, k) AS y, CAST(min(p) AS BIGINT) AS start, CAST(max(p + n_chars) AS BIGINT) AS "end" FROM w GROUP BY run_id, line_no""")
_ITEMS = "SELECT *, CASE WHEN seq % 5 < 4 THEN CAST(n_chars % 2 AS INT) END AS item_no, x > 25 AS labelled FROM ({0}) z"
register("merged_items", lambda s, d: n.merged_items(view(s, d, _ITEMS.format(RUNS)).withColumnRenamed("seq", "run_no"), "run_id"),
         f"WITH i AS ({_ITEMS.format(oracle(RUNS))}), k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) - CASE WHEN item_no IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY run_id, item_no ORDER BY seq) END AS isle FROM i) SELECT run_id, min(seq) AS first_no, count(*) AS n_runs, item_no, bool_or(labelled) AS labelled FROM k GROUP BY run_id, item_no, isle")
_MARKED = "CASE WHEN (doc_id + line_no) % 5 = 1 THEN '• ' WHEN (doc_id + line_no) % 7 = 2 THEN ' 12. ' ELSE '' END || line"


def _marked(s, d):
    lines = s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select("doc_id", "line_no", F.expr(_MARKED).alias("text"), (F.col("line_no") * 10).alias("start"), (F.col("line_no") * 10 + 10).alias("end"))


register("list_pieces", lambda s, d: n.list_pieces(_marked(s, d), "doc_id"), f"""WITH l AS (SELECT doc_id, i - 1 AS line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)),
 m AS (SELECT doc_id, line_no, regexp_matches({_MARKED}, '^[ \\t]*([•‣◦▪●○*]|[A-Za-z]\\.|[0-9]+\\.)([ \\t]|$)') AS opens FROM l), o AS (SELECT doc_id, line_no, opens, lead(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) AS nxt FROM m WHERE opens OR line_no = 0), z AS (SELECT doc_id, max(line_no) AS top FROM m GROUP BY doc_id)
 SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS INT) AS item_no, CAST(line_no * 10 AS INT) AS start, CAST(coalesce(nxt, top + 1) * 10 AS INT) AS "end", opens AS labelled FROM o JOIN z USING (doc_id)""")
#: Lines of a region: an order's lines down the page, some of them indented.
HUNG = "SELECT l_orderkey AS region_id, CAST(l_linenumber / 4 AS BIGINT) AS leaf, CAST(l_linenumber AS INT) AS line_no, CASE WHEN max(l_partkey) % 3 = 0 THEN 30.0 ELSE 10.0 + max(l_partkey) % 3 END AS x, l_linenumber * 12.0 AS y, CAST(l_linenumber * 7 AS BIGINT) AS start, CAST(l_linenumber * 7 + CASE WHEN max(l_suppkey) % 3 = 0 THEN 6 ELSE 7 END AS BIGINT) AS stop FROM {lineitem} GROUP BY l_orderkey, l_linenumber"
_D = lambda df: df.withColumns({k: F.col(k).cast("double") for k in ("x", "y")}).withColumnRenamed("stop", "end").withColumn("leaf", F.floor(F.col("line_no") / 4).cast("long"))
register("hanging_entries", lambda s, d: n.hanging_entries(written(_D(view(s, d, HUNG, lineitem="l_orderkey")), "hung")), f"""WITH h AS (SELECT * REPLACE (CAST(line_no // 4 AS BIGINT) AS leaf) FROM ({oracle(HUNG)})), m AS (SELECT *, x <= min(x) OVER (PARTITION BY region_id) + 2.5 AS starts FROM h),
 f AS (SELECT region_id FROM m GROUP BY region_id HAVING count(*) >= 3 AND count(*) FILTER (starts) >= 2 AND min(x) FILTER (NOT starts) - max(x) FILTER (starts) >= 4 AND max(line_no) FILTER (NOT starts) > min(line_no) FILTER (starts)),
 i AS (SELECT *, (SELECT count(*) FROM m o WHERE o.region_id = m.region_id AND o.line_no <= m.line_no AND (o.starts OR NOT EXISTS (SELECT 1 FROM m b WHERE b.region_id = o.region_id AND b.line_no < o.line_no))) AS item_no FROM m WHERE region_id IN (SELECT region_id FROM f)),
 e AS (SELECT *, CASE WHEN lag(item_no) OVER w = item_no AND lag(leaf) OVER w = leaf AND lag(stop) OVER w = start THEN 0 ELSE 1 END AS new FROM i WINDOW w AS (PARTITION BY region_id ORDER BY line_no)), s AS (SELECT *, sum(new) OVER (PARTITION BY region_id ORDER BY line_no) AS piece FROM e)
 SELECT region_id, min(leaf) AS leaf, min(start) AS start, max(stop) AS "end", CAST(min(item_no) AS INT) AS item_no FROM s GROUP BY region_id, piece""")
_SHOWN = "SELECT run_id, seq, repeat(chr(CAST(97 + n_chars AS INT)), CAST(n_chars AS INT)) AS text, seq * 30.0 + x / 5 AS x, CASE WHEN n_chars % 3 = 0 THEN 5.0 ELSE 0.0 END AS y, seq * 30.0 + 30.0 + x / 9 AS end_x, CASE WHEN n_chars % 3 = 0 THEN 5.0 ELSE 0.0 END AS end_y, 10.0 AS size FROM ({0}) z"
register("broken_text", lambda s, d: n.broken_text(view(s, d, _SHOWN.format(RUNS)), "run_id"), f"WITH z AS ({_SHOWN.format(oracle(RUNS))}), j AS (SELECT *, x - lag(end_x) OVER w AS dx, y - lag(end_y) OVER w AS dy FROM z WINDOW w AS (PARTITION BY run_id ORDER BY seq)) SELECT run_id, substr(string_agg(CASE WHEN abs(dy) > 4 OR dx > 2.5 OR dx < -5 THEN ' ' ELSE '' END || text, '' ORDER BY seq), 1, 300) AS text FROM j GROUP BY run_id")
_PLACED = "SELECT doc_id, page, op_idx, CAST(max(mcid) OVER (PARTITION BY doc_id, page, CAST(floor(op_idx / 4) AS BIGINT)) AS INT) AS mcid, CAST(op_idx % 53 AS DOUBLE) AS y, op = 'Tj' AND visible AS shows FROM ({0}) z"
_ANCHORS = f"placed AS ({_PLACED.format(oracle(LEAF_OPS))}), anchors AS (SELECT doc_id, page, mcid, coalesce(arg_min(y, op_idx) FILTER (shows), arg_min(y, op_idx)) AS y FROM placed GROUP BY ALL)"
register("mcid_anchors", lambda s, d: n.mcid_anchors(view(s, d, _PLACED.format(LEAF_OPS))), f"WITH {_ANCHORS} SELECT * FROM anchors")
_BOXES = lambda x: x.filter("has_bbox").select("doc_id", "node_id", (F.col("node_id") % 50).cast("double").alias("y"))
_anchored = lambda x, w: n.node_anchors(x, n.mcid_anchors(w(_PLACED.format(LEAF_OPS))), _BOXES(x))
_POSITIONS = f"""{_ANCHORS}, spots AS (SELECT t.doc_id, t.node_id, t.page, a.y, t.pre AS at, 0 AS k FROM tree t JOIN anchors a ON a.doc_id = t.doc_id AND a.page = t.page AND a.mcid = t.mcid WHERE t.type = 'content'
  UNION ALL SELECT doc_id, node_id, page, CAST(node_id % 50 AS DOUBLE), last_pre, 1000 - depth FROM tree WHERE has_bbox AND type = 'element' AND page IS NOT NULL),
 ranked AS (SELECT a.doc_id, a.anc AS node_id, s.page, s.y, row_number() OVER (PARTITION BY a.doc_id, a.anc ORDER BY s.at, s.k) AS n FROM spots s JOIN anc a ON a.doc_id = s.doc_id AND a.node_id = s.node_id), positions AS (SELECT doc_id, node_id, page, y FROM ranked WHERE n = 1)"""
on_tree("node_anchors", _anchored, f", {_POSITIONS} SELECT * FROM positions")
_GOALS = lambda x: x.filter("type = 'element' AND depth = 2").select("doc_id", F.col("node_id").alias("parent_id"), F.lit(1).alias("target_id"), (F.col("node_id") % 7).cast("int").alias("page"), F.lit(25.0).alias("y"))
on_tree("insertion_index", lambda x, w: n.insertion_index(x, _anchored(x, w), _GOALS(x)), f""", {_POSITIONS}, kids AS (SELECT doc_id, parent_id, node_id, row_number() OVER (PARTITION BY doc_id, parent_id ORDER BY ord, node_id) - 1 AS i FROM tree WHERE parent_id IS NOT NULL)
 SELECT g.doc_id, g.node_id AS parent_id, 1 AS target_id, CAST(coalesce(min(k.i) FILTER (p.page > g.node_id % 7 OR (p.page = g.node_id % 7 AND p.y < 25)), count(k.node_id)) AS INT) AS index FROM tree g LEFT JOIN kids k ON k.doc_id = g.doc_id AND k.parent_id = g.node_id LEFT JOIN positions p ON p.doc_id = k.doc_id AND p.node_id = k.node_id WHERE g.type = 'element' AND g.depth = 2 GROUP BY ALL""")

# a figure for each part of the outline: every other one an object
_FIGS = f"SELECT doc_id, bookmark_id AS figure_id, page, CAST(bookmark_id % 60 AS DOUBLE) AS y, CASE WHEN bookmark_id % 2 = 0 THEN bookmark_id + 5 END AS target_id FROM ({OUTLINE}) o"
on_tree("place_figures", lambda x, w: g_.place_figures(x, w(_FIGS), _anchored(x, w), F.lit(1_000_000_000_000) + F.col("figure_id"), F.lit(2_000_000_000_000) + F.col("figure_id")).select("doc_id", "node_id", "parent_id", "ord", "type", "has_bbox", "own_page"),
        f""", {_POSITIONS}, home AS (SELECT doc_id, node_id AS parent_id FROM tree WHERE depth = 1 AND role = 'Document'), kids AS (SELECT t.*, row_number() OVER (PARTITION BY doc_id, parent_id ORDER BY ord, node_id) - 1 AS i FROM tree t),
 f AS (SELECT figs.*, home.parent_id, coalesce((SELECT min(k.i) FROM kids k JOIN positions p ON p.doc_id = k.doc_id AND p.node_id = k.node_id WHERE k.doc_id = figs.doc_id AND k.parent_id = home.parent_id AND (p.page > figs.page OR (p.page = figs.page AND p.y < figs.y))), (SELECT count(*) FROM kids k WHERE k.doc_id = figs.doc_id AND k.parent_id = home.parent_id)) AS i FROM figs JOIN home USING (doc_id)),
 k AS (SELECT doc_id, node_id, parent_id, i, 1 AS b, 0 AS n, type, has_bbox, own_page FROM kids UNION ALL SELECT doc_id, 1000000000000 + figure_id, parent_id, i, 0, figure_id, 'element', target_id IS NULL, page FROM f UNION ALL SELECT doc_id, 2000000000000 + figure_id, 1000000000000 + figure_id, i, 0, figure_id, 'object-ref', false, page FROM f WHERE target_id IS NOT NULL)
 SELECT doc_id, node_id, parent_id, CAST(row_number() OVER (PARTITION BY doc_id, parent_id ORDER BY i, b, n, node_id) - 1 AS BIGINT) AS ord, type, has_bbox, own_page FROM k""", ("figs", _FIGS))

# boxes
_SIZED = "SELECT CAST(leaf_id % 40 AS BIGINT) AS doc_id, CAST(width AS DOUBLE) AS width, CAST(height AS DOUBLE) AS height, leaf_id % 3 = 0 OR leaf_id % 40 < 5 AS coarse FROM ({0}) z"
register("median_width", lambda s, d: g.median_width(view(s, d, _SIZED.format(RECTS)), "doc_id"), f"SELECT doc_id, coalesce(median(width) FILTER (NOT coarse), median(height) / 2) AS width FROM ({_SIZED.format(oracle(RECTS))}) GROUP BY doc_id")
_BOX = "SELECT leaf_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(width AS DOUBLE) AS width, CAST(height AS DOUBLE) AS height FROM ({0}) z"
_M = lambda *v: F.array(*[F.lit(float(a)) for a in v])
register("affine_boxes", lambda s, d: view(s, d, _BOX.format(RECTS)).select("leaf_id", g.mapped_box(g.composed(_M(0, 2, -2, 0, 5, 7), _M(1, 0, 0, -1, 0, 100)), F.col("x"), F.col("y"), F.col("width"), F.col("height")).alias("b")).select("leaf_id", "b.*"),
         f"SELECT leaf_id, 5 - 2 * (y + height) AS x0, 100 - (2 * (x + width) + 7) AS y0, 5 - 2 * y AS x1, 100 - (2 * x + 7) AS y1 FROM ({_BOX.format(oracle(RECTS))})")
register("point_in_box", lambda s, d: view(s, d, _BOX.format(RECTS)).select("leaf_id", F.struct("x", "y", "width", "height").alias("b")).select("leaf_id", g.contains("b", F.lit(30.0), F.lit(20.0)).alias("inside"), g.contains("b", F.lit(30.0), F.lit(20.0), 0.5).alias("near")),
         f"SELECT leaf_id, 30 >= x AND 30 <= x + width AND 20 >= y AND 20 <= y + height AS inside, 30 >= x - 0.5 AND 30 <= x + width + 0.5 AND 20 >= y - 0.5 AND 20 <= y + height + 0.5 AS near FROM ({_BOX.format(oracle(RECTS))})")
register("fit_lines", lambda s, d: g.fit_lines(view(s, d, _BOX.format(RECTS)).withColumn("page", F.col("leaf_id") % 7), ["page"], "x", F.lit(3.0), F.lit(80.0)),
         f"""WITH RECURSIVE r AS (SELECT leaf_id % 7 AS page, x FROM ({_BOX.format(oracle(RECTS))}) WHERE x >= 7 AND x <= 79), kept AS (SELECT page, min(x) AS x FROM r GROUP BY page UNION ALL SELECT k.page, min(r.x) AS x FROM kept k JOIN r ON r.page = k.page AND r.x >= k.x + 4 GROUP BY k.page, k.x) SELECT page, x FROM kept""")

# cells
on_tree("add_column", lambda x, _: b.added_columns(b.cells(x)), f", {_CELLS} SELECT doc_id, tab, CAST(row_no AS INT) AS row_no, CAST(max(cell_no) + 1 AS INT) AS cell_no, 'TD' AS role FROM cells GROUP BY doc_id, tab, row_no")
on_tree("delete_row", lambda x, _: b.without_row(b.grid(b.cells(x)), 1), f", {_CELLS} SELECT doc_id, tab, node_id FROM placed WHERE row_no <> 1")


def _spanned(x):
    return b.grid(b.cells(x)).join(b.cells(x).select("doc_id", "node_id", "col_span", "role"), ["doc_id", "node_id"]).withColumn("row_span", F.lit(1))


_AREA = lambda x: b.cells(x).select("doc_id", "tab").distinct().select("*", F.lit(1).alias("r0"), F.lit(2).alias("r1"), F.lit(1).alias("c0"), F.lit(2).alias("c1"))
on_tree("merge_cells", lambda x, _: b.merged(_spanned(x), _AREA(x)), f""", {_CELLS}, inside AS (SELECT s.doc_id, s.tab, s.node_id, s.role, s.row_no, s.col_no, s.col_span, s.col_no + s.col_span - 1 <= 2 AS ok FROM sat s WHERE row_no <= 2 AND col_no <= 2)
 SELECT doc_id, tab, min_by(node_id, row_no * 100 + col_no) AS node_id, min_by(role, row_no * 100 + col_no) AS role, 2 AS row_span, 2 AS col_span, NOT (bool_and(ok) AND coalesce(sum(col_span) FILTER (ok), 0) = 4) AS refused FROM inside GROUP BY doc_id, tab""")
on_tree("unmerge_cells", lambda x, _: b.unmerged(_spanned(x)), f", {_CELLS} SELECT doc_id, tab, node_id, CAST(row_no AS INT) AS row_no, CAST(col_no + o.o AS INT) AS col_no, role FROM sat, (VALUES (0), (1)) o(o) WHERE col_span > 1 AND o.o < col_span")

# pages
register("repaired_pages", lambda s, d: c.repaired_pages(view(s, d, PAGE_OPS), view(s, d, PAGE_CLAIMED)).groupBy("doc_id", "page").agg(F.count_if(F.col("tag") == "Artifact").alias("n_artifacts")),
         f"WITH {PAGE_STREAMS}, {PAGE_ORPHANS} SELECT o.doc_id // 8 AS doc_id, CAST(o.doc_id % 8 AS INT) AS page, count(*) FILTER (tag = 'Artifact') + (SELECT count(*) FROM runs r WHERE r.doc_id = o.doc_id) + (SELECT count(*) FROM loose r WHERE r.doc_id = o.doc_id) + (SELECT count(*) FROM spans s JOIN mcids USING (doc_id, mcid) WHERE s.doc_id = o.doc_id AND s.tag <> 'Artifact') AS n_artifacts FROM ops o GROUP BY o.doc_id")
on_tree("repair_status", lambda x, w: c.repair_status(w("SELECT c_custkey AS doc_id FROM {customer}"), x, c.orphans_by_document(w(PAGE_OPS), w(PAGE_CLAIMED))),
        f", {PAGE_STREAMS}, {PAGE_ORPHANS} SELECT c_custkey AS doc_id, CASE WHEN c_custkey NOT IN (SELECT doc_id FROM nodes) THEN 'skipped' WHEN total IS NULL THEN 'clean' ELSE 'repaired' END AS status, CASE WHEN c_custkey IN (SELECT doc_id FROM nodes) THEN coalesce(total, 0) ELSE 0 END AS n FROM customer LEFT JOIN orphaned ON doc_id = c_custkey")

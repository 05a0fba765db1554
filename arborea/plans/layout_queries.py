"""Queries of boxes on pages, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry as g
from ..operators import layout as y
from .adapters import LINES, RECTS, REGIONS, oracle, view
from .registry import register
from .table_queries import _ROWS
from .tree_queries import HEADS, on_tree

_POINTS = "SELECT s_suppkey AS point_id, CAST(s_suppkey % 7 AS INT) AS page, s_suppkey % 97 * 1e0 AS x, s_nationkey * 2e0 AS y FROM {supplier}"
_KINDS = RECTS.replace("SELECT p_partkey AS leaf_id,", "SELECT p_partkey AS leaf_id, CASE WHEN p_partkey % 2 = 0 THEN 'text' ELSE 'image' END AS kind,")


def on_views(name, run, sql, **views):
    """A query over adapters, which the SQL names by keyword."""
    named = ", ".join(f"{k} AS ({oracle(v)})" for k, v in views.items())
    register(name, lambda s, d: run(**{k: view(s, d, v) for k, v in views.items()}), f"WITH {named}{sql}")


on_views("hit_test", lambda points, rects: y.hit_test(points, rects), " SELECT point_id, min_by(leaf_id, {'g': kind <> 'text', 'i': leaf_id}) AS leaf_id FROM points p JOIN rects r ON r.page = p.page AND p.x BETWEEN r.x AND r.x + r.width AND p.y BETWEEN r.y AND r.y + r.height GROUP BY point_id", points=_POINTS, rects=_KINDS)
on_views("line_boxes", lambda rects: y.line_boxes(rects, "page"), " SELECT page, CAST(floor(y + 0.5) AS BIGINT) AS line_y, min(x) AS x0, min(y) AS y0, max(x + width) AS x1, max(y + height) AS y1 FROM rects GROUP BY ALL", rects=RECTS)
on_views("split_index", lambda rows: y.split_index(g.glyphs(rows), F.lit(60.0)),
         ", ch AS (SELECT doc_id, line, unnest(range(1, length(text) + 1)) AS i, text FROM rows_) SELECT doc_id, line, count(*) FILTER ((i - 1) * 6 + 3 < 60) AS n FROM ch WHERE substr(text, i, 1) <> ' ' GROUP BY ALL".replace("rows_", "rows"), rows=_ROWS)
_OVER = """, pairs AS (SELECT region_id, leaf_id, (least(r.x + r.width, l.x + l.width) - greatest(r.x, l.x)) * (least(r.y + r.height, l.y + l.height) - greatest(r.y, l.y)) AS area, l.width * l.height AS whole, r.width * r.height AS own FROM regions r JOIN rects l ON r.page = l.page
 AND least(r.x + r.width, l.x + l.width) > greatest(r.x, l.x) AND least(r.y + r.height, l.y + l.height) > greatest(r.y, l.y))"""
# pages of two sizes: on the small ones the larger boxes are the scan; one page has no known size
_SIZES = "SELECT DISTINCT CAST(p_size % 7 AS INT) AS page, CASE WHEN p_size % 7 IN (1, 4) THEN 8.0 ELSE 600.0 END AS width, CASE WHEN p_size % 7 IN (1, 4) THEN 6.0 ELSE 800.0 END AS height FROM {part} WHERE p_size % 7 <> 2"
on_views("figure_sources", lambda regions, rects, sizes: y.figure_sources(regions, g.region_overlaps(regions, rects), sizes),
         f"{_OVER}, known AS (SELECT pairs.*, z.width * z.height AS page_area FROM pairs JOIN regions USING (region_id) LEFT JOIN sizes z ON z.page = regions.page) SELECT region_id, b.leaf_id FROM regions LEFT JOIN (SELECT region_id, min_by(leaf_id, {{'a': -area / least(own, whole), 'i': leaf_id}}) AS leaf_id FROM known WHERE area / least(own, whole) >= 0.6 AND (page_area IS NULL OR whole / page_area < 0.9) GROUP BY ALL) b USING (region_id) WHERE width * height > 0", regions=REGIONS, rects=RECTS, sizes=_SIZES)


def _glyph_runs(regions, rects):
    """Three glyphs in each box; one counts for a region that holds its middle."""
    part = rects.select("leaf_id", "page", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("seq"), (F.col("x") + (F.col("seq") + 0.5) * F.col("width") / 3).alias("mx"), (F.col("y") + F.col("height") / 2).alias("my"))
    r = g._cells(regions, ["region_id", "page"], "r")
    hits = part.withColumns({"cx": F.floor(F.col("mx") / g.CELL), "cy": F.floor(F.col("my") / g.CELL)}).join(r, ["page", "cx", "cy"]).filter("mx BETWEEN r.x AND r.x + r.width AND my BETWEEN r.y AND r.y + r.height")
    return y.covered_runs(hits.select("region_id", "leaf_id", "seq"))


_RUNS = ", glyph AS (SELECT leaf_id, page, CAST(s AS INT) AS seq, x + (s + 0.5) * width / 3 AS mx, y + height / 2 AS my FROM rects, range(0, 3) q(s)), runs AS (SELECT region_id, leaf_id, min(seq) AS first, max(seq) AS last, max(seq) - min(seq) + 1 = count(*) AS whole_run FROM regions r JOIN glyph g ON g.page = r.page AND mx BETWEEN r.x AND r.x + r.width AND my BETWEEN r.y AND r.y + r.height GROUP BY ALL)"
on_views("covered_runs", _glyph_runs, f"{_RUNS} SELECT * FROM runs", regions=REGIONS, rects=RECTS)
on_views("leaf_hits", lambda regions, rects: y.leaf_hits(g.region_overlaps(regions, rects).select("region_id", "leaf_id", (F.col("area") / F.col("whole")).alias("coverage")), _glyph_runs(regions, rects)),
         f"{_OVER}{_RUNS} SELECT region_id, leaf_id, CASE WHEN area / whole >= 0.995 THEN 'whole' WHEN whole_run THEN 'run' WHEN area / whole >= 0.5 THEN 'part' ELSE 'skipped' END AS hit FROM pairs LEFT JOIN runs USING (region_id, leaf_id)", regions=REGIONS, rects=RECTS)

# boxes of an order's lines: instructions, clips, glyphs and leaves
_PAINT = f"WITH l AS ({LINES}) SELECT ok AS doc_id, ln * 10 AS op_idx, qty * 1e0 AS x0, ln * 8e0 AS y0, qty + 12e0 AS x1, ln * 8e0 + 10 AS y1 FROM l"
_CLIPS = f"WITH l AS ({LINES}) SELECT ok AS doc_id, ln * 10 - 15 AS open_idx, ln * 10 + sk % 20 AS close_idx, qty - 5e0 AS x0, ln * 4e0 AS y0, qty + 20e0 AS x1, ln * 9e0 + 2 AS y1 FROM l WHERE sk % 3 = 0"
on_views("clipped_paint", y.clipped, """, cut AS (SELECT p.doc_id, p.op_idx, greatest(p.x0, max(c.x0)) AS x0, greatest(p.y0, max(c.y0)) AS y0, least(p.x1, min(c.x1)) AS x1, least(p.y1, min(c.y1)) AS y1 FROM paints p LEFT JOIN clips c ON c.doc_id = p.doc_id AND p.op_idx > c.open_idx AND p.op_idx < c.close_idx GROUP BY p.doc_id, p.op_idx, p.x0, p.y0, p.x1, p.y1)
 SELECT * FROM cut WHERE x0 < x1 AND y0 < y1""", paints=_PAINT, clips=_CLIPS)
_BOX = f"WITH l AS ({LINES}) SELECT ok AS doc_id, ln % 3 AS mcid, qty * 1e0 AS x0, ln * 8e0 AS y0, qty + 12e0 AS x1, ln * 8e0 + 10 AS y1 FROM l"
_COARSE = f"WITH l AS ({LINES}) SELECT ok AS doc_id, ln % 3 AS mcid, 0e0 AS x0, ln * 8e0 AS y0, 60e0 AS x1, ln * 8e0 + 10 AS y1 FROM l WHERE ln <= 3"
_REFUSED = f"WITH l AS ({LINES}) SELECT ok AS doc_id, ln % 3 AS mcid, rf AS reason FROM l WHERE sk % 4 = 0"
on_views("measured_boxes", lambda glyphs, refusals, coarse: y.measured_boxes(glyphs, refusals, coarse, "doc_id", "mcid"),
         " SELECT g.*, false AS coarse FROM glyphs g WHERE NOT EXISTS (SELECT 1 FROM refusals r WHERE r.doc_id = g.doc_id AND r.mcid = g.mcid) UNION ALL SELECT c.*, true FROM coarse c WHERE EXISTS (SELECT 1 FROM refusals r WHERE r.doc_id = c.doc_id AND r.mcid = c.mcid)", glyphs=_BOX, refusals=_REFUSED, coarse=_COARSE)
_CHANGES = f"WITH l AS ({LINES}) SELECT ok AS key, ln * 3 AS start, ln * 3 + CASE WHEN sk % 3 = 0 THEN 0 ELSE sk % 7 END AS stop FROM l"
_TEXT_RUNS = f"WITH l AS ({LINES}) SELECT ok AS key, ln AS run_no, (ln - 1) * 6 AS run_start, ln * 6 - sk % 3 AS run_end, qty * 1e0 AS x, ln * 20e0 AS y, 30e0 AS width, 10e0 + sk % 8 AS height FROM l"
_LEAVES = f"WITH l AS ({LINES}) SELECT doc_id, base + 8 + ln AS node_id, CAST(pk % 7 AS INT) AS page, qty * 1e0 AS x, ln * 30e0 AS y, 10e0 + sk % 9 AS width, 12e0 AS height FROM l WHERE qty > 10"
_BOXES = ", boxes AS (SELECT a.doc_id, a.anc AS node_id, r.page, min(x) AS x0, min(y) AS y0, max(x + width) AS x1, max(y + height) AS y1 FROM anc a JOIN rects r ON r.doc_id = a.doc_id AND r.node_id = a.node_id JOIN tree t ON t.doc_id = a.doc_id AND t.node_id = a.anc WHERE a.type = 'content' AND t.type = 'element' GROUP BY ALL)"
on_tree("node_boxes", lambda x, w: y.node_boxes(x, w(_LEAVES)), f"{_BOXES} SELECT * FROM boxes", ("rects", _LEAVES))
on_tree("node_crops", lambda x, w: y.node_crops(x, w(_LEAVES), 60.0, 200.0),
        f"{_BOXES}, n AS (SELECT doc_id, node_id, page, greatest(0, x0 - 6) AS x0, greatest(0, y0 - 6) AS y0, least(60, x1 + 6) AS x1, least(200, y1 + 6) AS y1, row_number() OVER (PARTITION BY doc_id, node_id ORDER BY page) AS k FROM boxes) SELECT * EXCLUDE (k), round(least(3.0, 1568 / greatest(x1 - x0, y1 - y0)), 6) AS scale FROM n WHERE k <= 3", ("rects", _LEAVES))
on_tree("heading_tops", lambda x, w: y.heading_tops(x, w(_LEAVES), 792.0), f"{_BOXES} SELECT b.doc_id, b.node_id, 792.0 - min_by(y0, b.page) AS top FROM boxes b JOIN tree t USING (doc_id, node_id) WHERE role IN {HEADS} GROUP BY ALL", ("rects", _LEAVES))
on_views("change_marks", lambda changes, runs: y.change_marks(changes.withColumnRenamed("stop", "end"), runs),
         """, both_ AS (SELECT c.start, c.stop, r.* FROM changes c JOIN runs r USING (key)), f AS (SELECT key, start, min_by({'a': run_start, 'x': x, 'y': y, 'h': height, 's': width / (run_end - run_start)}, run_start) AS r FROM both_ WHERE start = stop AND run_end > start GROUP BY ALL)
 SELECT key, start, 'removed' AS kind, x + (greatest(start, run_start) - run_start) * width / (run_end - run_start) AS x, y, (least(stop, run_end) - greatest(start, run_start)) * width / (run_end - run_start) AS width, height FROM both_ WHERE stop > start AND greatest(start, run_start) < least(stop, run_end)
 UNION ALL SELECT key, start, 'inserted', r.x + greatest(0, start - r.a) * r.s, r.y - 0.15 * r.h, greatest(4.0, 0.3 * r.h), 1.3 * r.h FROM f""", changes=_CHANGES, runs=_TEXT_RUNS)
_SIDES = "SELECT CAST(n_nationkey % 7 AS INT) AS page, max(6e0 + n_nationkey % 3) AS width, max(5e0 + n_nationkey % 2) AS height FROM {nation} GROUP BY n_nationkey % 7"
on_views("background_images", lambda images, pages: y.backgrounds(images, pages), " SELECT DISTINCT leaf_id FROM images i JOIN pages_ p ON p.page = i.page WHERE i.width >= 0.9 * p.width AND i.height >= 0.9 * p.height".replace("pages_", "pages"), images=RECTS, pages=_SIDES)

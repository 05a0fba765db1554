"""Boxes of leaves and glyphs on pages: hit tests, line boxes, cuts, clips, marks of text changes, pictures of a figure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.scratch import parts
from .geometry import CELL, _cells, crops, union_boxes

#: Share of the smaller area from which a picture is the one meant; share of a page's sides from which it is a background.
SAME, BACKGROUND = 0.6, 0.9


def hit_test(points: DataFrame, rects: DataFrame) -> DataFrame:
    """point_id, leaf_id: the first box under each point (edges included): texts in their order, then graphics.

    points: point_id, page, x, y; rects: leaf_id, page, kind ('text' or another), x, y, width, height. Met through grid cells."""
    p = points.select("point_id", "page", F.col("x").alias("px"), F.col("y").alias("py"), F.floor(F.col("x") / CELL).alias("cx"), F.floor(F.col("y") / CELL).alias("cy"))
    r = _cells(rects, ["leaf_id", "page", "kind"], "r")
    hit = p.join(r, ["page", "cx", "cy"]).filter("px BETWEEN r.x AND r.x + r.width AND py BETWEEN r.y AND r.y + r.height")
    return hit.groupBy("point_id").agg(F.min_by("leaf_id", F.struct(F.col("kind") != "text", F.col("leaf_id"))).alias("leaf_id"))


def line_boxes(rects: DataFrame, *keys: str) -> DataFrame:
    """keys, line_y, x0, y0, x1, y1: boxes of one rounded y united."""
    return union_boxes(rects.withColumn("line_y", F.floor(F.col("y") + 0.5)), *keys, "line_y")


def split_index(glyphs: DataFrame, x: Column) -> DataFrame:
    """doc_id, line, n: characters of a line's glyphs before the first whose midpoint reaches x."""
    w = Window.partitionBy("doc_id", "line").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    over = F.max(((F.col("x0") + F.col("x1")) / 2 >= x).cast("int")).over(w)
    return glyphs.withColumn("over", over).groupBy("doc_id", "line").agg(F.sum(F.when(F.col("over") == 0, F.length("ch")).otherwise(0)).alias("n"))


def covered_runs(hits: DataFrame) -> DataFrame:
    """region_id, leaf_id, first, last, whole_run: glyphs (seq) of a leaf inside a region; whole_run where they follow one another."""
    return hits.groupBy("region_id", "leaf_id").agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.count("*").alias("n")).select("region_id", "leaf_id", "first", "last", (F.col("last") - F.col("first") + 1 == F.col("n")).alias("whole_run"))


def leaf_hits(coverage: DataFrame, runs: DataFrame, whole: float = 0.995, half: float = 0.5) -> DataFrame:
    """region_id, leaf_id, hit of leaves that a region covers: whole; a run where the leaf's glyphs are known and covered in one run, at any
    coverage; else part from one half, or skipped. coverage: region_id, leaf_id, coverage; runs: see ``covered_runs``."""
    c = coverage.filter("coverage > 0").join(runs.select("region_id", "leaf_id", "whole_run"), ["region_id", "leaf_id"], "left")
    hit = F.when(F.col("coverage") >= whole, "whole").when(F.col("whole_run"), "run").when(F.col("coverage") >= half, "part").otherwise("skipped")
    return c.select("region_id", "leaf_id", hit.alias("hit"))


def clipped(paints: DataFrame, clips: DataFrame) -> DataFrame:
    """doc_id, op_idx, x0, y0, x1, y1: each painted box cut by every clip whose stretch of instructions encloses it; what is cut away goes.

    paints: doc_id, op_idx, x0, y0, x1, y1; clips: doc_id, open_idx, close_idx and the same corners. A document's clips travel as one array,
    and what is dealt grows in tasks, not in rows a task."""
    corners = ("x0", "y0", "x1", "y1")
    n = parts(paints)
    held = clips.repartition(n, "doc_id").groupBy("doc_id").agg(F.collect_list(F.struct("open_idx", "close_idx", *corners)).alias("clips"))
    around = F.filter("clips", lambda c: (F.col("op_idx") > c["open_idx"]) & (F.col("op_idx") < c["close_idx"]))
    p = paints.repartition(n, "doc_id").join(held, "doc_id", "left").withColumn("clips", around)
    at = lambda k: F.transform("clips", lambda c: c[k])
    # greatest and least pass over nulls: a box outside every clip stays whole
    cut = p.select("doc_id", "op_idx", *[F.greatest(k, F.array_max(at(k))).alias(k) for k in ("x0", "y0")], *[F.least(k, F.array_min(at(k))).alias(k) for k in ("x1", "y1")])
    return cut.filter("x0 < x1 AND y0 < y1")


def measured_boxes(glyphs: DataFrame, refusals: DataFrame, coarse: DataFrame, *keys: str) -> DataFrame:
    """keys, x0, y0, x1, y1, coarse: a leaf with any refused glyph loses all its glyph boxes and keeps its coarse ones."""
    corners = ("x0", "y0", "x1", "y1")
    refused = refusals.select(*keys).distinct()
    fine = glyphs.join(refused, list(keys), "left_anti").select(*keys, *corners, F.lit(False).alias("coarse"))
    return fine.unionByName(coarse.join(refused, list(keys), "left_semi").select(*keys, *corners, F.lit(True).alias("coarse")))


def node_boxes(tree: DataFrame, rects: DataFrame) -> DataFrame:
    """doc_id, node_id, page, x0, y0, x1, y1: union over all leaves below each element (rects: doc_id, node_id, page, x, y, width, height)."""
    leaf = rects.withColumnRenamed("node_id", "leaf").join(tree.filter("type = 'content'").select("doc_id", F.col("node_id").alias("leaf"), F.explode("path").alias("step")), ["doc_id", "leaf"])
    return union_boxes(leaf.filter("step.type = 'element'").withColumn("node_id", F.col("step.node_id")), "doc_id", "node_id", "page")


def node_crops(tree: DataFrame, rects: DataFrame, width: float, height: float, pages: int = 3) -> DataFrame:
    """The padded picture regions of each element on its first pages."""
    n = F.row_number().over(Window.partitionBy("doc_id", "node_id").orderBy("page"))
    return crops(node_boxes(tree, rects).withColumn("n", n).filter(F.col("n") <= pages).drop("n"), width, height)


def heading_tops(tree: DataFrame, rects: DataFrame, height: float) -> DataFrame:
    """doc_id, node_id, top: height of the page less the smallest y of a heading's boxes on its first page; headings without boxes are left out."""
    heads = tree.filter(F.col("role").rlike("^H[1-6]$")).select("doc_id", "node_id")
    return node_boxes(tree, rects).join(heads, ["doc_id", "node_id"], "left_semi").groupBy("doc_id", "node_id").agg((F.lit(height) - F.min_by("y0", "page")).alias("top"))


def change_marks(changes: DataFrame, runs: DataFrame) -> DataFrame:
    """key, start, kind, x, y, width, height: where old text changed, on the page. A removal takes its share of every run it touches; an
    insertion is a bar at the next character.

    changes: key, start, end (equal: an insertion); runs: key, run_no, run_start, run_end, x, y, width, height."""
    both = changes.join(runs, "key")
    size = F.col("width") / (F.col("run_end") - F.col("run_start"))
    a, b = F.greatest("start", "run_start"), F.least("end", "run_end")
    gone = both.filter((F.col("end") > F.col("start")) & (a < b)).select("key", "start", F.lit("removed").alias("kind"), (F.col("x") + (a - F.col("run_start")) * size).alias("x"), "y", ((b - a) * size).alias("width"), "height")
    follows = both.filter("start = end AND run_end > start")
    at = follows.groupBy("key", "start").agg(F.min_by(F.struct("run_start", "x", "y", "height", size.alias("size")), "run_start").alias("r"))
    x = F.col("r.x") + F.greatest(F.lit(0), F.col("start") - F.col("r.run_start")) * F.col("r.size")
    bar = at.select("key", "start", F.lit("inserted").alias("kind"), x.alias("x"), (F.col("r.y") - 0.15 * F.col("r.height")).alias("y"), F.greatest(F.lit(4.0), 0.3 * F.col("r.height")).alias("width"), (1.3 * F.col("r.height")).alias("height"))
    return gone.unionByName(bar)


def figure_sources(regions: DataFrame, pairs: DataFrame, pages: DataFrame) -> DataFrame:
    """region_id, leaf_id: the picture a dragged region means, the one whose overlap is the largest share of the smaller area, by at least ``SAME``; null: the
    region itself is the figure. Regions without area are refused; a picture of ``BACKGROUND`` of its page's area is its scan, not a
    figure. pairs: see ``region_overlaps``; pages: page and its sides."""
    area = regions.select("region_id", "page", (F.col("width") * F.col("height")).alias("own")).filter("own > 0")
    side = pages.select("page", (F.col("width") * F.col("height")).alias("page_area"))
    share = F.col("area") / F.least("own", "whole")
    fit = pairs.join(area, "region_id").join(side, "page", "left").filter((share >= SAME) & (F.coalesce("page_area", F.lit(0)) <= 0) | (share >= SAME) & (F.col("whole") / F.col("page_area") < BACKGROUND))
    best = fit.groupBy("region_id").agg(F.min_by("leaf_id", F.struct(-share, F.col("leaf_id"))).alias("leaf_id"))
    return area.select("region_id").join(best, "region_id", "left")


def backgrounds(images: DataFrame, pages: DataFrame) -> DataFrame:
    """leaf_id of images that fill nearly the whole page in both directions (images: leaf_id, page, width, height; pages: page and its sides)."""
    side = pages.select("page", F.col("width").alias("pw"), F.col("height").alias("ph"))
    return images.join(side, "page").filter((F.col("width") >= BACKGROUND * F.col("pw")) & (F.col("height") >= BACKGROUND * F.col("ph"))).select("leaf_id").distinct()

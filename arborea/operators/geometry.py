"""Geometry of boxes on pages: overlap, hits of regions, lines, words, dividers. One space: x to the right, y downwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .fold import fold

#: Coverage from which a leaf is whole, and from which one that can't be cut counts; size of a grid cell for joins.
WHOLE, HALF, CELL = 0.995, 0.5, 64.0
#: Characters whose boxes one task sorts.
CHARACTERS = 2_000_000


def overlap(a: str, b: str) -> Column:
    """Area common to two boxes (columns prefix.x, .y, .width, .height)."""
    side = lambda p, q: F.greatest(F.lit(0.0), F.least(F.col(f"{a}.{p}") + F.col(f"{a}.{q}"), F.col(f"{b}.{p}") + F.col(f"{b}.{q}")) - F.greatest(f"{a}.{p}", f"{b}.{p}"))
    return side("x", "width") * side("y", "height")


def _cells(df: DataFrame, keep: list[str], name: str) -> DataFrame:
    """One row for each grid cell that a box touches."""
    span = lambda p, q: F.sequence(F.floor(F.col(p) / CELL), F.floor((F.col(p) + F.col(q)) / CELL))
    box = F.struct("x", "y", "width", "height").alias(name)
    return df.select(*keep, box, F.explode(span("x", "width")).alias("cx"), "x", "y", "width", "height").select(*keep, name, "cx", F.explode(span("y", "height")).alias("cy"))


def contains(box: str, x: Column, y: Column, slack: float = 0.0) -> Column:
    """Whether a point lies in a box (column prefix), edges included, give or take ``slack``."""
    return x.between(F.col(f"{box}.x") - slack, F.col(f"{box}.x") + F.col(f"{box}.width") + slack) & y.between(F.col(f"{box}.y") - slack, F.col(f"{box}.y") + F.col(f"{box}.height") + slack)


def composed(first: Column, then: Column) -> Column:
    """The affine map (array a b c d e f: x' = a x + c y + e, y' = b x + d y + f) that does ``first``, then ``then``."""
    p, q = (lambda m: lambda i: F.element_at(m, i))(first), (lambda m: lambda i: F.element_at(m, i))(then)
    return F.array(p(1) * q(1) + p(2) * q(3), p(1) * q(2) + p(2) * q(4), p(3) * q(1) + p(4) * q(3), p(3) * q(2) + p(4) * q(4), p(5) * q(1) + p(6) * q(3) + q(5), p(5) * q(2) + p(6) * q(4) + q(6))


def mapped(m: Column, x: Column, y: Column) -> Column:
    """A point (struct x, y) under an affine map."""
    at = lambda i: F.element_at(m, i)
    return F.struct((at(1) * x + at(3) * y + at(5)).alias("x"), (at(2) * x + at(4) * y + at(6)).alias("y"))


def mapped_box(m: Column, x: Column, y: Column, width: Column, height: Column) -> Column:
    """The box (struct x0, y0, x1, y1) of a box's four corners under an affine map."""
    corners = [mapped(m, a, b) for a in (x, x + width) for b in (y, y + height)]
    return F.struct(F.least(*[c["x"] for c in corners]).alias("x0"), F.least(*[c["y"] for c in corners]).alias("y0"), F.greatest(*[c["x"] for c in corners]).alias("x1"), F.greatest(*[c["y"] for c in corners]).alias("y1"))


def region_overlaps(regions: DataFrame, rects: DataFrame) -> DataFrame:
    """region_id, leaf_id, area, whole: overlapping pairs on a page, met through the grid cells that both touch (no cross join)."""
    r, l = _cells(regions, ["region_id", "page"], "r"), _cells(rects, ["leaf_id", "page"], "l")
    pairs = r.join(l, ["page", "cx", "cy"]).dropDuplicates(["region_id", "leaf_id"])
    return pairs.select("region_id", "leaf_id", overlap("r", "l").alias("area"), (F.col("l.width") * F.col("l.height")).alias("whole")).filter("area > 0")


def region_hits(pairs: DataFrame) -> DataFrame:
    """region_id, leaf_id, coverage, hit: whole, part (at least half), or skipped."""
    c = pairs.withColumn("coverage", F.col("area") / F.col("whole"))
    return c.select("region_id", "leaf_id", F.round("coverage", 6).alias("coverage"), F.when(F.col("coverage") >= WHOLE, "whole").when(F.col("coverage") >= HALF, "part").otherwise("skipped").alias("hit"))


def best_overlap(pairs: DataFrame) -> DataFrame:
    """leaf_id, region_id of the largest overlap; ties to the first region."""
    return pairs.groupBy("leaf_id").agg(F.min_by("region_id", F.struct(-F.col("area"), F.col("region_id"))).alias("region_id"))


def union_boxes(rects: DataFrame, *keys: str) -> DataFrame:
    return rects.groupBy(*keys).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("width")).alias("x1"), F.max(F.col("y") + F.col("height")).alias("y1"))


def crops(boxes: DataFrame, width: float, height: float, pad: float = 6.0, most: int = 1568) -> DataFrame:
    """Boxes (x0, y0, x1, y1) padded and clamped to the page, with the scale of a picture of at most ``most`` pixels."""
    c = boxes.withColumns({"x0": F.greatest(F.lit(0.0), F.col("x0") - pad), "y0": F.greatest(F.lit(0.0), F.col("y0") - pad), "x1": F.least(F.lit(width), F.col("x1") + pad), "y1": F.least(F.lit(height), F.col("y1") + pad)})
    return c.withColumn("scale", F.round(F.least(F.lit(3.0), most / F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))), 6))


def glyphs(lines: DataFrame) -> DataFrame:
    """doc_id, line, col, ch, x0, y0, x1, y1: a box of 6 by 10 for each visible character of lines (doc_id, line, text), 20 apart.

    The lines are dealt by document, to more tasks where there is more text: what groups or orders the boxes by document or line then moves none."""
    n = max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(lines.agg(F.sum(F.length("text"))).first()[0] or 0) // CHARACTERS))
    g = lines.select("doc_id", "line", "text").repartition(n, "doc_id").select("doc_id", "line", F.posexplode(F.split("text", "")).alias("col", "ch")).filter("ch NOT IN (' ', '', '\\t', '\\r')")
    x, y = F.col("col") * 6.0, F.col("line") * 20.0
    return g.select("doc_id", "line", "col", "ch", x.alias("x0"), y.alias("y0"), (x + 6).alias("x1"), (y + 10).alias("y1"))


class _Lines:
    """Levels in order of their midpoint; a level farther than the tolerance from the line's mean opens the next."""

    def __init__(self):
        self.line, self.open = -1, None  # [sum of midpoints, boxes, top, bottom]

    def add(self, r):
        o = self.open
        if o and abs(r.mid - o[0] / o[1]) <= r.tolerance:
            self.open = [o[0] + r.mid * r.n, o[1] + r.n, min(o[2], r.top), max(o[3], r.bottom)]
            return
        yield from self.end((r.doc_id,))
        self.line, self.open = self.line + 1, [r.mid * r.n, r.n, r.top, r.bottom]

    def end(self, key):
        if self.open:
            yield key[0], self.line, self.open[1], self.open[2], self.open[3]


def line_clusters(boxes: DataFrame) -> DataFrame:
    """doc_id, line_no, n, top, bottom: boxes clustered to lines by vertical midpoint, within the larger of 1.5 and 0.35 of the median
    height. Boxes of one height and midpoint are grouped before Python, so a page is as many rows as it has levels."""
    levels = boxes.groupBy("doc_id", ((F.col("y0") + F.col("y1")) / 2).alias("mid"), (F.col("y1") - F.col("y0")).alias("h")).agg(F.count("*").alias("n"), F.min("y0").alias("top"), F.max("y1").alias("bottom"))
    median = boxes.groupBy("doc_id").agg(F.greatest(F.lit(1.5), F.median(F.col("y1") - F.col("y0")) * 0.35).alias("tolerance"))
    return fold(levels.join(median, "doc_id"), ["doc_id"], ["mid", "h"], _Lines, "doc_id long, line_no long, n long, top double, bottom double")


def median_width(boxes: DataFrame, *keys: str) -> DataFrame:
    """keys, width: the median width of measured glyphs, else half the median height. boxes: width, height, coarse (a whole phrase)."""
    return boxes.groupBy(*keys).agg(F.coalesce(F.median(F.when(~F.col("coarse"), F.col("width"))), F.median("height") / 2).alias("width"))


def row_dividers(lines: DataFrame) -> DataFrame:
    """doc_id, y of dividers between lines: where the sorted gaps jump by 1.6 or more, only gaps above the largest jump count."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    g = lines.withColumn("next", F.lead("top").over(w)).filter("next IS NOT NULL").withColumn("gap", F.greatest(F.lit(0.5), F.col("next") - F.col("bottom")))
    g = g.withColumn("y", F.when(F.col("next") > F.col("bottom"), (F.col("next") + F.col("bottom")) / 2).otherwise((F.col("top") + F.col("bottom")) / 2))
    s = g.groupBy("doc_id", "gap").agg(F.count("*").alias("n"))
    s = s.withColumn("below", F.lag("gap").over(Window.partitionBy("doc_id").orderBy("gap"))).withColumn("ratio", F.col("gap") / F.col("below"))
    best = s.filter("ratio >= 1.6").groupBy("doc_id").agg(F.min_by("gap", F.struct(-F.col("ratio"), F.col("gap"))).alias("least"))
    return g.join(best, "doc_id", "left").filter("least IS NULL OR gap >= least").select("doc_id", "y")


def fit_lines(lines: DataFrame, keys: list[str], value: str, lo: Column, extent: Column, apart: float = 4.0) -> DataFrame:
    """keys, value: of dividers in ascending order those inside a box by ``apart`` and as far from the one kept before. lo, extent: of the box,
    by the keys."""
    held = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.col(value).cast("double"))).alias("xs"))
    far = lambda kept, x: (x >= lo + apart) & (x <= lo + extent - apart) & F.coalesce(x - F.try_element_at(kept, F.lit(-1)) >= apart, F.lit(True))
    kept = F.aggregate("xs", F.array().cast("array<double>"), lambda kept, x: F.when(far(kept, x), F.concat(kept, F.array(x))).otherwise(kept))
    return held.select(*keys, F.explode(kept).alias(value))


def seed_grid(boxes: DataFrame, frames: DataFrame) -> DataFrame:
    """doc_id, axis ('x', 'y'), at: dividers of the columns and rows of a region (frames: doc_id, x, y, width, height); none where it has fewer
    than two lines."""
    lines = line_clusters(boxes)
    several = lines.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    xs = column_dividers(phrases(boxes)).select("doc_id", F.lit("x").alias("axis"), F.col("x").alias("at"))
    ys = row_dividers(lines).select("doc_id", F.lit("y").alias("axis"), F.col("y").alias("at"))
    every = xs.unionByName(ys).join(several, "doc_id", "left_semi").join(frames, "doc_id")
    every = every.withColumn("lo", F.when(F.col("axis") == "x", F.col("x")).otherwise(F.col("y"))).withColumn("extent", F.when(F.col("axis") == "x", F.col("width")).otherwise(F.col("height")))
    return fit_lines(every, ["doc_id", "axis", "lo", "extent"], "at", F.col("lo"), F.col("extent")).select("doc_id", "axis", "at")


def words(boxes: DataFrame) -> DataFrame:
    """doc_id, word_no, n: glyphs of a line joined while the gap is at most 1.5 median widths of the document, the columns follow and the
    leaf (where boxes name one) is the same; numbered in reading order.

    Glyphs that touch are joined first, whatever the median; only these pieces meet it. The median comes from the counts of each size."""
    sizes = boxes.groupBy("doc_id", (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("height")).agg(F.count("*").alias("n"))
    median = sizes.groupBy("doc_id").agg(F.coalesce(F.percentile("width", 0.5, F.col("n")), F.percentile("height", 0.5, F.col("n")) / 2).alias("width"))
    w = Window.partitionBy("doc_id", "line").orderBy("x0")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    leaf = "leaf" in boxes.columns

    def joined(df: DataFrame, reach: Column, end: str, col: str, first_col: str, last_leaf: str, first_leaf: str) -> DataFrame:
        near = (F.col("x0") - F.lag(end).over(w) <= reach) & (F.col(first_col) == F.lag(col).over(w) + 1)
        if leaf:
            near = near & F.col(first_leaf).eqNullSafe(F.lag(last_leaf).over(w))
        return df.withColumn("new", (~F.coalesce(near, F.lit(False))).cast("int")).withColumn("k", F.sum("new").over(upto))

    one = joined(boxes, F.lit(0.0), "x1", "col", "col", "leaf", "leaf").groupBy("doc_id", "line", "k").agg(
        F.count("*").alias("n"), F.min("x0").alias("x0"), F.max_by("x1", "x0").alias("end"), F.min_by("col", "x0").alias("from_col"), F.max_by("col", "x0").alias("to_col"),
        *([F.min_by("leaf", "x0").alias("from_leaf"), F.max_by("leaf", "x0").alias("to_leaf")] if leaf else [])).drop("k")
    two = joined(one.join(median, "doc_id"), 1.5 * F.col("width"), "end", "to_col", "from_col", "to_leaf", "from_leaf").groupBy("doc_id", "line", "k").agg(F.sum("n").alias("n"))
    return two.withColumn("word_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("line", "k"))).select("doc_id", "word_no", "n")


def phrases(boxes: DataFrame, gap: float = 9.0) -> DataFrame:
    """doc_id, line, x0, x1 of stretches without a gap wider than ``gap``."""
    w = Window.partitionBy("doc_id", "line").orderBy("x0")
    b = boxes.withColumn("new", (~F.coalesce(F.col("x0") - F.lag("x1").over(w) <= gap, F.lit(False))).cast("int")).withColumn("k", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return b.groupBy("doc_id", "line", "k").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("k")


def column_dividers(phrase: DataFrame, least: float = 9.0, most: int = 1) -> DataFrame:
    """doc_id, x: centres of clear stretches of at least ``least`` that at most ``most`` phrases cross and that lie between others; of a
    stretch the widest part of at least ``least`` that nothing crosses counts, the first of equals, else the whole stretch. A sweep over phrase
    ends, no pixel rows."""
    ends = phrase.select("doc_id", F.explode(F.array(F.struct(F.col("x0").alias("x"), F.lit(1).alias("d")), F.struct(F.col("x1").alias("x"), F.lit(-1).alias("d")))).alias("e")).groupBy("doc_id", F.col("e.x").alias("x")).agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy("doc_id").orderBy("x")
    seg = ends.withColumn("n", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("x1", F.lead("x").over(w)).filter("x1 IS NOT NULL").withColumn("clear", (F.col("n") <= most).cast("int"))
    seg = seg.withColumn("isle", F.sum((F.coalesce(F.lag("clear").over(w), F.lit(-1)) != F.col("clear")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    seg = seg.withColumn("last", F.max("isle").over(Window.partitionBy("doc_id")))
    isle = seg.filter("clear = 1 AND isle > 1 AND isle < last")
    zero = F.when((F.col("n") == 0) & (F.col("x1") - F.col("x") >= least), F.struct(-(F.col("x1") - F.col("x")), F.col("x")))
    s = isle.groupBy("doc_id", "isle").agg(F.min("x").alias("a"), F.max("x1").alias("b"), F.min_by(F.struct("x", "x1"), zero).alias("z")).filter(F.col("b") - F.col("a") >= least)
    return s.select("doc_id", F.coalesce((F.col("z.x") + F.col("z.x1")) / 2, (F.col("a") + F.col("b")) / 2).alias("x"))

"""Tables of a corpus: grid positions, checks, plain grids, selections, changes of rows and columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.scratch import written
from . import tree as t
from .fold import fold


def cells(tree: DataFrame) -> DataFrame:
    """doc_id, tab, row_no, cell_no, node_id, role, col_span: cells directly in rows, rows directly in tables or their parts; from 1."""
    row = t.nearest(lambda s: F.lit(True))
    c = tree.filter(F.col("role").isin("TH", "TD")).withColumn("row", row).filter("row.role = 'TR'").withColumn("tab", t.nearest(lambda s: s["role"] == "Table")["node_id"]).filter("tab IS NOT NULL")
    r = F.dense_rank().over(Window.partitionBy("doc_id", "tab").orderBy("row.ord", "row.node_id"))
    k = F.row_number().over(Window.partitionBy("doc_id", "tab", "row.node_id").orderBy("ord", "node_id"))
    return c.select("doc_id", "tab", r.alias("row_no"), k.alias("cell_no"), "node_id", "role", "col_span")


#: How far each walk goes from a table to its rows, and from a row to its cells: roles that stop it, or the only ones it passes (None: any).
WALKS = {"audit": (("TR", "Table"), None, ("TH", "TD"), None), "preview": (("TR", "Table"), None, ("TH", "TD", "TR", "Table"), None), "rewrite": ((), ("THead", "TBody", "TFoot"), (), ())}


def walked_cells(tree: DataFrame, mode: str) -> DataFrame:
    """doc_id, tab, row, row_no, node_id, cell_no: rows and cells of tables (from 1, in document order) by one of three walks.

    'audit' and 'preview' find rows through any wrapper but a nested table or row, 'rewrite' through the parts of a table only. From a row, 'audit' passes
    anything but a cell, so a nested row's cells count for the outer row too; 'preview' stops at nested rows and tables as well; 'rewrite' takes
    children alone. Each walk is read backwards along the path of a row or a cell."""
    stop_row, only_row, stop_cell, only_cell = WALKS[mode]
    roles = F.transform(t.ancestors(), lambda s: F.coalesce(s["role"], s["type"]))

    def since(stops, only):
        """Ancestors up to where the walk would have stopped: those after the last stop, the stop included."""
        up = t.ancestors()
        halts = F.transform(roles, lambda r, i: F.when((r.isin(*stops) if stops else F.lit(False)) if only is None else (~r.isin(*only) if only else F.lit(True)), i + 1))
        last = F.coalesce(F.array_max(halts), F.lit(1))
        return F.slice(up, last, F.size("path") - last)

    row = tree.filter("role = 'TR'").withColumn("tab", F.try_element_at(since(stop_row, only_row), F.lit(1))).filter("tab.role = 'Table'")
    row = row.select("doc_id", F.col("tab.node_id").alias("tab"), F.col("node_id").alias("row"), F.row_number().over(Window.partitionBy("doc_id", "tab.node_id").orderBy("pre")).alias("row_no"))
    cell = tree.filter(F.col("role").isin("TH", "TD")).select("doc_id", "node_id", "pre", F.explode(since(stop_cell, only_cell)).alias("up")).filter("up.role = 'TR'")
    cell = cell.select("doc_id", F.col("up.node_id").alias("row"), "node_id", F.row_number().over(Window.partitionBy("doc_id", "up.node_id").orderBy("pre")).alias("cell_no"))
    return row.join(cell, ["doc_id", "row"]).select("doc_id", "tab", "row", "row_no", "node_id", "cell_no")


def place(rows: list[list[tuple[int, int]]]) -> tuple[list[list[int]], int, str | None]:
    """First free column of each cell of (column span, row span), the number of columns, and what is wrong with the grid."""
    taken: dict[int, set[int]] = {}
    out, widths, error = [], [], None
    for r, row in enumerate(rows):
        at, places = 0, []
        used = taken.setdefault(r, set())
        for cols, deep in row:
            if cols < 1 or deep < 1:
                error = error or "invalid span"
                cols, deep = max(cols, 1), max(deep, 1)
            while at in used:
                at += 1
            if any(c in used for c in range(at, at + cols)):
                error = error or "overlap"
            if r + deep > len(rows):
                error = error or "past the last row"
            places.append(at)
            for q in range(r, r + deep):
                taken.setdefault(q, set()).update(range(at, at + cols))
            at += cols
        out.append(places)
        widths.append(len(used))
        if used and max(used) + 1 > len(used):
            error = error or "gap"
        elif len(used) != widths[0]:
            error = error or "ragged width"
    if not any(widths):
        error = error or "no cells"
    return out, max([0, *(max(v) + 1 for v in taken.values() if v)]), error


def grid(cell: DataFrame) -> DataFrame:
    """doc_id, tab, node_id, row_no, col_no, n_cols, error of each cell (with col_span, and row_span where there is one)."""
    c = cell if "row_span" in cell.columns else cell.withColumn("row_span", F.lit(1))

    class Table:
        """The cells of one table, row by row."""

        def __init__(self):
            self.rows, self.last = [], None

        def add(self, r):
            if r.row_no != self.last:
                self.rows.append([])
            self.rows[-1].append(r)
            self.last = r.row_no
            return ()

        def end(self, key):
            at, n, error = place([[(x.col_span, x.row_span) for x in line] for line in self.rows])
            return [(x.doc_id, x.tab, x.node_id, x.row_no, c + 1, n, error) for line, places in zip(self.rows, at) for x, c in zip(line, places)]

    c = c.select("doc_id", "tab", "row_no", "cell_no", "node_id", "col_span", "row_span")
    return fold(c, ["doc_id", "tab"], ["row_no", "cell_no"], Table, "doc_id long, tab long, node_id long, row_no int, col_no int, n_cols int, error string")


def plain_grid(sizes: DataFrame) -> DataFrame:
    """tab, row_no, col_no, role of every cell of tables (tab, n_rows, n_cols): the first row are headers."""
    each = sizes.select("tab", "n_cols", F.explode(F.sequence(F.lit(1), "n_rows")).alias("row_no")).select("tab", "row_no", F.explode(F.sequence(F.lit(1), "n_cols")).alias("col_no"))
    return each.withColumn("role", F.when(F.col("row_no") == 1, "TH").otherwise("TD"))


def block(placed: DataFrame, first: tuple[int, int], last: tuple[int, int]) -> DataFrame:
    """Cells of the rectangle between two anchors (row, column)."""
    return placed.filter(F.col("row_no").between(first[0], last[0]) & F.col("col_no").between(first[1], last[1])).select("doc_id", "tab", "node_id")


def toggled_headers(cell: DataFrame) -> DataFrame:
    """doc_id, node_id, role: a table whose cells are all headers gets data cells, any other gets headers."""
    every = F.bool_and(F.col("role") == "TH").over(Window.partitionBy("doc_id", "tab"))
    return cell.select("doc_id", "node_id", F.when(every, "TD").otherwise("TH").alias("role"))


def without_column(placed: DataFrame, cell: DataFrame, col_no: int) -> DataFrame:
    """doc_id, tab, node_id of the cells that stay when the cells over a column go."""
    span = cell.select("doc_id", "node_id", "col_span")
    over = (F.col("col_no") <= col_no) & (F.col("col_no") + F.col("col_span") > col_no)
    return placed.join(span, ["doc_id", "node_id"]).filter(~over).select("doc_id", "tab", "node_id")


def added_rows(cell: DataFrame) -> DataFrame:
    """doc_id, tab, row_no, n_cells of the row that a table gets: as many cells as its last one."""
    last = cell.groupBy("doc_id", "tab").agg(F.max("row_no").alias("row_no"))
    return cell.join(last, ["doc_id", "tab", "row_no"]).groupBy("doc_id", "tab", "row_no").agg(F.count("*").alias("n_cells")).withColumn("row_no", F.col("row_no") + 1)


def added_columns(cell: DataFrame) -> DataFrame:
    """doc_id, tab, row_no, cell_no of the data cell that each row gets at its end; a table without rows gets none."""
    return cell.groupBy("doc_id", "tab", "row_no").agg((F.max("cell_no") + 1).alias("cell_no")).select("doc_id", "tab", "row_no", "cell_no", F.lit("TD").alias("role"))


def without_row(placed: DataFrame, row_no: int) -> DataFrame:
    """doc_id, tab, node_id of the cells that stay when a row goes."""
    return placed.filter(F.col("row_no") != row_no).select("doc_id", "tab", "node_id")


def merged(placed: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, tab, node_id, role, row_span, col_span, refused of each block (doc_id, tab, r0, r1, c0, c1) as one cell: that at its top left,
    with its role. Only where the cells inside fill the block exactly. placed: with row_no, col_no, row_span, col_span, role."""
    p, keys = placed.alias("p"), ["doc_id", "tab"]
    hit = p.join(blocks, keys).filter("row_no <= r1 AND row_no + row_span > r0 AND col_no <= c1 AND col_no + col_span > c0")
    inside = (F.col("row_no") >= F.col("r0")) & (F.col("row_no") + F.col("row_span") - 1 <= F.col("r1")) & (F.col("col_no") >= F.col("c0")) & (F.col("col_no") + F.col("col_span") - 1 <= F.col("c1"))
    one = hit.groupBy(*keys, "r0", "r1", "c0", "c1").agg(F.min_by(F.struct("node_id", "role"), F.struct("row_no", "col_no")).alias("head"), F.sum(F.when(inside, F.col("row_span") * F.col("col_span")).otherwise(0)).alias("area"), F.bool_and(inside).alias("whole"))
    high, wide = F.col("r1") - F.col("r0") + 1, F.col("c1") - F.col("c0") + 1
    return one.select(*keys, "head.node_id", "head.role", high.cast("int").alias("row_span"), wide.cast("int").alias("col_span"), (~(F.col("whole") & (F.col("area") == high * wide))).alias("refused"))


def unmerged(placed: DataFrame) -> DataFrame:
    """doc_id, tab, node_id, row_no, col_no, role of the single cells that a merged cell splits into; node_id: of the merged one."""
    each = placed.filter("row_span * col_span > 1").withColumn("r", F.explode(F.sequence(F.lit(0), F.col("row_span") - 1))).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("col_span") - 1)))
    return each.select("doc_id", "tab", "node_id", (F.col("row_no") + F.col("r")).alias("row_no"), (F.col("col_no") + F.col("c")).alias("col_no"), "role")


def grown_blocks(placed: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, tab, r0, r1, c0, c1: blocks (the same columns) grown until each holds every merged cell it touches. placed: doc_id, tab, row_no,
    col_no, row_span, col_span. Each round is one join on the table; it ends when no block grows, after as many rounds as a table has
    rows and columns at most."""
    keys = ["doc_id", "tab"]
    edge = placed.select(*keys, F.col("row_no").alias("a"), (F.col("row_no") + F.col("row_span") - 1).alias("b"), F.col("col_no").alias("c"), (F.col("col_no") + F.col("col_span") - 1).alias("d"))
    edge, now = written(edge, "edges"), written(blocks.select(*keys, "r0", "r1", "c0", "c1"), "blocks")
    while True:
        hit = now.join(edge, keys).filter("a <= r1 AND b >= r0 AND c <= c1 AND d >= c0").groupBy(*keys, "r0", "r1", "c0", "c1").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.min("c").alias("c"), F.max("d").alias("d"))
        wide = hit.select(*keys, F.least("r0", "a").alias("r0"), F.greatest("r1", "b").alias("r1"), F.least("c0", "c").alias("c0"), F.greatest("c1", "d").alias("c1"), (F.greatest(F.col("r0") - F.col("a"), F.col("b") - F.col("r1"), F.col("c0") - F.col("c"), F.col("d") - F.col("c1")) > 0).alias("grew"))
        wide = written(wide, "blocks")
        if wide.filter("grew").isEmpty():
            return wide.drop("grew")
        now = wide.drop("grew")


def cell_runs(glyphs: DataFrame) -> DataFrame:
    """leaf, cell, start, end of the runs of a leaf's text that lie in one cell; end is null where the leaf ends.

    glyphs: leaf, seq, text, cell (null: outside). A blank follows the glyph before it; one outside breaks the run."""
    g = glyphs.filter("text <> ''")
    w = Window.partitionBy("leaf").orderBy("seq")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    ink = F.trim("text") != ""
    g = g.withColumn("grp", F.sum(ink.cast("int")).over(upto)).withColumn("stop", F.sum(F.length("text")).over(upto))
    by = Window.partitionBy("leaf", "grp").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    # a group is one visible glyph with the blanks after it: the first cell known there holds for the rest
    g = g.withColumn("cell", F.when(ink, F.col("cell")).otherwise(F.first("cell", ignorenulls=True).over(by)))
    g = g.withColumn("run", F.sum((~F.lag("cell").over(w).eqNullSafe(F.col("cell"))).cast("int")).over(upto)).withColumn("total", F.max("stop").over(Window.partitionBy("leaf")))
    r = g.filter("cell IS NOT NULL").groupBy("leaf", "run", "cell").agg(F.min(F.col("stop") - F.length("text")).alias("start"), F.max("stop").alias("end"), F.first("total").alias("total"))
    return r.select("leaf", "cell", "start", F.when(F.col("end") < F.col("total"), F.col("end")).alias("end"))


def _slots(points: DataFrame, edges: DataFrame, axis: str) -> DataFrame:
    """The points (tab, axis) with the first and last of the intervals between a table's edges (tab, axis) that hold each, from 0: one pass in order of place;
    two intervals for a point on an inner edge, none outside."""
    both = points.withColumn("edge", F.lit(0)).unionByName(edges.select("tab", axis, F.lit(1).alias("edge")), allowMissingColumns=True)
    upto = Window.partitionBy("tab").orderBy(axis).rangeBetween(Window.unboundedPreceding, 0)
    here = Window.partitionBy("tab", axis)
    b = both.withColumn("at", F.sum("edge").over(upto)).withColumn("on", F.sum("edge").over(here)).withColumn("n", F.sum("edge").over(Window.partitionBy("tab")))
    low, high = F.greatest(F.col("at") - F.col("on") - 1, F.lit(0)), F.least(F.col("at") - 1, F.col("n") - 2)
    found = b.filter("edge = 0").withColumn(f"{axis}_from", F.when((F.col("at") > 0) & (F.col("at") - F.col("on") < F.col("n")), low)).withColumn(f"{axis}_to", F.when(F.col(f"{axis}_from").isNotNull(), high))
    return found.drop("edge", "at", "on", "n")


def glyph_cells(glyphs: DataFrame, xs: DataFrame, ys: DataFrame, cell: DataFrame) -> DataFrame:
    """The glyphs (tab, leaf, seq, text, x, y, width, height) with ``cell``: the first cell, in the order of their numbers, that holds the glyph's middle, edges
    included; null outside. xs: tab, x of the vertical edges; ys: tab, y; cell: tab, cell, row_no, col_no (from 0), row_span, col_span."""
    p = glyphs.select("tab", "leaf", "seq", "text", (F.col("x") + F.col("width") / 2).alias("x"), (F.col("y") + F.col("height") / 2).alias("y"))
    p = _slots(_slots(p, xs, "x"), ys, "y")
    area = cell.select("tab", "cell", F.explode(F.sequence(F.col("row_no"), F.col("row_no") + F.col("row_span") - 1)).alias("r"), "col_no", "col_span")
    area = area.select("tab", "cell", F.col("r").cast("long").alias("r"), F.explode(F.sequence(F.col("col_no"), F.col("col_no") + F.col("col_span") - 1)).alias("c")).withColumn("c", F.col("c").cast("long"))
    area = area.groupBy("tab", "r", "c").agg(F.min("cell").alias("cell"))
    inside = p.filter("x_from IS NOT NULL AND y_from IS NOT NULL").withColumn("r", F.explode(F.sequence("y_from", "y_to"))).withColumn("c", F.explode(F.sequence("x_from", "x_to")))
    first = inside.join(area, ["tab", "r", "c"]).groupBy("tab", "leaf", "seq").agg(F.min("cell").alias("cell"))
    return glyphs.join(first, ["tab", "leaf", "seq"], "left")


def cell_contents(glyphs: DataFrame, rects: DataFrame, xs: DataFrame, ys: DataFrame, cell: DataFrame) -> DataFrame:
    """tab, leaf, cell, start, end, overhangs: what of each leaf goes into which cell of its table.

    Measured leaves (glyphs) are divided as by ``glyph_cells`` and ``cell_runs``. A leaf without glyphs (rects: tab, leaf, x, y, width, height) goes whole to the
    cell most of it lies in, the first of equals; it overhangs if a box of it reaches out of that cell by more than 0.5."""
    placed = glyph_cells(glyphs, xs, ys, cell).select(F.struct("tab", "leaf").alias("leaf"), "seq", "text", "cell")
    runs = cell_runs(placed).select("leaf.tab", "leaf.leaf", "cell", "start", "end", F.lit(False).alias("overhangs"))
    edge = lambda df, c: df.groupBy("tab").agg(F.array_sort(F.collect_list(c)).alias(f"{c}s"))
    side = lambda v, n, span: (F.element_at(v, (F.col(n) + 1).cast("int")), F.element_at(v, (F.col(n) + F.col(span) + 1).cast("int")))
    box = cell.join(edge(xs, "x"), "tab").join(edge(ys, "y"), "tab")
    (x0, x1), (y0, y1) = side("xs", "col_no", "col_span"), side("ys", "row_no", "row_span")
    box = box.select("tab", "cell", x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1"))
    coarse = rects.join(glyphs.filter("text <> ''").select("tab", "leaf").distinct(), ["tab", "leaf"], "left_anti").join(box, "tab")
    common = lambda a, w, lo, hi: F.greatest(F.lit(0.0), F.least(F.col(a) + F.col(w), F.col(hi)) - F.greatest(F.col(a), F.col(lo)))
    out = lambda a, w, lo, hi: (F.col(a) >= F.col(lo) - 0.5) & (F.col(a) + F.col(w) <= F.col(hi) + 0.5)
    each = coarse.groupBy("tab", "leaf", "cell").agg(F.sum(common("x", "width", "x0", "x1") * common("y", "height", "y0", "y1")).alias("area"), F.bool_and(out("x", "width", "x0", "x1") & out("y", "height", "y0", "y1")).alias("within"))
    best = each.filter("area > 0").groupBy("tab", "leaf").agg(F.min_by(F.struct("cell", "within"), F.struct(-F.col("area"), F.col("cell"))).alias("b"))
    return runs.unionByName(best.select("tab", "leaf", "b.cell", F.lit(0).cast(runs.schema["start"].dataType).alias("start"), F.lit(None).cast(runs.schema["end"].dataType).alias("end"), (~F.col("b.within")).alias("overhangs")))


def filled(cell: DataFrame, row_id: Column, cell_id: Column) -> DataFrame:
    """doc_id, node_id, parent_id, ord, role, col_span of the rows and cells of new tables (doc_id, tab, row_no, col_no, role, col_span)."""
    rows = cell.select("doc_id", "tab", "row_no").distinct().select("doc_id", row_id.alias("node_id"), F.col("tab").alias("parent_id"), (F.col("row_no") - 1).cast("long").alias("ord"), F.lit("TR").alias("role"), F.lit(1).alias("col_span"))
    n = F.row_number().over(Window.partitionBy("doc_id", "tab", "row_no").orderBy("col_no")) - 1
    return rows.unionByName(cell.select("doc_id", cell_id.alias("node_id"), row_id.alias("parent_id"), n.cast("long").alias("ord"), "role", "col_span"))


def previews(placed: DataFrame, tree: DataFrame, text: DataFrame) -> DataFrame:
    """doc_id, tab, row_no, col_no, col_span, shown of every cell: its text behind the sign of its scope."""
    fact = tree.select("doc_id", "node_id", "scope", "col_span")
    sign = F.when(F.col("scope") == "Row", "→ ").when(F.col("scope") == "Column", "↓ ").when(F.col("scope") == "Both", "↘ ").otherwise("")
    return placed.join(fact, ["doc_id", "node_id"]).join(text, ["doc_id", "node_id"], "left").select("doc_id", "tab", "row_no", "col_no", "col_span", F.concat(sign, F.coalesce("text", F.lit(""))).alias("shown"))

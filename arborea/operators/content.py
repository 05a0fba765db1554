"""Regions of a page's instruction stream (doc_id, op_idx, op, tag, mcid): spans, orphans, unwrapped paint, artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import regions

# fixed values: operators that open, close and paint
OPENS, CLOSE = ("BDC", "BMC"), "EMC"
PAINTS = ("Tj", "'", '"', "TJ", "S", "s", "f", "F", "f*", "B", "B*", "b", "b*", "sh", "Do")
_TEXT = ("Tj", "'", '"', "TJ")


def with_depth(ops: DataFrame, *page: str) -> DataFrame:
    """Adds depth after each instruction and before it; a close without an open span doesn't count (floor at 0).

    page: columns that tell the streams of a document apart, here and below."""
    w = Window.partitionBy("doc_id", *page).orderBy("op_idx").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("op").isin(*OPENS), 1).when(F.col("op") == CLOSE, -1).otherwise(0)
    s = ops.withColumn("s", F.sum(step).over(w))
    s = s.withColumn("depth", (F.col("s") - F.least(F.lit(0), F.min("s").over(w))).cast("int")).drop("s")
    return s.withColumn("depth_before", F.coalesce(F.lag("depth").over(Window.partitionBy("doc_id", *page).orderBy("op_idx")), F.lit(0)))


def spans(deep: DataFrame, *page: str) -> DataFrame:
    """doc_id, open_idx, close_idx (null where unclosed), level, tag, mcid: at one level opens and closes alternate."""
    opens = F.col("op").isin(*OPENS)
    edge = deep.filter(opens | ((F.col("op") == CLOSE) & (F.col("depth_before") > 0))).withColumn("level", F.when(opens, F.col("depth")).otherwise(F.col("depth_before")))
    edge = edge.withColumn("close_idx", F.lead("op_idx").over(Window.partitionBy("doc_id", *page, "level").orderBy("op_idx")))
    return edge.filter(opens).select("doc_id", *page, F.col("op_idx").alias("open_idx"), "close_idx", "level", "tag", "mcid")


def innermost_mcid(deep: DataFrame, span: DataFrame, *page: str) -> DataFrame:
    """doc_id, op_idx, mcid of each painting instruction inside a span that carries one; spans without are transparent."""
    s = span.filter("mcid IS NOT NULL").select("doc_id", *page, "open_idx", "close_idx", F.col("mcid").alias("in_mcid"))
    paint = deep.filter(F.col("op").isin(*PAINTS)).select("doc_id", *page, "op_idx")
    hit = paint.join(s, ["doc_id", *page]).filter((F.col("op_idx") > F.col("open_idx")) & (F.coalesce("close_idx", F.lit(1 << 62)) > F.col("op_idx")))
    return hit.groupBy("doc_id", *page, "op_idx").agg(F.max_by("in_mcid", "open_idx").alias("mcid"))


def orphan_mcids(ops: DataFrame, claimed: DataFrame) -> DataFrame:
    """doc_id, mcid that a span carries (artifacts aside) and no tag claims."""
    return ops.filter(F.col("op").isin(*OPENS) & F.col("mcid").isNotNull() & ~F.col("tag").eqNullSafe("Artifact")).select("doc_id", "mcid").distinct().join(claimed, ["doc_id", "mcid"], "left_anti")


def orphan_spans(span: DataFrame, claimed: DataFrame) -> DataFrame:
    """doc_id, open_idx of closed top-level spans without mcid, artifacts aside, that hold no claimed mcid at any depth."""
    top = span.filter("level = 1 AND close_idx IS NOT NULL AND mcid IS NULL AND NOT tag <=> 'Artifact'")
    held = span.join(claimed, ["doc_id", "mcid"], "left_semi").select(F.col("doc_id").alias("d"), F.col("open_idx").alias("at"))
    return top.join(held, (F.col("doc_id") == F.col("d")) & (F.col("at") > F.col("open_idx")) & (F.col("at") < F.col("close_idx")), "left_anti").select("doc_id", "open_idx")


def unwrapped_runs(deep: DataFrame) -> DataFrame:
    """doc_id, first_paint, last_paint, n_paints of maximal runs outside every span that paint anything; spans and stray closes end a run."""
    w = Window.partitionBy("doc_id").orderBy("op_idx").rowsBetween(Window.unboundedPreceding, 0)
    runs = deep.withColumn("run", F.sum(((F.col("op").isin(*OPENS) & (F.col("depth") == 1)) | ((F.col("op") == CLOSE) & (F.col("depth_before") == 0))).cast("int")).over(w)).filter((F.col("depth") == 0) & (F.col("depth_before") == 0) & F.col("op").isin(*PAINTS))
    return runs.groupBy("doc_id", "run").agg(F.min("op_idx").alias("first_paint"), F.max("op_idx").alias("last_paint"), F.count("*").alias("n_paints")).drop("run")


def orphan_totals(ops: DataFrame, claimed: DataFrame) -> DataFrame:
    """doc_id, n_mcids, n_spans, n_runs, total of the documents with any."""
    deep = with_depth(ops)
    parts = [orphan_mcids(ops, claimed), orphan_spans(spans(deep), claimed), unwrapped_runs(deep)]
    out = None
    for name, p in zip(("n_mcids", "n_spans", "n_runs"), parts):
        n = p.groupBy("doc_id").agg(F.count("*").alias(name))
        out = n if out is None else out.join(n, "doc_id", "full")
    out = out.na.fill(0)
    return out.withColumn("total", F.col("n_mcids") + F.col("n_spans") + F.col("n_runs"))


def _by_page(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", F.struct("doc_id", "page"))


def orphans_by_document(ops: DataFrame, claimed: DataFrame) -> DataFrame:
    """doc_id, total, n_pages of untagged regions, where ops and claimed have a page: each page is a stream of its own."""
    found = orphan_totals(_by_page(ops), _by_page(claimed))
    return found.groupBy("doc_id.doc_id").agg(F.sum("total").cast("long").alias("total"), F.count("*").alias("n_pages"))


def shown_text(ops: DataFrame) -> DataFrame:
    """doc_id, page, mcid of the innermost marked span around each instruction that shows text with a visible glyph (column visible)."""
    deep = with_depth(ops, "page")
    seen = ops.filter(F.col("op").isin(*_TEXT) & F.col("visible")).select("doc_id", "page", "op_idx")
    return innermost_mcid(deep, spans(deep, "page"), "page").join(seen, ["doc_id", "page", "op_idx"], "left_semi").select("doc_id", "page", "mcid").distinct()


def repaired(ops: DataFrame, claimed: DataFrame) -> DataFrame:
    """The stream with orphans made artifacts: opening instructions rewritten, a span put around each unwrapped run; numbered anew.
    Running it on its own result changes nothing."""
    deep = with_depth(ops)
    loose = spans(deep).join(orphan_mcids(ops, claimed), ["doc_id", "mcid"], "left_semi").filter("NOT tag <=> 'Artifact'").select("doc_id", "open_idx").unionByName(orphan_spans(spans(deep), claimed))
    fix = ops.join(loose.withColumnRenamed("open_idx", "op_idx").withColumn("fix", F.lit(True)), ["doc_id", "op_idx"], "left")
    old = fix.select("doc_id", F.col("op_idx") * 4, F.when(F.col("fix"), "BMC").otherwise(F.col("op")).alias("op"), F.when(F.col("fix"), "Artifact").otherwise(F.col("tag")).alias("tag"), F.when(F.col("fix"), None).otherwise(F.col("mcid")).alias("mcid")).toDF("doc_id", "at", "op", "tag", "mcid")
    run = unwrapped_runs(deep)
    none = F.lit(None).cast("int").alias("mcid")
    begin = run.select("doc_id", (F.col("first_paint") * 4 - 1).alias("at"), F.lit("BMC").alias("op"), F.lit("Artifact").alias("tag"), none)
    end = run.select("doc_id", (F.col("last_paint") * 4 + 1).alias("at"), F.lit(CLOSE).alias("op"), F.lit(None).cast("string").alias("tag"), none)
    new = old.unionByName(begin).unionByName(end)
    return new.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("at")).cast("long").alias("op_idx"), "op", "tag", "mcid")


def repaired_pages(ops: DataFrame, claimed: DataFrame) -> DataFrame:
    """``repaired`` page by page: doc_id, page, op_idx, op, tag, mcid."""
    return repaired(_by_page(ops), _by_page(claimed)).select("doc_id.doc_id", "doc_id.page", "op_idx", "op", "tag", "mcid")


def repair_status(info: DataFrame, tree: DataFrame, orphans: DataFrame) -> DataFrame:
    """doc_id, status, n: of each document 'skipped' (no tree), 'clean' or 'repaired' with the number of its regions. orphans: doc_id, total."""
    treed = tree.filter("depth = 0").select("doc_id").distinct().withColumn("tree", F.lit(True))
    d = info.select("doc_id").join(treed, "doc_id", "left").join(orphans, "doc_id", "left")
    return d.select("doc_id", F.when(F.col("tree").isNull(), "skipped").when(F.col("total").isNull(), "clean").otherwise("repaired").alias("status"), F.when(F.col("tree"), F.coalesce("total", F.lit(0))).otherwise(0).cast("long").alias("n"))


def kind_of(ops: Column) -> Column:
    """Of an array of painting operators: text, image, path, mixed, or region where there are none."""
    text, image, path = F.exists(ops, lambda o: o.isin(*_TEXT)), F.exists(ops, lambda o: o == "Do"), F.exists(ops, lambda o: o.isin(*[p for p in PAINTS if p not in _TEXT and p != "Do"]))
    n = text.cast("int") + image.cast("int") + path.cast("int")
    return F.when(n > 1, "mixed").when(text, "text").when(image, "image").when(path, "path").otherwise("region")


def artifact_paint(deep: DataFrame, span: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Outermost closed Artifact spans (doc_id, open_idx, close_idx, ...), and the painting instructions inside one, with its open_idx. Such spans are
    disjoint, so an instruction's span is the last one opened before it: one pass in order, no join by range."""
    a = span.filter("tag = 'Artifact' AND close_idx IS NOT NULL")
    w = Window.partitionBy("doc_id").orderBy("open_idx").rowsBetween(Window.unboundedPreceding, -1)
    a = a.withColumn("end_before", F.max("close_idx").over(w)).filter("end_before IS NULL OR open_idx > end_before").drop("end_before")
    opened = a.select("doc_id", F.col("open_idx").alias("op_idx"), F.struct("open_idx", "close_idx").alias("own"))
    both = deep.filter(F.col("op").isin(*PAINTS)).unionByName(opened, allowMissingColumns=True)
    last = F.last("own", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("op_idx").rowsBetween(Window.unboundedPreceding, 0))
    paint = both.withColumn("last", last).filter("own IS NULL AND op_idx < last.close_idx").withColumn("open_idx", F.col("last.open_idx")).drop("own", "last")
    return a, paint


def _listed(found: DataFrame, most: int) -> DataFrame:
    v = Window.partitionBy("doc_id")
    return found.withColumn("n", F.row_number().over(v.orderBy("open_idx"))).withColumn("truncated", F.count("*").over(v) > most).filter(F.col("n") <= most).drop("n")


def artifacts(deep: DataFrame, span: DataFrame, most: int = 2000) -> DataFrame:
    """doc_id, open_idx, kind, truncated: outermost closed Artifact spans that paint, the first of each document."""
    _, paint = artifact_paint(deep, span)
    return _listed(paint.groupBy("doc_id", "open_idx").agg(kind_of(F.collect_set("op")).alias("kind")), most).select("doc_id", "open_idx", "kind", "truncated")


def artifact_details(deep: DataFrame, span: DataFrame, declared: DataFrame, most: int = 2000) -> DataFrame:
    """doc_id, open_idx, kind, subtype, text, x0, y0, x1, y1, d0, d1, d2, d3, truncated: as ``artifacts``, with what a span says and where.

    deep: also text, x, y, end_x, end_y, size of shown strings, and the box x0, y0, x1, y1 of what an instruction paints. declared: doc_id, open_idx, subtype,
    d0..d3 (the box that the span itself states). The text is broken as by ``broken_text``; a span that paints nothing is listed only if it states
    a box, as a region. Boxes are rounded to two places."""
    a, paint = artifact_paint(deep, span)
    said = regions.broken_text(paint.filter(F.col("op").isin(*_TEXT) & F.col("text").isNotNull()).withColumn("seq", F.col("op_idx")), "doc_id", "open_idx")
    drawn = paint.groupBy("doc_id", "open_idx").agg(kind_of(F.collect_set("op")).alias("kind"), *(f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))))
    own = declared.select("doc_id", "open_idx", "subtype", "d0", "d1", "d2", "d3")
    every = a.select("doc_id", "open_idx").join(own, ["doc_id", "open_idx"], "left").join(drawn, ["doc_id", "open_idx"], "left").join(said, ["doc_id", "open_idx"], "left")
    every = every.filter("kind IS NOT NULL OR d0 IS NOT NULL").withColumn("kind", F.coalesce("kind", F.lit("region"))).withColumn("text", F.coalesce("text", F.lit("")))
    boxes = [F.round(c, 2).alias(c) for c in ("x0", "y0", "x1", "y1", "d0", "d1", "d2", "d3")]
    return _listed(every, most).select("doc_id", "open_idx", "kind", "subtype", "text", *boxes, "truncated")


def restored(artifact: DataFrame, targets: DataFrame, next_mcid: DataFrame) -> DataFrame:
    """doc_id, open_idx, mcid: targets (doc_id, open_idx) get new mcids in order; one stale target refuses its document's batch."""
    t = targets.distinct()
    ok = t.join(artifact.select("doc_id", "open_idx").withColumn("known", F.lit(True)), ["doc_id", "open_idx"], "left")
    bad = ok.filter("known IS NULL").select("doc_id").distinct()
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("open_idx")) - 1
    return ok.join(bad, "doc_id", "left_anti").withColumn("n", n).join(next_mcid, "doc_id", "left").select("doc_id", "open_idx", (F.coalesce("mcid", F.lit(0)) + F.col("n")).cast("int").alias("mcid"))


def restored_elements(restored: DataFrame, pages: DataFrame, parents: DataFrame, element_id: Column, leaf_id: Column, role: str = "P") -> DataFrame:
    """Node rows for restored artifacts (doc_id, open_idx, mcid): one new element a document at the end of its parent (doc_id, node_id), on the
    first leaf's page; leaves of other pages name their own. pages: doc_id, open_idx, page. Ids come from doc_id, and from open_idx too."""
    s = restored.join(pages, ["doc_id", "open_idx"])
    home = s.groupBy("doc_id").agg(F.min_by("page", "open_idx").alias("own_page")).join(parents.select("doc_id", F.col("node_id").alias("parent_id")), "doc_id")
    none = F.lit(None).cast("int")
    new = home.select("doc_id", element_id.alias("node_id"), "parent_id", F.lit(1 << 62).alias("ord"), F.lit("element").alias("type"), F.lit("element").alias("kind"), F.lit(role).alias("role"), F.col("own_page"), none.alias("mcid"))
    leaf = s.join(home.select("doc_id", F.col("own_page").alias("p_page")), "doc_id")
    away = ~F.col("page").eqNullSafe(F.col("p_page"))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("open_idx")) - 1
    return new.unionByName(leaf.select("doc_id", leaf_id.alias("node_id"), element_id.alias("parent_id"), n.cast("long").alias("ord"), F.lit("content").alias("type"), F.when(away, "content-dict").otherwise("content-int").alias("kind"), F.lit(None).cast("string").alias("role"), F.when(away, F.col("page")).alias("own_page"), F.col("mcid")))

"""Summaries of a corpus: one row a document, a page or a provider."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.scratch import written
from . import tree as t
from .audit import head_level
from .predicates import numbered_heading, organizational


def tree_summary(tree: DataFrame, empty: DataFrame) -> DataFrame:
    """doc_id, n_tags, n_leaves, max_depth (of elements), n_figures_without_alt, n_headings, n_empty."""
    e = F.col("type") == "element"
    sums = tree.groupBy("doc_id").agg(
        F.count_if(e).alias("n_tags"), F.count_if(F.col("type") == "content").alias("n_leaves"), F.coalesce(F.max(F.when(e, F.col("depth"))), F.lit(0)).alias("max_depth"),
        F.count_if(F.col("role").isin("Figure", "Formula") & (F.coalesce("alt", F.lit("")) == "")).alias("n_figures_without_alt"), F.count_if(numbered_heading(F.col("role"))).alias("n_headings"))
    return sums.join(empty.groupBy("doc_id").agg(F.count("*").alias("n_empty")), "doc_id", "left").na.fill(0, ["n_empty"])


def tags_per_role(tree: DataFrame) -> DataFrame:
    return tree.filter("type = 'element'").groupBy("doc_id", "role").agg(F.count("*").alias("n"))


def tags_per_page(tree: DataFrame) -> DataFrame:
    e = tree.filter("type = 'element'").select("doc_id", "node_id")
    return t.page_of(tree).join(e, ["doc_id", "node_id"], "left_semi").filter("page_no IS NOT NULL").groupBy("doc_id", "page_no").agg(F.count("*").alias("n"))


def heading_list(tree: DataFrame, most: int = 200) -> DataFrame:
    """doc_id, node_id, level, truncated: the first headings of each document."""
    w = Window.partitionBy("doc_id")
    h = tree.filter(numbered_heading(F.col("role"))).withColumn("n", F.row_number().over(w.orderBy("pre"))).withColumn("truncated", F.count("*").over(w) > most)
    return h.filter(F.col("n") <= most).select("doc_id", "node_id", head_level().alias("level"), "truncated")


def organizational_below(tree: DataFrame) -> DataFrame:
    """doc_id, node_id, n: organizational tags strictly below each element that has any."""
    return t.below(tree, organizational(F.col("role"))).filter("anc <> node_id AND step.type = 'element'").groupBy("doc_id", F.col("anc").alias("node_id")).agg(F.count("*").alias("n"))


def link_totals(tree: DataFrame) -> DataFrame:
    return tree.groupBy("doc_id").agg(F.count_if(F.col("role") == "Link").alias("n_links"), F.count_if((F.col("type") == "object-ref") & F.col("target_id").isNotNull()).alias("n_objects"))


def severity_below(tree: DataFrame, flagged: DataFrame) -> DataFrame:
    """doc_id, node_id, severity: the largest severity strictly below; flagged: doc_id, node_id, severity."""
    up = t.below(tree.join(flagged, ["doc_id", "node_id"]), F.lit(True)).filter("anc <> node_id")
    return up.groupBy("doc_id", F.col("anc").alias("node_id")).agg(F.max("severity").alias("severity"))


def badges(tree: DataFrame, ai: DataFrame, at: DataFrame) -> DataFrame:
    """doc_id, node_id, badge: own AI before AI below before own AT before AT below; a star for each degree."""
    out, parts = tree.select("doc_id", "node_id"), []
    for name, flags in (("AI", ai), ("AT", at)):
        for tail, df in (("", flags), ("↓", severity_below(tree, flags))):
            c = f"b{len(parts)}"
            out = out.join(df.select("doc_id", "node_id", F.concat(F.lit(name), F.repeat(F.lit("*"), F.col("severity")), F.lit(tail)).alias(c)), ["doc_id", "node_id"], "left")
            parts.append(c)
    return out.select("doc_id", "node_id", F.coalesce(*parts).alias("badge")).filter("badge IS NOT NULL")


def batch_time(log: DataFrame, keep: int = 50) -> DataFrame:
    """provider, low, high: expected milliseconds a character from the last runs over all providers; few runs give the median less
    or more three tenths, else the quartiles."""
    last = log.orderBy(F.desc("ts"), F.desc("run_id")).limit(keep)
    r = F.col("ms") / F.col("chars")
    s = last.filter("chars > 0").groupBy("provider").agg(F.count("*").alias("n"), F.percentile(r, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    q = lambda i: F.element_at("q", i)
    few = F.col("n") < 4
    return s.select("provider", F.round(F.when(few, q(2) * 0.7).otherwise(q(1)), 6).alias("low"), F.round(F.when(few, q(2) * 1.3).otherwise(q(3)), 6).alias("high"))


def depth_first(outline: DataFrame, most_levels: int = 1_000) -> DataFrame:
    """The outline (doc_id, bookmark_id, parent, ord, ...) with level (from 0) and place: its position in depth-first order, from 1. Level by level."""
    outline = written(outline, "outline")
    level = written(outline.filter("parent IS NULL").withColumn("route", F.array(F.struct("ord", "bookmark_id"))), "level")
    found, n = level, 1
    while not level.isEmpty():
        if n > most_levels:
            raise ValueError(f"the outline has more than {most_levels} levels, or a cycle")
        up = level.select("doc_id", F.col("bookmark_id").alias("parent"), F.col("route").alias("up"))
        level = written(outline.join(up, ["doc_id", "parent"]).withColumn("route", F.concat("up", F.array(F.struct("ord", "bookmark_id")))).select(found.columns), "level")
        found, n = found.unionByName(level), n + 1
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("route"))
    return found.withColumn("level", F.size("route") - 1).withColumn("place", place).drop("route")


def bookmark_listing(outline: DataFrame, most: int = 300) -> DataFrame:
    """doc_id, bookmark_id, level, total, truncated: the first bookmarks of a document, depth first. An outline without parents is one level."""
    flat = outline if "parent" in outline.columns else outline.withColumn("parent", F.lit(None).cast("long"))
    total = F.count("*").over(Window.partitionBy("doc_id"))
    return depth_first(flat).withColumn("total", total).filter(F.col("place") <= most).select("doc_id", "bookmark_id", "level", "total", (F.col("total") > most).alias("truncated"))


def heading_parents(headings: DataFrame) -> DataFrame:
    """doc_id, node_id, parent: of each heading the nearest one before it of a strictly lower level."""
    h = headings.withColumn("level", head_level())
    w = Window.partitionBy("doc_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    last = {k: F.last(F.when(F.col("level") == k, F.struct("pre", "node_id")), ignorenulls=True).over(w) for k in range(1, 6)}
    for k, c in last.items():
        h = h.withColumn(f"l{k}", c)
    low: Column = F.greatest(*[F.when(F.col("level") > k, F.col(f"l{k}")) for k in range(1, 6)])
    return h.select("doc_id", "node_id", low["node_id"].alias("parent"))


def bookmark_parents(tree: DataFrame) -> DataFrame:
    """``heading_parents`` of a generated outline. A heading that is on no page is left out: it gets no bookmark and is no parent."""
    paged = t.page_of(tree).filter("page_no IS NOT NULL").select("doc_id", "node_id")
    return heading_parents(tree.filter(numbered_heading(F.col("role"))).join(paged, ["doc_id", "node_id"], "left_semi"))


def outline_slot(outline: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page, after: the last bookmark of one level whose page isn't later; the scan stops at the first later page.

    The largest page so far rises along the level, so a page's slot is the last bookmark at which it isn't above the page: one as-of pass."""
    so_far = F.max("page").over(Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    last = outline.filter("page IS NOT NULL").withColumn("v", so_far).groupBy("doc_id", "v").agg(F.max_by("bookmark_id", "ord").alias("bookmark_id"))
    both = last.select("doc_id", "v", F.lit(0).alias("k"), "bookmark_id").unionByName(pages.select("doc_id", F.col("page").alias("v"), F.lit(1).alias("k"), F.lit(None).cast(last.schema["bookmark_id"].dataType).alias("bookmark_id")))
    w = Window.partitionBy("doc_id").orderBy("v", "k").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("after", F.last("bookmark_id", ignorenulls=True).over(w)).filter("k = 1").select("doc_id", F.col("v").alias("page"), "after")


def nested_slots(outline: DataFrame, pages: DataFrame, most_levels: int = 1_000) -> DataFrame:
    """doc_id, page, parent, after: where a bookmark for a page belongs in a nested outline (doc_id, bookmark_id, parent, ord, page).

    On each level as ``outline_slot``; where the bookmark found has children, the search goes on among them, all pages of all documents a level at a
    time. after null: in front of the parent's children (parent null: of the whole outline)."""
    outline = written(outline.select("doc_id", "bookmark_id", "parent", "ord", "page"), "outline")
    parents = outline.filter("parent IS NOT NULL").select("doc_id", F.col("parent").alias("after"), F.lit(True).alias("more")).distinct()
    group = lambda parent: F.coalesce(parent, F.lit(-(1 << 63)).cast("long"))  # noqa: E731  null is a group of its own
    so_far = F.max("page").over(Window.partitionBy("doc_id", "g").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    steps = outline.filter("page IS NOT NULL").withColumn("g", group(F.col("parent"))).withColumn("v", so_far).groupBy("doc_id", "g", "v").agg(F.max_by("bookmark_id", "ord").alias("bookmark_id"))
    steps = written(steps, "steps")
    now, found, n = written(pages.select("doc_id", "page").distinct().withColumn("parent", F.lit(None).cast("long")), "slots"), None, 0
    while True:
        if n > most_levels:
            raise ValueError(f"the outline has more than {most_levels} levels, or a cycle")
        both = now.select("doc_id", group(F.col("parent")).alias("g"), F.col("page").alias("v"), F.lit(1).alias("k"), F.lit(None).cast("long").alias("bookmark_id"), "parent")
        both = both.unionByName(steps.join(both.select("doc_id", "g").distinct(), ["doc_id", "g"], "left_semi").withColumn("k", F.lit(0)), allowMissingColumns=True)
        w = Window.partitionBy("doc_id", "g").orderBy("v", "k").rowsBetween(Window.unboundedPreceding, 0)
        at = both.withColumn("after", F.last("bookmark_id", ignorenulls=True).over(w)).filter("k = 1").select("doc_id", F.col("v").alias("page"), "parent", "after")
        at = written(at.join(parents, ["doc_id", "after"], "left"), "slots")
        done = at.filter("more IS NULL").select("doc_id", "page", "parent", "after")
        found = done if found is None else found.unionByName(done)
        now = at.filter("more").select("doc_id", "page", F.col("after").alias("parent"))
        if now.isEmpty():
            return found
        n += 1

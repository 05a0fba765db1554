"""Projections, filters and predicates over nodes with tree keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import tree as t
from .fold import fold

# fixed values: role categories
NUMBERED = ("H1", "H2", "H3", "H4", "H5", "H6")
HEADINGS = ("H", "H1", "H2", "H3", "H4", "H5", "H6", "Title")
CATEGORY = {
    **dict.fromkeys(HEADINGS, "heading"),
    **dict.fromkeys(("Document", "Part", "Art", "Sect", "Div", "TOC", "TOCI", "Index", "NonStruct", "Private"), "container"),
    **dict.fromkeys(("L", "LI", "Lbl", "LBody"), "list"),
    **dict.fromkeys(("Table", "TR", "TH", "TD", "THead", "TBody", "TFoot"), "table"),
    **dict.fromkeys(("Figure", "Formula"), "figure"),
}


def category(role: Column) -> Column:
    """Category of a role: inline where it is unknown, leaf where there is none."""
    known = F.create_map(*[F.lit(x) for kv in CATEGORY.items() for x in kv])
    return F.when(role.isNull(), "leaf").otherwise(F.coalesce(F.try_element_at(known, role), F.lit("inline")))


def organizational(role: Column) -> Column:
    """div, sect, part, sub exactly, or anything with 'span', whatever the case."""
    low = F.lower(F.coalesce(role, F.lit("")))
    return low.isin("div", "sect", "part", "sub") | F.contains(low, F.lit("span"))


def span_like(role: Column) -> Column:
    return F.contains(F.lower(F.coalesce(role, F.lit(""))), F.lit("span"))


def blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def numbered_heading(role: Column) -> Column:
    return role.isin(*NUMBERED)


#: Filters that list only the outermost of nested matches.
STOP_AT_MATCH = ("figures", "table", "lists", "empty")


def filters(tree: DataFrame, empty: DataFrame, flags: DataFrame | None = None) -> DataFrame:
    """doc_id, node_id, filter for each tag filter that a node passes. Every node passes 'all'; the others ask for elements, the hidden wrapper aside. ``empty``:
    doc_id, node_id of empty tags; ``flags``: doc_id, node_id, severity (1, or 2 where more than white space changed), one a node."""
    wrapper = t.hidden_wrappers(tree).withColumn("wrapper", F.lit(True))
    e = tree.join(wrapper, ["doc_id", "node_id"], "left").withColumn("tag", (F.col("type") == "element") & F.col("wrapper").isNull())
    e = e.join(empty.select("doc_id", "node_id", F.lit(True).alias("is_empty")), ["doc_id", "node_id"], "left")
    flags = tree.select("doc_id", "node_id", F.lit(1).alias("severity")).limit(0) if flags is None else flags.select("doc_id", "node_id", "severity")
    e = e.join(flags, ["doc_id", "node_id"], "left")
    tags = F.array_compact(F.array(
        F.when(F.col("severity").isNotNull(), "flagged"), F.when(F.col("severity") == 2, "flagged-substantive"),
        F.when(F.col("role").isin(*HEADINGS), "headings"), F.when(F.col("role") == "Figure", "figures"), F.when(F.col("role") == "Table", "table"),
        F.when(F.col("role").isin("L", "LI"), "lists"), F.when(F.col("role").isin("Figure", "Formula") & (F.coalesce("alt", F.lit("")) == ""), "alt-missing"), F.when(F.col("is_empty"), "empty")))
    passes = F.concat(F.array(F.lit("all")), F.when(F.col("tag"), tags).otherwise(F.array().cast("array<string>")))
    return e.select("doc_id", "node_id", "path", F.explode(passes).alias("filter"))


def outermost(matches: DataFrame) -> DataFrame:
    """Of matches (doc_id, node_id, path, filter) those without a matching ancestor of the same filter, where the filter stops at a match."""
    stops = F.col("filter").isin(*STOP_AT_MATCH)
    hit = matches.filter(stops).select("doc_id", "filter", F.col("node_id").alias("anc"))
    under = matches.filter(stops).select("doc_id", "filter", "node_id", F.explode(F.transform(t.ancestors(), lambda s: s["node_id"])).alias("anc")).join(hit, ["doc_id", "filter", "anc"], "left_semi")
    return matches.join(under.select("doc_id", "filter", "node_id").distinct(), ["doc_id", "filter", "node_id"], "left_anti").select("doc_id", "node_id", "filter")


def proofread(tree: DataFrame) -> DataFrame:
    """doc_id, node_id of elements to proofread.

    An element qualifies by a non-blank actual text or a direct content child, unless its role is Lbl or Figure or it is the
    hidden wrapper; a span-like one does not if an ancestor qualifies or is Lbl or Figure."""
    direct = tree.filter("type = 'content'").groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.lit(True).alias("direct"))
    wrapper = t.hidden_wrappers(tree).withColumn("wrapper", F.lit(True))
    e = tree.filter("type = 'element'").join(direct, ["doc_id", "node_id"], "left").join(wrapper, ["doc_id", "node_id"], "left")
    base = F.col("wrapper").isNull() & ~F.col("role").isin("Lbl", "Figure") & (~blank(F.col("actual_text")) | F.coalesce("direct", F.lit(False)))
    e = e.withColumn("base", base)
    stops = e.filter(F.col("base") | F.col("role").isin("Lbl", "Figure")).select("doc_id", F.col("node_id").alias("anc"))
    spans = e.filter(F.col("base") & span_like(F.col("role"))).select("doc_id", "node_id", F.explode(F.transform(t.ancestors(), lambda s: s["node_id"])).alias("anc"))
    covered = spans.join(stops, ["doc_id", "anc"], "left_semi").select("doc_id", "node_id").distinct()
    return e.filter("base").join(covered, ["doc_id", "node_id"], "left_anti").select("doc_id", "node_id")


def find_nodes(tree: DataFrame, roles: list[str] | None = None, text: str | None = None, pages: tuple[int, int] | None = None, missing_alt: bool = False, most: int | None = None, content: DataFrame | None = None) -> DataFrame:
    """doc_id, node_id, role, page_no: elements that pass every filter, at most ``most`` a document in document order.

    text is looked for in the actual text, the alternate text and, where given, the content (doc_id, node_id, text)."""
    e = tree.filter("type = 'element'").join(t.page_of(tree), ["doc_id", "node_id"])
    if roles:
        e = e.filter(F.col("role").isin(roles))
    if pages:
        e = e.filter(F.col("page_no").between(*pages))
    if missing_alt:
        e = e.filter(F.col("role").isin("Figure", "Formula") & (F.coalesce("alt", F.lit("")) == ""))
    if text:
        shown = [F.coalesce("actual_text", F.lit("")), F.coalesce("alt", F.lit(""))]
        if content is not None:
            e = e.join(content.select("doc_id", "node_id", F.col("text").alias("pulled")), ["doc_id", "node_id"], "left")
            shown.append(F.coalesce("pulled", F.lit("")))
        e = e.filter(F.contains(F.lower(F.concat_ws("\n", *shown)), F.lit(text.lower())))
    if most:
        e = e.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("pre"))).filter(F.col("n") <= most)
    return e.select("doc_id", "node_id", "role", "page_no")


_LISTED = "doc_id long, start long, node_id long, level int, content_leaves long, child_count long, truncated boolean"


def subtree(tree: DataFrame, starts: DataFrame, levels: int = 3, most: int = 300, with_leaves: bool = False) -> DataFrame:
    """doc_id, start, node_id, level, content_leaves, child_count, truncated: the tags below each start (doc_id, node_id), itself included, in document order.

    Every tag listed spends one of ``most``, and its content leaves one each where they are listed too (``with_leaves``). A tag's children are left out, and
    counted instead (child_count), ``levels`` below the start, or where they are more than what is left to spend. One pass in document order; its state is what
    is left and where the part left out ends."""
    kids = tree.groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.count_if(F.col("type") != "content").alias("n_tags"), F.count_if(F.col("type") == "content").alias("n_leaves"))
    s = starts.select("doc_id", F.col("node_id").alias("start")).distinct()
    inside = tree.filter("type <> 'content'").select("doc_id", "node_id", "pre", "last_pre", "depth", F.posexplode("path.node_id").alias("at", "start")).join(s, ["doc_id", "start"])
    inside = inside.join(kids, ["doc_id", "node_id"], "left").select("doc_id", "start", "node_id", "pre", "last_pre", (F.col("depth") - F.col("at")).cast("int").alias("level"), F.coalesce("n_tags", F.lit(0)).alias("n_tags"), F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"))

    class Listing:
        def __init__(self):
            self.left, self.upto = most, 0

        def add(self, r):
            if r.pre <= self.upto:
                return []
            self.left -= 1 + (r.n_leaves if with_leaves else 0)
            cut = r.n_tags > 0 and (r.level >= levels or self.left < r.n_tags)
            if cut:
                self.upto = r.last_pre
            return [(r.doc_id, r.start, r.node_id, r.level, r.n_leaves, r.n_tags if cut else None, cut)]

        def end(self, key):
            return ()

    return fold(inside, ["doc_id", "start"], ["pre"], Listing, _LISTED)


def attributes(tree: DataFrame) -> DataFrame:
    """doc_id, node_id, attributes: those that are set and not empty, as 'name=value' joined by ';'."""
    pair = [F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{c}="), F.col(c))) for c in ("alt", "actual_text", "scope")]
    return tree.filter("type = 'element'").select("doc_id", "node_id", F.concat_ws(";", *pair).alias("attributes")).filter("attributes <> ''")


def change_candidates(tree: DataFrame) -> DataFrame:
    """doc_id, node_id, text: elements but Table and Document whose actual text may differ from their content: those with one that isn't blank."""
    return tree.filter("type = 'element' AND role NOT IN ('Table', 'Document')").filter(~blank(F.col("actual_text"))).select("doc_id", "node_id", F.col("actual_text").alias("text"))


def proofread_filtered(tree: DataFrame, matches: DataFrame, name: str) -> DataFrame:
    """doc_id, node_id of the proofread list narrowed to one filter's matches (see ``filters``)."""
    return proofread(tree).join(matches.filter(F.col("filter") == name), ["doc_id", "node_id"], "left_semi")


def live_proposals(tree: DataFrame, proposals: DataFrame) -> DataFrame:
    """Proposals (doc_id, node_id, suggested, ...) whose node is still there with the suggested text as its actual text."""
    now = tree.filter("type = 'element'").select("doc_id", "node_id", F.coalesce("actual_text", F.lit("")).alias("suggested"))
    return proposals.join(now, ["doc_id", "node_id", "suggested"], "left_semi")


def clip(text: Column, most: int) -> Column:
    """White space collapsed, trimmed, cut to ``most`` characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)


def fix_candidates(tree: DataFrame, leaf_text: DataFrame) -> DataFrame:
    """doc_id, node_id, text: elements but Table and Document with an actual text, or else the text of their direct leaves; blank ones go."""
    direct = tree.filter("type = 'content'").join(leaf_text, ["doc_id", "node_id"]).filter("text <> ''").groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", "text"))), lambda s: s["text"]), " ").alias("direct"))
    e = tree.filter("type = 'element' AND role NOT IN ('Table', 'Document')").join(direct, ["doc_id", "node_id"], "left")
    return e.withColumn("text", F.when(~blank(F.col("actual_text")), F.col("actual_text")).otherwise(F.col("direct"))).filter(~blank(F.col("text"))).select("doc_id", "node_id", "text")

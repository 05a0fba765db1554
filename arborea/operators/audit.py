"""Audit rules over a corpus: each rule yields doc_id, check_id, node_id, page (from 1) and detail; a report adds a status to each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import tree as t
from .predicates import blank, numbered_heading


def head_level() -> Column:
    return F.expr("TRY_CAST(substring(role, 2) AS INT)")



def _found(df: DataFrame, check: str, node: str | Column = "node_id", page=None, detail: str | Column = "") -> DataFrame:
    node = F.col(node) if isinstance(node, str) else node
    detail = F.lit(detail) if isinstance(detail, str) else detail
    page = F.lit(None) if page is None else page
    return df.select("doc_id", F.lit(check).alias("check_id"), node.cast("long").alias("node_id"), page.cast("int").alias("page"), detail.cast("string").alias("detail"))


def heading_skips(tree: DataFrame) -> DataFrame:
    """Headings deeper than one more than the deepest level seen before (0 at first)."""
    h = tree.filter(numbered_heading(F.col("role"))).withColumn("level", head_level())
    seen = F.coalesce(F.max("level").over(Window.partitionBy("doc_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return _found(h.withColumn("seen", seen).filter("level > seen + 1"), "heading-levels", detail=F.col("seen"))


def empty_nodes(tree: DataFrame) -> DataFrame:
    """doc_id, node_id, role, depth, path, pre, last_pre of elements without content, object or bounding box anywhere below or on
    them; nothing below a node with a bounding box is reported."""
    return tree.filter("type = 'element' AND NOT leafy AND NOT above_bbox")


def empty_headings(empty: DataFrame) -> DataFrame:
    return _found(empty.filter(numbered_heading(F.col("role"))), "heading-content")


def empty_tags(tree: DataFrame, empty: DataFrame) -> DataFrame:
    """Topmost empty tags but cells, headings and the hidden wrapper; an exempt one is walked through."""
    wrapper = t.hidden_wrappers(tree)
    named = empty.filter(~(F.col("role").isin("TD", "TH") | numbered_heading(F.col("role")))).join(wrapper, ["doc_id", "node_id"], "left_anti")
    hit = named.select("doc_id", F.col("node_id").alias("anc"))
    under = named.select("doc_id", "node_id", F.explode(F.transform(t.ancestors(), lambda s: s["node_id"])).alias("anc")).join(hit, ["doc_id", "anc"], "left_semi").select("doc_id", "node_id").distinct()
    return _found(named.join(under, ["doc_id", "node_id"], "left_anti"), "tag-content")


def parent_role() -> Column:
    return F.when(F.col("above_type") == "element", F.col("above_role"))


def nesting(tree: DataFrame) -> DataFrame:
    """Elements whose parent has a wrong role: LI in L, Lbl and LBody in LI, TR in a table part, cells in TR."""
    up = F.coalesce(parent_role(), F.lit("untagged content"))
    rules = {"list-nesting": [(("LI",), ("L",)), (("Lbl", "LBody"), ("LI",))], "row-parent": [(("TR",), ("Table", "THead", "TBody", "TFoot"))], "cell-parent": [(("TH", "TD"), ("TR",))]}
    check = F.lit(None).cast("string")
    for name, cases in rules.items():
        for roles, parents in cases:
            check = F.coalesce(check, F.when(F.col("role").isin(*roles) & ~up.isin(*parents), name))
    e = tree.filter("type = 'element'").withColumn("check_id", check).filter("check_id IS NOT NULL")
    return e.select("doc_id", "check_id", "node_id", F.lit(None).cast("int").alias("page"), up.alias("detail"))


def alt_texts(tree: DataFrame) -> DataFrame:
    return _found(tree.filter(F.col("role").isin("Figure", "Formula") & blank(F.col("alt"))), "alt-text")


def list_items(tree: DataFrame) -> DataFrame:
    """Of each LI: no body, pieces directly in it, elements in it that don't belong (reported themselves)."""
    kids = tree.filter("above_role = 'LI'")
    li = tree.filter("role = 'LI'").select("doc_id", "node_id")
    sums = kids.groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.bool_or(F.col("role").eqNullSafe("LBody")).alias("body"), F.bool_or(F.col("role").eqNullSafe("Lbl")).alias("label"), F.count_if(t.is_content()).alias("loose"))
    li = li.join(sums, ["doc_id", "node_id"], "left").na.fill(0, ["loose"])
    body = li.filter(~F.coalesce("body", F.lit(False))).withColumn("why", F.when(F.coalesce("label", F.lit(False)), "label but no body").otherwise("no body"))
    loose = li.filter("loose > 0")
    stray = kids.filter("type = 'element' AND role NOT IN ('Lbl', 'LBody')")
    return _found(body, "list-contents", detail=F.col("why")).unionByName(_found(loose, "list-contents", detail=F.concat(F.col("loose").cast("string"), F.lit(" directly")))).unionByName(_found(stray, "list-contents", detail=F.concat(F.lit("stray "), F.col("role"))))


def row_widths(tree: DataFrame) -> DataFrame:
    """doc_id, node_id (of the table), n_rows, widths: distinct sums of spans over the rows' cells, zero dropped, sorted."""
    cell = tree.filter(F.col("role").isin("TH", "TD")).withColumn("tr", t.nearest(lambda s: s["role"].isin("TR", "Table")))
    wide = cell.filter(F.col("tr.role") == "TR").groupBy("doc_id", F.col("tr.node_id").alias("row_id")).agg(F.sum(F.coalesce(F.nullif("col_span", F.lit(0)), F.lit(1))).alias("width"))
    rows = tree.filter("role = 'TR'").withColumn("table", t.nearest(lambda s: s["role"] == "Table")["node_id"]).filter("table IS NOT NULL").select("doc_id", F.col("node_id").alias("row_id"), F.col("table").alias("node_id"))
    return rows.join(wide, ["doc_id", "row_id"], "left").groupBy("doc_id", "node_id").agg(F.count("*").alias("n_rows"), F.array_join(F.transform(F.array_sort(F.collect_set(F.nullif("width", F.lit(0)))), lambda x: x.cast("string")), ",").alias("widths"))


def irregular_tables(tree: DataFrame) -> DataFrame:
    return _found(row_widths(tree).filter("n_rows >= 2 AND contains(widths, ',')"), "table-regularity", detail=F.col("widths"))


def table_headers(tree: DataFrame) -> DataFrame:
    """A table without TH once; else each TH without a scope."""
    cell = tree.filter(F.col("role").isin("TH", "TD")).withColumn("table", t.nearest(lambda s: s["role"] == "Table")["node_id"]).filter("table IS NOT NULL")
    has = cell.filter("role = 'TH'").select("doc_id", F.col("table").alias("node_id")).distinct()
    none = tree.filter("role = 'Table'").join(has, ["doc_id", "node_id"], "left_anti")
    return _found(none, "table-headers", detail="no header").unionByName(_found(cell.filter(F.col("role") == "TH").filter(blank(F.col("scope"))), "table-headers", detail="no scope"))


def link_tags(tree: DataFrame, annotations: DataFrame, role_map: DataFrame | None = None) -> DataFrame:
    """doc_id, annot_id, page, contents, link: the first Link element that holds the annotation's object leaf, or null.

    role_map (doc_id, custom, standard): roles that stand for Link count as it."""
    leaf = tree.filter("type = 'object-ref' AND target_id IS NOT NULL")
    leaf = leaf.select("doc_id", F.col("target_id").alias("annot_id"), "pre", F.col("above_role").alias("custom"), F.col("parent_id").alias("link"))
    if role_map is not None:
        leaf = leaf.join(role_map.select("doc_id", "custom", "standard"), ["doc_id", "custom"], "left").withColumn("custom", F.coalesce("standard", "custom"))
    first = leaf.filter("custom = 'Link'").groupBy("doc_id", "annot_id").agg(F.min_by("link", "pre").alias("link"))
    first = first.join(tree.select("doc_id", F.col("node_id").alias("link"), F.col("alt").alias("link_alt")), ["doc_id", "link"])
    return annotations.join(first, ["doc_id", "annot_id"], "left").select("doc_id", "annot_id", "page", "contents", "link", "link_alt")


def links(tagged: DataFrame) -> DataFrame:
    page = F.col("page") + 1
    untagged = _found(tagged.filter("link IS NULL"), "links-tagged", "link", page)
    silent = _found(tagged.filter(blank(F.col("contents")) & blank(F.col("link_alt"))), "links-described", "link", page)
    return untagged.unionByName(silent)


def tab_order(pages: DataFrame) -> DataFrame:
    return _found(pages.filter("coalesce(tabs, '') <> 'S'"), "tab-order", F.lit(None), F.col("page") + 1)


def document_rules(info: DataFrame, outline: DataFrame, tree: DataFrame) -> DataFrame:
    """doc_id, check_id, status of the rules on a document as a whole.

    info may have has_facts: false where annotations, pages and metadata could not be read, so that rules on them don't apply."""
    facts = _facts(info)
    marks = outline.groupBy("doc_id").agg(F.count("*").alias("n_marks"))
    heads = tree.filter(numbered_heading(F.col("role"))).groupBy("doc_id").agg(F.lit(True).alias("any"), F.bool_or(F.col("role") == "H1").alias("h1"))
    treed = tree.select("doc_id").distinct().withColumn("tree", F.lit(True))
    d = info.join(marks, "doc_id", "left").join(heads, "doc_id", "left").join(treed, "doc_id", "left").withColumn("tree", F.coalesce("tree", F.lit(False)))
    ok = lambda c: F.when(c, "pass").otherwise("fail")
    rules = {
        "tagged": ok(F.col("tree") & F.coalesce("marked_tagged", F.lit(False))), "title": ok(~blank(F.col("title"))), "language": ok(~blank(F.col("lang"))),
        "permission": ok(F.coalesce("accessibility_permission", F.lit(True))), "identifier": F.when(~facts, "na").otherwise(ok(~blank(F.col("pdfua_part")))),
        "bookmarks": F.when(F.coalesce("n_marks", F.lit(0)) > 0, "pass").when(F.col("page_count") >= 20, "warn").otherwise("na"),
        "h1": F.when(F.col("tree"), ok(F.coalesce("h1", F.lit(False)))), "structure": F.when(~F.col("tree"), "na"),
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("check_id"), v.alias("status")) for k, v in rules.items()])
    return d.select("doc_id", F.explode(pairs).alias("r")).select("doc_id", "r.check_id", "r.status").filter("status IS NOT NULL")


def _facts(info: DataFrame) -> Column:
    return F.coalesce("has_facts", F.lit(True)) if "has_facts" in info.columns else F.lit(True)


def figures_with_text(tree: DataFrame, shown: DataFrame) -> DataFrame:
    """Figures and formulas whose own content paints text. shown: doc_id, page, mcid of the innermost marked span around each
    instruction that shows visible glyphs. Of several figures that claim one mcid the first counts."""
    leaf = t.with_page(tree).filter("type = 'content' AND mcid IS NOT NULL").withColumn("figures", F.filter(t.ancestors(), lambda s: s["role"].isin("Figure", "Formula")))
    own = leaf.filter("page IS NOT NULL AND size(figures) > 0").select("doc_id", "page", "mcid", F.explode("figures").alias("f"))
    at = tree.filter(F.col("role").isin("Figure", "Formula")).select("doc_id", F.col("node_id").alias("figure"), F.col("pre").alias("figure_pre"))
    first = own.select("doc_id", "page", "mcid", F.col("f.node_id").alias("figure")).join(at, ["doc_id", "figure"]).groupBy("doc_id", "page", "mcid").agg(F.min_by("figure", "figure_pre").alias("node_id"))
    return _found(first.join(shown.select("doc_id", "page", "mcid").distinct(), ["doc_id", "page", "mcid"], "left_semi").select("doc_id", "node_id").distinct(), "figure-text")


#: Rules on nodes, and the status that a finding gives. Those on links and figures' text rest on the document's facts.
NODE_CHECKS = {"heading-levels": "fail", "heading-content": "fail", "tag-content": "fail", "list-nesting": "fail", "list-contents": "fail", "row-parent": "fail", "cell-parent": "fail", "table-regularity": "warn", "table-headers": "fail", "alt-text": "fail"}
FACT_CHECKS = {"links-tagged": "fail", "links-described": "fail", "figure-text": "warn"}


def instances(tree: DataFrame, pages: DataFrame, annotations: DataFrame, empty: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """Every finding of the rules on nodes and pages; those on text in figures only where ``shown`` is given."""
    parts = [tab_order(pages), heading_skips(tree), empty_headings(empty), empty_tags(tree, empty), nesting(tree), list_items(tree), irregular_tables(tree), table_headers(tree), alt_texts(tree), links(link_tags(tree, annotations))]
    parts += [] if shown is None else [figures_with_text(tree, shown)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def report(info: DataFrame, documents: DataFrame, found: DataFrame, tree: DataFrame, annotations: DataFrame, orphans: DataFrame | None = None) -> DataFrame:
    """doc_id, check_id, status, n: the whole report.

    A clean rule passes. A document without a tree has one rule 'structure' in place of all rules on nodes; without facts, or
    without link annotations, one rule 'links' in place of two; both don't apply. orphans: doc_id, total of untagged regions."""
    n = found.groupBy("doc_id", "check_id").agg(F.count("*").alias("n"))
    if orphans is not None:
        n = n.unionByName(orphans.select("doc_id", F.lit("orphaned-content").alias("check_id"), F.col("total").cast("long").alias("n")))
    treed = tree.filter("depth = 0").select("doc_id").distinct().withColumn("tree", F.lit(True))
    linked = annotations.select("doc_id").distinct().withColumn("linked", F.lit(True))
    d = info.select("doc_id", _facts(info).alias("facts")).join(treed, "doc_id", "left").join(linked, "doc_id", "left").na.fill(False, ["tree", "linked"])
    rule = lambda name, bad, when: F.when(when, F.struct(F.lit(name).alias("check_id"), F.lit(bad).alias("bad")))
    tree_, facts, links_ = F.col("tree"), F.col("facts"), F.col("facts") & F.col("linked")
    rules = [rule("tab-order", "fail", facts), rule("tab-order", "na", ~facts), *(rule(k, v, tree_) for k, v in NODE_CHECKS.items()), rule("links", "na", tree_ & ~links_)]
    rules += [rule(k, v, tree_ & links_ if k.startswith("links") else tree_ & facts) for k, v in FACT_CHECKS.items()] + [rule("orphaned-content", "fail", tree_)]
    every = d.select("doc_id", F.explode(F.array_compact(F.array(*rules))).alias("c")).select("doc_id", "c.*")
    status = F.when(F.col("bad") == "na", "na").when(F.col("n") > 0, F.col("bad")).otherwise("pass")
    nodes = every.join(n, ["doc_id", "check_id"], "left").select("doc_id", "check_id", status.alias("status"), F.when(F.col("bad") == "na", 0).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n"))
    return documents.withColumn("n", F.lit(0).cast("long")).unionByName(nodes)


def counts(report_: DataFrame) -> DataFrame:
    """doc_id, n_fail, n_warn, n_pass; rules that don't apply are not counted."""
    return report_.groupBy("doc_id").agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("fail", "warn", "pass")])


def identifier_gate(report_: DataFrame) -> DataFrame:
    """doc_id, fixable: whether the missing identifier may be set, as no other rule fails."""
    other = report_.groupBy("doc_id").agg(F.count_if((F.col("status") == "fail") & (F.col("check_id") != "identifier")).alias("others"), F.bool_or((F.col("check_id") == "identifier") & (F.col("status") == "fail")).alias("missing"))
    return other.filter("missing").select("doc_id", (F.col("others") == 0).alias("fixable"))


def capped(found: DataFrame, most: int = 100) -> DataFrame:
    """doc_id, check_id, node_id, truncated: the first findings of each check of a document."""
    w = Window.partitionBy("doc_id", "check_id")
    return found.withColumn("n", F.row_number().over(w.orderBy(F.col("node_id").asc_nulls_first(), F.col("page"), F.col("detail")))).withColumn("truncated", F.count("*").over(w) > most).filter(F.col("n") <= most).select("doc_id", "check_id", "node_id", "truncated")

"""Bulk rewrites of trees: each takes nodes with tree keys and returns a new version's rows.

A rewrite gives every node a new parent and a sort key (the old positions of its path); ``renumbered`` then
writes ord afresh and ``tree_keys`` numbers the new tree. Resolved pages are kept before a parent vanishes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.scratch import written
from . import tree as t
from .predicates import blank, numbered_heading, organizational

NODE = ("doc_id", "node_id", "parent_id", "ord", "type", "kind", "role", "alt", "actual_text", "scope", "col_span", "has_bbox", "own_page", "mcid", "target_id")
LISTED = ("alt", "actual_text", "scope", "role")
GROUPING = ("Document", "DocumentFragment", "Part", "Art", "Sect", "Div", "NonStruct", "Private")


def renumbered(nodes: DataFrame, sort: str = "sort") -> DataFrame:
    """Positions among siblings anew, from 0, by the sort key."""
    n = F.row_number().over(Window.partitionBy("doc_id", "parent_id").orderBy(sort, "node_id")) - 1
    return nodes.withColumn("ord", n.cast("long")).select(*NODE)


def update_nodes(tree: DataFrame, changes: DataFrame) -> DataFrame:
    """Applies changes (doc_id, node_id, changes map) to elements: an empty string clears, a missing key leaves, an empty role is
    passed over; spans below 1 or unreadable are refused (see ``refused_updates``)."""
    c = tree.join(changes.select("doc_id", "node_id", "changes"), ["doc_id", "node_id"], "left")
    new = lambda k: F.try_element_at("changes", F.lit(k))
    on = F.col("changes").isNotNull() & (F.col("type") == "element")
    for k in LISTED:
        value = F.when(new(k) == "", F.col("role") if k == "role" else None).otherwise(new(k))
        c = c.withColumn(k, F.when(on & new(k).isNotNull(), value).otherwise(F.col(k)))
    span = new("col_span").try_cast("int")
    return c.withColumn("col_span", F.when(on & (span >= 1), span).otherwise(F.col("col_span"))).select(*NODE)


def refused_updates(tree: DataFrame, changes: DataFrame) -> DataFrame:
    """doc_id, node_id, reason of changes that aren't applied."""
    c = changes.join(tree.select("doc_id", "node_id", "type"), ["doc_id", "node_id"], "left")
    span = F.try_element_at("changes", F.lit("col_span"))
    why = F.when(F.col("type").isNull(), "unknown").when(F.col("type") != "element", "not a tag").when(span.isNotNull() & ~F.coalesce(span.try_cast("int") >= 1, F.lit(False)), "bad span")
    return c.withColumn("reason", why).filter("reason IS NOT NULL").select("doc_id", "node_id", "reason")


def known_selection(tree: DataFrame, selection: DataFrame) -> DataFrame:
    """doc_id, node_id, known, refused of a selection's nodes: the unknown ones are told apart and passed over, but where all of a document's are unknown the
    request is refused."""
    s = selection.select("doc_id", "node_id").distinct().join(tree.select("doc_id", "node_id", F.lit(True).alias("found")), ["doc_id", "node_id"], "left")
    known = F.col("found").isNotNull()
    return s.select("doc_id", "node_id", known.alias("known"), (~F.bool_or(known).over(Window.partitionBy("doc_id"))).alias("refused"))


def effective_changes(tree: DataFrame, changes: DataFrame) -> DataFrame:
    """doc_id, node_id, name of each change that alters a value; null and '' are the same."""
    now = F.create_map(*[x for k in LISTED for x in (F.lit(k), F.coalesce(F.col(k), F.lit("")))], F.lit("col_span"), F.col("col_span").cast("string"))
    each = changes.join(tree.select("doc_id", "node_id", now.alias("now")), ["doc_id", "node_id"]).select("doc_id", "node_id", "now", F.explode("changes").alias("name", "value"))
    return each.filter(F.coalesce(F.try_element_at("now", F.col("name")), F.lit("")) != F.coalesce("value", F.lit(""))).select("doc_id", "node_id", "name")


def replace_role(tree: DataFrame, find: str, put: str) -> DataFrame:
    """Elements of exactly one role take another, the hidden wrapper aside."""
    w = t.hidden_wrappers(tree).withColumn("wrapper", F.lit(True))
    hit = (F.col("type") == "element") & (F.col("role") == find) & F.col("wrapper").isNull()
    return tree.join(w, ["doc_id", "node_id"], "left").withColumn("role", F.when(hit, put).otherwise(F.col("role"))).select(*NODE)


def shift_headings(tree: DataFrame, by: int) -> DataFrame:
    level = F.expr("TRY_CAST(substring(role, 2) AS INT)") + by
    return tree.withColumn("role", F.when(numbered_heading(F.col("role")) & level.between(1, 6), F.concat(F.lit("H"), level.cast("string"))).otherwise(F.col("role"))).select(*NODE)


def _spliced(tree: DataFrame, dissolves: str) -> DataFrame:
    """Drops the elements marked in the boolean column; their children take their place under the nearest survivor."""
    gone = tree.filter(dissolves).select("doc_id", F.col("node_id").alias("parent_id"), F.lit(True).alias("up_gone"))
    paged = t.with_page(tree)
    dead = paged.filter(dissolves).select("doc_id", F.col("node_id").alias("anc"))
    moved = paged.filter(f"NOT ({dissolves})").join(gone, ["doc_id", "parent_id"], "left")
    up = moved.filter("up_gone").select("doc_id", "node_id", F.posexplode(F.transform(t.ancestors(), lambda s: s["node_id"])).alias("at", "anc")).join(dead, ["doc_id", "anc"], "left_anti")
    heir = up.groupBy("doc_id", "node_id").agg(F.max_by("anc", "at").alias("heir"))
    # a node whose ancestors' page came from a vanished one keeps it as its own
    out = moved.join(heir, ["doc_id", "node_id"], "left").withColumn("own_page", F.when(F.col("up_gone") & (F.col("type") == "element"), F.coalesce("own_page", "page")).otherwise(F.col("own_page")))
    out = out.withColumn("own_page", F.when(F.col("up_gone") & (F.col("kind") == "content-int"), F.col("page")).otherwise(F.col("own_page"))).withColumn("kind", F.when(F.col("up_gone") & (F.col("kind") == "content-int"), "content-dict").otherwise(F.col("kind")))
    return renumbered(out.withColumn("parent_id", F.coalesce("heir", "parent_id")).withColumn("sort", F.transform("path", lambda s: F.struct(s["ord"], s["node_id"]))))


def flatten(tree: DataFrame, targets: DataFrame) -> DataFrame:
    """Dissolves every organizational tag strictly below a target; the targets themselves stay."""
    chosen = targets.select("doc_id", F.col("node_id").alias("anc"))
    below = tree.filter(organizational(F.col("role"))).select("doc_id", "node_id", F.explode(F.transform(t.ancestors(), lambda s: s["node_id"])).alias("anc")).join(chosen, ["doc_id", "anc"], "left_semi").select("doc_id", "node_id").distinct()
    return _spliced(tree.join(below.withColumn("dissolves", F.lit(True)), ["doc_id", "node_id"], "left").withColumn("dissolves", F.coalesce("dissolves", F.lit(False))), "dissolves")


def delete_nodes(tree: DataFrame, selection: DataFrame) -> DataFrame:
    """Removes the selected nodes with all below them."""
    chosen = selection.select("doc_id", F.col("node_id").alias("anc"))
    gone = tree.select("doc_id", "node_id", F.explode("path.node_id").alias("anc")).join(chosen, ["doc_id", "anc"], "left_semi").select("doc_id", "node_id").distinct()
    return renumbered(tree.join(gone, ["doc_id", "node_id"], "left_anti").withColumn("sort", F.col("ord")))


def join_previous(tree: DataFrame, selection: DataFrame) -> DataFrame:
    """Each selected element joins its previous sibling element, if that isn't selected itself: its children follow that one's, and keep their page where they
    had it from the element that goes."""
    s = t.with_page(tree).join(selection.withColumn("chosen", F.lit(True)), ["doc_id", "node_id"], "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))
    w = Window.partitionBy("doc_id", "parent_id").orderBy("ord", "node_id")
    s = s.withColumn("before", F.lag(F.struct("node_id", "type", "chosen", "page")).over(w))
    pairs = s.filter("chosen AND type = 'element' AND before.type = 'element' AND NOT before.chosen").select("doc_id", F.col("node_id").alias("parent_id"), F.col("before.node_id").alias("into"), F.col("before.page").alias("into_page"))
    kids = t.with_page(tree).join(pairs, ["doc_id", "parent_id"], "left")
    away = F.col("into").isNotNull() & ~F.col("page").eqNullSafe(F.col("into_page"))
    kids = kids.withColumn("own_page", F.when(away, F.coalesce("own_page", "page")).otherwise(F.col("own_page"))).withColumn("kind", F.when(away & (F.col("kind") == "content-int"), "content-dict").otherwise(F.col("kind")))
    kids = kids.withColumn("sort", F.struct(F.col("into").isNotNull(), F.col("ord")))
    kids = kids.withColumn("parent_id", F.coalesce("into", "parent_id"))
    return renumbered(kids.join(pairs.select("doc_id", F.col("parent_id").alias("node_id")), ["doc_id", "node_id"], "left_anti"))


def join_into_first(tree: DataFrame, selection: DataFrame) -> DataFrame:
    """The selected elements of a document join the first of them: their children follow its own, in order, and keep their page where they had
    it from an element that goes. Documents whose selection isn't two or more children of one parent are left alone."""
    s = t.with_page(tree).join(selection.select("doc_id", "node_id").distinct().withColumn("chosen", F.lit(True)), ["doc_id", "node_id"], "left")
    one = s.filter("chosen AND type = 'element' AND depth > 0").groupBy("doc_id").agg(F.min("parent_id").alias("home"), F.max("parent_id").alias("other"), F.count("*").alias("n"), F.min_by(F.struct("node_id", "page"), F.struct("ord", "node_id")).alias("head"))
    one = one.filter("home = other AND n > 1").select("doc_id", F.col("head.node_id").alias("head"), F.col("head.page").alias("head_page"))
    gone = s.filter("chosen AND type = 'element' AND depth > 0").join(one, "doc_id").filter("node_id <> head").select("doc_id", F.col("node_id").alias("parent_id"), F.col("ord").alias("up_ord"), "head", "head_page")
    k = s.join(gone, ["doc_id", "parent_id"], "left")
    away = F.col("head").isNotNull() & ~F.col("page").eqNullSafe(F.col("head_page"))
    k = k.withColumn("own_page", F.when(away, F.coalesce("own_page", "page")).otherwise(F.col("own_page"))).withColumn("kind", F.when(away & (F.col("kind") == "content-int"), "content-dict").otherwise(F.col("kind")))
    k = k.withColumn("sort", F.struct(F.coalesce("up_ord", F.lit(-1)).alias("u"), "ord")).withColumn("parent_id", F.coalesce("head", "parent_id"))
    return renumbered(k.join(gone.select("doc_id", F.col("parent_id").alias("node_id")), ["doc_id", "node_id"], "left_anti"))


def refused_moves(tree: DataFrame, moves: DataFrame) -> DataFrame:
    """doc_id, node_id, reason of moves (doc_id, node_id, target, index) that can't be made; one refusal refuses a document's block."""
    m = moves.join(t.with_page(tree).select("doc_id", "node_id", "kind", "page", "depth"), ["doc_id", "node_id"], "left")
    to = t.with_page(tree).select("doc_id", F.col("node_id").alias("target"), F.col("type").alias("t_type"), F.col("page").alias("t_page"), F.col("path.node_id").alias("up"))
    m = m.join(to, ["doc_id", "target"], "left")
    why = F.when(F.col("kind").isNull(), "unknown").when(F.col("depth") == 0, "the root").when(F.col("t_type").isNull() | ~F.col("t_type").isin("root", "element"), "no such parent")
    why = why.when(F.array_contains("up", F.col("node_id")), "into itself").when((F.col("kind") == "content-int") & ~F.col("page").eqNullSafe(F.col("t_page")), "page would change")
    return m.withColumn("reason", why).filter("reason IS NOT NULL").select("doc_id", "node_id", "reason")


def move_nodes(tree: DataFrame, moves: DataFrame) -> DataFrame:
    """Puts nodes, as a block in document order, below a target at an index, which counts the target's children that stay.

    moves: doc_id, node_id, target, index; one target and index a document. Documents with a refused move are left alone."""
    ok = moves.join(refused_moves(tree, moves).select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "node_id", "target", "index")
    goal = ok.select("doc_id", F.col("target").alias("parent_id"), F.col("index").alias("goal")).distinct()
    s = tree.join(ok, ["doc_id", "node_id"], "left")
    stay = s.filter("target IS NULL").withColumn("i", (F.row_number().over(Window.partitionBy("doc_id", "parent_id").orderBy("ord", "node_id")) - 1).cast("long")).join(goal, ["doc_id", "parent_id"], "left")
    side = F.when(F.col("goal").isNotNull() & (F.col("i") >= F.col("goal")), 2).otherwise(0)
    stay = stay.select(*NODE, F.struct(side.alias("side"), F.col("i").alias("i")).alias("sort"))
    moved = s.filter("target IS NOT NULL").withColumn("parent_id", F.col("target")).select(*NODE, F.struct(F.lit(1).alias("side"), F.col("pre").cast("long").alias("i")).alias("sort"))
    return renumbered(stay.unionByName(moved))


def freed_leaves(tree: DataFrame, selection: DataFrame) -> DataFrame:
    """doc_id, page, mcid of the leaves of deleted nodes, which become artifacts of their pages."""
    chosen = selection.select("doc_id", F.col("node_id").alias("anc"))
    leaf = t.with_page(tree).filter("type = 'content' AND mcid IS NOT NULL AND page IS NOT NULL").select("doc_id", "page", "mcid", F.explode("path.node_id").alias("anc"))
    return leaf.join(chosen, ["doc_id", "anc"], "left_semi").select("doc_id", "page", "mcid").distinct()


def move_to_front(tree: DataFrame, selection: DataFrame) -> DataFrame:
    """The selected nodes, as a block in their order, before their other siblings."""
    s = tree.join(selection.withColumn("chosen", F.lit(True)), ["doc_id", "node_id"], "left")
    return renumbered(s.withColumn("sort", F.struct(F.col("chosen").isNull(), F.col("ord"))))


def wrap_nodes(tree: DataFrame, selection: DataFrame, role: str, new_id: Column) -> DataFrame:
    """Each selected node gets an element of the role around it in its place, with its page."""
    s = t.with_page(tree).join(selection.withColumn("chosen", F.lit(True)), ["doc_id", "node_id"], "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))
    around = s.filter("chosen").select("doc_id", new_id.alias("node_id"), "parent_id", "ord", F.lit("element").alias("type"), F.lit("element").alias("kind"), F.lit(role).alias("role"), *[F.lit(None).cast("string").alias(c) for c in ("alt", "actual_text", "scope")], F.lit(1).alias("col_span"), F.lit(False).alias("has_bbox"), F.col("page").alias("own_page"), F.lit(None).cast("int").alias("mcid"), F.lit(None).cast("long").alias("target_id"))
    inner = s.withColumn("parent_id", F.when(F.col("chosen"), new_id).otherwise(F.col("parent_id"))).withColumn("ord", F.when(F.col("chosen"), 0).otherwise(F.col("ord")).cast("long")).select(*NODE)
    return inner.unionByName(around)


def collapse_to_leaves(tree: DataFrame, targets: DataFrame, role: str) -> DataFrame:
    """Each topmost target takes the role and keeps its leaves as direct children; elements in between go."""
    top = t.top_level(tree.join(targets, ["doc_id", "node_id"], "left_semi")).select("doc_id", F.col("node_id").alias("anc"))
    under = tree.select("doc_id", "node_id", F.explode(F.transform(t.ancestors(), lambda s: s["node_id"])).alias("anc")).join(top, ["doc_id", "anc"]).select("doc_id", "node_id", F.col("anc").alias("into"))
    s = tree.join(under, ["doc_id", "node_id"], "left").join(top.select("doc_id", F.col("anc").alias("node_id"), F.lit(True).alias("is_top")), ["doc_id", "node_id"], "left")
    s = s.filter(F.col("into").isNull() | t.is_content()).withColumn("role", F.when(F.col("is_top"), role).otherwise(F.col("role"))).withColumn("parent_id", F.coalesce("into", "parent_id"))
    return renumbered(s.withColumn("sort", F.transform("path", lambda x: F.struct(x["ord"], x["node_id"]))))


def link_elements(tree: DataFrame, role_map: DataFrame | None = None) -> DataFrame:
    """The tree with ``is_link``: elements of the role Link, or of a custom role that stands for it (role_map: doc_id, custom, standard)."""
    link = (F.col("type") == "element") & (F.col("role") == "Link")
    if role_map is None:
        return tree.withColumn("is_link", F.coalesce(link, F.lit(False)))
    own = role_map.filter("standard = 'Link'").select("doc_id", F.col("custom").alias("role"), F.lit(True).alias("mapped")).distinct()
    return tree.join(own, ["doc_id", "role"], "left").withColumn("is_link", F.coalesce(link | ((F.col("type") == "element") & F.col("mapped")), F.lit(False))).drop("mapped")


def _link_fates(tree: DataFrame, role_map: DataFrame | None) -> DataFrame:
    """The tree without the object leaves of links, with ``fate`` of each node: 'stay', 'vanish', 'dissolve', or the role that a link takes."""
    kept = link_elements(tree.filter("NOT (type = 'object-ref' AND target_id IS NOT NULL)"), role_map)
    held = t.below(kept, ~F.col("is_link")).select("doc_id", F.col("anc").alias("node_id")).distinct().withColumn("holds", F.lit(True))
    s = kept.join(held, ["doc_id", "node_id"], "left")
    up = t.nearest(lambda x: F.lit(True))
    grouping = (up["type"] == "root") | F.coalesce(up["role"].isin(*GROUPING), F.lit(False))
    fate = F.when(~F.col("is_link"), "stay").when(F.col("holds").isNull(), "vanish").when(grouping, "P").when(F.col("actual_text").isNotNull(), "Span").otherwise("dissolve")
    return s.withColumn("fate", fate)


def remove_links(tree: DataFrame, role_map: DataFrame | None = None) -> DataFrame:
    """Object leaves of links go; a link (see ``link_elements``) dissolves into its parent, but becomes P under the root or a grouping parent, else Span where
    it has an actual text; both lose their alternative text. One that holds nothing, but perhaps links of that kind, vanishes. Parents are
    judged by the role they had."""
    s = _link_fates(tree, role_map)
    put = F.col("fate").isin("Span", "P")
    s = s.withColumn("role", F.when(put, F.col("fate")).otherwise(F.col("role"))).withColumn("alt", F.when(~put, F.col("alt")))
    return _spliced(s.filter("fate <> 'vanish'").withColumn("dissolves", F.col("fate") == "dissolve"), "dissolves")


def unlinked_ops(ops: DataFrame) -> DataFrame:
    """The instructions with spans marked Link marked Span; their mcids stay."""
    return ops.withColumn("tag", F.when(F.col("op").isin("BDC", "BMC") & (F.col("tag") == "Link"), "Span").otherwise(F.col("tag")))


def links_removed(tree: DataFrame, annotations: DataFrame, ops: DataFrame, role_map: DataFrame | None = None) -> DataFrame:
    """doc_id, annotations, tags, retagged, spans: what removing the links takes away or changes; documents without any have no row."""
    fates = _link_fates(tree, role_map).filter("is_link").groupBy("doc_id").agg(F.count("*").alias("tags"), F.count_if(F.col("fate").isin("P", "Span")).alias("retagged"))
    notes = annotations.groupBy("doc_id").agg(F.count("*").alias("annotations"))
    spans = ops.filter("op IN ('BDC', 'BMC') AND tag = 'Link'").groupBy("doc_id").agg(F.count("*").alias("spans"))
    every = fates.join(notes, "doc_id", "full").join(spans, "doc_id", "full")
    return every.select("doc_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("annotations", "tags", "retagged", "spans")))


def prune_emptied(tree: DataFrame, candidates: DataFrame) -> DataFrame:
    """Removes candidates, and their ancestors in turn, that hold nothing but such; roots and Documents stay."""
    at = candidates.select("doc_id", F.col("node_id").alias("cand"))
    chain = tree.join(at.withColumnRenamed("cand", "node_id"), ["doc_id", "node_id"], "left_semi").select("doc_id", F.explode("path.node_id").alias("node_id")).distinct()
    may = tree.join(chain, ["doc_id", "node_id"], "left_semi").filter("type = 'element' AND role <> 'Document'").select("doc_id", "node_id")
    other = tree.join(may, ["doc_id", "node_id"], "left_anti").select("doc_id", F.explode("path.node_id").alias("node_id")).distinct()
    gone = may.join(other, ["doc_id", "node_id"], "left_anti")
    return renumbered(tree.join(gone, ["doc_id", "node_id"], "left_anti").withColumn("sort", F.col("ord")))


def scope_tables(tree: DataFrame) -> DataFrame:
    """doc_id, node_id, scope that each header gets: Both, Column and Row where the first row and all leading cells are headers, Column
    where only the first row has them, Row where each row leads with one; other tables are left alone."""
    cell = tree.filter(F.col("role").isin("TH", "TD")).withColumn("row", t.nearest(lambda s: s["role"] == "TR")).withColumn("tab", t.nearest(lambda s: s["role"] == "Table")["node_id"]).filter("row IS NOT NULL AND tab IS NOT NULL")
    cell = cell.select("doc_id", "node_id", "tab", F.col("row.node_id").alias("tr"), F.col("row.ord").alias("tr_ord"), "ord", (F.col("role") == "TH").alias("th"))
    cell = cell.withColumn("r", F.dense_rank().over(Window.partitionBy("doc_id", "tab").orderBy("tr_ord", "tr"))).withColumn("c", F.row_number().over(Window.partitionBy("doc_id", "tab", "tr").orderBy("ord", "node_id")))
    w = cell.groupBy("doc_id", "tab").agg(
        F.bool_and(F.when(F.col("r") == 1, F.col("th"))).alias("first"), F.bool_and(F.when((F.col("r") > 1) & (F.col("c") == 1), F.col("th"))).alias("lead"),
        F.coalesce(F.bool_or(F.when(F.col("r") > 1, F.col("th"))), F.lit(False)).alias("later"), F.bool_and(F.when(F.col("c") == 1, F.col("th"))).alias("every"), F.max("r").alias("rows"))
    mode = F.when(F.col("first") & (F.col("rows") > 1) & F.col("lead"), "both").when(F.col("first") & ~F.col("later"), "column").when(F.col("every"), "row")
    at = cell.filter("th").join(w.withColumn("mode", mode).filter("mode IS NOT NULL"), ["doc_id", "tab"])
    both = F.when((F.col("r") == 1) & (F.col("c") == 1), "Both").when(F.col("r") == 1, "Column").when(F.col("c") == 1, "Row")
    return at.select("doc_id", "node_id", F.when(F.col("mode") == "both", both).when((F.col("mode") == "column") & (F.col("r") == 1), "Column").when((F.col("mode") == "row") & (F.col("c") == 1), "Row").alias("scope")).filter("scope IS NOT NULL")


def content_fingerprint(tree: DataFrame) -> DataFrame:
    """doc_id, fingerprint: 'page:mcid' of all leaves in document order; structure edits leave it as it is."""
    leaf = t.with_page(tree).filter("type = 'content'")
    mark = F.concat(F.coalesce(F.col("page").cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.col("mcid").cast("string"), F.lit("-")))
    return leaf.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", mark.alias("m")))), lambda s: s["m"]), " ").alias("fingerprint"))


def scoped(tree: DataFrame) -> DataFrame:
    """The tree with the scopes of ``scope_tables``."""
    new = scope_tables(tree).withColumnRenamed("scope", "new_scope")
    return tree.join(new, ["doc_id", "node_id"], "left").withColumn("scope", F.coalesce("new_scope", "scope")).select(*NODE)


#: Steps of a script on the tree, by name.
STEPS = {
    "scope_tables": lambda tree, step: scoped(tree),
    "replace_role": lambda tree, step: replace_role(tree, step["find"], step["put"]),
    "shift_headings": lambda tree, step: shift_headings(tree, step["by"]),
    "flatten": lambda tree, step: flatten(tree, tree.filter("depth = 1")),
    "remove_links": lambda tree, step: remove_links(tree, step.get("role_map")),
}


#: Steps of a script on the pages' instructions: given ops and claimed mcids (both with a page), and leaves' images where one is asked for.
PAGE_STEPS = {"repair_orphans", "smartifact"}


def run_script(tree: DataFrame, steps: list[dict]) -> DataFrame:
    """Runs steps on the tree in order, each on the last one's tree (written in between, so plans stay short); the first that fails raises."""
    tree, _, said = run_steps(tree, steps)
    if said and said[-1]["error"]:
        raise ValueError(said[-1]["error"])
    return tree


def run_steps(tree: DataFrame, steps: list[dict], ops: DataFrame | None = None, claimed: DataFrame | None = None, backgrounds: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None, list[dict]]:
    """Runs the steps in order up to the first that fails, in whatever way: the tree and the instructions as the steps before left them, and for each step
    that ran its type and its error (none: null).

    backgrounds: doc_id, page, mcid of leaves that only paint a page's background, which ``smartifact`` takes off the tree; their spans in the
    instructions become artifacts."""
    from . import content

    said = []
    for step in steps:
        name = step.get("type") if isinstance(step, dict) else None
        try:
            new_tree, new_ops = tree, ops
            if name in STEPS:
                new_tree = t.tree_keys(STEPS[name](tree, step))
            elif name == "repair_orphans":
                if ops is None or claimed is None:
                    raise ValueError("the pages' instructions are not given")
                new_ops = written(content.repaired_pages(ops, claimed), "steps")
            elif name == "smartifact":
                if backgrounds is None:
                    raise ValueError("the pages' backgrounds are not given")
                on = t.with_page(tree).filter("type = 'content'").join(backgrounds, ["doc_id", "page", "mcid"], "left_semi").select("doc_id", "node_id")
                new_tree = t.tree_keys(delete_nodes(tree, on))
                new_ops = ops if ops is None else written(as_artifacts(ops, freed_leaves(tree, on)), "steps")
            else:
                raise ValueError(f"no such step: {name}")
            tree, ops = new_tree, new_ops
            said.append({"type": name, "error": None})
        except Exception as wrong:  # noqa: BLE001  a script reports what stopped it, from Spark too, and keeps what was done before
            said.append({"type": name, "error": f"{name}: {wrong}".split("\n")[0]})
            break
    return tree, ops, said


def as_artifacts(ops: DataFrame, freed: DataFrame) -> DataFrame:
    """The instructions with the spans of freed leaves (doc_id, page, mcid) opened as artifacts without an mcid."""
    f = freed.select("doc_id", "page", "mcid").distinct().withColumn("freed", F.lit(True))
    o = ops.join(f, ["doc_id", "page", "mcid"], "left").withColumn("freed", F.col("freed").isNotNull() & (F.col("op") == "BDC"))
    return o.withColumn("tag", F.when(F.col("freed"), "Artifact").otherwise(F.col("tag"))).withColumn("mcid", F.when(~F.col("freed"), F.col("mcid"))).select(*ops.columns)

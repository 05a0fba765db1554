"""Rewrites that build structure: paragraphs, lists, groups, moves by one step, bookmarks, facts of documents.

New elements take ids from a column expression of the caller (``new_id``) or follow the document's largest id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.scratch import written
from . import summary, text as texts
from . import tree as t
from .rewrite import NODE, renumbered
from .text import is_list_label

# fixed values: roles that a paragraph sees through; roles that are never divided
TRANSPARENT = ("L", "Span", "Div", "LI", "Lbl", "LBody")
DISSOLVING = ("L", "Span", "Div", "BlockQuote")
# of tables: roles that fall apart, roles of cells, and what a cell may hold its text in
TABLE_PARTS = ("Table", "THead", "TBody", "TFoot", "TR")
CELLS = ("TH", "TD")
CELL_TEXT = ("P", "Span", "Div")
UNDIVIDED = ("Table", "THead", "TBody", "TFoot", "TR", "TD", "TH", "L", "LI", "Lbl", "LBody", "TOC", "TOCI")
#: Of a grouping: the role of an item, and the roles that stay as they are.
GROUPS = {
    "Table": ("TD", ("TH", "TR")),
    "TR": ("TD", ("TH",)),
    "BlockQuote": ("P", ("P", "H", "H1", "H2", "H3", "H4", "H5", "H6", "L", "Table", "Figure", "Formula", "BlockQuote", "Caption", "Note", "TOC", "Index", "Div", "Sect", "Part", "Art", "NonStruct", "Private")),
}


def undivided(role: Column) -> Column:
    """Whether the role's place in its parent is fixed, so that it can't be split."""
    return F.coalesce(role.isin(*UNDIVIDED), F.lit(False))


def _element(role: str, **columns: Column) -> list[Column]:
    """The columns of a new element; what isn't named is empty."""
    types = {"alt": "string", "actual_text": "string", "scope": "string", "own_page": "int", "mcid": "int", "target_id": "long"}
    fixed = {"type": F.lit("element"), "kind": F.lit("element"), "role": F.lit(role), "col_span": F.lit(1), "has_bbox": F.lit(False)} | {k: F.lit(None).cast(v) for k, v in types.items()}
    return [(fixed | columns)[c].alias(c) for c in NODE]


def _adopted(page: Column) -> dict[str, Column]:
    """Kind and own page of a leaf that moves below an element of another page: a bare one then names its page."""
    away = (F.col("kind") == "content-int") & ~page.eqNullSafe(F.col("page"))
    return {"kind": F.when(away, "content-dict").otherwise(F.col("kind")), "own_page": F.when(away, F.col("page")).otherwise(F.col("own_page"))}


def _item_parts(tree: DataFrame) -> DataFrame:
    """Children of list items: doc_id, node_id, seg, part. A Lbl or LBody that holds only leaves and Spans is simple (part 1); a bare leaf
    has part 0, any other element part 2 and ends a segment."""
    held = t.below(tree, F.lit(True)).filter("anc <> node_id").groupBy("doc_id", F.col("anc").alias("node_id")).agg(F.bool_or((F.col("type") == "element") & (F.col("role") != "Span")).alias("rich"))
    up = t.nearest(lambda s: F.lit(True))
    kid = tree.withColumn("up_role", up["role"]).filter("up_role = 'LI'").join(held, ["doc_id", "node_id"], "left")
    simple = F.col("role").isin("Lbl", "LBody") & ~F.coalesce("rich", F.lit(False))
    kid = kid.withColumn("part", F.when(F.col("type") != "element", 0).when(simple, 1).otherwise(2))
    w = Window.partitionBy("doc_id", "parent_id").orderBy("ord", "node_id").rowsBetween(Window.unboundedPreceding, -1)
    return kid.select("doc_id", "node_id", F.coalesce(F.sum((F.col("part") == 2).cast("long")).over(w), F.lit(0)).alias("seg"), "part")


def _melted(role: Column, before: Column, merges: Column) -> Column:
    """What becomes of an element of a target in the state of its parent: 'open' elements and parts of 'table' fall apart, a 'cell' gives all it holds to one
    paragraph, 'kept' ones stay whole. The target itself has no state before it."""
    table = F.when(role.isin(*TABLE_PARTS), "table").when(role.isin(*CELLS) & merges, "cell").when(role.isin(*CELLS), "open")
    first = F.when(role.isin(*DISSOLVING), "open").otherwise(table)
    inner = F.when(role.isin(*TRANSPARENT), "open").otherwise("kept")
    return F.when(before == "", F.coalesce(first, F.lit("kept"))).when(before.isin("kept", "cell"), before).when(before == "table", F.coalesce(table, inner)).otherwise(inner)


def to_paragraphs(tree: DataFrame, targets: DataFrame, new_id: Column) -> DataFrame:
    """Turns the topmost targets into paragraphs. L, Span, Div, BlockQuote, tables, their parts and cells with content dissolve; a leaf gets a P around it; any other
    element becomes P.

    Inside, transparent roles dissolve as deep as they reach and any other element is kept whole, but a table that is aimed at itself, or by a part of it, falls
    apart into its cells. A cell is one paragraph of all its leaves if it wraps them in P, Span and Div only; else it dissolves like the others. Leaves that
    follow one another below one parent share a P. Of a list item, label and body share one P, which comes after the bare leaves of its segment. new_id: id of
    a P from the id (first) of its first leaf."""
    picked = t.top_level(tree.filter("depth > 0").join(targets.select("doc_id", "node_id").distinct(), ["doc_id", "node_id"], "left_semi"))
    cells = tree.filter(F.col("role").isin(*CELLS)).select("doc_id", F.col("node_id").alias("anc"))
    filled = t.below(tree, F.lit(True)).filter("anc <> node_id").join(cells, ["doc_id", "anc"], "left_semi").groupBy("doc_id", "anc").agg(
        F.bool_or(t.is_content()).alias("filled"), F.bool_or((F.col("type") == "element") & ~F.coalesce(F.col("role").isin(*CELL_TEXT), F.lit(False))).alias("rich"))
    filled = written(filled, "cells")
    picked = written(picked.join(filled.select("doc_id", F.col("anc").alias("node_id"), "filled"), ["doc_id", "node_id"], "left").withColumn(
        "fate", F.when(F.col("type") != "element", "wrap").when(F.col("role").isin(*DISSOLVING, *TABLE_PARTS) | (F.col("role").isin(*CELLS) & F.coalesce("filled", F.lit(False))), "melt").otherwise("P")).select("doc_id", "node_id", "fate"), "picked")
    relabel = picked.filter("fate = 'P'").select("doc_id", "node_id", F.lit("P").alias("new_role"))
    top = picked.filter("fate <> 'P'").select("doc_id", F.col("node_id").alias("top"))
    merging = filled.filter("NOT rich").select("doc_id", "anc")
    s = t.with_page(tree).join(relabel, ["doc_id", "node_id"], "left").withColumn("role", F.coalesce("new_role", "role")).drop("new_role")
    inside = tree.select("doc_id", "node_id", F.explode(F.transform(t.ancestors(True), lambda x: x["node_id"])).alias("top")).join(top, ["doc_id", "top"])
    merged = tree.join(inside.select("doc_id", "node_id"), ["doc_id", "node_id"], "left_semi").select("doc_id", "node_id", F.explode("path.node_id").alias("anc")).join(merging, ["doc_id", "anc"]).groupBy("doc_id", "node_id").agg(F.collect_set("anc").alias("merges"))
    s = s.join(inside, ["doc_id", "node_id"], "left").join(merged, ["doc_id", "node_id"], "left").withColumn("merges", F.coalesce("merges", F.array().cast("array<long>")))

    # states of the elements from the target down to the node; once one is kept, all below it are
    chain = F.filter("path", lambda x: (x["type"] == "element") & (F.array_position(F.col("path.node_id"), x["node_id"]) >= F.array_position(F.col("path.node_id"), F.col("top"))))
    states = F.aggregate(chain, F.array().cast("array<string>"), lambda done, x: F.concat(done, F.array(_melted(x["role"], F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")), F.array_contains("merges", x["node_id"])))))
    s = s.withColumn("chain", F.when(F.col("top").isNotNull(), F.transform(chain, lambda x: x["node_id"]))).withColumn("states", F.when(F.col("top").isNotNull(), states))
    is_element = F.col("type") == "element"
    s = s.withColumn("above", F.when(is_element, F.try_element_at("states", F.lit(-2))).otherwise(F.try_element_at("states", F.lit(-1)))).withColumn("own", F.when(is_element, F.try_element_at("states", F.lit(-1))))
    melts = F.col("above").isin("open", "table")
    s = s.withColumn("free", F.coalesce(melts & (~is_element | (F.col("own") == "kept")) | (~is_element & ((F.col("above") == "cell") | (F.col("node_id") == F.col("top")))), F.lit(False)))
    s = s.withColumn("gone", F.coalesce(is_element & F.col("own").isin("open", "table", "cell"), F.lit(False)))
    s = s.withColumn("cell", F.try_element_at("chain", F.nullif(F.array_position("states", "cell"), F.lit(0)).cast("int"))).withColumn("melted", F.size(F.filter("states", lambda x: x != "kept")))
    s = written(s, "paragraphs")

    # places below list items that dissolve follow segments
    parts = _item_parts(tree).withColumnRenamed("node_id", "step_id")
    steps = s.filter("top IS NOT NULL").select("doc_id", "node_id", F.array_position("path.node_id", F.col("top")).alias("deep"), "melted", F.posexplode("path").alias("i", "step"))
    steps = steps.select("doc_id", "node_id", "deep", "melted", "i", F.col("step.node_id").alias("step_id"), F.col("step.ord").alias("step_ord"), F.col("step.parent_id").alias("item"))
    steps = steps.join(parts, ["doc_id", "step_id"], "left").withColumns({k: F.when((F.col("i") >= F.col("deep")) & (F.col("i") < F.col("deep") + F.col("melted")), F.col(k)) for k in ("seg", "part")})
    place = F.struct(F.coalesce("seg", F.lit(0)).alias("seg"), F.coalesce("part", F.lit(0)).alias("part"), F.when(F.col("part") == 1, 0).otherwise(F.col("step_ord")).cast("long").alias("o"), F.when(F.col("part") == 1, 0).otherwise(F.col("step_id")).cast("long").alias("id"))
    placed = steps.groupBy("doc_id", "node_id").agg(F.array_sort(F.collect_list(F.struct("i", place.alias("p")))).alias("steps"), F.max_by(F.when(F.col("part") == 1, F.struct("i", "item", "seg")), F.when(F.col("part") == 1, F.col("i"))).alias("body"))
    s = s.join(placed, ["doc_id", "node_id"], "left").withColumn("place", F.transform("steps", lambda x: x["p"]))
    plain = F.transform("path", lambda x: F.struct(F.lit(0).cast("long").alias("seg"), F.lit(0).alias("part"), x["ord"].alias("o"), x["node_id"].alias("id")))
    s = s.withColumn("place", F.coalesce("place", plain))

    # leaves that come out: one group a cell, a list item's label and body, or a run of siblings
    loose = s.filter("free AND type <> 'element'")
    runs = tree.withColumn("run", F.coalesce(F.sum((F.col("type") == "element").cast("long")).over(Window.partitionBy("doc_id", "parent_id").orderBy("ord", "node_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("doc_id", "node_id", F.col("run"))
    group = lambda a, b, c: F.struct(a.alias("a"), b.cast("long").alias("b"), F.lit(c).alias("c"))
    loose = loose.join(runs, ["doc_id", "node_id"]).withColumn("grp", F.when(F.col("cell").isNotNull(), group(F.col("cell"), F.lit(0), 2)).when(F.col("body").isNotNull(), group(F.col("body.item"), F.col("body.seg"), 1)).otherwise(group(F.col("parent_id"), F.col("run"), 0)))
    spot = F.when(F.col("cell").isNotNull(), F.slice("place", F.lit(1), F.array_position("path.node_id", F.col("cell")).cast("int"))).when(F.col("body").isNotNull(), F.slice("place", F.lit(1), F.col("body.i") + 1))
    loose = loose.withColumn("spot", F.coalesce(spot, "place"))
    first = Window.partitionBy("doc_id", "top", "grp").orderBy("pre")
    loose = written(loose.withColumn("first", F.first("node_id").over(first)).withColumn("p_page", F.first("page").over(first)).withColumn("spot", F.first("spot").over(first)), "loose")
    home = F.try_element_at(F.filter("path", lambda x: x["node_id"] == F.col("top")), F.lit(1))["parent_id"]
    heads = loose.filter("node_id = first").select("doc_id", F.struct(*_element("P", doc_id=F.col("doc_id"), node_id=new_id, parent_id=home, ord=F.lit(0).cast("long"), own_page=F.col("p_page"))).alias("e"), F.col("spot").alias("sort")).select("e.*", "sort")
    leaves = loose.withColumns({"parent_id": new_id, "sort": F.col("place")} | _adopted(F.col("p_page"))).select(*NODE, "sort")
    rest = s.filter("NOT gone AND NOT (free AND type <> 'element')")
    # a kept element takes the place of the target, with the page it had
    moved = F.col("free")
    rest = rest.withColumn("parent_id", F.when(moved, home).otherwise(F.col("parent_id"))).withColumn("own_page", F.when(moved, F.coalesce("own_page", "page")).otherwise(F.col("own_page")))
    return renumbered(rest.select(*NODE, F.col("place").alias("sort")).unionByName(heads).unionByName(leaves))


def group_nodes(tree: DataFrame, selection: DataFrame, role: str, group_id: Column, item_id: Column) -> DataFrame:
    """Puts the selected siblings (doc_id, node_id) into one new element of the role where the first of them was; documents whose selection
    spans several parents are left alone. Elements take the item role unless their role may stay; leaves get an item around them.
    group_id, item_id: ids from node_id (of the first member, of the leaf)."""
    item, keep = GROUPS[role]
    s = t.with_page(tree).join(selection.select("doc_id", "node_id").distinct().withColumn("chosen", F.lit(True)), ["doc_id", "node_id"], "left")
    one = s.filter("chosen AND depth > 0").groupBy("doc_id").agg(F.min("parent_id").alias("home"), F.max("parent_id").alias("other"), F.min_by(F.struct("node_id", "ord", "page"), F.struct("ord", "node_id")).alias("head")).filter("home = other").select("doc_id", "home", "head")
    s = s.join(one, "doc_id", "left").withColumn("in", F.col("chosen").isNotNull() & F.col("head").isNotNull() & (F.col("depth") > 0))
    s = s.withColumn("gid", F.when(F.col("in"), F.col("head.node_id")))
    box = one.select("doc_id", "home", "head", F.col("head.node_id").alias("node_id")).select(*_element(role, doc_id=F.col("doc_id"), node_id=group_id, parent_id=F.col("home"), ord=F.col("head.ord"), own_page=F.col("head.page")))
    member = s.filter("in AND type = 'element'").withColumn("role", F.when(F.col("role").isin(*keep), F.col("role")).otherwise(item))
    leaf = s.filter("in AND type <> 'element'")
    around = leaf.select(*_element(item, doc_id=F.col("doc_id"), node_id=item_id, parent_id=F.col("gid"), ord=F.col("ord"), own_page=F.col("page")), F.col("gid"))
    ids = one.select("doc_id", F.col("head.node_id").alias("node_id")).select("doc_id", F.col("node_id").alias("gid"), group_id.alias("group_node"))
    under = member.select(*NODE, "gid").unionByName(around).join(ids, ["doc_id", "gid"]).withColumn("parent_id", F.col("group_node")).select(*NODE)
    inner = leaf.withColumn("parent_id", item_id).withColumn("ord", F.lit(0).cast("long")).select(*NODE)
    out = s.filter("NOT in").select(*NODE).unionByName(box).unionByName(under).unionByName(inner)
    return renumbered(out.withColumn("sort", F.col("ord")))


def make_lists(tree: DataFrame, selection: DataFrame, leaf_text: DataFrame, ids: dict[str, Column]) -> DataFrame:
    """Each selected sibling becomes a list item of one new L where the first was, built anew from its leaves: a first leaf that is a marker
    goes into a Lbl, the others into an LBody. Documents whose selection spans several parents are left alone.

    ids: of the list (from the first member), item, label and body (from each member), as expressions of node_id."""
    s = t.with_page(tree).join(selection.select("doc_id", "node_id").distinct().withColumn("chosen", F.lit(True)), ["doc_id", "node_id"], "left")
    one = s.filter("chosen AND depth > 0").groupBy("doc_id").agg(F.min("parent_id").alias("home"), F.max("parent_id").alias("other"), F.min_by(F.struct("node_id", "ord", "page"), F.struct("ord", "node_id")).alias("head")).filter("home = other").select("doc_id", "home", "head")
    member = s.filter("chosen AND depth > 0").join(one.select("doc_id", F.col("head.node_id").alias("head_id")), "doc_id").select("doc_id", "head_id", F.col("node_id").alias("member"), F.col("ord").alias("member_ord"), F.col("page").alias("member_page"))
    under = tree.select("doc_id", "node_id", F.explode("path.node_id").alias("member")).join(member, ["doc_id", "member"])
    leaf = t.with_page(tree).filter(t.is_content()).join(under, ["doc_id", "node_id"]).join(leaf_text.select("doc_id", "node_id", "text"), ["doc_id", "node_id"], "left")
    w = Window.partitionBy("doc_id", "member").orderBy("pre")
    leaf = leaf.withColumn("n", F.row_number().over(w)).withColumn("label", (F.col("n") == 1) & F.coalesce(is_list_label(F.col("text")), F.lit(False)))
    leaf = leaf.withColumn("leaf_id", F.col("node_id")).withColumn("node_id", F.col("member")).withColumn("holder", F.when(F.col("label"), ids["label"]).otherwise(ids["body"])).withColumn("node_id", F.col("leaf_id"))
    head_page = F.first("page").over(Window.partitionBy("doc_id", "holder").orderBy("pre"))
    leaf = written(leaf.withColumn("holder_page", head_page), "items")
    holders = leaf.groupBy("doc_id", "member", "holder", "label").agg(F.first("holder_page").alias("own_page")).withColumn("node_id", F.col("member")).withColumn("li", ids["item"])
    holders = holders.select("label", F.struct(*_element("LBody", doc_id=F.col("doc_id"), node_id=F.col("holder"), parent_id=F.col("li"), ord=F.when(F.col("label"), 0).otherwise(1).cast("long"), own_page=F.col("own_page"))).alias("e")).select("e.*", "label").withColumn("role", F.when(F.col("label"), "Lbl").otherwise("LBody")).drop("label")
    lists = one.select("doc_id", "home", "head", F.col("head.node_id").alias("node_id")).select(*_element("L", doc_id=F.col("doc_id"), node_id=ids["list"], parent_id=F.col("home"), ord=F.col("head.ord"), own_page=F.col("head.page")))
    li = member.withColumn("node_id", F.col("head_id")).withColumn("l", ids["list"]).withColumn("node_id", F.col("member"))
    items = li.select(*_element("LI", doc_id=F.col("doc_id"), node_id=ids["item"], parent_id=F.col("l"), ord=F.col("member_ord"), own_page=F.col("member_page")))
    leaves = leaf.withColumns({"parent_id": F.col("holder"), "ord": F.col("pre").cast("long")} | _adopted(F.col("holder_page"))).select(*NODE)
    rest = tree.join(under.select("doc_id", "node_id").distinct(), ["doc_id", "node_id"], "left_anti").select(*NODE)
    return renumbered(rest.unionByName(lists).unionByName(items).unionByName(holders).unionByName(leaves).withColumn("sort", F.col("ord")))


def insert_paragraphs(tree: DataFrame, anchors: DataFrame, new_id: Column) -> DataFrame:
    """An empty P after each anchor (doc_id, node_id); a document whose anchor is null gets it at the end of its insertion parent."""
    paged = t.with_page(tree).select("doc_id", "node_id", "parent_id", "ord", "page", "depth")
    after = paged.filter("depth > 0").join(anchors.filter("node_id IS NOT NULL").select("doc_id", "node_id").distinct(), ["doc_id", "node_id"], "left_semi")
    p = after.select(*_element("P", doc_id=F.col("doc_id"), node_id=new_id, parent_id=F.col("parent_id"), ord=F.col("ord"), own_page=F.col("page")))
    home = t.insertion_parents(tree).join(anchors.filter("node_id IS NULL").select("doc_id").distinct(), "doc_id", "left_semi")
    end = home.select(*_element("P", doc_id=F.col("doc_id"), node_id=new_id, parent_id=F.col("node_id"), ord=F.lit((1 << 62)).cast("long")))
    return renumbered(tree.select(*NODE, F.struct("ord", F.lit(0).alias("k")).alias("sort")).unionByName(p.unionByName(end).withColumn("sort", F.struct("ord", F.lit(1).alias("k")))))


def move_one_step(tree: DataFrame, selection: DataFrame, by: int) -> DataFrame:
    """Moves each selected node up (-1) or down (1): past its neighbour; at the edge an element comes out beside its parent, and a leaf goes
    into the next tag in that direction (as last child going up, first going down), or out where there is none. Select one of a parent's
    children at most. A bare leaf whose page would change, and children of the root's own level at the edge, stay."""
    w = Window.partitionBy("doc_id", "parent_id").orderBy("ord", "node_id")
    s = t.with_page(tree).withColumn("i", F.row_number().over(w).cast("double"))
    beside = F.lag(F.struct("node_id", "type", "page")).over(w) if by < 0 else F.lead(F.struct("node_id", "type", "page")).over(w)
    s = s.withColumn("beside", beside).join(selection.select("doc_id", "node_id").distinct().withColumn("chosen", F.lit(True)), ["doc_id", "node_id"], "left")
    up = s.select("doc_id", F.col("node_id").alias("parent_id"), F.col("parent_id").alias("g"), F.col("i").alias("up_i"), F.col("beside").alias("aunt"))
    grand = s.select("doc_id", F.col("node_id").alias("g"), F.col("page").alias("g_page"))
    m = s.join(up, ["doc_id", "parent_id"], "left").join(grand, ["doc_id", "g"], "left")
    into = (F.col("type") != "element") & F.coalesce(F.col("aunt.type") == "element", F.lit(False))
    bare = F.col("kind") == "content-int"
    how = F.when(F.col("chosen").isNull(), "stay").when(F.col("beside").isNotNull(), "swap").when(F.col("g").isNull(), "stay")
    how = how.when(into & ~(bare & ~F.col("aunt.page").eqNullSafe(F.col("page"))), "into").when(into, "stay").when(bare & ~F.col("g_page").eqNullSafe(F.col("page")), "stay").otherwise("out")
    m = m.withColumn("how", how)
    sort = F.when(F.col("how") == "swap", F.col("i") + 1.5 * by).when(F.col("how") == "into", -by * 1e18).when(F.col("how") == "out", F.col("up_i") + 0.5 * by).otherwise(F.col("i"))
    return renumbered(m.withColumn("sort", sort).withColumn("parent_id", F.when(F.col("how") == "into", F.col("aunt.node_id")).when(F.col("how") == "out", F.col("g")).otherwise(F.col("parent_id"))))


def list_item_content(tree: DataFrame, items: DataFrame, leaf_text: DataFrame) -> DataFrame:
    """doc_id, item, part ('Lbl', 'LBody'), leaf_id, start: how the leaves below each item (doc_id, node_id) are dealt to its label and body.

    Where the first leaf's text begins with a label and goes on, the leaf is cut: its label is the Lbl, what follows from ``start`` on the
    first of the body. A first leaf that is nothing but a label is the Lbl whole; else all is body. An item without leaves has no rows."""
    own = t.below(tree, F.col("type") == "content").select("doc_id", F.col("anc").alias("item"), F.col("node_id").alias("leaf_id"), "pre").join(items.select("doc_id", F.col("node_id").alias("item")).distinct(), ["doc_id", "item"], "left_semi")
    own = own.join(leaf_text.select("doc_id", F.col("node_id").alias("leaf_id"), "text"), ["doc_id", "leaf_id"], "left")
    own = own.withColumn("no", F.row_number().over(Window.partitionBy("doc_id", "item").orderBy("pre"))).withColumn("cut", F.when(F.col("no") == 1, F.coalesce(texts.leading_label_length(F.col("text")), F.lit(0))).otherwise(0))
    label = (F.col("no") == 1) & F.coalesce(texts.is_list_label(F.col("text")), F.lit(False))
    part = lambda role, start: F.struct(F.lit(role).alias("part"), start.cast("int").alias("start"))
    parts = F.when(F.col("cut") > 0, F.array(part("Lbl", F.lit(0)), part("LBody", F.col("cut")))).when(label, F.array(part("Lbl", F.lit(0)))).otherwise(F.array(part("LBody", F.lit(0))))
    return own.select("doc_id", "item", "leaf_id", F.explode(parts).alias("p")).select("doc_id", "item", "p.part", "leaf_id", "p.start")


def convert_to_items(tree: DataFrame, selection: DataFrame, leaf_text: DataFrame) -> DataFrame:
    """doc_id, item, wrapped, part, leaf_id, start: the topmost selected nodes as list items: elements take the role, leaves get an item around them
    (wrapped), and their leaves are dealt as by ``list_item_content``."""
    top = t.top_level(tree.filter("depth > 0").join(selection, ["doc_id", "node_id"], "left_semi"))
    dealt = list_item_content(tree, top, leaf_text)
    return top.select("doc_id", F.col("node_id").alias("item"), (F.col("type") != "element").alias("wrapped")).join(dealt, ["doc_id", "item"], "left").select("doc_id", "item", "wrapped", "part", "leaf_id", "start")


def generated_bookmarks(tree: DataFrame, leaf_text: DataFrame) -> DataFrame:
    """doc_id, bookmark_id, parent, ord, title, page_no: an outline of the headings, each below the nearest shallower one before it."""
    up = summary.bookmark_parents(tree).withColumnRenamed("parent", "up")
    h = texts.heading_titles(tree, leaf_text).join(up, ["doc_id", "node_id"]).join(t.page_of(tree), ["doc_id", "node_id"]).join(tree.select("doc_id", "node_id", "pre"), ["doc_id", "node_id"])
    n = F.row_number().over(Window.partitionBy("doc_id", "up").orderBy("pre")) - 1
    return h.select("doc_id", F.col("node_id").alias("bookmark_id"), F.col("up").alias("parent"), n.cast("long").alias("ord"), "title", "page_no")


# facts of documents


def update_doc_info(info: DataFrame, changes: DataFrame, names: tuple[str, ...] = ("title", "lang", "author")) -> DataFrame:
    """Facts with changes (doc_id, changes map): an empty string clears, a missing key leaves."""
    c = info.join(changes.select("doc_id", "changes"), "doc_id", "left")
    new = lambda k: F.try_element_at("changes", F.lit(k))
    return c.withColumns({k: F.when(new(k).isNotNull(), F.nullif(new(k), F.lit(""))).otherwise(F.col(k)) for k in names}).select(*info.columns)


def set_tab_order(pages: DataFrame) -> DataFrame:
    """Pages with tab order 'S'; changed where it wasn't."""
    return pages.withColumn("changed", ~F.col("tabs").eqNullSafe("S")).withColumn("tabs", F.lit("S"))


def set_conformance(info: DataFrame, gate: DataFrame) -> DataFrame:
    """pdfua_part '1' for documents without one whose report has no other failure (gate: doc_id, fixable)."""
    c = info.join(gate.filter("fixable").select("doc_id", "fixable"), "doc_id", "left")
    return c.withColumn("pdfua_part", F.when(F.col("fixable") & (F.trim(F.coalesce("pdfua_part", F.lit(""))) == ""), "1").otherwise(F.col("pdfua_part"))).select(*info.columns)


# bookmarks (doc_id, bookmark_id, parent, ord, ...)


def add_bookmarks(outline: DataFrame, new: DataFrame, slots: DataFrame) -> DataFrame:
    """doc_id, bookmark_id, ord: new ones (doc_id, bookmark_id, page) after the slot of their page (doc_id, page, after; null: in front)."""
    at = outline.select("doc_id", F.col("bookmark_id").alias("after"), F.col("ord").alias("after_ord"))
    n = new.join(slots, ["doc_id", "page"], "left").join(at, ["doc_id", "after"], "left").select("doc_id", "bookmark_id", F.struct(F.coalesce("after_ord", F.lit(-(1 << 62))).alias("o"), F.lit(1).alias("k"), "bookmark_id").alias("sort"))
    both = outline.select("doc_id", "bookmark_id", F.struct(F.col("ord").alias("o"), F.lit(0).alias("k"), "bookmark_id").alias("sort")).unionByName(n)
    return both.select("doc_id", "bookmark_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("sort")) - 1).cast("long").alias("ord"))


def rename_bookmarks(outline: DataFrame, titles: DataFrame) -> DataFrame:
    """Titles by key; a blank one is 'Untitled'."""
    new = F.when(F.trim("new_title") == "", "Untitled").otherwise(F.trim("new_title"))
    return outline.join(titles.select("doc_id", "bookmark_id", F.col("title").alias("new_title")), ["doc_id", "bookmark_id"], "left").withColumn("title", F.coalesce(new, "title")).drop("new_title")


def delete_bookmarks(outline: DataFrame, selection: DataFrame, most_levels: int = 1000) -> DataFrame:
    """The outline without the selected bookmarks and all below them, level by level."""
    outline = written(outline, "outline")
    level = written(outline.join(selection.select("doc_id", "bookmark_id"), ["doc_id", "bookmark_id"], "left_semi").select("doc_id", "bookmark_id"), "marks")
    gone, n = level, 0
    while not level.isEmpty():
        if n > most_levels:
            raise ValueError(f"the outline has more than {most_levels} levels, or a cycle")
        level = written(outline.join(level.withColumnRenamed("bookmark_id", "parent"), ["doc_id", "parent"], "left_semi").select("doc_id", "bookmark_id"), "marks")
        gone, n = gone.unionByName(level), n + 1
    return outline.join(gone.distinct(), ["doc_id", "bookmark_id"], "left_anti")

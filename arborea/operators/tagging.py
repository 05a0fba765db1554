"""Tagging a selection of content: leaves, or runs of their text, get one new tag of their own.

Everything about a selection follows from counts along the paths of its leaves: how many of the selected leaves an ancestor holds, how many
leaves it holds in all, and how many nodes lie below it. No subtree is walked, and only documents with a selection are looked at."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.scratch import beside, written
from . import tree as t
from .rewrite import NODE, renumbered
from . import regions, text as texts
from .structure import _adopted, _element, undivided

#: Kinds of leaves that can be tagged.
CONTENT = ("content-int", "content-dict")
Ids = dict[str, Column]


def _stops(tree: DataFrame) -> DataFrame:
    """doc_id, anc: the root and the insertion parent, which are never divided, relabelled or taken away."""
    roots = tree.filter("depth = 0").select("doc_id", F.col("node_id").alias("anc"))
    return roots.unionByName(t.insertion_parents(tree).select("doc_id", F.col("node_id").alias("anc"))).distinct().withColumn("stop", F.lit(True))


def refused_selections(tree: DataFrame, selection: DataFrame) -> DataFrame:
    """doc_id, reason: selections that can't become one tag: 'unknown' nodes, nodes that are 'not content', content of several 'pages'."""
    s = selection.select("doc_id", "node_id").distinct().join(t.with_page(tree).select("doc_id", "node_id", "kind", "page"), ["doc_id", "node_id"], "left")
    g = s.groupBy("doc_id").agg(F.bool_or(F.col("kind").isNull()).alias("unknown"), F.bool_or(~F.col("kind").isin(*CONTENT)).alias("other"), F.countDistinct(F.coalesce("page", F.lit(-1))).alias("pages"))
    why = F.when(F.col("unknown"), "unknown").when(F.col("other"), "not content").when(F.col("pages") > 1, "pages")
    return g.withColumn("reason", why).filter("reason IS NOT NULL").select("doc_id", "reason")


def _facts(tree: DataFrame, selection: DataFrame) -> DataFrame:
    """One row for each document whose selection isn't refused.

    how ('relabel', 'split', 'around'), page, first (the first leaf), up (the leaves' parent, where they have one only), lo and hi (positions of the
    leaves among its children), kids (their number), home (parent of the new tag), at (the child of home that it stands beside)."""
    ok = selection.select("doc_id", "node_id").distinct().join(refused_selections(tree, selection), "doc_id", "left_anti")
    mine = t.with_page(tree).join(ok.select("doc_id").distinct(), "doc_id", "left_semi")
    siblings = Window.partitionBy("doc_id", "parent_id")
    mine = mine.withColumn("i", F.row_number().over(siblings.orderBy("ord", "node_id")) - 1).withColumn("kids", F.count("*").over(siblings))
    leaf = written(mine.join(ok, ["doc_id", "node_id"], "left_semi").select("doc_id", "node_id", "parent_id", "page", "pre", "i", "kids", "path"), "chosen")
    all_of = leaf.groupBy("doc_id").agg(F.count("*").alias("n"), F.first("page").alias("page"), F.min_by(F.struct("node_id", "path"), "pre").alias("head"), F.countDistinct("parent_id").alias("ups"), F.min("parent_id").alias("up"), F.min("i").alias("lo"), F.max("i").alias("hi"), F.min("kids").alias("kids"))
    held = leaf.select("doc_id", F.explode(F.slice("path", 1, F.size("path") - 1)).alias("s")).groupBy("doc_id", F.col("s.node_id").alias("anc")).agg(F.count("*").alias("inside"), F.first("s").alias("s"))
    leaves = mine.filter(t.is_content()).select("doc_id", F.explode("path.node_id").alias("anc")).groupBy("doc_id", "anc").agg(F.count("*").alias("leaves"))
    held = held.join(leaves, ["doc_id", "anc"]).join(_stops(tree), ["doc_id", "anc"], "left")
    held = held.withColumn("free", (F.col("s.type") == "element") & F.col("stop").isNull()).withColumn("consumed", F.col("free") & (F.col("inside") == F.col("leaves")))
    up = held.select("doc_id", F.col("anc").alias("up"), F.col("consumed").alias("up_consumed"), (F.col("free") & ~undivided(F.col("s.role")) & F.col("s.parent_id").isNotNull()).alias("divides"), F.col("s.parent_id").alias("grand"))
    d = all_of.join(up, ["doc_id", "up"])
    # the anchor stands right below the last ancestor of the first leaf that the selection doesn't consume
    kept = held.filter("NOT consumed").groupBy("doc_id").agg(F.collect_set("anc").alias("kept"))
    d = d.join(kept, "doc_id", "left")
    last = F.array_max(F.transform("head.path", lambda s, i: F.when(F.array_contains("kept", s["node_id"]), i + 1)))
    anchor = F.try_element_at("head.path", F.coalesce(last, F.lit(1)) + 1)
    one = F.col("ups") == 1
    how = F.when(one & F.col("up_consumed"), "relabel").when(one & F.col("divides") & (F.col("hi") - F.col("lo") + 1 == F.col("n")), "split").otherwise("around")
    d = d.withColumn("how", how).withColumn("anchor", anchor)
    split = F.col("how") == "split"
    return written(d.select(
        "doc_id", "how", "page", F.col("head.node_id").alias("first"), F.when(F.col("how") != "around", F.col("up")).alias("up"), "lo", "hi", "kids",
        F.when(split, F.col("grand")).when(F.col("how") == "around", F.col("anchor.parent_id")).alias("home"), F.when(split, F.col("up")).when(F.col("how") == "around", F.col("anchor.node_id")).alias("at")), "selections")


def wrap_plan(tree: DataFrame, selection: DataFrame) -> DataFrame:
    """doc_id, how, node_id, first, last: how the selected leaves of a document get a tag of their own.

    'relabel': they are all leaves of their parent, which takes the role. 'split': they are neighbours among the children of an element that may be
    divided; what lies before and after stays in elements beside the new one (first and last: positions among its children). 'around': the
    new tag takes the place of node_id, the highest tag of which they are all leaves, or the first of them. Otherwise the refusal."""
    f = _facts(tree, selection)
    span = lambda c: F.when(F.col("how") == "split", F.col(c)).cast("int")
    found = f.select("doc_id", "how", F.coalesce("up", "at").alias("node_id"), span("lo").alias("first"), span("hi").alias("last"))
    none = F.lit(None)
    return found.unionByName(refused_selections(tree, selection).select("doc_id", F.col("reason").alias("how"), none.cast("long").alias("node_id"), none.cast("int").alias("first"), none.cast("int").alias("last")))


def _filled(leaf: DataFrame, role: str, ids: Ids, keep: Callable[[DataFrame, str], DataFrame] = written) -> tuple[DataFrame, DataFrame | None]:
    """Leaves with the element that holds each (``holder``), and the elements between them and the new tag.

    leaf: NODE, page, pre, into (the tag), item, label. Text in a BlockQuote stands in a P; a list holds items, and an item a Lbl, if it is labelled, and
    an LBody. The Lbl is the item's first leaf."""
    if role == "BlockQuote":
        own = leaf.withColumn("head", F.first("node_id").over(Window.partitionBy("doc_id").orderBy("pre")))
        own = _with_id(own, ids["para"], "head", "holder")
        return own, own.groupBy("doc_id", "holder", "into").agg(F.first("page").alias("page")).select(*_element("P", doc_id=F.col("doc_id"), node_id=F.col("holder"), parent_id=F.col("into"), ord=F.lit(0).cast("long"), own_page=F.col("page")))
    if role not in ("L", "LI"):
        return leaf.withColumn("holder", F.col("into")), None
    item = Window.partitionBy("doc_id", "item")
    own = leaf.withColumn("head", F.first("node_id").over(item.orderBy("pre"))).withColumn("labelled", F.max("label").over(item)).withColumn("at", F.min("pre").over(item).cast("long"))
    for name in ("item", "label", "body"):
        own = _with_id(own, ids[name], "head", f"{name}_id")
    own = own.withColumn("box", F.col("item_id") if role == "L" else F.col("into")).withColumn("is_label", F.col("labelled") & (F.col("node_id") == F.col("head")))
    own = keep(own.withColumn("holder", F.when(F.col("is_label"), F.col("label_id")).otherwise(F.col("body_id"))), "filled")
    first = lambda test: F.min_by(F.when(test, F.col("page")), F.when(test, F.col("pre")))
    each = own.groupBy("doc_id", "item", "into", "box", "label_id", "body_id", "labelled", "at").agg(first(F.col("is_label")).alias("label_page"), first(~F.col("is_label")).alias("body_page"))
    made = lambda df, r, node, up, at, page: df.select(*_element(r, doc_id=F.col("doc_id"), node_id=node, parent_id=up, ord=at.cast("long"), own_page=page))
    # a body without a leaf names no page
    boxes = made(each, "LBody", F.col("body_id"), F.col("box"), F.lit(1), F.col("body_page"))
    boxes = boxes.unionByName(made(each.filter("labelled"), "Lbl", F.col("label_id"), F.col("box"), F.lit(0), F.col("label_page")))
    return own, boxes.unionByName(made(each, "LI", F.col("box"), F.col("into"), F.col("at"), F.lit(None).cast("int"))) if role == "L" else boxes


def _with_id(df: DataFrame, of_node: Column, node: str, name: str) -> DataFrame:
    """``of_node``, an expression of node_id, evaluated for the node in another column."""
    return df.withColumn("__own", F.col("node_id")).withColumn("node_id", F.col(node)).withColumn(name, of_node).withColumn("node_id", F.col("__own")).drop("__own")


def wrap_selection(tree: DataFrame, selection: DataFrame, role: str, ids: Ids) -> DataFrame:
    """The selected leaves (doc_id, node_id; for L and LI also item and label, see ``_filled``) of each document under one tag of the role, as
    ``wrap_plan`` says; refused selections change nothing.

    Of a divided element the first part stays what it was, and a part behind the new tag gets its role and page only. Elements that lose their last child
    go, and so do those above them that then hold nothing. ids: of the new tag ('new'), the part behind ('tail') and what stands
    in between ('para', 'item', 'label', 'body'), as expressions of the first leaf's node_id."""
    f = _facts(tree, selection).withColumnRenamed("page", "new_page")
    f = _with_id(_with_id(f.withColumn("node_id", F.col("first")), ids["new"], "first", "new"), ids["tail"], "first", "tail").drop("node_id")
    f = f.withColumn("into", F.when(F.col("how") == "relabel", F.col("up")).otherwise(F.col("new")))
    marks = selection.select("doc_id", "node_id", *([c for c in ("item", "label") if c in selection.columns])).dropDuplicates(["doc_id", "node_id"])
    for name, kind in (("item", "int"), ("label", "boolean")):
        if name not in marks.columns:
            marks = marks.withColumn(name, F.lit(0 if kind == "int" else False).cast(kind))
    siblings = Window.partitionBy("doc_id", "parent_id").orderBy("ord", "node_id")
    s = t.with_page(tree).withColumn("i", F.row_number().over(siblings) - 1).join(f, "doc_id", "left")
    s = s.join(marks.withColumn("marked", F.lit(True)), ["doc_id", "node_id"], "left").withColumn("chosen", F.col("marked").isNotNull() & F.col("how").isNotNull())
    s = written(s, "wrapping")

    # a tag that loses all it holds goes: everything below it is selected, or goes as well
    leaf = s.filter("chosen")
    chain = leaf.filter("how = 'around'").select("doc_id", "node_id", F.explode(F.slice("path", 1, F.size("path") - 1)).alias("s"))
    tags = chain.filter("s.type = 'element'").select("doc_id", F.col("s.node_id").alias("anc")).distinct().join(_stops(tree), ["doc_id", "anc"], "left_anti")
    tags = written(tags.join(s.select("doc_id", F.col("node_id").alias("anc"), "path", "pre", "last_pre", "home"), ["doc_id", "anc"]), "consumed")
    below = tags.select("doc_id", F.explode(F.slice("path.node_id", 1, F.size("path") - 1)).alias("anc")).unionByName(chain.select("doc_id", F.col("s.node_id").alias("anc"))).groupBy("doc_id", "anc").agg(F.count("*").alias("n"))
    homes = s.filter("node_id = home AND how = 'around'").select("doc_id", F.explode("path.node_id").alias("anc"))
    gone = tags.join(below, ["doc_id", "anc"]).filter("n = last_pre - pre").join(homes, ["doc_id", "anc"], "left_anti").select("doc_id", F.col("anc").alias("node_id"))

    held, between = _filled(leaf.select(*NODE, "page", "pre", "into", "item", "label"), role, ids)
    held = held.withColumn("parent_id", F.col("holder")).withColumn("ord", F.col("pre").cast("long")).select(*NODE)
    split = F.col("how") == "split"
    behind = split & (F.col("parent_id") == F.col("up")) & (F.col("i") > F.col("hi")) & (F.col("lo") > 0)
    rest = s.filter("NOT chosen").join(gone, ["doc_id", "node_id"], "left_anti")
    rest = rest.withColumn("parent_id", F.when(behind, F.col("tail")).otherwise(F.col("parent_id"))).withColumn("role", F.when((F.col("how") == "relabel") & (F.col("node_id") == F.col("up")), role).otherwise(F.col("role")))
    rest = rest.select(*NODE, F.struct("ord", F.lit(0).alias("side")).alias("sort"))
    at = s.filter("node_id = at").select("doc_id", "ord", "role", "own_page", "how", "new", "tail", "home", "lo", "hi", "kids", "new_page")
    beside = F.struct("ord", F.when(split & (F.col("lo") > 0), 1).otherwise(-1).alias("side"))
    new = at.select(F.struct(*_element(role, doc_id=F.col("doc_id"), node_id=F.col("new"), parent_id=F.col("home"), ord=F.col("ord"), own_page=F.col("new_page"))).alias("e"), beside.alias("sort")).select("e.*", "sort")
    tail = at.filter("how = 'split' AND lo > 0 AND hi < kids - 1")
    tail = tail.select(F.struct(*_element("", doc_id=F.col("doc_id"), node_id=F.col("tail"), parent_id=F.col("home"), ord=F.col("ord"), own_page=F.col("own_page")), F.col("role").alias("same")).alias("e"), F.struct("ord", F.lit(2).alias("side")).alias("sort")).select("e.*", "sort").withColumn("role", F.col("same")).drop("same")
    inner = held if between is None else held.unionByName(between)
    return renumbered(rest.unionByName(new).unionByName(tail).unionByName(inner.withColumn("sort", F.struct("ord", F.lit(0).alias("side")))))


# runs of text


def refused_runs(tree: DataFrame, runs: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id, reason: runs that can't be tagged, as by ``refused_selections``, and runs without text ('no text')."""
    r = runs.join(texts.select("doc_id", "node_id", F.length("text").alias("total")), ["doc_id", "node_id"], "left")
    part = (F.coalesce("start", F.lit(0)) > 0) | F.col("end").isNotNull()
    hollow = part & F.coalesce(F.greatest(F.coalesce("start", F.lit(0)), F.lit(0)) >= F.least(F.coalesce("end", "total"), "total"), F.lit(True))
    return refused_selections(tree, runs).unionByName(r.filter(hollow).select("doc_id", F.lit("no text").alias("reason")).distinct()).groupBy("doc_id").agg(F.max("reason").alias("reason"))


def cut_runs(tree: DataFrame, runs: DataFrame, texts: DataFrame, ops: DataFrame | None = None) -> DataFrame:
    """doc_id, leaf, piece (from 0), start, stop, text, node_id, mcid, page, run, label: the pieces of every leaf that has a run.

    runs: doc_id, node_id, start, end (null: to the end), and label (the length of a list marker that the run begins with, null: none). A leaf is
    cut at the ends of its runs and behind their markers, all at once. The first piece keeps the leaf's mcid and node; the others
    get the page's next mcids, beyond those of the tree and of the instructions: as if cut one at a time, the last run first
    and its end before its start, then markers in order. run: the run's number in the document, null where a piece is in none."""
    return _cut(tree, runs.join(refused_runs(tree, runs, texts), "doc_id", "left_anti"), texts, ops)


def _cut(tree: DataFrame, ok: DataFrame, texts: DataFrame, ops: DataFrame | None) -> DataFrame:
    at = t.with_page(tree).select("doc_id", "node_id", "pre", "page", F.col("mcid").alias("old"))
    r = ok.join(at, ["doc_id", "node_id"]).join(texts.select("doc_id", "node_id", "text"), ["doc_id", "node_id"], "left")
    start, total = F.greatest(F.coalesce("start", F.lit(0)), F.lit(0)), F.length("text")
    stop = F.least(F.coalesce("end", total), total)
    r = r.select("doc_id", F.col("node_id").alias("leaf"), "pre", "page", "old", "text", total.alias("total"), start.alias("a"), stop.alias("b"), F.when((F.col("label") > 0) & (start + F.col("label") < stop), start + F.col("label")).alias("c"))
    r = written(r.withColumn("run", F.row_number().over(Window.partitionBy("doc_id").orderBy("pre", "a"))), "runs")
    edge = r.select("doc_id", "leaf", "pre", "page", "total", F.explode(F.array(F.struct(F.lit(0).alias("phase"), F.col("a").alias("x")), F.struct(F.lit(0).alias("phase"), F.col("b").alias("x")), F.struct(F.lit(1).alias("phase"), F.col("c").alias("x")))).alias("e"))
    edge = edge.filter("e.x > 0 AND e.x < total").groupBy("doc_id", "leaf", "pre", "page", F.col("e.x").alias("x")).agg(F.min("e.phase").alias("phase"))
    turn = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("phase", F.when(F.col("phase") == 0, -F.col("pre")).otherwise(F.col("pre")), F.when(F.col("phase") == 0, -F.col("x")).otherwise(F.col("x"))))
    top = tree.join(r.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("node_id").alias("top"))
    fresh = edge.join(t.next_mcid(tree, ops).withColumnRenamed("mcid", "next"), ["doc_id", "page"]).join(top, "doc_id")
    fresh = fresh.select("doc_id", "leaf", "x", (F.col("next") + turn - 1).cast("int").alias("mcid"), (F.col("top") + F.row_number().over(Window.partitionBy("doc_id").orderBy("pre", "x"))).alias("node_id"))
    one = r.dropDuplicates(["doc_id", "leaf"])
    begins = fresh.unionByName(one.select("doc_id", "leaf", F.lit(0).alias("x"), F.col("old").alias("mcid"), F.col("leaf").alias("node_id")))
    order = Window.partitionBy("doc_id", "leaf").orderBy("x")
    p = begins.join(one.select("doc_id", "leaf", "text", "page", "total"), ["doc_id", "leaf"]).withColumn("piece", F.row_number().over(order) - 1).withColumn("stop", F.coalesce(F.lead("x").over(order), "total"))
    within = r.select(F.col("doc_id").alias("of_doc"), F.col("leaf").alias("of_leaf"), "a", "b", "c", "run")
    # a leaf without a known text is one piece, taken whole
    p = p.join(within, F.expr("doc_id = of_doc AND leaf = of_leaf AND (total IS NULL OR a <= x AND stop <= b)"), "left")
    label = F.coalesce(F.col("stop") == F.col("c"), F.lit(False))
    return p.select("doc_id", "leaf", "piece", F.col("x").alias("start"), "stop", F.expr("substring(text, x + 1, stop - x)").alias("text"), "node_id", "mcid", "page", "run", label.alias("label"))


def cut_marks(ops: DataFrame, pieces: DataFrame) -> DataFrame:
    """The pages' instructions (doc_id, page, op_idx, op, tag, mcid, shown) with a span of its own for every piece: a shown text that runs
    over a cut is divided, and before each further piece the span is closed and opened again with the piece's mcid.

    shown: the text that an instruction paints, null for others; texts are counted from the last opening with an mcid on; spans
    without one are no bounds."""
    page = Window.partitionBy("doc_id", "page").orderBy("op_idx")
    o = ops.withColumn("in_mcid", F.last(F.when((F.col("op") == "BDC") & F.col("mcid").isNotNull(), F.struct("mcid", "tag", "op_idx")), ignorenulls=True).over(page))
    o = o.withColumn("off", F.coalesce(F.sum(F.coalesce(F.length("shown"), F.lit(0))).over(Window.partitionBy("doc_id", "page", "in_mcid.op_idx").orderBy("op_idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    first = pieces.filter("piece = 0").select("doc_id", "leaf", F.col("mcid").alias("was"))
    # what a span shows beyond the known text stays with its last piece
    last = F.col("piece") == F.max("piece").over(Window.partitionBy("doc_id", "leaf"))
    cut = pieces.withColumn("stop", F.when(last, 1 << 30).otherwise(F.col("stop")).cast("int")).join(first, ["doc_id", "leaf"]).groupBy("doc_id", "page", "was").agg(F.array_sort(F.collect_list(F.struct("piece", "start", "stop", "mcid"))).alias("pieces"))
    o = o.withColumn("was", F.col("in_mcid.mcid")).join(cut.filter("size(pieces) > 1"), ["doc_id", "page", "was"], "left")
    end = F.col("off") + F.length("shown")
    own = F.filter("pieces", lambda p: (F.greatest(p["start"], F.col("off")) < F.least(p["stop"], end)))
    step = lambda op, tag, mcid, shown: F.struct(op.alias("op"), tag.cast("string").alias("tag"), mcid.cast("int").alias("mcid"), shown.cast("string").alias("shown"))
    none = F.lit(None)
    show = lambda p: step(F.col("op"), none, none, F.substring("shown", F.greatest(p["start"], F.col("off")) - F.col("off") + 1, F.least(p["stop"], end) - F.greatest(p["start"], F.col("off"))))
    opened = lambda p: F.array(step(F.lit("EMC"), none, none, none), step(F.lit("BDC"), F.col("in_mcid.tag"), p["mcid"], none), show(p))
    made = F.flatten(F.transform(own, lambda p: F.when((p["piece"] > 0) & (p["start"] >= F.col("off")), opened(p)).otherwise(F.array(show(p)))))
    steps = F.when(F.col("shown").isNotNull() & (F.size(own) > 0), made).otherwise(F.array(step(F.col("op"), F.col("tag"), F.col("mcid"), F.col("shown"))))
    out = o.select("doc_id", "page", "op_idx", F.posexplode(steps).alias("k", "s"))
    return out.select("doc_id", "page", (F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("op_idx", "k")) - 1).cast("long").alias("op_idx"), "s.op", "s.tag", "s.mcid", "s.shown")


def tag_runs(tree: DataFrame, runs: DataFrame, texts: DataFrame, role: str, ids: Ids, ops: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Runs of text under one new tag of the role in each document: the new version's nodes, and the pieces (``cut_runs``) that were cut for them.

    In a list every run is an item; neighbouring runs with the same ``item`` share one. A run's marker (``label``) becomes the Lbl of its item, in an LI that
    of the first run. A document with a refused run is left alone. A run that covers a whole leaf cuts nothing, so tagging again changes no content."""
    pieces = written(cut_runs(tree, runs, texts, ops), "pieces")
    leaf = pieces.filter("piece > 0").select("doc_id", F.col("leaf").alias("node_id"), F.col("node_id").alias("new_id"), F.col("mcid").alias("new_mcid"), "piece")
    whole = tree.select(*NODE, F.struct("ord", F.lit(0).alias("piece")).alias("sort"))
    more = tree.join(leaf, ["doc_id", "node_id"]).withColumn("node_id", F.col("new_id")).withColumn("mcid", F.col("new_mcid")).select(*NODE, F.struct("ord", "piece").alias("sort"))
    cut = t.tree_keys(renumbered(whole.unionByName(more)))
    order = runs.join(tree.select("doc_id", "node_id", "pre"), ["doc_id", "node_id"]).withColumn("run", F.row_number().over(Window.partitionBy("doc_id").orderBy("pre", F.greatest(F.coalesce("start", F.lit(0)), F.lit(0)))))
    w = Window.partitionBy("doc_id").orderBy("run")
    item = F.col("item") if "item" in runs.columns else F.lit(None).cast("int")
    order = order.withColumn("own", item).withColumn("new", (~F.coalesce(F.col("own") == F.lag("own").over(w), F.lit(False))).cast("int"))
    order = order.select("doc_id", "run", F.sum("new").over(w).cast("int").alias("item"))
    chosen = pieces.filter("run IS NOT NULL").join(order, ["doc_id", "run"])
    if role == "LI":
        chosen = chosen.withColumn("label", F.col("label") & (F.col("item") == 1)).withColumn("item", F.lit(1))
    return wrap_selection(cut, chosen.select("doc_id", "node_id", "item", "label"), role, ids), pieces


def convert_items(tree: DataFrame, selection: DataFrame, leaf_text: DataFrame, ids: Ids, ops: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The topmost selected nodes as list items, and the pieces that were cut for it: the new version's nodes, and rows as of ``cut_runs``.

    An element takes the role LI and keeps of what it holds the leaves alone, a leaf gets an LI around it. The leaves go into an LBody, but the first into a
    Lbl where it is a marker; where its text begins with a marker and goes on, it is cut behind it. A leaf on another page than the first of its Lbl or LBody
    names its own. An item without leaves is left empty. ids: as of ``wrap_selection``, of the first leaf."""
    top = t.top_level(tree.filter("depth > 0").join(selection.select("doc_id", "node_id").distinct(), ["doc_id", "node_id"], "left_semi"))
    top = beside(tree, top.select("doc_id", F.col("node_id").alias("item"), (F.col("type") != "element").alias("bare")), "items")
    under = tree.select("doc_id", "node_id", "type", "pre", F.explode("path.node_id").alias("item")).join(top, ["doc_id", "item"])
    leaf = under.filter("type <> 'element'").join(leaf_text.select("doc_id", "node_id", "text"), ["doc_id", "node_id"], "left")
    first = F.row_number().over(Window.partitionBy("doc_id", "item").orderBy("pre")) == 1
    length = F.coalesce(texts.leading_label_length(F.col("text")), F.lit(0))
    whole = F.coalesce(texts.is_list_label(F.col("text")), F.lit(False))
    leaf = beside(tree, leaf.withColumn("first", first).withColumn("cut", F.when(F.col("first") & (F.col("type") == "content"), length).otherwise(0)).withColumn("whole", F.col("first") & whole), "item_leaves")
    # every item's first leaf is cut by itself: pages don't matter
    runs = leaf.filter("cut > 0").select("doc_id", "node_id", F.lit(0).alias("start"), F.lit(None).cast("int").alias("end"), F.col("cut").cast("int").alias("label"))
    pieces = beside(tree, _cut(tree, runs, leaf_text, ops), "pieces")
    more = pieces.filter("piece > 0").select("doc_id", F.col("leaf").alias("node_id"), F.col("node_id").alias("new_id"), F.col("mcid").alias("new_mcid"))
    s = t.with_page(tree).join(leaf.select("doc_id", "node_id", "item", "cut", "whole"), ["doc_id", "node_id"], "left")
    kept = s.withColumn("label", F.col("whole") | (F.col("cut") > 0)).withColumn("piece", F.lit(0))
    added = s.join(more, ["doc_id", "node_id"]).withColumn("node_id", F.col("new_id")).withColumn("mcid", F.col("new_mcid")).withColumn("label", F.lit(False)).withColumn("piece", F.lit(1)).drop("new_id", "new_mcid")
    each = kept.unionByName(added)
    inside = each.filter("item IS NOT NULL").join(top, ["doc_id", "item"]).withColumn("pre", F.col("pre") * 2 + F.col("piece"))
    head = F.first("node_id").over(Window.partitionBy("doc_id", "item").orderBy("pre"))
    inside = _with_id(inside.withColumn("head", head), ids["new"], "head", "new").withColumn("into", F.when(F.col("bare"), F.col("new")).otherwise(F.col("item")))
    held, between = _filled(inside.select(*NODE, "page", "pre", "into", "item", "label"), "LI", ids, partial(beside, tree))
    holder_page = F.first("page").over(Window.partitionBy("doc_id", "holder").orderBy("pre"))
    held = held.withColumn("holder_page", holder_page).withColumns({"parent_id": F.col("holder"), "ord": F.col("pre").cast("long")} | _adopted(F.col("holder_page"))).select(*NODE)
    # a leaf's own item stands in its place
    around = inside.filter("bare AND node_id = item").select(*_element("LI", doc_id=F.col("doc_id"), node_id=F.col("new"), parent_id=F.col("parent_id"), ord=F.col("ord"), own_page=F.col("page")))
    gone = under.filter("node_id <> item OR bare").select("doc_id", "node_id").distinct()
    rest = tree.join(gone, ["doc_id", "node_id"], "left_anti").join(top.filter("NOT bare").select("doc_id", F.col("item").alias("node_id"), F.lit(True).alias("is_item")), ["doc_id", "node_id"], "left")
    rest = rest.withColumn("role", F.when(F.col("is_item"), "LI").otherwise(F.col("role"))).select(*NODE)
    out = rest.unionByName(around).unionByName(held).unionByName(between)
    return renumbered(out.withColumn("sort", F.col("ord"))), pieces


# figures


def place_figures(tree: DataFrame, figures: DataFrame, anchors: DataFrame, figure_id: Column, leaf_id: Column) -> DataFrame:
    """New Figures (doc_id, figure_id, page, y, target_id) among the children of each document's insertion parent, each before the first that lies on a later page
    or lower on its own; y grows upwards, anchors as of ``node_anchors``. A figure that is an object holds a leaf of it (target_id), any other has a box
    of its own. Figures of one place keep their order. Ids are expressions of figure_id."""
    home = t.insertion_parents(tree).withColumnRenamed("node_id", "parent_id")
    goal = figures.join(home, "doc_id").withColumn("target", F.col("figure_id"))
    at = regions.insertion_index(tree, anchors, goal.select("doc_id", "parent_id", F.col("figure_id").alias("target_id"), "page", "y"))
    f = goal.join(at.select("doc_id", F.col("target_id").alias("figure_id"), "index"), ["doc_id", "figure_id"])
    sort = F.struct(F.col("index").cast("long").alias("i"), F.lit(0).alias("k"), F.col("figure_id").cast("long").alias("n"))
    boxed = _element("Figure", doc_id=F.col("doc_id"), node_id=figure_id, parent_id=F.col("parent_id"), ord=F.lit(0).cast("long"), own_page=F.col("page"), has_bbox=F.col("target_id").isNull())
    new = f.select(F.struct(*boxed).alias("e"), sort.alias("sort")).select("e.*", "sort")
    held = f.filter("target_id IS NOT NULL").select(F.struct(*_element("", doc_id=F.col("doc_id"), node_id=leaf_id, parent_id=figure_id, ord=F.lit(0).cast("long"), type=F.lit("object-ref"), kind=F.lit("content-dict"), own_page=F.col("page"), target_id=F.col("target_id"))).alias("e"), sort.alias("sort")).select("e.*", "sort").withColumn("role", F.lit(None).cast("string"))
    i = F.row_number().over(Window.partitionBy("doc_id", "parent_id").orderBy("ord", "node_id")) - 1
    old = tree.select(*NODE, F.struct(i.cast("long").alias("i"), F.lit(1).alias("k"), F.lit(0).cast("long").alias("n")).alias("sort"))
    return renumbered(old.unionByName(new).unionByName(held))

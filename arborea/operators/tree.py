"""Tree keys and navigation over node rows (doc_id, node_id, parent_id, ord, ...).

After ``tree_keys`` every question about ancestors is a function of ``path`` (no join), and a subtree is the interval
``pre < x <= last_pre`` within a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.scratch import Dealt, drop, written
from .keys import families

#: Nodes of a bucket of documents.
BUCKET = 100_000


#: Children in a row of a tree's table at most, as a parent may have any number.
KIDS = 1000


#: What ``tree_keys`` adds to the nodes.
KEYS = ("path", "depth", "pre", "last_pre", "above_role", "above_type", "above_page", "above_bbox", "leafy")


def _kept() -> dict[str, Column]:
    """What a path entry keeps of each ancestor (the node itself is last) besides its ids: no text, as a node would carry that of all ancestors."""
    return {k: F.col(k) for k in ("ord", "type", "role", "own_page", "has_bbox")} | {"has_actual": F.trim(F.coalesce("actual_text", F.lit(""))) != ""}


def _filled() -> Column:
    return F.coalesce(is_content() | F.col("has_bbox"), F.lit(False))


def _entries(kept: Column) -> Column:
    """Path entries from what a tree's tables keep of them: an entry's parent is the entry before it."""
    ids, known = kept["node_id"], ("ord", "type", "role", "own_page", "has_bbox", "has_actual")
    parents = F.slice(F.concat(F.array(F.lit(None).cast("long")), ids), F.lit(1), F.size(ids))
    return F.arrays_zip(ids.alias("node_id"), parents.alias("parent_id"), *[kept[k].alias(k) for k in known])


def tree_keys(nodes: DataFrame, most_levels: int = 10_000, rows: int | None = None, buckets: int | None = None) -> DataFrame:
    """Adds path, depth (root: 0), pre (depth-first position in the document, from 1) and last_pre (of the last descendant); of the parent its role and type
    (above_role, above_type), the page that a node inherits (above_page), whether an ancestor has a box (above_bbox), and whether the node or one below
    it is a leaf or has a box (leafy).

    The nodes are dealt by document once, and each task numbers the documents that it reads, many at a time, in arrays (see ``keys``); a document too large for
    that goes level by level. The result keeps the dealing, so what reads it by document isn't shuffled. Its table holds rows of a parent, its path and
    some of its children, so that siblings share a path.

    rows: number of nodes, about, where the caller can tell it without making them; else they are written first. buckets: where the nodes
    come from tables dealt by document to so many buckets; they are then neither written nor dealt."""
    spark, columns, given = nodes.sparkSession, nodes.columns, None
    if buckets is None:
        if rows is None:
            nodes = given = written(nodes, "nodes")
            rows = nodes.count()
        buckets = -(-rows // BUCKET) or 1
    own = [c for c in columns if c not in ("doc_id", "node_id", "parent_id", *KEYS)]
    nodes = nodes.select("doc_id", "node_id", "parent_id", *own).filter("doc_id IS NOT NULL AND node_id IS NOT NULL")
    tree = Dealt(spark, "tree", "doc_id", buckets)
    held = tree.add(_in_arrays(nodes, own, most_levels, buckets), dealt=True)
    odd = held.filter("part < 0").select("doc_id")
    if not odd.isEmpty():
        large = _by_level(nodes.join(odd, "doc_id", "left_semi"), own, most_levels, buckets)
        held = tree.add(large).filter("part >= 0")
        drop(large)
    if given is not None:
        drop(given)
    # what siblings share is made once for them all, and only what is asked for is read
    last_of = lambda k: F.try_element_at(F.col(f"up.{k}"), F.lit(-1))
    shared = {"depth": F.coalesce(F.size("up.node_id"), F.lit(0)), "above_role": last_of("role"), "above_type": last_of("type"),
              "above_page": F.try_element_at(F.filter("up.own_page", lambda p: p.isNotNull()), F.lit(-1)), "above_bbox": F.coalesce(F.exists("up.has_bbox", lambda b: b), F.lit(False))}
    # in a step before the children are told apart: Spark evaluates what stands beside an explode after it, for each of them
    flat = held.select("doc_id", "parent_id", F.coalesce(_entries(F.col("up")), F.array()).alias("up"), *[c.alias(k) for k, c in shared.items()], "kids")
    flat = flat.select("doc_id", "parent_id", "up", *shared, F.explode("kids").alias("kid")).select("doc_id", "kid.node_id", *["parent_id" if c == "parent_id" else f"kid.{c}" for c in columns if c in own or c == "parent_id"], "up", "kid.pre", "kid.size", "kid.leafy", *shared)
    path, last = F.concat("up", F.array(F.struct("node_id", "parent_id", *[c.alias(k) for k, c in _kept().items()]))), (F.col("pre") + F.col("size")).cast("int")
    return flat.select(*[c for c in flat.columns if c not in ("up", "size", *KEYS)], path.alias("path"), "depth", "pre", last.alias("last_pre"), *[c for c in KEYS if c in shared and c != "depth"], "leafy")


def _in_arrays(nodes: DataFrame, own: list[str], most_levels: int, buckets: int) -> DataFrame:
    """Rows of a tree's table: doc_id, parent_id, up, part, kids; of a document that is left out one of part -1."""
    known = list(_kept())
    marked = nodes.select("*", *[c.alias(k) for k, c in _kept().items() if k not in own], _filled().alias("leafy"))
    kind = {f.name: f.dataType for f in marked.schema}
    up = T.StructType([T.StructField(k, kind[k]) for k in ("node_id", *known)])
    kid = T.StructType([T.StructField("pre", T.IntegerType()), T.StructField("node_id", kind["node_id"]), T.StructField("size", T.LongType()), T.StructField("leafy", T.BooleanType()), *[T.StructField(c, kind[c]) for c in own]])
    schema = T.StructType([T.StructField("doc_id", kind["doc_id"]), T.StructField("parent_id", kind["parent_id"]), T.StructField("up", T.ArrayType(up)), T.StructField("part", T.IntegerType()), T.StructField("kids", T.ArrayType(kid))])
    return marked.repartition(buckets, "doc_id").sortWithinPartitions("doc_id").mapInArrow(families(to_arrow_schema(schema), own, known, KIDS, most_levels), schema)


def _by_level(nodes: DataFrame, own: list[str], most_levels: int, buckets: int) -> DataFrame:
    """The same for documents of any size: level by level over the nodes that have children, each step joins one level to its parents' paths; leaves meet their
    parent's path at the end. Nothing with a path is shuffled."""
    spark = nodes.sparkSession
    dealt, counts, within, levels = (Dealt(spark, name, "doc_id", buckets) for name in ("nodes", "kids", "inner", "level"))
    nodes = dealt.add(nodes)
    kids = counts.add(nodes.groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("n"), F.max(_filled()).alias("leafy")), "doc_id", "node_id")
    inner = within.add(nodes.join(kids, ["doc_id", "node_id"]).select("doc_id", "node_id", "parent_id", *[c.alias(f"step_{k}") for k, c in _kept().items()], "n", "leafy"), "doc_id", "node_id")
    counts.drop()
    step = F.array(F.struct("node_id", *[F.col(f"step_{k}").alias(k) for k in _kept()]))
    found, n = levels.add(inner.filter("parent_id IS NULL").select("doc_id", "node_id", "n", "leafy", step.alias("path"), F.lit(0).alias("depth")), "doc_id", "node_id"), 0
    while not (level := found.filter(F.col("depth") == n)).isEmpty():
        n += 1
        if n >= most_levels:
            raise ValueError(f"the tree has more than {most_levels} levels, or a cycle")
        up = level.select("doc_id", F.col("node_id").alias("parent_id"), F.col("path").alias("up"))
        found = levels.add(inner.join(up, ["doc_id", "parent_id"]).select("doc_id", "node_id", "n", "leafy", F.concat("up", step).alias("path"), F.lit(n).alias("depth")), "doc_id", "node_id")
    within.drop()
    up = found.select("doc_id", F.col("node_id").alias("parent_id"), F.col("path").alias("up"))
    sizes = found.select("doc_id", F.explode("path.node_id").alias("node_id"), "n", "leafy").groupBy("doc_id", "node_id").agg(F.sum("n").alias("size"), F.max("leafy").alias("leafy"))
    whole = nodes.join(sizes, ["doc_id", "node_id"], "left").join(up, ["doc_id", "parent_id"], "left").filter("up IS NOT NULL OR parent_id IS NULL")
    order = F.concat(F.transform(F.coalesce("up", F.array()), lambda s: F.struct(s["ord"], s["node_id"])), F.array(F.struct("ord", "node_id")))
    keyed = whole.withColumn("pre", F.row_number().over(Window.partitionBy("doc_id").orderBy(order)))
    kids = F.collect_list(F.struct("pre", "node_id", F.coalesce("size", F.lit(0)).alias("size"), (_filled() | F.coalesce("leafy", F.lit(False))).alias("leafy"), *own)).alias("kids")
    held = written(keyed.groupBy("doc_id", "parent_id", "up", (F.col("pre") / KIDS).cast("int").alias("part")).agg(kids), "large")
    for x in (levels, dealt):
        x.drop()
    return held


def ancestors(include_self: bool = False) -> Column:
    """Path entries from the root to the parent, or to the node itself."""
    return F.col("path") if include_self else F.slice("path", 1, F.size("path") - 1)


def nearest(test, include_self: bool = False) -> Column:
    """The nearest ancestor's path entry that passes ``test``; null if none does."""
    return F.try_element_at(F.filter(ancestors(include_self), test), F.lit(-1))


def role_path() -> Column:
    """Roles from the top to the parent, the root excluded; a node without a role shows its type."""
    return F.array_join(F.transform(F.filter(ancestors(), lambda s: s["type"] != "root"), lambda s: F.coalesce(s["role"], s["type"])), " > ")


def index_path() -> Column:
    """Positions from below the root to the node, as text; survives renumbering."""
    return F.array_join(F.transform(F.slice("path", 2, F.size("path")), lambda s: s["ord"].cast("string")), "/")


def resolved_paths(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, key, node_id: the node that each position path (doc_id, key, index_path) names in this version; null where the path is broken."""
    at = tree.select("doc_id", "node_id", index_path().alias("index_path"))
    return wanted.join(at, ["doc_id", "index_path"], "left").select("doc_id", "key", "node_id")


def leaf_ids(tree: DataFrame) -> DataFrame:
    """doc_id, node_id, leaf_ids: content and object leaves below each element in document order, joined by commas."""
    ids = F.array_sort(F.collect_list(F.struct("pre", "node_id")))
    found = below(tree, is_content()).groupBy("doc_id", "anc").agg(F.array_join(F.transform(ids, lambda s: s["node_id"].cast("string")), ",").alias("leaf_ids"))
    return tree.filter("type = 'element'").select("doc_id", "node_id").join(found.withColumnRenamed("anc", "node_id"), ["doc_id", "node_id"])


def resolved_page() -> Column:
    """Page with inheritance: an element's own or its nearest ancestor's; a bare leaf always its parent's; other leaves their own first."""
    above = nearest(lambda s: s["own_page"].isNotNull())["own_page"]
    return F.when(F.col("kind") == "content-int", above).otherwise(F.coalesce("own_page", above))


def with_page(tree: DataFrame) -> DataFrame:
    if "above_page" not in tree.columns:
        return tree.withColumn("page", resolved_page())
    return tree.withColumn("page", F.when(F.col("kind") == "content-int", F.col("above_page")).otherwise(F.coalesce("own_page", "above_page")))


def is_content() -> Column:
    return F.col("type").isin("content", "object-ref")


def hidden_wrappers(tree: DataFrame) -> DataFrame:
    """doc_id, node_id of the root's only child where that is a Document element."""
    top = tree.filter("depth = 1").groupBy("doc_id").agg(F.count("*").alias("n"), F.first("node_id").alias("node_id"), F.first("role").alias("role"), F.first("type").alias("type"))
    return top.filter("n = 1 AND role = 'Document' AND type = 'element'").select("doc_id", "node_id")


def is_hidden_wrapper() -> Column:
    """For trees whose roots have their Document as only child, without a join: see ``hidden_wrappers`` for the general test."""
    return (F.col("depth") == 1) & (F.col("role") == "Document")


def insertion_parents(tree: DataFrame) -> DataFrame:
    """doc_id, node_id: the first child of the root with role Document, else the root."""
    top = tree.filter("depth <= 1")
    return top.groupBy("doc_id").agg(F.coalesce(F.min_by(F.when(F.col("role") == "Document", F.col("node_id")), F.when(F.col("role") == "Document", F.col("ord"))), F.min(F.when(F.col("depth") == 0, F.col("node_id")))).alias("node_id"))


def children(tree: DataFrame) -> DataFrame:
    """doc_id, parent_id, child_ids in order, joined by commas."""
    kids = F.array_sort(F.collect_list(F.struct("ord", "node_id")))
    return tree.filter("parent_id IS NOT NULL").groupBy("doc_id", "parent_id").agg(F.array_join(F.transform(kids, lambda c: c["node_id"].cast("string")), ",").alias("child_ids"))


def top_level(selection: DataFrame) -> DataFrame:
    """Of selected nodes (with path) those without a selected ancestor."""
    chosen = selection.select("doc_id", F.col("node_id").alias("anc"))
    under = selection.select("doc_id", "node_id", F.explode(F.transform(ancestors(), lambda s: s["node_id"])).alias("anc")).join(chosen, ["doc_id", "anc"], "left_semi").select("doc_id", "node_id").distinct()
    return selection.join(under, ["doc_id", "node_id"], "left_anti")


def below(tree: DataFrame, keep: Column) -> DataFrame:
    """One row for each kept node and each of its ancestors (anc, anc_depth), itself included: subtree aggregation by equal keys."""
    return tree.filter(keep).withColumn("step", F.explode("path")).withColumn("anc", F.col("step.node_id"))


def page_of(tree: DataFrame) -> DataFrame:
    """doc_id, node_id, page_no (from 1): own resolved page, else that of the first content leaf below with one."""
    paged = with_page(tree)
    first = below(paged, (F.col("type") == "content") & F.col("page").isNotNull()).groupBy("doc_id", F.col("anc").alias("node_id")).agg(F.min_by("page", "pre").alias("below_page"))
    return paged.join(first, ["doc_id", "node_id"], "left").select("doc_id", "node_id", (F.coalesce("page", "below_page") + 1).alias("page_no"))


def page_ranges(tree: DataFrame) -> DataFrame:
    """doc_id, node_id, first_page, last_page over descendants without children (a node without any counts itself)."""
    ends = below(with_page(tree), F.col("pre") == F.col("last_pre"))
    return ends.groupBy("doc_id", F.col("anc").alias("node_id")).agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"))


def page_breaks(tree: DataFrame) -> DataFrame:
    """doc_id, node_id, mark: 'before' where a node begins after every earlier page, 'through' where a childless row spans pages."""
    rows = tree.join(page_ranges(tree), ["doc_id", "node_id"]).filter("first_page IS NOT NULL AND depth > 0")
    end = F.when(F.col("pre") == F.col("last_pre"), F.col("last_page")).otherwise(F.col("first_page"))
    cursor = F.max(end).over(Window.partitionBy("doc_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1))
    mark = F.when(F.col("first_page") > cursor, "before").when((F.col("pre") == F.col("last_pre")) & (F.col("last_page") > F.col("first_page")), "through")
    return rows.withColumn("mark", mark).filter("mark IS NOT NULL").select("doc_id", "node_id", "mark")


def leaves(tree: DataFrame) -> DataFrame:
    """doc_id, node_id, n_leaves, n_direct: content and object leaves in the subtree, and content children."""
    counted = below(tree, is_content()).groupBy("doc_id", F.col("anc").alias("node_id")).agg(
        F.count("*").alias("n_leaves"), F.count_if((F.col("parent_id") == F.col("anc")) & (F.col("type") == "content")).alias("n_direct"))
    elements = tree.filter("type = 'element'").select("doc_id", "node_id")
    return elements.join(counted, ["doc_id", "node_id"], "left").na.fill(0, ["n_leaves", "n_direct"])


def leaves_through(tree: DataFrame, roles: list[str]) -> DataFrame:
    """doc_id, node_id, n_leaves: leaves reachable through child elements of the roles; null if another element lies in between."""
    other = F.col("type").eqNullSafe("element") & ~F.coalesce(F.col("role").isin(roles), F.lit(False))
    inside = below(tree, F.lit(True)).filter("anc <> node_id").groupBy("doc_id", F.col("anc").alias("node_id")).agg(F.count_if(is_content()).alias("n"), F.bool_or(other).alias("other"))
    return tree.filter("type = 'element'").select("doc_id", "node_id").join(inside, ["doc_id", "node_id"], "left").select(
        "doc_id", "node_id", F.when(F.coalesce("other", F.lit(False)), None).otherwise(F.coalesce("n", F.lit(0))).alias("n_leaves"))


def owners(tree: DataFrame) -> DataFrame:
    """doc_id, page, mcid, owner: parent of each content leaf; of several the last in document order."""
    leaf = with_page(tree).filter("type = 'content' AND mcid IS NOT NULL AND page IS NOT NULL")
    return leaf.groupBy("doc_id", "page", "mcid").agg(F.max_by("parent_id", "pre").alias("owner"))


def content_map(tree: DataFrame) -> DataFrame:
    """doc_id, page, owners: per page the owners by mcid, from 0 to the largest, gaps empty, joined by commas."""
    o = owners(tree).groupBy("doc_id", "page").agg(F.map_from_entries(F.collect_list(F.struct("mcid", "owner"))).alias("m"), F.max("mcid").alias("top"))
    at = F.transform(F.sequence(F.lit(0), "top"), lambda i: F.coalesce(F.try_element_at("m", i).cast("string"), F.lit("")))
    return o.select("doc_id", "page", F.array_join(at, ",").alias("owners"))


def parent_tree(tree: DataFrame, page_keys: DataFrame, object_keys: DataFrame, declared: DataFrame) -> DataFrame:
    """doc_id, key, kind ('page', 'object'), id, owners, next: the reverse map of a version, from a page's or an object's key to what owns it.

    Keys of the version before stay (page_keys: doc_id, page, key; object_keys: doc_id, target_id, key; null: none yet). Pages with content, then objects in
    document order, that have none get the next ones without a gap, from the largest in use or the declared next key (declared: doc_id, next) on,
    whichever is greater. A page that has a key keeps its entry even when nothing on it is tagged any more. An object belongs to its last owner;
    owners of a page are as in ``content_map``. next: the key that comes after."""
    owned = content_map(tree)
    pages = page_keys.filter("key IS NOT NULL").select("doc_id", "page", "key").join(owned, ["doc_id", "page"], "full")
    leaf = tree.filter("type = 'object-ref' AND target_id IS NOT NULL").groupBy("doc_id", "target_id").agg(F.min("pre").alias("at"), F.max_by("parent_id", "pre").alias("owner"))
    objects = leaf.join(object_keys.select("doc_id", "target_id", "key"), ["doc_id", "target_id"], "left")
    every = pages.select("doc_id", "key", F.lit("page").alias("kind"), F.col("page").cast("long").alias("id"), F.coalesce("owners", F.lit("")).alias("owners"), F.struct(F.lit(0).alias("k"), F.col("page").cast("long").alias("at")).alias("turn"))
    every = every.unionByName(objects.select("doc_id", "key", F.lit("object").alias("kind"), F.col("target_id").alias("id"), F.col("owner").cast("string").alias("owners"), F.struct(F.lit(1).alias("k"), F.col("at").cast("long").alias("at")).alias("turn")))
    doc = Window.partitionBy("doc_id")
    first = F.greatest(F.coalesce(F.max("key").over(doc) + 1, F.lit(0)), F.coalesce("next", F.lit(0))).cast("long")
    fresh = F.row_number().over(Window.partitionBy("doc_id", F.col("key").isNull()).orderBy("turn")) - 1
    e = every.join(declared.select("doc_id", "next"), "doc_id", "left").withColumn("first", first)
    return e.select("doc_id", F.coalesce("key", F.col("first") + fresh).cast("long").alias("key"), "kind", "id", "owners", (F.col("first") + F.count_if(F.col("key").isNull()).over(doc)).alias("next"))


def next_mcid(tree: DataFrame, ops: DataFrame | None = None) -> DataFrame:
    """doc_id, page, mcid: one more than the largest in use on the page, by the tree or by the page's instructions (doc_id, page, op, mcid)."""
    used = with_page(tree).filter("type = 'content' AND mcid IS NOT NULL AND page IS NOT NULL").select("doc_id", "page", "mcid")
    if ops is not None:
        used = used.unionByName(ops.filter("op = 'BDC' AND mcid IS NOT NULL").select("doc_id", "page", "mcid"))
    return used.groupBy("doc_id", "page").agg((F.max("mcid") + 1).alias("mcid"))


def signature(tree: DataFrame) -> DataFrame:
    """doc_id, signature: number of nodes and FNV-1a (32 bits) over 'type:role|' in document order."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", F.concat("type", F.lit(":"), F.coalesce("role", F.lit("")), F.lit("|")).alias("t")))), lambda s: s["t"]), "")
    codes = F.transform(F.split("t", ""), lambda c: F.ascii(c).cast("long"))
    hashed = F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: F.pmod(h.bitwiseXOR(c) * F.lit(16777619), F.lit(4294967296)))
    return tree.groupBy("doc_id").agg(F.count("*").alias("n"), text.alias("t")).select("doc_id", F.concat(F.col("n").cast("string"), F.lit("."), F.lower(F.hex(hashed))).alias("signature"))


def shape_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """doc_id, pre: the first position where two versions differ in depth, type, or a leaf's mcid and page; only documents that differ."""
    mark = F.concat_ws(":", "depth", "type", F.when(F.col("type") == "content", F.concat_ws(":", F.coalesce(F.col("mcid").cast("string"), F.lit("")), F.coalesce(F.col("page").cast("string"), F.lit("")))))
    a, b = (with_page(t).select("doc_id", "pre", mark.alias(m)) for t, m in ((before, "a"), (after, "b")))
    return a.join(b, ["doc_id", "pre"], "full").filter("NOT a <=> b").groupBy("doc_id").agg(F.min("pre").alias("pre"))


def content_keys(tree: DataFrame, after: DataFrame) -> DataFrame:
    """doc_id, node_id, found: each element found again in another version by the mcid and page of its first leaf, climbing to its role."""
    first = below(with_page(tree), (F.col("type") == "content") & F.col("mcid").isNotNull() & F.col("page").isNotNull()).groupBy("doc_id", F.col("anc").alias("node_id")).agg(F.min_by(F.struct("page", "mcid"), "pre").alias("key"))
    keyed = tree.filter("type = 'element'").select("doc_id", "node_id", "role").join(first, ["doc_id", "node_id"]).select("doc_id", "node_id", F.col("role").alias("want"), "key.page", "key.mcid")
    own = owners(after).join(after.select("doc_id", F.col("node_id").alias("owner"), "path"), ["doc_id", "owner"])
    at = keyed.join(own, ["doc_id", "page", "mcid"])
    same = F.try_element_at(F.filter("path", lambda s: s["role"] == F.col("want")), F.lit(-1))["node_id"]
    return at.select("doc_id", "node_id", F.coalesce(same, "owner").alias("found"))

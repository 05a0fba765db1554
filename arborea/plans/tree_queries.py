"""Queries of tree navigation, predicates and the audit, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as a
from ..operators import content as c
from ..operators import predicates as p
from ..operators import tree as t
from . import adapters as v
from .adapters import ANNOTATIONS, DOC_INFO, DOC_PAGES, LEAF_OPS, LEAF_TEXT, ORACLE_TREE, OUTLINE, PAGE_CLAIMED, PAGE_OPS, oracle, tree, view
from .content_queries import PAGE_ORPHANS, PAGE_STREAMS
from .registry import register


def on_tree(name, run, sql=None, *extra):
    """A query on the tree. extra: adapters that the SQL names after their variable."""
    more = "".join(f", {n} AS ({oracle(x)})" for n, x in extra)
    register(name, lambda s, d: run(tree(s, d), lambda x: view(s, d, x)), sql and f"WITH RECURSIVE {ORACLE_TREE}{more} {sql}")


HEADS = "('H1', 'H2', 'H3', 'H4', 'H5', 'H6')"

on_tree("tree_preorder", lambda x, _: x.select("doc_id", "node_id", "pre", "depth"), "SELECT doc_id, node_id, pre, depth FROM tree")
on_tree("tree_last_pre", lambda x, _: x.select("doc_id", "node_id", "last_pre"), "SELECT doc_id, node_id, last_pre FROM tree")
on_tree("tree_children", lambda x, _: t.children(x), "SELECT doc_id, parent_id, string_agg(CAST(node_id AS VARCHAR), ',' ORDER BY ord, node_id) AS child_ids FROM nodes WHERE parent_id IS NOT NULL GROUP BY ALL")
on_tree("tree_role_path", lambda x, _: x.filter("depth > 0").select("doc_id", "node_id", t.role_path().alias("role_path")), "SELECT doc_id, node_id, roles AS role_path FROM tree WHERE depth > 0")
on_tree("tree_index_path", lambda x, _: x.select("doc_id", "node_id", t.index_path().alias("index_path")), "SELECT doc_id, node_id, array_to_string(pos[2:], '/') AS index_path FROM tree")
on_tree("tree_ancestors", lambda x, _: x.filter("role = 'LBody'").select("doc_id", "node_id", F.explode("path.node_id").alias("ancestor")), "SELECT doc_id, node_id, unnest(path) AS ancestor FROM tree WHERE role = 'LBody'")
on_tree("top_level_selection", lambda x, _: t.top_level(x.filter("node_id % 3 = 0 AND depth > 0")).select("doc_id", "node_id"),
        "SELECT doc_id, node_id FROM tree s WHERE node_id % 3 = 0 AND depth > 0 AND NOT EXISTS (SELECT 1 FROM anc JOIN tree o ON o.doc_id = anc.doc_id AND o.node_id = anc.anc WHERE anc.doc_id = s.doc_id AND anc.node_id = s.node_id AND anc.anc <> s.node_id AND o.depth > 0 AND o.node_id % 3 = 0)")
on_tree("page_inheritance", lambda x, _: t.with_page(x).select("doc_id", "node_id", "page"), "SELECT doc_id, node_id, page FROM tree")
_PAGE_OF = """page_of AS (SELECT t.doc_id, t.node_id, CAST(coalesce(t.page, f.page) + 1 AS INT) AS page_no FROM tree t LEFT JOIN
 (SELECT doc_id, anc AS node_id, min_by(page, pre) AS page FROM anc WHERE type = 'content' AND page IS NOT NULL GROUP BY ALL) f USING (doc_id, node_id))"""
on_tree("page_of", lambda x, _: t.page_of(x), f", {_PAGE_OF} SELECT * FROM page_of")
_RANGES = "ranges AS (SELECT a.doc_id, anc AS node_id, min(a.page) AS first_page, max(a.page) AS last_page FROM anc a JOIN tree t ON t.doc_id = a.doc_id AND t.node_id = a.node_id AND t.pre = t.last_pre GROUP BY ALL)"
on_tree("page_ranges", lambda x, _: t.page_ranges(x), f", {_RANGES} SELECT * FROM ranges")
on_tree("page_breaks", lambda x, _: t.page_breaks(x), f""", {_RANGES}, r AS (SELECT t.*, first_page, last_page, max(CASE WHEN pre = last_pre THEN last_page ELSE first_page END) OVER (PARTITION BY t.doc_id ORDER BY pre ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cur
 FROM tree t JOIN ranges USING (doc_id, node_id) WHERE first_page IS NOT NULL AND depth > 0), m AS (SELECT doc_id, node_id, CASE WHEN first_page > cur THEN 'before' WHEN pre = last_pre AND last_page > first_page THEN 'through' END AS mark FROM r) SELECT * FROM m WHERE mark IS NOT NULL""")
on_tree("hidden_wrapper", lambda x, _: t.hidden_wrappers(x), "SELECT doc_id, min(node_id) AS node_id FROM tree WHERE depth = 1 GROUP BY doc_id HAVING count(*) = 1 AND min(role) = 'Document' AND min(type) = 'element'")
on_tree("insertion_parent", lambda x, _: t.insertion_parents(x), "SELECT doc_id, coalesce(min_by(node_id, ord) FILTER (role = 'Document'), min(node_id) FILTER (depth = 0)) AS node_id FROM tree WHERE depth <= 1 GROUP BY doc_id")
on_tree("leaf_counts", lambda x, _: t.leaves(x), "SELECT t.doc_id, t.node_id, count(a.node_id) FILTER (a.type IN ('content', 'object-ref')) AS n_leaves, count(a.node_id) FILTER (a.type = 'content' AND a.parent_id = t.node_id) AS n_direct FROM tree t LEFT JOIN anc a ON a.doc_id = t.doc_id AND a.anc = t.node_id WHERE t.type = 'element' GROUP BY ALL")
on_tree("leaves_through_roles", lambda x, _: t.leaves_through(x, ["LBody", "Span"]),
        "SELECT t.doc_id, t.node_id, CASE WHEN count(*) FILTER (c.type = 'element' AND c.role NOT IN ('LBody', 'Span')) > 0 THEN NULL ELSE count(*) FILTER (c.type IN ('content', 'object-ref')) END AS n_leaves FROM tree t LEFT JOIN tree c ON c.doc_id = t.doc_id AND c.pre > t.pre AND c.pre <= t.last_pre WHERE t.type = 'element' GROUP BY ALL")
_OWNERS = "owners AS (SELECT doc_id, page, mcid, max_by(parent_id, pre) AS owner FROM tree WHERE type = 'content' AND mcid IS NOT NULL AND page IS NOT NULL GROUP BY ALL)"
on_tree("content_owner", lambda x, _: t.owners(x), f", {_OWNERS} SELECT * FROM owners")
on_tree("content_map", lambda x, _: t.content_map(x), f""", {_OWNERS}, top AS (SELECT doc_id, page, unnest(range(0, max(mcid) + 1)) AS mcid FROM owners GROUP BY doc_id, page)
 SELECT doc_id, page, string_agg(coalesce(CAST(owner AS VARCHAR), ''), ',' ORDER BY mcid) AS owners FROM top LEFT JOIN owners USING (doc_id, page, mcid) GROUP BY ALL""")
on_tree("next_mcid", lambda x, w: t.next_mcid(x, w(PAGE_OPS)), "SELECT doc_id, page, max(mcid) + 1 AS mcid FROM (SELECT doc_id, page, mcid FROM tree WHERE type = 'content' AND mcid IS NOT NULL AND page IS NOT NULL UNION ALL SELECT doc_id, page, mcid FROM page_ops WHERE op = 'BDC' AND mcid IS NOT NULL) GROUP BY ALL", ("page_ops", PAGE_OPS))
on_tree("tree_signature", lambda x, _: t.signature(x), """, s AS (SELECT doc_id, count(*) AS n, string_agg(type || ':' || coalesce(role, '') || '|', '' ORDER BY pre) AS t FROM tree GROUP BY doc_id)
 SELECT doc_id, n || '.' || printf('%x', list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(t, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) % 4294967296)) AS signature FROM s""")
_SHIFTED = lambda x: x.withColumn("mcid", F.when((F.col("node_id") % 50 == 9), F.col("mcid") + 1).otherwise(F.col("mcid")))
on_tree("shape_difference", lambda x, _: t.shape_difference(x, _SHIFTED(x)), "SELECT doc_id, min(pre) AS pre FROM tree WHERE type = 'content' AND node_id % 50 = 9 AND mcid IS NOT NULL GROUP BY doc_id")
on_tree("content_keys", lambda x, _: t.content_keys(x, x), f""", {_OWNERS}, k AS (SELECT t.doc_id, t.node_id, t.role, f.f.page AS page, f.f.mcid AS mcid FROM tree t JOIN (SELECT a.doc_id, anc AS node_id, min_by({{'page': c.page, 'mcid': c.mcid}}, a.pre) AS f FROM anc a JOIN tree c ON c.doc_id = a.doc_id AND c.node_id = a.node_id
 WHERE c.type = 'content' AND c.page IS NOT NULL AND c.mcid IS NOT NULL GROUP BY ALL) f USING (doc_id, node_id) WHERE t.type = 'element'), o AS (SELECT k.*, owner FROM k JOIN owners USING (doc_id, page, mcid)),
 u AS (SELECT o.doc_id, o.node_id, owner, max_by(s.node_id, s.depth) FILTER (s.role = o.role) AS same FROM o JOIN anc ON anc.doc_id = o.doc_id AND anc.node_id = o.owner JOIN tree s ON s.doc_id = o.doc_id AND s.node_id = anc.anc GROUP BY ALL) SELECT doc_id, node_id, coalesce(same, owner) AS found FROM u""")
on_tree("nearest_ancestor", lambda x, _: x.select("doc_id", "node_id", t.nearest(lambda s: s["role"].isin("L", "Table", "H1"))["node_id"].alias("ancestor")).filter("ancestor IS NOT NULL"),
        "SELECT a.doc_id, a.node_id, max_by(s.node_id, s.depth) AS ancestor FROM anc a JOIN tree s ON s.doc_id = a.doc_id AND s.node_id = a.anc WHERE a.anc <> a.node_id AND s.role IN ('L', 'Table', 'H1') GROUP BY ALL")
on_tree("bbox_targets", lambda x, _: t.below(t.with_page(x), F.col("has_bbox") & F.col("page").isNotNull()).groupBy("doc_id", F.col("anc").alias("node_id")).agg(F.count("*").alias("n")), "SELECT a.doc_id, anc AS node_id, count(*) AS n FROM anc a JOIN tree t ON t.doc_id = a.doc_id AND t.node_id = a.node_id WHERE t.has_bbox AND t.page IS NOT NULL GROUP BY ALL")

# predicates
_CATEGORY = """CASE WHEN role IS NULL THEN 'leaf' WHEN role IN ('H', 'H1', 'H2', 'H3', 'H4', 'H5', 'H6', 'Title') THEN 'heading' WHEN role IN ('Document', 'Part', 'Art', 'Sect', 'Div', 'TOC', 'TOCI', 'Index', 'NonStruct', 'Private') THEN 'container'
 WHEN role IN ('L', 'LI', 'Lbl', 'LBody') THEN 'list' WHEN role IN ('Table', 'TR', 'TH', 'TD', 'THead', 'TBody', 'TFoot') THEN 'table' WHEN role IN ('Figure', 'Formula') THEN 'figure' ELSE 'inline' END"""
on_tree("role_category", lambda x, _: x.select("doc_id", "node_id", p.category(F.col("role")).alias("category")), f"SELECT doc_id, node_id, {_CATEGORY} AS category FROM tree")
on_tree("organizational_tags", lambda x, _: x.filter(p.organizational(F.col("role"))).select("doc_id", "node_id"), "SELECT doc_id, node_id FROM tree WHERE lower(role) IN ('div', 'sect', 'part', 'sub') OR lower(role) LIKE '%span%'")
_FILTERS = f"""matches AS (SELECT doc_id, node_id, path, f.filter AS filter, f.ok AS ok FROM (SELECT t.*, e.node_id IS NOT NULL AS is_empty FROM tree t LEFT JOIN empty e USING (doc_id, node_id)) t,
 LATERAL (VALUES ('all', true), ('flagged', node_id % 5 = 0), ('flagged-substantive', node_id % 10 = 0), ('headings', role IN ('H', 'H1', 'H2', 'H3', 'H4', 'H5', 'H6', 'Title')), ('figures', role = 'Figure'), ('table', role = 'Table'), ('lists', role IN ('L', 'LI')), ('alt-missing', role IN ('Figure', 'Formula') AND coalesce(alt, '') = ''), ('empty', is_empty)) f(filter, ok) WHERE ok AND (f.filter = 'all' OR t.type = 'element' AND t.depth > 1))"""
_FLAGS = lambda x: x.filter("node_id % 5 = 0").select("doc_id", "node_id", F.when(F.expr("node_id % 10 = 0"), 2).otherwise(1).alias("severity"))
on_tree("tag_filters", lambda x, _: p.filters(x, a.empty_nodes(x), _FLAGS(x)).select("doc_id", "node_id", "filter"), f", {_FILTERS} SELECT doc_id, node_id, filter FROM matches")
on_tree("outermost_matches", lambda x, _: p.outermost(p.filters(x, a.empty_nodes(x), _FLAGS(x))), f", {_FILTERS} SELECT doc_id, node_id, filter FROM matches m WHERE filter NOT IN ('figures', 'table', 'lists', 'empty') OR NOT EXISTS (SELECT 1 FROM matches o WHERE o.doc_id = m.doc_id AND o.filter = m.filter AND o.node_id <> m.node_id AND list_contains(m.path, o.node_id))")
on_tree("proofread_selection", lambda x, _: p.proofread(x), """, b AS (SELECT t.*, depth > 1 AND role NOT IN ('Lbl', 'Figure') AND (trim(coalesce(actual_text, '')) <> '' OR EXISTS (SELECT 1 FROM nodes c WHERE c.doc_id = t.doc_id AND c.parent_id = t.node_id AND c.type = 'content')) AS base FROM tree t WHERE type = 'element')
 SELECT doc_id, node_id FROM b WHERE base AND NOT (lower(role) LIKE '%span%' AND EXISTS (SELECT 1 FROM b s WHERE s.doc_id = b.doc_id AND s.node_id <> b.node_id AND list_contains(b.path, s.node_id) AND (s.base OR s.role IN ('Lbl', 'Figure'))))""")
on_tree("find_nodes", lambda x, _: p.find_nodes(x, ["H1", "H2", "Figure"], pages=(2, 5), most=3), f", {_PAGE_OF}, f AS (SELECT doc_id, node_id, role, page_no, row_number() OVER (PARTITION BY doc_id ORDER BY pre) AS n FROM tree JOIN page_of USING (doc_id, node_id) WHERE role IN ('H1', 'H2', 'Figure') AND page_no BETWEEN 2 AND 5) SELECT doc_id, node_id, role, page_no FROM f WHERE n <= 3")
for _name, _levels, _most, _leaves in (("subtree_listing", 3, 300, 0), ("subtree_listing_leaves", 2, 25, 1)):
    # from the top and from one order of each document
    on_tree(_name, lambda x, _, v=(_levels, _most, bool(_leaves)): p.subtree(x, x.filter("depth = 0").select("doc_id", "node_id").unionByName(x.filter("depth = 2").groupBy("doc_id").agg(F.max("node_id").alias("node_id"))), *v),
            f""", starts AS (SELECT doc_id, node_id AS start, pre, last_pre, depth FROM tree t WHERE depth = 0 OR depth = 2 AND node_id = (SELECT max(node_id) FROM tree m WHERE m.doc_id = t.doc_id AND m.depth = 2)),
 kids AS (SELECT doc_id, parent_id AS node_id, count(*) FILTER (type <> 'content') AS n_tags, count(*) FILTER (type = 'content') AS n_leaves FROM tree GROUP BY ALL),
 rows_ AS (SELECT s.doc_id, start, t.node_id, t.pre, t.last_pre, t.depth - s.depth AS level, coalesce(n_tags, 0) AS n_tags, coalesce(n_leaves, 0) AS n_leaves, row_number() OVER (PARTITION BY s.doc_id, start ORDER BY t.pre) AS k FROM starts s JOIN tree t ON t.doc_id = s.doc_id AND t.pre BETWEEN s.pre AND s.last_pre AND t.type <> 'content' LEFT JOIN kids ON kids.doc_id = t.doc_id AND kids.node_id = t.node_id),
 spent AS (SELECT doc_id, start, CAST(0 AS BIGINT) AS k, CAST({_most} AS BIGINT) AS budget, 0 AS upto, false AS shown, false AS cut FROM starts UNION ALL SELECT r.doc_id, r.start, r.k, CASE WHEN r.pre <= s.upto THEN s.budget ELSE s.budget - 1 - {_leaves} * r.n_leaves END,
   CASE WHEN r.pre > s.upto AND r.n_tags > 0 AND (r.level >= {_levels} OR s.budget - 1 - {_leaves} * r.n_leaves < r.n_tags) THEN r.last_pre ELSE s.upto END, r.pre > s.upto, r.pre > s.upto AND r.n_tags > 0 AND (r.level >= {_levels} OR s.budget - 1 - {_leaves} * r.n_leaves < r.n_tags) FROM spent s JOIN rows_ r ON r.doc_id = s.doc_id AND r.start = s.start AND r.k = s.k + 1)
 SELECT r.doc_id, r.start, r.node_id, CAST(level AS INT) AS level, n_leaves AS content_leaves, CASE WHEN cut THEN n_tags END AS child_count, cut AS truncated FROM spent s JOIN rows_ r USING (doc_id, start, k) WHERE shown""")
on_tree("attributes", lambda x, _: p.attributes(x), "SELECT doc_id, node_id, a AS attributes FROM (SELECT doc_id, node_id, concat_ws(';', CASE WHEN alt <> '' THEN 'alt=' || alt END, CASE WHEN actual_text <> '' THEN 'actual_text=' || actual_text END, CASE WHEN scope <> '' THEN 'scope=' || scope END) AS a FROM tree WHERE type = 'element') WHERE a <> ''")
_DIRECT = "direct AS (SELECT t.doc_id, parent_id AS node_id, string_agg(text, ' ' ORDER BY pre) AS text FROM tree t JOIN leaf_text l USING (doc_id, node_id) WHERE t.type = 'content' AND text <> '' GROUP BY ALL)"
on_tree("fix_candidates", lambda x, w: p.fix_candidates(x, w(LEAF_TEXT)), f", {_DIRECT}, c AS (SELECT t.doc_id, t.node_id, CASE WHEN trim(coalesce(actual_text, '')) <> '' THEN actual_text ELSE d.text END AS text FROM tree t LEFT JOIN direct d USING (doc_id, node_id) WHERE type = 'element' AND role NOT IN ('Table', 'Document')) SELECT * FROM c WHERE trim(coalesce(text, '')) <> ''", ("leaf_text", LEAF_TEXT))

# audit
_F = "doc_id, check_id, CAST(node_id AS BIGINT) AS node_id, CAST(page AS INT) AS page, CAST(detail AS VARCHAR) AS detail"
_SKIPS = f"skips AS (SELECT doc_id, 'heading-levels' AS check_id, node_id, NULL AS page, seen AS detail FROM (SELECT *, coalesce(max(level) OVER (PARTITION BY doc_id ORDER BY pre ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM (SELECT *, CAST(substr(role, 2) AS INT) AS level FROM tree WHERE role IN {HEADS})) WHERE level > seen + 1)"
_EMPTY_HEADS = f"empty_heads AS (SELECT doc_id, 'heading-content' AS check_id, node_id, NULL AS page, '' AS detail FROM empty WHERE role IN {HEADS})"
_EMPTY_TAGS = f"named AS (SELECT * FROM empty WHERE role NOT IN ('TD', 'TH') AND role NOT IN {HEADS} AND depth > 1), empty_tags AS (SELECT doc_id, 'tag-content' AS check_id, node_id, NULL AS page, '' AS detail FROM named n WHERE NOT EXISTS (SELECT 1 FROM named o WHERE o.doc_id = n.doc_id AND o.node_id <> n.node_id AND list_contains(n.path, o.node_id)))"
_NESTING = """nests AS (SELECT doc_id, CASE WHEN role = 'LI' AND up <> 'L' THEN 'list-nesting' WHEN role IN ('Lbl', 'LBody') AND up <> 'LI' THEN 'list-nesting' WHEN role = 'TR' AND up NOT IN ('Table', 'THead', 'TBody', 'TFoot') THEN 'row-parent' WHEN role IN ('TH', 'TD') AND up <> 'TR' THEN 'cell-parent' END AS check_id, node_id, NULL AS page, up AS detail
 FROM (SELECT *, coalesce(up_role, 'untagged content') AS up FROM tree WHERE type = 'element') WHERE check_id IS NOT NULL)"""
_ITEMS = """kids AS (SELECT l.doc_id, l.node_id AS li, c.* EXCLUDE (doc_id) FROM tree l LEFT JOIN tree c ON c.doc_id = l.doc_id AND c.parent_id = l.node_id WHERE l.role = 'LI'),
 li AS (SELECT doc_id, li, count(*) FILTER (role = 'LBody') AS body, count(*) FILTER (role = 'Lbl') AS label, count(*) FILTER (type IN ('content', 'object-ref')) AS loose FROM kids GROUP BY ALL),
 items AS (SELECT doc_id, 'list-contents' AS check_id, li AS node_id, NULL AS page, CASE WHEN label > 0 THEN 'label but no body' ELSE 'no body' END AS detail FROM li WHERE body = 0
  UNION ALL SELECT doc_id, 'list-contents', li, NULL, loose || ' directly' FROM li WHERE loose > 0 UNION ALL SELECT doc_id, 'list-contents', node_id, NULL, 'stray ' || role FROM kids WHERE type = 'element' AND role NOT IN ('Lbl', 'LBody'))"""
_WIDTHS = """trs AS (SELECT a.doc_id, a.node_id AS row_id, max_by(s.node_id, s.depth) AS node_id FROM anc a JOIN tree r ON r.doc_id = a.doc_id AND r.node_id = a.node_id AND r.role = 'TR' JOIN tree s ON s.doc_id = a.doc_id AND s.node_id = a.anc AND s.role = 'Table' GROUP BY ALL),
 wide AS (SELECT doc_id, parent_id AS row_id, sum(col_span) AS width FROM tree WHERE role IN ('TH', 'TD') GROUP BY ALL),
 widths AS (SELECT trs.doc_id, node_id, count(*) AS n_rows, coalesce(array_to_string(list_sort(list_distinct(list(width) FILTER (width > 0))), ','), '') AS widths FROM trs LEFT JOIN wide USING (doc_id, row_id) GROUP BY trs.doc_id, node_id)"""
_TABLES = f"""{_WIDTHS}, ragged AS (SELECT doc_id, 'table-regularity' AS check_id, node_id, NULL AS page, widths AS detail FROM widths WHERE n_rows >= 2 AND widths LIKE '%,%'),
 cells AS (SELECT t.*, r.node_id AS tab FROM tree t JOIN trs r ON r.doc_id = t.doc_id AND r.row_id = t.parent_id WHERE role IN ('TH', 'TD')),
 heads AS (SELECT t.doc_id, 'table-headers' AS check_id, t.node_id, NULL AS page, 'no header' AS detail FROM tree t LEFT JOIN (SELECT DISTINCT doc_id, tab AS node_id, true AS headed FROM cells WHERE role = 'TH') h ON h.doc_id = t.doc_id AND h.node_id = t.node_id WHERE t.role = 'Table' AND headed IS NULL
  UNION ALL SELECT doc_id, 'table-headers', node_id, NULL, 'no scope' FROM cells WHERE role = 'TH' AND trim(coalesce(scope, '')) = '')"""
_ALT = "alts AS (SELECT doc_id, 'alt-text' AS check_id, node_id, NULL AS page, '' AS detail FROM tree WHERE role IN ('Figure', 'Formula') AND trim(coalesce(alt, '')) = '')"
_LINKS = """tagged AS (SELECT a.doc_id, annot_id, a.page, contents, l.link, l.link_alt FROM annotations a LEFT JOIN (SELECT o.doc_id, o.target_id AS annot_id, min_by(p.node_id, o.pre) AS link, min_by(p.alt, o.pre) AS link_alt FROM tree o JOIN tree p ON p.doc_id = o.doc_id AND p.node_id = o.parent_id
  WHERE o.type = 'object-ref' AND p.role = 'Link' GROUP BY ALL) l USING (doc_id, annot_id)),
 linked AS (SELECT doc_id, 'links-tagged' AS check_id, link AS node_id, page + 1 AS page, '' AS detail FROM tagged WHERE link IS NULL UNION ALL SELECT doc_id, 'links-described', link, page + 1, '' FROM tagged WHERE trim(coalesce(contents, '')) = '' AND trim(coalesce(link_alt, '')) = '')"""
_TABS = "tabs AS (SELECT doc_id, 'tab-order' AS check_id, NULL AS node_id, page + 1 AS page, '' AS detail FROM pages_ WHERE coalesce(tabs, '') <> 'S')"
_ALL = f", {_SKIPS}, {_EMPTY_HEADS}, {_EMPTY_TAGS}, {_NESTING}, {_ITEMS}, {_TABLES}, {_ALT}, {_LINKS}, {_TABS}, found AS (" + " UNION ALL ".join(f"SELECT {_F} FROM {x}" for x in ("skips", "empty_heads", "empty_tags", "nests", "items", "ragged", "heads", "alts", "linked", "tabs")) + ")"
_PARTS = (("annotations", ANNOTATIONS), ("pages_", DOC_PAGES))

on_tree("heading_skips", lambda x, _: a.heading_skips(x), f", {_SKIPS} SELECT {_F} FROM skips")
on_tree("empty_nodes", lambda x, _: a.empty_nodes(x).select("doc_id", "node_id"), "SELECT doc_id, node_id FROM empty")
on_tree("empty_headings", lambda x, _: a.empty_headings(a.empty_nodes(x)), f", {_EMPTY_HEADS} SELECT {_F} FROM empty_heads")
on_tree("empty_tags", lambda x, _: a.empty_tags(x, a.empty_nodes(x)), f", {_EMPTY_TAGS} SELECT {_F} FROM empty_tags")
on_tree("parent_role_rules", lambda x, _: a.nesting(x), f", {_NESTING} SELECT {_F} FROM nests")
on_tree("list_item_contents", lambda x, _: a.list_items(x), f", {_ITEMS} SELECT {_F} FROM items")
on_tree("row_widths", lambda x, _: a.row_widths(x), f", {_WIDTHS} SELECT * FROM widths")
on_tree("table_regularity", lambda x, _: a.irregular_tables(x), f", {_TABLES} SELECT {_F} FROM ragged")
on_tree("table_headers", lambda x, _: a.table_headers(x), f", {_TABLES} SELECT {_F} FROM heads")
on_tree("alt_texts", lambda x, _: a.alt_texts(x), f", {_ALT} SELECT {_F} FROM alts")
on_tree("annotation_links", lambda x, w: a.link_tags(x, w(ANNOTATIONS)), f", {_LINKS} SELECT * FROM tagged", _PARTS[0])
on_tree("links_audit", lambda x, w: a.links(a.link_tags(x, w(ANNOTATIONS))), f", {_LINKS} SELECT {_F} FROM linked", _PARTS[0])
on_tree("tab_order", lambda x, w: a.tab_order(w(DOC_PAGES)), f", {_TABS} SELECT {_F} FROM tabs", _PARTS[1])
_DOC = """docs AS (SELECT d.*, (SELECT count(*) FROM outline_ o WHERE o.doc_id = d.doc_id) AS n_marks, d.doc_id IN (SELECT doc_id FROM nodes) AS tree, d.doc_id IN (SELECT doc_id FROM nodes WHERE role = 'H1') AS h1 FROM info d),
 rules AS (SELECT doc_id, r.check_id AS check_id, r.status AS status FROM docs, LATERAL (VALUES ('tagged', CASE WHEN tree AND coalesce(marked_tagged, false) THEN 'pass' ELSE 'fail' END), ('title', CASE WHEN trim(coalesce(title, '')) <> '' THEN 'pass' ELSE 'fail' END),
  ('language', CASE WHEN trim(coalesce(lang, '')) <> '' THEN 'pass' ELSE 'fail' END), ('permission', CASE WHEN coalesce(accessibility_permission, true) THEN 'pass' ELSE 'fail' END), ('identifier', CASE WHEN NOT has_facts THEN 'na' WHEN trim(coalesce(pdfua_part, '')) <> '' THEN 'pass' ELSE 'fail' END),
  ('bookmarks', CASE WHEN n_marks > 0 THEN 'pass' WHEN page_count >= 20 THEN 'warn' ELSE 'na' END), ('h1', CASE WHEN NOT tree THEN NULL WHEN h1 THEN 'pass' ELSE 'fail' END), ('structure', CASE WHEN NOT tree THEN 'na' END)) r(check_id, status) WHERE r.status IS NOT NULL)"""
_INFO = (("info", DOC_INFO), ("outline_", OUTLINE))
on_tree("document_rules", lambda x, w: a.document_rules(w(DOC_INFO), w(OUTLINE), x), f", {_DOC} SELECT * FROM rules", *_INFO)
on_tree("audit_instances", lambda x, w: a.instances(x, w(DOC_PAGES), w(ANNOTATIONS), a.empty_nodes(x)), f"{_ALL} SELECT * FROM found", *_PARTS)
_FIGURES = """figure_mcids AS (SELECT t.doc_id, t.page, t.mcid, min_by(f.node_id, f.pre) AS node_id FROM tree t JOIN anc a ON a.doc_id = t.doc_id AND a.node_id = t.node_id JOIN tree f ON f.doc_id = a.doc_id AND f.node_id = a.anc AND f.role IN ('Figure', 'Formula') WHERE t.type = 'content' AND t.mcid IS NOT NULL AND t.page IS NOT NULL GROUP BY ALL),
 figure_text AS (SELECT DISTINCT doc_id, 'figure-text' AS check_id, node_id, NULL AS page, '' AS detail FROM figure_mcids JOIN shown USING (doc_id, page, mcid))"""
_SHOWN = f"shown AS (SELECT DISTINCT doc_id, page, o.mcid FROM ({oracle(LEAF_OPS)}) t JOIN (SELECT doc_id, page, op_idx + 1 AS op_idx, mcid FROM ({oracle(LEAF_OPS)})) o USING (doc_id, page, op_idx) WHERE visible)"
_STREAMS = f", {PAGE_STREAMS}, {PAGE_ORPHANS}, {_SHOWN}, {_FIGURES}"
_REPORT = f"""{_ALL}, {_DOC}{_STREAMS}, every_found AS (SELECT doc_id, check_id FROM found UNION ALL SELECT doc_id, check_id FROM figure_text),
 counted AS (SELECT doc_id, check_id, count(*) AS n FROM every_found GROUP BY ALL UNION ALL SELECT doc_id, 'orphaned-content', total FROM orphaned),
 flags AS (SELECT doc_id, has_facts, doc_id IN (SELECT doc_id FROM nodes) AS treed, doc_id IN (SELECT doc_id FROM annotations) AS linked FROM info),
 due AS (SELECT doc_id, c.check_id AS check_id, CASE WHEN c.apply THEN c.bad ELSE 'na' END AS bad, c.apply OR c.show_na AS shown_ FROM flags, LATERAL (VALUES ('tab-order', 'fail', has_facts, true),
  ('heading-levels', 'fail', treed, false), ('heading-content', 'fail', treed, false), ('tag-content', 'fail', treed, false), ('list-nesting', 'fail', treed, false), ('list-contents', 'fail', treed, false), ('row-parent', 'fail', treed, false), ('cell-parent', 'fail', treed, false),
  ('table-regularity', 'warn', treed, false), ('table-headers', 'fail', treed, false), ('alt-text', 'fail', treed, false), ('links', 'na', treed AND NOT (has_facts AND linked), false), ('links-tagged', 'fail', treed AND has_facts AND linked, false), ('links-described', 'fail', treed AND has_facts AND linked, false),
  ('figure-text', 'warn', treed AND has_facts, false), ('orphaned-content', 'fail', treed, false)) c(check_id, bad, apply, show_na)),
 report AS (SELECT doc_id, check_id, status, 0 AS n FROM rules UNION ALL
 SELECT doc_id, check_id, CASE WHEN bad = 'na' THEN 'na' WHEN n > 0 THEN bad ELSE 'pass' END, CASE WHEN bad = 'na' THEN 0 ELSE coalesce(n, 0) END FROM due LEFT JOIN counted USING (doc_id, check_id) WHERE shown_)"""


def _found(x, w):
    return a.instances(x, w(DOC_PAGES), w(ANNOTATIONS), a.empty_nodes(x), c.shown_text(w(LEAF_OPS)))


def _report(x, w):
    return a.report(w(DOC_INFO), a.document_rules(w(DOC_INFO), w(OUTLINE), x), _found(x, w), x, w(ANNOTATIONS), c.orphans_by_document(w(PAGE_OPS), w(PAGE_CLAIMED)))


on_tree("figures_with_text", lambda x, w: a.figures_with_text(x, c.shown_text(w(LEAF_OPS))), f"{_STREAMS} SELECT {_F} FROM figure_text")
on_tree("audit_report", _report, f"{_REPORT} SELECT doc_id, check_id, status, CAST(n AS BIGINT) AS n FROM report", *_PARTS, *_INFO)
on_tree("audit_counts", lambda x, w: a.counts(_report(x, w)), f"{_REPORT} SELECT doc_id, count(*) FILTER (status = 'fail') AS n_fail, count(*) FILTER (status = 'warn') AS n_warn, count(*) FILTER (status = 'pass') AS n_pass FROM report GROUP BY doc_id", *_PARTS, *_INFO)
on_tree("identifier_gate", lambda x, w: a.identifier_gate(_report(x, w)), f"{_REPORT} SELECT doc_id, count(*) FILTER (status = 'fail' AND check_id <> 'identifier') = 0 AS fixable FROM report GROUP BY doc_id HAVING bool_or(check_id = 'identifier' AND status = 'fail')", *_PARTS, *_INFO)
on_tree("audit_capped", lambda x, w: a.capped(a.instances(x, w(DOC_PAGES), w(ANNOTATIONS), a.empty_nodes(x))),
        f"{_ALL}, c AS (SELECT doc_id, check_id, node_id, count(*) OVER (PARTITION BY doc_id, check_id) > 100 AS truncated, row_number() OVER (PARTITION BY doc_id, check_id ORDER BY node_id NULLS FIRST, page NULLS FIRST, detail) AS n FROM found) SELECT doc_id, check_id, node_id, truncated FROM c WHERE n <= 100", *_PARTS)

"""Queries of bulk rewrites, with their SQL: parents and positions of the new version."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as a
from ..operators import rewrite as r
from ..operators import tree as t
from .adapters import ANNOTATIONS, LEAF_OPS
from .tree_queries import on_tree

_pick = lambda x, k=7: x.filter(f"type = 'element' AND node_id % {k} = 1").select("doc_id", "node_id")
_place = lambda df: df.select("doc_id", "node_id", "parent_id", "ord")


def _changes(x):
    return x.filter("node_id % 5 = 1").select("doc_id", "node_id", F.create_map(F.lit("alt"), F.when(F.col("ord") % 2 == 0, "").otherwise("new"), F.lit("role"), F.when(F.col("ord") % 3 == 0, "").otherwise("Sect"), F.lit("col_span"), F.when(F.col("ord") % 4 == 0, "0").otherwise("3")).alias("changes"))


_C = "node_id % 5 = 1"
on_tree("update_nodes", lambda x, _: r.update_nodes(x, _changes(x)).select("doc_id", "node_id", "role", "alt", "col_span"),
        f"SELECT doc_id, node_id, CASE WHEN {_C} AND type = 'element' AND ord % 3 <> 0 THEN 'Sect' ELSE role END AS role, CASE WHEN {_C} AND type = 'element' THEN CASE WHEN ord % 2 = 0 THEN NULL ELSE 'new' END ELSE alt END AS alt, CASE WHEN {_C} AND type = 'element' AND ord % 4 <> 0 THEN 3 ELSE col_span END AS col_span FROM tree")
on_tree("refused_updates", lambda x, _: r.refused_updates(x, _changes(x)), f"SELECT doc_id, node_id, CASE WHEN type <> 'element' THEN 'not a tag' ELSE 'bad span' END AS reason FROM tree WHERE {_C} AND (type <> 'element' OR ord % 4 = 0)")
on_tree("known_selection", lambda x, _: r.known_selection(x, x.filter("depth = 2").select("doc_id", F.when((F.col("node_id") % 3 > 0) & (F.col("doc_id") % 4 > 0), F.col("node_id")).otherwise(F.col("node_id") + 7_000_000_000).alias("node_id"))),
        "SELECT doc_id, CASE WHEN k THEN node_id ELSE node_id + 7000000000 END AS node_id, k AS known, NOT bool_or(k) OVER (PARTITION BY doc_id) AS refused FROM (SELECT *, node_id % 3 > 0 AND doc_id % 4 > 0 AS k FROM tree WHERE depth = 2) z")
on_tree("effective_changes", lambda x, _: r.effective_changes(x, _changes(x)),
        f"SELECT doc_id, node_id, c.name AS name FROM tree, LATERAL (VALUES ('alt', CASE WHEN ord % 2 = 0 THEN '' ELSE 'new' END, coalesce(alt, '')), ('role', CASE WHEN ord % 3 = 0 THEN '' ELSE 'Sect' END, coalesce(role, '')), ('col_span', CASE WHEN ord % 4 = 0 THEN '0' ELSE '3' END, CAST(col_span AS VARCHAR))) c(name, new, old) WHERE {_C} AND c.new <> c.old")
on_tree("replace_role", lambda x, _: r.replace_role(x, "Table", "Sect").select("doc_id", "node_id", "role"), "SELECT doc_id, node_id, CASE WHEN role = 'Table' THEN 'Sect' ELSE role END AS role FROM tree")
on_tree("shift_headings", lambda x, _: r.shift_headings(x, 1).select("doc_id", "node_id", "role"), "SELECT doc_id, node_id, CASE role WHEN 'H1' THEN 'H2' WHEN 'H2' THEN 'H3' WHEN 'H3' THEN 'H4' ELSE role END AS role FROM tree")
_NUM = "CAST(row_number() OVER (PARTITION BY doc_id, parent_id ORDER BY {0}) - 1 AS BIGINT) AS ord"
_HEIR = "(SELECT max_by(s.node_id, s.depth) FROM anc JOIN tree s ON s.doc_id = anc.doc_id AND s.node_id = anc.anc WHERE anc.doc_id = t.doc_id AND anc.node_id = t.node_id AND s.node_id <> t.node_id AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = s.doc_id AND g.node_id = s.node_id))"
on_tree("flatten_nodes", lambda x, _: _place(r.flatten(x, x.filter("depth = 1").select("doc_id", "node_id"))),
        f", gone AS (SELECT doc_id, node_id FROM tree WHERE depth > 1 AND (lower(role) IN ('div', 'sect', 'part', 'sub') OR lower(role) LIKE '%span%')), m AS (SELECT t.doc_id, t.node_id, t.pos, {_HEIR} AS parent_id FROM tree t WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = t.doc_id AND g.node_id = t.node_id)) SELECT doc_id, node_id, parent_id, {_NUM.format('pos, node_id')} FROM m")
on_tree("delete_subtrees", lambda x, _: _place(r.delete_nodes(x, _pick(x))), f", k AS (SELECT * FROM tree t WHERE NOT EXISTS (SELECT 1 FROM tree d WHERE d.doc_id = t.doc_id AND d.type = 'element' AND d.node_id % 7 = 1 AND t.pre BETWEEN d.pre AND d.last_pre)) SELECT doc_id, node_id, parent_id, {_NUM.format('ord, node_id')} FROM k")
on_tree("join_previous", lambda x, _: r.join_previous(x, _pick(x, 3)).select("doc_id", "node_id", "parent_id", "ord", "own_page", "kind"),
        f", s AS (SELECT *, type = 'element' AND node_id % 3 = 1 AS chosen FROM tree), b AS (SELECT *, lag(node_id) OVER w AS into_id, lag(type) OVER w AS bt, lag(chosen) OVER w AS bc, lag(page) OVER w AS bp FROM s WINDOW w AS (PARTITION BY doc_id, parent_id ORDER BY ord, node_id)), pairs AS (SELECT doc_id, node_id, into_id, bp FROM b WHERE chosen AND bt = 'element' AND NOT bc), k AS (SELECT t.doc_id, t.node_id, t.ord AS o, coalesce(p.into_id, t.parent_id) AS parent_id, p.into_id IS NOT NULL AS moved, CASE WHEN p.into_id IS NOT NULL AND t.page IS DISTINCT FROM bp THEN CASE WHEN t.kind = 'content-int' THEN t.page ELSE coalesce(t.own_page, t.page) END ELSE t.own_page END AS own_page, CASE WHEN p.into_id IS NOT NULL AND t.page IS DISTINCT FROM bp AND t.kind = 'content-int' THEN 'content-dict' ELSE t.kind END AS kind FROM tree t LEFT JOIN pairs p ON p.doc_id = t.doc_id AND p.node_id = t.parent_id WHERE NOT EXISTS (SELECT 1 FROM pairs q WHERE q.doc_id = t.doc_id AND q.node_id = t.node_id)) SELECT doc_id, node_id, parent_id, {_NUM.format('moved, o, node_id')}, own_page, kind FROM k")
on_tree("move_to_front", lambda x, _: _place(r.move_to_front(x, _pick(x, 4))), f"SELECT doc_id, node_id, parent_id, CAST(row_number() OVER (PARTITION BY doc_id, parent_id ORDER BY NOT (type = 'element' AND node_id % 4 = 1), tree.ord, node_id) - 1 AS BIGINT) AS ord FROM tree")
on_tree("wrap_leaves", lambda x, _: _place(r.wrap_nodes(x, x.filter("type = 'content' AND node_id % 2 = 0").select("doc_id", "node_id"), "P", F.lit(1_000_000_000) + F.col("node_id"))),
        "SELECT doc_id, node_id, CASE WHEN type = 'content' AND node_id % 2 = 0 THEN 1000000000 + node_id ELSE parent_id END AS parent_id, CASE WHEN type = 'content' AND node_id % 2 = 0 THEN 0 ELSE ord END AS ord FROM tree UNION ALL SELECT doc_id, 1000000000 + node_id, parent_id, ord FROM tree WHERE type = 'content' AND node_id % 2 = 0")
on_tree("collapse_to_figure", lambda x, _: _place(r.collapse_to_leaves(x, x.filter("role = 'Table'").select("doc_id", "node_id"), "Figure")),
        f", u AS (SELECT t.doc_id, t.node_id, max(f.node_id) AS into_id FROM tree t JOIN tree f ON f.doc_id = t.doc_id AND f.role = 'Table' AND t.pre > f.pre AND t.pre <= f.last_pre GROUP BY ALL), k AS (SELECT t.*, coalesce(into_id, parent_id) AS up FROM tree t LEFT JOIN u USING (doc_id, node_id) WHERE into_id IS NULL OR type IN ('content', 'object-ref')) SELECT doc_id, node_id, up AS parent_id, CAST(row_number() OVER (PARTITION BY doc_id, up ORDER BY pos, node_id) - 1 AS BIGINT) AS ord FROM k")
# in some documents a role of their own stands for Link, and lines have an actual text
_ROLE_MAP = "SELECT DISTINCT o_custkey AS doc_id, CASE WHEN o_custkey % 3 = 0 THEN 'Span' ELSE 'LBody' END AS custom, CASE WHEN o_custkey % 2 = 0 THEN 'Link' ELSE 'P' END AS standard FROM {orders}"
_SPOKEN = "CASE WHEN depth = 3 AND node_id % 5 = 0 THEN 'said' WHEN depth = 3 AND node_id % 5 = 1 THEN '' ELSE actual_text END"
_TAGGED_OPS = LEAF_OPS.replace("CASE WHEN k = 0 THEN 'P' END AS tag", "CASE WHEN k = 0 THEN CASE WHEN pk % 4 = 0 THEN 'Link' ELSE 'P' END END AS tag")
_spoken = lambda x: x.withColumn("actual_text", F.expr(_SPOKEN))
_UNLINKED = f"""s AS (SELECT * REPLACE ({_SPOKEN} AS actual_text) FROM tree WHERE NOT (type = 'object-ref' AND target_id IS NOT NULL)), l AS (SELECT s.*, type = 'element' AND (role = 'Link' OR EXISTS (SELECT 1 FROM role_map m WHERE m.doc_id = s.doc_id AND m.custom = s.role AND m.standard = 'Link')) AS is_link FROM s),
 fates AS (SELECT l.*, CASE WHEN NOT is_link THEN 'stay' WHEN NOT EXISTS (SELECT 1 FROM l c WHERE c.doc_id = l.doc_id AND c.pre > l.pre AND c.pre <= l.last_pre AND NOT c.is_link) THEN 'vanish'
   WHEN depth = 1 OR coalesce(up_role IN ('Document', 'DocumentFragment', 'Part', 'Art', 'Sect', 'Div', 'NonStruct', 'Private'), false) THEN 'P' WHEN actual_text IS NOT NULL THEN 'Span' ELSE 'dissolve' END AS fate FROM l)"""
on_tree("remove_links", lambda x, w: r.remove_links(_spoken(x), w(_ROLE_MAP)).select("doc_id", "node_id", "parent_id", "role", "alt"),
        f""", {_UNLINKED} SELECT f.doc_id, f.node_id, (SELECT max_by(a.node_id, a.depth) FROM fates a WHERE a.doc_id = f.doc_id AND a.pre < f.pre AND f.pre <= a.last_pre AND a.fate <> 'dissolve') AS parent_id, CASE WHEN fate IN ('P', 'Span') THEN fate ELSE role END AS role, CASE WHEN fate NOT IN ('P', 'Span') THEN alt END AS alt FROM fates f WHERE fate NOT IN ('vanish', 'dissolve')""", ("role_map", _ROLE_MAP))
on_tree("links_removed", lambda x, w: r.links_removed(_spoken(x), w(ANNOTATIONS), w(_TAGGED_OPS), w(_ROLE_MAP)),
        f""", {_UNLINKED}, t_ AS (SELECT doc_id, count(*) AS tags, count(*) FILTER (fate IN ('P', 'Span')) AS retagged FROM fates WHERE is_link GROUP BY doc_id), a_ AS (SELECT doc_id, count(*) AS annotations FROM notes GROUP BY doc_id), s_ AS (SELECT doc_id, count(*) AS spans FROM tagged_ops WHERE op = 'BDC' AND tag = 'Link' GROUP BY doc_id)
 SELECT doc_id, coalesce(annotations, 0) AS annotations, coalesce(tags, 0) AS tags, coalesce(retagged, 0) AS retagged, coalesce(spans, 0) AS spans FROM t_ FULL JOIN a_ USING (doc_id) FULL JOIN s_ USING (doc_id)""", ("role_map", _ROLE_MAP), ("notes", ANNOTATIONS), ("tagged_ops", _TAGGED_OPS))
on_tree("unlinked_ops", lambda _, w: r.unlinked_ops(w(_TAGGED_OPS)).select("doc_id", "page", "op_idx", "tag", "mcid"), "SELECT doc_id, page, op_idx, CASE WHEN tag = 'Link' THEN 'Span' ELSE tag END AS tag, mcid FROM tagged_ops", ("tagged_ops", _TAGGED_OPS))
on_tree("annotation_links_mapped", lambda x, w: a.link_tags(x, w(ANNOTATIONS), w(_ROLE_MAP.replace("'Span' ELSE 'LBody'", "'Figure' ELSE 'Link'"))).select("doc_id", "annot_id", "link"),
        """, m AS (SELECT o.doc_id, o.target_id, p.node_id, o.pre FROM tree o JOIN tree p ON p.doc_id = o.doc_id AND p.node_id = o.parent_id LEFT JOIN role_map r ON r.doc_id = p.doc_id AND r.custom = p.role WHERE o.type = 'object-ref' AND coalesce(r.standard, p.role) = 'Link')
 SELECT n.doc_id, n.annot_id, (SELECT min_by(m.node_id, m.pre) FROM m WHERE m.doc_id = n.doc_id AND m.target_id = n.annot_id) AS link FROM notes n""", ("role_map", _ROLE_MAP.replace("'Span' ELSE 'LBody'", "'Figure' ELSE 'Link'")), ("notes", ANNOTATIONS))
on_tree("prune_emptied", lambda x, _: r.prune_emptied(x, x.filter("role IN ('LBody', 'Span', 'TD') AND pre = last_pre").select("doc_id", "node_id")).select("doc_id", "node_id"),
        """, cand AS (SELECT * FROM tree WHERE role IN ('LBody', 'Span', 'TD') AND pre = last_pre), may AS (SELECT t.* FROM tree t WHERE type = 'element' AND role <> 'Document' AND EXISTS (SELECT 1 FROM cand c WHERE c.doc_id = t.doc_id AND c.pre BETWEEN t.pre AND t.last_pre)),
 gone AS (SELECT * FROM may m WHERE NOT EXISTS (SELECT 1 FROM tree c WHERE c.doc_id = m.doc_id AND c.pre BETWEEN m.pre AND m.last_pre AND NOT EXISTS (SELECT 1 FROM may x WHERE x.doc_id = c.doc_id AND x.node_id = c.node_id))) SELECT doc_id, node_id FROM tree t WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = t.doc_id AND g.node_id = t.node_id)""")
on_tree("table_scope", lambda x, _: r.scope_tables(x), """, c AS (SELECT c.doc_id, c.node_id, g.node_id AS tab, dense_rank() OVER (PARTITION BY c.doc_id, g.node_id ORDER BY r.ord, r.node_id) AS r, row_number() OVER (PARTITION BY c.doc_id, g.node_id, r.node_id ORDER BY c.ord, c.node_id) AS c, c.role = 'TH' AS th
  FROM tree c JOIN tree r ON r.doc_id = c.doc_id AND r.node_id = c.parent_id AND r.role = 'TR' JOIN tree g ON g.doc_id = r.doc_id AND g.node_id = r.parent_id AND g.role = 'Table' WHERE c.role IN ('TH', 'TD')),
 w AS (SELECT doc_id, tab, bool_and(th) FILTER (r = 1) AS first, bool_and(th) FILTER (r > 1 AND c = 1) AS lead, coalesce(bool_or(th) FILTER (r > 1), false) AS later, bool_and(th) FILTER (c = 1) AS every, max(r) AS n FROM c GROUP BY ALL),
 o AS (SELECT c.doc_id, node_id, CASE WHEN first AND n > 1 AND lead THEN CASE WHEN r = 1 AND c = 1 THEN 'Both' WHEN r = 1 THEN 'Column' WHEN c = 1 THEN 'Row' END WHEN first AND NOT later THEN CASE WHEN r = 1 THEN 'Column' END WHEN every THEN CASE WHEN c = 1 THEN 'Row' END END AS scope FROM c JOIN w USING (doc_id, tab) WHERE th) SELECT * FROM o WHERE scope IS NOT NULL""")
on_tree("content_fingerprint", lambda x, _: r.content_fingerprint(x), "SELECT doc_id, string_agg(coalesce(CAST(page AS VARCHAR), '-') || ':' || coalesce(CAST(mcid AS VARCHAR), '-'), ' ' ORDER BY pre) AS fingerprint FROM tree WHERE type = 'content' GROUP BY doc_id")
on_tree("flatten_fingerprint", lambda x, _: r.content_fingerprint(t.tree_keys(r.flatten(x, x.filter("depth = 1").select("doc_id", "node_id")), buckets=x.rdd.getNumPartitions())), "SELECT doc_id, string_agg(coalesce(CAST(page AS VARCHAR), '-') || ':' || coalesce(CAST(mcid AS VARCHAR), '-'), ' ' ORDER BY pre) AS fingerprint FROM tree WHERE type = 'content' GROUP BY doc_id")
on_tree("run_script", lambda x, _: r.run_script(x, [{"type": "replace_role", "find": "Div", "put": "Sect"}, {"type": "shift_headings", "by": 1}]).select("doc_id", "node_id", "role"), "SELECT doc_id, node_id, CASE role WHEN 'H1' THEN 'H2' WHEN 'H2' THEN 'H3' WHEN 'H3' THEN 'H4' WHEN 'Div' THEN 'Sect' ELSE role END AS role FROM tree")

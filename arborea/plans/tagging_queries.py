"""Queries that tag selections of content, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tagging as g
from ..operators import tree as t
from .adapters import LEAF_OPS, LEAF_TEXT
from .move_queries import _LABELLED
from .tree_queries import on_tree

#: By document: all leaves of one line, some of a line's, those of the first lines of an order, or those of several orders.
_CHOSEN = "type = 'content' AND parent_id > 0 AND (doc_id % 5 = 0 AND node_id // 64 = low AND node_id % 64 <= 10 OR doc_id % 5 = 1 AND node_id // 64 = low OR doc_id % 5 = 2 AND parent_id = up OR doc_id % 5 = 3 AND node_id // 64 = low + 1 AND node_id % 64 > 10 OR doc_id % 5 = 4 AND node_id // 64 <= low + 40)"


def _chosen(x):
    low = x.filter("type = 'content'").groupBy("doc_id").agg(F.min(F.expr("node_id div 64")).alias("low"), F.min("parent_id").alias("up"))
    return x.join(low, "doc_id").filter(_CHOSEN.replace("//", "div")).select("doc_id", "node_id")


_IDS = lambda: {k: F.lit((i + 1) * 1_000_000_000_000) + F.col("node_id") for i, k in enumerate(("new", "tail", "para", "item", "label", "body"))}
# every leaf with what it holds counted anew: inside (selected) and all leaves below each node
_FACTS = f"""low AS (SELECT doc_id, min(node_id // 64) AS low, min(parent_id) AS up FROM tree WHERE type = 'content' GROUP BY doc_id), pick AS (SELECT t.doc_id, t.node_id FROM tree t JOIN low USING (doc_id) WHERE {_CHOSEN}),
 sibs AS (SELECT *, row_number() OVER (PARTITION BY doc_id, parent_id ORDER BY ord, node_id) - 1 AS i, count(*) OVER (PARTITION BY doc_id, parent_id) AS kids FROM tree), c AS (SELECT sibs.* FROM sibs JOIN pick USING (doc_id, node_id)),
 d AS (SELECT doc_id, count(*) AS n, count(DISTINCT parent_id) AS ups, count(DISTINCT coalesce(page, -1)) AS pages, min(i) AS lo, max(i) AS hi, min(kids) AS kids, min(parent_id) AS up, min_by(node_id, pre) AS first, min(page) AS page FROM c GROUP BY doc_id),
 h AS (SELECT a.doc_id, a.anc, count(*) AS leaves, count(p.node_id) AS inside FROM anc a LEFT JOIN pick p ON p.doc_id = a.doc_id AND p.node_id = a.node_id WHERE a.type IN ('content', 'object-ref') GROUP BY ALL),
 stop AS (SELECT doc_id, node_id FROM tree WHERE depth = 0 OR depth = 1 AND role = 'Document'),
 full_ AS (SELECT h.doc_id, h.anc FROM h JOIN tree t ON t.doc_id = h.doc_id AND t.node_id = h.anc WHERE inside = leaves AND type = 'element' AND NOT EXISTS (SELECT 1 FROM stop s WHERE s.doc_id = h.doc_id AND s.node_id = h.anc)),
 top AS (SELECT a.doc_id, max(t.depth) AS kept FROM d JOIN anc a ON a.doc_id = d.doc_id AND a.node_id = d.first AND a.anc <> d.first JOIN tree t ON t.doc_id = a.doc_id AND t.node_id = a.anc WHERE NOT EXISTS (SELECT 1 FROM full_ f WHERE f.doc_id = a.doc_id AND f.anc = a.anc) GROUP BY a.doc_id),
 f AS (SELECT d.*, l.path[kept + 2] AS anchor, u.parent_id AS grand, CASE WHEN pages > 1 THEN 'pages' WHEN ups = 1 AND EXISTS (SELECT 1 FROM full_ x WHERE x.doc_id = d.doc_id AND x.anc = d.up) THEN 'relabel'
   WHEN ups = 1 AND hi - lo + 1 = n AND u.type = 'element' AND u.role NOT IN ('Table', 'THead', 'TBody', 'TFoot', 'TR', 'TD', 'TH', 'L', 'LI', 'Lbl', 'LBody', 'TOC', 'TOCI') AND NOT EXISTS (SELECT 1 FROM stop s WHERE s.doc_id = d.doc_id AND s.node_id = d.up) THEN 'split' ELSE 'around' END AS how
   FROM d JOIN top USING (doc_id) JOIN tree l ON l.doc_id = d.doc_id AND l.node_id = d.first JOIN tree u ON u.doc_id = d.doc_id AND u.node_id = d.up)"""
on_tree("wrap_plan", lambda x, _: g.wrap_plan(x, _chosen(x)), f", {_FACTS} SELECT doc_id, how, CASE how WHEN 'pages' THEN NULL WHEN 'around' THEN anchor ELSE up END AS node_id, CASE WHEN how = 'split' THEN CAST(lo AS INT) END AS first, CASE WHEN how = 'split' THEN CAST(hi AS INT) END AS last FROM f")
# a tag goes if every leaf and other node below it is selected or goes: level by level, from below
_WRAPPED = f"""{_FACTS}, ok AS (SELECT f.*, CASE how WHEN 'relabel' THEN up ELSE 1000000000000 + first END AS into_, CASE how WHEN 'split' THEN grand ELSE (SELECT parent_id FROM tree a WHERE a.doc_id = f.doc_id AND a.node_id = f.anchor) END AS home, CASE how WHEN 'split' THEN up ELSE anchor END AS at FROM f WHERE how <> 'pages'),
 sel AS (SELECT p.doc_id, p.node_id FROM pick p JOIN ok USING (doc_id)),
 gone AS (SELECT e.doc_id, e.node_id FROM tree e JOIN ok ON ok.doc_id = e.doc_id AND how = 'around' WHERE e.type = 'element' AND EXISTS (SELECT 1 FROM anc a JOIN sel s ON s.doc_id = a.doc_id AND s.node_id = a.node_id WHERE a.doc_id = e.doc_id AND a.anc = e.node_id) AND NOT EXISTS (SELECT 1 FROM stop s WHERE s.doc_id = e.doc_id AND s.node_id = e.node_id)
   AND NOT EXISTS (SELECT 1 FROM anc a WHERE a.doc_id = e.doc_id AND a.anc = e.node_id AND a.node_id = ok.home)
   AND NOT EXISTS (SELECT 1 FROM anc a WHERE a.doc_id = e.doc_id AND a.anc = e.node_id AND NOT EXISTS (SELECT 1 FROM anc b JOIN sel s ON s.doc_id = b.doc_id AND s.node_id = b.node_id WHERE b.doc_id = a.doc_id AND b.anc = a.node_id))),
 k AS (SELECT s.doc_id, s.node_id, CASE WHEN c.node_id IS NOT NULL THEN into_ WHEN how = 'split' AND s.parent_id = up AND i > hi AND lo > 0 THEN 2000000000000 + first ELSE s.parent_id END AS parent_id, CASE WHEN c.node_id IS NOT NULL THEN s.pre ELSE s.ord END AS o, 0 AS side, CASE WHEN how = 'relabel' AND s.node_id = up THEN 'H2' ELSE s.role END AS role, own_page
   FROM sibs s LEFT JOIN ok USING (doc_id) LEFT JOIN sel c ON c.doc_id = s.doc_id AND c.node_id = s.node_id WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = s.doc_id AND g.node_id = s.node_id)
   UNION ALL SELECT ok.doc_id, into_, home, t.ord, CASE WHEN how = 'split' AND lo > 0 THEN 1 ELSE -1 END, 'H2', ok.page FROM ok JOIN tree t ON t.doc_id = ok.doc_id AND t.node_id = ok.at WHERE how <> 'relabel'
   UNION ALL SELECT ok.doc_id, 2000000000000 + first, home, t.ord, 2, t.role, t.own_page FROM ok JOIN tree t ON t.doc_id = ok.doc_id AND t.node_id = ok.at WHERE how = 'split' AND lo > 0 AND hi < ok.kids - 1)"""
on_tree("wrap_selection", lambda x, _: g.wrap_selection(x, _chosen(x), "H2", _IDS()).select("doc_id", "node_id", "parent_id", "ord", "role", "own_page"),
        f", {_WRAPPED} SELECT doc_id, node_id, parent_id, CAST(row_number() OVER (PARTITION BY doc_id, parent_id ORDER BY o, side, node_id) - 1 AS BIGINT) AS ord, role, own_page FROM k")
on_tree("refused_selections", lambda x, _: g.refused_selections(x, x.filter("node_id % 64 <= 10 AND doc_id % 3 > 0").select("doc_id", "node_id").unionByName(x.filter("depth = 0 AND doc_id % 7 = 0").select("doc_id", F.lit(-9).cast("long").alias("node_id")))),
        ", s AS (SELECT doc_id, node_id, kind, page FROM tree WHERE node_id % 64 <= 10 AND doc_id % 3 > 0 UNION ALL SELECT doc_id, -9, NULL, NULL FROM tree WHERE depth = 0 AND doc_id % 7 = 0), r AS (SELECT doc_id, CASE WHEN bool_or(kind IS NULL) THEN 'unknown' WHEN bool_or(kind NOT IN ('content-int', 'content-dict')) THEN 'not content' WHEN count(DISTINCT coalesce(page, -1)) > 1 THEN 'pages' END AS reason FROM s GROUP BY doc_id) SELECT * FROM r WHERE reason IS NOT NULL")

#: Runs of the first lines' texts: two of a long text, one up to the end of another, a marker's length for a list.
_RUNS = "type = 'content' AND length(text) > 6 AND node_id % 64 <= 12"


def _runs(x, w):
    leaf = x.join(w(LEAF_TEXT), ["doc_id", "node_id"]).filter(_RUNS)
    n = F.length("text")
    two = F.array(F.struct(F.lit(1).alias("start"), F.lit(3).alias("end"), F.lit(None).cast("int").alias("label")), F.struct(F.lit(4).alias("start"), F.when(F.col("node_id") % 2 == 0, n + 5).alias("end"), F.lit(1).alias("label")))
    first = leaf.withColumn("page", t.resolved_page()).withColumn("low", F.expr("min(node_id div 64) OVER (PARTITION BY doc_id)")).filter("node_id div 64 = low")
    return first.select("doc_id", "node_id", F.explode(two).alias("r")).select("doc_id", "node_id", "r.*", F.lit(None).cast("int").alias("item"))


_CUT = f"""r0 AS (SELECT t.doc_id, t.node_id, t.pre, t.page, t.mcid, text, length(text) AS n, t.node_id // 64 AS o FROM tree t JOIN leaf_text USING (doc_id, node_id) WHERE {_RUNS}), r1 AS (SELECT * FROM r0 QUALIFY o = min(o) OVER (PARTITION BY doc_id)),
 pages_ AS (SELECT doc_id FROM r1 GROUP BY doc_id HAVING count(DISTINCT coalesce(page, -1)) = 1), r2 AS (SELECT r1.* FROM r1 JOIN pages_ USING (doc_id)),
 edges AS (SELECT r2.*, x, phase FROM r2, LATERAL (VALUES (1, 0), (3, 0), (4, 0), (5, 1)) e(x, phase)),
 used AS (SELECT doc_id, page, max(mcid) + 1 AS next FROM (SELECT doc_id, page, mcid FROM tree WHERE type = 'content' AND mcid IS NOT NULL UNION ALL SELECT doc_id, page, mcid FROM leaf_ops WHERE op = 'BDC' AND mcid IS NOT NULL) u GROUP BY ALL), tops AS (SELECT doc_id, max(node_id) AS top FROM tree GROUP BY doc_id),
 fresh AS (SELECT e.doc_id, e.node_id AS leaf, x, e.page, text, n, CAST(next + row_number() OVER (PARTITION BY e.doc_id, e.page ORDER BY phase, CASE WHEN phase = 0 THEN -e.pre ELSE e.pre END, CASE WHEN phase = 0 THEN -x ELSE x END) - 1 AS INT) AS mcid, top + row_number() OVER (PARTITION BY e.doc_id ORDER BY e.pre, x) AS node_id FROM edges e JOIN used USING (doc_id, page) JOIN tops USING (doc_id)),
 begins AS (SELECT doc_id, leaf, x, page, text, n, mcid, node_id FROM fresh UNION ALL SELECT doc_id, node_id, 0, page, text, n, mcid, node_id FROM r2),
 pieces AS (SELECT doc_id, leaf, CAST(row_number() OVER w - 1 AS INT) AS piece, CAST(x AS INT) AS start, CAST(coalesce(lead(x) OVER w, n) AS INT) AS stop, text, node_id, mcid, page FROM begins WINDOW w AS (PARTITION BY doc_id, leaf ORDER BY x)),
 cut AS (SELECT p.doc_id, p.leaf, piece, start, stop, substr(p.text, start + 1, stop - start) AS text, p.node_id, p.mcid, p.page, CASE WHEN start = 1 THEN 2 * no - 1 WHEN start >= 4 THEN 2 * no END AS run, start = 4 AS label FROM pieces p JOIN (SELECT doc_id, node_id AS leaf, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pre) AS INT) AS no FROM r2) z USING (doc_id, leaf))"""
on_tree("cut_runs", lambda x, w: g.cut_runs(x, _runs(x, w), w(LEAF_TEXT), w(LEAF_OPS)), f", {_CUT} SELECT * FROM cut", ("leaf_text", LEAF_TEXT), ("leaf_ops", LEAF_OPS))
_TAGGED = lambda x, w, role: g.tag_runs(x, _runs(x, w), w(LEAF_TEXT), role, _IDS(), w(LEAF_OPS))[0]
# the content of the new tag, in order: each list item's marker and text
on_tree("tag_runs", lambda x, w: t.tree_keys(_TAGGED(x, w, "L")).filter("type = 'content'").select("doc_id", "node_id", "mcid", F.concat_ws(" > ", F.transform(F.filter("path", lambda s: s["role"].isin("L", "LI", "Lbl", "LBody") & (s["node_id"] > 1_000_000_000_000)), lambda s: s["role"])).alias("within")),
        f""", {_CUT}, every AS (SELECT doc_id, node_id, mcid, CASE WHEN run IS NULL THEN '' WHEN label THEN 'L > LI > Lbl' ELSE 'L > LI > LBody' END AS within FROM cut UNION ALL SELECT doc_id, node_id, mcid, '' FROM tree t WHERE type = 'content' AND NOT EXISTS (SELECT 1 FROM r2 WHERE r2.doc_id = t.doc_id AND r2.node_id = t.node_id)) SELECT * FROM every""", ("leaf_text", LEAF_TEXT), ("leaf_ops", LEAF_OPS))
_SHOWN = f"SELECT o.doc_id, o.page, o.op_idx, o.op, o.tag, o.mcid, CASE WHEN o.op = 'Tj' THEN l.text END AS shown FROM ({LEAF_OPS}) o LEFT JOIN (SELECT doc_id, node_id, text FROM ({LEAF_TEXT}) z) l ON l.doc_id = o.doc_id AND l.node_id = o.op_idx // 32 * 64 + o.op_idx // 4 % 8 + 8"
on_tree("cut_marks", lambda x, w: g.cut_marks(w(_SHOWN.replace("//", "div")), g.cut_runs(x, _runs(x, w), w(LEAF_TEXT), w(LEAF_OPS))),
        f""", {_CUT}, o AS (SELECT s.*, op_idx // 4 AS span, max(s.mcid) OVER (PARTITION BY s.doc_id, s.page, op_idx // 4) AS was FROM shown_ s), many AS (SELECT c.*, first_value(mcid) OVER (PARTITION BY doc_id, leaf ORDER BY piece) AS was, max(piece) OVER (PARTITION BY doc_id, leaf) AS final FROM cut c),
 steps AS (SELECT o.doc_id, o.page, op_idx, 0 AS k, 0 AS j, op, tag, o.mcid, shown FROM o WHERE NOT (op = 'Tj' AND shown <> '' AND EXISTS (SELECT 1 FROM many m WHERE m.doc_id = o.doc_id AND m.page = o.page AND m.was = o.was))
  UNION ALL SELECT o.doc_id, o.page, op_idx, piece, j, CASE j WHEN 0 THEN 'EMC' WHEN 1 THEN 'BDC' ELSE 'Tj' END, CASE WHEN j = 1 THEN 'P' END, CASE WHEN j = 1 THEN m.mcid END, CASE WHEN j = 2 THEN CASE WHEN piece = final THEN substr(shown, start + 1) ELSE substr(shown, start + 1, stop - start) END END FROM o JOIN many m ON m.doc_id = o.doc_id AND m.page = o.page AND m.was = o.was, LATERAL (VALUES (0), (1), (2)) z(j) WHERE op = 'Tj' AND start < length(shown) AND (piece > 0 OR j = 2))
 SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY op_idx, k, j) - 1 AS BIGINT) AS op_idx, op, tag, mcid, shown FROM steps""", ("leaf_text", LEAF_TEXT), ("leaf_ops", LEAF_OPS), ("shown_", _SHOWN))

# every third node as a list item; some leaves begin with a marker, some are one
_LABELLED_LEAVES = "item_leaves AS (SELECT i.doc_id, i.node_id AS item, i.type <> 'element' AS bare, c.node_id, c.type, c.kind, c.pre, c.page, c.mcid, l.text, row_number() OVER (PARTITION BY i.doc_id, i.node_id ORDER BY c.pre) AS no FROM top i JOIN tree c ON c.doc_id = i.doc_id AND c.pre BETWEEN i.pre AND i.last_pre AND c.type <> 'element' LEFT JOIN leaf_text l ON l.doc_id = c.doc_id AND l.node_id = c.node_id)"
_ITEMS = f"""sel AS (SELECT * FROM tree WHERE node_id % 3 = 0 AND depth > 0), top AS (SELECT * FROM sel WHERE NOT EXISTS (SELECT 1 FROM sel o WHERE o.doc_id = sel.doc_id AND o.node_id <> sel.node_id AND list_contains(sel.path, o.node_id))), {_LABELLED_LEAVES},
 marked AS (SELECT *, CASE WHEN no = 1 AND type = 'content' THEN coalesce(length(regexp_extract(text, '^([ \\t]*(?:[•‣◦▪●○*]|[A-Za-z]\\.|[0-9]+\\.))[ \\t]+[^ \\t]', 1)), 0) ELSE 0 END AS cut, no = 1 AND coalesce(regexp_matches(trim(text), '^([•‣◦▪●○*]|[A-Za-z]\\.|[0-9]+\\.)$'), false) AS whole FROM item_leaves),
 used AS (SELECT doc_id, page, max(mcid) + 1 AS next FROM (SELECT doc_id, page, mcid FROM tree WHERE type = 'content' AND mcid IS NOT NULL UNION ALL SELECT doc_id, page, mcid FROM leaf_ops WHERE op = 'BDC' AND mcid IS NOT NULL) u GROUP BY ALL), tops AS (SELECT doc_id, max(node_id) AS last FROM tree GROUP BY doc_id),
 fresh AS (SELECT m.*, CAST(next + row_number() OVER (PARTITION BY m.doc_id, m.page ORDER BY m.pre) - 1 AS INT) AS new_mcid, last + row_number() OVER (PARTITION BY m.doc_id ORDER BY m.pre) AS new_id FROM marked m JOIN used USING (doc_id, page) JOIN tops USING (doc_id) WHERE cut > 0),
 pieces AS (SELECT doc_id, item, bare, node_id, pre * 2 AS pre, mcid, cut > 0 OR whole AS label FROM marked UNION ALL SELECT doc_id, item, bare, new_id, pre * 2 + 1, new_mcid, false FROM fresh),
 heads AS (SELECT doc_id, item, bool_or(label) AS labelled, min_by(node_id, pre) AS head FROM pieces GROUP BY ALL),
 k AS (SELECT p.doc_id, p.node_id, CASE WHEN p.label THEN 5000000000000 ELSE 6000000000000 END + head AS parent_id, NULL AS role, mcid, p.pre AS o FROM pieces p JOIN heads USING (doc_id, item)
  UNION ALL SELECT h.doc_id, 6000000000000 + head, CASE WHEN t.type = 'element' THEN item ELSE 1000000000000 + head END, 'LBody', NULL, 1 FROM heads h JOIN tree t ON t.doc_id = h.doc_id AND t.node_id = h.item UNION ALL SELECT h.doc_id, 5000000000000 + head, CASE WHEN t.type = 'element' THEN item ELSE 1000000000000 + head END, 'Lbl', NULL, 0 FROM heads h JOIN tree t ON t.doc_id = h.doc_id AND t.node_id = h.item WHERE labelled
  UNION ALL SELECT doc_id, 1000000000000 + node_id, parent_id, 'LI', NULL, ord FROM top WHERE type <> 'element'
  UNION ALL SELECT t.doc_id, t.node_id, t.parent_id, CASE WHEN p.node_id IS NOT NULL THEN 'LI' ELSE t.role END, t.mcid, t.ord FROM tree t LEFT JOIN top p ON p.doc_id = t.doc_id AND p.node_id = t.node_id WHERE NOT EXISTS (SELECT 1 FROM top i WHERE i.doc_id = t.doc_id AND t.pre BETWEEN i.pre AND i.last_pre AND (i.node_id <> t.node_id OR i.type <> 'element')))"""
on_tree("convert_items", lambda x, w: g.convert_items(x, x.filter("node_id % 3 = 0").select("doc_id", "node_id"), w(_LABELLED), _IDS(), w(LEAF_OPS))[0].select("doc_id", "node_id", "parent_id", "role", "mcid", "ord"),
        f", {_ITEMS} SELECT doc_id, node_id, parent_id, role, mcid, CAST(row_number() OVER (PARTITION BY doc_id, parent_id ORDER BY o, node_id) - 1 AS BIGINT) AS ord FROM k", ("leaf_text", _LABELLED), ("leaf_ops", LEAF_OPS))

"""Queries of moves, joins, list items, plans of new tags and selections, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as a
from ..operators import predicates as p
from ..operators import rewrite as r
from ..operators import structure as s
from ..operators import text as x
from ..operators import tree as t
from .adapters import LEAF_TEXT
from .text_queries import _PULLED, _TITLES
from .tree_queries import _FILTERS, _FLAGS, _PAGE_OF, HEADS, on_tree

_NUM = "CAST(row_number() OVER (PARTITION BY doc_id, parent_id ORDER BY {0}) - 1 AS BIGINT) AS ord"
_place = lambda df: df.select("doc_id", "node_id", "parent_id", "ord")

# of each document the elements with an even position below the parent that has the smallest id of all with several of them
_PICKED = "cand AS (SELECT * FROM tree WHERE type = 'element' AND depth > 1 AND ord % 2 = 1), homes AS (SELECT doc_id, min(parent_id) AS home FROM (SELECT doc_id, parent_id FROM cand GROUP BY ALL HAVING count(*) > 1) GROUP BY doc_id), picked AS (SELECT c.* FROM cand c JOIN homes ON homes.doc_id = c.doc_id AND home = c.parent_id)"


def _picked(x_):
    cand = x_.filter("type = 'element' AND depth > 1 AND ord % 2 = 1")
    home = cand.groupBy("doc_id", "parent_id").agg(F.count("*").alias("n")).filter("n > 1").groupBy("doc_id").agg(F.min("parent_id").alias("parent_id"))
    return cand.join(home, ["doc_id", "parent_id"], "left_semi").select("doc_id", "node_id")


on_tree("join_into_first", lambda x_, _: _place(r.join_into_first(x_, _picked(x_))), f""", {_PICKED}, first_ AS (SELECT doc_id, min_by(node_id, ord) AS head FROM picked GROUP BY doc_id), gone AS (SELECT p.doc_id, p.node_id, p.ord AS up_ord, head FROM picked p JOIN first_ USING (doc_id) WHERE p.node_id <> head),
 k AS (SELECT t.doc_id, t.node_id, coalesce(g.head, t.parent_id) AS parent_id, coalesce(g.up_ord, -1) AS u, t.ord AS o FROM tree t LEFT JOIN gone g ON g.doc_id = t.doc_id AND g.node_id = t.parent_id ANTI JOIN gone d ON d.doc_id = t.doc_id AND d.node_id = t.node_id) SELECT doc_id, node_id, parent_id, {_NUM.format('u, o, node_id')} FROM k""")


def _moves(x_, to):
    """The picked elements to position 1 below a target: the Document, or their own grandchild where ``to`` says so."""
    last = x_.filter("type = 'element'").groupBy("doc_id").agg(F.max("node_id").alias("last"))
    return _picked(x_).join(last, "doc_id").select("doc_id", "node_id", F.when(F.col("doc_id") % 4 == 0, F.col("last") + 1).when(F.col("doc_id") % 4 == 1, F.lit(-1)).otherwise(F.col(to)).cast("long").alias("target"), F.lit(1).alias("index"))


_MOVES = f"{_PICKED}, last_ AS (SELECT doc_id, max(node_id) AS last FROM tree WHERE type = 'element' GROUP BY doc_id), moves AS (SELECT p.doc_id, p.node_id, CASE WHEN p.doc_id % 4 = 0 THEN last + 1 WHEN p.doc_id % 4 = 1 THEN -1 ELSE p.node_id END AS target, p.pre FROM picked p JOIN last_ USING (doc_id))"
on_tree("refused_moves", lambda x_, _: r.refused_moves(x_, _moves(x_, "node_id")), f", {_MOVES} SELECT doc_id, node_id, CASE WHEN doc_id % 4 = 0 THEN 'no such parent' ELSE 'into itself' END AS reason FROM moves WHERE doc_id % 4 <> 1")
on_tree("move_nodes", lambda x_, _: _place(r.move_nodes(x_, _moves(x_, "node_id"))), f""", {_MOVES}, ok AS (SELECT * FROM moves WHERE doc_id % 4 = 1), rest AS (SELECT t.*, row_number() OVER (PARTITION BY t.doc_id, t.parent_id ORDER BY t.ord, t.node_id) - 1 AS i FROM tree t ANTI JOIN ok ON ok.doc_id = t.doc_id AND ok.node_id = t.node_id),
 k AS (SELECT doc_id, node_id, parent_id, CASE WHEN parent_id = -1 AND i >= 1 AND doc_id IN (SELECT doc_id FROM ok) THEN 2 ELSE 0 END AS side, i FROM rest UNION ALL SELECT doc_id, node_id, -1, 1, pre FROM ok) SELECT doc_id, node_id, parent_id, {_NUM.format('side, i, node_id')} FROM k""")
on_tree("freed_leaves", lambda x_, _: r.freed_leaves(x_, _picked(x_)), f", {_PICKED} SELECT DISTINCT c.doc_id, c.page, c.mcid FROM picked p JOIN tree c ON c.doc_id = p.doc_id AND c.pre >= p.pre AND c.pre <= p.last_pre WHERE c.type = 'content' AND c.mcid IS NOT NULL AND c.page IS NOT NULL")
# list items
_LABELLED = LEAF_TEXT.replace("ELSE p_name END AS text", "WHEN ln % 3 = 0 THEN '2.' WHEN ln % 3 = 1 THEN ' • ' || p_name ELSE p_name END AS text")
_DEALT = """under AS (SELECT i.doc_id, i.node_id AS item, c.node_id AS leaf_id, l.text, row_number() OVER (PARTITION BY i.doc_id, i.node_id ORDER BY c.pre) AS no FROM {0} i JOIN tree c ON c.doc_id = i.doc_id AND c.pre >= i.pre AND c.pre <= i.last_pre AND c.type = 'content' LEFT JOIN leaf_text l ON l.doc_id = c.doc_id AND l.node_id = c.node_id),
 cuts AS (SELECT *, CASE WHEN no = 1 THEN coalesce(length(regexp_extract(text, '^([ \\t]*(?:[•‣◦▪●○*]|[A-Za-z]\\.|[0-9]+\\.))[ \\t]+[^ \\t]', 1)), 0) ELSE 0 END AS cut, no = 1 AND coalesce(regexp_matches(trim(text), '^([•‣◦▪●○*]|[A-Za-z]\\.|[0-9]+\\.)$'), false) AS whole FROM under),
 dealt AS (SELECT doc_id, item, 'Lbl' AS part, leaf_id, 0 AS start FROM cuts WHERE cut > 0 OR whole UNION ALL SELECT doc_id, item, 'LBody', leaf_id, CAST(cut AS INT) FROM cuts WHERE cut > 0 OR NOT whole)"""
on_tree("list_item_content", lambda x_, w: s.list_item_content(x_, x_.filter("role = 'LI'"), w(_LABELLED)), f", items AS (SELECT * FROM tree WHERE role = 'LI'), {_DEALT.format('items')} SELECT * FROM dealt", ("leaf_text", _LABELLED))
on_tree("convert_to_items", lambda x_, w: s.convert_to_items(x_, x_.filter("node_id % 3 = 0").select("doc_id", "node_id"), w(_LABELLED)),
        f", sel AS (SELECT * FROM tree WHERE node_id % 3 = 0 AND depth > 0), top AS (SELECT * FROM sel WHERE NOT EXISTS (SELECT 1 FROM sel o WHERE o.doc_id = sel.doc_id AND o.node_id <> sel.node_id AND list_contains(sel.path, o.node_id))), {_DEALT.format('top')} SELECT top.doc_id, top.node_id AS item, type <> 'element' AS wrapped, part, leaf_id, start FROM top LEFT JOIN dealt ON dealt.doc_id = top.doc_id AND dealt.item = top.node_id", ("leaf_text", _LABELLED))
on_tree("generated_bookmarks", lambda x_, w: s.generated_bookmarks(x_, w(LEAF_TEXT)), f""", {_PULLED}, {_TITLES}, {_PAGE_OF}, h AS (SELECT *, CAST(substr(role, 2) AS INT) AS lev FROM tree JOIN page_of USING (doc_id, node_id) WHERE role IN {HEADS} AND page_no IS NOT NULL), ups AS (SELECT h.doc_id, h.node_id, h.pre, max_by(q.node_id, q.pre) AS parent FROM h LEFT JOIN h q ON q.doc_id = h.doc_id AND q.pre < h.pre AND q.lev < h.lev GROUP BY ALL)
 SELECT u.doc_id, u.node_id AS bookmark_id, u.parent, row_number() OVER (PARTITION BY u.doc_id, u.parent ORDER BY u.pre) - 1 AS ord, title, page_no FROM ups u JOIN titles USING (doc_id, node_id) JOIN page_of USING (doc_id, node_id)""", ("leaf_text", LEAF_TEXT))


# scripts
def _steps(x_, _):
    on = t.owners(x_).filter("mcid % 10 = 3").select("doc_id", "page", "mcid")
    done, _, _ = r.run_steps(x_, [{"type": "replace_role", "find": "Div", "put": "Sect"}, {"type": "scope_tables"}, {"type": "smartifact"}, {"type": "unheard"}, {"type": "shift_headings", "by": 1}], backgrounds=on)
    return done.select("doc_id", "node_id", "role")


on_tree("script_stops", _steps, "SELECT doc_id, node_id, CASE WHEN role = 'Div' THEN 'Sect' ELSE role END AS role FROM tree WHERE NOT coalesce(type = 'content' AND mcid % 10 = 3 AND page IS NOT NULL, false)")

# selections
on_tree("change_candidates", lambda x_, _: p.change_candidates(x_), "SELECT doc_id, node_id, actual_text AS text FROM tree WHERE type = 'element' AND role NOT IN ('Table', 'Document') AND trim(coalesce(actual_text, '')) <> ''")
on_tree("proofread_filtered", lambda x_, _: p.proofread_filtered(x_, p.filters(x_, a.empty_nodes(x_), _FLAGS(x_)), "flagged"), f""", {_FILTERS}, b AS (SELECT t.*, depth > 1 AND role NOT IN ('Lbl', 'Figure') AND (trim(coalesce(actual_text, '')) <> '' OR EXISTS (SELECT 1 FROM nodes c WHERE c.doc_id = t.doc_id AND c.parent_id = t.node_id AND c.type = 'content')) AS base FROM tree t WHERE type = 'element')
 SELECT doc_id, node_id FROM b WHERE base AND node_id % 5 = 0 AND NOT (lower(role) LIKE '%span%' AND EXISTS (SELECT 1 FROM b s WHERE s.doc_id = b.doc_id AND s.node_id <> b.node_id AND list_contains(b.path, s.node_id) AND (s.base OR s.role IN ('Lbl', 'Figure'))))""")
on_tree("live_proposals", lambda x_, _: p.live_proposals(x_, x_.filter("depth = 2").select("doc_id", F.when(F.col("node_id") % 3 == 0, F.col("node_id") + 7_000_000_000).otherwise(F.col("node_id")).alias("node_id"), F.when(F.col("node_id") % 2 == 0, F.coalesce("actual_text", F.lit(""))).otherwise("other").alias("suggested"))),
        "SELECT doc_id, node_id, coalesce(actual_text, '') AS suggested FROM tree WHERE depth = 2 AND type = 'element' AND node_id % 3 <> 0 AND (node_id % 2 = 0 OR actual_text = 'other')")
on_tree("find_text", lambda x_, w: p.find_nodes(x_, text="LAR", content=x.content_text(x_, w(LEAF_TEXT))), f", {_PULLED}, {_PAGE_OF} SELECT t.doc_id, t.node_id, role, page_no FROM tree t JOIN page_of USING (doc_id, node_id) LEFT JOIN pulled USING (doc_id, node_id) WHERE type = 'element' AND lower(concat_ws(chr(10), coalesce(actual_text, ''), coalesce(alt, ''), coalesce(pulled.text, ''))) LIKE '%lar%'", ("leaf_text", LEAF_TEXT))
on_tree("leaf_ids", lambda x_, _: t.leaf_ids(x_), "SELECT a.doc_id, anc AS node_id, string_agg(CAST(a.node_id AS VARCHAR), ',' ORDER BY a.pre) AS leaf_ids FROM anc a JOIN tree e ON e.doc_id = a.doc_id AND e.node_id = a.anc WHERE a.type IN ('content', 'object-ref') AND e.type = 'element' GROUP BY ALL")
on_tree("resolve_path", lambda x_, _: t.resolved_paths(x_.filter("node_id % 7 <> 1 OR type <> 'element'"), x_.filter("node_id % 3 = 0").select("doc_id", F.col("node_id").alias("key"), t.index_path().alias("index_path"))), "SELECT doc_id, node_id AS key, CASE WHEN type <> 'element' OR node_id % 7 <> 1 THEN node_id END AS node_id FROM tree WHERE node_id % 3 = 0")

"""Queries of tables, sources and column geometry, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry as g
from ..operators import tables as b
from ..operators.text import cell_text
from ..sources import documents as src
from .adapters import LEAF_TEXT, oracle, view
from .registry import register
from .tree_queries import on_tree

_ROWS = "SELECT CAST(s_nationkey AS BIGINT) AS doc_id, s_suppkey AS line, rpad(s_name, 24, ' ') || rpad(CAST(s_suppkey AS STRING), 16, ' ') || CAST(s_nationkey AS STRING) AS text FROM {supplier}"
_CELLS = """cells AS (SELECT c.doc_id, t.node_id AS tab, dense_rank() OVER (PARTITION BY c.doc_id, t.node_id ORDER BY r.ord, r.node_id) AS row_no, row_number() OVER (PARTITION BY c.doc_id, r.node_id ORDER BY c.ord, c.node_id) AS cell_no, c.node_id, c.role, c.col_span
 FROM tree c JOIN tree r ON r.doc_id = c.doc_id AND r.node_id = c.parent_id AND r.role = 'TR' JOIN tree t ON t.doc_id = r.doc_id AND t.node_id = r.parent_id AND t.role = 'Table' WHERE c.role IN ('TH', 'TD')),
 sat AS (SELECT *, coalesce(sum(col_span) OVER (PARTITION BY doc_id, tab, row_no ORDER BY cell_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS col_no, sum(col_span) OVER (PARTITION BY doc_id, tab, row_no) AS width FROM cells),
 placed AS (SELECT doc_id, tab, node_id, CAST(row_no AS INT) AS row_no, CAST(col_no AS INT) AS col_no, CAST(max(width) OVER (PARTITION BY doc_id, tab) AS INT) AS n_cols, CASE WHEN min(width) OVER (PARTITION BY doc_id, tab) <> max(width) OVER (PARTITION BY doc_id, tab) THEN 'ragged width' END AS error, col_span FROM sat)"""
on_tree("table_grid", lambda x, _: b.grid(b.cells(x)), f", {_CELLS} SELECT * EXCLUDE (col_span) FROM placed")
on_tree("table_block", lambda x, _: b.block(b.grid(b.cells(x)), (1, 1), (1, 2)), f", {_CELLS} SELECT doc_id, tab, node_id FROM placed WHERE row_no = 1 AND col_no BETWEEN 1 AND 2")
on_tree("toggle_headers", lambda x, _: b.toggled_headers(b.cells(x)), f", {_CELLS} SELECT doc_id, node_id, CASE WHEN bool_and(role = 'TH') OVER (PARTITION BY doc_id, tab) THEN 'TD' ELSE 'TH' END AS role FROM cells")
on_tree("delete_column", lambda x, _: b.without_column(b.grid(b.cells(x)), b.cells(x), 2), f", {_CELLS} SELECT doc_id, tab, node_id FROM placed WHERE NOT (col_no <= 2 AND col_no + col_span > 2)")
on_tree("add_row", lambda x, _: b.added_rows(b.cells(x)), f", {_CELLS} SELECT doc_id, tab, CAST(row_no + 1 AS INT) AS row_no, count(*) AS n_cells FROM cells c WHERE row_no = (SELECT max(row_no) FROM cells o WHERE o.doc_id = c.doc_id AND o.tab = c.tab) GROUP BY ALL")
_TEXTS = "texts AS (SELECT e.doc_id, e.node_id, string_agg(text, ' ' ORDER BY c.pre) AS text FROM tree e JOIN tree c ON c.doc_id = e.doc_id AND c.pre > e.pre AND c.pre <= e.last_pre JOIN leaf_text l ON l.doc_id = c.doc_id AND l.node_id = c.node_id WHERE e.role IN ('TH', 'TD') AND c.type = 'content' AND text <> '' GROUP BY ALL)"
on_tree("table_preview", lambda t, w: b.previews(b.grid(b.cells(t)), t, cell_text(t, w(LEAF_TEXT))), f", {_CELLS}, {_TEXTS} SELECT p.doc_id, tab, row_no, col_no, p.col_span, CASE t.scope WHEN 'Row' THEN '→ ' WHEN 'Column' THEN '↓ ' WHEN 'Both' THEN '↘ ' ELSE '' END || coalesce(text, '') AS shown FROM placed p JOIN tree t USING (doc_id, node_id) LEFT JOIN texts x USING (doc_id, node_id)", ("leaf_text", LEAF_TEXT))
_SIZES = "SELECT p_partkey AS tab, 1 + CAST(p_size % 3 AS INT) AS n_rows, 1 + CAST(p_partkey % 4 AS INT) AS n_cols FROM {part}"
_ROW_ID = lambda: F.col("tab") * 1000 + F.col("row_no") * 100
register("fill_table", lambda s, d: b.filled(b.plain_grid(view(s, d, _SIZES)).withColumn("doc_id", F.col("tab")).withColumn("col_span", F.lit(1)), _ROW_ID(), _ROW_ID() + F.col("col_no")),
         "WITH g AS (SELECT p_partkey AS tab, r, c FROM part, range(1, 4) x(r), range(1, 5) y(c) WHERE r <= 1 + p_size % 3 AND c <= 1 + p_partkey % 4) SELECT DISTINCT tab AS doc_id, tab * 1000 + r * 100 AS node_id, tab AS parent_id, r - 1 AS ord, 'TR' AS role, 1 AS col_span FROM g UNION ALL SELECT tab, tab * 1000 + r * 100 + c, tab * 1000 + r * 100, c - 1, CASE WHEN r = 1 THEN 'TH' ELSE 'TD' END, 1 FROM g")


def _table_blocks(t):
    """Of each table, with the span of a cell taken downwards too, the block around its first cell of the second row."""
    at = b.grid(b.cells(t)).join(b.cells(t).select("doc_id", "node_id", "col_span"), ["doc_id", "node_id"]).withColumn("row_span", F.col("col_span"))
    one = at.groupBy("doc_id", "tab").agg(F.max_by(F.struct("row_no", "col_no"), F.struct("row_no", "col_no")).alias("b"))
    return b.grown_blocks(at, one.select("doc_id", "tab", F.col("b.row_no").alias("r0"), F.col("b.row_no").alias("r1"), F.col("b.col_no").alias("c0"), F.col("b.col_no").alias("c1")))


# as many rounds as a table of the adapter has rows and columns
_GROWN = "".join(f""", g{i + 1} AS (SELECT b.doc_id, b.tab, least(b.r0, min(e.row_no)) AS r0, greatest(b.r1, max(e.row_no + e.col_span - 1)) AS r1, least(b.c0, min(e.col_no)) AS c0, greatest(b.c1, max(e.col_no + e.col_span - 1)) AS c1
 FROM g{i} b JOIN sat e ON e.doc_id = b.doc_id AND e.tab = b.tab AND e.row_no <= b.r1 AND e.row_no + e.col_span - 1 >= b.r0 AND e.col_no <= b.c1 AND e.col_no + e.col_span - 1 >= b.c0 GROUP BY b.doc_id, b.tab, b.r0, b.r1, b.c0, b.c1)""" for i in range(12))
on_tree("grown_blocks", lambda t, _: _table_blocks(t), f", {_CELLS}, g0 AS (SELECT doc_id, tab, max(row_no) AS r0, max(row_no) AS r1, max_by(col_no, row_no * 1000 + col_no) AS c0, max_by(col_no, row_no * 1000 + col_no) AS c1 FROM sat GROUP BY doc_id, tab){_GROWN} SELECT doc_id, tab, CAST(r0 AS INT) AS r0, CAST(r1 AS INT) AS r1, CAST(c0 AS INT) AS c0, CAST(c1 AS INT) AS c1 FROM g12")


def _glyph_cells(s, d):
    """Every character of supplier lines, 6 wide, in columns of 70 up to 200."""
    mid = F.col("seq") * 6.0 + 3
    return view(s, d, _ROWS).select(F.col("line").alias("leaf"), F.posexplode(F.split("text", "")).alias("seq", "text")).withColumn("cell", F.when(mid < 200, F.floor(mid / 70)).when(mid > 240, F.lit(9)))


register("cell_runs", lambda s, d: b.cell_runs(_glyph_cells(s, d)),
         f"""WITH z AS ({oracle(_ROWS)}), g AS (SELECT line AS leaf, i - 1 AS seq, substr(text, i, 1) AS ch, length(text) AS total FROM (SELECT line, text, unnest(range(1, length(text) + 1)) AS i FROM z)), p AS (SELECT *, CASE WHEN seq * 6 + 3 < 200 THEN CAST(floor((seq * 6 + 3) / 70) AS BIGINT) WHEN seq * 6 + 3 > 240 THEN 9 END AS own FROM g),
 q AS (SELECT *, (SELECT max(b.seq) FROM p b WHERE b.leaf = p.leaf AND b.ch <> ' ' AND b.seq <= p.seq) AS ink FROM p), r AS (SELECT q.*, CASE WHEN ch <> ' ' THEN own ELSE (SELECT min_by(b.own, b.seq) FROM p b WHERE b.leaf = q.leaf AND b.seq BETWEEN q.ink AND q.seq AND b.own IS NOT NULL) END AS cell FROM q),
 n AS (SELECT *, seq - row_number() OVER (PARTITION BY leaf, cell ORDER BY seq) AS isle FROM r WHERE cell IS NOT NULL) SELECT leaf, cell, CAST(min(seq) AS BIGINT) AS start, CAST(CASE WHEN max(seq) + 1 < min(total) THEN max(seq) + 1 END AS BIGINT) AS "end" FROM n GROUP BY leaf, cell, isle""")
register("plain_grid", lambda s, d: b.plain_grid(view(s, d, "SELECT p_partkey AS tab, 1 + CAST(p_size % 3 AS INT) AS n_rows, 1 + CAST(p_partkey % 4 AS INT) AS n_cols FROM {part}")),
         "SELECT p_partkey AS tab, CAST(r AS INT) AS row_no, CAST(c AS INT) AS col_no, CASE WHEN r = 1 THEN 'TH' ELSE 'TD' END AS role FROM part, range(1, 4) x(r), range(1, 5) y(c) WHERE r <= 1 + p_size % 3 AND c <= 1 + p_partkey % 4")
register("seed_columns", lambda s, d: g.column_dividers(g.phrases(g.glyphs(view(s, d, _ROWS)))),
         "WITH n AS (SELECT CAST(s_nationkey AS BIGINT) AS doc_id, max(length(s_name)) AS a, max(length(CAST(s_suppkey AS VARCHAR))) AS b FROM supplier GROUP BY ALL HAVING count(*) > 1) SELECT doc_id, CAST((a * 6 + 144) / 2.0 AS DOUBLE) AS x FROM n UNION ALL SELECT doc_id, CAST(((24 + b) * 6 + 240) / 2.0 AS DOUBLE) FROM n")
register("markup_nodes", lambda s, d: src.markup_nodes(s.read.parquet(f"{d}/pages.parquet")))
register("markup_paragraphs", lambda s, d: src.markup_nodes(s.read.parquet(f"{d}/pages.parquet")).filter("role = 'H1'").groupBy("doc_id").agg(F.count("*").alias("n")),
         "SELECT page_id AS doc_id, CAST(len(regexp_extract_all(html, '<h1[ >]')) AS BIGINT) AS n FROM pages WHERE html LIKE '%<h1%'")


def _trees(s, d):
    c = s.read.parquet(f"{d}/customer.parquet")
    return c.select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit('{"role":"Document","children":[{"role":"'), "c_mktsegment", F.lit('","children":[{"role":"P"}]},{"role":"Span","children":[]}]}')).alias("tree"))


register("nested_nodes", lambda s, d: src.nested_nodes(_trees(s, d)), "SELECT c_custkey AS doc_id, v.path AS path, CAST(v.ord AS INT) AS ord, CASE WHEN v.role = '' THEN c_mktsegment ELSE v.role END AS role FROM customer, (VALUES ('0', 0, 'Document'), ('0/0', 0, ''), ('0/0/0', 0, 'P'), ('0/1', 1, 'Span')) v(path, ord, role)")
register("command_log", lambda s, d: src.command_log(s.read.parquet(f"{d}/events.parquet").select(F.when(F.col("event_id") % 9 == 0, "{bad").otherwise(F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.lit(',"cmd":"'), "event_type", F.lit('"}'))).alias("value"))),
         """SELECT CASE WHEN event_id % 9 > 0 THEN event_id END AS id, CASE WHEN event_id % 9 > 0 THEN event_type END AS cmd, CASE WHEN event_id % 9 = 0 THEN '{bad' ELSE '{"id":' || event_id || ',"cmd":"' || event_type || '"}' END AS payload, event_id % 9 = 0 AS bad FROM events""")

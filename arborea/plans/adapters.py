"""Views of the given tables in the shape of a corpus of documents.

Each adapter is one SQL text that Spark and the oracle both run, with the tables' names as parameters. A customer is a
document; its orders and their lines become sections, headings, tables, lists, figures and links."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, TypeVar

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.tree import tree_keys
from ..sources.scratch import Dealt, drop, parts, written

T = TypeVar("T")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "benchmark", "conversations")

#: Lines of orders with their document and the role each line takes.
LINES = """
SELECT *, CASE WHEN rf = 'A' THEN 'LI' WHEN rf = 'R' THEN 'TR' WHEN ls = 'O' AND ln % 3 = 0 THEN 'H3' WHEN ls = 'O' AND ln % 3 = 1 THEN 'P' WHEN ls = 'O' THEN 'Figure' WHEN pk % 4 = 0 THEN 'Link' ELSE 'Span' END AS role
FROM (SELECT o_custkey AS doc_id, o_orderkey AS ok, CAST(l_linenumber AS BIGINT) AS ln, o_orderkey * 64 AS base, max(l_quantity) AS qty, max(l_discount) AS disc, max(l_tax) AS tax, max(l_partkey) AS pk, max(l_suppkey) AS sk,
             max(l_extendedprice) AS price, max(l_returnflag) AS rf, max(l_linestatus) AS ls
      FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY o_custkey, o_orderkey, l_linenumber) x
"""

_DEALT = "SELECT *, ok * 64 AS base FROM {order_lines}"

_ELEMENT = "'element' AS type, 'element' AS kind"
_NONE = "CAST(NULL AS STRING) AS alt, CAST(NULL AS STRING) AS actual_text, CAST(NULL AS STRING) AS scope, 1 AS col_span, FALSE AS has_bbox, CAST(NULL AS INT) AS own_page, CAST(NULL AS INT) AS mcid, CAST(NULL AS BIGINT) AS target_id"
NODES = f"""
WITH l AS ({LINES})
SELECT DISTINCT o_custkey AS doc_id, CAST(-2 AS BIGINT) AS node_id, CAST(NULL AS BIGINT) AS parent_id, CAST(0 AS BIGINT) AS ord, 'root' AS type, 'root' AS kind, CAST(NULL AS STRING) AS role, {_NONE} FROM {{orders}}
UNION ALL SELECT DISTINCT o_custkey, CAST(-1 AS BIGINT), CAST(-2 AS BIGINT), CAST(0 AS BIGINT), {_ELEMENT}, 'Document', {_NONE} FROM {{orders}}
UNION ALL SELECT o_custkey, o_orderkey * 64, CAST(-1 AS BIGINT), o_orderkey, {_ELEMENT},
       CASE o_orderpriority WHEN '1-URGENT' THEN 'H1' WHEN '2-HIGH' THEN 'H2' WHEN '3-MEDIUM' THEN 'Table' WHEN '4-NOT SPECIFIED' THEN 'L' ELSE 'Div' END,
       CAST(NULL AS STRING), CASE WHEN o_totalprice > 250000 THEN o_orderpriority WHEN o_totalprice > 220000 THEN ' ' END, CAST(NULL AS STRING), 1, FALSE,
       CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderkey % 7 AS INT) END, CAST(NULL AS INT), CAST(NULL AS BIGINT) FROM {{orders}}
UNION ALL SELECT doc_id, base + ln, base, ln, {_ELEMENT}, role, CASE WHEN role = 'Figure' AND tax >= 0.02 THEN CASE WHEN tax < 0.04 THEN ' ' ELSE 'picture' END END,
       CAST(NULL AS STRING), CAST(NULL AS STRING), 1, role = 'Figure' AND sk % 4 = 0, CASE WHEN ln = 5 THEN CAST(ok % 7 AS INT) + 1 END, CAST(NULL AS INT), CAST(NULL AS BIGINT) FROM l
UNION ALL SELECT doc_id, base + 16 + ln, base + ln, CAST(1 AS BIGINT), {_ELEMENT}, CASE WHEN ln = 1 OR tax > 0.05 THEN 'TH' ELSE 'TD' END, CAST(NULL AS STRING), CAST(NULL AS STRING), CASE WHEN tax > 0.06 THEN 'Row' END, CASE WHEN disc > 0.08 THEN 2 ELSE 1 END, FALSE, CAST(NULL AS INT), CAST(NULL AS INT), CAST(NULL AS BIGINT) FROM l WHERE role = 'TR'
UNION ALL SELECT doc_id, base + 24 + ln, base + ln, CAST(2 AS BIGINT), {_ELEMENT}, 'TD', CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), 1, FALSE, CAST(NULL AS INT), CAST(NULL AS INT), CAST(NULL AS BIGINT) FROM l WHERE role = 'TR' AND disc > 0.04
UNION ALL SELECT doc_id, base + 32 + ln, base + ln, CAST(1 AS BIGINT), {_ELEMENT}, 'Lbl', {_NONE} FROM l WHERE role = 'LI' AND ln % 2 = 0
UNION ALL SELECT doc_id, base + 40 + ln, base + ln, CAST(2 AS BIGINT), {_ELEMENT}, 'LBody', {_NONE} FROM l WHERE role = 'LI' AND tax > 0.02
UNION ALL SELECT doc_id, base + 48 + ln, base + ln, CAST(4 AS BIGINT), 'object-ref', 'content-dict', CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), 1, FALSE, CAST(NULL AS INT), CAST(NULL AS INT), base + ln FROM l WHERE role = 'Link' AND sk % 3 <> 0
UNION ALL SELECT doc_id, base + 8 + ln, CASE WHEN role = 'TR' THEN base + 16 + ln WHEN role = 'LI' AND tax > 0.02 THEN base + 40 + ln ELSE base + ln END, CAST(3 AS BIGINT), 'content',
       CASE WHEN tax > 0.07 THEN 'content-dict' ELSE 'content-int' END, CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), 1, FALSE, CASE WHEN tax > 0.07 THEN CAST(pk % 7 AS INT) END, CAST(ok % 100 * 8 + ln AS INT), CAST(NULL AS BIGINT) FROM l WHERE qty > 10
"""
#: Text of each leaf, keyed by the leaf's node id.
LEAF_TEXT = f"""
WITH l AS ({LINES}) SELECT doc_id, base + 8 + ln AS node_id, CASE WHEN ln % 4 = 0 THEN '' WHEN ln % 5 = 0 THEN '  a  ' || p_type ELSE p_name END AS text, pk % 2 = 0 AS has_image, pk % 3 = 0 AS has_vector
FROM l JOIN {{part}} ON pk = p_partkey WHERE qty > 10
"""
#: Instructions that paint each leaf: its span, the text, its end.
LEAF_OPS = f"""
WITH l AS ({LINES}) SELECT doc_id, CAST(CASE WHEN tax > 0.07 THEN pk % 7 WHEN ln = 5 THEN ok % 7 + 1 ELSE ok % 7 END AS INT) AS page, (ok * 8 + ln) * 4 + k AS op_idx, CASE k WHEN 0 THEN 'BDC' WHEN 1 THEN 'Tj' ELSE 'EMC' END AS op,
       CASE WHEN k = 0 THEN 'P' END AS tag, CASE WHEN k = 0 THEN CAST(ok % 100 * 8 + ln AS INT) END AS mcid, k = 1 AND pk % 3 > 0 AS visible FROM l CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) s WHERE qty > 10
"""
ANNOTATIONS = f"""
WITH l AS ({LINES}) SELECT doc_id, CAST(ok % 7 AS INT) AS page, base + ln AS annot_id, CASE WHEN sk % 2 = 0 THEN 'see ' || rf WHEN sk % 5 = 0 THEN ' ' END AS contents FROM l WHERE role IN ('Link', 'Span')
"""
DOC_INFO = """
SELECT c_custkey AS doc_id, CASE WHEN c_acctbal > 2000 THEN c_name WHEN c_acctbal > 0 THEN ' ' END AS title, CASE WHEN c_nationkey % 3 > 0 THEN 'en' END AS lang, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment END AS author,
       c_nationkey % 4 <> 0 AS marked_tagged, CASE WHEN c_nationkey % 5 = 0 THEN FALSE WHEN c_nationkey % 5 = 1 THEN TRUE END AS accessibility_permission,
       CASE WHEN c_mktsegment = 'BUILDING' THEN '1' END AS pdfua_part, c_custkey % 25 AS page_count, c_custkey % 13 <> 5 AS has_facts FROM {customer}
"""
DOC_PAGES = "SELECT DISTINCT o_custkey AS doc_id, CAST(o_orderkey % 7 AS INT) AS page, CASE WHEN o_orderkey % 7 > 2 THEN 'S' END AS tabs FROM {orders}"
OUTLINE = "SELECT o_custkey AS doc_id, o_orderkey AS bookmark_id, o_orderkey AS ord, CAST(o_orderkey % 7 AS INT) AS page FROM {orders} WHERE o_totalprice > 200000"
#: A page's instructions: events of a user in order of time.
OPS = """
SELECT user_id AS doc_id, event_id AS op_idx, CASE event_type WHEN 'signup' THEN 'BDC' WHEN 'error' THEN 'EMC' WHEN 'click' THEN 'q' WHEN 'purchase' THEN 'Tj' ELSE 'f' END AS op,
       CASE WHEN event_type = 'signup' THEN CASE WHEN event_id % 5 = 0 THEN 'Artifact' ELSE 'P' END END AS tag,
       CASE WHEN event_type = 'signup' AND event_id % 3 > 0 THEN CAST(event_id % 50 AS INT) END AS mcid, value FROM {events}
"""
#: The same with a page, and whether shown text has a visible glyph.
PAGE_OPS = OPS.replace("user_id AS doc_id", "user_id AS doc_id, CAST(event_id % 7 AS INT) AS page, value > 20 AS visible")
#: mcids that a tag claims.
CLAIMED = "SELECT DISTINCT user_id AS doc_id, CAST(event_id % 50 AS INT) AS mcid FROM {events} WHERE event_type = 'purchase'"
PAGE_CLAIMED = CLAIMED.replace("user_id AS doc_id", "user_id AS doc_id, CAST(event_id % 7 AS INT) AS page")
EDITS = """
SELECT user_id AS doc_id, event_id AS seq, ts, event_type AS cmd, CASE WHEN value > 50 THEN event_type END AS undo_group, event_type <> 'view' AS changes FROM {events}
"""
RECTS = """
SELECT p_partkey AS leaf_id, p_size % 7 AS page, p_partkey % 97 * 1.0 AS x, p_size * 1.0 AS y, 4.0 + p_size % 5 AS width, 3.0 + p_partkey % 4 AS height FROM {part}
"""
REGIONS = "SELECT n_nationkey AS region_id, CAST(n_nationkey % 7 AS INT) AS page, n_regionkey * 15.0 AS x, n_nationkey * 1.5 AS y, 30.0 AS width, 20.0 AS height FROM {nation}"

#: Lines in a bucket of documents; a line makes about three nodes.
BUCKET = 30_000

_held: dict[tuple[str, str, str, str], Any] = {}


def names() -> dict[str, str]:
    return {t: t for t in TABLES}


def view(spark: SparkSession, sf_dir: str, sql: str, **dealt: str) -> DataFrame:
    """An adapter over the tables of ``sf_dir``. What many adapters read, the lines of orders and the orders, lies in tables dealt by document.

    dealt: keys by table; these tables are dealt by them to as many tasks as the first one's rows ask for, so that joins and groups by the keys need no other shuffle."""
    lines = {"order_lines": _lines(spark, sf_dir)[0]} if LINES in sql and sql != LINES + " " else {}
    if lines:
        sql = sql.replace(LINES, _DEALT)
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    if dealt:
        n = parts(used[next(iter(dealt))])
        used |= {t: used[t].repartition(n, key) for t, key in dealt.items()}
    elif sql in (NODES.replace(LINES, _DEALT), DOC_PAGES, OUTLINE):
        used["orders"] = _orders(spark, sf_dir)
    return spark.sql(sql, **used, **lines)


def _lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """The lines of orders, joined once and dealt by document, and to how many buckets."""

    def make() -> tuple[DataFrame, int]:
        # no adapter reads the price; base follows from the order
        joined = written(view(spark, sf_dir, LINES + " ", lineitem="l_orderkey", orders="o_orderkey").drop("price", "base"), "joined")
        buckets = -(-joined.count() // BUCKET) or 1
        lines = Dealt(spark, "lines", "doc_id", buckets).add(joined, "doc_id", "ok", "ln")
        drop(joined)
        return lines, buckets

    return _once(spark, sf_dir, "lines", make)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders, dealt as their lines are."""
    return _once(spark, sf_dir, "orders", lambda: Dealt(spark, "orders", "o_custkey", _lines(spark, sf_dir)[1]).add(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_custkey", "o_orderkey"))


def oracle(sql: str) -> str:
    """An adapter as the oracle reads it."""
    return sql.format(**names())


def _once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], T]) -> T:
    """What ``make`` gives, made once for a session and state of the orders and their lines in the folder."""
    changed = [spark.read.parquet(f"{sf_dir}/{x}.parquet").agg(F.max("_metadata.file_modification_time")).first()[0] for x in ("orders", "lineitem")]
    key = (spark.sparkContext.applicationId, sf_dir, name, str(changed))
    if key not in _held:
        _held[key] = make()
    return _held[key]


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes with their tree keys, as every operator starts from them."""
    return _once(spark, sf_dir, "tree", lambda: tree_keys(view(spark, sf_dir, NODES), buckets=_lines(spark, sf_dir)[1]))


#: The same keys for the oracle, by recursion: path of ids and positions, depth, pre, last_pre, page, roles above, parent's role.
ORACLE_TREE = f"""
nodes AS ({oracle(NODES)}),
walk AS (SELECT *, [node_id] AS path, [ord] AS pos, 0 AS depth, CAST(NULL AS INT) AS up_page, '' AS roles, CAST(NULL AS VARCHAR) AS up_role, has_bbox AS sheltered FROM nodes WHERE parent_id IS NULL
         UNION ALL SELECT n.*, list_append(w.path, n.node_id), list_append(w.pos, n.ord), w.depth + 1, coalesce(w.own_page, w.up_page),
                CASE WHEN w.type = 'root' THEN '' WHEN w.roles = '' THEN coalesce(w.role, w.type) ELSE w.roles || ' > ' || coalesce(w.role, w.type) END, w.role, w.sheltered OR n.has_bbox
         FROM walk w JOIN nodes n ON n.doc_id = w.doc_id AND n.parent_id = w.node_id),
numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos, node_id) AS INT) AS pre,
             CASE WHEN kind = 'content-int' THEN up_page ELSE coalesce(own_page, up_page) END AS page FROM walk),
anc AS (SELECT doc_id, node_id, pre, depth, type, parent_id, page, unnest(path) AS anc FROM numbered),
ends AS (SELECT doc_id, anc AS node_id, max(pre) AS last_pre FROM anc GROUP BY doc_id, anc),
tree AS (SELECT numbered.*, last_pre FROM numbered JOIN ends USING (doc_id, node_id)),
empty AS (SELECT t.* FROM tree t WHERE type = 'element' AND NOT sheltered AND NOT EXISTS (SELECT 1 FROM tree c WHERE c.doc_id = t.doc_id AND c.pre BETWEEN t.pre AND t.last_pre AND (c.type IN ('content', 'object-ref') OR c.has_bbox)))
"""

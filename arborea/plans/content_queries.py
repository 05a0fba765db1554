"""Queries of instruction streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import content as c
from .adapters import CLAIMED, OPS, PAGE_CLAIMED, PAGE_OPS, oracle, view
from .registry import register

_DEEP = f"""ops AS ({oracle(OPS)}), claimed AS ({oracle(CLAIMED)}),
summed AS (SELECT *, sum(CASE WHEN op = 'BDC' THEN 1 WHEN op = 'EMC' THEN -1 ELSE 0 END) OVER w AS s FROM ops WINDOW w AS (PARTITION BY doc_id ORDER BY op_idx)),
floored AS (SELECT *, CAST(s - least(0, min(s) OVER (PARTITION BY doc_id ORDER BY op_idx)) AS INT) AS depth FROM summed),
deep AS (SELECT *, CAST(coalesce(lag(depth) OVER (PARTITION BY doc_id ORDER BY op_idx), 0) AS INT) AS depth_before FROM floored),
spans AS (SELECT doc_id, op_idx AS open_idx, (SELECT min(e.op_idx) FROM deep e WHERE e.doc_id = d.doc_id AND e.op_idx > d.op_idx AND e.op = 'EMC' AND e.depth = d.depth - 1 AND e.depth_before = d.depth) AS close_idx, depth AS level, tag, mcid FROM deep d WHERE op = 'BDC'),
paints AS (SELECT * FROM deep WHERE op IN ('Tj', 'f'))"""
_MCIDS = "mcids AS (SELECT DISTINCT doc_id, mcid FROM ops WHERE op = 'BDC' AND mcid IS NOT NULL AND tag <> 'Artifact' EXCEPT SELECT doc_id, mcid FROM claimed)"
_ORPHANS = "loose AS (SELECT doc_id, open_idx FROM spans s WHERE level = 1 AND close_idx IS NOT NULL AND mcid IS NULL AND tag <> 'Artifact' AND NOT EXISTS (SELECT 1 FROM spans i JOIN claimed USING (doc_id, mcid) WHERE i.doc_id = s.doc_id AND i.open_idx > s.open_idx AND i.open_idx < s.close_idx))"
_RUNS = "runs AS (SELECT doc_id, min(op_idx) AS first_paint, max(op_idx) AS last_paint, count(*) AS n_paints FROM (SELECT p.doc_id, p.op_idx, (SELECT count(*) FROM spans s WHERE s.doc_id = p.doc_id AND s.level = 1 AND s.open_idx < p.op_idx) + (SELECT count(*) FROM deep e WHERE e.doc_id = p.doc_id AND e.op = 'EMC' AND e.depth_before = 0 AND e.op_idx < p.op_idx) AS run FROM paints p WHERE depth = 0 AND depth_before = 0) GROUP BY doc_id, run)"
_ARTIFACTS = """outer_ AS (SELECT * FROM spans s WHERE tag = 'Artifact' AND close_idx IS NOT NULL AND NOT EXISTS (SELECT 1 FROM spans o WHERE o.doc_id = s.doc_id AND o.tag = 'Artifact' AND o.close_idx IS NOT NULL AND o.open_idx < s.open_idx AND o.close_idx > s.open_idx)),
arts AS (SELECT o.doc_id, open_idx, CASE WHEN count(DISTINCT op) > 1 THEN 'mixed' WHEN min(op) = 'Tj' THEN 'text' ELSE 'path' END AS kind, false AS truncated FROM outer_ o JOIN paints p ON p.doc_id = o.doc_id AND p.op_idx > o.open_idx AND p.op_idx < o.close_idx GROUP BY ALL)"""


#: The same streams page by page: the oracle's doc_id is eight times the document and the page.
PAGE_STREAMS = _DEEP.replace("user_id AS doc_id", "user_id * 8 + event_id % 7 AS doc_id")
_TOTALS = "n AS (SELECT doc_id, (SELECT count(*) FROM mcids m WHERE m.doc_id = d.doc_id) AS n_mcids, (SELECT count(*) FROM loose m WHERE m.doc_id = d.doc_id) AS n_spans, (SELECT count(*) FROM runs m WHERE m.doc_id = d.doc_id) AS n_runs FROM (SELECT DISTINCT doc_id FROM ops) d)"
PAGE_ORPHANS = f"{_MCIDS}, {_ORPHANS}, {_RUNS}, {_TOTALS.replace('n AS', 'per_page AS', 1)}, orphaned AS (SELECT doc_id // 8 AS doc_id, CAST(sum(n_mcids + n_spans + n_runs) AS BIGINT) AS total, count(*) AS n_pages FROM per_page WHERE n_mcids + n_spans + n_runs > 0 GROUP BY ALL)"
SHOWN = "shown AS (SELECT DISTINCT doc_id // 8 AS doc_id, doc_id % 8 AS page, mcid FROM (SELECT p.doc_id, p.op_idx, max_by(s.mcid, s.open_idx) AS mcid FROM paints p JOIN spans s ON s.doc_id = p.doc_id AND s.mcid IS NOT NULL AND s.open_idx < p.op_idx AND (s.close_idx IS NULL OR s.close_idx > p.op_idx) WHERE p.op = 'Tj' AND p.value > 20 GROUP BY ALL))"


def on_ops(name, run, sql=None):
    register(name, lambda s, d: run(view(s, d, OPS), view(s, d, CLAIMED)), sql and f"WITH {_DEEP} {sql}")


on_ops("span_depth", lambda o, k: c.with_depth(o).select("doc_id", "op_idx", "depth"), "SELECT doc_id, op_idx, depth FROM deep")
on_ops("span_matching", lambda o, k: c.spans(c.with_depth(o)).select("doc_id", "open_idx", "close_idx", "level"), "SELECT doc_id, open_idx, close_idx, level FROM spans")
on_ops("innermost_mcid", lambda o, k: c.innermost_mcid(c.with_depth(o), c.spans(c.with_depth(o))), "SELECT p.doc_id, op_idx, max_by(s.mcid, s.open_idx) AS mcid FROM paints p JOIN spans s ON s.doc_id = p.doc_id AND s.mcid IS NOT NULL AND s.open_idx < p.op_idx AND (s.close_idx IS NULL OR s.close_idx > p.op_idx) GROUP BY ALL")
on_ops("orphan_mcids", c.orphan_mcids, f", {_MCIDS} SELECT * FROM mcids")
on_ops("orphan_regions", lambda o, k: c.orphan_spans(c.spans(c.with_depth(o)), k), f", {_ORPHANS} SELECT * FROM loose")
on_ops("unwrapped_runs", lambda o, k: c.unwrapped_runs(c.with_depth(o)), f", {_RUNS} SELECT * FROM runs")
on_ops("orphan_totals", c.orphan_totals, f", {_MCIDS}, {_ORPHANS}, {_RUNS}, {_TOTALS} SELECT *, n_mcids + n_spans + n_runs AS total FROM n WHERE n_mcids + n_spans + n_runs > 0")
register("orphaned_content", lambda s, d: c.orphans_by_document(view(s, d, PAGE_OPS), view(s, d, PAGE_CLAIMED)), f"WITH {PAGE_STREAMS}, {PAGE_ORPHANS} SELECT * FROM orphaned")
register("shown_text", lambda s, d: c.shown_text(view(s, d, PAGE_OPS)), f"WITH {PAGE_STREAMS}, {SHOWN} SELECT doc_id, CAST(page AS INT) AS page, mcid FROM shown")
on_ops("repair_orphans", lambda o, k: c.repaired(o, k).groupBy("doc_id").agg(F.count("*").alias("n_ops"), F.count_if(F.col("tag") == "Artifact").alias("n_artifacts")), f", {_MCIDS}, {_ORPHANS}, {_RUNS} SELECT doc_id, count(*) + 2 * (SELECT count(*) FROM runs r WHERE r.doc_id = o.doc_id) AS n_ops, count(*) FILTER (tag = 'Artifact') + (SELECT count(*) FROM runs r WHERE r.doc_id = o.doc_id) + (SELECT count(*) FROM loose r WHERE r.doc_id = o.doc_id) + (SELECT count(*) FROM spans s JOIN mcids USING (doc_id, mcid) WHERE s.doc_id = o.doc_id AND s.tag <> 'Artifact') AS n_artifacts FROM ops o GROUP BY doc_id")
on_ops("repair_is_final", lambda o, k: c.repaired(c.repaired(o, k), k).groupBy("doc_id").agg(F.count("*").alias("n_ops")), f", {_RUNS} SELECT doc_id, count(*) + 2 * (SELECT count(*) FROM runs r WHERE r.doc_id = o.doc_id) AS n_ops FROM ops o GROUP BY doc_id")
on_ops("artifact_list", lambda o, k: c.artifacts(c.with_depth(o), c.spans(c.with_depth(o))), f", {_ARTIFACTS} SELECT * FROM arts")
_TARGETS = lambda o: o.filter("op = 'BDC' AND tag = 'Artifact'").groupBy("doc_id").agg(F.min("op_idx").alias("open_idx"))
_NEXT = lambda o: o.filter("mcid IS NOT NULL").groupBy("doc_id").agg((F.max("mcid") + 1).alias("mcid"))
on_ops("restore_artifacts", lambda o, k: c.restored(c.artifacts(c.with_depth(o), c.spans(c.with_depth(o))), _TARGETS(o), _NEXT(o)), f", {_ARTIFACTS}, t AS (SELECT doc_id, min(op_idx) AS open_idx FROM ops WHERE op = 'BDC' AND tag = 'Artifact' GROUP BY doc_id) SELECT t.doc_id, t.open_idx, CAST(coalesce((SELECT max(mcid) + 1 FROM ops o WHERE o.doc_id = t.doc_id), 0) AS INT) AS mcid FROM t JOIN arts USING (doc_id, open_idx)")


def _restored(ops):
    arts = c.artifacts(c.with_depth(ops), c.spans(c.with_depth(ops))).select("doc_id", "open_idx")
    pages = arts.withColumn("page", (F.col("open_idx") % 2).cast("int"))
    return c.restored_elements(c.restored(arts, arts, _NEXT(ops)), pages, arts.select("doc_id").distinct().withColumn("node_id", F.lit(-1).cast("long")), F.lit(1_000_000_000_000) + F.col("doc_id"), F.lit(2_000_000_000_000) + F.col("open_idx"))


on_ops("restored_elements", lambda o, _: _restored(o), f""", {_ARTIFACTS}, r AS (SELECT doc_id, open_idx, row_number() OVER w - 1 AS n, CAST(open_idx % 2 AS INT) AS page, first_value(CAST(open_idx % 2 AS INT)) OVER w AS pp FROM arts WINDOW w AS (PARTITION BY doc_id ORDER BY open_idx))
 SELECT doc_id, 1000000000000 + doc_id AS node_id, -1 AS parent_id, 4611686018427387904 AS ord, 'element' AS type, 'element' AS kind, 'P' AS role, pp AS own_page, CAST(NULL AS INT) AS mcid FROM r WHERE n = 0
 UNION ALL SELECT doc_id, 2000000000000 + open_idx, 1000000000000 + doc_id, n, 'content', CASE WHEN page <> pp THEN 'content-dict' ELSE 'content-int' END, NULL, CASE WHEN page <> pp THEN page END, CAST(coalesce((SELECT max(mcid) + 1 FROM ops o WHERE o.doc_id = r.doc_id), 0) + n AS INT) FROM r""")

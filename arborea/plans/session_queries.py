"""Queries over edits, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import edits as e
from ..streaming import refresh as r
from .adapters import EDITS, oracle, view
from .registry import register
from .tree_queries import _INFO, _PARTS, _REPORT, _report, on_tree

_E = f"edits AS ({oracle(EDITS)})"


def on_edits(name, run, sql=None):
    register(name, lambda s, d: run(view(s, d, EDITS)), sql and f"WITH RECURSIVE {_E} {sql}")


on_edits("edit_sessions", e.sessions, ", g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY doc_id ORDER BY ts, seq) < INTERVAL 120 SECOND THEN 0 ELSE 1 END AS new FROM edits), s AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY ts, seq) AS n FROM g) SELECT doc_id, min(ts) AS start, max(ts) AS last, count(*) AS n_edits, count(*) FILTER (changes) AS n_changes FROM s GROUP BY doc_id, n")
on_edits("autosave_ticks", e.autosave_ticks, "SELECT doc_id, time_bucket(INTERVAL 2 MINUTE, ts) + INTERVAL 2 MINUTE AS tick, max_by(seq, {'ts': ts, 'seq': seq}) AS seq FROM edits WHERE changes GROUP BY ALL")
_STEPS = "f AS (SELECT *, CASE WHEN undo_group = lag(undo_group) OVER (PARTITION BY doc_id ORDER BY seq) THEN 0 ELSE 1 END AS new FROM edits WHERE changes), n AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY seq) AS step FROM f), steps AS (SELECT doc_id, CAST(step AS BIGINT) AS step, min(undo_group) AS undo_group, min(seq) AS first_seq, count(*) AS n_edits FROM n GROUP BY doc_id, step QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY step DESC) <= 50)"
on_edits("undo_steps", e.undo_steps, f", {_STEPS} SELECT * FROM steps")
on_edits("undo_owner", e.undo_owner, f", {_STEPS} SELECT s.doc_id, s.undo_group FROM steps s WHERE step = (SELECT max(step) FROM steps o WHERE o.doc_id = s.doc_id)")
on_edits("latest_tokens", lambda x: e.latest_tokens(x.select("doc_id", "seq", (F.col("seq") % 17).alias("token"))), "SELECT doc_id, seq, token FROM (SELECT doc_id, seq, seq % 17 AS token, max(seq % 17) OVER (PARTITION BY doc_id ORDER BY seq) AS newest FROM edits) WHERE token >= newest")
_RENUMBER = lambda x: x.filter("cmd = 'signup'").select("doc_id", F.col("seq").alias("revision"), (F.col("seq") % 40).alias("boundary"))
on_edits("stale_edits", lambda x: e.stale_edits(x.select("doc_id", "seq", (F.col("seq") - 20).alias("revision"), (F.col("seq") % 50).alias("node_id")), _RENUMBER(x)),
         ", r AS (SELECT doc_id, seq AS revision, seq % 40 AS boundary, row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) AS n, count(*) OVER (PARTITION BY doc_id) AS total FROM edits WHERE cmd = 'signup'), h AS (SELECT doc_id, max(revision) AS newest, min(revision) AS oldest, max(total) AS total FROM r WHERE n <= 500 GROUP BY doc_id) SELECT e.doc_id, e.seq, CASE WHEN e.seq - 20 > coalesce(newest, 0) THEN 'future' WHEN total > 500 AND e.seq - 20 < oldest - 1 THEN 'stale' WHEN e.seq % 50 >= (SELECT min(boundary) FROM r WHERE r.doc_id = e.doc_id AND n <= 500 AND r.revision > e.seq - 20) THEN 'stale' ELSE 'fresh' END AS verdict FROM edits e LEFT JOIN h USING (doc_id)")
# renumberings and edits in one; an edit is judged by what came before it
_EVENTS = lambda x: x.select("doc_id", "seq", F.when(F.col("cmd") == "signup", "renumbering").otherwise("edit").alias("kind"), F.when(F.col("cmd") == "signup", F.col("seq")).otherwise(F.col("seq") - 40).alias("revision"), (F.col("seq") % 40).alias("boundary"), (F.col("seq") % 50).alias("node_id"))
on_edits("judged_edits", lambda x: e.judged_edits(_EVENTS(x)),
         """, r AS (SELECT doc_id, seq AS revision, seq % 40 AS boundary, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS n FROM edits WHERE cmd = 'signup'), x AS (SELECT e.doc_id, e.seq, e.seq - 40 AS revision, e.seq % 50 AS node_id, (SELECT max(n) FROM r WHERE r.doc_id = e.doc_id AND r.revision < e.seq) AS total FROM edits e WHERE cmd <> 'signup')
 SELECT doc_id, seq, CASE WHEN revision > coalesce((SELECT r.revision FROM r WHERE r.doc_id = x.doc_id AND r.n = total), 0) THEN 'future' WHEN total > 500 AND revision < (SELECT r.revision FROM r WHERE r.doc_id = x.doc_id AND r.n = total - 499) - 1 THEN 'stale'
  WHEN EXISTS (SELECT 1 FROM r WHERE r.doc_id = x.doc_id AND r.n <= total AND r.n > total - 500 AND r.revision > x.revision AND r.boundary <= x.node_id) THEN 'stale' ELSE 'fresh' END AS verdict FROM x""")
# calls at ten thousand times their pace, so that sessions hold several
_CALLED = lambda x: x.select("doc_id", "seq", F.timestamp_micros(F.expr("unix_micros(CAST(ts AS TIMESTAMP)) div 10000")).cast("timestamp_ntz").alias("ts"), F.when(F.col("cmd") == "signup", "begin").when((F.col("cmd") == "error") & (F.col("seq") % 3 > 0), F.when(F.col("seq") % 3 == 1, "end").otherwise("stop")).when(F.col("cmd") == "purchase", "delete").when(F.col("cmd") == "click", "edit").otherwise("read").alias("cmd"), (F.col("seq") % 7).alias("node_id"))
on_edits("call_sessions", lambda x: e.call_sessions(_CALLED(x)),
         """, c AS (SELECT doc_id, seq, make_timestamp(epoch_us(ts) // 10000) AS ts, CASE WHEN cmd = 'signup' THEN 'begin' WHEN cmd = 'error' AND seq % 3 = 1 THEN 'end' WHEN cmd = 'error' AND seq % 3 = 2 THEN 'stop' WHEN cmd = 'purchase' THEN 'delete' WHEN cmd = 'click' THEN 'edit' ELSE 'read' END AS cmd, seq % 7 AS node_id FROM edits),
 n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ts, seq) AS k FROM c),
 s AS (SELECT doc_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS TIMESTAMP) AS ts, CAST(NULL AS VARCHAR) AS cmd, CAST(NULL AS BIGINT) AS node_id, CAST(NULL AS TIMESTAMP) AS begun FROM (SELECT DISTINCT doc_id FROM n) d
  UNION ALL SELECT n.doc_id, n.k, n.ts, n.cmd, n.node_id, CASE WHEN s.begun IS NOT NULL AND s.cmd NOT IN ('end', 'stop') AND n.ts - s.ts < INTERVAL 120 SECOND THEN s.begun WHEN n.cmd = 'begin' THEN n.ts END FROM s JOIN n ON n.doc_id = s.doc_id AND n.k = s.k + 1),
 b AS (SELECT *, sum(CASE WHEN cmd = 'begin' AND begun = ts AND (prior IS NULL OR prior IS DISTINCT FROM begun OR pcmd IN ('end', 'stop') OR gap) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS no FROM (SELECT *, lag(begun) OVER w AS prior, lag(cmd) OVER w AS pcmd, ts - lag(ts) OVER w >= INTERVAL 120 SECOND AS gap FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY k)) z WHERE begun IS NOT NULL)
 SELECT doc_id, min(ts) AS start, CASE WHEN max_by(cmd, k) IN ('end', 'stop') THEN max(ts) ELSE max(ts) + INTERVAL 120 SECOND END AS stop, CASE max_by(cmd, k) WHEN 'end' THEN 'ended' WHEN 'stop' THEN 'stopped' ELSE 'quiet' END AS reason, count(*) FILTER (cmd IN ('edit', 'delete')) AS n_edits, count(DISTINCT CASE WHEN cmd = 'edit' THEN node_id END) AS n_touched, count(*) FILTER (cmd = 'delete') AS n_deleted FROM b GROUP BY doc_id, no""")
on_edits("undo_redo", lambda x: e.undo_redo(x.withColumn("cmd", F.when(F.col("cmd") == "error", "undo").when(F.col("cmd") == "click", "redo").otherwise("edit"))),
         """, c AS (SELECT doc_id, seq, CASE cmd WHEN 'error' THEN 'undo' WHEN 'click' THEN 'redo' ELSE 'edit' END AS cmd, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS k FROM edits),
 s AS (SELECT doc_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS seq, CAST([] AS BIGINT[]) AS u, CAST([] AS BIGINT[]) AS r, false AS refused FROM (SELECT DISTINCT doc_id FROM c) d
  UNION ALL SELECT c.doc_id, c.k, c.seq, CASE c.cmd WHEN 'undo' THEN u[:-2] WHEN 'redo' THEN CASE WHEN len(r) > 0 THEN list_append(u, r[-1]) ELSE u END ELSE list_append(u, c.seq)[-50:] END,
   CASE c.cmd WHEN 'undo' THEN CASE WHEN len(u) > 0 THEN list_append(r, u[-1]) ELSE r END WHEN 'redo' THEN r[:-2] ELSE [] END, (c.cmd = 'undo' AND len(u) = 0) OR (c.cmd = 'redo' AND len(r) = 0) FROM s JOIN c ON c.doc_id = s.doc_id AND c.k = s.k + 1)
 SELECT doc_id, seq, u[-1] AS version, CAST(len(u) AS INT) AS n_undo, CAST(len(r) AS INT) AS n_redo, refused FROM s WHERE k > 0""")
on_edits("rolling_timings", lambda x: e.rolling_timings(x.select(F.col("seq").alias("run_id"), "ts", F.col("cmd").alias("provider"))), "SELECT seq AS run_id, ts, cmd AS provider FROM edits ORDER BY ts DESC, seq DESC LIMIT 50")
on_edits("newest_results", lambda x: r.newest(x.select("doc_id", (F.col("seq") % 3).alias("node_id"), (F.col("seq") % 17).alias("token"), "seq")), "SELECT doc_id, seq % 3 AS node_id, seq % 17 AS token, seq FROM edits QUALIFY row_number() OVER (PARTITION BY doc_id, seq % 3 ORDER BY seq % 17 DESC, seq DESC) = 1")


def _saved(tree, look):
    saved = r.saved_documents(look(EDITS), "purchase")
    only = lambda df: df.join(saved, "doc_id", "left_semi")
    return r.refreshed(None, saved, lambda docs: _report(only(tree), lambda sql: only(look(sql))))


on_tree("saved_audit", _saved, f"{_REPORT} SELECT doc_id, check_id, status, CAST(n AS BIGINT) AS n FROM report WHERE doc_id IN (SELECT doc_id FROM edits WHERE cmd = 'purchase')", *_PARTS, *_INFO, ("edits", EDITS))

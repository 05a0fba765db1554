"""Edits (doc_id, seq, ts, cmd, undo_group, changes) as a stream or a table.

Event time has a watermark of ``LATE``; later edits are dropped by the windowed operators. A function that takes a
DataFrame works on either kind unless it says otherwise."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.fold import fold

LATE, IDLE, AUTOSAVE = "10 minutes", "120 seconds", "2 minutes"
#: Undo steps kept of a document.
KEPT = 50


def _timed(edits: DataFrame) -> DataFrame:
    return edits.withWatermark("ts", LATE) if edits.isStreaming else edits


def sessions(edits: DataFrame, idle: str = IDLE) -> DataFrame:
    """doc_id, start, last, n_edits, n_changes: a session ends when a document has been idle."""
    s = _timed(edits).groupBy("doc_id", F.session_window("ts", idle).alias("w"))
    return s.agg(F.max("ts").alias("last"), F.count("*").alias("n_edits"), F.count_if("changes").alias("n_changes")).select("doc_id", F.col("w.start").alias("start"), "last", "n_edits", "n_changes")


def autosave_ticks(edits: DataFrame, every: str = AUTOSAVE) -> DataFrame:
    """doc_id, tick, seq: at each tick the last version of a document that has unsaved work."""
    s = _timed(edits).filter("changes").groupBy("doc_id", F.window("ts", every).alias("w"))
    return s.agg(F.max_by("seq", F.struct("ts", "seq")).alias("seq")).select("doc_id", F.col("w.end").alias("tick"), "seq")


def undo_steps(edits: DataFrame, kept: int = KEPT) -> DataFrame:
    """doc_id, step, undo_group, first_seq, n_edits: edits in a row with one group share a step, any other is its own; the last ones. (Table.)"""
    w = Window.partitionBy("doc_id").orderBy("seq")
    e = edits.filter("changes").withColumn("new", (~F.coalesce(F.col("undo_group") == F.lag("undo_group").over(w), F.lit(False))).cast("int"))
    e = e.withColumn("step", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = e.groupBy("doc_id", "step").agg(F.first("undo_group").alias("undo_group"), F.min("seq").alias("first_seq"), F.count("*").alias("n_edits"))
    last = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("step")))
    return s.withColumn("back", last).filter(F.col("back") <= kept).drop("back")


_STEP = "doc_id long, step long, undo_group string, first_seq long, n_edits long"


def undo_steps_stream(edits: DataFrame) -> DataFrame:
    """``undo_steps`` of a stream, in update mode: a step's row comes again, with its new count, whenever an edit joins it. The state of a
    document is its top step; rows of edits must come in order of seq."""

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        number, group, first, n = state.get if state.exists else (0, None, None, 0)
        changed: dict[int, tuple] = {}
        for r in pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
            own = None if pd.isna(r.undo_group) else r.undo_group
            if number and own is not None and own == group:
                n += 1
            else:
                number, group, first, n = number + 1, own, int(r.seq), 1
            changed[number] = (key[0], number, group, first, n)
        state.update((number, group, first, n))
        yield pd.DataFrame(list(changed.values()), columns=[c.split()[0] for c in _STEP.split(", ")], dtype=object)

    return edits.filter("changes").select("doc_id", "seq", "undo_group").groupBy("doc_id").applyInPandasWithState(step, _STEP, "step long, undo_group string, first_seq long, n_edits long", "update", "NoTimeout")


def undo_owner(edits: DataFrame) -> DataFrame:
    """doc_id, undo_group of the top step. (Table.)"""
    return undo_steps(edits).groupBy("doc_id").agg(F.max_by("undo_group", "step").alias("undo_group"))


def latest_tokens(results: DataFrame) -> DataFrame:
    """doc_id, token, seq: results (doc_id, node, token, seq) whose token is older than one seen before are dropped. (Table.)"""
    w = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return results.withColumn("newest", F.max("token").over(w)).filter("token >= newest").drop("newest")


def stale_edits(edits: DataFrame, renumberings: DataFrame, kept: int = 500) -> DataFrame:
    """doc_id, seq, verdict of edits (doc_id, seq, revision, node_id) against renumberings (doc_id, revision, boundary): 'future' beyond the
    newest revision, 'stale' where a later renumbering reaches the id or is forgotten, else 'fresh'. (Table.)"""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("revision")))
    r = renumberings.withColumn("n", n)
    held = r.filter(F.col("n") <= kept).groupBy("doc_id").agg(F.max("revision").alias("newest"), F.min("revision").alias("oldest"), F.max("n").alias("held"), F.array_sort(F.collect_list(F.struct("revision", "boundary"))).alias("log"))
    total = r.groupBy("doc_id").agg(F.count("*").alias("total"))
    e = edits.join(held, "doc_id", "left").join(total, "doc_id", "left")
    low = F.array_min(F.transform(F.filter("log", lambda x: x["revision"] > F.col("revision")), lambda x: x["boundary"]))
    v = F.when(F.col("revision") > F.coalesce("newest", F.lit(0)), "future").when((F.col("total") > kept) & (F.col("revision") < F.col("oldest") - 1), "stale").when(F.col("node_id") >= low, "stale").otherwise("fresh")
    return e.select("doc_id", "seq", v.alias("verdict"))


_VERDICT = "doc_id long, seq long, verdict string"


class _Renumberings:
    """A document's last renumberings (revision, boundary), and verdicts against them."""

    def __init__(self, kept: int, log: list[tuple[int, int]] | None = None, total: int = 0):
        self.kept, self.log, self.total = kept, log or [], total

    def verdict(self, revision: int, node_id: int) -> str:
        newest = self.log[-1][0] if self.log else 0
        if revision > newest:
            return "future"
        if self.total > self.kept and revision < self.log[0][0] - 1:
            return "stale"
        return "stale" if any(boundary <= node_id for at, boundary in self.log if at > revision) else "fresh"

    def add(self, r):
        if r.kind == "renumbering":
            self.log = [*self.log, (int(r.revision), int(r.boundary))][-self.kept :]
            self.total += 1
            return []
        return [(int(r.doc_id), int(r.seq), self.verdict(int(r.revision), int(r.node_id)))]

    def end(self, key):
        return ()


def judged_edits(events: DataFrame, kept: int = 500) -> DataFrame:
    """doc_id, seq, verdict of edits as by ``stale_edits``, each against the renumberings that came before it.

    events: doc_id, seq, kind ('renumbering' or 'edit'), revision, boundary (of a renumbering), node_id (of an edit): two streams, or tables, in one. State of a
    document: its last ``kept`` renumberings. On a stream the rows of a document must come in order of seq."""
    e = events.select("doc_id", "seq", "kind", "revision", "boundary", "node_id")
    if not events.isStreaming:
        return fold(e, ["doc_id"], ["seq"], lambda: _Renumberings(kept), _VERDICT)

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        revisions, boundaries, total = state.get if state.exists else ([], [], 0)
        own = _Renumberings(kept, list(zip(revisions, boundaries)), total)
        rows = [x for r in pd.concat(list(batches)).sort_values("seq").itertuples(index=False) for x in own.add(r)]
        state.update(([r for r, _ in own.log], [b for _, b in own.log], own.total))
        yield pd.DataFrame(rows, columns=["doc_id", "seq", "verdict"])

    return e.groupBy("doc_id").applyInPandasWithState(step, _VERDICT, "revisions array<long>, boundaries array<long>, total long", "append", "NoTimeout")


def undo_owner_stream(edits: DataFrame) -> DataFrame:
    """``undo_owner`` of a stream, in update mode: the group of a document's top step is that of its last change."""

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seq, group = state.get if state.exists else (-1, None)
        pdf = pd.concat(list(batches))
        last = pdf.loc[pdf["seq"].idxmax()]
        if last["seq"] > seq:
            seq, group = int(last["seq"]), None if pd.isna(last["undo_group"]) else last["undo_group"]
        state.update((seq, group))
        yield pd.DataFrame({"doc_id": [key[0]], "undo_group": [group]}, dtype=object)

    return edits.filter("changes").select("doc_id", "seq", "undo_group").groupBy("doc_id").applyInPandasWithState(step, "doc_id long, undo_group string", "seq long, undo_group string", "update", "NoTimeout")


# sessions with a beginning and an end

_SESSION = "doc_id long, start timestamp, stop timestamp, reason string, n_edits long, n_touched long, n_deleted long"
_CALLS = ("doc_id", "seq", "ts", "cmd", "node_id")
ENDS = {"end": "ended", "stop": "stopped"}


def call_sessions(calls: DataFrame, idle: int = 120) -> DataFrame:
    """doc_id, start, stop, reason, n_edits, n_touched, n_deleted: editing sessions from calls (doc_id, seq, ts, cmd, node_id).

    A session opens with 'begin' and closes with 'end' or 'stop' ('ended', 'stopped'), or ``idle`` seconds after the last call of any kind ('quiet'; stop is
    then). A 'begin' in an open session is a call like others. 'edit' and 'delete' count in an open session alone: edits, different tags touched by
    edits, and tags deleted. On a stream calls may come late within the watermark: they wait in a document's state until their
    turn, and a session is given out once it has closed."""
    c = calls.select(*_CALLS)
    if calls.isStreaming:
        return _call_sessions_stream(_timed(c.withColumn("ts", F.col("ts").cast("timestamp"))), idle)
    w = Window.partitionBy("doc_id").orderBy("ts", "seq")
    after = F.coalesce((F.col("ts") >= F.lag("ts").over(w) + F.expr(f"INTERVAL {idle} SECONDS")) | F.lag("cmd").over(w).isin(*ENDS), F.lit(False))
    c = c.withColumn("stretch", F.sum(after.cast("int")).over(w))
    inside = Window.partitionBy("doc_id", "stretch").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("open", F.max((F.col("cmd") == "begin").cast("int")).over(inside) == 1).filter("open")
    last = F.max_by("cmd", F.struct("ts", "seq"))
    g = c.groupBy("doc_id", "stretch").agg(
        F.min("ts").alias("start"), F.max("ts").alias("last"), last.alias("cmd"), F.count_if(F.col("cmd").isin("edit", "delete")).alias("n_edits"),
        F.count_distinct(F.when(F.col("cmd") == "edit", F.col("node_id"))).alias("n_touched"), F.count_if(F.col("cmd") == "delete").alias("n_deleted"))
    ended = F.col("cmd").isin(*ENDS)
    return g.select("doc_id", "start", F.when(ended, F.col("last")).otherwise(F.col("last") + F.expr(f"INTERVAL {idle} SECONDS")).alias("stop"), F.when(F.col("cmd") == "end", "ended").when(ended, "stopped").otherwise("quiet").alias("reason"), "n_edits", "n_touched", "n_deleted")


class _OpenSession:
    """A document's calls that wait for their turn, and its open session, in milliseconds."""

    def __init__(self, waiting, opened):
        self.waiting, self.open = waiting, opened  # [(ms, seq, cmd, node)], None or [start, last, edits, touched, deleted]

    def upto(self, now: int, idle: int):
        """Sessions that have closed by ``now``, of calls up to then in order."""
        self.waiting.sort()
        done = [c for c in self.waiting if c[0] <= now]
        self.waiting = self.waiting[len(done) :]
        for ms, _, cmd, node in done:
            yield from self.quiet(ms, idle)
            if self.open is None:
                if cmd != "begin":
                    continue
                self.open = [ms, ms, 0, set(), 0]
            self.open[1] = ms
            if cmd in ("edit", "delete"):
                self.open[2] += 1
                self.open[4] += cmd == "delete"
                if cmd == "edit" and node is not None:
                    self.open[3].add(node)
            if cmd in ENDS:
                yield self.close(ms, ENDS[cmd])
        yield from self.quiet(now, idle)

    def quiet(self, now: int, idle: int):
        if self.open and now - self.open[1] >= idle:
            yield self.close(self.open[1] + idle, "quiet")

    def close(self, at: int, why: str):
        start, _, edits, touched, deleted = self.open
        self.open = None
        return pd.Timestamp(start, unit="ms"), pd.Timestamp(at, unit="ms"), why, edits, len(touched), deleted


def _call_sessions_stream(calls: DataFrame, idle: int) -> DataFrame:
    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        ms, seqs, cmds, nodes, opened, touched = state.get if state.exists else ([], [], [], [], [], [])
        s = _OpenSession(list(zip(ms, seqs, cmds, nodes)), [*opened[:3], set(touched), opened[3]] if opened else None)
        if not state.hasTimedOut:
            for pdf in batches:
                s.waiting += [(int(t.value // 1_000_000), int(q), c, None if pd.isna(n) else int(n)) for t, q, c, n in zip(pdf["ts"], pdf["seq"], pdf["cmd"], pdf["node_id"])]
        now = state.getCurrentWatermarkMs()
        rows = list(s.upto(now, idle * 1000))
        if s.waiting or s.open:
            w = list(zip(*s.waiting)) if s.waiting else [[], [], [], []]
            o = s.open
            state.update((list(w[0]), list(w[1]), list(w[2]), list(w[3]), [o[0], o[1], o[2], o[4]] if o else [], sorted(o[3]) if o else []))
            turn = min([*(x[0] for x in s.waiting), *([o[1] + idle * 1000] if o else [])])
            state.setTimeoutTimestamp(max(turn, now + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(key[0], *r) for r in rows], columns=[x.split()[0] for x in _SESSION.split(", ")])

    state = "ms array<long>, seqs array<long>, cmds array<string>, nodes array<long>, opened array<long>, touched array<long>"
    return calls.groupBy("doc_id").applyInPandasWithState(step, _SESSION, state, "append", "EventTimeTimeout")


def rolling_timings_stream(log: DataFrame, kept: int = KEPT) -> DataFrame:
    """pool, run_ids: after each batch of a timing stream (run_id, ts), the last ``kept`` runs of all providers, newest first; the state is
    these runs."""

    def ring(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []
        new = pd.concat(list(batches))
        held = sorted(held + [(int(t.value), int(i)) for t, i in zip(new["ts"], new["run_id"])], reverse=True)[:kept]
        state.update(([t for t, _ in held], [i for _, i in held]))
        yield pd.DataFrame({"pool": [key[0]], "run_ids": [[i for _, i in held]]})

    # each task hands on its newest runs alone, whatever the batch holds
    def newest(batches):
        held = None
        for pdf in batches:
            held = pd.concat([held, pdf]).nlargest(kept, ["ts", "run_id"])
        if held is not None:
            yield held

    runs = log.select("run_id", "ts").mapInPandas(newest, "run_id long, ts timestamp").select(F.lit("all").alias("pool"), "run_id", "ts")
    return runs.groupBy("pool").applyInPandasWithState(ring, "pool string, run_ids array<long>", "ts array<long>, run_id array<long>", "update", "NoTimeout")


def rolling_timings(log: DataFrame, kept: int = KEPT) -> DataFrame:
    """The last runs of a timing log (run_id, ts, ...) over all providers. (Table.)"""
    return log.orderBy(F.desc("ts"), F.desc("run_id")).limit(kept)


def replay(cmds: list[tuple[int, str]], undo: list[int], redo: list[int], kept: int = KEPT) -> list[tuple[int, int | None, int, int, bool]]:
    """One document's commands in order against its two stacks: (seq, version shown, undo depth, redo depth, refused)."""
    out = []
    for seq, cmd in cmds:
        refused = (cmd == "undo" and not undo) or (cmd == "redo" and not redo)
        if cmd == "undo" and undo:
            redo.append(undo.pop())
        elif cmd == "redo" and redo:
            undo.append(redo.pop())
        elif cmd == "edit":
            undo.append(seq)
            redo.clear()
            del undo[:-kept]
        out.append((seq, undo[-1] if undo else None, len(undo), len(redo), refused))
    return out


_REPLAYED = "doc_id long, seq long, version long, n_undo int, n_redo int, refused boolean"


def _frame(doc_id, rows) -> pd.DataFrame:
    return pd.DataFrame([(doc_id, *r) for r in rows], columns=["doc_id", "seq", "version", "n_undo", "n_redo", "refused"]).astype({"version": "Int64"})


def undo_redo(edits: DataFrame) -> DataFrame:
    """doc_id, seq, version, n_undo, n_redo, refused of every command ('edit', 'undo', 'redo'); state per document.

    On a stream the two stacks (at most ``KEPT`` entries each) are the state of a document."""
    e = edits.select("doc_id", "seq", "cmd")
    if not edits.isStreaming:
        class Stacks:
            def __init__(self):
                self.undo, self.redo = [], []

            def add(self, r):
                return [(r.doc_id, *x) for x in replay([(r.seq, r.cmd)], self.undo, self.redo)]

            def end(self, key):
                return ()

        return fold(e, ["doc_id"], ["seq"], Stacks, _REPLAYED)

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        undo, redo = (list(x) for x in state.get) if state.exists else ([], [])
        pdf = pd.concat(list(batches)).sort_values("seq")
        rows = replay(list(zip(pdf["seq"], pdf["cmd"])), undo, redo)
        state.update((undo, redo))
        yield _frame(key[0], rows)

    return e.groupBy("doc_id").applyInPandasWithState(step, _REPLAYED, "undo array<long>, redo array<long>", "append", "NoTimeout")

"""Results that follow a stream."""

import tempfile
from datetime import datetime, timedelta

from arborea.streaming import edits as ed
from arborea.streaming import refresh as r
from pyspark.sql import functions as F

ROWS = "doc_id long, node_id long, token long, seq long"


def test_newest_results_over_batches(spark):
    folder = tempfile.mkdtemp(prefix="spark-") + "/results"
    write = r.keep_newest(folder)
    write(spark.createDataFrame([(1, 1, 5, 1), (1, 2, 1, 2)], ROWS), 0)
    second = spark.createDataFrame([(1, 1, 4, 3), (1, 2, 1, 4), (2, 1, 0, 5)], ROWS)
    write(second, 1)
    write(second, 1)  # again, as after a failure
    assert sorted(map(tuple, spark.read.parquet(f"{folder}/v=1").collect())) == [(1, 1, 5, 1), (1, 2, 1, 4), (2, 1, 0, 5)]


def test_audit_follows_saves_on_a_stream(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    runs = []

    def audit(docs):
        runs.append(sorted(x.doc_id for x in docs.collect()))
        return docs.withColumn("n", F.lit(len(runs)))

    for i, rows in enumerate([[(1, "save"), (2, "save"), (3, "autosave")], [(2, "save"), (1, "edit")]]):
        spark.createDataFrame(rows, "doc_id long, cmd string").coalesce(1).write.parquet(f"{root}/in/{i}")
        edits = spark.readStream.schema("doc_id long, cmd string").parquet(f"{root}/in/*")
        q = edits.writeStream.foreachBatch(r.keep_report(f"{root}/report", audit)).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
        assert q.awaitTermination(60)
    assert runs == [[1, 2], [2]]
    assert sorted(map(tuple, spark.read.parquet(f"{root}/report/v=1").collect())) == [(1, 1), (2, 2)]


def _batches(spark, schema, parts, run, mode, name):
    """Rows that a stream returns when its files come one batch at a time."""
    root = tempfile.mkdtemp(prefix="spark-")
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/in/{i}")
    q = run(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in/*")).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{root}/state").start()
    try:
        q.processAllAvailable()
        return spark.table(name).collect()
    finally:
        q.stop()


def test_undo_steps_on_a_stream(spark):
    """The last row of each step is that of the table; a step goes on over batches."""
    schema = "doc_id long, seq long, undo_group string, changes boolean"
    parts = [[(1, 1, "a", True), (1, 2, "a", True), (2, 1, None, True)], [(1, 3, "a", True), (1, 4, "b", True), (1, 5, "b", False), (2, 2, None, True)], [(1, 6, None, True), (1, 7, "b", True)]]
    last = {}
    for r in _batches(spark, schema, parts, ed.undo_steps_stream, "update", "undo_steps"):
        if r.n_edits >= last.get((r.doc_id, r.step), (None, None, 0))[2]:
            last[r.doc_id, r.step] = (r.undo_group, r.first_seq, r.n_edits)
    table = spark.createDataFrame([x for p in parts for x in p], schema)
    assert last == {(r.doc_id, r.step): (r.undo_group, r.first_seq, r.n_edits) for r in ed.undo_steps(table).collect()}


def test_stale_edits_on_a_stream(spark):
    known = spark.createDataFrame([(1, 5, 10), (1, 9, 30)], "doc_id long, revision long, boundary long")
    parts = [[(1, 1, 4, 20), (1, 2, 9, 50)], [(1, 3, 99, 1), (2, 1, 0, 1)]]
    got = {(r.doc_id, r.seq): r.verdict for r in _batches(spark, "doc_id long, seq long, revision long, node_id long", parts, lambda s: ed.stale_edits(s, known), "append", "stale")}
    assert got == {(1, 1): "stale", (1, 2): "fresh", (1, 3): "future", (2, 1): "fresh"}


def test_rolling_timings_on_a_stream(spark):
    rows = [(i, datetime(2024, 1, 1) + timedelta(minutes=i * 7 % 60)) for i in range(90)]
    got = _batches(spark, "run_id long, ts timestamp", [rows[:40], rows[40:]], lambda s: ed.rolling_timings_stream(s, 20), "update", "timings")
    want = [r.run_id for r in ed.rolling_timings(spark.createDataFrame(rows, "run_id long, ts timestamp"), 20).collect()]
    assert len(got) == 2 and got[-1].run_ids == want

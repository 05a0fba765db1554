"""Results that follow a stream batch by batch: the newest result of each node, and the audit of saved documents.

Both keep a table of versions in a shared folder; a batch that is run again after a failure writes the same version again, so nothing
counts twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def newest(results: DataFrame) -> DataFrame:
    """Per document and node the result with the newest token (doc_id, node_id, token, seq, ...); of one token the last."""
    w = Window.partitionBy("doc_id", "node_id").orderBy(F.desc("token"), F.desc("seq"))
    return results.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def version(spark: SparkSession, folder: str, batch_id: int) -> DataFrame | None:
    """The last version before a batch; null before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return None
    found = [int(f.getPath().getName()[2:]) for f in files.listStatus(path) if f.getPath().getName().startswith("v=")]
    # a version without this mark was not written to its end
    found = [v for v in found if v < batch_id and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/v={v}/_SUCCESS"))]
    return spark.read.parquet(f"{folder}/v={max(found)}") if found else None


def keep_newest(folder: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: version v=<batch> holds the newest result of every node so far; late ones with an older token change nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        before = version(batch.sparkSession, folder, batch_id)
        newest(batch if before is None else before.unionByName(batch)).write.mode("overwrite").parquet(f"{folder}/v={batch_id}")

    return write


def saved_documents(edits: DataFrame, command: str = "save") -> DataFrame:
    """Documents with an explicit save; ticks of the autosave don't count."""
    return edits.filter(F.col("cmd") == command).select("doc_id").distinct()


def refreshed(report: DataFrame | None, saved: DataFrame, audit: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The report with the saved documents' lines made anew. audit: from documents (doc_id) to their lines of the report, so that only
    what changed is computed."""
    new = audit(saved)
    return new if report is None else report.join(saved, "doc_id", "left_anti").unionByName(new)


def keep_report(folder: str, audit: Callable[[DataFrame], DataFrame], command: str = "save") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` over edits: version v=<batch> holds the report of every document as of its last save."""

    def write(batch: DataFrame, batch_id: int) -> None:
        before = version(batch.sparkSession, folder, batch_id)
        refreshed(before, saved_documents(batch, command), audit).write.mode("overwrite").parquet(f"{folder}/v={batch_id}")

    return write

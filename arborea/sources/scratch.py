"""Tables that an operator writes to the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset an own folder in local mode (tests), and an error on a cluster."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found.rstrip("/")


@contextlib.contextmanager
def _freed(spark: SparkSession) -> Iterator[None]:
    """A write started within it deletes its shuffles when it ends, as no later step reads them; else they stay until the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as read back from a file: its lineage ends there, and a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with _freed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop(table: DataFrame) -> None:
    """Frees what ``written`` gave, once no later read needs it."""
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        _delete(table.sparkSession, folder)


#: Rows of a shuffled table in one task.
ROWS = 250_000


def parts(df: DataFrame) -> int:
    """Tasks for a shuffle of ``df``: the session's, or more where these would hold more than ``ROWS`` rows, so that a task doesn't grow with the table."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS))


class Dealt:
    """A table dealt to buckets by one key. Joins, groups and windows by that key, alone or among others, read it without another shuffle."""

    def __init__(self, spark: SparkSession, name: str, key: str, buckets: int):
        # the key alone deals the sides of a join on several keys; a scan keeps its buckets also where only a later step needs them
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
        self.spark, self.key, self.buckets, self.name = spark, key, buckets, f"{name}_{uuid.uuid4().hex}"
        self.path = f"{shared_dir(spark)}/{self.name}"

    def add(self, df: DataFrame, *order: str, dealt: bool = False) -> DataFrame:
        """Appends rows, each bucket in one file and in ``order``; the whole table. dealt: each task of ``df`` has one bucket's rows already."""
        w = (df if dealt else df.repartition(self.buckets, self.key)).write.mode("append").option("compression", "zstd").option("path", self.path).bucketBy(self.buckets, self.key)
        with _freed(self.spark):
            (w.sortBy(*order) if order else w).saveAsTable(self.name)
        return self.spark.table(self.name)

    def drop(self) -> None:
        """Frees a table that no later read needs."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        _delete(self.spark, self.path)


def beside(tree: DataFrame, df: DataFrame, name: str) -> DataFrame:
    """``df`` as read back from a table that is dealt by document as the tree's is, so that nothing is shuffled to meet the tree."""
    return Dealt(df.sparkSession, name, "doc_id", tree.rdd.getNumPartitions()).add(df, "doc_id")

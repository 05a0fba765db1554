"""Helpers shared by the corpus operators: scratch tables in the cluster's shared folder, packed
word hashes and connected components."""

from __future__ import annotations

import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.scratch import shared_dir

#: The white space that separates words in every operator here.
SPACE = r"[\x20\x09-\x0D]+"


#: Rows of whole texts that go to Python at a time; the memory of a worker follows it.
BATCH_ROWS = 500


def bounded_batches(df: DataFrame) -> None:
    """Lowers the session's Arrow batches to ``BATCH_ROWS`` where they are larger: texts may be long."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))


class Scratch:
    """Tables of one operator run, written to the shared folder so that a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """Writes ``df`` and returns it as read from the file: cuts the lineage."""
        schema = df.schema
        df.write.options(**options).mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Frees a table that no later read needs."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of text in the whole table; sizes the number of tiles."""
    return int(df.agg(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0)


def tiles_for(total_bytes: int, each: int) -> int:
    """Number of hash tiles so that one holds about ``each`` bytes of the input."""
    return max(8, -(-total_bytes // each))


# --- words and shingles --------------------------------------------------------------------------

_K = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words(text: str | None, lower: bool) -> list[bytes]:
    """Words of a text in UTF-8. ``bytes.lower`` changes A-Z alone, ``bytes.split`` splits at SPACE alone."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def word_hashes(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` word hashes; ``h`` may hold many documents one after another."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    for i in range(1, width):
        out *= _K
        out += h[i : i + n]
    return mix(out)


def sub_batches(lengths, most: int):
    """(from, to) of runs of rows with about ``most`` characters; bounds memory whatever the batch holds."""
    start = total = 0
    for i, n in enumerate(lengths):
        total += n
        if total >= most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(lengths):
        yield start, len(lengths)


def pack48(h: np.ndarray) -> bytes:
    """The low six bytes of each value."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack48(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


# --- connected components ------------------------------------------------------------------------


#: Edges that one task settles by itself.
EDGE_BLOCK = 1_000_000


def roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b), each with the smallest node that it is connected with."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        for side in (root[x], root[y], x, y):
            np.minimum.at(root, side, low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(root, before):
            return nodes, nodes[root]


def _settled(pdf):
    import pandas as pd

    nodes, roots = roots_of(pdf["v"].to_numpy(), pdf["u"].to_numpy())
    return pd.DataFrame({"v": nodes[nodes != roots], "u": roots[nodes != roots]})


def components(edges: DataFrame, scratch: Scratch, name: str, rounds: int = 60, block: int = EDGE_BLOCK) -> DataFrame:
    """Connected components: blocks of edges are settled on their own, several blocks by alternating large-star and
    small-star steps.

    ``edges``: columns a, b (long). Returns node, root (smallest node of the component) for every node that
    has an edge to another. A task settles ``block`` edges at most in expectation, whatever the table holds, and returns no more
    than it was given. Each step is an aggregation with map-side combine and a join that adaptive
    execution may split, so a star with very many leaves isn't one task's work."""
    flat = scratch.write(edges.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), f"{name}-flat")
    blocks = -(-flat.count() // block)
    dealt = flat.withColumn("block", F.pmod(F.xxhash64("v", "u"), F.lit(max(1, blocks))).cast("int"))
    cur, before = scratch.write(dealt.groupBy("block").applyInPandas(_settled, "v long, u long"), f"{name}-0"), None
    scratch.drop(f"{name}-flat")
    named = lambda df: df.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(df.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
    if blocks <= 1:
        return named(cur)
    for i in range(1, rounds + 1):
        both = cur.unionByName(cur.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.filter("u > v").join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        step = large.filter("v <> u").distinct()
        small_low = step.groupBy("v").agg(F.min("u").alias("m"))
        small = step.join(small_low, "v")
        step = small.select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(small.select("v", F.col("m").alias("u"))).filter("v <> u").distinct()
        cur = scratch.write(step, f"{name}-{i}")
        scratch.drop(f"{name}-{i - 1}")
        now = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        if now == before:
            return named(cur)
        before = now
    raise RuntimeError(f"{name}: components did not settle in {rounds} rounds")

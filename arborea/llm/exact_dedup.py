"""Exact dedup as a log-structured merge index, in DataFrame operations alone.

* *Memtable and flush*: each scan partition is a memtable; it is sorted by digest and written as one run. No shuffle.
* *Filter*: the runs' digests, folded to eight bytes, with counts that add up over the runs. What the filter counts once is
  unique and needs no merge.
* *Compaction*: the entries that pass the filter are merged by digest; the entry with the smallest identifier stays, counts add up.
  The aggregation combines on the map side, so a group of copies costs one row a task.
* *Hits*: digests that more than one row has. Their texts are read again and grouped byte for byte; where one
  digest stands for several texts, these rows are resolved by their bytes instead.

Defined cases: a null text equals an empty one; a null doc_id comes after every other (a group of such rows only
keeps one of them and has a null keep_id); of repeated rows with the same doc_id one stays; very long texts are digested
whole; an empty table gives an empty result. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE, Scratch

#: Distinct hit digests (32 bytes each) up to which they are broadcast; beyond, a shuffled join.
BROADCAST_DIGESTS = 200_000
_LAST = (1 << 63) - 1


def normalised(text: Column) -> Column:
    """The text with each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _smallest(entry: str) -> list[Column]:
    return [F.min(entry).alias("low"), F.count("*").alias("group_size")]


def _resolved(rows: DataFrame, groups: DataFrame, on: list[str]) -> DataFrame:
    """Rows with the entry that stays of their group; a row without a group stands alone."""
    low = F.coalesce("low", "entry")
    return rows.join(groups, on, "left").select(
        F.when(F.col("entry.id") < _LAST, F.col("entry.id")).alias("doc_id"),
        F.when(low["id"] < _LAST, low["id"]).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (low["row"] == F.col("entry.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest_bytes: int = 32) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row.

    digest_bytes: length of the index' digest; short ones only serve to test the byte verification."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "dedup")
    norm = normalised(F.col(text))
    entry = F.struct(F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)).alias("id"), F.monotonically_increasing_id().alias("row"))
    src = docs.select(entry.alias("entry"), F.unhex(F.sha2(norm, 256)).alias("sha")).withColumn("digest", F.substring("sha", 1, digest_bytes))
    runs = scratch.write(src.sortWithinPartitions("digest"), "runs")
    fold = F.xxhash64("digest").alias("fold")
    passed = scratch.write(runs.groupBy(fold).agg(F.count("*").alias("n")).filter("n > 1").select("fold"), "filter")
    several = runs.withColumn("fold", fold).join(F.broadcast(passed) if passed.count() <= BROADCAST_DIGESTS else passed, "fold", "left_semi")
    index = several.groupBy("digest").agg(*_smallest("entry"))
    hits = scratch.write(index.filter("group_size > 1"), "hits")

    few = hits.count() <= BROADCAST_DIGESTS
    small = F.broadcast if few else (lambda df: df)
    # byte verification: the texts of hit digests, grouped by their bytes
    texts = docs.select(F.substring(F.unhex(F.sha2(norm, 256)), 1, digest_bytes).alias("digest"), norm.alias("norm"))
    bytes_of = texts.join(small(hits.select("digest")), "digest", "left_semi").groupBy("digest", "norm").agg(F.count("*").alias("n"))
    clashes = scratch.write(bytes_of.groupBy("digest").agg(F.count("*").alias("texts")).filter("texts > 1").select("digest"), "clashes")
    if clashes.isEmpty():
        found = _resolved(runs, small(hits), ["digest"])
    else:
        whole = docs.select(entry.alias("entry"), norm.alias("norm")).withColumn("sha", F.unhex(F.sha2("norm", 256))).withColumn("digest", F.substring("sha", 1, digest_bytes))
        apart = scratch.write(whole.join(clashes, "digest", "left_semi"), "apart")
        clear = runs.join(clashes, "digest", "left_anti")
        found = _resolved(clear, hits, ["digest"]).unionByName(_resolved(apart, apart.groupBy("digest", "norm").agg(*_smallest("entry")), ["digest", "norm"]))
    return found


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM t
"""

"""The query of table proposals, with its SQL: a nation's suppliers as a table of three columns, every third row named by text alone."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.proposals import proposed_grids
from .adapters import view
from .registry import register

_LINES = "SELECT CAST(s_nationkey AS BIGINT) AS region_id, s_name AS a, CAST(s_suppkey AS STRING) AS b, CAST(s_nationkey AS STRING) AS c, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS INT) AS row_no FROM {supplier}"


def _grids(spark, sf_dir):
    each = view(spark, sf_dir, _LINES).select("region_id", "row_no", F.posexplode(F.array("a", "b", "c")).alias("k", "text")).withColumn("word_no", F.col("row_no") * 3 + F.col("k"))
    left = F.when(F.col("k") == 0, 0.0).when(F.col("k") == 1, 144.0).otherwise(240.0)
    words = each.select("region_id", "word_no", "text", left.alias("x"), (F.col("row_no") * 20.0).alias("y"), (F.length("text") * 6.0).alias("width"), F.lit(10.0).alias("height"))
    named = F.when(F.col("row_no") % 3 == 0, F.array().cast("array<int>")).otherwise(F.array("word_no"))
    cells = each.select("region_id", "row_no", (F.col("k") + 1).alias("cell_no"), F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), F.upper("text").alias("text"), named.alias("word_nos"))
    seeds = F.array().cast("array<double>")
    regions = each.groupBy("region_id").agg(F.max("row_no").alias("n")).select("region_id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(400.0).alias("width"), (F.col("n") * 20.0 + 30).alias("height"), seeds.alias("seed_columns"), seeds.alias("seed_rows"))
    joined = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",").alias(c)
    return proposed_grids(regions, cells, words).select("region_id", "error", "n_rows", "n_cols", joined("columns"), joined("rows"), "conflicts", "misfiled", "rebuilt")


register("proposed_grids", _grids, """WITH s AS (SELECT CAST(s_nationkey AS BIGINT) AS region_id, s_name, CAST(s_suppkey AS VARCHAR) AS key, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier)
SELECT region_id, CAST(NULL AS VARCHAR) AS error, CAST(count(*) AS INT) AS n_rows, 3 AS n_cols, CAST(CAST((max(length(s_name)) * 6 + 144) / 2.0 AS DOUBLE) AS VARCHAR) || ',' || CAST(CAST((144 + max(length(key)) * 6 + 240) / 2.0 AS DOUBLE) AS VARCHAR) AS columns,
 coalesce(string_agg(CASE WHEN n > 1 THEN CAST(CAST(n * 20 - 5 AS DOUBLE) AS VARCHAR) END, ',' ORDER BY n), '') AS rows, 0 AS conflicts, 0 AS misfiled, false AS rebuilt FROM s GROUP BY region_id""")

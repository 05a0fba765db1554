"""A corpus pipeline of five stages: quality, exact dedup, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of ``documents``. Every stage's result is
written to the shared folder and read again as the next one's input.

Defined cases, for every stage: a null text counts as empty (and stays null where the row stays); a null doc_id is a row like any other; very
long texts are read whole; of repeated rows with one doc_id and text the two dedup stages keep one, unless the text is blank, which has no
near copies; ties go to the smallest doc_id; further columns of docs, whatever their names, are carried along, but for packing; an empty
table gives an empty result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from arborea.llm import exact_dedup, pii, quality
from arborea.llm.common import Scratch
from arborea.llm.jaccard import jaccard_components
from arborea.llm.packing import pack_documents
from arborea.llm.queries import VOCABULARY

#: Rows of keys up to which they are broadcast; beyond, a shuffled join.
FEW = 200_000


def _without(docs: DataFrame, gone: DataFrame, key: DataFrame) -> DataFrame:
    return docs.join(F.broadcast(gone) if gone.count() <= FEW else gone, key, "left_anti")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(quality.quality_column(model)("text") >= 0.5)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    scratch = Scratch(spark, "copies")
    found = scratch.write(exact_dedup.exact_duplicates(docs).filter("not kept"), "gone").select(F.col("doc_id").alias("gone_id"), "keep_id", F.col("text_sha256").alias("gone_sha"))
    sha = F.sha2(exact_dedup.normalised(F.col("text")), 256)
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (sha == F.col("gone_sha"))
    kept = _without(docs, found.filter("not gone_id <=> keep_id"), same)
    ties = found.filter("gone_id <=> keep_id").select("gone_id", "gone_sha").distinct()
    if ties.isEmpty():
        return kept
    # rows that share doc_id and text with the row that stays
    return kept.join(ties, same, "left_anti").unionByName(kept.join(ties, same, "left_semi").withColumn("__sha", sha).dropDuplicates(["doc_id", "__sha"]).drop("__sha"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one row stays: that with the smallest doc_id, null last, and of these that with the smallest hash.

    Rows are told apart by doc_id and text, so rows with a null or shared doc_id are judged each for itself."""
    scratch = Scratch(spark, "near")
    key = F.xxhash64("doc_id", "text")
    found = jaccard_components(docs.select(key.alias("key"), "text"), doc_id="key").filter("n_shingles > 0")
    found = scratch.write(found.groupBy(F.col("doc_id").alias("key")).agg(F.first("component_id").alias("component"), F.count("*").alias("n")), "found")
    large = found.groupBy("component").agg(F.sum("n").alias("size")).filter("size > 1").select("component")
    member = scratch.write(found.join(large, "component", "left_semi"), "members")
    ids = docs.select("doc_id", key.alias("key")).join(F.broadcast(member) if member.count() <= FEW else member, "key")
    stays = ids.groupBy("component").agg(F.min_by("key", F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("stays"))
    gone = scratch.write(member.join(stays, "component").filter("key <> stays").select(F.col("key").alias("gone")), "gone")
    kept = _without(docs, gone, key == F.col("gone"))
    same = member.filter("n > 1").select(F.col("key").alias("same")).join(gone, F.col("same") == F.col("gone"), "left_anti")
    if same.isEmpty():
        return kept
    # repeated rows with the same doc_id and text
    return kept.join(same, key == F.col("same"), "left_anti").unionByName(kept.join(same, key == F.col("same"), "left_semi").withColumn("__key", key).dropDuplicates(["__key"]).drop("__key"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind; n_chars follows the text."""
    model = pii.estimate(pii.vote_counts(docs))
    clean = docs.withColumn("text", pii.redacted(model)("text"))
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, VOCABULARY)


STAGES = [("quality classifier", keep_good), ("exact dedup", drop_copies), ("n-gram Jaccard join", drop_near_copies), ("personal data", redact_personal_data), ("packing", pack)]

#: The classifier and the packing are no SQL; tests/llm compares each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage-{i}")
    return docs

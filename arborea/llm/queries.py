"""The registered queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import collocations, divergence, exact_dedup, jaccard, licenses, pii, quality, substring_dedup, warc
from .best_fit import pack_best_fit
from .bpe import encoding_digests
from .jaccard import jaccard_components
from .licenses import license_scan
from .neighbours import nearest
from .packing import pack_documents

#: Public tokenizer files; every operator takes the path as a parameter.
VOCABULARY, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(_table(spark, sf_dir, "pages"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(_table(spark, sf_dir, "documents"), VOCABULARY)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"), with_text=False)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), VOCABULARY)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.learn(docs, _table(spark, sf_dir, "labels")))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return license_scan(docs.withColumn("path", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_best_fit(_table(spark, sf_dir, "documents"), BYTES)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(_table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_nearest_neighbours, op3_exact_dedup, op4_warc, op5_bpe, op6_substring_dedup, op7_packing, op8_pii, op9_quality, op10_license_scan, op11_best_fit_packing, op12_source_divergence, op13_collocations)}
ORACLE_SQL: dict[str, str] = {"op1_ngram_jaccard_join": jaccard.ORACLE_SQL, "op3_exact_dedup": exact_dedup.ORACLE_SQL, "op4_warc": warc.ORACLE_SQL, "op10_license_scan": licenses.ORACLE_SQL, "op6_substring_dedup": substring_dedup.ORACLE_SQL, "op12_source_divergence": divergence.ORACLE_SQL, "op13_collocations": collocations.ORACLE_SQL}

"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, language_id, length_buckets, line_dedup, ngram_join, oracles, packed_output, pivot_search, pseudo_likelihood, quality, substring_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", language_id.held_out("doc_id", 5, 0))
    parser = language_id.train(docs.where(~F.col("held_out")), "text", "lang")
    return language_id.identify(docs.select("doc_id", "text", "held_out"), parser).select("doc_id", "held_out", "lang_pred", "score", "bits", "accepted")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = _table(spark, sf_dir, "documents").select("doc_id", "text"), quality.held_out("doc_id", 3, 1)
    model = quality.train(docs, _table(spark, sf_dir, "labels").where(~out))
    return quality.classify(docs.withColumn("held_out", out), model, columns=["doc_id", "held_out"])


def op3_masked_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pseudo_likelihood.score_documents(docs, pseudo_likelihood.train(docs))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = pivot_search.quantised(_table(spark, sf_dir, "embeddings"))
    return pivot_search.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op5_packed_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_output.pack_tokens(_table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = decontamination.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return decontamination.contamination_digest(report)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(_table(spark, sf_dir, "documents"), digest=True)


def op9_length_bucket_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_buckets.pack_by_length(_table(spark, sf_dir, "documents"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.similarity_classes(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "class_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [f for name, f in globals().items() if name.startswith("op") and callable(f)]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)

"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann_forest, divergence, embed_dedup, line_dedup, merge_dropout, mixing, ngram_join, packing, pii, quality, target_sampling, token_count, toxicity


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(documents(spark, sf_dir).select("doc_id", "text"))


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


def op8_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_dropout.encode(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(embeddings(spark, sf_dir))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(documents(spark, sf_dir))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_forest.nearest(embeddings(spark, sf_dir), F.col("vec_id") % 50 == 0)


def op7_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Carries no text: id, weight, key and whether the document is selected."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.resample(documents(spark, sf_dir).select("doc_id", "text"), labels).drop("text")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_sampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_line_dedup, op3_embedding_near_dedup, op4_personal_data, op5_ngram_join, op6_nearest_neighbours, op7_importance_resampling, op8_merge_dropout, op9_toxicity, op10_best_fit_packing, op11_source_divergence, op12_target_resampling, op13_source_mixing)}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": line_dedup.sql(), "op11_source_divergence": divergence.sql(), "op12_target_resampling": target_sampling.sql(), "op13_source_mixing": mixing.sql()}

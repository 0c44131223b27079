"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    """Place of a public tokenizer file on the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _spread(docs: DataFrame) -> DataFrame:
    """Documents of a scan for work that is heavy for each row: dealt evenly where the scan has fewer parts than there are cores.

    A large table has many parts and is not moved.
    """
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import substring

    return substring.dedup_digest(_documents(spark, sf_dir))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import language_model

    return language_model.score(_documents(spark, sf_dir))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import decontaminate

    return decontaminate.report(_documents(spark, sf_dir), _benchmark(spark, sf_dir))


def op1_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import shard_tree

    return shard_tree.shard(_documents(spark, sf_dir), 24)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import pieces

    return pieces.digest(_spread(_documents(spark, sf_dir)), vocabulary("piece_bpe_32k.model"))


def op6_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import quality

    return quality.judge(_spread(_documents(spark, sf_dir)))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import jaccard

    return jaccard.join(_documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import toxicity

    return toxicity.classify(_spread(_documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import token_files

    return token_files.round_trip(_documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import license_scan

    return license_scan.scan(_documents(spark, sf_dir))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import token_counts

    return token_counts.totals(_documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op12_late_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import late_layout

    return late_layout.overwrite_late(spark.read.parquet(f"{sf_dir}/sales.parquet"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import centroids

    return centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict[str, Query]:
    return {name: fn for name, fn in sorted(globals().items()) if name.startswith("op") and callable(fn)}


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that it can express; the tests hold the others against brute force."""
    from lodestone.llm.oracles import ORACLES

    return dict(ORACLES)

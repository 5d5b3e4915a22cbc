"""The queries of this subpackage and the SQL of those that DuckDB can run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licenses, mixing, neardup, packing, quality, scratch, secrets, tokenio, topk, toxicity, urls

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Where the public tokenizers' files lie on this machine and on the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), 1024, 0, with_ids=False, cache=tokenio.CACHE)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.weigh(table(spark, sf_dir, "documents"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("matches")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op10_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.new_path(spark, "shards")
    tokenio.write(table(spark, sf_dir, "documents"), path, tokenizer("word_bpe_49k.json"), 1)
    return tokenio.read(spark, path)


def queries() -> dict[str, Query]:
    return {
        "op1_quality": op1_quality,
        "op2_packing": op2_packing,
        "op3_mixing": op3_mixing,
        "op4_urls": op4_urls,
        "op5_toxicity": op5_toxicity,
        "op6_near_duplicates": op6_near_duplicates,
        "op7_licenses": op7_licenses,
        "op8_topk": op8_topk,
        "op9_secrets": op9_secrets,
        "op10_token_blocks": op10_token_blocks,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_mixing": mixing.sql(),
        "op6_near_duplicates": neardup.sql(),
        "op7_licenses": licenses.sql(),
        "op8_topk": topk.SQL,
        "op9_secrets": secrets.sql(),
    }

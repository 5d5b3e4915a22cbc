"""From raw documents to packed token sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all documents that the one before kept, and returns
documents with the columns it got, but for the last, which returns one row a packed piece. `run`
writes each stage's result to the folder that all executors share and reads it again, so a lost
executor never costs more than the stage at hand; the table before it is deleted then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm import mixing, neardup, packing, quality, registry, scratch, secrets

#: Estimation and thresholds cannot be put into SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base check or the posterior of the weak rules rejects go."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, that of the least doc_id."""
    return neardup.deduplicate(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark; n_chars follows the text. No document goes."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled so that sources, languages and topics near their target weights."""
    return mixing.sample(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece, with its token ids as little-endian unsigned 32-bit values."""
    return packing.pack(docs, registry.tokenizer("byte_bpe_50k.json"), 1024, 0, with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = registry.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        was, docs = docs, scratch.table(stage(spark, docs, sf_dir), name)
        if hasattr(was, "scratch_path"):
            scratch.discard(was)
    return STAGES[-1][1](spark, docs, sf_dir)

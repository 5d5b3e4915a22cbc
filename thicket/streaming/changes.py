"""Change feeds and last-write-wins ingestion with Structured Streaming.

An operation log is an append-only table: id, _time, deleted and the document's fields. A watch is the
stream of its rows as (id, kind); a watch on a query also applies the query's filters. Ingestion keeps
the latest row of each id in a table of versions, one folder for each micro-batch, so that a batch that
runs again writes the same folder again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.predicates import condition
from ..operators.query import Query


def op_log(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def watch(log: DataFrame) -> DataFrame:
    """(id, kind): put or delete, without the document."""
    return log.select("id", F.when(F.col("deleted"), "delete").otherwise("put").alias("kind"))


def watch_query(log: DataFrame, query: Query) -> DataFrame:
    """Changes that concern a query: puts that its filters admit, and every delete."""
    fits = condition(log.schema, query.filters, query.or_filters, query.elem_matches)
    return watch(log.filter(F.col("deleted") | fits))


def latest(rows: DataFrame) -> DataFrame:
    """The latest row of each id; a delete is a row like any other. Of equal times the first to arrive
    (the least `_arrived`, if there is one) stays."""
    rest = [c for c in rows.columns if c != "id"]
    by = F.struct("_time", -F.col("_arrived")) if "_arrived" in rows.columns else F.col("_time")
    return rows.groupBy("id").agg(F.max_by(F.struct(*rest), by).alias("m")).select("id", "m.*").select(*rows.columns)


def ingest(log: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Folds each micro-batch to the latest row of each id and adds it to the versions at `path`."""

    def fold(batch: DataFrame, number: int) -> None:
        latest(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return log.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state(spark: SparkSession, path: str, schema) -> DataFrame:
    """The live documents that the versions at `path` amount to; of equal times the earlier batch's stays."""
    versions = spark.read.option("basePath", path).schema(schema).parquet(path).withColumnRenamed("batch", "_arrived")
    return latest(versions).filter(~F.col("deleted")).drop("_arrived", "deleted")


def compact(spark: SparkSession, path: str, schema, to: str) -> None:
    """Writes the versions anew as one batch, deletes included."""
    versions = spark.read.option("basePath", path).schema(schema).parquet(path).withColumnRenamed("batch", "_arrived")
    latest(versions).drop("_arrived").write.parquet(f"{to}/batch=0")


def counts(changes: DataFrame, delay: str = "1 hour", every: str = "1 day") -> DataFrame:
    """Changes for each window of their time and each kind, with late rows dropped after `delay`."""
    return changes.withWatermark("ts", delay).groupBy(F.window("ts", every), "kind").agg(F.count(F.lit(1)).alias("n"))

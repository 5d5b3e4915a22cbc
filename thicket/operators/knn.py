"""Exact nearest neighbours and hybrid retrieval.

One query is an expression over the scan and a top-k by (distance, id): no shuffle but the k best rows
of each task. Many stated queries are scored block by block with matrix products, each block giving
its k best to one ranking for each query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text, vectors
from ..functions.predicates import condition
from . import aggregate
from .query import Query, matching, page


def ranked(df: DataFrame, field: str, query: list[float], metric: str = "cosine") -> DataFrame:
    """Rows that have a vector of the query's length, with `score` (the distance)."""
    kind = df.schema[field].dataType if field in df.columns else None
    if isinstance(kind, T.BinaryType):
        vector = vectors.decoded(F.col(field))
    elif isinstance(kind, T.ArrayType):
        vector = vectors.doubles(F.col(field))
    else:
        return df.limit(0).withColumn("score", F.lit(None).cast("double"))
    rows = df.filter(F.col(field).isNotNull()).withColumn("_vector", vector).filter(F.size("_vector") == len(query))
    return rows.withColumn("score", vectors.distance(F.col("_vector"), vectors.literal(query), metric)).drop("_vector")


def knn(df: DataFrame, field: str, query: list[float], k: int, metric: str = "cosine", max_distance: float | None = None, filters=()) -> DataFrame:
    """The k nearest rows that the filters admit, nearest first, ties by id; the cut by distance is
    made after the k are chosen."""
    rows = df.filter(condition(df.schema, filters)) if filters else df
    best = ranked(rows, field, query, metric).orderBy("score", "id").limit(k)
    return best if max_distance is None else best.filter(F.col("score") <= max_distance).orderBy("score", "id")


def run_near(df: DataFrame, query: Query) -> DataFrame:
    """A query with one `near` filter: other filters first, then distance; without a limit all rows."""
    near = query.marker("near")
    rows = matching(df, query.without("near"))
    rows = ranked(rows, near.field, near.value["vector"], near.value.get("metric", "cosine"))
    if query.aggregates:
        return aggregate.simple(rows, query.aggregates)
    return page(rows, query.without("near").order_by("score").order_by("id") if not query.order else query.without("near"))


def knn_batch(df: DataFrame, field: str, queries: list[list[float]], k: int, metric: str = "cosine") -> DataFrame:
    """(query, rank, id, score) for each of the stated queries; `query` is its place in the list."""
    if metric not in vectors.METRICS:
        raise ValueError(f"no metric {metric!r}")
    asked = np.array(queries, dtype=np.float64)
    if asked.ndim != 2:
        raise ValueError("queries need one length")

    def nearest(batches):
        norms = np.linalg.norm(asked, axis=1)
        for batch in batches:
            ids, rows = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            fits = pc.fill_null(pc.equal(pc.list_value_length(rows), asked.shape[1]), False).to_numpy(zero_copy_only=False)
            if not fits.any():
                continue
            ids = ids[fits]
            kept = rows.filter(pa.array(fits))
            values = kept.flatten().to_numpy(zero_copy_only=False).reshape(len(kept), -1).astype(np.float64)
            dot = asked @ values.T
            if metric == "ip":
                far = -dot
            elif metric == "l2":
                far = np.stack([((values - q) ** 2).sum(axis=1) for q in asked])
            else:
                size = norms[:, None] * np.linalg.norm(values, axis=1)[None, :]
                far = np.where(size == 0, 1.0, 1.0 - dot / np.where(size == 0, 1.0, size))
            out = []
            for q in range(len(asked)):
                limit = np.partition(far[q], k - 1)[k - 1] if len(ids) > k else np.inf
                near = np.flatnonzero(far[q] <= limit)  # ties at the limit stay, the ranking settles them
                out += [(q, ids[i], far[q][i]) for i in near.tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] for r in out], pa.float64())],
                names=["query", "id", "score"],
            )

    found = df.select("id", vectors.doubles(F.col(field)).alias("v")).mapInArrow(nearest, "query int, id string, score double")
    by = W.partitionBy("query").orderBy("score", "id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query", "rank", "id", "score")


def hybrid(df: DataFrame, text_field: str, query: str, vector_field: str, vector: list[float], k: int, rrf_k: int = 60, filters=(), metric: str = "cosine", most_texts: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of a text ranking and a vector ranking: (id, score), best first.

    Texts hold all terms of the query and rank by the sum of tf * ln(1 + N / df), with N all rows and df
    the rows of a term; if `most_texts` is given, only so many of them, by id, take part. Each side is cut to
    max(2 k, 16) ranks. Filters apply before ranks are given. k = 0 gives no row.
    """
    if rrf_k < 1:
        raise ValueError("rrf_k is 1 or more")
    depth, asked = max(2 * k, 16), text.query_terms(query)
    rows = df.filter(condition(df.schema, filters)) if filters else df
    sides = []
    if asked and k:
        held = text.terms(F.col(text_field))
        n = df.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.array_contains(held, t)).alias(f"df{i}") for i, t in enumerate(asked))).first()
        texts = text.search(rows, text_field, query)
        texts = texts.orderBy("id").limit(most_texts) if most_texts else texts
        weight = F.lit(0.0)
        for i, t in enumerate(asked):
            weight = weight + _count_of(held, t).cast("double") * F.log(F.lit(1.0 + n["n"] / max(1, n[f"df{i}"])))
        top = texts.withColumn("_w", weight).orderBy(F.col("_w").desc(), "id").limit(depth)
        sides.append(top.select("id", F.row_number().over(W.orderBy(F.col("_w").desc(), "id")).alias("rank")))
    if k:
        near = ranked(rows, vector_field, vector, metric).orderBy("score", "id").limit(depth)
        sides.append(near.select("id", F.row_number().over(W.orderBy("score", "id")).alias("rank")))
    if not sides:
        return df.limit(0).select("id", F.lit(0.0).alias("score"))
    both = sides[0] if len(sides) == 1 else sides[0].union(sides[1])
    # At most two ranked lists of `depth` rows each.
    fused = both.groupBy("id").agg(F.sum(1.0 / (F.lit(float(rrf_k)) + F.col("rank"))).alias("score"))
    return fused.orderBy(F.col("score").desc(), "id").limit(k)


def _count_of(held, term: str):
    return F.size(F.filter(held, lambda x: x == F.lit(term)))

"""Index definitions, and the side tables that they stand for.

Spark's scans need no index for right results; a definition says which side table is worth writing: a
table clustered by fields (secondary, composite), a table of postings (fts), quantised vectors with sign
bits (vector), or an edge table (traverse, edge). Creating the same definition twice changes nothing;
another definition for the same place is refused.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, vectors
from ..functions.predicates import Filter, condition
from . import mutate

KINDS = ("secondary", "composite", "fts", "vector", "traverse", "edge")


@dataclass(frozen=True)
class Index:
    kind: str
    collection: str
    fields: tuple[tuple[str, str], ...]  # (name, "asc" or "desc")
    unique: bool = False
    sparse: bool = False
    where: tuple[Filter, ...] = ()
    dimension: int | None = None
    metric: str = "cosine"


class Indexes:
    def __init__(self):
        self.known: dict[tuple, Index] = {}

    def create(self, index: Index) -> bool:
        """True if it is new."""
        if index.kind not in KINDS:
            raise ValueError(f"no kind of index {index.kind!r}")
        place = (index.kind, index.collection, tuple(f for f, _ in index.fields))
        if (old := self.known.get(place)) is not None:
            if old != index:
                raise ValueError(f"another {index.kind} index on {index.collection} {place[2]} exists")
            return False
        self.known[place] = index
        return True

    def ensure(self, *indexes: Index) -> int:
        return sum(self.create(i) for i in indexes)

    def drop(self, kind: str, collection: str, *fields: str) -> bool:
        return self.known.pop((kind, collection, fields), None) is not None

    def list(self, collection: str | None = None) -> list[Index]:
        return [i for _, i in sorted(self.known.items()) if collection in (None, i.collection)]


def violations(df: DataFrame, index: Index) -> DataFrame:
    """Tuples that break a unique index, over the rows that it covers."""
    covered = df.filter(condition(df.schema, index.where)) if index.where else df
    return mutate.unique_violations(covered, [f for f, _ in index.fields], index.sparse)


def side_table(df: DataFrame, index: Index) -> DataFrame:
    """What to write for the index."""
    rows = df.filter(condition(df.schema, index.where)) if index.where else df
    names = [f for f, _ in index.fields]
    for n in names if index.sparse else []:
        rows = rows.filter(F.col(n).isNotNull())
    if index.kind == "fts":
        return text.postings(rows, names[0]).repartitionByRange("term").sortWithinPartitions("term", "id")
    if index.kind == "vector":
        return quantised(rows, names[0])
    by = [F.col(n).desc() if d == "desc" else F.col(n).asc() for n, d in index.fields]
    return rows.repartitionByRange(*by).sortWithinPartitions(*by, "id")


def quantised(df: DataFrame, field: str) -> DataFrame:
    """(id, scale, q, signs): 8-bit components with the scale max / 127, and each component's sign as a
    bit of 32-bit words. `scale * q` is within half a scale of the vector."""
    v = vectors.doubles(F.col(field))
    rows = df.filter(F.col(field).isNotNull()).select("id", v.alias("v"))
    most = F.array_max(F.transform("v", F.abs))
    rows = rows.withColumn("scale", F.when(most > 0, most / 127.0).otherwise(1.0))
    q = F.transform("v", lambda x: F.round(x / F.col("scale")).cast("tinyint"))
    return rows.select("id", "scale", q.alias("q"), _signs(F.col("v")).alias("signs"))


def _signs(v: Column) -> Column:
    words = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(v) / 32).cast("int") - 1, F.lit(0)))

    def word(k: Column) -> Column:
        part = F.slice(v, k * 32 + 1, F.lit(32))
        bits = F.transform(part, lambda x, i: F.when(x >= 0, F.pow(F.lit(2.0), i.cast("double")).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
        return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: a + b)

    return F.transform(words, word)


def approximate_knn(df: DataFrame, index: DataFrame, field: str, query: list[float], k: int, metric: str = "cosine", widen: int = 16) -> DataFrame:
    """(id, score): the nearest, from the rows that bounds by 8-bit components leave, scored exactly.

    index: the rows of `quantised`. `scale * q` is within half a scale of the vector, which bounds each
    distance; rows whose least distance exceeds the k-th of the greatest ones cannot be among the
    nearest, so none is lost. `widen` is no longer used.
    """
    asked, approx = vectors.literal(query), F.transform("q", lambda x: x * F.col("scale"))
    off = F.col("scale") * (0.5 * len(query) ** 0.5 + 1e-6)  # the length of the greatest rounding
    size = sum(x * x for x in query) ** 0.5
    rows = index.filter(F.size("q") == len(query)).select("id", "scale", "q", approx.alias("_v"))
    if metric == "l2":
        far = F.sqrt(vectors.distance(F.col("_v"), asked, "l2"))
        low, high = F.pow(F.greatest(far - off, F.lit(0.0)), 2), F.pow(far + off, 2)
    elif metric == "ip":
        far = vectors.distance(F.col("_v"), asked, "ip")
        low, high = far - off * size, far + off * size
    else:
        length = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x))
        far = F.acos(F.least(F.greatest(1.0 - vectors.distance(F.col("_v"), asked, metric), F.lit(-1.0)), F.lit(1.0)))
        turn = F.when(length > off, F.asin(off / length)).otherwise(math.pi)
        low, high = 1.0 - F.cos(F.greatest(far - turn, F.lit(0.0))), 1.0 - F.cos(F.least(far + turn, F.lit(math.pi)))
    slack = 1e-9
    rows = rows.select("id", F.coalesce(low, F.lit(float("-inf"))).alias("_low"), F.coalesce(high, F.lit(float("inf"))).alias("_high"))
    limit = rows.select("_high").orderBy("_high").limit(k).agg(F.max("_high").alias("_limit"))
    near = rows.crossJoin(F.broadcast(limit)).filter(F.col("_low") <= F.col("_limit") + slack * (1.0 + F.abs("_limit")))
    found = df.join(near.select("id"), "id", "left_semi")
    score = vectors.distance(vectors.doubles(F.col(field)), vectors.literal(query), metric)
    return found.select("id", score.alias("score")).orderBy("score", "id").limit(k)


def recall(exact: DataFrame, found: DataFrame, k: int) -> float:
    """The share of the k exact neighbours that were found."""
    return exact.join(found.select("id"), "id", "left_semi").count() / k


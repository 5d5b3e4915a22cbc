"""Collections: named tables with an `id` (string) and `_time` (microseconds) column.

`Engine` holds what names a collection's table, and runs queries, pipelines and lookups on them. A
collection that nobody registered is empty. `over_tables` registers the driver's tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, knn, mutate
from ..operators.pipeline import Pipeline, run_pipeline
from ..operators.query import Query, run

Source = Callable[[], DataFrame]


class Engine:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.sources: dict[str, Source] = {}
        self.keys: dict[str, str] = {}  # whole-number columns that ids are the text of
        self.edges: Source | None = None

    def register(self, name: str, source: Source | DataFrame) -> "Engine":
        self.sources[name] = source if callable(source) else (lambda: source)
        return self

    def collection(self, name: str) -> DataFrame:
        if name not in self.sources:
            return self.spark.createDataFrame([], "id string, _time bigint")
        return self.sources[name]()

    def subcollection(self, parent_id: str, name: str) -> DataFrame:
        """Named `parent id/name`, whatever the parent's collection."""
        return self.collection(f"{parent_id}/{name}")

    def link(self, edges: Source | DataFrame) -> "Engine":
        """Names the edge table that queries with a `traverse` filter walk over."""
        self.edges = edges if callable(edges) else (lambda: edges)
        return self

    def query(self, q: Query) -> DataFrame:
        if q.marker("traverse"):
            if self.edges is None:
                raise ValueError("a query that walks needs an edge table: Engine.link")
            spec = q.marker("traverse").value
            if not self.exists(spec["collection"], spec["id"]):
                return graph.run_traverse(self.collection(q.collection), self.edges().limit(0), q)
            return graph.run_traverse(self.collection(q.collection), self.edges(), q)
        if q.marker("near"):
            return knn.run_near(self.collection(q.collection), q)
        return run(self.collection(q.collection), q)

    def first(self, q: Query) -> Row | None:
        """The first document of a query's result."""
        return self.query(replace(q, n_limit=1)).first()

    def count(self, q: Query) -> int:
        """How many rows the filters admit, whatever the page."""
        return int(self._one(q, "count", None))

    def sum(self, q: Query, name: str) -> float:
        return self._one(q, "sum", name)

    def avg(self, q: Query, name: str) -> float:
        return self._one(q, "avg", name)

    def min(self, q: Query, name: str) -> float | None:
        return self._one(q, "min", name)

    def max(self, q: Query, name: str) -> float | None:
        return self._one(q, "max", name)

    def _one(self, q: Query, op: str, name: str | None):
        return self.query(replace(q, aggregates=((op, name),))).first()[0]

    def patch(self, q: Query, values: dict) -> DataFrame:
        """The collection with these fields set in all rows that the filters admit."""
        return mutate.patch_where(self.collection(q.collection), q, values)

    def delete(self, q: Query) -> DataFrame:
        """The collection without the rows that the filters admit."""
        return mutate.delete_where(self.collection(q.collection), q)

    def pipeline(self, p: Pipeline) -> DataFrame:
        return run_pipeline(self.collection, p)

    def get(self, name: str, doc_id: str) -> DataFrame:
        """The document, if there is one. Where ids are the text of a number, that column is compared too,
        so that the scan can skip row groups."""
        df = self.collection(name).filter(F.col("id") == doc_id)
        if name in self.keys and doc_id.isdecimal():
            df = df.filter(F.col(self.keys[name]) == int(doc_id))
        return df

    def exists(self, name: str, doc_id: str) -> bool:
        return not self.get(name, doc_id).isEmpty()

    def ids(self, name: str, start: str | None = None, exclusive: bool = False, reverse: bool = False, offset: int = 0, limit: int | None = None) -> DataFrame:
        """A slice of the sorted ids. A start that no row has begins at its place in the order."""
        df = self.collection(name).select("id")
        if start is not None:
            at = F.col("id")
            beyond = at < start if reverse else at > start
            df = df.filter(beyond if exclusive else beyond | (at == start))
        df = df.orderBy(F.col("id").desc() if reverse else F.col("id").asc())
        df = df.offset(offset) if offset else df
        return df if limit is None else df.limit(limit)

    def resolve(self, df: DataFrame, reference: str, target: str, prefix: str) -> DataFrame:
        """Joins the documents that a reference column points to; their columns get a prefix."""
        there = self.collection(target)
        there = there.select(F.col("id").alias("_ref"), *(F.col(c).alias(prefix + c) for c in there.columns if c not in ("id", "_time")))
        return df.join(there, F.col(reference).cast("string") == F.col("_ref"), "left").drop("_ref")

    def stats(self) -> DataFrame:
        """(collection, documents) of all that is registered."""
        parts = [self.collection(n).agg(F.lit(n).alias("collection"), F.count(F.lit(1)).alias("documents")) for n in sorted(self.sources)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def union_by_id(parts: list[DataFrame]) -> DataFrame:
    """The rows of all parts, one an id."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(["id"])


#: Each table's key and the column of its time, if it has one.
TABLES = {
    "region": ("r_regionkey", None), "nation": ("n_nationkey", None), "customer": ("c_custkey", None),
    "supplier": ("s_suppkey", None), "part": ("p_partkey", None), "orders": ("o_orderkey", "o_orderdate"),
    "events": ("event_id", "ts"), "documents": ("doc_id", None), "embeddings": ("vec_id", None),
    "pages": ("page_id", None), "benchmark": ("item_id", None),
}


#: Columns that hold ids of another collection.
REFERENCES = [("orders", {"o_custkey": "customer"}), ("customer", {"c_nationkey": "nation"}), ("supplier", {"s_nationkey": "nation"}), ("nation", {"n_regionkey": "region"})]


def _micros(at: str | None) -> Column:
    return F.unix_micros(F.col(at).cast("timestamp")) if at else F.lit(0).cast("bigint")


def over_tables(spark: SparkSession, sf_dir: str) -> Engine:
    """The driver's tables as collections; `orders_items` nests each order's line items, sorted."""
    engine = Engine(spark)

    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def table(name: str, key: str, at: str | None) -> Source:
        def load() -> DataFrame:
            df = read(name).withColumns({"id": F.col(key).cast("string"), "_time": _micros(at)})
            return df.withColumn("props", F.from_json("props", "k bigint")) if name == "events" else df

        return load

    for name, (key, at) in TABLES.items():
        engine.register(name, table(name, key, at))
        engine.keys[name] = key

    def nested() -> DataFrame:
        item = F.struct(F.col("l_partkey").alias("part"), F.col("l_quantity").alias("qty"), F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("price"))
        items = read("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items"))
        orders = engine.collection("orders").select("id", "_time", "o_orderkey", "o_orderstatus", "o_orderpriority")
        joined = orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")
        flags = F.transform("items", lambda i: i["flag"])
        return joined.withColumn("flags", flags)

    engine.register("orders_items", nested)

    def references() -> DataFrame:
        out = None
        for name, fields in REFERENCES:
            edges = graph.reference_edges(engine.collection(name), name, **fields)
            out = edges if out is None else out.unionByName(edges)
        return out

    engine.link(references)
    return engine

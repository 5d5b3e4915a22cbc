"""The aggregation pipeline: match, project, sort, limit, offset, unwind and group, in any order.

A `match` stage runs a whole query and replaces the rows at hand, wherever it stands. A pipeline that
begins with another stage begins with the whole collection.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import of_row, parts_of, project
from ..functions.values import order_key
from .query import Query, run, sort_columns

ACCUMULATORS = ("count", "sum", "avg", "min", "max")
LONGEST = 2**63 - 1


@dataclass(frozen=True)
class Pipeline:
    collection: str
    stages: tuple[tuple, ...] = ()

    def _with(self, *stage) -> "Pipeline":
        return replace(self, stages=(*self.stages, stage))

    def match_query(self, query: Query) -> "Pipeline":
        return self._with("match", query)

    def project(self, *paths: str) -> "Pipeline":
        return self._with("project", paths)

    def sort(self, field: str, asc: bool = True) -> "Pipeline":
        return self._with("sort", field, asc)

    def limit(self, n: int) -> "Pipeline":
        return self._with("limit", n)

    def offset(self, n: int) -> "Pipeline":
        return self._with("offset", n)

    def unwind(self, field: str) -> "Pipeline":
        return self._with("unwind", field)

    def group(self, key: str | None, *accumulators: tuple) -> "Pipeline":
        """accumulators: (output name, operator, path); the path is None for a count."""
        return self._with("group", key, accumulators)

    def validate(self) -> None:
        """Refuses malformed paths, dotted unwinds, unknown accumulators and repeated output names."""
        for stage in self.stages:
            if stage[0] == "project" and (not stage[1] or not all(map(parts_of, stage[1]))):
                raise ValueError("project needs well-formed paths")
            if stage[0] == "sort" and not parts_of(stage[1]):
                raise ValueError("sort needs a well-formed path")
            if stage[0] == "unwind" and ("." in stage[1] or not stage[1]):
                raise ValueError("unwind takes a top-level field")
            if stage[0] in ("limit", "offset") and stage[1] < 0:
                raise ValueError("limit and offset are not negative")
            if stage[0] == "group":
                names = [out for out, _, _ in stage[2]]
                if len(set(names)) < len(names) or (stage[1] is not None and not parts_of(stage[1])):
                    raise ValueError("group needs distinct names and a well-formed key")
                for _, op, path in stage[2]:
                    if op not in ACCUMULATORS or (op != "count" and not (path and parts_of(path))):
                        raise ValueError(f"no accumulator {op!r} of {path!r}")


def _accumulator(df: DataFrame, op: str, path: str | None) -> Column:
    if op == "count":
        return F.count(F.lit(1))
    at = of_row(df.schema)(path)
    if at is None:
        return F.lit(0).cast("bigint") if op == "sum" else F.lit(None).cast("double")
    column, kind = at
    if op in ("min", "max"):
        if isinstance(kind, (T.ArrayType, T.MapType)):
            return getattr(F, f"{op}_by")(column, order_key(column, kind))
        return getattr(F, op)(column)
    if not isinstance(kind, T.NumericType):
        return F.lit(0).cast("bigint") if op == "sum" else F.lit(None).cast("double")
    if op == "avg":
        return F.avg(column.cast("double"))
    if isinstance(kind, T.IntegralType):  # whole sums stay whole and stop at the ends of 64 bits
        total = F.sum(column.cast("decimal(28,0)"))
        held = F.least(F.greatest(total, F.lit(-LONGEST - 1).cast("decimal(28,0)")), F.lit(LONGEST).cast("decimal(28,0)"))
        return F.coalesce(held.cast("bigint"), F.lit(0).cast("bigint"))
    return F.coalesce(F.sum(column.cast("double")), F.lit(0.0))


def _group(df: DataFrame, key: str | None, accumulators) -> DataFrame:
    made = [_accumulator(df, op, path).alias(out) for out, op, path in accumulators] or [F.count(F.lit(1)).alias("_rows")]
    every = F.lit("$all")
    if key is None:  # no rows make no group
        kept = [out for out, _, _ in accumulators]
        out = df.agg(F.count(F.lit(1)).alias("_n"), *made).filter("_n > 0")
        return out.select(every.alias("id"), *kept)
    at, name = of_row(df.schema)(key), key.split(".")[-1]
    column, kind = at if at is not None else (F.lit(None).cast("string"), T.StringType())
    out = df.groupBy(column.alias(name)).agg(*made)
    text = F.col(f"`{name}`").cast("string") if not isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else F.to_json(f"`{name}`")
    out = out.select(F.coalesce(text, every).alias("id"), *(F.col(f"`{c}`") for c in out.columns if c != "_rows" and c != "id"), *([F.col("id").alias("id_")] if name == "id" else []))
    return out.orderBy(order_key(F.col(f"`{name}`") if name != "id" else F.col("id_"), kind).asc_nulls_first())


def run_pipeline(collection, pipeline: Pipeline) -> DataFrame:
    """collection: gives the DataFrame of a collection's name."""
    pipeline.validate()
    df = None if pipeline.stages and pipeline.stages[0][0] == "match" else collection(pipeline.collection)
    for kind, *args in pipeline.stages:
        if kind == "match":
            df = run(collection(args[0].collection), args[0])
        elif kind == "project":
            df = df.select(*project(df.schema, ["id", *(p for p in args[0] if p != "id")] if "id" in df.columns else list(args[0])))
        elif kind == "sort":
            df = df.orderBy(*sort_columns(df, [tuple(args)]))
        elif kind == "limit":
            df = df.limit(args[0])
        elif kind == "offset":
            df = df.offset(args[0])
        elif kind == "unwind":
            name = args[0]
            known = name in df.columns and isinstance(df.schema[name].dataType, T.ArrayType)
            df = df.withColumn(name, F.explode(F.col(f"`{name}`"))) if known else df.limit(0)
        else:
            df = _group(df, *args)
    return df

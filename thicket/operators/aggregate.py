"""Simple aggregates over admitted rows, in one pass.

Columns are `count`, `sum_f`, `avg_f`, `min_f`, `max_f`, all DOUBLE. Only numbers count; another kind of
field counts as having none. Of no number the sum and the average are 0 and the extremes are absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPS = ("count", "sum", "avg", "min", "max")


def _number(df: DataFrame, name: str) -> Column:
    known = name in df.columns and isinstance(df.schema[name].dataType, T.NumericType)
    return F.col(f"`{name}`").cast("double") if known else F.lit(None).cast("double")


def simple(df: DataFrame, aggregates) -> DataFrame:
    out = []
    for op, name in aggregates:
        if op not in OPS or (name is None) != (op == "count"):
            raise ValueError(f"no aggregate {op!r} of {name!r}")
        if op == "count":
            out.append(F.count(F.lit(1)).cast("double").alias("count"))
        elif op in ("sum", "avg"):
            of = getattr(F, op)(_number(df, name))
            out.append(F.coalesce(of, F.lit(0.0)).alias(f"{op}_{name}"))
        else:
            out.append(getattr(F, op)(_number(df, name)).alias(f"{op}_{name}"))
    return df.agg(*out)

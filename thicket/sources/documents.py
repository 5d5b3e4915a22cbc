"""Documents as JSON, in and out, dynamic documents, and backups.

JSON documents have their fields in sorted order, with `_time`; NaN and infinities become null; binary
values become arrays of numbers; references become {"__ref__": "collection/id"}.

A dynamic document is a VARIANT column. It keeps an explicit null apart from an absent field, and
`dynamic` compares its values with the engine's rules; `order_key` makes such values sortable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import parts_of
from ..functions.values import WEIGHTS, _by_weight, all_of, compare, kind_of, parse_number


def _plain(column: Column, kind: T.DataType) -> Column:
    """A value as JSON shows it."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(column) & (F.abs(column) != float("inf")), column)
    if isinstance(kind, T.BinaryType):
        bytes_of = F.sequence(F.lit(1), F.octet_length(column))
        numbers = F.transform(bytes_of, lambda i: F.conv(F.hex(F.substring(column, i, F.lit(1))), 16, 10).cast("int"))
        return F.when(F.octet_length(column) > 0, numbers).when(column.isNotNull(), F.array().cast("array<int>"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(column.cast("timestamp"))
    if isinstance(kind, T.StructType):
        if set(kind.names) == {"collection", "doc_id"}:
            return F.when(column.isNotNull(), F.struct(F.concat_ws("/", column["collection"], column["doc_id"]).alias("__ref__")))
        return F.when(column.isNotNull(), F.struct(*(_plain(column[n], kind[n].dataType).alias(n) for n in kind.names)))
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: _plain(x, kind.elementType))
    return column


def to_json(df: DataFrame) -> DataFrame:
    """(id, json): one document a row."""
    names = sorted(c for c in df.columns if c != "id")
    fields = [_plain(F.col(f"`{c}`"), df.schema[c].dataType).alias(c) for c in names]
    return df.select("id", F.to_json(F.struct(*fields)).alias("json"))


def from_json(df: DataFrame, schema: str | None = None) -> DataFrame:
    """df: id, json. Typed columns by a schema, or one VARIANT column `doc`."""
    if schema is None:
        return df.select("id", F.try_parse_json("json").alias("doc"))
    return df.select("id", F.from_json("json", schema).alias("d")).select("id", "d.*")


def backup(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


def restore_backup(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _at(doc: Column, path: str) -> tuple[Column, Column]:
    """The value at a dotted path and its kind: null, bool, number, string, array, map; no kind if absent."""
    parts = parts_of(path)
    value = F.try_variant_get(doc, "$" + "".join(f"['{p}']" for p in parts or ["\x00"]), "variant")
    of = F.schema_of_variant(value)
    kind = (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(F.is_variant_null(value), "null")
        .when(of == "BOOLEAN", "bool")
        .when(of == "STRING", "string")
        .when(of.startswith("ARRAY"), "array")
        .when(of.startswith("OBJECT"), "map")
        .when(of.startswith("TIMESTAMP") | (of == "DATE"), "timestamp")
        .otherwise("number")
    )
    return value, kind


def dynamic(doc: Column, path: str, op: str, value) -> Column:
    """A comparison with the value at a path of a VARIANT document; false where it is absent."""
    at, kind = _at(doc, path)
    got = lambda t: F.try_variant_get(at, "$", t)
    asked = kind_of(value)
    if asked == "null":
        held = F.when(kind == "null", F.lit(op in ("eq", "gte", "lte"))).otherwise(F.lit(op in ("ne", "gt", "gte")))
        return F.coalesce(kind.isNotNull() & held, F.lit(False))
    whole = isinstance(value, int) or (isinstance(value, str) and isinstance(parse_number(value), int))
    number = got("bigint") if whole else got("double")
    number_type: T.DataType = T.LongType() if whole else T.DoubleType()
    exact = F.when(number.isNotNull(), compare(number, number_type, op, value)).otherwise(compare(got("double"), T.DoubleType(), op, value))
    held = (
        F.when(kind == "number", exact)
        .when(kind == "string", compare(got("string"), T.StringType(), op, value))
        .when(kind == "bool", compare(got("boolean"), T.BooleanType(), op, value))
    )
    for other in ("null", "array", "map", "timestamp"):
        held = held.when(kind == other, _by_weight(op, other, asked))
    return F.coalesce(held, F.lit(False))


def dynamic_filter(df: DataFrame, filters: list[tuple], column: str = "doc") -> DataFrame:
    return df.filter(all_of([dynamic(F.col(column), *f) for f in filters]))


def order_key(doc: Column, path: str) -> Column:
    """What sorts dynamic values: by kind, then within it; arrays and maps by length, then their JSON.
    Absent values are null and so come first."""
    value, kind = _at(doc, path)
    got = lambda t: F.try_variant_get(value, "$", t)
    weight = F.lit(None).cast("int")
    for name, w in WEIGHTS.items():
        weight = F.when(kind == name, w).otherwise(weight)
    size = F.coalesce(F.size(got("array<variant>")), F.size(F.map_keys(got("map<string,variant>"))))
    return F.when(
        kind.isNotNull(),
        F.struct(
            weight.alias("weight"),
            F.coalesce(got("double"), F.when(kind == "bool", got("boolean").cast("double"))).alias("num"),
            F.when(kind == "number", got("bigint")).alias("int"),
            F.when(kind.isin("array", "map"), size).alias("size"),
            F.when(kind == "string", got("string")).when(kind.isin("array", "map"), F.to_json(value)).alias("str"),
        ),
    )

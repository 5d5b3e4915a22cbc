"""Comparison of stored values with filter values.

Types are ordered by weight (null, bool, number, timestamp, string, binary, reference, array, map). A
filter value of another type is converted where a rule below says so; otherwise weights decide, so a
filter `gt 5` on an unparsable string holds. Absent values (NULL in a typed column) match no operator.

Conversions: string against number parses the string; bool against number counts as 0 or 1; bool
against string takes "true" and "false" in any case, and matches nothing else, not even `ne`.
Floating-point NaN matches no ordering and equals only NaN.
"""

from __future__ import annotations

import math
import re
from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The order of types.
WEIGHTS = {"null": 0, "bool": 1, "number": 2, "timestamp": 3, "string": 4, "binary": 5, "reference": 6, "array": 7, "map": 8}
INTEGER, DECIMAL = r"^[+-]?[0-9]+$", r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
ORDERINGS = ("gt", "gte", "lt", "lte")
COMPARISONS = ("eq", "ne", *ORDERINGS)


def kind_of(value) -> str:
    """The type of a filter value."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, (datetime, date)):
        return "timestamp"
    if isinstance(value, str):
        return "string"
    if isinstance(value, (bytes, bytearray)):
        return "binary"
    if isinstance(value, (list, tuple)):
        return "array"
    return "map"


def kind_of_type(kind: T.DataType) -> str:
    """The type of a column."""
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "timestamp"
    if isinstance(kind, T.StringType):
        return "string"
    if isinstance(kind, T.BinaryType):
        return "binary"
    if isinstance(kind, T.ArrayType):
        return "array"
    if isinstance(kind, T.StructType) and set(kind.names) == {"collection", "doc_id"}:
        return "reference"
    return "map"


def _ordered(left: Column, op: str, right: Column) -> Column:
    return {"eq": left == right, "ne": left != right, "gt": left > right, "gte": left >= right, "lt": left < right, "lte": left <= right}[op]


def _decided(op: str, order: int) -> bool:
    """The outcome of an operator when left is below (-1), equal to (0) or above (1) right."""
    return {"eq": order == 0, "ne": order != 0, "gt": order > 0, "gte": order >= 0, "lt": order < 0, "lte": order <= 0}[op]


def _by_weight(op: str, left: str, right: str) -> Column:
    a, b = WEIGHTS[left], WEIGHTS[right]
    return F.lit(_decided(op, (a > b) - (a < b)))


def parse_number(text: str) -> int | float | None:
    """The number that a string spells, without white space around it."""
    if re.match(INTEGER, text) and -(2**63) <= int(text) < 2**63:
        return int(text)
    return float(text) if re.match(DECIMAL, text) else None


def literal(value) -> Column:
    if isinstance(value, (list, tuple)):
        return F.array(*map(literal, value))
    if isinstance(value, dict):
        return F.struct(*(literal(v).alias(k) for k, v in value.items()))
    return F.lit(bytes(value)) if isinstance(value, bytearray) else F.lit(value)


def _numbers(column: Column, kind: T.DataType, op: str, value) -> Column:
    """A number column against a number; NaN matches nothing but an equal NaN."""
    if isinstance(value, float) and math.isnan(value):
        floating = isinstance(kind, (T.DoubleType, T.FloatType))
        return F.isnan(column) if op == "eq" and floating else F.lit(False)
    found = _ordered(column, op, F.lit(value))
    if isinstance(kind, (T.DoubleType, T.FloatType)) and op in ("ne", "gt", "gte"):
        found = found & ~F.isnan(column)
    return found


def _parsed(column: Column, value) -> Column:
    """A string column as the number type of the filter value; null where it spells none."""
    if isinstance(value, int):
        return F.when(column.rlike(INTEGER), column.try_cast("bigint"))
    return F.when(column.rlike(DECIMAL), column.try_cast("double"))


def compare(column: Column, kind: T.DataType, op: str, value) -> Column:
    """Whether the stored value stands in relation `op` to `value`; false where it is absent."""
    left, right = kind_of_type(kind), kind_of(value)
    if left == right == "number":
        found = _numbers(column, kind, op, value)
    elif left == "bool" and right == "number":
        found = _ordered(column.cast("double" if isinstance(value, float) else "bigint"), op, F.lit(value))
    elif left == "number" and right == "bool":
        found = _numbers(column, kind, op, int(value))
    elif left == "string" and right == "number":
        number = _parsed(column, value)
        found = F.when(number.isNotNull(), _numbers(number, T.DoubleType() if isinstance(value, float) else T.LongType(), op, value))
        found = found.otherwise(_by_weight(op, left, right))
    elif left == "number" and right == "string":
        number = parse_number(value)
        found = _by_weight(op, left, right) if number is None else _numbers(column, kind, op, number)
    elif left == "bool" and right == "string":
        said = value.strip().lower()
        found = _ordered(column, op, F.lit(said == "true")) if said in ("true", "false") else F.lit(False)
    elif left == "string" and right == "bool":
        said = F.lower(F.trim(column))
        found = F.when(said.isin("true", "false"), _ordered(said == "true", op, F.lit(value))).otherwise(False)
    elif left == "array" and right == "array" and op in ORDERINGS:  # the longer array is greater
        size, other = F.size(column), F.lit(len(value))
        found = F.when(size != other, _ordered(size, op, other)).otherwise(_ordered(column, op, literal(value).cast(kind)))
    elif left == "reference" and right == "string":  # written "collection/id"
        found = _ordered(F.concat_ws("/", column["collection"], column["doc_id"]), op, F.lit(value))
    elif left == right:
        found = _ordered(column, op, literal(value).cast(kind) if right in ("array", "map") else literal(value))
    else:
        found = _by_weight(op, left, right)
    if right in ("array", "map", "reference") or left != right:
        found = F.coalesce(found, F.lit(False))
    return column.isNotNull() & found  # scalars of one kind compare to null only if absent; this form is pushed to scans


def same(column: Column, kind: T.DataType, value) -> Column:
    """Equality without conversions, as array membership uses it: numbers equal across types, else
    types must agree; floating-point zeros differ by sign and NaN equals NaN."""
    left, right = kind_of_type(kind), kind_of(value)
    if left != right:
        return F.lit(False)
    if left == "number" and isinstance(kind, (T.DoubleType, T.FloatType)) and value == 0:
        negative = F.lit(str(float(value)).startswith("-"))
        equal = (column == F.lit(value)) & (column.cast("string").startswith("-") == negative)
    else:
        equal = column == (literal(value).cast(kind) if right in ("array", "map") else literal(value))
    return F.coalesce(equal, F.lit(False))


def order_key(column: Column, kind: T.DataType) -> Column:
    """What ORDER BY sorts by: arrays and maps by their length first; absent values come first."""
    if isinstance(kind, T.ArrayType):
        return F.when(column.isNotNull(), F.struct(F.size(column), column))
    if isinstance(kind, T.MapType):
        entries = F.map_entries(column)
        return F.when(column.isNotNull(), F.struct(F.size(entries), entries))
    return column


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))

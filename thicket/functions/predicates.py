"""Filters and their compilation to columns.

A filter is (field, operator, value). All plain filters must hold; of all `or` filters together at
least one must; an element match holds if one element satisfies all its filters. An absent field, also
one that the schema does not have, matches no operator.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text
from .paths import Resolver, of_element, of_row
from .values import COMPARISONS, all_of, any_of, compare, kind_of_type, same

#: The operators' names.
OPERATORS = [*COMPARISONS, "in", "not_in", "array_contains", "array_contains_any", "array_all_eq", "contains", "starts_with", "match", "match_prefix", "near", "traverse"]


@dataclass(frozen=True)
class Filter:
    field: str
    op: str
    value: object

    def __post_init__(self):
        if self.op not in OPERATORS:
            raise ValueError(f"unknown operator {self.op!r}")

    @staticmethod
    def from_json(raw: str) -> list["Filter"]:
        """[{"field": ..., "op": ..., "value": ...}, ...]; a missing op is `eq`."""
        return [Filter(x["field"], x.get("op", "eq"), x.get("value")) for x in json.loads(raw)]


@dataclass(frozen=True)
class ElemMatch:
    field: str
    filters: tuple[Filter, ...]

    def __post_init__(self):
        if not self.filters:
            raise ValueError("an element match needs a filter")


def compile_filter(find: Resolver, f: Filter) -> Column:
    """The filter as a condition that is never null."""
    if f.op in ("near", "traverse"):  # markers; only their own operators evaluate them
        return F.lit(False)
    at = find(f.field)
    if at is None:
        return F.lit(False)
    column, kind = at
    if f.field == "id" and f.op in COMPARISONS and isinstance(f.value, (int, float)) and not isinstance(f.value, bool):
        return compare(column, kind, f.op, str(f.value))  # ids are strings
    if f.op in COMPARISONS:
        return compare(column, kind, f.op, f.value)
    if f.op in ("in", "not_in"):
        if not isinstance(f.value, (list, tuple)):
            return column.isNotNull() if f.op == "not_in" else F.lit(False)
        items = [v for v in f.value if f.field != "id" or isinstance(v, str)]
        if items and all(isinstance(v, str) for v in items) and kind_of_type(kind) == "string":
            among = column.isin(items)
        else:
            among = any_of([compare(column, kind, "eq", v) for v in items])
        return column.isNotNull() & (~among if f.op == "not_in" else among)
    if f.op.startswith("array_"):
        if not isinstance(kind, T.ArrayType):
            return F.lit(False)
        of = kind.elementType
        if f.op == "array_all_eq":
            held = (F.size(column) > 0) & F.forall(column, lambda x: same(x, of, f.value))
        elif f.op == "array_contains":
            held = F.exists(column, lambda x: same(x, of, f.value))
        else:
            items = f.value if isinstance(f.value, (list, tuple)) else []
            held = any_of([_member(column, of, v) for v in items])
        return F.coalesce(held, F.lit(False))
    if kind_of_type(kind) != "string" or not isinstance(f.value, str):
        return F.lit(False)
    if f.op == "contains":
        held = column.contains(f.value)
    elif f.op == "starts_with":
        held = column.startswith(f.value)
    else:
        held = text.match(column, f.value) if f.op == "match" else text.match_prefix(column, f.value)
    return column.isNotNull() & held


def _member(column: Column, of: T.DataType, value) -> Column:
    return F.exists(column, lambda x: same(x, of, value))


def compile_elem_match(find: Resolver, e: ElemMatch) -> Column:
    at = find(e.field)
    if at is None or not isinstance(at[1], T.ArrayType):
        return F.lit(False)
    column, kind = at
    every = lambda x: all_of([compile_filter(of_element(x, kind.elementType), f) for f in e.filters])
    return F.coalesce(F.exists(column, every), F.lit(False))


def condition(schema: T.StructType, filters=(), or_filters=(), elem_matches=()) -> Column:
    find = of_row(schema)
    parts = [compile_filter(find, f) for f in filters]
    if or_filters:
        parts.append(any_of([compile_filter(find, f) for f in or_filters]))
    return all_of(parts + [compile_elem_match(find, e) for e in elem_matches])

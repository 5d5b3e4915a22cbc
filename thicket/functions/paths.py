"""Dotted paths into nested columns.

A path descends through structs and maps only; an array on the way makes the value absent. Projection
prunes: it keeps the named subtrees, prunes every element of an array, and stops at a scalar ("leaf
preserving": `name.first` keeps a scalar `name`). A malformed path (an empty part) names nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Resolver = Callable[[str], tuple[Column, T.DataType] | None]


def parts_of(path: str) -> list[str] | None:
    parts = path.split(".")
    return parts if all(parts) else None


def descend(column: Column, kind: T.DataType, parts: list[str]) -> tuple[Column, T.DataType] | None:
    """The value below `column`, or None if the type has no such place."""
    for part in parts:
        if isinstance(kind, T.StructType) and part in kind.names:
            column, kind = column[part], kind[part].dataType
        elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
            column, kind = F.element_at(column, F.lit(part)), kind.valueType
        else:
            return None
    return column, kind


def of_row(schema: T.StructType) -> Resolver:
    """Finds paths from a row. A column whose own name has dots is found by its whole name."""

    def find(path: str):
        if path in schema.names:
            return F.col(f"`{path}`"), schema[path].dataType
        parts = parts_of(path)
        if not parts or parts[0] not in schema.names:
            return None
        return descend(F.col(f"`{parts[0]}`"), schema[parts[0]].dataType, parts[1:])

    return find


def of_element(element: Column, kind: T.DataType) -> Resolver:
    """Finds paths from an array's element; the empty path is the element."""

    def find(path: str):
        if not path:
            return element, kind
        parts = parts_of(path)
        return descend(element, kind, parts) if parts else None

    return find


def _tree(paths: list[str]) -> dict:
    """Nested names; an empty dict keeps the whole subtree, also when deeper paths are named too."""
    tree: dict = {}
    whole: set[tuple[str, ...]] = set()
    for path in paths:
        parts = parts_of(path)
        if not parts:
            continue
        at = tree
        for i, part in enumerate(parts):
            if tuple(parts[:i]) in whole:
                break
            at = at.setdefault(part, {})
        else:
            at.clear()
            whole.add(tuple(parts))
    return tree


def _pruned(column: Column, kind: T.DataType, tree: dict) -> Column | None:
    if not tree:
        return column
    if isinstance(kind, T.StructType):
        kept = [(n, _pruned(column[n], kind[n].dataType, tree[n])) for n in kind.names if n in tree]
        kept = [c.alias(n) for n, c in kept if c is not None]
        return F.when(column.isNotNull(), F.struct(*kept)) if kept else None
    if isinstance(kind, T.ArrayType):
        if _pruned(F.lit(None), kind.elementType, tree) is None:
            return None
        return F.transform(column, lambda x: _pruned(x, kind.elementType, tree))
    if isinstance(kind, T.MapType):
        return F.map_filter(column, lambda k, _: k.isin(*tree))
    return column


def project(schema: T.StructType, paths: list[str]) -> list[Column]:
    """Columns with the named subtrees only, in the schema's order."""
    exact = [p for p in paths if p in schema.names]
    tree = _tree([p for p in paths if p not in exact])
    out = []
    for name in schema.names:
        column = F.col(f"`{name}`")
        if name in exact:
            out.append(column)
        elif name in tree:
            kept = _pruned(column, schema[name].dataType, tree[name])
            if kept is not None:
                out.append(kept.alias(name))
    return out

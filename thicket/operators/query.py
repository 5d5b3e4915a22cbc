"""The fluent query: filter, then sort, offset and limit, then project; always in that order.

Rows with equal sort keys are ordered by id, so pages are stable. Cursors are bounds on the sort keys
(all of them, lexicographically) and hold whatever the plan is.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import of_row, project
from ..functions.predicates import ElemMatch, Filter, condition
from ..functions.values import order_key
from . import aggregate


@dataclass(frozen=True)
class Query:
    collection: str
    filters: tuple[Filter, ...] = ()
    or_filters: tuple[Filter, ...] = ()
    elem_matches: tuple[ElemMatch, ...] = ()
    order: tuple[tuple[str, bool], ...] = ()
    n_limit: int | None = None
    n_offset: int = 0
    fields: tuple[str, ...] = ()
    aggregates: tuple[tuple[str, str | None], ...] = ()
    cursors: tuple[tuple[str, tuple], ...] = field(default=())

    def where(self, name: str, op: str, value) -> "Query":
        return replace(self, filters=(*self.filters, Filter(name, op, value)))

    def where_eq(self, name: str, value) -> "Query":
        return self.where(name, "eq", value)

    def where_gt(self, name: str, value) -> "Query":
        return self.where(name, "gt", value)

    def where_json(self, raw: str) -> "Query":
        return replace(self, filters=(*self.filters, *Filter.from_json(raw)))

    def or_where(self, name: str, op: str, value) -> "Query":
        """Adds to the one group of alternatives; rows must fit one of them besides all filters."""
        return replace(self, or_filters=(*self.or_filters, Filter(name, op, value)))

    def elem_match(self, name: str, *filters: tuple) -> "Query":
        made = tuple(f if isinstance(f, Filter) else Filter(*f) for f in filters)
        return replace(self, elem_matches=(*self.elem_matches, ElemMatch(name, made)))

    def where_near(self, name: str, vector: list[float], metric: str = "cosine") -> "Query":
        return self.where(name, "near", {"vector": list(vector), "metric": metric})

    def where_traverse(self, collection: str, doc_id: str, direction: str = "out", depth: int = 1, **spec) -> "Query":
        return self.where("", "traverse", {"collection": collection, "id": doc_id, "direction": direction, "max_depth": depth, **spec})

    def order_by(self, name: str, asc: bool = True) -> "Query":
        return replace(self, order=(*self.order, (name, asc)))

    def limit(self, n: int) -> "Query":
        return replace(self, n_limit=n)

    def offset(self, n: int) -> "Query":
        return replace(self, n_offset=n)

    def select(self, *names: str) -> "Query":
        return replace(self, fields=(*self.fields, *names))

    def aggregate(self, op: str, name: str | None = None) -> "Query":
        return replace(self, aggregates=(*self.aggregates, (op, name)))

    def _cursor(self, kind: str, values: tuple) -> "Query":
        return replace(self, cursors=(*self.cursors, (kind, values)))

    def start_at(self, *values) -> "Query":
        return self._cursor("start_at", values)

    def start_after(self, *values) -> "Query":
        return self._cursor("start_after", values)

    def end_at(self, *values) -> "Query":
        return self._cursor("end_at", values)

    def end_before(self, *values) -> "Query":
        return self._cursor("end_before", values)

    def marker(self, op: str) -> Filter | None:
        """The one `near` or `traverse` filter; more than one, or one beside alternatives, is refused."""
        found = [f for f in self.filters if f.op == op]
        if any(f.op == op for f in self.or_filters) or len(found) > 1 or (found and self.or_filters):
            raise ValueError(f"a query takes one {op!r} filter, and no alternatives beside it")
        return found[0] if found else None

    def without(self, op: str) -> "Query":
        return replace(self, filters=tuple(f for f in self.filters if f.op != op))


def sort_columns(df: DataFrame, order) -> list[Column]:
    """ORDER BY columns: absent values first ascending and last descending, ties by id."""
    find, out, names = of_row(df.schema), [], [n for n, _ in order]
    for name, asc in order:
        at = find(name)
        if at is not None:
            key = order_key(*at)
            out.append(key.asc_nulls_first() if asc else key.desc_nulls_last())
    if "id" not in names and "id" in df.columns:
        out.append(F.col("id").asc())
    return out


def _bound(df: DataFrame, order, kind: str, values: tuple) -> Column:
    """Rows at or beyond the bound on one side. A bound may have fewer values than there are keys."""
    find = of_row(df.schema)
    keys = [(find(n), asc) for n, asc in (order or (("id", True),))]
    keys = [(order_key(*at), asc) for at, asc in keys if at is not None][: len(values)]
    after = kind.startswith("start")
    beyond, equal = F.lit(False), F.lit(True)
    for (key, asc), value in zip(keys, values):
        # An absent value sorts below every other one.
        up = key.isNotNull() if value is None else F.coalesce(key > F.lit(value), F.lit(False))
        down = F.lit(False) if value is None else F.coalesce(key < F.lit(value), F.lit(True))
        beyond = beyond | (equal & (up if asc == after else down))
        equal = equal & key.eqNullSafe(F.lit(value))
    return beyond | equal if kind.endswith("_at") else beyond


def anchor(df: DataFrame, doc_id: str, order) -> tuple:
    """A document's values of the sort keys, for a cursor that starts or ends at it."""
    find = of_row(df.schema)
    row = df.filter(F.col("id") == doc_id).select(*(find(n)[0].alias(f"k{i}") for i, (n, _) in enumerate(order))).first()
    if row is None or any(v is None for v in row):
        raise KeyError(f"no document {doc_id!r} with all sort keys")
    return tuple(row)


def matching(df: DataFrame, query: Query) -> DataFrame:
    """The rows that the filters admit."""
    return df.filter(condition(df.schema, query.filters, query.or_filters, query.elem_matches))


def page(df: DataFrame, query: Query) -> DataFrame:
    """Sort, cursors, offset, limit and projection over admitted rows."""
    for kind, values in query.cursors:
        df = df.filter(_bound(df, query.order, kind, values))
    if query.order or query.cursors or query.n_offset or query.n_limit is not None:
        df = df.orderBy(*sort_columns(df, query.order))
    if query.n_offset:
        df = df.offset(query.n_offset)
    if query.n_limit is not None:
        df = df.limit(query.n_limit)
    if query.fields:
        names = [n for n in ("id", "_time") if n in df.columns and n not in query.fields]
        df = df.select(*project(df.schema, [*names, *query.fields]))
    return df


def run(df: DataFrame, query: Query) -> DataFrame:
    """The query's result over its collection. Aggregates read all admitted rows, whatever the page."""
    rows = matching(df, query)
    return aggregate.simple(rows, query.aggregates) if query.aggregates else page(rows, query)

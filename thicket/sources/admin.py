"""Administration of an engine's collections: names, rights, audit, caching, rewriting, walking.

`Catalog` wraps an Engine. Its registry is the driver's; data stays in the tables that collections read.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from fnmatch import fnmatch

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..operators.mutate import allowed
from ..operators.query import Query
from ..plans.explain import report
from .collections import Engine


class Catalog:
    def __init__(self, engine: Engine, rules: list[tuple[str, bool]] = (), read_only: bool = False):
        self.engine, self.rules, self.read_only = engine, list(rules), read_only
        self.log: list[tuple[int, str, str, bool]] = []
        self.loaded: dict[str, DataFrame] = {}

    def _admit(self, action: str, name: str, writes: bool = False) -> None:
        """Records the attempt; refuses what the rules or the read-only mode forbid."""
        ok = allowed(self.rules, name) and not (writes and self.read_only)
        self.log.append((time.time_ns() // 1000, action, name, ok))
        if not ok:
            raise PermissionError(f"{action} of {name!r} is not allowed")

    def query(self, q: Query) -> DataFrame:
        self._admit("query", q.collection)
        return self.engine.query(q)

    def explain(self, q: Query) -> dict:
        """The plan's pushed filters, columns, exchanges and text."""
        return report(self.engine.query(q))

    def audit_log(self) -> DataFrame:
        return self.engine.spark.createDataFrame(self.log, "at bigint, action string, collection string, allowed boolean")

    def list_collections(self, pattern: str = "*") -> list[str]:
        return sorted(n for n in self.engine.sources if fnmatch(n, pattern))

    def rename(self, old: str, new: str) -> None:
        self._admit("rename", old, True)
        if new in self.engine.sources:
            raise ValueError(f"{new!r} exists")
        self.engine.sources[new] = self.engine.sources.pop(old)
        if old in self.engine.keys:
            self.engine.keys[new] = self.engine.keys.pop(old)

    def drop(self, name: str) -> bool:
        """Forgets a collection; its files stay."""
        self._admit("drop", name, True)
        self.engine.keys.pop(name, None)
        return self.engine.sources.pop(name, None) is not None

    def relocate(self, source: str, target: str, query: Query) -> tuple[DataFrame, DataFrame]:
        """(source without the admitted rows, target with them): two next states to commit together."""
        from ..operators.mutate import delete_where, put
        from ..operators.query import matching

        self._admit("relocate", source, True)
        df = self.engine.collection(source)
        return delete_where(df, query), put(self.engine.collection(target), matching(df, query))

    def compact(self, name: str, path: str, rows_per_file: int = 5_000_000, by: str = "id") -> DataFrame:
        """Rewrites a collection, sorted within files so that row groups can be skipped by `by`."""
        self._admit("compact", name, True)
        self.engine.collection(name).repartitionByRange(by).sortWithinPartitions(by).write.option("maxRecordsPerFile", rows_per_file).parquet(path)
        return self.engine.spark.read.parquet(path)

    def load(self, *patterns: str) -> list[str]:
        """Keeps the collections that fit a pattern in the executors' memory, spilling to their disks."""
        names = [n for n in self.list_collections() if any(fnmatch(n, p) for p in patterns) and n not in self.loaded]
        for n in names:
            df = self.loaded[n] = self.engine.collection(n).persist()
            df.count()
            self.engine.sources[n] = lambda df=df: df
        return names

    def unload(self, name: str) -> None:
        """Frees the memory; the cached table is read anew from its source when it is needed."""
        if name in self.loaded:
            self.loaded.pop(name).unpersist()

    @contextmanager
    def cancellable(self, group: str):
        """Jobs begun inside can be ended by `cancel(group)` from another thread."""
        context = self.engine.spark.sparkContext
        context.setJobGroup(group, group, interruptOnCancel=True)
        try:
            yield
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)

    def cancel(self, group: str) -> None:
        self.engine.spark.sparkContext.cancelJobGroup(group)


def walk(df: DataFrame, visit: Callable[[Row], bool | None]) -> int:
    """Calls `visit` for each row on the driver, one partition in memory at a time; stops when it returns
    False. Gives the number of rows visited."""
    n = 0
    for row in df.toLocalIterator(prefetchPartitions=True):
        n += 1
        if visit(row) is False:
            break
    return n


def walk_partitions(df: DataFrame, visit: Callable[[Iterator[Row]], None]) -> None:
    """Calls `visit` on the executors, once a partition."""
    df.foreachPartition(visit)


def conflicts(df: DataFrame, read: DataFrame) -> DataFrame:
    """(id, seen, now): documents that changed since a transaction read them. read: id, _time, null for
    one that was absent. A commit goes ahead only if there are none."""
    now = df.select("id", F.col("_time").alias("now"))
    seen = read.select("id", F.col("_time").alias("seen"))
    return seen.join(now, "id", "left").filter(~F.col("seen").eqNullSafe(F.col("now")))

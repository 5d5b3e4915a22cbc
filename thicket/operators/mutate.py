"""Changes to collections as functions from tables to tables, for a writer to commit.

Nothing is changed in place: a result is the next state of the collection. Batches hold one row an
operation: seq (their order), op (put, patch, delete, soft_delete), id, and for puts and patches the
fields. The last operation on an id wins, and a patch applies to what the ones before it left.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import condition
from .query import Query, matching

RETENTION = 24 * 3600 * 1_000_000  # microseconds
OPS = ("put", "patch", "delete", "soft_delete")


def now_us() -> int:
    return time.time_ns() // 1000


def with_ids(df: DataFrame, nanos: int | None = None) -> DataFrame:
    """Gives rows with an empty or missing id one of 16 hexadecimal digits of time and 4 of sequence.

    Rows beyond 65,536 of one batch take later nanoseconds, so ids stay distinct and in order.
    """
    base = F.lit(time.time_ns() if nanos is None else nanos) + F.col("_n").cast("bigint")
    stamp, sequence = base.bitwiseAND(F.lit(~0xFFFF)) + F.lit(0), base.bitwiseAND(F.lit(0xFFFF))
    made = F.lower(F.concat(F.lpad(F.hex(stamp), 16, "0"), F.lpad(F.hex(sequence), 4, "0")))
    rows = df.withColumn("_n", F.monotonically_increasing_id())
    return rows.withColumn("id", F.when(F.coalesce("id", F.lit("")) == "", made).otherwise(F.col("id"))).drop("_n")


def put(df: DataFrame, new: DataFrame) -> DataFrame:
    """Whole rows replace those of the same id; a repeated id in `new` must not occur."""
    return df.join(new.select("id"), "id", "left_anti").select(*df.columns).unionByName(new, allowMissingColumns=True)


def patch_where(df: DataFrame, query: Query, updates: dict) -> DataFrame:
    """Sets fields of the rows that the query admits; a new field is added."""
    hit = condition(df.schema, query.filters, query.or_filters, query.elem_matches)
    kept = [F.when(hit, F.lit(updates[c])).otherwise(F.col(f"`{c}`")).cast(df.schema[c].dataType).alias(c) if c in updates else F.col(f"`{c}`") for c in df.columns]
    return df.select(*kept, *(F.when(hit, F.lit(v)).alias(c) for c, v in updates.items() if c not in df.columns))


def delete_where(df: DataFrame, query: Query) -> DataFrame:
    """Without the rows that the query admits; nothing is retained of them."""
    return df.filter(~condition(df.schema, query.filters, query.or_filters, query.elem_matches))


def apply_batch(df: DataFrame, ops: DataFrame, stamp: int | None = None) -> DataFrame:
    """The state after a batch. Operations are folded for each id before they meet the collection, so the
    collection is shuffled once and no id's operations are gathered: for each field, the last patch
    after the last put or delete counts."""
    fields = [c for c in df.columns if c not in ("id", "_time")]
    ops = ops.filter(F.col("op").isin(*OPS))
    whole = ops.filter("op <> 'patch'").groupBy("id").agg(F.max("seq").alias("base_seq"), F.max_by(F.struct("op", *(c for c in fields if c in ops.columns)), "seq").alias("base"))
    patches = ops.join(whole.select("id", "base_seq"), "id", "left").filter("op = 'patch' AND seq > coalesce(base_seq, -1)")
    given = [c for c in fields if c in ops.columns]
    last = [F.max(F.when(F.col(c).isNotNull(), F.struct("seq", F.col(c).alias("v"))))["v"].alias(f"p_{c}") for c in given]
    folded = patches.groupBy("id").agg(F.max("seq").alias("p_seq"), *last).join(whole, "id", "full_outer")
    rows = df.join(folded.withColumnRenamed("id", "o_id"), F.col("id") == F.col("o_id"), "full_outer")
    touched, based = F.col("o_id").isNotNull(), F.col("base_seq").isNotNull()
    out = [F.coalesce("id", "o_id").alias("id")]
    for c in fields:
        if c in given:
            before = F.when(based, F.col(f"base.{c}")).otherwise(F.col(f"`{c}`"))
            before = F.when(based & (F.col("base.op") != "put"), F.lit(None)).otherwise(before)
            out.append(F.coalesce(F.col(f"p_{c}"), before).cast(df.schema[c].dataType).alias(c))
        else:
            out.append(F.when(based, F.lit(None)).otherwise(F.col(f"`{c}`")).cast(df.schema[c].dataType).alias(c))
    at = F.lit(now_us() if stamp is None else stamp)
    if "_time" in df.columns:
        out.append(F.when(touched, at).otherwise(F.col("_time")).cast("bigint").alias("_time"))
    gone = based & (F.col("base.op") != "put") & F.col("p_seq").isNull()
    return rows.filter(~F.coalesce(gone, F.lit(False))).select(*out).select(*df.columns)


def soft_delete(df: DataFrame, collection: str, query: Query, stamp: int, retention: int = RETENTION) -> tuple[DataFrame, DataFrame]:
    """(the collection without the rows, their retention records)."""
    gone = matching(df, query)
    records = gone.select(
        F.concat(F.lit(collection + "/"), "id").alias("key"),
        F.lit(collection).alias("collection"),
        "id",
        F.lit(stamp).cast("bigint").alias("deleted_at"),
        F.lit(stamp + retention).cast("bigint").alias("scheduled_at"),
        F.to_json(F.struct(*df.columns)).alias("payload"),
    )
    return delete_where(df, query), records


def restore_available(records: DataFrame, live: DataFrame, collection: str | None = None, at: int | None = None) -> DataFrame:
    """Records that can be restored: not yet due, and their id not put again since. live: key."""
    out = records if collection is None else records.filter(F.col("collection") == collection)
    out = out if at is None else out.filter(F.col("scheduled_at") > at)
    return out.join(live.select("key"), "key", "left_anti").select(*records.columns).orderBy("deleted_at", "key")


def restore(df: DataFrame, records: DataFrame, collection: str, doc_id: str) -> DataFrame:
    """The collection with the record's row back; a row put since then stays as it is."""
    schema = T.StructType(df.schema.fields)
    back = records.filter((F.col("collection") == collection) & (F.col("id") == doc_id))
    back = back.select(F.from_json("payload", schema).alias("d")).select("d.*")
    return df.unionByName(back.join(df.select("id"), "id", "left_anti").select(*df.columns))


def delete_queue(records: DataFrame, at: int) -> DataFrame:
    """Records by the time they are due, with the microseconds left."""
    return records.withColumn("left_us", F.greatest(F.col("scheduled_at") - at, F.lit(0))).orderBy("scheduled_at", "key")


def sweep(records: DataFrame, at: int) -> DataFrame:
    """Records that are not due yet."""
    return records.filter(F.col("scheduled_at") > at)


def unique_violations(df: DataFrame, fields: list[str], sparse: bool = False, where: Column | None = None) -> DataFrame:
    """(fields, n): tuples that more than one row holds. Absent values count as equal; `sparse` leaves
    rows out that lack a field, `where` those outside a partial index."""
    rows = df if where is None else df.filter(F.coalesce(where, F.lit(False)))
    for f in fields if sparse else []:
        rows = rows.filter(F.col(f).isNotNull())
    return rows.groupBy(*fields).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


#: The kinds that a rule can ask for, and the columns that have them.
KINDS = {
    "string": T.StringType, "int": T.IntegralType, "float": T.FractionalType, "bool": T.BooleanType, "array": T.ArrayType,
    "map": (T.StructType, T.MapType), "bytes": T.BinaryType, "timestamp": (T.TimestampType, T.TimestampNTZType),
}


def check_rules(rules: list[dict]) -> None:
    """rules: {name, kind, required, default}; names are distinct top-level ones."""
    names = [r["name"] for r in rules]
    if len(set(names)) < len(names) or any("." in n for n in names):
        raise ValueError("rules have distinct, top-level names")
    of = {"string": str, "int": int, "float": float, "bool": bool}
    for r in rules:
        if r.get("kind", "any") not in (*KINDS, "any", "null"):
            raise ValueError(f"no kind {r['kind']!r}")
        d = r.get("default")
        if d is not None and r.get("kind") in of and (not isinstance(d, of[r["kind"]]) or (r["kind"] != "bool" and isinstance(d, bool))):
            raise ValueError(f"the default of {r['name']!r} is of another kind")


def apply_schema(df: DataFrame, rules: list[dict]) -> DataFrame:
    """Defaults fill what is absent; other columns stay."""
    check_rules(rules)
    for r in rules:
        if r.get("default") is not None:
            name = r["name"]
            old = F.col(f"`{name}`") if name in df.columns else F.lit(None)
            df = df.withColumn(name, F.coalesce(old, F.lit(r["default"])))
    return df


def schema_violations(df: DataFrame, rules: list[dict]) -> DataFrame:
    """(id, field, reason) of rows that break a rule; a batch with any is refused as a whole."""
    check_rules(rules)
    found = []
    for r in rules:
        name, kind = r["name"], r.get("kind", "any")
        has = name in df.columns
        if r.get("required") and r.get("default") is None:
            gone = F.col(f"`{name}`").isNull() if has else F.lit(True)
            found.append(F.when(gone, F.struct(F.lit(name).alias("field"), F.lit("missing").alias("reason"))))
        if has and kind in KINDS and not isinstance(df.schema[name].dataType, KINDS[kind]):
            found.append(F.when(F.col(f"`{name}`").isNotNull(), F.struct(F.lit(name).alias("field"), F.lit("kind").alias("reason"))))
    if not found:
        return df.select("id", F.lit("").alias("field"), F.lit("").alias("reason")).limit(0)
    return df.select("id", F.explode(F.array_compact(F.array(*found))).alias("v")).select("id", "v.field", "v.reason")


def lww_merge(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Last write wins: a remote row (with `deleted`) is taken only if its _time is later than the local
    one; equal times keep the local row. Deletes stay as rows, so that they win over earlier puts."""
    side = local.withColumn("_own", F.lit(1)).unionByName(remote.withColumn("_own", F.lit(0)))
    rest = [c for c in local.columns if c != "id"]
    return side.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct("_time", "_own")).alias("m")).select("id", "m.*").select(*local.columns)


def allowed(rules: list[tuple[str, bool]], collection: str) -> bool:
    """rules: (prefix of a collection's name, allowed); the last that fits decides, none allows."""
    return next((ok for prefix, ok in reversed(rules) if collection.startswith(prefix)), True)

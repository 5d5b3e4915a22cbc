"""Exact top-k search by inner product over a bit-sliced index.

A vector's components become whole numbers floor(scale * x). Rows are dealt into blocks; in each,
component d less the block's least value is stored as slices: bitmap j holds bit j of all rows. The
index is a table in the shared folder.

For a query, the score of all rows of a block at once is a sum of bit-sliced numbers: for each
component and each set bit of the query's multiplier, the component's slices (their complements for
a negative multiplier) are added at that bit by a ripple of AND, OR and XOR over bitmaps. Top rows
are then chosen from the most significant slice of the sum downward: rows known to be in, and rows
still equal. Rows equal to the last slice stand at the boundary, and are resolved exactly by id. Each
block gives its k best to one ranking for each query.

Queries meet blocks by an equality join of (block, chunk of queries): every query meets every block,
which the question asks for, and a task holds one block and at most about `CHUNK` queries.

Each component has as many slices as its own range in the block needs, so one large value widens its
own component only. Whole numbers beyond 62 bits are held as Python's, so no finite value is too large.

Defined cases: vectors that are null or hold a null or non-finite component take no part, nor do rows
without an id; vectors of unlike lengths count as filled up with zeros; rows with the same id are all
candidates, and a query leaves out its own row only; equal scores go to the smaller id; a score among a
query's k best that doesn't fit 64 bits is an error that names both rows; an empty table gives an empty
result; columns besides the id and the vector are not read, whatever their names.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import scratch

BLOCK, CHUNK, TOGETHER = 8192, 4096, 64
INDEX = "block int, n int, bits array<int>, row binary, vec_id binary, low array<string>, slices binary"
FOUND = "q_row long, query_id long, row long, vec_id long, score long, wide boolean"
#: Whole numbers up to this size are held in 64 bits, with room for one difference.
SMALL = 1 << 62
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def whole(vectors: list, scale: float) -> np.ndarray:
    """(rows, dims) of floor(scale * x), exactly; short vectors are filled up with zeros. The type is
    int64 where all fit, else object."""
    out = np.zeros((len(vectors), max(map(len, vectors), default=0)))
    for i, x in enumerate(vectors):
        out[i, : len(x)] = x
    with np.errstate(over="ignore"):
        scaled = out * scale
    if not len(vectors) or np.abs(scaled).max(initial=0) < SMALL:
        return np.floor(scaled).astype(np.int64)
    # Doubles this large are whole numbers, and so is the scale, or their product is below the limit.
    exact = np.frompyfunc(lambda x, y: math.floor(y) if abs(y) < SMALL else math.floor(Fraction(x) * Fraction(scale)), 2, 1)
    return exact(out, scaled)


def build(values: np.ndarray) -> tuple[np.ndarray, list[int], np.ndarray]:
    """values: (rows, dims). Gives each component's least value, its number of bits, and the slices
    of all components, one after the other, as (all bits, words) of u64."""
    n, dims = values.shape
    low = values.min(axis=0) if n else np.zeros(dims, dtype=np.int64)
    high = values.max(axis=0) if n else low
    if max((int(h) - int(x) for h, x in zip(high, low)), default=0) >= SMALL:
        values, low = values.astype(object), low.astype(object)
    rest = values - low
    bits = [max(1, (int(h) - int(x)).bit_length()) for h, x in zip(high, low)]
    words = -(-n // 64)
    slices = np.zeros((sum(bits), words), dtype=np.uint64)
    at = 0
    for d in range(dims):
        on = np.zeros((bits[d], words * 64), dtype=np.uint8)
        for j in range(bits[d]):
            on[j, :n] = ((rest[:, d] >> j) & 1).astype(np.uint8)
        slices[at : at + bits[d]] = np.packbits(on, axis=1, bitorder="little").view("<u8")
        at += bits[d]
    return low, bits, slices


def sums(bits: list[int], slices: np.ndarray, queries: np.ndarray) -> list[np.ndarray]:
    """Slices of sum(|q| * v) for each query, v being a component or, where q < 0, its complement."""
    words = slices.shape[1]
    size = np.abs(queries)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    flip = np.where(queries < 0, full, np.uint64(0))
    total: list[np.ndarray] = []
    first = 0
    for d, wide in enumerate(bits):
        value = slices[first : first + wide][:, None, :] ^ flip[:, d][None, :, None]  # bits, queries, words
        first += wide
        for b in range(int(size[:, d].max(initial=0)).bit_length()):
            on = np.where((size[:, d] >> b) & 1 == 1, full, np.uint64(0))[:, None]
            if not on.any():
                continue
            while len(total) < b + wide:
                total.append(np.zeros((len(queries), words), dtype=np.uint64))
            carry = None
            for j in range(wide):
                x, y = total[b + j], value[j] & on
                half = x ^ y
                if carry is None:
                    total[b + j], carry = half, x & y
                else:
                    total[b + j], carry = half ^ carry, (x & y) | (half & carry)
            at = b + wide
            while carry.any():
                if at == len(total):
                    total.append(carry)
                    break
                total[at], carry = total[at] ^ carry, total[at] & carry
                at += 1
    return total


def choose(total: list[np.ndarray], among: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps, for each query, of the rows surely among the k highest, and of those at the boundary."""
    inside, equal = np.zeros_like(among), among.copy()
    for s in reversed(total):
        tried = inside | (equal & s)
        many = (np.bitwise_count(tried).sum(axis=1) > k)[:, None]
        inside = np.where(many, inside, tried)
        equal = np.where(many, equal & s, equal & ~s)
    return inside, equal


def _rows_of(bitmap: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[:n])


def search(rows, ids, low, bits, slices, q_rows, queries: np.ndarray, k: int):
    """(query's place, row, id, score) of each query's k best rows of a block. Scores have any size."""
    n, dims = len(rows), len(bits)
    if queries.shape[1] < dims:  # a shorter query ends in zeros; of a longer one the rest meets zeros
        queries = np.pad(queries, ((0, 0), (0, dims - queries.shape[1])))
    queries = queries[:, :dims]
    exact = queries.astype(object)
    limits = np.array([(1 << w) - 1 for w in bits], dtype=object)
    shift = exact @ np.array(low, dtype=object) - np.where(queries < 0, -exact, 0) @ limits if dims else np.zeros(len(queries), dtype=object)
    place = {r: i for i, r in enumerate(rows.tolist())}
    there = np.zeros(slices.shape[1] * 64, dtype=np.uint8)
    there[:n] = 1
    among = np.repeat(np.packbits(there, bitorder="little").view("<u8")[None], len(queries), axis=0)
    for i, r in enumerate(q_rows.tolist()):
        if r in place:
            word, bit = divmod(place[r], 64)
            among[i, word] &= ~np.uint64(1 << bit)
    total = sums(bits, slices, queries)
    inside, equal = choose(total, among, k)
    for i in range(len(queries)):
        sure, tied = _rows_of(inside[i], n), _rows_of(equal[i], n)
        tied = tied[np.lexsort((rows[tied], ids[tied]))][: k - len(sure)]
        for r in np.concatenate([sure, tied]).tolist():
            word, bit = divmod(r, 64)
            score = sum(((int(s[i, word]) >> bit) & 1) << j for j, s in enumerate(total))
            yield i, int(rows[r]), int(ids[r]), score + int(shift[i])


def _build(scale: float):
    def run(table: pa.Table) -> pa.Table:
        rows, ids = (table.column(c).to_numpy() for c in ("row", "vec_id"))
        low, bits, slices = build(whole(table.column("value").to_pylist(), scale))
        if not bits:  # no vector has a component
            slices = np.zeros((0, -(-len(rows) // 64)), dtype=np.uint64)
        values = [table.column("block")[0].as_py(), len(rows), bits, rows.astype("<i8").tobytes(), ids.astype("<i8").tobytes(), [str(x) for x in low.tolist()], slices.astype("<u8").tobytes()]
        kinds = [pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.binary()]
        return pa.table([pa.array([v], t) for v, t in zip(values, kinds)], names=[c.split()[0] for c in INDEX.split(", ")])

    return run


def _search(k: int, scale: float):
    def run(index: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for x in index.to_pylist():
            rows, ids = (np.frombuffer(x[c], dtype="<i8") for c in ("row", "vec_id"))
            low, words = [int(v) for v in x["low"]], -(-x["n"] // 64)
            slices = np.frombuffer(x["slices"], dtype="<u8").reshape(sum(x["bits"]), words)
            for at in range(0, asked.num_rows, TOGETHER):
                some = asked.slice(at, TOGETHER)
                q_rows, q_ids = some.column("row").to_numpy(), some.column("vec_id").to_numpy()
                for i, row, vec, score in search(rows, ids, low, x["bits"], slices, q_rows, whole(some.column("value").to_pylist(), scale), k):
                    out.append((int(q_rows[i]), int(q_ids[i]), row, vec, max(LEAST, min(MOST, score)), not LEAST <= score <= MOST))
        columns = list(zip(*out)) if out else [[]] * 6
        names = [c.split()[0] for c in FOUND.split(", ")]
        return pa.table([pa.array(c, pa.bool_() if n == "wide" else pa.int64()) for n, c in zip(names, columns)], names=names)

    return run


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: float = 256.0) -> DataFrame:
    """vectors: vec_id, embedding; is_query: a condition on vec_id. Gives query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    scratch.workers_import(spark)
    sound = F.forall("value", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = scratch.only(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("value"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False)))
    rows = scratch.table(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, asked = rows.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    blocks, chunks = max(1, math.ceil(n / BLOCK)), max(1, math.ceil(asked / CHUNK))

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    index = scratch.table(dealt.groupBy("block").applyInArrow(_build(scale), INDEX), "slices")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    queries = rows.filter(is_query).withColumn("chunk", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(chunks)).cast("int"))
    left = index.withColumn("chunk", every(chunks)).groupBy("block", "chunk")
    right = queries.withColumn("block", every(blocks)).groupBy("block", "chunk")
    found = left.cogroup(right).applyInArrow(_search(k, scale), FOUND)
    best = W.partitionBy("q_row").orderBy(F.col("score").desc(), "vec_id", "row")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    # A score beyond 64 bits was put at the end of their range, so it can't have pushed out a better one.
    refused = F.raise_error(F.concat(F.lit("the score of query "), "query_id", F.lit(" and vector "), "vec_id", F.lit(" doesn't fit 64 bits"))).cast("long")
    return ranked.select("query_id", "rank", "vec_id", F.when(F.col("wide"), refused).otherwise(F.col("score")).alias("score"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS "rank" FROM s
)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 5
"""

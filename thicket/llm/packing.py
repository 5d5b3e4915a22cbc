"""Packing of documents into fixed-length token sequences: concatenate and cut.

All documents' ids, each closed by an end id, stand one after another in one conceptual stream that
is cut every `length` ids. The offset of a document in that stream comes from prefix sums in two
passes: a first pass encodes each partition, stores ids with their offset in the partition, and
gives one total a partition; the totals' running sums, held by the driver, are the partitions'
offsets. A second pass cuts each document at the window edges. Nothing is shuffled.

Only the last sequence can be short, so there is next to no padding. A piece that its window's edge
cuts off is a boundary record (`continues`): the document goes on in the next sequence at offset 0.

Defined cases: a null or empty text is the end id alone; an empty table gives no rows; repeated
rows and null doc_ids are documents like any other; columns besides the id and text are not read.
The order of the stream is that of the input's partitions and rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .tokens import CACHE, encoder

STORED = "part int, at long, doc_id long, n int, ids binary"
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, continues boolean"
)


def _encode(path: str, end: int, cache: int):
    close = np.array([end], dtype="<u2").tobytes()

    def run(batches):
        from pyspark import TaskContext

        encode, part, at = encoder(path, cache).encode, TaskContext.get().partitionId(), 0
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                some = batch.slice(low, 1000)
                ids = [encode(t or "") + close for t in some.column(1).to_pylist()]
                n = np.array([len(x) // 2 for x in ids], dtype=np.int64)
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part, dtype=np.int32)), pa.array(starts), some.column(0), pa.array(n.astype(np.int32)), pa.array(ids, pa.binary())],
                    names=["part", "at", "doc_id", "n", "ids"],
                )
        scratch.trim()

    return run


def _cut(length: int, with_ids: bool):
    def run(batches):
        for batch in (x.slice(low, 1000) for x in batches for low in range(0, x.num_rows, 1000)):
            rows: list[tuple] = []
            ids_of: list[bytes] = []
            docs, starts, raws = (batch.column(i).to_pylist() for i in range(3))
            for doc, at, raw in zip(docs, starts, raws):
                ids = np.frombuffer(raw, dtype="<u2").astype("<u4")
                view, n, start = memoryview(ids).cast("B"), len(ids), 0
                while start < n:
                    sequence, offset = divmod(at + start, length)
                    size = min(n - start, length - offset)
                    piece = view[4 * start : 4 * (start + size)]
                    rows.append((doc, start, size, zlib.crc32(piece), n, sequence, offset, start + size < n))
                    if with_ids:
                        ids_of.append(bytes(piece))
                    start += size
            columns = [pa.array(c, pa.bool_() if i == 7 else pa.int64()) for i, c in enumerate(zip(*rows))] if rows else [pa.array([], pa.bool_() if i == 7 else pa.int64()) for i in range(8)]
            names = [x.split()[0] for x in PIECES.split(", ")]
            if with_ids:
                columns, names = [*columns, pa.array(ids_of, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        scratch.trim()

    return run


def pack(docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 0, with_ids: bool = True, cache: int = CACHE) -> DataFrame:
    """One row a piece; with `with_ids` also the piece's ids as little-endian unsigned 32-bit values. `cache` bounds the
    pre-tokens of each of the two generations that a worker keeps."""
    spark = docs.sparkSession
    scratch.workers_import(spark)
    stored = scratch.table(scratch.only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(_encode(tokenizer, end_id, cache), STORED), "packing")
    # One total for each task of the first pass; Spark's driver holds more than that for each task.
    totals = sorted(stored.groupBy("part").agg(F.sum("n").alias("n")).collect())
    offsets, at = [], 0
    for part, n in totals:
        offsets.append((part, at))
        at += n
    offset_of = F.broadcast(spark.createDataFrame(offsets, "part int, base long"))
    placed = stored.join(offset_of, "part").select("doc_id", (F.col("base") + F.col("at")).alias("at"), "ids")
    return placed.mapInArrow(_cut(length, with_ids), PIECES + ", ids binary" * with_ids)

"""Token ids in binary shards of patched frame-of-reference blocks.

Documents are range-partitioned and sorted by id, encoded, and written as shards. A shard holds up
to about `SHARD` ids of whole documents and stands alone; its layout, all little-endian:

    "PFR2", then u32: documents, ids, blocks
    i64 each document's id; u8 each: 1 if that id is null
    u32 each document's number of ids
    u64 each block's start, from the first byte after this index
    blocks of 4096 ids (the last is filled up with its minimum):
        u32 minimum, u8 width, u16 number of exceptions
        width * 64 words of u64: id k of lane l (id 64 * k + l of the block) less the minimum has
        its low bits at bit k * width of the lane's words; an exception has zeros there
        u16 each exception's place, u32 each exception's id less the minimum

The width is the least in which a share `FITS` of the block's ids fits, so that a few large ids
don't widen all others. `document` reads one document by seeking: the index, and the blocks that
hold its ids.

Each shard is a file `p<task>-<ids before it in the task>.pfr` in the folder's `shards`, which the executors
write themselves where the folder is one that all machines mount (no scheme, or file:). A file gets its name when
it is whole, and a retry writes the same bytes under the same name, so lost executors leave nothing half done.
Where only Spark's writers reach the folder (any other scheme), the same bytes are kept in the manifest's
column `payload`. The manifest, a Parquet table, has one row a shard, and reading checks the files against it.

Defined cases: a null or empty text is the end id alone; an empty table gives no shards; rows with
the same doc_id stand in the order of their texts; null ids come first; texts of any length are read
whole; other columns are not read, whatever their names.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .tokens import encoder

BLOCK, LANES, SHARD, FITS = 4096, 64, 1 << 20, 0.9
#: Pre-tokens of one generation of the cache; two generations are held, so that bounds a worker's memory.
CACHE = 600_000
MAGIC = b"PFR2"
SHARDS = "part int, at long, n_docs int, n_ids int, name string, payload binary"
READ = "part int, doc_id long, at long, n_tokens long, ids_crc32 long"


def _lane_words(values: np.ndarray, width: int) -> np.ndarray:
    """values: (blocks, 64 rows, 64 lanes) of u64 below 2**width. Gives (blocks, width, lanes)."""
    words = np.zeros((len(values), width, LANES), dtype=np.uint64)
    for k in range(BLOCK // LANES):
        word, shift = divmod(k * width, 64)
        words[:, word] |= values[:, k] << np.uint64(shift)
        if shift + width > 64:
            words[:, word + 1] |= values[:, k] >> np.uint64(64 - shift)
    return words


def _lane_values(words: np.ndarray, width: int) -> np.ndarray:
    values = np.empty((len(words), BLOCK // LANES, LANES), dtype=np.uint64)
    mask = np.uint64((1 << width) - 1)
    for k in range(BLOCK // LANES):
        word, shift = divmod(k * width, 64)
        got = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            got = got | (words[:, word + 1] << np.uint64(64 - shift))
        values[:, k] = got & mask
    return values


def pack_blocks(ids: np.ndarray) -> list[bytes]:
    """ids: u32, any number of them."""
    if not len(ids):
        return []
    n = -(-len(ids) // BLOCK)
    last = ids[(n - 1) * BLOCK :]
    full = np.concatenate([ids, np.full(n * BLOCK - len(ids), last.min(), dtype=ids.dtype)]).reshape(n, BLOCK)
    low = full.min(axis=1)
    rest = full - low[:, None]
    kth = min(BLOCK - 1, int(np.ceil(BLOCK * FITS)) - 1)
    width = np.maximum(1, np.ceil(np.log2(np.partition(rest, kth, axis=1)[:, kth].astype(np.float64) + 1))).astype(int)
    out: list[bytes] = [b""] * n
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        some = rest[at]
        odd = some >> np.uint32(w) != 0 if w < 32 else np.zeros(some.shape, dtype=bool)
        words = _lane_words(np.where(odd, 0, some).astype(np.uint64).reshape(len(at), BLOCK // LANES, LANES), w)
        for i, block in enumerate(at.tolist()):
            places = np.flatnonzero(odd[i])
            head = struct.pack("<IBH", int(low[block]), w, len(places))
            out[block] = head + words[i].astype("<u8").tobytes() + places.astype("<u2").tobytes() + some[i][places].astype("<u4").tobytes()
    return out


def unpack_blocks(raw: memoryview, starts: np.ndarray, n_ids: int) -> np.ndarray:
    out = np.empty((len(starts), BLOCK), dtype=np.uint32)
    heads = [struct.unpack_from("<IBH", raw, s) for s in starts.tolist()]
    by_width: dict[int, list[int]] = {}
    for i, (_, w, _) in enumerate(heads):
        by_width.setdefault(w, []).append(i)
    for w, some in by_width.items():
        words = np.stack([np.frombuffer(raw, "<u8", w * LANES, int(starts[i]) + 7).reshape(w, LANES) for i in some])
        out[some] = _lane_values(words, w).reshape(len(some), BLOCK)
    for i, (low, w, odd) in enumerate(heads):
        if odd:
            at = int(starts[i]) + 7 + 8 * w * LANES
            out[i][np.frombuffer(raw, "<u2", odd, at)] = np.frombuffer(raw, "<u4", odd, at + 2 * odd)
        out[i] += np.uint32(low)
    return out.reshape(-1)[:n_ids]


def shard_bytes(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    blocks = pack_blocks(ids)
    sizes = np.array([len(b) for b in blocks], dtype=np.uint64)
    starts = np.cumsum(sizes, dtype=np.uint64) - sizes
    return b"".join(
        [
            MAGIC,
            struct.pack("<III", len(doc_ids), len(ids), len(blocks)),
            np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(),
            bytes(d is None for d in doc_ids),
            np.array(counts, dtype="<u4").tobytes(),
            starts.astype("<u8").tobytes(),
            *blocks,
        ]
    )


def read_shard(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """The document ids, each document's number of ids, and all ids."""
    raw = memoryview(payload)
    if raw[:4] != MAGIC:
        raise ValueError("not a shard of this format")
    docs, n_ids, blocks = struct.unpack_from("<III", raw, 4)
    at = 16
    doc_ids = np.frombuffer(raw, "<i8", docs, at).tolist()
    absent = raw[at + 8 * docs : at + 9 * docs]
    at += 9 * docs
    counts = np.frombuffer(raw, "<u4", docs, at).astype(np.int64)
    at += 4 * docs
    starts = np.frombuffer(raw, "<u8", blocks, at) if blocks else np.zeros(0, dtype=np.uint64)
    at += 8 * blocks
    return [None if gone else d for d, gone in zip(doc_ids, absent)], counts, unpack_blocks(raw[at:], starts, n_ids)


def document(f, number: int) -> np.ndarray:
    """The ids of a shard's document, by its place in the shard; f: a file open for reading that can seek."""
    f.seek(0)
    head = f.read(16)
    if head[:4] != MAGIC:
        raise ValueError("not a shard of this format")
    docs, n_ids, blocks = struct.unpack_from("<III", head, 4)
    if not 0 <= number < docs:
        raise IndexError(f"the shard has {docs} documents")
    f.seek(16 + 9 * docs)
    counts = np.frombuffer(f.read(4 * (number + 1)), "<u4").astype(np.int64)
    start, n = int(counts[:-1].sum()), int(counts[-1])
    if not n:
        return np.zeros(0, dtype=np.uint32)
    first, last = start // BLOCK, (start + n - 1) // BLOCK
    index = 16 + 13 * docs
    f.seek(index + 8 * first)
    more = last + 1 < blocks
    starts = np.frombuffer(f.read(8 * (last - first + 1 + more)), "<u8").astype(np.int64)
    f.seek(index + 8 * blocks + int(starts[0]))
    raw = f.read(int(starts[-1] - starts[0])) if more else f.read()
    held = starts[: last - first + 1] - starts[0]
    ids = unpack_blocks(memoryview(raw), held, len(held) * BLOCK)
    return ids[start - first * BLOCK : start - first * BLOCK + n]


def mounted(path: str) -> str | None:
    """The folder as all machines see it in their file systems, or None where only Spark reaches it."""
    at = urlparse(path)
    return unquote(at.path) if at.scheme in ("", "file") else None


def _put(folder: str, name: str, payload: bytes) -> None:
    os.makedirs(folder, exist_ok=True)
    unfinished = os.path.join(folder, f".{name}-{uuid.uuid4().hex}")
    with open(unfinished, "wb") as f:
        f.write(payload)
    os.replace(unfinished, os.path.join(folder, name))


def _write(path: str, end: int, folder: str | None):
    close = np.array([end], dtype="<u2").tobytes()

    def run(batches):
        from pyspark import TaskContext

        encode, part, at = encoder(path, CACHE).encode, TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        parts: list[bytes] = []
        held = 0

        def shard():
            ids = np.frombuffer(b"".join(parts), dtype="<u2").astype(np.uint32)
            payload, name = shard_bytes(docs, [len(p) // 2 for p in parts], ids), f"p{part:06d}-{at:015d}.pfr"
            if folder is not None:
                _put(folder, name, payload)
            row = [[part], [at], [len(docs)], [len(ids)], [name], [payload if folder is None else None]]
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=[c.split()[0] for c in SHARDS.split(", ")])

        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                some = batch.slice(low, 1000)
                for doc, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    docs.append(doc)
                    parts.append(encode(text or "") + close)
                    held += len(parts[-1]) // 2
                    if held >= SHARD:
                        yield shard()
                        at, held = at + held, 0
                        docs.clear()
                        parts.clear()
        if docs:
            yield shard()

    return run


def _read(batches):
    for batch in batches:
        for part, at, payload in zip(*(batch.column(i).to_pylist() for i in range(3))):
            docs, counts, ids = read_shard(payload)
            ends = np.cumsum(counts)
            view = memoryview(ids.astype("<u4")).cast("B")
            crc = [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(docs), part, dtype=np.int32)), pa.array(docs, pa.int64()), pa.array(at + ends - counts), pa.array(counts), pa.array(crc, pa.int64())],
                names=[c.split()[0] for c in READ.split(", ")],
            )


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1) -> None:
    """Writes the documents' shards, in ascending doc_id order, and their manifest to a shared folder."""
    scratch.workers_import(docs.sparkSession)
    rows = scratch.only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Many equal rows must not meet in one task: their order doesn't matter, so the last key may part them.
    keyed = rows.withColumns({"_hash": F.xxhash64("text"), "_n": F.monotonically_increasing_id()})
    ordered = keyed.repartitionByRange("doc_id", "_hash", "_n").sortWithinPartitions("doc_id", "_hash", "text").select("doc_id", "text")
    at, folder = path.rstrip("/"), mounted(path)
    made = ordered.mapInArrow(_write(tokenizer, end_id, None if folder is None else os.path.join(folder, "shards")), SHARDS)
    made.write.parquet(f"{at}/manifest")


def manifest(spark, path: str) -> DataFrame:
    return spark.read.schema(SHARDS).parquet(f"{path.rstrip('/')}/manifest")


def shards(spark, path: str) -> DataFrame:
    """part, at and payload of each shard, from the files."""
    listed = manifest(spark, path)
    if mounted(path) is None:
        return listed.select("part", "at", "payload")
    n = listed.count()
    if not n:
        return listed.select("part", "at", "payload")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "p*.pfr").load(f"{path.rstrip('/')}/shards")
    if files.select("path").count() != n:
        raise ValueError(f"{path} has other files than its manifest")
    name = F.regexp_extract("path", r"p(\d+)-(\d+)\.pfr$", 1), F.regexp_extract("path", r"p(\d+)-(\d+)\.pfr$", 2)
    return files.select(name[0].cast("int").alias("part"), name[1].cast("long").alias("at"), F.col("content").alias("payload"))


def read(spark, path: str) -> DataFrame:
    """Per document, from the shards: doc_id, start, n_tokens and ids_crc32 of all its ids."""
    scratch.workers_import(spark)
    # One total for each task that wrote; the shards know their place within their task.
    totals = sorted(manifest(spark, path).groupBy("part").agg(F.sum(F.col("n_ids").cast("long")).alias("n")).collect())
    bases, at = [], 0
    for part, n in totals:
        bases.append((part, at))
        at += n
    base = F.broadcast(spark.createDataFrame(bases, "part int, base long"))
    found = shards(spark, path).mapInArrow(_read, READ).join(base, "part")
    return found.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")

"""Near-duplicate classes of documents by ProbMinHash, banding and exact verification.

1. Texts that are equal byte for byte share a digest; each distinct text is one node.
2. Each node gets a ProbMinHash signature of its set of word shingles, cut into bands; nodes with an
   equal band share a bucket. All shingles weigh 1, so registers agree with the probability of the
   Jaccard similarity of the sets, which is what step 3 verifies, however often passages repeat. At a
   similarity of 0.8, 28 bands of 6 registers miss a pair with a probability of about 0.0002.
3. Buckets that hold the same nodes count once. First, each bucket's nodes are compared with its least
   node alone, which costs one comparison a node, and the links found are joined to components: in a
   family of copies that settles nearly all. Only buckets that still hold several components are
   compared whole, in blocks: the shingles that two or more of a block's nodes have become columns, and
   a product of the membership matrix with its transpose gives all intersections. Either way the
   Jaccard similarity of the shingle sets is counted out, by 40 bits of each shingle's hash. What leaves
   a task is a spanning forest of the links found, at most one edge a node: no link between different
   texts is lost for the classes, and pairs aren't written out. Nodes of a large bucket are dealt into
   blocks of about `BLOCK`, and a task holds one with the least node, or two.
4. Classes are the connected components of those links; equal texts follow their node.

The texts of the nodes in buckets are read in a second scan. Bitmaps built from the buckets' bands and
those nodes' keys drop nearly all other rows before they are shuffled; they have 16 bits a wanted row, from
2**26 bits up to 2**30 (128 MB), which are sent to all executors. Past some 10**8 wanted rows more rows
than wanted pass, and are shuffled. Joins on a text's digest or a class meet hot keys (copies of one text)
and rely on Spark's splitting of skewed partitions; texts without words have no key and are kept out.

`deduplicate` writes no copy of the rows. What it drops is named by doc_id and the text's digest: a bitmap of those
names lets most rows that stay through where they lie, and only the others are joined with the names themselves. Of
rows that share the name that stays, one is chosen by an aggregation of those rows alone.

Defined cases: a null text and one without words is alone in its class, and `deduplicate` keeps all of
those; a class's id is its least doc_id, null if all are null; rows with one doc_id and different texts
are classed by their texts, each on its own; of a class `deduplicate` keeps one row, always: that of the
least doc_id (rows without one come last), the first of them if there are several; texts of any length are
read whole; an empty table gives an empty result; other columns are kept by `deduplicate`, whatever their
names, and not read by `classes`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .components import components, meet
from .shingles import SIZE, mix, shingles, signature

SIMILARITY, BANDS, ROWS = 0.8, 28, 6
BLOCK = 256
#: Bits of a bitmap at least and at most, and bits of one of its pages.
LEAST_BITS, MOST_BITS, PAGE = 1 << 26, 1 << 30, 1 << 15


def _key(text: Column) -> Column:
    """A text's digest; null for a text that has no words."""
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.unhex(F.md5(text.cast("binary"))))


def _sign(size: int, bands: int, rows: int):
    """row, raw, key, doc_id -> row, key, bands, doc_id."""

    def run(batches):
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        odd = mix(np.arange(1000, 1000 + rows, dtype=np.uint64)) | np.uint64(1)
        for batch in batches:
            signed = []
            for text, key in zip(batch.column(1), batch.column(2)):
                if not key.is_valid:
                    signed.append(None)
                    continue
                hashes = shingles(text.as_py(), size)[0]
                won = mix(signature(hashes, np.ones(len(hashes)), bands * rows)).reshape(bands, rows)
                signed.append(mix((won * odd).sum(axis=1, dtype=np.uint64) ^ salt).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(signed, pa.list_(pa.int64())), batch.column(3)], names=["row", "key", "bands", "doc_id"]
            )
        scratch.trim()

    return run


def _stored(hashes: np.ndarray) -> bytes:
    """The distinct low 40 bits of each: two shingles of a pair of texts clash once in 10**12."""
    short = np.unique(hashes & np.uint64((1 << 40) - 1)).astype("<u8")
    return short.view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _restored(raw) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 5)
    return out.reshape(-1).view("<u8")


def _shingled(size: int):
    def run(batches):
        for batch in batches:
            sets = [_stored(shingles(x.as_py(), size)[0]) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])
        scratch.trim()

    return run


def links(sets: list[np.ndarray], least: float) -> np.ndarray:
    """All pairs (i < j) of a block's sets whose Jaccard similarity is `least` or more."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    if n == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[0, 1]] if both >= least * (sizes.sum() - both) else []).reshape(-1, 2)
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    values, column, count = np.unique(every, return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    owner, column = owner[shared[column]], place[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((n, n), dtype=np.float32)
    columns = int(shared.sum())
    for low in range(0, columns, 8192):  # bounds the matrix
        a, b = np.searchsorted(column, [low, low + 8192])
        part = np.zeros((n, min(8192, columns - low)), dtype=np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        both += part @ part.T
    union = sizes[:, None] + sizes[None, :] - both
    return np.argwhere(np.triu(both >= least * union, 1))


def forest(pairs: np.ndarray) -> list[tuple[int, int]]:
    """Pairs enough to connect what all of them connect."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in pairs.tolist():
        x, y = root(a), root(b)
        if x != y:
            parent[x] = y
            out.append((a, b))
    return out


def _link(least: float):
    """Rows come sorted by (band, i, j); each run of them is a block."""

    def run(batches):
        held_key, nodes, sets = None, [], []
        out: list[tuple[int, int]] = []

        def close():
            if len(nodes) > 1:
                out.extend((nodes[a], nodes[b]) for a, b in forest(links(sets, least)))
            nodes.clear()
            sets.clear()

        def found():
            a, b = zip(*out) if out else ((), ())
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            band, i, j, node, raw = (batch.column(k) for k in range(5))
            for key, x, r in zip(zip(band.to_pylist(), i.to_pylist(), j.to_pylist()), node.to_pylist(), raw):
                if key != held_key:
                    close()
                    held_key = key
                nodes.append(x)
                sets.append(_restored(r.as_py()))
            yield found()
        close()
        yield found()
        scratch.trim()

    return run


def _verify(least: float):
    """Rows come sorted by (rep, blocks, slot), the rep itself first: links of the others with it."""

    def run(batches):
        key, rep, held = None, None, None
        for batch in batches:
            out: list[tuple[int, int]] = []
            reps, blocks, slots, nodes = (batch.column(k).to_pylist() for k in range(4))
            for r, b, slot, node, raw in zip(reps, blocks, slots, nodes, batch.column(4)):
                own = _restored(raw.as_py())
                if (r, b, slot) != key:
                    key, rep, held = (r, b, slot), r, own
                    if node != r:
                        raise ValueError("a block without its least node")
                    continue
                small, large = (own, held) if len(own) < len(held) else (held, own)
                if len(small) < least * len(large):
                    continue
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                if both >= least * (len(own) + len(held) - both):
                    out.append((rep, node))
            a, b = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        scratch.trim()

    return run


def _on(bits: Column, place: Column) -> Column:
    """Whether a page's bit is set."""
    byte = F.conv(F.hex(F.substring(bits, (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.expr("1").cast("int").bitwiseAND(F.call_function("shiftright", byte, (place % 8).cast("int"))) == 1


def _pages(spots: DataFrame) -> DataFrame:
    """spots: a column s. Pages of a bitmap: (_page, _bits)."""
    at = spots.select(F.floor(F.col("s") / PAGE).cast("long").alias("_page"), F.pmod("s", F.lit(PAGE)).alias("p"))
    return F.broadcast(at.groupBy("_page").agg(F.expr("bitmap_construct_agg(p)").alias("_bits")))


def _paged(rows: DataFrame, hashed: Column, wanted: DataFrame, wanted_hash: Column, how: str) -> DataFrame:
    """Rows beside their page of a bitmap of wanted rows' hashes."""
    bits = max(LEAST_BITS, min(MOST_BITS, 1 << (16 * wanted.count()).bit_length()))
    spot = lambda h: F.pmod(h, F.lit(bits).cast("long"))
    at = rows.withColumn("_spot", spot(hashed)).withColumn("_page", F.floor(F.col("_spot") / PAGE).cast("long"))
    return at.join(_pages(wanted.select(spot(wanted_hash).alias("s"))), "_page", how)


def _among(rows: DataFrame, hashed: Column, wanted: DataFrame, wanted_hash: Column) -> DataFrame:
    """Rows whose hash is that of a wanted row, and few others."""
    found = _paged(rows, hashed, wanted, wanted_hash, "inner").filter(_on(F.col("_bits"), F.col("_spot") % PAGE))
    return found.drop("_page", "_bits", "_spot")


def _classed(texts: DataFrame, least: float, size: int, bands: int, rows: int) -> tuple[DataFrame, list[DataFrame]]:
    """texts: row, doc_id, raw, key. Gives row, doc_id, key and, for texts with words, class_id and stays (the
    row that stands for the class); and the tables that can be discarded once that is written."""
    signed = texts.select("row", "raw", "key", "doc_id").mapInArrow(_sign(size, bands, rows), "row long, key binary, bands array<long>, doc_id long")
    signed = scratch.table(signed, "signatures")
    worded = signed.filter("key IS NOT NULL")

    # One node for each distinct text. max_by would hold an array; the least row stands for all.
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    distinct = worded.groupBy("key").agg(F.min("row").alias("node"), F.min(first).alias("first"))
    distinct = scratch.table(distinct, "texts")
    banded = worded.select("row", "bands").join(distinct.select("node"), F.col("row") == F.col("node"), "left_semi")
    banded = scratch.table(banded.select(F.col("row").alias("node"), F.explode("bands").alias("band")), "bands")

    buckets = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum(F.shiftright(F.xxhash64("node"), 12)).alias("s"), F.min("node").alias("rep"))
    buckets = buckets.filter("n > 1").groupBy("n", "s", "rep").agg(F.min("band").alias("band"))
    buckets = scratch.table(buckets.select("band", "rep", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "buckets")
    shared = _among(banded, F.xxhash64("band"), buckets, F.xxhash64("band"))  # most bands have one node
    members = scratch.table(shared.join(buckets, "band"), "members")
    scratch.discard(banded)

    # The shingles of those nodes: a second scan, cut down by the bitmap before it is shuffled.
    nodes = members.select("node").distinct().join(signed.select("row", "doc_id", "key"), F.col("node") == F.col("row"))
    nodes = scratch.table(nodes.select("node", "doc_id", "key"), "nodes")
    known = F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "key")
    near = _among(texts.select("doc_id", "raw", "key").filter("key IS NOT NULL"), known, nodes, known)
    asked = nodes.select("node", F.col("doc_id").alias("_id"), F.col("key").alias("_key"))
    found = near.join(asked, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))).select("node", "raw")
    sets = scratch.table(found.mapInArrow(_shingled(size), "node long, shingles binary").dropDuplicates(["node"]), "shingles")

    # Each node against the least of its buckets, in slots of a large bucket.
    slot = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pairs = members.filter("node <> rep").groupBy("rep", "node").agg(F.max("blocks").alias("blocks")).select("rep", "blocks", slot.alias("slot"), "node")
    reps = members.select("rep", "blocks").distinct()
    reps = reps.select("rep", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("slot"), F.col("rep").alias("node"))
    met = pairs.unionByName(reps).join(sets, "node").select("rep", "blocks", "slot", "node", "shingles")
    met = met.repartition("rep", "blocks", "slot").sortWithinPartitions("rep", "blocks", "slot", F.col("node") != F.col("rep"))
    edges = scratch.table(met.mapInArrow(_verify(least), "a long, b long"), "links")
    roots = scratch.table(components(edges), "roots")

    # Buckets whose nodes are not all of one component yet are compared whole.
    root = F.coalesce("root", "node")
    of = members.join(roots, "node", "left").select("band", "node", "blocks", root.alias("root"))
    apart = of.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("band")
    apart = scratch.table(apart, "apart")
    if not apart.isEmpty():
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        dealt = members.join(apart, "band", "left_semi").withColumn("own", slot).withColumn("other", other)
        dealt = dealt.select("band", "node", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        met = dealt.join(sets, "node").select("band", "i", "j", "node", "shingles")
        met = met.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "node")
        more = scratch.table(met.mapInArrow(_link(least), "a long, b long"), "links")
        # A component found already is a star of its root's edges.
        roots = scratch.table(components(more.union(roots.select("root", "node"))), "roots")
    scratch.discard(sets)
    scratch.discard(members)

    linked = roots.join(distinct.select("node", "first"), "node")
    named = linked.groupBy("root").agg(F.min("first").alias("of"))
    linked = meet(linked.select("node", "root"), named, "root", "node").select("node", "of")
    of = F.coalesce("of", "first")
    class_of = distinct.join(linked, "node", "left").select("key", of["doc_id"].alias("class_id"), of["row"].alias("stays"))
    class_of = scratch.table(class_of, "classes")
    plain = signed.filter("key IS NULL").select("row", "doc_id", "key", F.lit(None).cast("long").alias("class_id"), F.lit(None).cast("long").alias("stays"))
    found = worded.select("row", "doc_id", "key").join(class_of, "key").select("row", "doc_id", "key", "class_id", "stays")
    return found.unionByName(plain), [signed, distinct, nodes, class_of]


def _texts(rows: DataFrame, row: Column) -> DataFrame:
    return rows.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"), _key(F.col("text")).alias("key"))


def classes(docs: DataFrame, least: float = SIMILARITY, size: int = SIZE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, key (the text's digest) and class_id, one row a document."""
    scratch.workers_import(docs.sparkSession)
    # Only the first scan's row numbers are used: they are written with the signatures.
    texts = _texts(scratch.only(docs, "doc_id", "text"), F.monotonically_increasing_id())
    found, _ = _classed(texts, least, size, bands, rows)
    return found.select("doc_id", "key", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def deduplicate(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The documents with one row of each class. Texts without words all stay."""
    scratch.workers_import(docs.sparkSession)
    # Only the first scan's row numbers are used, to choose the row of a class.
    texts = _texts(scratch.only(docs, "doc_id", "text"), F.monotonically_increasing_id())
    found, made = _classed(texts, least, SIZE, BANDS, ROWS)
    names = found.filter("key IS NOT NULL").groupBy("doc_id", "key").agg(F.max(F.col("row") == F.col("stays")).alias("stays"), F.count(F.lit(1)).alias("n"))
    marked = scratch.table(names.filter("NOT stays OR n > 1").select("doc_id", "key", "stays"), "marked")
    for table in made:
        scratch.discard(table)

    rows, back = scratch.beside(docs, "doc_id", "text")
    whole = [f"c{i}" for i in range(len(back))]
    rows = rows.select(*whole, F.col("doc_id").cast("long").alias("_id"), _key(F.col("text")).alias("_key"), F.monotonically_increasing_id().alias("_row"))
    known = lambda i, k: F.xxhash64(F.coalesce(i, F.lit(-1)), k)
    paged = _paged(rows, known("_id", "_key"), marked, known("doc_id", "key"), "left")
    hit = F.col("_key").isNotNull() & F.col("_bits").isNotNull() & _on(F.col("_bits"), F.col("_spot") % PAGE)
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("key"))
    # Spark would push an anti join below the bitmap, and shuffle all rows.
    alone = paged.filter(hit).join(marked, same, "left").filter("stays IS NULL")
    out = paged.filter(~hit).select(*whole).unionByName(alone.select(*whole))
    tied = marked.filter("stays")
    if not tied.isEmpty():
        first = paged.filter(hit).join(tied, same).groupBy("_id", "_key").agg(F.min_by(F.struct(*whole), "_row").alias("_of"))
        out = out.unionByName(first.select("_of.*"))
    return out.select(*back)


def sql(documents: str = "documents", least: float = SIMILARITY, size: int = SIZE) -> str:
    """Classes by comparing all pairs that share a shingle, in DuckDB's SQL; for small tables."""
    return (
        f"WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM {documents}), "
        f"s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i : i + least({size}, len(w)) - 1], ' ') AS s FROM d, unnest(range(1, len(w) - least({size}, len(w)) + 2)) AS u(i) WHERE len(w) > 0), "
        "n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), "
        f"e AS MATERIALIZED (SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS shared FROM s p JOIN s q ON p.s = q.s AND p.doc_id <> q.doc_id GROUP BY ALL) x JOIN n ON n.doc_id = a JOIN n m ON m.doc_id = b WHERE shared >= {least} * (n.n + m.n - shared)), "
        "r AS (SELECT a, a AS c FROM e UNION SELECT e.a, r.c FROM r JOIN e ON e.b = r.a) "
        "SELECT doc_id, coalesce(c, doc_id) AS class_id, doc_id = coalesce(c, doc_id) AS kept FROM d LEFT JOIN (SELECT a, min(c) AS c FROM r GROUP BY a) ON a = doc_id"
    )

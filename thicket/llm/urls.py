"""URL filters: host and path rules first, else a character language-model ratio.

A rule is `host/path`: it fits its host and all subdomains if the URL's path starts with its path.
The longest rule that fits decides.

Other URLs are judged by two variable-order Markov models of characters, one of the URLs that rules
accepted and one of those they rejected. Each interpolates the orders 0 to `order` (Witten-Bell: a
context's own counts weigh the more, the fewer kinds of characters followed it; contexts never seen
fall through to shorter ones). A URL's figure is the difference of its two log-likelihoods for each
character; a logistic curve, fitted on a held-out part of the same rows, turns it into the
probability that the URL is to be rejected, and 0.5 is the limit.

Host names are left out of what the models read (`host` is where the rules already decided), so they
learn the form of subdomain names, paths and queries: the last two labels of a host become a mark.

The models learn from every URL that a rule fits, of any length; each distinct URL counts once. Executors count:

1. Distinct URLs under a rule are put in the order of their hash, by their verdict; of each four the first is held
   out for the curve, the others are counted.
2. One row for each different window of each order, named by a 64-bit hash: its counts under both verdicts and how
   often the texts to be judged hold it; its context's totals stand beside it.
3. From order to order, each window meets the chances of the one a character shorter. Windows of the highest order
   get the difference of their two logarithms.
4. The `HEAVY` most frequent of these (8 MB) are sent to all executors, which add them up a text at a time. All
   others, if there are more, are joined by their hash; none of them is hot.
5. The curve's Newton steps are sums over all URLs held out.

So the driver holds `HEAVY` windows, some thousand counts of hash ranges and five sums a step, whatever the table's
size. Sums that executors share are of decimals, so their order changes nothing.

Defined cases: a URL that is null or has no `://` has an empty host and path, so no rule fits; a
null or empty URL is allowed; repeated rows get the same verdict, and rows with a null page_id one as well;
if rules gave no example of a verdict, all other URLs are allowed; an empty table gives an empty result;
columns besides the id and the URL are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .shingles import mix

#: The rules in use, (verdict, host, path).
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
ORDER = 4
#: URLs of any length are learnt from.
LONGEST = math.inf
#: Windows that are sent to all executors; any others are joined. Bits of a hash that name its range.
HEAVY, RANGE = 1 << 19, 12
#: Characters that are cut into windows at once (one text at least).
AT_ONCE = 1 << 18
_PAD, _END = "\x01", "\x03"


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, at, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(at + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def shown(url: str | None) -> str:
    """What the models read: the URL with the last two labels of its host replaced by a mark."""
    if not url:
        return ""
    before, mark, rest = url.partition("://")
    if not mark:
        return url
    cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    labels = rest[:cut].split(".")
    return ".".join([*labels[:-2], "\x02"]) + rest[cut:]


def windows(texts: list[str], order: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each order k, the hash of each character's k predecessors and that of the same with the character;
    and each text's number of characters, its end included. Texts stand one after another."""
    codes = np.frombuffer("".join(_PAD * order + t + _END for t in texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    size = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    first = np.cumsum(size + order) - size  # of the characters that are no padding
    at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
    context = np.full(len(at), 0x5EED, dtype=np.uint64)
    contexts, grams = [], []
    for k in range(order + 1):
        if k:
            context = mix(context * np.uint64(0x9E3779B97F4A7C15) + codes[at - k] + np.uint64(1))
        contexts.append(context)
        grams.append(mix(context ^ mix(codes[at] + np.uint64(0xA5A5A5A5))))
    return contexts, grams, size


def _found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key stands in a sorted table, and whether it does."""
    at = np.minimum(np.searchsorted(table, keys), max(0, len(table) - 1))
    return at, (table[at] == keys) if len(table) else np.zeros(len(keys), dtype=bool)


class Model:
    """Witten-Bell interpolation of the orders 0 to `order` over code points, in memory: what `scores` gets from tables."""

    def __init__(self, texts: list[str], order: int, letters: int):
        self.order, self.letters = order, letters
        contexts, grams, _ = windows(texts, order)
        self.grams, self.counts, self.contexts, self.totals, self.kinds = [], [], [], [], []
        for context, gram in zip(contexts, grams):
            keys, where, counts = np.unique(gram, return_index=True, return_counts=True)
            of, kinds = np.unique(context[where], return_counts=True)
            totals = np.zeros(len(of), dtype=np.int64)
            np.add.at(totals, np.searchsorted(of, context[where]), counts)
            for held, part in zip((self.grams, self.counts, self.contexts, self.totals, self.kinds), (keys, counts, of, totals, kinds)):
                held.append(part)

    def chances(self, contexts: list[np.ndarray], grams: list[np.ndarray]) -> np.ndarray:
        """The probability of each character after its predecessors."""
        p = np.full(len(grams[0]), 1 / self.letters)
        for k in range(self.order + 1):
            at, known = _found(self.contexts[k], contexts[k])
            place, seen = _found(self.grams[k], grams[k])
            if not known.any():
                continue
            n = np.where(seen, self.counts[k][place] if len(self.counts[k]) else 0, 0)
            p = np.where(known, (n + self.kinds[k][at] * p) / (self.totals[k][at] + self.kinds[k][at]), p)
        return p


def _newton(sums: Callable[[float, float], tuple], scale: float) -> tuple[float, float]:
    """Newton's steps on a slightly regularised logistic loss in one variable, divided by `scale`. `sums` gives the
    loss's weighted sums of slopes (by the factor, by the shift) and of curvatures (by both factors, mixed, by shifts)."""
    a, b = 1.0, 0.0
    for _ in range(50):
        ga, gb, aa, ab, bb = sums(a, b)
        step = np.linalg.solve(np.array([[aa + 1e-3, ab], [ab, bb + 1e-3]]), np.array([ga + 1e-3 * a, gb]))
        a, b = float(a - step[0]), float(b - step[1])
        if np.abs(step).max() < 1e-10:
            break
    return a / scale, b


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """The curve of rows in memory."""
    scale = float(np.abs(x).max()) or 1.0
    z = x / scale

    def sums(a, b):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -50, 50)))
        h = weight * p * (1 - p)
        return (weight * (p - y) * z).sum(), (weight * (p - y)).sum(), (h * z * z).sum(), (h * z).sum(), h.sum()

    return _newton(sums, scale)


def _chance(of: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), of))))


def _curve(ratios: DataFrame, numbers: list[int]) -> tuple[float, float]:
    """The same of a table (x, y), with even odds beforehand; `numbers` are its rows of each verdict."""
    scale = ratios.agg(F.max(F.abs("x"))).first()[0] or 1.0

    def sums(a, b):
        z = F.col("x") / scale
        rows = ratios.select("y", z.alias("z"), _chance(a * z + b).alias("p"))
        off, h = F.col("p") - F.col("y"), F.col("p") * (1 - F.col("p"))
        parts = (off * F.col("z"), off, h * F.col("z") * F.col("z"), h * F.col("z"), h)
        found = rows.groupBy("y").agg(*(F.sum(x.cast("decimal(38,20)")).cast("double") for x in parts)).collect()
        return tuple(sum(0.5 / numbers[r[0]] * r[i + 1] for r in sorted(found)) for i in range(len(parts)))

    return _newton(sums, scale)


def _slices(texts: list[str]) -> Iterator[list[int]]:
    """The texts' places, some at a time."""
    held, n = [], 0
    for i, t in enumerate(texts):
        if held and n + len(t) > AT_ONCE:
            yield held
            held, n = [], 0
        held.append(i)
        n += len(t)
    if held:
        yield held


def _counted(order: int):
    """url, role -> a row for each different window of some texts. Roles: 0 and 1 learn, 2 are held out, 3 are judged."""

    def run(batches):
        for batch in batches:
            urls, roles = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for role in range(4):
                texts = [shown(urls[i]) for i in np.flatnonzero(roles == role)]
                for some in _slices(texts):
                    contexts, grams, _ = windows([texts[i] for i in some], order)
                    for k in range(order + 1):
                        keys, first, n = np.unique(grams[k], return_index=True, return_counts=True)
                        lower = grams[k - 1][first] if k else np.zeros(len(keys), dtype=np.uint64)
                        none = np.zeros(len(keys), dtype=np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(x) for x in (np.full(len(keys), k, dtype=np.int32), *(h.view(np.int64) for h in (keys, contexts[k][first], lower)))]
                            + [pa.array(x) for x in (n if role == 0 else none, n if role == 1 else none, n if role > 1 else none, np.full(len(keys), role < 3))],
                            names=[c.split()[0] for c in WINDOWS.split(", ")],
                        )
        scratch.trim()

    return run


WINDOWS = "k int, gram long, context long, lower long, n0 long, n1 long, asked long, known boolean"


def scores(texts: DataFrame, order: int) -> DataFrame:
    """texts: url, role. gram, score and asked (how often) of each window of the highest order in texts to be judged or held out."""
    found = texts.mapInArrow(_counted(order), WINDOWS).groupBy("k", "gram", "context", "lower")
    found = found.agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "asked")), F.max("known").alias("known"))
    beside = Window.partitionBy("k", "context")
    for v in (0, 1):
        found = found.withColumns({f"total{v}": F.sum(f"n{v}").over(beside), f"kinds{v}": F.sum((F.col(f"n{v}") > 0).cast("long")).over(beside)})
    found = scratch.table(found.drop("context"), "windows")
    letters = found.filter("k = 0 AND known").count() + 1  # the end is one; and one for all others

    def chance(v: int, lower: Column) -> Column:
        n, total, kinds = (F.col(f"{c}{v}") for c in ("n", "total", "kinds"))
        return F.when(total > 0, (n + kinds * lower) / (total + kinds)).otherwise(lower).alias(f"p{v}")

    now = found.filter("k = 0").select("gram", "asked", *(chance(v, F.lit(1 / letters)) for v in (0, 1)))
    for k in range(1, order + 1):
        shorter = now.select(F.col("gram").alias("lower"), F.col("p0").alias("q0"), F.col("p1").alias("q1"))
        longer = found.filter((F.col("k") == k) & (F.col("asked") > 0))
        now = longer.join(shorter, "lower").select("gram", "asked", *(chance(v, F.col(f"q{v}")) for v in (0, 1)))
    now = now.filter("asked > 0").select("gram", (F.log("p1") - F.log("p0")).alias("score"), "asked")
    return scratch.table(now, "scores")


def _summed(sent, order: int, at: int):
    """Adds to each row the sum of its windows that were sent, its number of windows, and all its other windows' hashes;
    the URL is column `at`, and null for rows that aren't judged."""

    def run(batches):
        grams, values = sent.value
        for batch in batches:
            urls = batch.column(at).to_pylist()
            asked = [i for i, u in enumerate(urls) if u]
            texts = [shown(urls[i]) for i in asked]
            total, size, rest = [None] * len(urls), [None] * len(urls), [None] * len(urls)
            for some in _slices(texts):
                _, found, sizes = windows([texts[i] for i in some], order)
                # Different windows are looked up once.
                keys, again = np.unique(found[-1], return_inverse=True)
                place, known = _found(grams, keys)
                value = np.where(known, values[place], 0.0)[again] if len(grams) else np.zeros(len(again))
                known, start = known[again], np.cumsum(sizes) - sizes
                sums = np.add.reduceat(value, start)
                for i, a, n, s in zip(some, start.tolist(), sizes.tolist(), sums.tolist()):
                    total[asked[i]], size[asked[i]] = s, n
                    rest[asked[i]] = found[-1][a : a + n][~known[a : a + n]].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [c for i, c in enumerate(batch.columns) if i != at] + [pa.array(total, pa.float64()), pa.array(size, pa.int64()), pa.array(rest, pa.list_(pa.int64()))],
                names=[n for i, n in enumerate(batch.schema.names) if i != at] + ["total", "size", "rest"],
            )
        scratch.trim()

    return run


def _ratios(rows: DataFrame, schema: str, sent, light: DataFrame | None, order: int) -> DataFrame:
    """rows: url, then the columns of `schema`, which are given back with x: the difference of the two log-likelihoods
    for each character, the end included; null for rows without a URL."""
    columns = [c.split()[0] for c in schema.split(", ")]
    found = rows.mapInArrow(_summed(sent, order, 0), schema + ", total double, size long, rest array<long>")
    total = F.col("total")
    if light is not None:
        found = scratch.table(found.withColumn("_row", F.monotonically_increasing_id()), "sums")
        rest = found.select("_row", F.explode("rest").alias("gram")).join(light, "gram")
        rest = rest.groupBy("_row").agg(F.sum(F.col("score").cast("decimal(38,20)")).cast("double").alias("more"))
        found, total = found.join(rest, "_row", "left"), total + F.coalesce("more", F.lit(0.0))
    return found.select(*columns, (total / F.col("size")).alias("x"))


def _examples(rows: DataFrame) -> tuple[DataFrame, list[int]]:
    """url, y (1: rejected), fit and held of each distinct URL under a rule, and the numbers held of both verdicts.
    Every fourth in the order of the hash is held out for the curve; a lone one serves for both."""
    known = rows.filter("by IS NOT NULL").select("url", (F.col("by.verdict") == "block").cast("int").alias("y")).distinct()
    known = scratch.table(known.withColumn("h", F.xxhash64("url")).withColumn("range", F.shiftright("h", 64 - RANGE).cast("int")), "examples")
    counts = sorted(known.groupBy("y", "range").agg(F.count(F.lit(1)).alias("n")).collect())
    numbers, befores = [0, 0], []
    for y, part, n in counts:
        befores.append((y, part, numbers[y]))
        numbers[y] += n
    before = rows.sparkSession.createDataFrame(befores, "y int, range int, before long")
    place = F.col("before") + F.row_number().over(Window.partitionBy("y", "range").orderBy("h", "url")) - 1
    ranked = known.join(F.broadcast(before), ["y", "range"]).withColumn("held", place % 4 == 0)
    lone = F.lit(numbers[0] == 1) & (F.col("y") == 0) | F.lit(numbers[1] == 1) & (F.col("y") == 1)
    return scratch.table(ranked.select("url", "y", (~F.col("held") | lone).alias("fit"), "held"), "ranked"), [-(-n // 4) for n in numbers]


def judge(pages: DataFrame, rules=RULES, order: int = ORDER) -> DataFrame:
    """page_id, host, path, rule, verdict and rejected (the method's probability; null under a rule)."""
    spark = pages.sparkSession
    scratch.workers_import(spark)
    rows = scratch.only(pages, "page_id", "url").select(F.col("page_id").cast("long").alias("page_id"), "url")
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rows = rows.withColumn("by", rule_of(F.col("host"), F.col("path"), rules))
    asked = F.when(F.col("by").isNull() & (F.col("url") != ""), F.col("url"))  # null: nothing to judge
    flat = rows.select(asked.alias("asked"), "page_id", "host", "path", F.col("by.rule").alias("rule"), F.col("by.verdict").alias("verdict"))
    examples, numbers = _examples(rows)
    p = F.lit(0.0)
    if all(numbers):
        texts = examples.filter("fit").select("url", F.col("y").alias("role"))
        texts = texts.unionByName(examples.filter("held").select("url", F.lit(2).alias("role")))
        texts = texts.unionByName(flat.filter("asked IS NOT NULL").select(F.col("asked").alias("url"), F.lit(3).alias("role")))
        every, light = scores(texts, order), None
        heavy = every.orderBy(F.desc("asked"), "gram").limit(HEAVY).toArrow()
        if heavy.num_rows == HEAVY:
            last, gram = heavy["asked"][-1].as_py(), heavy["gram"][-1].as_py()
            light = every.filter((F.col("asked") < last) | (F.col("asked") == last) & (F.col("gram") > gram)).select("gram", "score")
        grams, values = heavy["gram"].to_numpy().view(np.uint64), heavy["score"].to_numpy()
        by = np.argsort(grams)
        sent = spark.sparkContext.broadcast((grams[by], values[by]))
        held = _ratios(examples.filter("held").select("url", "y"), "y int", sent, light, order)
        slope, shift = _curve(scratch.table(held, "ratios"), numbers)
        flat = _ratios(flat, "page_id long, host string, path string, rule string, verdict string", sent, light, order)
        p = F.when(F.col("x").isNotNull(), _chance(slope * F.col("x") + shift)).otherwise(F.lit(0.0))
    judged = F.when(p >= 0.5, "block").otherwise("allow")
    return flat.select("page_id", "host", "path", "rule", F.coalesce("verdict", judged).alias("verdict"), F.when(F.col("verdict").isNull(), p).alias("rejected"))

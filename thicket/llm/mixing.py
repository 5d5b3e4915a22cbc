"""Mixing of sources to target weights by iterative proportional fitting; DataFrame functions only.

Documents fall into cells of (source, language, topic). Raking scales the cells' token weights to
one target margin after the other, round by round, until all three fit within `FITS`: a cell's
weight is one factor for its source times one for its language times one for its topic.

A document is then sampled with its cell's chance. Chances are raked too, under the bound of 1: what
cells that are taken whole can't give, the others of the same levels make up, so the expected tokens of
the sample meet the targets within `FITS`. The share of all tokens that is kept is `rate`, or where that
can't be reached (a level can't give more than it has), the first lower one of a falling row that can.
The draw is a hash of the doc_id, so it is the same in every run and on every machine.

Only a few numbers come to the driver. Up to `FEW_CELLS` cells make one row of arrays, over which all rounds
are one expression, and are sent to the executors. More stay a table: margins are window sums over it, each
round is written to the shared folder, and documents meet their cells by a shuffle with salted keys.

Targets are shares for each level. Where none are given for a column, its levels' shares of the
tokens are raised to a power below 1 and scaled to 1, which lowers a hot source and lifts the rest.

The topic of a document is the first topic of which a marker occurs in its lower-cased text.
A document's tokens are its words (runs of other characters than white space), 1 at least.

Defined cases: a null source, language or text counts as the empty string; texts of any length are
counted whole; levels without a target get share 0 where targets are given; targets that no weights meet
are approached for `ROUNDS` rounds; rows with the same doc_id are kept or left together, null ones too; an
empty table gives an empty result; `weigh` reads the id, source, language and text alone, and `sample`
keeps all columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import scratch
from .scratch import bound

#: Topic and its markers, the first that fits; documents of no other topic are prose.
TOPICS = [
    ("legal", ["license", "rights reserved", "copyright"]),
    ("credentials", ["password", "token =", "api_key", "akia"]),
    ("contact", ["@", "http"]),
    ("table", [" | "]),
    ("noise", ["###", "***", "!!"]),
]
OTHER = "prose"
MARGINS = ("source", "lang", "topic")
POWERS = {"source": 0.7, "lang": 0.8, "topic": 0.9}
#: The share of tokens to keep, and how near the most that a level can give it may come.
RATE, NEAR = 0.8, 0.95
#: Most rounds for the weights, and the largest difference of a level from its target, as a share of the
#: target, that counts as met.
ROUNDS, FITS = 120, 0.002
#: Rounds for the chances at one rate before the next one, STEP of it, is tried; so many rates at most.
TRIED, STEP, RATES = 30, 0.85, 30
FEW_CELLS, SALT = 5000, 16
WORD = r"[^\x20\x09-\x0D]+"


def topic_of(text: Column) -> Column:
    low, topic = F.lower(text), F.lit(OTHER)
    for name, markers in reversed(TOPICS):
        some = F.lit(False)
        for m in markers:
            some = some | low.contains(m)
        topic = F.when(some, name).otherwise(topic)
    return topic


def draw(doc_id: Column, salt: str = "mix") -> Column:
    """A number from 0 to 1 (exclusive) that depends on the id alone."""
    digest = F.md5(F.concat(F.lit(salt + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def _measured(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns(
        {
            "_source": F.coalesce(F.col("source").cast("string"), F.lit("")),
            "_lang": F.coalesce(F.col("lang").cast("string"), F.lit("")),
            "_topic": topic_of(text),
            "_tokens": F.greatest(F.regexp_count(text, F.lit(WORD)), F.lit(1)).cast("long"),
        }
    )


def _aimed(cells: DataFrame, targets: dict[str, dict[str, float]] | None) -> tuple[DataFrame, float]:
    """Adds the tokens that each cell's source, language and topic shall have; also gives the largest share of
    its targets that every level can meet."""
    spark = cells.sparkSession
    power = F.element_at(F.create_map(*(F.lit(x) for pair in POWERS.items() for x in pair)), F.col("margin"))
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("margin"), F.col(m).alias("level")) for m in MARGINS)))
    levels = cells.select(each.alias("of"), "tokens").groupBy("of.margin", "of.level").agg(F.sum("tokens").alias("n"))
    share = F.pow("n", power)
    if targets:
        asked = [(m, k, float(v)) for m, given in targets.items() for k, v in given.items()]
        asked = spark.createDataFrame(asked, "margin string, level string, share double")
        levels = levels.join(asked, ["margin", "level"], "left")
        share = F.when(F.col("margin").isin([*targets]), F.coalesce("share", F.lit(0.0))).otherwise(share)
    levels = scratch.table(levels.select("margin", "level", "n", share.alias("share")), "levels")
    sums = levels.groupBy("margin").agg(F.sum("n").alias("total"), F.sum("share").alias("scale"), F.min(F.when(F.col("share") > 0, F.col("n") / F.col("share"))).alias("least"))
    most = float("inf")
    for r in sums.collect():  # one row a margin
        want = F.lit(r.total / (r.scale or 1.0)) * F.col("share")
        of = levels.filter(F.col("margin") == r.margin).select(F.col("level").alias(r.margin), want.alias(f"want_{r.margin}"))
        cells = cells.join(of, r.margin)
        most = most if r.least is None else min(most, r.least * r.scale / r.total)
    return cells, most


def _round(cells: DataFrame, rate: float, limit: float) -> DataFrame:
    """`cells` after one round on column g; `off` is the largest difference of the cell's levels."""

    def now(m: str) -> Column:
        return F.sum(F.col("tokens") * F.least(F.lit(limit), F.col("g"))).over(W.partitionBy(m))

    rest = [c for c in cells.columns if c not in ("g", "off")]
    for m in MARGINS:
        cells = cells.select(*rest, F.when(now(m) > 0, F.col("g") * (F.lit(rate) * F.col(f"want_{m}") / now(m))).otherwise(0.0).alias("g"))
    off = [F.when(F.col(f"want_{m}") > 0, F.abs(now(m) / (F.lit(rate) * F.col(f"want_{m}")) - 1.0)).otherwise(0.0) for m in MARGINS]
    return cells.select(*rest, "g", F.greatest(*off).alias("off"))


def _rounds(cells: DataFrame, rate: float, limit: float, most: int) -> tuple[DataFrame, bool]:
    """Rounds until the margins fit, and whether they do."""
    for _ in range(most):
        cells = scratch.table(_round(cells, rate, limit), "cells")
        if cells.agg(F.max("off")).first()[0] <= FITS:
            return cells, True
    return cells, False


def _rake_table(aimed: DataFrame, rate: float) -> DataFrame:
    weighed, _ = _rounds(aimed.withColumn("g", F.lit(1.0)), 1.0, float("inf"), ROUNDS)
    weighed = weighed.withColumn("weight", F.col("g"))
    for _ in range(RATES):
        chosen, fits = _rounds(weighed.withColumn("g", F.lit(rate) * F.col("weight")), rate, 1.0, TRIED)
        if fits:
            break
        rate *= STEP
    return chosen.select(*MARGINS, "weight", F.least(F.lit(1.0), "g").alias("chance"))


def _rake_row(aimed: DataFrame, rate: float) -> DataFrame:
    """The same over arrays: `at_m` is the place of each cell's level, `of_m` the places of each level's cells."""
    row = aimed.agg(F.array_sort(F.collect_list(F.struct(*MARGINS, "tokens", *(f"want_{m}" for m in MARGINS)))).alias("cells"))
    row = scratch.table(row.select("cells", *(F.array_distinct(f"cells.{m}").alias(f"levels_{m}") for m in MARGINS)), "row")

    def indexed(m: str) -> list[Column]:
        at = F.transform(f"cells.{m}", lambda v: F.array_position(f"levels_{m}", v).cast("int") - 1)
        every = F.sequence(F.lit(0), F.size("cells") - 1)
        of = F.transform(f"levels_{m}", lambda v: F.filter(every, lambda i: F.get(f"cells.{m}", i) == v))
        return [F.col(f"cells.want_{m}").alias(f"want_{m}"), at.alias(f"at_{m}"), of.alias(f"of_{m}")]

    row = scratch.table(row.select("cells", F.col("cells.tokens").alias("tokens"), *(c for m in MARGINS for c in indexed(m))), "row")

    def sums(g: Column, m: str, limit: float) -> Column:
        weight = lambda i: F.get("tokens", i) * F.least(F.lit(limit), F.get(g, i))
        return F.transform(f"of_{m}", lambda places: F.aggregate(places, F.lit(0.0), lambda a, i: a + weight(i)))

    def scaled(g: Column, m: str, rate: Column, limit: float) -> Column:
        def by(now: Column) -> Column:
            level = lambda i: F.get(now, F.get(f"at_{m}", i))
            return F.transform(g, lambda x, i: F.when(level(i) > 0, x * (rate * F.get(f"want_{m}", i) / level(i))).otherwise(0.0))

        return bound(sums(g, m, limit), by)

    def difference(g: Column, m: str, rate: Column, limit: float) -> Column:
        def by(now: Column) -> Column:
            want = lambda i: rate * F.get(f"want_{m}", i)
            return F.array_max(F.transform(f"at_{m}", lambda level, i: F.when(want(i) > 0, F.abs(F.get(now, level) / want(i) - 1.0)).otherwise(0.0)))

        return bound(sums(g, m, limit), by)

    def state(g: Column, it: Column, rate: Column, off: Column) -> Column:
        return F.struct(g.alias("g"), it.alias("it"), rate.alias("rate"), off.alias("off"))

    def one_round(now: Column, limit: float) -> Column:
        def after(g: Column) -> Column:
            return state(g, now["it"] + 1, now["rate"], F.greatest(*(difference(g, m, now["rate"], limit) for m in MARGINS)))

        first, second, third = MARGINS
        turned = bound(scaled(now["g"], first, now["rate"], limit), lambda g: bound(scaled(g, second, now["rate"], limit), lambda h: scaled(h, third, now["rate"], limit)))
        return bound(turned, after)

    unset = F.lit(float("inf"))
    begin = state(F.transform("tokens", lambda _: F.lit(1.0)), F.lit(0), F.lit(1.0), unset)
    weight = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), begin, lambda now, _: F.when(now["off"] <= FITS, now).otherwise(one_round(now, float("inf"))), lambda now: now["g"])
    row = scratch.table(row.withColumn("weight", weight), "row")

    def start(rate: Column) -> Column:
        return state(F.transform("weight", lambda w: rate * w), F.lit(0), rate, unset)

    def step(now: Column, _: Column) -> Column:
        return F.when(now["off"] <= FITS, now).when(now["it"] == TRIED, start(now["rate"] * STEP)).otherwise(one_round(now, 1.0))

    chance = F.aggregate(F.sequence(F.lit(1), F.lit(RATES * (TRIED + 1) - 1)), start(F.lit(rate)), step, lambda now: F.transform(now["g"], lambda g: F.least(F.lit(1.0), g)))
    found = row.select(F.explode(F.arrays_zip("cells", "weight", chance.alias("chance"))).alias("x"))
    return found.select(*(F.col(f"x.cells.{m}").alias(m) for m in MARGINS), "x.weight", "x.chance")


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, rate: float = RATE) -> DataFrame:
    """cells: source, lang, topic, tokens. A table of each cell's weight and chance."""
    n = cells.count()
    if not n:
        return cells.select(*MARGINS, F.lit(0.0).alias("weight"), F.lit(0.0).alias("chance"))
    aimed, most = _aimed(cells, targets)
    raked = (_rake_row if n <= FEW_CELLS else _rake_table)(aimed, min(rate, NEAR * most))
    return scratch.table(raked, "cells")


def _with_cells(rows: DataFrame, cells: DataFrame, prefix: str = "") -> DataFrame:
    """The rows with `weight` and `chance` of their cell; their cell columns have the prefix."""
    keys = [f"_cell_{m}" for m in MARGINS]
    cells = cells.select(*(F.col(m).alias(k) for m, k in zip(MARGINS, keys)), "weight", "chance")
    if cells.count() <= FEW_CELLS:
        cells = F.broadcast(cells)
    else:  # a cell may hold a third of the rows
        cells = cells.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        rows, keys = rows.withColumn("_dealt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALT)).cast("int")), [*keys, "_salt"]
    on = F.lit(True)
    for m in MARGINS:
        on = on & (F.col(prefix + m) == F.col(f"_cell_{m}"))
    if "_salt" in keys:
        on = on & (F.col("_dealt") == F.col("_salt"))
    return rows.join(cells, on).drop("_dealt", *keys)


def weigh(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, rate: float = RATE) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight and chance of the cell, and kept."""
    rows = scratch.only(docs, "doc_id", "source", "lang", "text")
    rows = _measured(rows.withColumn("doc_id", F.col("doc_id").cast("long")))
    rows = rows.select("doc_id", *(F.col(f"_{m}").alias(m) for m in MARGINS), F.col("_tokens").alias("n_tokens"))
    rows = scratch.table(rows, "mixing")
    cells = scratch.table(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").cast("double").alias("tokens")), "cells")
    rows = _with_cells(rows, rake(cells, targets, rate))
    kept = draw(F.col("doc_id")) < F.col("chance")
    return rows.select("doc_id", *MARGINS, "n_tokens", F.round("weight", 6).alias("weight"), F.round("chance", 6).alias("chance"), kept.alias("kept"))


def sample(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, rate: float = RATE) -> DataFrame:
    """The documents kept, with the input's columns."""
    rows, back = scratch.beside(docs, "doc_id", "source", "lang", "text")
    rows = _measured(rows)
    cells = rows.groupBy(*(F.col(f"_{m}").alias(m) for m in MARGINS)).agg(F.sum("_tokens").cast("double").alias("tokens"))
    rows = _with_cells(rows, rake(scratch.table(cells, "cells"), targets, rate), "_")
    return rows.filter(draw(F.col("doc_id")) < F.col("chance")).select(*back)


def sql(documents: str = "documents", rate: float = RATE) -> str:
    """The same as `weigh` over a table of documents, in DuckDB's SQL: each step of a recursion is a round."""
    topic = "CASE " + " ".join(
        "WHEN " + " OR ".join(f"contains(lower(t), '{m}')" for m in markers) + f" THEN '{name}'" for name, markers in TOPICS
    ) + f" ELSE '{OTHER}' END"
    wants = ", ".join(f"want_{k}" for k in MARGINS)

    def rounds(start: str, bound: str, kept: str) -> str:
        """One round over the rows of `start`: cells, their wants, rate and g, and the columns `kept`."""
        at = start
        for k in MARGINS:
            now = f"sum(tokens * least({bound}, g)) OVER (PARTITION BY {k})"
            at = f"(SELECT * EXCLUDE (g, now), CASE WHEN now > 0 THEN g * (rate * want_{k} / now) ELSE 0.0 END AS g FROM (SELECT *, {now} AS now FROM {at}))"
        off = ", ".join(f"CASE WHEN want_{k} > 0 THEN abs(sum(tokens * least({bound}, g)) OVER (PARTITION BY {k}) / (rate * want_{k}) - 1.0) ELSE 0.0 END" for k in MARGINS)
        return f"SELECT source, lang, topic, tokens, {wants}, {kept}, rate, g, max(o) OVER () AS off FROM (SELECT *, greatest({off}) AS o FROM {at})"

    unmet = f"NOT (it > 0 AND off <= {FITS})"
    parts = [
        f"d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM {documents})",
        f"m AS MATERIALIZED (SELECT doc_id, source, lang, {topic} AS topic, greatest(len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')), 1)::BIGINT AS n_tokens FROM d)",
        "c AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM m GROUP BY ALL)",
        "total AS (SELECT sum(tokens) AS n FROM c)",
    ]
    for k in MARGINS:
        parts.append(f"s_{k} AS (SELECT {k}, sum(tokens) AS have, power(sum(tokens) / any_value(n), {POWERS[k]}) AS share FROM c, total GROUP BY {k})")
        parts.append(f"w_{k} AS (SELECT {k}, have, n * share / (SELECT sum(share) FROM s_{k}) AS want_{k} FROM s_{k}, total)")
    joins = " ".join(f"JOIN w_{k} USING ({k})" for k in MARGINS)
    most = ", ".join(f"(SELECT min(have / want_{k}) FROM w_{k})" for k in MARGINS)
    parts += [
        f"a AS MATERIALIZED (SELECT source, lang, topic, tokens, {wants} FROM c {joins})",
        f"r AS (SELECT *, 0 AS it, 1.0::DOUBLE AS rate, 1.0::DOUBLE AS g, 9e9::DOUBLE AS off FROM a UNION ALL "
        + rounds(f"(SELECT * FROM r WHERE {unmet} AND it < {ROUNDS})", "1e300::DOUBLE", "it + 1 AS it").replace("it + 1 AS it, rate", "it + 1, rate")
        + ")",
        f"w AS MATERIALIZED (SELECT source, lang, topic, tokens, {wants}, g AS weight FROM r WHERE it = (SELECT max(it) FROM r))",
        f"best AS (SELECT least({rate}, {NEAR} * least({most}))::DOUBLE AS rate)",
        # A step is a round, or where a rate's rounds are used up, the start of the next rate.
        f"b AS (SELECT source, lang, topic, tokens, {wants}, weight, 0 AS n, 0 AS it, rate, rate * weight AS g, 9e9::DOUBLE AS off FROM w, best UNION ALL SELECT * FROM ("
        + rounds(f"(SELECT * FROM b WHERE {unmet} AND it < {TRIED})", "1.0::DOUBLE", "weight, n + 1 AS n, it + 1 AS it")
        + f" UNION ALL SELECT source, lang, topic, tokens, {wants}, weight, n + 1, 0, rate * {STEP}, rate * {STEP} * weight, 9e9 FROM b WHERE {unmet} AND it = {TRIED} AND n < {RATES * (TRIED + 1) - 1}))",
        "x AS (SELECT m.*, b.weight, least(1.0, b.g) AS chance FROM m JOIN b USING (source, lang, topic) WHERE b.n = (SELECT max(n) FROM b))",
    ]
    drawn = "('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT / 281474976710656.0::DOUBLE"
    return (
        "WITH RECURSIVE " + ", ".join(parts) + " SELECT doc_id, source, lang, topic, n_tokens, round(weight, 6) AS weight, "
        f"round(chance, 6) AS chance, {drawn} < chance AS kept FROM x"
    )

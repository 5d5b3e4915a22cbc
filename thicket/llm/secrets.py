"""Secret scans; DataFrame functions only.

Three base patterns (assignments, access keys, long hexadecimal runs) give spans. Besides them, every
long run of key characters is a candidate, and a window of fixed width slides over it. The window's
counts of each character are carried along: when a character enters and one leaves, those two counts
change by one, and with them the sum of c * log2(c), and so the Shannon entropy. A candidate whose
highest window entropy reaches the limit of its character class is a span of kind `entropy`, unless
the allow-list knows its form or it overlaps a base span.

Spans are offsets in code points, the end exclusive. A document is one row throughout: nothing is
shuffled, and the regular expressions that find spans run only on texts that a cheap test passes. Time
grows in proportion to a text's length, its longest run and its number of matches: offsets, entropies and
overlaps are running folds, and a fold that returns an array does so in pieces (`running`).

Defined cases: a null text is empty: no spans, the digest of the empty string; texts and runs of any
length are read whole; repeated rows and rows with a null id are each scanned; an empty table gives an
empty result; columns besides the id and text are not read by `scan`, and are kept by `redact`,
whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .scratch import bound

#: The base patterns, in the order in which kinds are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ["assign", "access", "hex", "entropy"]
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
#: Words of which an assignment has one.
ASSIGNED = ["password", "passwd", "secret", "token", "apikey", "api_key"]

CANDIDATE, LEAST_CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}", 20
WIDTH = 20
CONSONANTS = "[bcdfghjklmnpqrstvwxz]"
#: Character classes, narrowest first: name, patterns that all fit a candidate of it, least entropy in
#: bits. Letters alone say less than letters and digits, so they need a run of consonants that words
#: don't have, or an entropy that words don't reach.
CLASSES = [
    ("hex", ["^[0-9a-f]+$|^[0-9A-F]+$"], 2.95),
    ("mixed hex", ["^[0-9a-fA-F]+$", "[0-9]"], 3.25),
    ("upper", ["^[A-Z0-9]+$", "[0-9]"], 3.25),
    ("lower letters", ["^[a-z]+$", CONSONANTS + "{6}"], 3.7),
    ("odd letters", ["^[A-Za-z+/_=-]+$", "[A-Z]", "(?i)" + CONSONANTS + "{5}"], 3.8),
    ("letters", ["^[A-Za-z]+$"], 4.15),
    ("base64", ["[0-9]", "[A-Za-z]"], 3.65),
]
#: Forms that look random and are no secrets: UUIDs, paths, counting runs, samples, hyphenated words.
ALLOWED = [
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"^/?([A-Za-z_-][A-Za-z0-9_-]*/){2,}[A-Za-z0-9_=-]*$",
    r"(?i)^.{0,60}(0123456789|abcdefghij|example|sample|placeholder|xxxx).{0,60}$",
    r"^[a-z]+([_-][a-z]+)+$",
]
#: Of ALLOWED, the form of paths excuses only plain words: fewer than LEAST_MIXED places where lower
#: case turns to upper, capitals to lower case or digits to letters.
PATH, MIXED, LEAST_MIXED = ALLOWED[1], r"[a-z][A-Z]|[A-Z]{2}[a-z]|[0-9][A-Za-z]", 3

SPAN = "array<struct<start:int,kind:int,end:int,text:string>>"
#: Items that a running fold takes at a time.
PIECE = 256


def running(items: Column, begin: Column, step, kind: str) -> Column:
    """The array of what `step` (state, item) -> (state, output) puts out along `items`; outputs are arrays
    of `kind`. Adding to an array copies it, so pieces are folded apart and then put together."""
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / PIECE).cast("int")), lambda k: F.slice(items, k * PIECE + 1, F.lit(PIECE)))

    def within(acc: Column, x: Column) -> Column:
        state, out = step(acc["state"], x)
        return F.struct(state.alias("state"), F.concat(acc["out"], out).alias("out"))

    def across(acc: Column, piece: Column) -> Column:
        start = F.struct(acc["state"].alias("state"), F.array().cast(kind).alias("out"))
        done = F.aggregate(piece, start, within)
        # Bound to one variable, so that the inner fold runs once.
        return F.element_at(F.transform(F.array(done), lambda d: F.struct(d["state"].alias("state"), F.array_append(acc["out"], d["out"]).alias("out"))), 1)

    start = F.struct(begin.alias("state"), F.array().cast(f"array<{kind}>").alias("out"))
    found = F.flatten(F.aggregate(pieces, start, across, lambda acc: acc["out"]))
    return F.when(F.size(items) > 0, found).otherwise(F.array().cast(kind))


def _spans(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """Every match with its place; `text` is the match's group. The pieces between matches give the places."""
    match, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    shown = match if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.filter(F.arrays_zip(between.alias("gap"), match.alias("hit"), shown.alias("shown")), lambda x: x["hit"].isNotNull())

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        begin = at + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        return end, F.array(F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["shown"].alias("text")))

    return bound(parts, lambda p: running(p, F.lit(0), step, SPAN))


def _c_log_c(n: Column) -> Column:
    return F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(0.0)


def highest_entropy(text: Column, width: int) -> Column:
    """The highest Shannon entropy, in bits, of a window of `width` characters that slides over `text`.

    `counts` holds one character for each different one of the text, `0` raised by its count in the window."""
    if not 0 < width < 64:
        raise ValueError("a window has 1 to 63 characters")

    def entropy(of: Column) -> Column:
        letters, codes = of["letters"], of["codes"]
        leave = F.concat(F.array_repeat(F.lit(0).cast("bigint"), width), F.slice(codes, F.lit(1), F.greatest(F.size(codes) - width, F.lit(0))))
        moves = F.slice(F.zip_with(codes, leave, lambda a, b: F.struct(a.alias("enter"), b.alias("leave"))), F.lit(1), F.size(codes))

        def held(counts: Column, code: Column) -> Column:
            return F.ascii(F.substring(counts, code, F.lit(1))) - 48

        def put(counts: Column, code: Column, n: Column) -> Column:
            return F.overlay(counts, F.char(n + 48), code.cast("int"), F.lit(1))

        def step(acc: Column, move: Column) -> Column:
            def left(n: Column) -> Column:  # n: the count of what leaves
                gone = F.when(move["leave"] > 0, put(acc["counts"], move["leave"], n - 1)).otherwise(acc["counts"])
                less = F.when(move["leave"] > 0, _c_log_c(n) - _c_log_c(n - 1)).otherwise(0.0)
                return F.struct(gone.alias("counts"), (acc["total"] - less).alias("total"))

            def entered(was: Column) -> Column:
                def with_count(n: Column) -> Column:  # n: the count before of what enters
                    total = was["total"] + _c_log_c(n + 1) - _c_log_c(n)
                    least = F.when((acc["n"] >= width - 1) & (total < acc["least"]), total).otherwise(acc["least"])
                    return F.struct(put(was["counts"], move["enter"], n + 1).alias("counts"), total.alias("total"), (acc["n"] + 1).alias("n"), least.alias("least"))

                return bound(held(was["counts"], move["enter"]), with_count)

            return bound(bound(held(acc["counts"], F.greatest(move["leave"], F.lit(1))), left), entered)

        begin = F.struct(F.repeat(F.lit("0"), F.size(letters)).alias("counts"), F.lit(0.0).alias("total"), F.lit(0).alias("n"), F.lit(float("inf")).alias("least"))
        return F.lit(math.log2(width)) - F.aggregate(moves, begin, step, lambda acc: acc["least"]) / F.lit(float(width))

    def coded(letters: Column) -> Column:
        codes = F.transform(F.split(text, ""), lambda c: F.array_position(letters, c))
        return F.struct(letters.alias("letters"), codes.alias("codes"))

    return bound(bound(F.array_distinct(F.split(text, "")), coded), entropy)


def suspicious(text: Column) -> Column:
    """Whether a candidate string is random enough for its class and of no allowed form."""
    limit = F.lit(None).cast("double")
    for _, forms, least in reversed(CLASSES):
        fits = F.lit(True)
        for form in forms:
            fits = fits & text.rlike(form)
        limit = F.when(fits, F.lit(least)).otherwise(limit)
    allowed = F.lit(False)
    for form in ALLOWED:
        known = text.rlike(form)
        allowed = allowed | ((known & (F.regexp_count(text, F.lit(MIXED)) < LEAST_MIXED)) if form == PATH else known)
    limit = F.when(allowed, None).otherwise(limit)
    return bound(limit, lambda least: F.when(least.isNotNull(), highest_entropy(text, WIDTH) >= least).otherwise(False))


def _apart(spans: Column) -> Column:
    """Sorted spans without those of the method that overlap a base span. One fold carries the furthest end of
    the base spans before, one from behind the nearest start of those after."""
    kept = SPAN.replace("struct<", "struct<ok:boolean,", 1)

    def after(end: Column, s: Column) -> tuple[Column, Column]:
        base = s["kind"] < 3
        fields = [s[f].alias(f) for f in ("start", "kind", "end", "text")]
        return F.when(base, F.greatest(end, s["end"])).otherwise(end), F.array(F.struct((base | (end <= s["start"])).alias("ok"), *fields))

    def before(start: Column, s: Column) -> tuple[Column, Column]:
        base = s["kind"] < 3
        span = F.struct(*(s[f].alias(f) for f in ("start", "kind", "end", "text")))
        fits = base | (s["ok"] & (s["end"] <= start))
        return F.when(base, s["start"]).otherwise(start), F.when(fits, F.array(span)).otherwise(F.array().cast(SPAN))

    ahead = running(spans, F.lit(0), after, kept)
    return bound(F.reverse(ahead), lambda back: F.reverse(running(back, F.lit(2**31 - 1), before, SPAN)))


def spans_of(text: Column, low: Column, long_run: Column) -> tuple[Column, Column]:
    """Base spans (kinds 0 to 2) and the method's, each unsorted. low: the text in lower case; long_run:
    whether a candidate occurs in it."""
    none = F.array().cast(SPAN)
    named = F.lit(False)
    for w in ASSIGNED:
        named = named | low.contains(w)
    assign = F.when(named, F.filter(_spans(text, ASSIGN, 0, 2), lambda s: F.length(s["text"]) >= LEAST_VALUE)).otherwise(none)
    # A run that is too short can hold no longer match, so the least length may stand in the pattern.
    access = F.when(text.contains("AKIA"), _spans(text, r"AKIA[A-Z0-9]{%d,}" % (LEAST_ACCESS - 4), 1)).otherwise(none)
    hexes = F.when(long_run, _spans(text, r"[0-9a-f]{%d,}" % LEAST_HEX, 2)).otherwise(none)
    base = F.concat(assign, access, hexes)
    more = F.when(long_run, F.filter(_spans(text, CANDIDATE, 3), lambda s: suspicious(s["text"]))).otherwise(none)
    return base, more


def find(docs: DataFrame) -> DataFrame:
    """The input, which needs a column `text` and none of the names made here, with `base_spans` and
    `spans` (start, kind, end, text), sorted by start, then kind."""
    rows = docs.withColumn("_text", F.coalesce("text", F.lit("")))
    rows = rows.withColumns({"_low": F.lower("_text"), "_run": F.col("_text").rlike(CANDIDATE.replace(",}", "}"))})
    base, more = spans_of(F.col("_text"), F.col("_low"), F.col("_run"))
    rows = rows.withColumns({"_base": F.array_sort(base), "_more": more})
    mixed = (F.size("_base") > 0) & (F.size("_more") > 0)
    both = F.array_sort(F.concat("_base", "_more"))
    rows = rows.withColumns({"base_spans": F.col("_base"), "spans": F.when(mixed, bound(both, _apart)).otherwise(both)})
    return rows.drop("_text", "_low", "_run", "_base", "_more")


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans."""
    found = find(scratch.only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")))
    kinds = F.transform("base_spans", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, F.lit(k).eqNullSafe)).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base_spans")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The input with every span in `text` replaced by `mark`; a null text stays null."""

    def marked(letters: Column) -> Column:  # Spark finds a place in a string by counting from its start, in an array at once
        def step(at: Column, s: Column) -> tuple[Column, Column]:
            gap = F.array_join(F.slice(letters, at + 1, F.greatest(s["start"] - at, F.lit(0))), "")
            inside = s["start"] < at  # overlaps the one before, which has its mark already
            return F.greatest(at, s["end"]), F.when(inside, F.array().cast("array<string>")).otherwise(F.array(gap, F.lit(mark)))

        last = F.array_max(F.transform("spans", lambda s: s["end"]))
        rest = F.array_join(F.slice(letters, last + 1, F.size(letters)), "")
        return F.concat(F.array_join(running(F.col("spans"), F.lit(0), step, "array<string>"), ""), rest)

    rows, back = scratch.beside(docs, "text")
    at = f"c{docs.columns.index('text')}"
    found = find(rows)
    return found.withColumn(at, F.when(F.size("spans") > 0, bound(F.split("text", ""), marked)).otherwise(F.col("text"))).select(*back)


def sql(documents: str = "documents") -> str:
    """The same as `scan` over a table of documents, in DuckDB's SQL."""

    def spans(kind: int, pattern: str, shown: int = 0) -> str:
        quoted = pattern.replace("'", "''")
        return (
            f"SELECT r, {kind} AS kind, i, m[i] AS hit, shown[i] AS shown, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::INTEGER AS start "
            f"FROM (SELECT r, regexp_extract_all(t, '{quoted}', 0) AS m, regexp_extract_all(t, '{quoted}', {shown}) AS shown, string_split_regex(t, '{quoted}') AS gaps FROM d), unnest(range(1, len(m) + 1)) AS u(i)"
        )

    highest = f"list_max(list_transform(range(1, length(shown) - {WIDTH} + 2), lambda i: list_aggregate(string_split(substr(shown, i, {WIDTH}), ''), 'entropy')))"
    fits = " ".join("WHEN " + " AND ".join(f"regexp_matches(shown, '{f}')" for f in forms) + f" THEN {highest} >= {least}" for _, forms, least in CLASSES)
    plain = f" AND len(regexp_extract_all(shown, '{MIXED}')) < {LEAST_MIXED}"
    allowed = " OR ".join(f"(regexp_matches(shown, '{f}'){plain * (f == PATH)})" for f in ALLOWED)
    joined = "string_agg(k || ':' || start || ':' || stop, ',' ORDER BY start, kind)"
    return (
        f"WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM {documents}), "
        f"a AS ({spans(0, ASSIGN, 2)}), b AS ({spans(1, ACCESS)}), c AS ({spans(2, HEX)}), e AS ({spans(3, CANDIDATE)}), "
        f"base AS (SELECT r, kind, start, start + length(hit) AS stop FROM (SELECT * FROM a WHERE length(shown) >= {LEAST_VALUE} UNION ALL SELECT * FROM b WHERE length(hit) >= {LEAST_ACCESS} UNION ALL SELECT * FROM c WHERE length(hit) >= {LEAST_HEX})), "
        f"more AS (SELECT r, kind, start, start + length(hit) AS stop FROM e WHERE NOT ({allowed}) AND CASE {fits} ELSE FALSE END), "
        "every AS (SELECT * FROM base UNION ALL SELECT * FROM more m WHERE NOT EXISTS (SELECT 1 FROM base x WHERE x.r = m.r AND x.start < m.stop AND m.start < x.stop)), "
        f"n AS (SELECT *, CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'entropy' END AS k FROM every), "
        f"s AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, coalesce({joined.replace(')', '')}) FILTER (kind < 3), '') AS base, {joined} AS spans FROM n GROUP BY r) "
        "SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN s ON s.r = d.r"
    )

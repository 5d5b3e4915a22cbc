"""Licence scans by a positional index of rare words; DataFrame functions only.

Texts are lower-cased (A to Z) and cut into words (runs of letters, digits and characters beyond ASCII).
Each licence template is a short run of words; an index holds, for each word, the templates and
places where it stands. The inverse document frequency of the templates' words is counted over all
documents. Each template is looked up by its anchors, the `ANCHORS` rarest words of its mandatory key
phrases: each of an anchor's places in a file votes for (template, place of the template's start in
the file), and votes that agree on the relative position meet in one aggregation. Where all anchors
agree, the file's words there are laid beside the template: its key phrases must stand word for
word, and the share of equal words must reach `LEAST_COVERED`. That share is the score. As key
phrases are mandatory, a match holds all anchors, so none is lost whatever else the file holds.
A hit carries the words around it alone (as many as any template may need), so a long file costs its
length and its hits, not their product.

Base places, where a fixed phrase's words stand consecutively, are counted besides.

Defined cases: a null text is empty: no words, no places, null first and last word, empty labels,
score 0; repeated rows and rows with a null id are each scanned; texts of any length are read whole; an
empty table gives an empty result; columns besides the id and text are not read, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

#: The characters between words, and the base phrases with their labels.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Label, template, mandatory key phrases.
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "licensed under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted", "associated documentation files"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2"]),
    ("gpl-3.0", "gnu general public license version 3", ["general public license version 3"]),
    ("gpl-2.0", "gnu general public license version 2", ["general public license version 2"]),
    ("lgpl", "gnu lesser general public license", ["lesser general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that", ["redistribution and use in source"]),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("copyright", "copyright c all rights reserved", ["all rights reserved"]),
]
#: Words too common to say anything about a licence; templates are found by their others.
COMMON = "a all an and any are as by c for from in is of on or that the this to use with without under v 0 2 3 4".split()
ANCHORS, LEAST_COVERED = 2, 0.75
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(lowered: Column) -> Column:
    return F.filter(F.split(lowered, BETWEEN), lambda w: w != "")


def _places(words: Column, phrase: str) -> Column:
    """Where the phrase's words stand one after another, from 0."""
    want = phrase.split()

    def here(w: Column, i: Column) -> Column:
        fits = w == want[0]
        for k, x in enumerate(want[1:], 1):
            fits = fits & (F.get(words, i + k) == x)
        return F.when(fits, i)

    return F.filter(F.transform(words, here), lambda i: i.isNotNull())


def _postings(spark, idf: dict[str, float]) -> DataFrame:
    rows = []
    for t, (label, template, keys) in enumerate(TEMPLATES):
        words = template.split()
        spans = []
        for key in keys:
            k = key.split()
            spans.append(next((i, len(k)) for i in range(len(words)) if words[i : i + len(k)] == k))
        mandatory = {words[at]: at for i, n in spans for at in range(i, i + n) if words[at] not in COMMON}
        for w in sorted(mandatory, key=lambda w: (-idf[w], w))[:ANCHORS]:
            rows.append((w, t, label, mandatory[w], words, spans))
    return spark.createDataFrame(rows, "word string, template int, label string, place int, words array<string>, keys array<struct<at:int,n:int>>")


def scan(docs: DataFrame, least_covered: float = LEAST_COVERED) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches.

    matches: the templates found, as (label, first word, share of equal words).
    """
    spark = docs.sparkSession
    vocabulary = sorted({w for _, t, _ in TEMPLATES for w in t.split()} - set(COMMON))
    asked = sorted({*vocabulary, "cc", "license", "reserved"})
    lowered = scratch.only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER).alias("low"))
    cut = lowered.withColumn("cut", F.split("low", BETWEEN))
    some = F.arrays_overlap("cut", F.array(*map(F.lit, asked)))
    n = F.size("cut")
    edges = F.when(F.element_at("cut", 1) == "", 1).otherwise(0) + F.when((n > 1) & (F.element_at("cut", -1) == ""), 1).otherwise(0)
    files = scratch.table(
        cut.select("doc_id", (n - edges).cast("long").alias("n_words"), F.when(some, F.col("low")).alias("low"))
        .withColumn("row", F.monotonically_increasing_id()),
        "licences",
    )

    near = files.filter(F.col("low").isNotNull()).select("row", words_of(F.col("low")).alias("words"))
    places = {label: _places(F.col("words"), phrase) for phrase, label in PHRASES.items()}
    base = near.select("row", *(p.alias(k) for k, p in places.items()))
    every = F.concat(*(F.col(f"`{k}`") for k in places))
    base = base.select(
        "row",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.filter(F.array(*(F.when(F.size(F.col(f"`{k}`")) > 0, F.lit(k)) for k in places)), lambda x: x.isNotNull()).alias("base"),
    ).filter("n_base > 0")

    # Document frequencies of the templates' words; at most one row for each of them.
    held = near.select("row", "words", F.array_intersect("words", F.array(*map(F.lit, vocabulary))).alias("licence_words"))
    total = files.count()
    seen = held.select(F.explode("licence_words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    df = {r.word: r.n for r in seen.collect()}
    idf = {w: math.log(1 + total / (1 + df.get(w, 0))) for w in vocabulary}
    postings = _postings(spark, idf)
    anchors = F.array(*map(F.lit, sorted({r.word for r in postings.select("word").collect()})))
    looked = held.filter(F.arrays_overlap("licence_words", anchors))
    # Words from `reach` before a hit to `reach` after it; places outside the file are null.
    reach = max(len(t.split()) for _, t, _ in TEMPLATES)
    around = lambda i: F.transform(F.sequence(i - reach, i + reach), lambda k: F.when(k >= 0, F.get("words", k)))
    places = F.filter(F.transform("words", lambda w, i: F.when(F.array_contains(anchors, w), i)), lambda i: i.isNotNull())
    hits = F.transform(places, lambda i: F.struct(i.alias("at"), F.get("words", i).alias("word"), around(i).alias("near")))
    hits = looked.select("row", F.explode(hits).alias("hit")).select("row", "hit.*")
    votes = (
        hits.join(F.broadcast(postings), "word")
        .select("row", "template", "label", (F.col("at") - F.col("place")).alias("start"), "words", "keys", F.slice("near", F.lit(reach + 1) - F.col("place"), F.size("words")).alias("laid"))
        .groupBy("row", "template", "start")
        .agg(F.count(F.lit(1)).alias("votes"), *(F.first(c).alias(c) for c in ("label", "words", "keys", "laid")))
    )
    covered = F.size(F.filter(F.zip_with("words", "laid", lambda a, b: a.eqNullSafe(b)), lambda x: x)) / F.size("words")
    keyed = F.forall("keys", lambda k: F.slice("laid", k["at"] + 1, k["n"]) == F.slice("words", k["at"] + 1, k["n"]))
    found = (
        votes.filter((F.col("votes") == ANCHORS) & keyed)
        .withColumn("covered", covered)
        .filter(F.col("covered") >= least_covered)
        .groupBy("row")
        .agg(F.collect_set("label").alias("found"), F.max("covered").alias("score"), F.array_sort(F.collect_list(F.struct("label", F.col("start").alias("first_word"), "covered"))).alias("matches"))
    )

    none = F.array().cast("array<string>")
    at_base, of_method = F.coalesce("base", none), F.coalesce("found", none)
    out = files.select("row", "doc_id", "n_words").join(base, "row", "left").join(found, "row", "left")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
        "first_word",
        "last_word",
        F.array_join(F.array_sort(at_base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(at_base, of_method)), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        "matches",
    )


def sql(documents: str = "documents", least_covered: float = LEAST_COVERED) -> str:
    """The same as `scan`, but for its matches, over a table of documents in DuckDB's SQL. It has no index:
    wherever the first word of a template's first key phrase stands, the template is laid."""
    words, first, keys = [], [], []
    for t, (label, template, phrases) in enumerate(TEMPLATES):
        cut = template.split()
        spans = [next(i for i in range(len(cut)) if cut[i : i + len(p.split())] == p.split()) for p in phrases]
        keyed = {i for at, p in zip(spans, phrases) for i in range(at, at + len(p.split()))}
        words += [f"({t}, {i}, '{w}', {i in keyed})" for i, w in enumerate(cut)]
        first.append(f"({t}, '{label}', {spans[0]}, '{cut[spans[0]]}', {len(cut)}, {len(keyed)})")
    places = " UNION ALL ".join(
        f"SELECT a.r, a.i AS start, '{label}' AS label FROM w a "
        + " ".join(f"JOIN w w{j} ON w{j}.r = a.r AND w{j}.i = a.i + {j} AND w{j}.word = '{x}'" for j, x in enumerate(phrase.split()) if j)
        + f" WHERE a.word = '{phrase.split()[0]}'"
        for phrase, label in PHRASES.items()
    )
    return (
        f"WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM {documents}), "
        "w AS MATERIALIZED (SELECT r, i - 1 AS i, words[i] AS word FROM d, unnest(range(1, len(words) + 1)) AS u(i)), "
        f"t(template, place, word, keyed) AS (VALUES {', '.join(words)}), k(template, label, place, word, size, n_keyed) AS (VALUES {', '.join(first)}), "
        f"p AS ({places}), "
        "base AS (SELECT r, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list_distinct(list(label)) AS labels FROM p GROUP BY r), "
        "tried AS (SELECT w.r, k.template, k.label, k.size, k.n_keyed, w.i - k.place AS start FROM w JOIN k ON k.word = w.word), "
        "laid AS (SELECT x.r, x.template, x.start, any_value(x.label) AS label, any_value(x.size) AS size, any_value(x.n_keyed) AS n_keyed, count(*) AS equal, count(*) FILTER (t.keyed) AS keyed "
        "FROM tried x JOIN t ON t.template = x.template JOIN w ON w.r = x.r AND w.i = x.start + t.place AND w.word = t.word GROUP BY x.r, x.template, x.start), "
        f"found AS (SELECT r, list_distinct(list(label)) AS labels, max(equal / size::DOUBLE) AS score FROM laid WHERE equal / size::DOUBLE >= {least_covered} AND keyed = n_keyed GROUP BY r) "
        "SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels, "
        "array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ',') AS labels, coalesce(score, 0.0) AS score FROM d LEFT JOIN base ON base.r = d.r LEFT JOIN found ON found.r = d.r"
    )

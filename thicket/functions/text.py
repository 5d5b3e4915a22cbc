"""Words and full-text terms as expressions.

`words` are what `match` compares: lower-cased pieces between white space. `terms` are what an index
holds: lower-cased runs of letters and digits of more than one byte.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .values import all_of


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: F.octet_length(t) > 1)


def query_words(query: str) -> list[str]:
    return query.lower().split()


def query_terms(query: str) -> list[str]:
    found = (t for t in re.split(r"[\W_]+", query.lower()) if len(t.encode()) > 1)
    return list(dict.fromkeys(found))


def match(text: Column, query: str) -> Column:
    """Every word of the query is a word of the text; an empty query matches."""
    there = words(text)
    return text.isNotNull() & all_of([F.array_contains(there, w) for w in query_words(query)])


def match_prefix(text: Column, query: str) -> Column:
    """Every word of the query begins some word of the text."""
    there = words(text)
    return text.isNotNull() & all_of([_begins(there, w) for w in query_words(query)])


def _begins(there: Column, start: str) -> Column:
    return F.exists(there, lambda w: w.startswith(start))


def search(df: DataFrame, field: str, query: str, prefix: bool = False) -> DataFrame:
    """Rows that hold every term of the query; no row if it has no term."""
    asked = query_terms(query)
    if not asked:
        return df.limit(0)
    there = terms(F.col(field))
    return df.filter(all_of([_begins(there, t) if prefix else F.array_contains(there, t) for t in asked]))


def document_frequency(df: DataFrame, field: str) -> DataFrame:
    """(term, df): in how many rows each term occurs."""
    each = df.select(F.explode(F.array_distinct(terms(F.col(field)))).alias("term"))
    return each.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def postings(df: DataFrame, field: str) -> DataFrame:
    """(term, id, tf): a table to write, clustered by term, where searches recur."""
    each = df.select("id", F.explode(terms(F.col(field))).alias("term"))
    return each.groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"))


def search_postings(table: DataFrame, query: str) -> DataFrame:
    """The ids that hold every term of the query, from a table of postings."""
    asked = query_terms(query)
    hits = table.filter(F.col("term").isin(asked)).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return hits.filter(F.col("n") == len(asked)).select("id") if asked else table.select("id").limit(0)

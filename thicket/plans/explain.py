"""What a query's physical plan does, read from its formatted text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def report(df: DataFrame) -> dict:
    """pushed: filters that reach the scans; columns: those read; exchanges, codegen spans and Python
    steps: how many the plan has."""
    text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    plan = text.split("\n\n")[0]
    return {
        "pushed": re.findall(r"PushedFilters: (\[.*\])", text),
        "columns": re.findall(r"ReadSchema: (.*)", text),
        "exchanges": len(re.findall(r"\bExchange\b", plan)),
        "broadcasts": len(re.findall(r"\bBroadcastExchange\b", plan)),
        "python": len(re.findall(r"Python|Pandas|Arrow", plan)),
        "text": text,
    }

"""Every registered engine query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from thicket.plans import queries as engine

SQL = engine.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        at = f + "/*.parquet" if os.path.isdir(f) else f
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{at}'")
    return c


def rows(df):
    df = df.reindex(sorted(df.columns), axis=1)
    return sorted(tuple("NULL" if not hasattr(x, "__len__") and pd.isna(x) else repr(x.tolist() if hasattr(x, "tolist") else x) for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(engine.queries()))
def test_query(spark, duck, sf_dir, name):
    got = engine.queries()[name](spark, sf_dir).toPandas()
    if name in SQL:
        want = duck.sql(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got) > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())

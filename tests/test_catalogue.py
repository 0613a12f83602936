"""Every query with SQL beside it gives the same rows as that SQL on the same files."""

import math
import sys

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUERIES, ORACLES = entries.queries(), entries.oracle_sql()


@pytest.fixture(scope="session")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(value):
    if value is None or value is pd.NA or value is pd.NaT:
        return None
    if isinstance(value, (float, np.floating)):
        return None if math.isnan(value) else round(float(value), 6) + 0.0
    return value.item() if isinstance(value, np.generic) else value


def content(df):
    names = sorted(df.columns)
    rows = [tuple(plain(v) for v in r) for r in df[names].itertuples(index=False)]
    return names, sorted(rows, key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, small, duck, name):
    found = content(QUERIES[name](spark, small).toPandas())
    assert found == content(duck.execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entries.entry(spark).first()["overall_quality_score"] > 0
    assert "catalogue" in sys.modules

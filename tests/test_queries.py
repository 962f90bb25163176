"""Every query with SQL gives what DuckDB gives; the others give rows."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from quillstone.plans import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if hasattr(v, "tolist") and not isinstance(v, str):
        v = v.tolist()
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    return (int(v) if v == int(v) and abs(v) < 1e15 else round(v, 9)) if isinstance(v, float) else v


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(str([plain(v) for v in row]) for row in df[columns].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(SQL))
def test_as_duckdb(spark, duck, sf_dir, name):
    assert rows(QUERIES[name](spark, sf_dir).toPandas()) == rows(duck.sql(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

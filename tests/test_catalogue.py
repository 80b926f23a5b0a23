"""Every query with SQL gives DuckDB's rows."""

import math

import duckdb
import pandas as pd
import pytest

from quarry.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if not isinstance(value, list | dict) and pd.isna(value):
        return ""
    return f"{value:.6g}" if isinstance(value, float) and math.isfinite(value) else str(value)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_matches_sql(spark, duck, sf_dir, name):
    got, expected = catalogue.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_runs(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0

"""Every published query against its oracle, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.QUERIES, entry.ORACLES


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _text(value) -> str:
    if value is None or (not isinstance(value, str) and pd.isna(value)):
        return "NULL"
    if isinstance(value, pd.Timestamp):
        return str(value)
    if hasattr(value, "dtype") or isinstance(value, (int, float)):
        return str(bool(value)) if str(getattr(value, "dtype", "")) == "bool" else repr(float(value) + 0.0)
    return str(value)


def _rows(frame: pd.DataFrame) -> list:
    columns = sorted(frame.columns)
    return sorted(tuple(_text(v) for v in row) for row in frame[columns].itertuples(index=False))


def test_each_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    expected = con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert _rows(got) == _rows(expected)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0

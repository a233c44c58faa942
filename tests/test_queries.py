"""Registered queries against their SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__

SMALL = "/root/testdata/sf0.001"
QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()
#: Those with SQL of the operators for training data run here too where they are installed.
NAMED = [n for n in QUERIES if n != "pipeline" and not (n.startswith("op") and n not in SQL)]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SMALL):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SMALL}/{name}')")
    return con


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
        return None
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return bool(value)
    if isinstance(value, str | pd.Timestamp):
        return str(value)
    return round(float(value), 6)


def rows(frame: pd.DataFrame) -> list[str]:
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(str(tuple(plain(v) for v in row)) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", NAMED)
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    if name not in SQL:
        assert len(got) > 0
        return
    want = duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_ann_recall(spark):
    assert QUERIES["ann_recall"](spark, "/root/testdata/sf0.01").first().mean_recall >= 0.9

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import SparkSession

from tidepanel.plans.catalogue import ORACLE_SQL, QUERIES, flagship

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck() -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def plain(v: object) -> object:
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "year"):
        return str(v)[:10]
    if isinstance(v, str):
        return v
    return round(float(v), 9) + 0.0


def rows(df: pd.DataFrame) -> list[tuple]:
    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark: SparkSession, duck: duckdb.DuckDBPyConnection, name: str) -> None:
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_flagship_has_rows(spark: SparkSession) -> None:
    assert flagship(spark, SF).count() > 0


def test_every_query_has_sql() -> None:
    assert set(QUERIES) == set(ORACLE_SQL)

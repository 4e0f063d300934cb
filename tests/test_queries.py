"""Every registered core query with SQL against DuckDB on sf0.001, by values."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from tidemark.plans import catalogue

D = "/root/testdata/sf0.001"
SQL = catalogue.oracle_sql()


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)].astype(object)
    df = df.where(df.notna(), None)

    def norm(v):
        if v is None:
            return ""
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)) or type(v).__module__ == "numpy":
            return f"{float(v):.5f}"
        return str(pd.Timestamp(v)) if hasattr(v, "isoformat") else str(v)

    return sorted(tuple(map(norm, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{D}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    got, want = catalogue.queries()[name](spark, D).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, D).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_overlay_has_every_episode(spark):
    got = catalogue.queries()["validity_overlay"](spark, D)
    assert got.where("episode_id >= 200").count() > 0

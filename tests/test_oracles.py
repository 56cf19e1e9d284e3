"""Every query that has SQL gives the rows that DuckDB gives, with the same columns and types."""

import glob
import os

import duckdb
import pytest

from nearframe.plans.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, sf, duck, name):
    mine = QUERIES[name](spark, sf).toPandas()
    want = duck.sql(ORACLES[name]).fetchdf()
    columns = sorted(want.columns)
    assert sorted(mine.columns) == columns
    key = lambda df: sorted(map(tuple, df[columns].astype(object).values.tolist()), key=repr)
    assert len(mine) == len(want) and key(mine) == key(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0

"""Every query of the engine against DuckDB on the smallest tables."""

import importlib

import duckdb
import pytest

from listforge.plans import catalogue

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(str(tuple(None if v is None else int(v) if isinstance(v, (bool, float)) and v == int(v) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, D)
    names = sorted(df.columns)
    found = duck.execute(f"SELECT {', '.join(names)} FROM ({catalogue.ORACLE_SQL[name]})").fetchall()
    assert plain(map(tuple, df.select(names).collect())) == plain(found)


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

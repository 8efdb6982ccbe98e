"""Where queries are registered, with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..config import Settings
from . import adapter as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
S: Settings = A.SETTINGS


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def values(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    return spark.createDataFrame(rows, names)


def sql_values(rows: list[tuple], names: str) -> str:
    def lit(x):
        return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") v({names})"

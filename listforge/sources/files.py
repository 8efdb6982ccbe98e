"""Stored tables: CSV as people read it, Parquet snapshots, evolution by column name, reports."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import strings


def read_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A CSV table with a header, quoted line feeds and doubled quotes; empty fields are empty texts."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', enforceSchema=False)
    return by_name(df, columns)


def write_csv(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.csv(path, header=True, escape='"', quoteAll=True, mode=mode, emptyValue="")


def by_name(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exactly these columns in this order: kept by name, blank where there was none, others dropped."""
    return df.select(*[(F.coalesce(F.col(c), F.lit("")) if dict(df.dtypes)[c] == "string" else F.col(c)).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns])


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


class Snapshots:
    """A table of whole snapshots under one folder. The newest complete one counts; a reader never sees half of one.

    This is what a keyed update needs without a lakehouse format: read, change, write a new snapshot, drop the old.
    """

    def __init__(self, spark: SparkSession, base: str, columns: Sequence[str]):
        self.spark, self.base, self.columns = spark, base.rstrip("/"), tuple(columns)

    def _all(self) -> list[str]:
        fs, p = _fs(self.spark, self.base)
        if not fs.exists(p):
            return []
        done = [s.getPath().toString() for s in fs.listStatus(p) if exists(self.spark, s.getPath().toString() + "/_SUCCESS")]
        return sorted(done, key=lambda x: x.rsplit("/", 1)[1])

    def read(self) -> DataFrame:
        """The current rows and row_idx, their order; none if nothing was written yet. Columns come by name, so that older
        snapshots still fit."""
        found = self._all()
        return with_order(self.spark.read.parquet(found[-1]), self.columns) if found else self.spark.createDataFrame([], strings(self.columns).add("row_idx", "long"))

    def replace(self, df: DataFrame, keep: int = 2) -> None:
        found = self._all()
        number = int(found[-1].rsplit("/", 1)[1].split("-")[0]) + 1 if found else 0
        kept = (*self.columns, "row_idx") if "row_idx" in df.columns else self.columns
        df.select(*kept).write.parquet(f"{self.base}/{number:09d}-{uuid.uuid4().hex}")
        for old in self._all()[:-keep]:
            fs, p = _fs(self.spark, old)
            fs.delete(p, True)


def append_ordered(df: DataFrame, path: str, columns: Sequence[str], order: str = "row_idx") -> None:
    """Append rows with their order of arrival: `row_idx` goes on from the largest that the table has.

    Order among the new rows is that of the column `order`, whole numbers from 0. One writer at a time, as with a file.
    """
    spark = df.sparkSession
    base = 0
    if exists(spark, path):
        last = read_ordered(spark, path, columns).agg(F.max("row_idx").alias("m")).first()["m"]
        base = 0 if last is None or last < 0 else last + 1
    placed = (F.col(order).cast("long") + base).alias("row_idx")
    rows = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns], placed)
    rows.write.mode("append").parquet(path)


def read_ordered(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """The table's columns and row_idx, its order of arrival. Rows stored without one come first, in the order of reading."""
    if not exists(spark, path):
        return spark.createDataFrame([], strings(columns).add("row_idx", "long"))
    return with_order(spark.read.option("mergeSchema", "true").parquet(path), columns)


def with_order(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    read = F.monotonically_increasing_id() - F.lit(1 << 62)
    order = F.coalesce(F.col("row_idx"), read) if "row_idx" in rows.columns else read
    return by_name(rows.withColumn("row_idx", order), (*columns, "row_idx"))


def dump_first_pages(found: DataFrame, folder: str) -> None:
    """The markup of the first page of each query as text, one folder a query, to look at when no card is found."""
    first = found.groupBy("query").agg(F.min_by("raw", F.struct("page", "pos")).alias("raw"))
    first.write.mode("overwrite").partitionBy("query").text(folder)


def append(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Append rows to a Parquet table; columns that the table has more or less of are matched by name on reading."""
    by_name(df, columns).write.mode("append").parquet(path)


def read_table(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], strings(columns))
    return by_name(spark.read.option("mergeSchema", "true").parquet(path), columns)


def unique_name(spark: SparkSession, folder: str, base: str) -> str:
    """folder/base.md, or base_2.md, base_3.md, ... if there is one."""
    n, path = 2, f"{folder}/{base}.md"
    while exists(spark, path):
        path, n = f"{folder}/{base}_{n}.md", n + 1
    return path


def write_text(spark: SparkSession, path: str, content: str) -> None:
    """A small text file, through Spark's own file systems."""
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(content.encode("utf-8")))
    out.close()

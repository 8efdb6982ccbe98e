"""Joins by time: the last row before a moment, and rows whose span holds a moment. Neither pairs all rows with all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: Column, order: str, bucket: Callable[[Column], Column]) -> DataFrame:
    """left with `found`: the value of that row of right which is the last of the same key at or before its time.

    Both have key and time; order tells apart rows of right at one moment, the largest of which counts. found is null
    where there is no earlier row, or where key or time is null. bucket maps a time to an ordered stretch of time (a day,
    an hour) that is short enough for one task to sort what a key has in it: rows are united by key and stretch, and from
    one stretch to the next goes nothing but each key's last value, so that a key with a third of all rows is divided.
    """
    names = left.columns
    own = left.select(F.col(key).alias("_k"), F.col(time).alias("_t"), F.struct(*names).alias("_l"))
    there = right.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).alias("_k"), F.col(time).alias("_t"), F.col(order).alias("_o"), F.struct(value.alias("v")).alias("_v"))
    both = there.withColumn("_l", F.lit(None).cast(own.schema["_l"].dataType)).unionByName(own.withColumns({"_o": F.lit(None).cast(there.schema["_o"].dataType), "_v": F.lit(None).cast(there.schema["_v"].dataType)}))
    both = both.withColumn("_b", bucket(F.col("_t")))
    # At one moment rows of right come first.
    within = Window.partitionBy("_k", "_b").orderBy("_t", F.col("_l").isNotNull(), "_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = both.withColumn("_v", F.last("_v", ignorenulls=True).over(within)).where("_l is not null")
    lasts = both.groupBy("_k", "_b").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct("_t", "_o"))).alias("_last"))
    before = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    lasts = lasts.withColumn("_last", F.last("_last", ignorenulls=True).over(before)).where("_last is not null")
    out = here.join(lasts, ["_k", "_b"], "left")
    known = F.when(F.col("_l")[key].isNotNull() & F.col("_l")[time].isNotNull(), F.coalesce("_v", "_last"))
    return out.select(*[F.col("_l")[n].alias(n) for n in names], known["v"].alias("found"))


def within(points: DataFrame, spans: DataFrame, point: str, start: str, end: str, unit: int = 1) -> DataFrame:
    """Pairs of a point and a span with start <= point <= end, all whole numbers: the columns of both.

    A span lies in the cells of a grid whose width is a power of two, at least its own length (and unit): in one or two
    of them. Points are asked in the cell of each width that spans really have, at most 64 of them, so that a few very
    long spans don't multiply, and short ones don't meet far points. The join is on width and cell, and the ends are
    compared exactly. Spans that end before they start, or have a null end, hold nothing.
    """
    length = F.greatest(F.col(end) - F.col(start) + 1, F.lit(unit)).cast("long")
    width = F.when(length == 1, 0).otherwise(F.length(F.bin(length - 1)))
    kept = spans.where(F.col(start) <= F.col(end)).withColumn("_w", width)
    cell = lambda c: F.expr(f"shiftright(cast({c} AS bigint), _w)")
    kept = kept.withColumn("_c", F.explode(F.sequence(cell(f"`{start}`"), cell(f"`{end}`"))))
    # The driver gets the widths that there are, at most 64 numbers whatever the input.
    widths = sorted(r["_w"] for r in kept.select("_w").distinct().collect())
    each = F.explode(F.array(*[F.lit(w) for w in widths]) if widths else F.array().cast("array<int>"))
    asked = points.where(F.col(point).isNotNull()).withColumn("_w", each).withColumn("_c", cell(f"`{point}`"))
    return asked.join(kept, ["_w", "_c"]).where((F.col(point) >= F.col(start)) & (F.col(point) <= F.col(end))).drop("_w", "_c")

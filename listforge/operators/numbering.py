"""Numbers in an order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dedup import written

#: The ids that Spark gives the rows of a partition: the partition's number above these bits, the row's place in it below.
PLACE_BITS = 33


def numbered(rows: DataFrame, *order: Column | str, name: str = "n", start: int = 1) -> DataFrame:
    """rows with their numbers in this order, which should tell all rows apart, gapless from `start`.

    Rows are dealt by ranges of the order and sorted within; a partition's numbers begin after those of the ones before
    it. The table is written once, since ranges come from a sample. The driver gets one count a partition and sends the
    sums back, whatever the number of rows.
    """
    there = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    counts = there.groupBy(F.shiftright("_at", PLACE_BITS).alias("_part")).count().orderBy("_part").collect()
    starts, run = [], start
    for part, n in counts:
        starts.append((part, run))
        run += n
    starts = rows.sparkSession.createDataFrame(starts, "_part long, _start long")
    found = there.withColumn("_part", F.shiftright("_at", PLACE_BITS)).join(F.broadcast(starts), "_part")
    return found.withColumn(name, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))).drop("_part", "_at", "_start")

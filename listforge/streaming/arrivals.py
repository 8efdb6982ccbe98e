"""First arrivals of a stream of teasers, by keyed state: one for each URL, and among those one for each role.

State is kept by key and expires by event time: a teaser counts as published on its date, or on the day of the run where it
states none, and one that is published longer ago than the recency filter allows is late. Late teasers are dropped and
counted by the query's progress, and what a key holds is forgotten once everything that could meet it would be late, so
that the state is bounded by the days that the filter allows.

Both steps are exact for their key. Together they differ from the greedy reader of a batch in one case: a teaser that is
dropped for its role still holds its URL. Needs RocksDB as state store, which is set here.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, StructType, TimestampType

from ..config import Settings
from ..functions import dates, text
from ..operators.dedup import first_per
from ..shipping import ship

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstArrival(StatefulProcessor):
    """The first row of a key, by row_idx within a micro-batch; later ones are dropped until the key expires."""

    def __init__(self, columns: list[str], keep: timedelta):
        self.columns, self.keep = columns, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.since = handle.getValueState("since", StructType([StructField("event", TimestampType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        best = None
        for part in rows:  # all are read, one part at a time
            row = part.loc[[part["row_idx"].idxmin()]]
            best = row if best is None or row["row_idx"].iloc[0] < best["row_idx"].iloc[0] else best
        if best is None or self.since.exists():
            yield pd.DataFrame(columns=self.columns)
            return
        event = best["event"].iloc[0]
        self.since.update((event,))
        self.handle.registerTimer(int(event.timestamp() * 1000) + int(self.keep.total_seconds() * 1000))
        yield best[self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        self.since.clear()
        yield pd.DataFrame(columns=self.columns)

    def close(self) -> None:
        pass


def keyed(teasers: DataFrame, s: Settings) -> DataFrame:
    """teasers with cu, the role's key (the URL where it has none) and event, the day of publishing."""
    cu = text.canonical_url(F.col("url"))
    role = text.role_key(F.col("company"), F.col("title"))
    day = F.coalesce(dates.parse_date(F.col("published_date")), F.lit(s.today))
    rows = teasers.withColumns({"cu": cu, "rk": F.when(role != "", F.concat(F.lit("r "), role)).otherwise(F.concat(F.lit("u "), cu)), "event": day.cast("timestamp")})
    return rows.where(F.col("cu") != "")


def _first(rows: DataFrame, key: str, s: Settings) -> DataFrame:
    """By transformWithState; the key's own state outlives what the watermark lets pass."""
    processor = FirstArrival(rows.columns, timedelta(days=s.max_days_old + 1))
    return rows.groupBy(key).transformWithStateInPandas(processor, rows.schema, "Append", "EventTime", eventTimeColumnName="event")


def first_arrivals(teasers: DataFrame, s: Settings) -> DataFrame:
    """Teasers (row_idx and the columns of schema.TEASER), a stream or a table, without repeated URLs and roles.

    Of a stream, those published max_days_old days before the latest so far are late; the query's progress counts them.
    """
    if not teasers.isStreaming:
        return first_per(first_per(keyed(teasers, s), "cu"), "rk")
    spark = teasers.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = keyed(teasers, s).withWatermark("event", f"{s.max_days_old} days")
    return _first(_first(rows, "cu", s), "rk", s)


def late(query) -> int:
    """How many rows a running or ended query has dropped as late, so far as its progress is kept."""
    return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])

"""Look-ups between listings, the archive and the tracker, all by canonical URL (column cu)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unseen(new: DataFrame, archive: DataFrame) -> DataFrame:
    """New rows whose URL isn't empty and isn't in the archive."""
    return new.where(F.col("cu") != "").join(archive.where(F.col("cu") != "").select("cu"), "cu", "left_anti")


def tracker_status(tracker: DataFrame) -> DataFrame:
    """cu and status of the last tracker row of each URL; an empty status is `tracked`."""
    status = F.lower(F.trim(F.coalesce("status", F.lit(""))))
    last = tracker.where(F.col("cu") != "").groupBy("cu").agg(F.max_by(status, "row_idx").alias("status"))
    return last.withColumn("status", F.when(F.col("status") == "", "tracked").otherwise(F.col("status")))


def with_status(listings: DataFrame, tracker: DataFrame) -> DataFrame:
    """listings with kind (new where the tracker has nothing) and actionable (new or interested)."""
    found = listings.join(tracker_status(tracker), "cu", "left")
    kind = F.coalesce("status", F.lit("new"))
    return found.withColumns({"kind": kind, "actionable": kind.isin("new", "interested")}).drop("status")


def tracked(listings: DataFrame, tracker: DataFrame) -> DataFrame:
    return listings.join(tracker.select("cu"), "cu", "left_semi")


def archive_row(archive: DataFrame, cu: str) -> DataFrame:
    """The best archived row of one URL, the first of equals; no row if there is none."""
    whole = F.struct(*archive.columns)
    best = archive.where(F.col("cu") == cu).agg(F.max_by(whole, F.struct(F.col("score_n"), -F.col("row_idx"))).alias("b"))
    return best.where("b is not null").select("b.*")


def insert_absent(tracker: DataFrame, new: DataFrame) -> DataFrame:
    """tracker and those new rows whose URL it doesn't have."""
    return tracker.unionByName(new.join(tracker.select("cu"), "cu", "left_anti").select(*tracker.columns))


def update_status(tracker: DataFrame, cu: str, status: str) -> DataFrame:
    """tracker with the status of every row of one URL replaced."""
    return tracker.withColumn("status", F.when(F.col("cu") == cu, F.lit(status)).otherwise(F.col("status")))

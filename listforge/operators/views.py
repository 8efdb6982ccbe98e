"""Views over the archive. Archive rows carry row_idx, cu (canonical URL) and score_n (score as a number)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import dates, text
from . import filters, numbering
from .dedup import best_per_url


def keyed(archive: DataFrame) -> DataFrame:
    """archive with cu and score_n, computed once."""
    return archive.withColumns({"cu": text.canonical_url(F.col("url")), "score_n": filters.score_of(F.col("score"))})


def shortlist_rows(archive: DataFrame, s: Settings) -> DataFrame:
    """Open matches with days_left and first_idx, in no order. The best row of a URL stands for it before any filter."""
    best = best_per_url(archive)
    keep = (F.col("score_n") >= s.score_threshold) & filters.accepted_type(archive, s)
    if s.require_commutable:
        keep &= filters.commutable(archive)
    if s.exclude_language_required:
        keep &= ~filters.language_required(archive)
    return best.where(keep & filters.open_listing(s)).withColumn("days_left", dates.days_left(F.col("deadline"), s.today))


def urgency() -> list:
    return [F.col("days_left").asc_nulls_last(), F.col("score_n").desc(), F.col("first_idx")]


def open_shortlist(archive: DataFrame, s: Settings) -> DataFrame:
    """Open matches, the soonest deadline first, then the best score, then as they first appeared."""
    return shortlist_rows(archive, s).orderBy(*urgency())


def numbered(shortlist: DataFrame) -> DataFrame:
    """The shortlist with its numbers, which every view of it keeps."""
    return numbering.numbered(shortlist, *urgency())


def matches(archive: DataFrame, s: Settings):
    """The analysis' own idea of a match: no URL de-duplication and no language filter."""
    return in_target(archive, s) & filters.open_listing(s)


def in_target(archive: DataFrame, s: Settings):
    return (F.col("score_n") >= s.score_threshold) & filters.accepted_type(archive, s) & filters.commutable(archive)


def console_matches(scored: DataFrame, s: Settings) -> DataFrame:
    """What a run prints: score and type alone."""
    return scored.where((F.col("score_n") >= s.score_threshold) & filters.accepted_type(scored, s))

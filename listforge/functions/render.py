"""Column functions for lines of text that people read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import parse_date
from .text import blank


def padded(c: Column, n: int) -> Column:
    """At least n characters, filled at the right; rpad would cut."""
    return F.concat(c, F.repeat(F.lit(" "), F.greatest(F.lit(n) - F.length(c), F.lit(0))))


def padded_left(c: Column, n: int) -> Column:
    return F.concat(F.repeat(F.lit(" "), F.greatest(F.lit(n) - F.length(c), F.lit(0))), c)


def valid_deadline() -> Column:
    return F.when(parse_date(F.col("deadline")).isNotNull(), F.col("deadline"))


def meta_line() -> Column:
    """Type, work mode, place, language and deadline of a listing, as far as known. Needs days_left."""
    known = lambda c, *no: F.when(~blank(c).isin("", *no), c)
    lvl, dl, days = F.lower(blank(F.col("danish_level"))), valid_deadline(), F.col("days_left")
    place = F.when(~F.upper(blank(F.col("location"))).isin("", "N/A"), F.col("location"))
    due = F.when(dl.isNotNull() & (days <= 0), F.concat(F.lit("⏰ closes today ("), dl, F.lit(")")))
    due = due.when(dl.isNotNull() & (days <= 7), F.concat(F.lit("⏰ closes in "), days.cast("string"), F.lit("d ("), dl, F.lit(")")))
    due = due.when(dl.isNotNull() & days.isNotNull(), F.concat(F.lit("deadline "), dl, F.lit(" ("), days.cast("string"), F.lit("d)")))
    due = due.when(dl.isNotNull(), F.concat(F.lit("deadline "), dl))
    language = F.when(lvl == "required", "⚠ Danish required").when(lvl == "preferred", "Danish a plus")
    return F.concat_ws(" · ", known(F.col("employment_type"), "unknown"), known(F.col("work_mode"), "unknown"), place, language, due)


def badge() -> Column:
    lane = F.when(F.col("track") == "A", "Technical").otherwise("Foot-in-door")
    return F.concat(lane, F.when(F.col("source") == "snippet", " · ⚠ teaser only").otherwise(""))


def when_phrase() -> Column:
    """closes in Nd, else no deadline. Needs days_left."""
    return F.when(F.col("days_left").isNotNull(), F.concat(F.lit("closes in "), F.col("days_left").cast("string"), F.lit("d"))).otherwise(F.coalesce(valid_deadline(), F.lit("no deadline")))


def row_line() -> Column:
    """One line of a report: score, track, type, company, title and flags."""
    lvl = F.lower(F.trim(blank(F.col("danish_level"))))
    flags = F.concat_ws(", ", F.when(lvl == "required", "DK req").when(lvl == "preferred", "DK plus"), F.concat(F.lit("due "), valid_deadline()), F.when(F.col("source") == "snippet", "teaser-only"))
    tag = F.when(flags != "", F.concat(F.lit("  ["), flags, F.lit("]"))).otherwise("")
    return F.concat(F.lit("  "), padded_left(F.col("score_n").cast("string"), 3), F.lit("  "), padded(blank(F.col("track")), 4), F.lit(" "), padded(blank(F.col("employment_type")), 10), F.lit(" "), padded(F.substring(blank(F.col("company")), 1, 22), 22), F.lit(" "), F.substring(blank(F.col("title")), 1, 54), tag)

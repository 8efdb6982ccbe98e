"""Column functions on dates. Today is always passed in."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, stripped

# Danish months.
MONTHS = ("januar", "februar", "marts", "april", "maj", "juni", "juli", "august", "september", "oktober", "november", "december")
DEADLINE = r"(?iU)(?:ans[øo]gningsfrist|frist|deadline)[:\s]*(\d{1,2})[.\s/-]\s*(\d{1,2}|\w+)[.\s/-]\s*(\d{2,4})"


def parse_date(c: Column) -> Column:
    """A date from the first ten characters, yyyy-MM-dd; null for anything else."""
    s = F.substring(stripped(blank(c)), 1, 10)
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(s, "yyyy-MM-dd"))


def is_recent(c: Column, today: date, max_days: int) -> Column:
    """False only for a known date before the cutoff; unknown dates stay."""
    return F.coalesce(parse_date(c) >= F.date_sub(F.lit(today), max_days), F.lit(True))


def is_open(deadline: Column, seen: Column, today: date, fresh_days: int) -> Column:
    """By deadline if there is one, else by when it was seen, else open."""
    dl, at = parse_date(deadline), parse_date(seen)
    return F.when(dl.isNotNull(), dl >= F.lit(today)).when(at.isNotNull(), F.datediff(F.lit(today), at) <= fresh_days).otherwise(F.lit(True))


def days_left(deadline: Column, today: date) -> Column:
    return F.datediff(parse_date(deadline), F.lit(today))


def deadline_passed(text: Column, today: date) -> Column:
    """Whether the first deadline that the text states is before today; false if none can be read."""
    t = blank(text)
    day, month, year = (F.regexp_extract(t, DEADLINE, i) for i in (1, 2, 3))
    by_name = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(month)).cast("int")
    number = F.coalesce(F.when(month.rlike(r"^\d{1,2}$"), month.try_cast("int")), by_name)
    y = year.try_cast("int")
    y = F.when(y < 100, y + 2000).otherwise(y)
    found = F.try_to_date(F.format_string("%04d-%02d-%02d", y, number, day.try_cast("int")), "yyyy-MM-dd")
    return F.coalesce((day != "") & (number > 0) & (found < F.lit(today)), F.lit(False))

"""Predicates over teasers and scored listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import dates, jsonx, text


def passes_keywords(title: Column, snippet: Column, s: Settings) -> Column:
    """A wanted term in title or snippet, none unwanted in the title. Terms match as parts; padding lets them match at ends."""
    both = F.lower(F.concat(F.lit(" "), text.blank(title), F.lit(" "), text.blank(snippet), F.lit(" ")))
    return text.any_in(both, s.include_terms) & ~unwanted_title(title, s)


def unwanted_title(title: Column, s: Settings) -> Column:
    return text.any_in(F.lower(F.concat(F.lit(" "), text.blank(title), F.lit(" "))), s.exclude_terms)


def passes_source_policy(site: Column, title: Column, snippet: Column, s: Settings) -> Column:
    """Listings of the API source were searched for already: only the title counts there."""
    return F.when(site == "hub", ~unwanted_title(title, s)).otherwise(passes_keywords(title, snippet, s))


def excluded_company(company: Column, s: Settings) -> Column:
    return text.any_in(F.lower(text.blank(company)), s.excluded_companies)


def score_of(raw: Column) -> Column:
    """A stored score as a number; what isn't a whole number is 0."""
    return F.coalesce(raw.try_cast("int"), F.lit(0))


def column_or(df: DataFrame, name: str, default: str) -> Column:
    """The column, null as empty; the default only where there is no such column."""
    return text.blank(F.col(name)) if name in df.columns else F.lit(default)


def accepted_type(df: DataFrame, s: Settings) -> Column:
    return column_or(df, "employment_type", "unknown").isin(*s.accepted_types)


def commutable(df: DataFrame) -> Column:
    return F.lower(column_or(df, "commute_ok", "true")) != "false"


def language_required(df: DataFrame) -> Column:
    return F.lower(column_or(df, "danish_level", "")) == "required"


def open_listing(s: Settings) -> Column:
    return dates.is_open(F.col("deadline"), F.col("scraped_date"), s.today, s.fresh_days)


def without_errors(scored: DataFrame) -> DataFrame:
    """Scored rows whose scoring didn't fail."""
    return scored.where(F.coalesce(F.col("reasoning") != jsonx.ERROR, F.lit(True)))


def gate(s: Settings, body: str = "body", detected: Column | None = None) -> Column:
    """Why a fetched row goes: `deadline` if the one that its page states has passed, then `danish` if it is in Danish alone
    (where asked for); null if it stays."""
    late = (F.col("source") == "full") & dates.deadline_passed(F.col(body), s.today)
    why = F.when(late, "deadline")
    return why.when(text.looks_danish(F.col(body), detected), "danish") if s.drop_foreign_language else why


def gated(df: DataFrame, s: Settings, body: str = "body", detected: Column | None = None) -> DataFrame:
    """Fetched rows that no gate drops."""
    return df.where(gate(s, body, detected).isNull())


def bodies_last(has_body: Column, order: Column, n: int) -> Column:
    """The order in which a run works on teasers (order from 0 to under n): first those that have to be fetched, then those
    whose source gave the body, both as they arrived."""
    return order.cast("long") + F.when(has_body, F.lit(n)).otherwise(F.lit(0)).cast("long")

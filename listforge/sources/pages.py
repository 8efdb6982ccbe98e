"""Teasers from web pages: cards of a result page, or pages themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SNIPPET_CAP, decoded, search_url, stripped


def grid(spark: SparkSession, queries, max_pages: int, base: str) -> DataFrame:
    """query, page and url of every result page to read."""
    rows = spark.createDataFrame([(q,) for q in queries], "query string")
    return rows.select("query", F.explode(F.sequence(F.lit(1), F.lit(max_pages))).alias("page")).withColumn("url", search_url(base, F.col("query"), F.col("page")))


def flat(html: Column) -> Column:
    """Markup as one line of text."""
    return stripped(F.regexp_replace(decoded(F.regexp_replace(html, "<[^>]+>", " ")), r"\s+", " "))


def paragraphs(html: Column) -> Column:
    """The text of all paragraphs, joined by spaces and cut."""
    parts = F.filter(F.transform(F.regexp_extract_all(html, F.lit(r"(?s)<p>(.*?)</p>"), F.lit(1)), flat), lambda p: p != "")
    return F.substring(F.array_join(parts, " "), 1, SNIPPET_CAP)


def page_teasers(pages: DataFrame) -> DataFrame:
    """A teaser from each page with a title and a URL."""
    out = pages.select("page_id", flat(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)).alias("title"), *[F.lit("N/A").alias(n) for n in ("company", "location", "published_date")], paragraphs(F.col("html")).alias("snippet"), "url", F.lit("board").alias("source_site"))
    return out.where("title <> '' and url <> ''")


def _flat_sql(c: str) -> str:
    out = f"regexp_replace({c}, '<[^>]+>', ' ', 'g')"
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        out = f"replace({out}, '{a}', '{b}')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


TITLE_SQL = _flat_sql("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")
SNIPPET_SQL = f"substr(array_to_string(list_filter(list_transform(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1), lambda p: {_flat_sql('p')}), lambda p: p <> ''), ' '), 1, 500)"

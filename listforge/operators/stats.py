"""Aggregates of the analysis report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Settings
from ..functions.text import bar, blank
from . import filters, views

BUCKETS = ("85-100", "75-84", "50-74", "0-49")


def bucket(score: Column) -> Column:
    return F.when(score >= 85, "85-100").when(score >= 75, "75-84").when(score >= 50, "50-74").otherwise("0-49")


def distribution(df: DataFrame, value: Column, domain) -> DataFrame:
    """ord, value, n and bar for every value of the domain, 0 where there is none; other values are left out."""
    spark = df.sparkSession
    fixed = spark.createDataFrame([(i, v) for i, v in enumerate(domain)], "ord int, value string")
    counted = df.select(value.alias("value")).where(F.col("value").isin(*domain)).groupBy("value").agg(F.count("*").alias("n"))
    full = fixed.join(F.broadcast(counted), "value", "left").select("ord", "value", F.coalesce("n", F.lit(0)).alias("n"))
    most = full.agg(F.max("n").alias("most"))
    return full.crossJoin(F.broadcast(most)).select("ord", "value", "n", bar(F.col("n"), F.col("most")).alias("bar"))


def by_frequency(df: DataFrame, value: Column) -> DataFrame:
    """value and n, most frequent first, equals as they first appeared."""
    counted = df.select(value.alias("value"), "row_idx").groupBy("value").agg(F.count("*").alias("n"), F.min("row_idx").alias("first_idx"))
    return counted.orderBy(F.desc("n"), "first_idx")


def overview(archive: DataFrame, s: Settings) -> DataFrame:
    """One row of counts: rows, URLs, duplicates, dates, matches, closed ones, and high scores of other types."""
    target, hit = views.in_target(archive, s), views.matches(archive, s)
    date = F.nullif(blank(F.col("scraped_date")), F.lit(""))
    high = F.col("score_n") >= s.score_threshold
    return archive.agg(
        F.count("*").alias("n_rows"), F.countDistinct(blank(F.col("url"))).alias("n_urls"), (F.count("*") - F.countDistinct(blank(F.col("url")))).alias("n_duplicates"),
        F.countDistinct(date).alias("n_dates"), F.min(date).alias("first_date"), F.max(date).alias("last_date"),
        F.count_if(hit).alias("n_matches"), F.count_if(target & ~hit).alias("n_closed"), F.count_if(high & ~target).alias("n_outside"),
    )


def track_split(archive: DataFrame, s: Settings) -> DataFrame:
    hit = views.matches(archive, s)
    return archive.agg(F.count_if(hit & (F.col("track") == "A")).alias("n_a"), F.count_if(hit & (F.col("track") == "B")).alias("n_b"))


def language_rates(archive: DataFrame, s: Settings) -> DataFrame:
    hit = views.matches(archive, s)
    lvl = F.lower(F.trim(blank(F.col("danish_level"))))
    return archive.agg(
        F.count("*").alias("n_rows"), F.count_if(lvl == "required").alias("n_required"), F.count_if(hit).alias("n_matches"),
        F.count_if(hit & (lvl == "required")).alias("n_required_matches"), F.count_if(hit & (lvl == "preferred")).alias("n_preferred_matches"),
    )


def tech_rate(archive: DataFrame, s: Settings) -> DataFrame:
    """How many matches there are, and how many of them at companies that are tech companies."""
    hit = views.matches(archive, s)
    tech = F.lower(F.trim(blank(F.col("is_tech_company")))) == "true"
    return archive.agg(F.count_if(hit).alias("n"), F.count_if(hit & tech).alias("n_true"))


def recurring_companies(archive: DataFrame, s: Settings, least: int = 2, most: int = 15) -> DataFrame:
    """Companies with at least two rows, the most frequent 15, and how many of their rows match."""
    grouped = archive.where(blank(F.col("company")) != "").groupBy("company").agg(F.count("*").alias("n"), F.count_if(views.matches(archive, s)).alias("n_matches"), F.min("row_idx").alias("first_idx"))
    return grouped.where(F.col("n") >= least).orderBy(F.desc("n"), "first_idx").limit(most)


def drift(df: DataFrame, day: Column, score: Column, s: Settings) -> DataFrame:
    """day, rows and rows at the threshold; bar in proportion to the best day. The blank day counts too."""
    by_day = df.groupBy(blank(day).alias("day")).agg(F.count("*").alias("n"), F.count_if(score >= s.score_threshold).alias("n_high"))
    # A window without partitions is one task: it holds one row a day.
    most = F.max("n_high").over(Window.partitionBy())
    return by_day.withColumn("most", most).select("day", "n", "n_high", bar(F.col("n_high"), F.col("most")).alias("bar"))


def outside_targets(archive: DataFrame, s: Settings, most: int = 15) -> DataFrame:
    """High scores that the current targets leave out, the best 15."""
    high = archive.where((F.col("score_n") >= s.score_threshold) & ~F.coalesce(views.in_target(archive, s), F.lit(False)))
    return high.orderBy(F.desc("score_n"), "row_idx").limit(most)


def last_runs(runs: DataFrame, most: int = 10) -> DataFrame:
    """The last runs, in the order in which they were logged."""
    return runs.orderBy(F.desc("row_idx")).limit(most).orderBy("row_idx")


def funnel(teasers: DataFrame, s: Settings) -> DataFrame:
    """Counts by source: teasers, those that pass the prefilter, those with a body of their own."""
    passes = filters.passes_source_policy(F.col("source_site"), F.col("title"), F.col("snippet"), s)
    return teasers.groupBy(F.coalesce("source_site", F.lit("?")).alias("source_site")).agg(F.count("*").alias("n_teasers"), F.count_if(passes).alias("n_prefiltered"), F.count_if(passes & F.col("description").isNotNull()).alias("n_preloaded"))

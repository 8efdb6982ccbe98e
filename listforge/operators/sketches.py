"""Sketches of each run, stored beside its metrics, that merge into statistics of any span of runs without its rows.

Distinct URLs by HyperLogLog (standard error 1.04 / sqrt(2 ** LG_URLS), 0.8 %) and by a theta sketch (which also tells
how many URLs two spans share; exact up to 2 ** LG_THETA URLs, 0.8 % beyond), scores by KLL (rank error at most 1.4 %).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_URLS, LG_THETA, K = 14, 14, 200
KEPT = ("n", "n_scored", "urls", "shared", "scores")


def sketched(rows: DataFrame, run: Column, url: Column, score: Column) -> DataFrame:
    """A row of sketches for each run; partial sketches are made before the shuffle. Null URLs and scores don't count."""
    return rows.groupBy(run.alias("run")).agg(
        F.count("*").alias("n"), F.count(score).alias("n_scored"), F.hll_sketch_agg(url, LG_URLS).alias("urls"),
        F.theta_sketch_agg(url, LG_THETA).alias("shared"), F.kll_sketch_agg_bigint(score.cast("long"), K).alias("scores"),
    )


def merged(sketches: DataFrame, *by: Column | str) -> DataFrame:
    """The sketches of all runs of a group as one row of sketches."""
    return sketches.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("n_scored").alias("n_scored"), F.hll_union_agg("urls").alias("urls"),
        F.theta_union_agg("shared", LG_THETA).alias("shared"), F.kll_merge_agg_bigint("scores", K).alias("scores"),
    )


def estimates(sketches: DataFrame, *quantiles: float) -> DataFrame:
    """n, n_scored, n_urls, n_urls_theta and a column q<percent> for each quantile of the scores."""
    others = [c for c in sketches.columns if c not in KEPT]
    at = {f"q{round(100 * q)}": F.when(F.col("n_scored") > 0, F.kll_sketch_get_quantile_bigint("scores", F.lit(q))) for q in quantiles}
    return sketches.select(*others, "n", "n_scored", F.hll_sketch_estimate("urls").alias("n_urls"), F.theta_sketch_estimate("shared").alias("n_urls_theta"), *[c.alias(k) for k, c in at.items()])


def in_both(one: Column, other: Column) -> Column:
    """How many URLs two theta sketches share, about."""
    return F.theta_sketch_estimate(F.theta_intersection(one, other))

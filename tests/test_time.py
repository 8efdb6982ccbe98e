"""Joins by time and numbering against plain Python; sketches against exact statistics."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from listforge.operators import numbering, sketches, timejoins


def test_as_of(spark):
    rng = random.Random(1)
    left = [(i, rng.choice(["hot", "hot", "b", "c", None]), rng.choice([None, *range(-5, 105)])) for i in range(300)]
    right = [(i, rng.choice(["hot", "hot", "b", None]), rng.choice([None, *range(100)]), rng.choice([None, f"v{i}"])) for i in range(200)]
    by = {}
    for i, k, t, v in sorted((r for r in right if r[1] and r[2] is not None), key=lambda r: (r[2], r[0])):
        by.setdefault(k, []).append((t, i, v))

    def last(k, t):
        found = by.get(k, [])
        at = bisect.bisect_right([x[0] for x in found], t) if k and t is not None else 0
        return found[at - 1][2] if at else None

    lf = spark.createDataFrame([(i, k, t, "x") for i, k, t in left], "i int, k string, t int, found string").drop("found")
    rf = spark.createDataFrame(right, "i int, k string, t int, v string")
    for width in (1, 7, 1000):
        got = timejoins.as_of(lf, rf, "k", "t", F.col("v"), "i", lambda t, w=width: F.floor(t / w)).collect()
        assert sorted((r["i"], r["found"]) for r in got) == [(i, last(k, t)) for i, k, t in left]
    assert all(r["found"] is None for r in timejoins.as_of(lf, rf.where("false"), "k", "t", F.col("v"), "i", lambda t: t).collect())
    assert timejoins.as_of(lf.where("false"), rf, "k", "t", F.col("v"), "i", lambda t: t).count() == 0


def test_a_frequent_key_is_divided(spark):
    """All rows of one key: no task sorts more than what lies in a stretch of time."""
    rows = spark.range(4000).select(F.lit("k").alias("k"), F.col("id").alias("t"), F.col("id").alias("i"), F.col("id").alias("v"))
    plan = timejoins.as_of(rows, rows, "k", "t", F.col("v"), "i", lambda t: F.floor(t / 100))._jdf.queryExecution().executedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [last(" in x]
    assert len(windows) == 2 and sum("_b#" in x.split("windowspecdefinition(")[1].split(" ASC")[0] for x in windows) >= 1
    assert "Nested" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("unit", [1, 16])
def test_within(spark, unit):
    rng = random.Random(2)
    points = [(i, rng.choice([None, *range(-100, 3000)])) for i in range(200)]
    spans = [(i, a := rng.randrange(-50, 3000), a + rng.choice([-1, 0, 0, 1, 5, 31, 32, 33, 500, 2500])) for i in range(300)] + [(900, None, 5), (901, 5, None), (902, -(1 << 40), 1 << 40)]
    got = timejoins.within(spark.createDataFrame(points, "p int, at long"), spark.createDataFrame(spans, "s int, a long, b long"), "at", "a", "b", unit)
    expected = sorted((p, s) for p, at in points for s, a, b in spans if at is not None and a is not None and b is not None and a <= at <= b)
    assert sorted((r["p"], r["s"]) for r in got.collect()) == expected and got.columns == ["p", "at", "s", "a", "b"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ("HashJoin" in plan or "SortMergeJoin" in plan) and "NestedLoop" not in plan and "Cartesian" not in plan
    assert timejoins.within(spark.createDataFrame(points, "p int, at long"), spark.createDataFrame([], "s int, a long, b long"), "at", "a", "b").count() == 0


def test_numbers_without_a_task_that_sees_all(spark):
    rows = spark.range(5000).select(F.pmod(F.xxhash64("id"), F.lit(700)).alias("a"), F.col("id").alias("b")).repartition(6)
    got = numbering.numbered(rows, F.desc("a"), "b", name="place", start=5)
    order = sorted(((r["a"], r["b"], r["place"]) for r in got.collect()), key=lambda r: (-r[0], r[1]))
    assert [r[2] for r in order] == list(range(5, 5005)) and got.columns == ["a", "b", "place"]
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    assert numbering.numbered(rows.where("false"), "b").count() == 0


def test_sketches_merge(spark):
    rows = spark.range(60_000).select((F.col("id") % 30).alias("day"), F.concat(F.lit("u"), F.pmod(F.xxhash64("id"), F.lit(40_000))).alias("cu"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(101)).cast("int").alias("score"))
    rows = rows.unionByName(spark.createDataFrame([(31, None, None)] * 3, "day long, cu string, score int"))
    by_day = sketches.sketched(rows, F.col("day"), F.col("cu"), F.col("score"))
    one = sketches.estimates(sketches.sketched(rows, F.lit(0), F.col("cu"), F.col("score")), 0.1, 0.5, 0.9).first()
    merged = sketches.estimates(sketches.merged(by_day), 0.1, 0.5, 0.9).first()
    exact = rows.agg(F.count_distinct("cu")).first()[0]
    assert (merged["n"], merged["n_scored"]) == (60_003, 60_000) == (one["n"], one["n_scored"])
    for r in (one, merged):  # three standard errors; ranks within 1.4 % of 101 even values, two at most
        assert abs(r["n_urls"] / exact - 1) < 0.025 and abs(r["n_urls_theta"] / exact - 1) < 0.025
        assert abs(r["q10"] - 10) <= 2 and abs(r["q50"] - 50) <= 2 and abs(r["q90"] - 90) <= 2
    assert abs(merged["n_urls"] / one["n_urls"] - 1) < 0.01
    empty = sketches.estimates(by_day.where("run = 31"), 0.5).first()
    assert (empty["n"], empty["n_urls"], empty["q50"]) == (3, 0, None)
    days = {r["run"]: r["shared"] for r in by_day.collect()}
    two = spark.createDataFrame([(days[0], days[1])], "a binary, b binary").select(sketches.in_both(F.col("a"), F.col("b"))).first()[0]
    both = rows.where("day = 0").select("cu").intersect(rows.where("day = 1").select("cu")).count()
    assert two == both  # few enough URLs to be exact

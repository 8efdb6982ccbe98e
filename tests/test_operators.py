import random

import pytest
from pyspark.sql import functions as F

from listforge.operators import dedup, filters, lookups, views
from listforge.plans import adapter


def greedy(rows):
    urls, roles, kept = set(), set(), []
    for i, u, r in rows:
        if not u or u in urls or (r and r in roles):
            continue
        urls.add(u)
        if r:
            roles.add(r)
        kept.append(i)
    return kept


def test_greedy_two_keys(spark):
    rng = random.Random(4)
    cases = [[(0, "1", "x"), (1, "2", "x"), (2, "2", "y")], [(0, "1", "x"), (1, "1", "y"), (2, "3", "y")], [(0, "1", ""), (1, "2", ""), (2, "", "z")], [(i, f"u{rng.randrange(12)}", rng.choice(["", *"abcdefgh"])) for i in range(60)]]
    for rows in cases:
        got = dedup.greedy_two_keys(spark.createDataFrame(rows, "row_idx long, cu string, rk string")).select("row_idx").collect()
        assert sorted(r[0] for r in got) == greedy(rows)


def chain(n):
    """Row i shares its URL with one neighbour and its role with the other: each waits for the one before."""
    return [(i, f"u{(i + 1) // 2}", f"r{i // 2}") for i in range(n)]


@pytest.mark.parametrize(("shape", "reader_rows", "first_rounds"), [("mixed", 40, 1), ("chain", 50, 0), ("chain", 50, 1), ("star", 60, 0), ("no roles", 60, 1)])
def test_greedy_two_keys_divided(spark, shape, reader_rows, first_rounds):
    """Components, and stretches of large ones, give what one reader gives."""
    rng = random.Random(len(shape) + reader_rows)
    if shape == "mixed":
        rows = [(i, f"u{rng.randrange(90)}", rng.choice(["", None, *(f"r{k}" for k in range(90))])) for i in range(200)]
    elif shape == "chain":
        rows = chain(120)
        ids = rng.sample(range(1000), 120) if first_rounds else list(range(120))
        rows = sorted((j, u, r) for j, (_, u, r) in zip(ids, rows, strict=True))
    else:
        rows = [(i, "hub" if i % 3 else f"u{i}", f"r{i % 11}" if shape == "star" else "") for i in range(150)]
    df = spark.createDataFrame(rows, "row_idx long, cu string, rk string")
    got = dedup.greedy_two_keys(df, reader_rows=reader_rows, first_rounds=first_rounds).select("row_idx").collect()
    assert sorted(r[0] for r in got) == greedy(rows)


def test_a_long_chain_takes_few_jobs(spark):
    """10,000 rows, each of which waits for the one before; what jobs there are counts Spark's own for each exchange."""
    df = spark.createDataFrame(chain(10_000), "row_idx long, cu string, rk string")
    sc = spark.sparkContext
    sc.setJobGroup("chain", "chain")
    got = sorted(r[0] for r in dedup.greedy_two_keys(df).select("row_idx").collect())
    jobs = len(sc.statusTracker().getJobIdsForGroup("chain"))
    sc.setJobGroup("other", "other")
    assert got == greedy(chain(10_000)) and jobs <= 20


def test_components(spark):
    rng = random.Random(5)
    rows = [(i, f"u{rng.randrange(150)}", rng.choice(["", *(f"r{k}" for k in range(150))]) or None) for i in range(200)] + [(1000 + i, f"a{u}", f"a{r}") for i, u, r in chain(300)]
    first = {i: i for i, _, _ in rows}
    for _ in rows:
        by = {}
        for i, u, r in rows:
            for k in (("u", u), ("r", r)):
                if k[1] is not None:
                    by[k] = min(by.get(k, i), first[i])
        now = {i: min([by["u", u]] + ([by["r", r]] if r is not None else [])) for i, u, r in rows}
        if now == first:
            break
        first = now
    got = dedup.components(spark.createDataFrame(rows, "i long, u string, r string")).collect()
    assert {r["i"]: r["c"] for r in got} == first


def test_best_per_url(spark):
    rows = [(0, "u", 5), (1, "v", 9), (2, "u", 9), (3, "u", 9), (4, "", 9)]
    got = dedup.best_per_url(spark.createDataFrame(rows, "row_idx long, cu string, score_n int")).orderBy("first_idx").collect()
    assert [(r["cu"], r["row_idx"], r["first_idx"]) for r in got] == [("u", 2, 0), ("v", 1, 1)]


def listing(i, url, score, **more):
    return {"row_idx": i, "url": url, "score": score, "employment_type": "student", "commute_ok": "True", "danish_level": "none", "deadline": "", "scraped_date": "2026-06-14"} | more


def shortlist(spark, settings, rows):
    df = views.keyed(spark.createDataFrame(rows))
    return [r["row_idx"] for r in views.open_shortlist(df, settings).collect()]


def test_best_row_hides_its_siblings(spark, settings):
    rows = [listing(0, "https://a.b/u", "90", employment_type="full_time"), listing(1, "https://www.a.b/u/", "80")]
    assert shortlist(spark, settings, rows) == []


def test_view_filters(spark, settings):
    rows = [listing(i, f"https://a.b/{i}", s) for i, s in enumerate(["74", "75", "", "85.0", " 80 "])]
    rows += [listing(5, "https://a.b/5", "90", employment_type=""), listing(6, "https://a.b/6", "90", commute_ok="false"), listing(7, "https://a.b/7", "90", commute_ok=""), listing(8, "https://a.b/8", "90", danish_level="REQUIRED"), listing(9, "https://a.b/9", "90", danish_level="preferred"), listing(10, "", "99")]
    assert sorted(shortlist(spark, settings, rows)) == [1, 4, 7, 9]


def test_missing_column_is_accepted(spark, settings):
    rows = [{k: v for k, v in listing(0, "https://a.b/1", "80").items() if k != "employment_type"}]
    assert shortlist(spark, settings, rows) == [0]


def test_order(spark, settings):
    rows = [listing(i, f"https://a.b/{i}", s, deadline=d) for i, (d, s) in enumerate([("2026-06-18", "80"), ("2026-06-18", "90"), ("", "99"), ("2026-06-15", "75"), ("", "99")])]
    assert shortlist(spark, settings, rows) == [3, 1, 0, 2, 4]


def test_keywords(spark, settings):
    rows = [("BI", "", True), ("HR Data analyst", "", False), ("Analyst", "hr team", True), ("Storage clerk", "", True), ("Baker", "bread", False), (None, None, False)]
    df = spark.createDataFrame(rows, "t string, s string, want boolean")
    assert df.where(filters.passes_keywords(F.col("t"), F.col("s"), settings) != F.col("want")).count() == 0


def test_tracker(spark):
    t = spark.createDataFrame([(0, "a", "applied"), (1, "a", "Rejected "), (2, "b", ""), (3, "", "x")], "row_idx long, cu string, status string")
    assert {r["cu"]: r["status"] for r in lookups.tracker_status(t).collect()} == {"a": "rejected", "b": "tracked"}
    listings = spark.createDataFrame([("a",), ("b",), ("c",)], "cu string")
    assert {r["cu"]: r["actionable"] for r in lookups.with_status(listings, t).collect()} == {"a": False, "b": False, "c": True}
    assert [r["status"] for r in lookups.update_status(t, "a", "odd").orderBy("row_idx").collect()] == ["odd", "odd", "", "x"]
    new = spark.createDataFrame([(9, "c", "new"), (10, "b", "new")], "row_idx long, cu string, status string")
    assert lookups.insert_absent(t, new).where("status = 'new'").count() == 1


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    d = "/root/testdata/sf0.001"
    archive = adapter.archive(spark, d)
    seen = archive.where("row_idx % 2 = 0")
    p = plan(lookups.unseen(archive, seen))
    assert "LeftAnti" in p and "Cartesian" not in p and "NestedLoop" not in p
    p = plan(views.shortlist_rows(archive, adapter.SETTINGS))
    assert "Cartesian" not in p and "Python" not in p and "Window" not in p
    scan = plan(adapter.table(spark, d, "orders").where("o_orderkey > 5").select("o_orderkey"))
    assert "PushedFilters: [IsNotNull(o_orderkey), GreaterThan(o_orderkey,5)]" in scan and "ReadSchema: struct<o_orderkey:bigint>" in scan


def test_best_rows_are_found_by_a_hash_aggregate(spark):
    df = spark.createDataFrame([(-5, "u", 5), (1, "v", -9), (2, "u", None), (7, "u", 5)], "row_idx long, cu string, score_n int")
    best = dedup.best_per_url(df)
    assert sorted((r["cu"], r["row_idx"], r["first_idx"]) for r in best.collect()) == [("u", -5, -5), ("v", 1, 1)]
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_texts_are_lowered_once(spark, settings):
    rows = spark.createDataFrame([("Data", "x")], "title string, snippet string")
    plan = rows.where(filters.passes_keywords(F.col("title"), F.col("snippet"), settings))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lower(") <= 4

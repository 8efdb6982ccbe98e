"""The index of seen keys: exactness, filters, plans, later sessions, crashes."""

import re

import pytest
from pyspark.sql import functions as F

from listforge.operators import seen


def keys(spark, start, stop, step=1):
    return spark.range(start, stop, step).select(F.concat(F.lit("https://x.example/"), "id").alias("cu"), F.col("id").alias("row_idx"))


def numbers(df):
    return sorted(int(r["cu"].rsplit("/", 1)[1]) for r in df.select("cu").collect())


@pytest.fixture
def index(spark, tmp_path):
    return seen.Seen(spark, f"file://{tmp_path}/seen", expected=20_000, buckets=6)


def test_unseen_is_exact(spark, index):
    assert numbers(index.unseen(keys(spark, 0, 5))) == [0, 1, 2, 3, 4]
    index.record(keys(spark, 0, 9000))
    index.record(keys(spark, 5000, 10_000))
    new = keys(spark, 9990, 10_010).unionByName(keys(spark, 9999, 10_001)).unionByName(spark.createDataFrame([("", 0), (None, 1)], "cu string, row_idx long"))
    assert numbers(index.unseen(new)) == sorted([*range(10_000, 10_010), 10_000])
    assert index.unseen(new).columns == ["cu", "row_idx"]


def test_filters_rule_out_most_new_keys(spark, index):
    index.record(keys(spark, 0, 10_000))
    index.record(keys(spark, 10_000, 20_000))
    assert index.candidates(keys(spark, 0, 20_000)).count() == 20_000  # none that is there is ruled out
    assert index.candidates(keys(spark, 100_000, 120_000)).count() < 20_000 * 0.02


def test_merged_filters_equal_one_pass(spark):
    whole = {r["block"]: bytes(r["bits"]) for r in seen.bloom(keys(spark, 0, 5000), 3).collect()}
    parts = seen.bloom(keys(spark, 0, 3000), 3).unionByName(seen.bloom(keys(spark, 2000, 5000), 3))
    assert {r["block"]: bytes(r["bits"]) for r in seen.merged(parts).collect()} == whole


@pytest.mark.parametrize("threshold", ["-1", "10485760"])
def test_archive_side_is_not_shuffled(spark, index, threshold):
    """Neither as a sort-merge join nor with the run's keys broadcast; also when Spark would like more partitions."""
    index.record(keys(spark, 0, 10_000))
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        plan = index.known(keys(spark, 9000, 12_000))._jdf.queryExecution().executedPlan().toString()
        lines = plan.splitlines()
        scan = next(i for i, x in enumerate(lines) if "seen_keys_" in x)
        assert "Bucketed: true" in lines[scan]
        # The operators above the archive's scan, up to the join: those that stand further left than it.
        depth, above = len(re.match(r"[ :+\-|]*", lines[scan])[0]), []
        for x in reversed(lines[:scan]):
            at = len(re.match(r"[ :+\-|]*", x)[0])
            if at < depth:
                depth = at
                above.append(x.strip(" :+-|"))
        assert any("Join" in x for x in above) and not any("Exchange" in x for x in above)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_later_sessions_find_the_index(spark, index):
    index.record(keys(spark, 0, 100))
    for t in (index.keys, index.filters):
        spark.sql(f"DROP TABLE {t}")
    again = seen.Seen(spark, index.base, expected=5, buckets=2)  # the folder's own shape counts
    assert (again.buckets, again.blocks) == (6, 7)
    assert numbers(again.unseen(keys(spark, 98, 103))) == [100, 101, 102]


def test_catch_up_records_what_came_after(spark, index):
    archive = keys(spark, 0, 50)
    index.catch_up(archive)
    assert index.mark() == 49
    index.catch_up(archive)  # nothing new
    more = archive.unionByName(keys(spark, 50, 70)).unionByName(spark.createDataFrame([("", 70)], "cu string, row_idx long"))
    # A crash after the keys and before the filters: the mark stays, and the rows are recorded again.
    more.where("row_idx > 49 AND cu <> ''").select("cu").repartition(6, "cu").write.insertInto(index.keys)
    index.catch_up(more)
    assert index.mark() == 70 and numbers(index.unseen(keys(spark, 45, 75))) == [70, 71, 72, 73, 74]
    index.catch_up(spark.createDataFrame([("", 71)], "cu string, row_idx long"))  # a snapshot without keys
    assert index.mark() == 71


def test_compaction(spark, index, tmp_path):
    for i in range(4):
        index.record(keys(spark, 100 * i, 100 * i + 150), i)
    index.compact(expected=60_000, buckets=3)
    for at in (index, seen.Seen(spark, index.base)):
        assert (at.buckets, at.blocks, at.mark()) == (3, 20, 3)
        assert numbers(at.unseen(keys(spark, 445, 455))) == [450, 451, 452, 453, 454]
    files = list((tmp_path / "seen").rglob("keys/*.parquet"))
    assert len(files) <= 3 and spark.table(index.keys).count() == 450

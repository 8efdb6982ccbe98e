"""Streams: keyed state, late rows, restarts; pages that are read once; ingest with an index and a versioned archive."""

import json
import threading
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from listforge.operators import external
from listforge.operators.seen import Seen
from listforge.schema import TEASER
from listforge.sources import api, live
from listforge.streaming import arrivals, ingest

TEASERS = "row_idx long, " + ", ".join(f"{c} string" for c in TEASER)


def teaser(i, url, title="", day="2026-06-14", company="Co", description=None):
    return (i, title or f"Data {url}", company, "N/A", day, "python", f"https://x/{url}", "board", description, None)


def run(rows, folder):
    query = rows.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").start()
    query.processAllAvailable()
    return query


def test_first_arrivals(spark, tmp_path, settings):
    """A stream in three parts with a restart equals the batch; what comes late is dropped and counted."""
    parts = [
        [teaser(0, "a"), teaser(1, "b", "Role"), teaser(2, "a?utm_source=z"), teaser(3, "c", "Role"), teaser(4, "", "")],
        [teaser(5, "a"), teaser(6, "d", "role!"), teaser(7, "e", day=""), teaser(8, "f", day="soon"), teaser(9, "g", company="")],
        [teaser(10, "g", company=""), teaser(11, "e"), teaser(12, "h", day="2026-06-13")],
    ]
    whole = spark.createDataFrame([r for p in parts for r in p], TEASERS)
    expected = sorted(r["row_idx"] for r in arrivals.first_arrivals(whole, settings).collect())
    assert expected == [0, 1, 4, 7, 8, 9, 12]
    for part in parts:
        spark.createDataFrame(part, TEASERS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(whole.schema).parquet(f"{tmp_path}/in")
        query = run(arrivals.first_arrivals(source, settings), tmp_path)
        assert arrivals.late(query) == 0
        query.stop()  # the next part is read by a new query, from the checkpoint
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(r["row_idx"] for r in got.collect()) == expected
    old = [teaser(20, "old1", day="2026-01-01"), teaser(21, "old2", day="2026-01-02"), teaser(22, "new")]
    spark.createDataFrame(old, TEASERS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    query = run(arrivals.first_arrivals(source, settings), tmp_path)
    assert arrivals.late(query) == 2
    query.stop()
    assert sorted(r["row_idx"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [*expected, 22]


MODULE = """
import json, os, time
from urllib.parse import parse_qs, urlsplit

LOG = {log!r}
PAGES = {{"data": {{1: ["1", "2"], 2: ["2", "3"], 3: ["3"]}}, "sql": {{1: ["9"]}}, "broken": {{}}}}

def web(url):
    q = parse_qs(urlsplit(url).query)
    term, page = q["q"][0], int(q["page"][0])
    with open(LOG, "a") as f:
        f.write(f"{{term}} {{page}}\\n")
    if term == "broken":
        raise OSError("no")
    return json.dumps({{"docs": [{{"id": i, "title": i}} for i in PAGES[term].get(page, [])]}})
"""


@pytest.fixture
def paged(spark, tmp_path, monkeypatch):
    name = f"web_{tmp_path.name.replace('-', '_')}"
    (tmp_path / f"{name}.py").write_text(MODULE.format(log=str(tmp_path / "log")))
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / f"{name}.py"))
    return {"queries": json.dumps(["data", "sql", "broken"]), "base": "http://x", "opener": f"{name}.web", "spool": f"file://{tmp_path}/spool"}


def asked(tmp_path):
    return sorted((tmp_path / "log").read_text().split("\n")[:-1])


EACH_ONCE = ["broken 1", "data 1", "data 2", "data 3", "sql 1", "sql 2"]


def test_pages_as_a_stream(spark, tmp_path, paged):
    spark.dataSource.register(api.PagedSource)
    rows = spark.readStream.format("listforge_paged").options(**paged).load()
    query = run(rows, tmp_path)
    query.stop()
    for _ in range(2):  # a later session with the same checkpoint has nothing left to ask
        query = run(rows, tmp_path)
        query.stop()
    got = sorted((r["rank"], r["page"], json.loads(r["raw"])["id"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(0, 1, "1"), (0, 1, "2"), (0, 2, "3"), (1, 1, "9")] and asked(tmp_path) == EACH_ONCE
    batch = spark.read.format("listforge_paged").options(**{k: v for k, v in paged.items() if k != "spool"}).load()
    assert sorted((r["rank"], r["page"], json.loads(r["raw"])["id"]) for r in batch.collect()) == got


def test_offsets_after_a_restart(tmp_path, paged):
    """A reader that is made anew goes on where the spool ends; a batch that is repeated gives the same rows unasked."""
    first = live.PagedStream(paged)
    start, end = first.initialOffset(), first.latestOffset()
    assert start == {"0": 1, "1": 1, "2": 1} and end == {"0": 2, "1": 2, "2": 2} == first.latestOffset()
    once = [list(first.read(p)) for p in first.partitions(start, end)]
    again = live.PagedStream(paged)
    assert [list(again.read(p)) for p in again.partitions(start, end)] == once
    assert again.latestOffset() == {"0": 3, "1": 3, "2": 2}
    assert asked(tmp_path) == ["broken 1", "data 1", "sql 1"]
    while (now := again.latestOffset()) != end:
        for p in again.partitions(end, now):
            list(again.read(p))
        end = now
    assert end == {"0": 4, "1": 3, "2": 2} and asked(tmp_path) == EACH_ONCE


def test_two_attempts_at_a_page_give_the_same_rows(paged):
    reader = live.PagedStream(paged)
    got = []
    threads = [threading.Thread(target=lambda: got.append(reader._fetch(0, "data", 1)["rows"])) for _ in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(got) == 6 and len({json.dumps(g) for g in got}) == 1


def test_ingest_with_index_and_versions(spark, tmp_path, settings):
    archive, index = ingest.versioned(spark, f"file://{tmp_path}/a"), Seen(spark, f"file://{tmp_path}/seen", 1000, 2)
    rows = [teaser(0, "full", description="python and sql " * 5), *[teaser(i, f"t{i}") for i in range(1, 6)], teaser(6, "t1")]
    df = spark.createDataFrame(rows, TEASERS)
    counts = ingest.ingest(df, archive, settings, None, seen=index)
    assert counts == {"teasers": 7, "prefiltered": 6, "danish_early": 0, "danish_body": 0, "deadline_dropped": 0, "fetched": 5, "scored": 6, "errors": 0, "matches": counts["matches"]}
    got = archive.read().orderBy("row_idx").collect()
    assert [r["url"].rsplit("/", 1)[1] for r in got] == ["t1", "t2", "t3", "t4", "t5", "full"]  # what is fetched comes first
    # The index doesn't know yet what this run archived; the next run adds that first.
    more = spark.createDataFrame([*rows[:3], teaser(9, "t9")], TEASERS)
    assert ingest.ingest(more, archive, settings, None, seen=index)["scored"] == 1
    assert archive.read().count() == 7 and index.mark() == max(r["row_idx"] for r in got)
    # A batch that is stored under a name is stored once, even if the index is lost.
    assert ingest.ingest(df, archive, settings, None, seen=Seen(spark, f"file://{tmp_path}/other", 1000, 2), txn="b 1")["scored"] == 0
    again = spark.createDataFrame([teaser(0, "z1")], TEASERS)
    for _ in range(2):
        ingest.ingest(again, archive, settings, None, txn="b 2")
    assert archive.read().count() == 8


def test_counts_need_no_jobs_of_their_own(spark, tmp_path, settings):
    """What jobs there are, Spark's own for each exchange among them, write, size up what is read in order, or ask for the
    archive's last row."""
    df = spark.createDataFrame([teaser(i, f"t{i}") for i in range(3)], TEASERS)
    sc = spark.sparkContext
    sc.setJobGroup("counted", "counted")
    counts = ingest.ingest(df, f"file://{tmp_path}/a", settings, None)
    jobs = len(sc.statusTracker().getJobIdsForGroup("counted"))
    sc.setJobGroup("other", "other")
    assert counts["teasers"] == counts["scored"] == 3 and jobs <= 18
    nothing = ingest.ingest(df.where("false"), f"file://{tmp_path}/b", settings, None)
    assert set(nothing.values()) == {0}


def raising(what):
    def make():
        raise what

    return make


def test_clients_that_fail(spark, settings, tmp_path, caplog):
    """Neither a failing call nor a client that can't be made ends the job."""
    df = spark.createDataFrame([(1, "https://a", "t", "c", "l", "b" * 300), (2, "https://b", None, None, None, None)], "row_idx int, url string, title string, company string, location string, body string")
    got = external.extracted(external.fetched(df, raising(OSError("away")), settings), raising(OSError("")), "body").withColumn("code", external.detected(F.col("body"), raising(OSError("away")))).collect()
    assert [(r["fetched"], r["fetch_error"], r["brief_json"], r["brief_error"], r["code"]) for r in got] == [("", "away", None, "RuntimeError", "?")] * 2
    assert [r["reasoning"] for r in external.scored(df, raising(OSError("away")), settings).collect()] == ["scoring error"] * 2
    rows = spark.createDataFrame([teaser(0, "a", description="og er til af vi du erfaring medarbejder " * 9), teaser(1, "b", description="sql " * 90)], TEASERS)
    with caplog.at_level("WARNING"):
        counts = ingest.ingest(rows, f"{tmp_path}/a", replace(settings, drop_foreign_language=True), None, detector=raising(OSError("away")))
    assert (counts["danish_body"], counts["scored"]) == (1, 1) and "detection failed for 2" in caplog.text  # marks decide


def test_shipped_clients():
    of = external.rule_detector()
    assert of("Vi søger dig og det er ikke til at blive i tvivl") == "da" and of("we are looking for you and the team with this work") == "en" and of("x") is None
    found = json.loads(external.rule_extractor()("T", "We build. Join us\nRequirements:\n- sql\n* python\n\nNice to have\n- go\nOther\n- nothing"))
    assert found == {"title": "T", "role_summary": "We build.", "must_have": ["sql", "python"], "nice_to_have": ["go"]}
    assert external.client("", of) is None and external.client("rules", of) is of and external.client("listforge.operators.external.web_fetcher", None) is external.web_fetcher

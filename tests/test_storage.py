import json

from pyspark.sql import functions as F

from listforge import cli, config
from listforge.schema import ARCHIVE, RUNS, TEASER, TRACKER, strings
from listforge.sources import api, files, registry
from listforge.streaming import ingest

ANSWERS = {("data", 1): {"docs": [{"id": "1", "title": "Data"}, {"id": "2", "title": "Dev"}]}, ("data", 2): {"docs": [{"id": "2", "title": "Dev"}]}}


def opener(url):
    from urllib.parse import parse_qs, urlsplit

    q = parse_qs(urlsplit(url).query)
    if q["q"][0] == "broken":
        raise OSError("no")
    return json.dumps(ANSWERS.get((q["q"][0], int(q["page"][0])), {}))


def test_paged_source():
    reader = api.PagedReader({"queries": json.dumps(["data", "broken", "none"]), "base": "http://x/api", "opener": f"{__name__}.opener"})
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert [json.loads(r[4])["id"] for r in rows] == ["1", "2"]
    assert api.PagedReader({"queries": '["data"]'}).partitions() == []


def test_sources_are_isolated(spark):
    def broken():
        raise RuntimeError("down")

    found, failed = registry.union({"a": lambda: spark.range(2), "b": broken, "c": lambda: spark.range(3).withColumn("x", F.lit("y"))})
    assert found.count() == 5 and failed == {"b": "down"}


def test_csv_round_trip_and_migration(spark, tmp_path):
    rows = [("1", 'a\nb, "c"', ""), ("2", "", "x")]
    files.write_csv(spark.createDataFrame(rows, "title string, reasoning string, foo string"), f"{tmp_path}/t")
    got = files.read_csv(spark, f"{tmp_path}/t", ("title", "danish_level", "reasoning")).orderBy("title").collect()
    assert [tuple(r) for r in got] == [("1", "", 'a\nb, "c"'), ("2", "", "")]


def test_append_evolves_by_name(spark, tmp_path):
    path = f"{tmp_path}/a"
    assert files.read_table(spark, path, ARCHIVE).count() == 0
    files.append(spark.createDataFrame([("1", "u")], "title string, url string"), path, ("title", "url"))
    files.append(spark.createDataFrame([("x", "2")], "source string, title string"), path, ("title", "source"))
    got = files.read_table(spark, path, ("source", "title", "url")).orderBy("title").collect()
    assert [tuple(r) for r in got] == [("", "1", "u"), ("x", "2", "")]


def test_profiles(tmp_path, settings):
    (tmp_path / "p.toml").write_text('candidate_profile = "c"\nlocation_anchor = "l"\nqueries = ["q"]\ndanish_ok = true\nrequire_commutable = false\n')
    s = config.with_profile(settings, config.load_profile(str(tmp_path), "p"))
    assert (s.board_queries, s.exclude_language_required, s.require_commutable, s.base) == (("q",), False, False, "./_profiles/p")


PAGES = {"https://ok": "Python developer student wanted. " * 10, "https://short": "x"}


def fetchers():
    """A factory that travels by value: executors can't import test modules."""
    pages = dict(PAGES)

    def make():
        return lambda url: pages[url]

    return make


def teasers(spark):
    rows = [(0, "Data student", "Co", "N/A", "N/A", "python", "https://ok", "board", None, None), (1, "Data student", "Co", "N/A", "N/A", "python", "https://other", "board", None, None), (2, "Baker", "B", "N/A", "N/A", "bread", "https://bread", "board", None, None), (3, "Engineer", "C", "N/A", "N/A", "", "https://short", "board", None, None), (4, "Engineer", "Politi", "N/A", "N/A", "", "https://p", "board", None, None), (5, "Anything", "D", "N/A", "N/A", "", "https://full", "hub", "data platform frist 1.1.2020", "full"), (6, "SQL", "E", "N/A", "N/A", "", "https://gone", "board", None, None)]
    return spark.createDataFrame(rows, "row_idx long, " + ", ".join(f"{c} string" for c in TEASER))


def test_ingest_and_desk(spark, tmp_path, settings):
    archive = f"file://{tmp_path}/archive"
    counts = ingest.ingest(teasers(spark), archive, settings, fetchers())
    assert counts["teasers"] == 7 and counts["prefiltered"] == 4 and counts["fetched"] == 3 and counts["deadline_dropped"] == 1 and counts["scored"] == 3 and counts["errors"] == 0
    # Roles bar each other within a run only, so that row 1 would be new now; what is archived is not.
    assert ingest.ingest(teasers(spark).where("row_idx <> 1"), archive, settings, fetchers())["scored"] == 0
    ingest.log_run(spark, f"{tmp_path}/runs", "2026-06-15 10:00:00", {"duration_s": 1.25}, counts)
    assert files.read_table(spark, f"{tmp_path}/runs", RUNS).first()["teasers"] == "7"
    desk = cli.Desk(spark, archive, f"file://{tmp_path}/tracker", settings, f"file://{tmp_path}/briefs")
    lines = desk.listing()
    assert len(lines) == 1 and "NEW" in lines[0] and "Data student" in lines[0]
    meta = desk.item(1)
    assert desk.item(99) is None and desk.row_of("https://www.OK/?utm_source=x")["url"] == "https://ok"
    path = desk.prepare(dict(meta), "body", {"must_have": ["sql", " "]})
    assert "- sql" in (tmp_path / "briefs" / path.rsplit("/", 1)[-1]).read_text()
    assert desk.prepare(dict(meta), "").endswith("_2.md")
    assert desk.snapshots.read().count() == 1
    assert desk.set_status("https://ok/", "applied") and not desk.set_status("https://nope", "applied")
    assert desk.listing(only_new=True) == [] and len(desk.listing()) == 1
    assert desk.report(f"file://{tmp_path}/report.md") == 1 and "Data student" in (tmp_path / "report.md").read_text()
    assert cli.main(["--status", "https://ok", "offer"], desk) == 0 and desk.snapshots.read().first()["status"] == "offer"


def test_failed_scores_are_not_stored(spark, tmp_path, settings):
    def broken():
        def ask(*_):
            raise OSError("no model")

        return ask

    counts = ingest.ingest(teasers(spark), f"{tmp_path}/archive", settings, None, broken)
    assert counts["errors"] == counts["scored"] > 0
    assert files.read_table(spark, f"{tmp_path}/archive", ARCHIVE).count() == 0


def test_stream(spark, tmp_path, settings):
    teasers(spark).write.parquet(f"{tmp_path}/in")
    rows = spark.readStream.schema(teasers(spark).schema).parquet(f"{tmp_path}/in")
    query = ingest.stream(rows, f"{tmp_path}/archive", f"{tmp_path}/check", settings)
    query.awaitTermination(120)
    assert query.exception() is None
    assert files.read_table(spark, f"{tmp_path}/archive", ARCHIVE).count() == 3
    assert ingest.current_shortlist(spark, f"{tmp_path}/archive", settings).count() >= 0


def test_snapshots_start_empty(spark, tmp_path):
    s = files.Snapshots(spark, f"file://{tmp_path}/t", TRACKER)
    assert s.read().schema.names == [*TRACKER, "row_idx"] and s.read().count() == 0
    for i in range(4):
        s.replace(spark.createDataFrame([tuple([str(i)] * len(TRACKER))], strings(TRACKER)))
    assert s.read().first()["url"] == "3" and len(s._all()) == 2


def test_order_of_arrival_is_stored(spark, tmp_path):
    """Files are read by size, so that the order of reading isn't that of two appends."""
    path = f"{tmp_path}/a"
    big = spark.range(400).selectExpr("399 - id AS row_idx", "cast(id AS string) AS title", "repeat('x', 50) AS url")
    files.append_ordered(spark.createDataFrame([(0, "first"), (1, "second")], "row_idx int, title string").coalesce(1), path, ("title", "url"))
    files.append_ordered(big.repartition(3), path, ("title", "url"))
    files.append_ordered(spark.createDataFrame([(0, "last")], "row_idx int, title string"), path, ("title", "url"))
    got = [r["title"] for r in files.read_ordered(spark, path, ("title", "url")).orderBy("row_idx").collect()]
    assert got == ["first", "second", *[str(399 - i) for i in range(400)], "last"]
    files.append(spark.createDataFrame([("old",)], "title string"), f"{tmp_path}/b", ("title",))
    files.append_ordered(spark.createDataFrame([(0, "new")], "row_idx int, title string"), f"{tmp_path}/b", ("title",))
    assert [r["title"] for r in files.read_ordered(spark, f"{tmp_path}/b", ("title",)).orderBy("row_idx").collect()] == ["old", "new"]


def test_language_gates_and_failures(spark, tmp_path, settings, caplog):
    from dataclasses import replace

    def detector():
        return lambda t: "da" if "dansk" in t else None

    rows = [(0, "Data dansk", "A", "", "", "python " * 12, "https://a", "board", None, None), (1, "Data", "B", "", "", "python " * 12, "https://short", "board", None, None), (2, "Data engineer", "C", "", "", "", "https://c", "board", "dansk " * 60, "full"), (3, "SQL", "D", "", "", "sql", "https://gone", "board", None, None)]
    df = spark.createDataFrame(rows, "row_idx long, " + ", ".join(f"{c} string" for c in TEASER))
    with caplog.at_level("WARNING"):
        counts = ingest.ingest(df, f"{tmp_path}/a", replace(settings, drop_foreign_language=True), fetchers(), detector=detector)
    assert (counts["danish_early"], counts["danish_body"], counts["deadline_dropped"], counts["scored"]) == (1, 1, 0, 2)
    assert [r.getMessage().split(": ")[1].split()[0] for r in caplog.records if "not fetched" in r.getMessage()] == ["https://short", "https://gone"]
    assert ingest.ingest(df, f"{tmp_path}/b", replace(settings, drop_foreign_language=True), fetchers())["danish_early"] == 0


BOARD_PAGE = """<html><p>outside</p><div class="jobsearch-result"><a href="https://logo"><img></a><div class="jix-toolbar-top__company"> <a>Co</a> &amp; Sons </div>
<h4><a href="/job/1">Data <b>student</b></a></h4><p>One <i>two</i></p><p>  </p><p>three</p><time datetime="2026-06-14T01:00">i dag</time></div>
<div class="jobsearch-result other"><h3><a href="https://x/2">Old</a></h3><time datetime="2025-01-01">x</time></div>
<div class="jobsearch-result"><h4>No link</h4><time>i dag</time></div><div class="jobsearch-result"><h3><a href="https://x/3">Python developer</a></h3><time datetime="soon">i dag</time></div>
<div class="jobsearch-result"><div class="jix-toolbar-top__company">Politiet</div><h3><a href="https://x/4">Data</a></h3></div><p>below</p></html>"""


def web(url):
    from urllib.parse import parse_qs, urlsplit

    q = parse_qs(urlsplit(url).query)
    if "board" in url:
        return BOARD_PAGE if q["page"][0] == "1" and q["q"][0] == "python student" else "<html>nothing</html>"
    docs = {("data", "0"): [{"id": 7, "title": "Data hub", "company": {"name": "H"}}, {"url": "https://www.h/8?ref=a", "title": "Eight"}], ("data", "1"): [{"url": "https://h/8", "title": "Eight again"}], ("sql", "0"): [{"id": 7, "title": "Data hub"}, {"id": 9, "title": "Nine", "published": "2020-01-01"}]}
    assert q["countryCode"] == ["DK"]
    return json.dumps({"docs": docs.get((q["search"][0], q["page"][0]), [])})


def test_cards(spark, settings):
    from dataclasses import replace

    from listforge.sources import cards

    pages_ = spark.createDataFrame([(0, BOARD_PAGE), (1, None), (2, "")], "page int, raw string")
    got = cards.teasers(pages_, replace(settings, board_base="https://b")).drop("description", "source").collect()
    assert [tuple(r) for r in got] == [
        (0, 0, "Datastudent", "Co & Sons", "N/A", "2026-06-14", "One two three", "https://b/job/1", "board"),
        (0, 3, "Python developer", "N/A", "N/A", "i dag", "", "https://x/3", "board"),
    ]


def test_api_parameters(settings):
    s = {"queries": '["data", "sql"]', "base": "http://api", "opener": f"{__name__}.web", "search": "search", "first": "0", "params": '{"countryCode": "DK"}'}
    reader = api.PagedReader(s)
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert [(r[0], r[2], json.loads(r[4])["title"]) for r in rows] == [(0, 0, "Data hub"), (0, 0, "Eight"), (1, 0, "Data hub"), (1, 0, "Nine")]
    assert reader.asked("", 3) == {"countryCode": "DK", "page": "3"}


def test_commands(spark, tmp_path, capsys, monkeypatch):
    """ingest, analyse and prepare, over sources that are read without a network."""
    from listforge import __main__ as command

    (tmp_path / "web_of_tests.py").write_text("import json\nBOARD_PAGE = " + repr(BOARD_PAGE) + "\n\n\n" + __import__("inspect").getsource(web))
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "web_of_tests.py"))
    (tmp_path / "me.toml").write_text('name = "me"\ncandidate_profile = "c"\nlocation_anchor = "l"\nqueries = ["python student", "none"]\n')
    common = ["--base", f"file://{tmp_path}/d", "--profiles", str(tmp_path), "--profile", "me", "--owner", "--today", "2026-06-15", "--no-fetch", "--board", "http://board", "--board-base", "https://b", "--api", "http://api", "--job-url", "https://h/"]
    real = config.Settings

    def settings_(**given):
        return real(**given, api_queries=("data", "sql"), api_zero_indexed=True)

    monkeypatch.setattr(config, "Settings", settings_)
    assert command.main(["ingest", *common, "--dump", f"file://{tmp_path}/dump"], spark, opener="web_of_tests.web") == 0
    out = capsys.readouterr().out
    assert "teasers 4" in out and "scored 4" in out and (tmp_path / "d" / "report.md").exists()
    assert any("jobsearch-result" in f.read_text() for f in (tmp_path / "dump").rglob("*.txt"))
    titles = [r["title"] for r in files.read_ordered(spark, f"file://{tmp_path}/d/archive", ARCHIVE).orderBy("row_idx").collect()]
    assert titles == ["Datastudent", "Python developer", "Data hub", "Eight"]
    assert command.main(["ingest", *common], spark, opener="web_of_tests.web") == 0 and "scored 0" in capsys.readouterr().out
    assert command.main(["analyse", *common], spark) == 0
    out = capsys.readouterr().out
    assert "Scored rows: 4" in out and "Runs" in out and out.count(" teasers, ") == 2
    assert command.main(["prepare", *common], spark) == 0 and command.main(["prepare", *common, "https://x/3"], spark) == 0
    assert command.main(["prepare", *common, "--status", "https://x/3", "applied"], spark) == 0
    assert "updated" in capsys.readouterr().out


def test_briefs_are_fetched_and_filled(spark, tmp_path, settings):
    def extractor():
        return lambda title, body: json.dumps({"must_have": [title, body[:6]], "company": "Found"})

    desk = cli.Desk(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/t", settings, f"file://{tmp_path}/b", fetchers(), extractor)
    path = desk.prepare_live({"url": "https://ok", "title": "T", "company": "N/A"})
    text = (tmp_path / "b" / path.rsplit("/", 1)[-1]).read_text()
    assert "# Brief: Found, T" in text and "- Python" in text and "developer student" in text
    assert cli.main(["https://short"], desk) == 0
    assert [r["url"] for r in desk.snapshots.read().orderBy("row_idx").collect()] == ["https://ok", "https://short"]


def test_scratch_needs_a_shared_folder(spark, monkeypatch):
    from listforge.operators import dedup

    class Other:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    since = dedup.mark()
    assert dedup.written(spark.range(3), "t").count() == 3 and dedup.clear(spark, since) == 1 and dedup.mark() == since

    class Session:
        sparkContext = Other()
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})

    class Frame:
        sparkSession = Session()

    try:
        dedup.written(Frame(), "t")
        raise AssertionError("a machine's own folder was taken")
    except RuntimeError as e:
        assert "spark.checkpoint.dir" in str(e)

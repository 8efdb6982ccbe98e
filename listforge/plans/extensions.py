"""Queries over what the engine adds to the plain listings: indexes, versions, orders, time joins, sketches, seams."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import external, filters, numbering, sketches, timejoins, views
from ..operators.dedup import written
from ..operators.seen import Seen
from ..shipping import ship
from ..sources import registry, tables
from ..streaming import arrivals
from . import adapter as A
from .base import S, query


def _folder(spark, name: str) -> str:
    """A new folder below the shared one."""
    import uuid

    written(spark.range(0), name)  # the shared folder is there, or is made, or the session is told to name one
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# --- the archive's index, and versions of the tracker ---------------------------------------------------------------

ROLE_URL = "'https://board.example/roles/' || cast(o_custkey AS string) || '-' || cast(o_orderkey % 10 AS string)"


@query(f"WITH a AS (SELECT o_orderkey AS row_idx, o_orderdate AS day, {ROLE_URL} AS cu FROM orders) SELECT row_idx, cu FROM a WHERE day >= DATE '1999-01-01' AND NOT EXISTS (SELECT 1 FROM a b WHERE b.cu = a.cu AND b.day < DATE '1999-01-01')")
def unseen_by_index(spark, d):
    """Roles of 1999 and later that an index of the earlier ones, recorded in two snapshots, doesn't have."""
    rows = A.table(spark, d, "orders").selectExpr("o_orderkey AS row_idx", "o_orderdate AS day", f"{ROLE_URL} AS cu")
    index = Seen(spark, _folder(spark, "index"), expected=100_000, buckets=8)
    index.record(rows.where("day < DATE '1997-01-01'"))
    index.record(rows.where("day >= DATE '1997-01-01' AND day < DATE '1999-01-01'"))
    return index.unseen(rows.where("day >= DATE '1999-01-01'")).select("row_idx", "cu")


@query(f"WITH t AS ({A.TRACKER_SQL}), h AS (SELECT * FROM t WHERE row_idx % 2 = 0), n AS (SELECT * FROM t WHERE row_idx % 2 = 1 AND cu NOT IN (SELECT cu FROM h WHERE cu LIKE '%7')) SELECT cu, CASE WHEN cu = 'https://ex.com/jobs/11' THEN 'offer' ELSE status END AS status, row_number() OVER (ORDER BY part, row_idx) - 1 AS place FROM (SELECT *, 0 AS part FROM h UNION ALL SELECT *, 1 AS part FROM n)")
def tracker_versions(spark, d):
    """Appends and an update of a versioned table, each one version; places follow the order of arrival."""
    t = A.tracker(spark, d)
    half, rest = t.where("row_idx % 2 = 0"), t.where("row_idx % 2 = 1")
    half = numbering.numbered(half, "row_idx", name="row_idx", start=0)
    rest = rest.join(half.where("cu LIKE '%7'").select("cu"), "cu", "left_anti")
    rest = numbering.numbered(rest, "row_idx", name="row_idx", start=0)
    table = tables.Table(spark, _folder(spark, "tracker"), half.select("cu", "status", "row_idx").schema)
    table.append_ordered(half)
    table.append_ordered(rest, txn="rest")
    table.append_ordered(rest, txn="rest")  # a repeated commit adds nothing
    table.change(lambda rows, _: rows.withColumn("status", F.when(F.col("cu") == "https://ex.com/jobs/11", "offer").otherwise(F.col("status"))))
    return table.read().select("cu", "status", F.col("row_idx").alias("place"))


# --- orders ---------------------------------------------------------------------------------------------------------


@query(f"WITH {A.SHORT} SELECT row_idx, row_number() OVER (ORDER BY days_left NULLS LAST, score_n DESC, first_idx) AS place FROM short")
def shortlist_places(spark, d):
    """The shortlist's order, as numbers."""
    return views.numbered(views.shortlist_rows(A.archive(spark, d), S)).select("row_idx", F.col("n").alias("place"))


@query(f"WITH {A.KEYED} SELECT row_idx, row_number() OVER (ORDER BY score_n DESC, row_idx) AS place FROM k WHERE {A.MATCH}")
def match_places(spark, d):
    """O2: matches by score, equals as they arrived, as numbers."""
    rows = A.archive(spark, d)
    return numbering.numbered(rows.where(views.matches(rows, S)), F.desc("score_n"), "row_idx").select("row_idx", F.col("n").alias("place"))


@query("SELECT doc_id, row_number() OVER (ORDER BY n_chars > 200, doc_id) AS place FROM documents")
def bodies_last_places(spark, d):
    """What has to be fetched first, then what came with a body, both as they arrived."""
    rows = A.table(spark, d, "documents").select("doc_id", "n_chars")
    most = rows.agg(F.max("doc_id")).first()[0]
    order = filters.bodies_last(F.col("n_chars") > 200, F.col("doc_id"), most + 1)
    return numbering.numbered(rows.withColumn("at", order), "at").select("doc_id", F.col("n").alias("place"))


# --- seams ----------------------------------------------------------------------------------------------------------


def scripted_fetcher():
    """Pages that say their URL; those with a 7 in it fail, those with an 8 are too short."""

    def get(url: str) -> str:
        if "7" in url:
            raise OSError(f"HTTP 500 for {url}")
        return url if "8" in url else f"{url}\n" * 250

    return get


@query("SELECT page_id, CASE WHEN contains(url, '7') OR contains(url, '8') THEN '' ELSE left(rtrim(repeat(url || chr(10), 250), chr(10)), 6000) END AS fetched, CASE WHEN contains(url, '7') THEN left('HTTP 500 for ' || url, 140) WHEN contains(url, '8') THEN 'the page has too little text' END AS fetch_error FROM pages")
def page_fetches(spark, d):
    """Every page by its URL, some of which fail or are too short."""
    return external.fetched(A.table(spark, d, "pages").select("page_id", "url"), scripted_fetcher, S).select("page_id", "fetched", "fetch_error")


def scripted_scorer():
    """Scores by the company's length; some answers are no JSON, some calls fail."""

    def ask(title: str, company: str, location: str, body: str) -> str:
        if company.endswith("3"):
            raise TimeoutError("no answer")
        if company.endswith("4"):
            return "I would rather not say."
        return json.dumps({"score": len(company), "track": "A", "reasoning": f"{location}: {len(body)}", "matched_skills": [title]})

    return ask


def scripted_extractor():
    def ask(title: str, body: str) -> str:
        if title.endswith("5"):
            raise RuntimeError(f"no model for {title}")
        return "nothing" if title.endswith("6") else json.dumps({"role_summary": body})

    return ask


def scripted_detector():
    def of(body: str) -> str | None:
        if body.endswith("8"):
            raise ValueError("no features in text")
        return "da" if body.endswith("1") else None

    return of


@query(
    "SELECT c_custkey, CASE WHEN c_name LIKE '%3' OR c_name LIKE '%4' THEN 0 ELSE length(c_name) END AS score, CASE WHEN c_name LIKE '%3' OR c_name LIKE '%4' THEN 'scoring error' ELSE 'N/A: ' || cast(least(length(c_name || repeat(' word', 2000)), 5000) AS string) END AS reasoning, "
    "CASE WHEN c_name LIKE '%5' OR c_name LIKE '%6' THEN NULL ELSE c_mktsegment END AS summary, CASE WHEN c_name LIKE '%5' THEN 'no model for ' || c_name END AS brief_error, CASE WHEN c_name LIKE '%8' THEN '?' WHEN c_name LIKE '%1' THEN 'da' END AS code FROM customer"
)
def failing_models(spark, d):
    """Scoring, extraction and detection with clients that fail for some rows; no row is lost."""
    rows = A.table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("title"), F.col("c_name").alias("company"), F.lit("N/A").alias("location"), F.concat("c_name", F.repeat(F.lit(" word"), 2000)).alias("body"), "c_mktsegment")
    rows = written(external.scored(rows, scripted_scorer, S), "scored")
    rows = external.extracted(rows, scripted_extractor, body="c_mktsegment")
    rows = rows.withColumn("code", external.detected(F.col("title"), scripted_detector))
    return rows.select("c_custkey", "score", "reasoning", F.get_json_object("brief_json", "$.role_summary").alias("summary"), "brief_error", "code")


@query("SELECT source_site, n, NULL AS error FROM (SELECT 'board' AS source_site, count(*) AS n FROM supplier UNION ALL SELECT 'hub', count(*) FROM customer) UNION ALL SELECT 'broken', 0, 'down'")
def isolated_sources(spark, d):
    """A source that fails while its plan is made and one that fails while it is read take nothing along."""

    def broken():
        raise RuntimeError("down")

    def late():
        rows = A.table(spark, d, "supplier").withColumn("title", F.when(F.col("s_suppkey") >= 0, F.raise_error(F.lit("down"))).otherwise(F.lit("")))
        return written(rows.select("title"), "late")

    sources = {
        "board": lambda: A.table(spark, d, "supplier").select(F.lit("board").alias("source_site")),
        "broken": broken, "late": late,
        "hub": lambda: A.table(spark, d, "customer").select(F.lit("hub").alias("source_site")),
    }
    found, failed = registry.union(sources)
    assert set(failed) == {"broken", "late"}
    errors = spark.createDataFrame([("broken", 0, failed["broken"])], "source_site string, n long, error string")
    return found.groupBy("source_site").agg(F.count("*").alias("n")).withColumn("error", F.lit(None).cast("string")).unionByName(errors)


# --- sources and sinks ----------------------------------------------------------------------------------------------

PAGE, LIMIT = 200, 3


@query(
    f"WITH t AS (SELECT *, c_custkey // {PAGE} + 1 AS page FROM customer) "
    f"SELECT c_name AS title, 'https://hub.example/' || cast(c_custkey AS string) AS url FROM t WHERE page <= {LIMIT} AND NOT (c_mktsegment = 'BUILDING' AND page >= 2)"
)
def paged_api(spark, d):
    """Customers as the pages of an API, by segment and ranges of keys, asked for page by page; a page limit, and
    a query whose second page repeats its first, which ends it."""
    from ..sources import api

    rows = A.table(spark, d, "customer")
    rows = rows.select(F.col("c_mktsegment").alias("q"), F.expr(f"cast(c_custkey div {PAGE} AS int) + 1").alias("page"), F.col("c_custkey").alias("at"), F.struct(F.col("c_name").alias("title"), F.concat(F.lit("https://www.hub.example/"), "c_custkey").alias("url")).alias("doc"))
    again = rows.where("q = 'BUILDING' AND page = 1")
    rows = rows.where("NOT (q = 'BUILDING' AND page = 2)").unionByName(again.withColumn("page", F.lit(2)))
    pages = rows.groupBy("q", "page").agg(F.to_json(F.struct(F.transform(F.sort_array(F.collect_list(F.struct("at", "doc"))), lambda x: x["doc"]).alias("docs"))).alias("value"))
    folder = _folder(spark, "pages")
    pages.write.partitionBy("q", "page").text(folder)
    terms = sorted(r[0] for r in rows.select("q").distinct().collect())  # one query each, as a settings file would list them
    spark.dataSource.register(api.PagedSource)
    ship(spark)
    found = spark.read.format("listforge_paged").options(base=folder, queries=json.dumps(terms), pages=str(LIMIT), opener="listforge.sources.api.stored").load()
    out = api.teasers(written(found, "objects"), S)
    return out.select("title", F.regexp_replace("url", "www[.]", "").alias("url"))


@query("SELECT o_orderkey, 'a \"quoted\", text' || chr(10) || o_orderpriority AS reasoning, '' AS published_date FROM orders")
def csv_scan(spark, d):
    """A CSV table with line feeds and quotes inside fields, read by name; a column that the file lacks is blank."""
    from ..sources import files

    folder = _folder(spark, "csv")
    rows = A.table(spark, d, "orders").select(F.concat(F.lit('a "quoted", text\n'), "o_orderpriority").alias("reasoning"), F.col("o_orderkey").cast("string").alias("o_orderkey"), F.lit("x").alias("foo"))
    files.write_csv(rows, folder)
    return files.read_csv(spark, folder, ("o_orderkey", "reasoning", "published_date")).withColumn("o_orderkey", F.col("o_orderkey").cast("long"))


@query(f"WITH {A.SHORT}, n AS (SELECT *, row_number() OVER (ORDER BY days_left NULLS LAST, score_n DESC, first_idx) AS n FROM short) SELECT '### ' || cast(n AS string) || '. [' || title || '](' || url || ') — ' || cast(score_n AS string) || '/100' AS heading FROM n")
def report_sink(spark, d):
    """The headings of the report that is written for people, read back from its file."""
    from .. import cli
    from ..schema import ARCHIVE, strings
    from ..sources import files

    folder = _folder(spark, "desk")
    archive = A.archive(spark, d).withColumn("published_date", F.lit(""))
    archive.select(*ARCHIVE, "row_idx").write.parquet(f"{folder}/archive")
    desk = cli.Desk(spark, f"{folder}/archive", f"{folder}/tracker", S)
    files.Snapshots(spark, f"{folder}/tracker", desk.snapshots.columns).replace(spark.createDataFrame([], strings(desk.snapshots.columns)))
    desk.report(f"{folder}/report.md")
    lines = spark.read.text(f"{folder}/report.md").where("value LIKE '### %'")
    return lines.select(F.regexp_extract("value", "^(### .*/100)", 1).alias("heading"))


@query("SELECT lang AS query, arg_min(text, struct_pack(a := n_chars, b := doc_id)) AS markup FROM documents WHERE text <> '' AND NOT contains(text, chr(13)) GROUP BY lang")
def first_page_dump(spark, d):
    """The first page of each query, written as text to look at, and read back; documents stand for pages."""
    from ..sources import files

    rows = A.table(spark, d, "documents").where("text <> '' AND NOT contains(text, '\r')")
    folder = _folder(spark, "dump")
    files.dump_first_pages(rows.select(F.col("lang").alias("query"), F.col("n_chars").alias("page"), F.col("doc_id").alias("pos"), F.col("text").alias("raw")), folder)
    return spark.read.option("wholetext", "true").text(folder).select("query", F.regexp_replace("value", "\n$", "").alias("markup"))


# --- time -----------------------------------------------------------------------------------------------------------

MOMENT = "DATE '2024-01-01' + cast((cast(o_orderkey AS int) % 40) - 5 AS int)"


@query(
    f"WITH l AS (SELECT o_orderkey, cast({MOMENT} AS timestamp) AS ts, o_custkey % 160 AS user_id FROM orders), r AS (SELECT ts, user_id, {A.STATUS} AS status FROM events) "
    "SELECT o_orderkey, r.status AS status FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts"
)
def status_as_of(spark, d):
    """As-of join: the tracker's status at the moment that each order asks about, by user."""
    right = A.table(spark, d, "events").selectExpr("user_id", "cast(ts AS timestamp_ntz) AS ts", "event_id", f"{A.STATUS} AS status")
    left = A.table(spark, d, "orders").selectExpr("o_orderkey", "o_custkey % 160 AS user_id", f"cast({MOMENT} AS timestamp_ntz) AS ts")
    found = timejoins.as_of(left, right, "user_id", "ts", F.col("status"), "event_id", lambda t: F.date_trunc("day", t))
    return found.select("o_orderkey", F.col("found").alias("status"))


SPAN = "date_diff('day', DATE '1995-01-01', cast(o_orderdate AS date))"


@query("WITH days AS (SELECT DISTINCT cast(l_shipdate AS date) AS day FROM lineitem WHERE day(l_shipdate) = 1), spans AS (SELECT cast(o_orderdate AS date) AS a, cast(o_orderdate AS date) + cast(CASE WHEN o_orderkey % 97 = 0 THEN 900 ELSE 7 + o_orderkey % 50 END AS int) AS b FROM orders) SELECT day, count(*) AS n_open FROM days JOIN spans ON day BETWEEN a AND b GROUP BY day")
def open_roles_by_day(spark, d):
    """Interval join: roles that are open on the first of each month; one in 97 is open for 900 days."""
    days = A.table(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("day")).where(F.day("day") == 1).distinct().select("day", F.unix_date("day").alias("at"))
    a = F.unix_date(F.col("o_orderdate").cast("date"))
    spans = A.table(spark, d, "orders").select(a.alias("a"), (a + F.when(F.col("o_orderkey") % 97 == 0, 900).otherwise(7 + F.col("o_orderkey") % 50)).cast("int").alias("b"))
    return timejoins.within(days, spans, "at", "a", "b").groupBy("day").agg(F.count("*").alias("n_open"))


@query(f"WITH {A.KEYED}, m AS (SELECT substr(scraped_date, 1, 4) AS year, count(*) AS n, count(DISTINCT cu) AS n_urls FROM k GROUP BY 1) SELECT year, n, true AS same, true AS near FROM m")
def sketched_years(spark, d):
    """Sketches of each day merge to the same as those of the whole year, near the exact counts and ranks."""
    rows = A.archive(spark, d).select("scraped_date", "cu", "score_n", F.substring("scraped_date", 1, 4).alias("year"))
    by_day = sketches.sketched(rows, F.col("scraped_date"), F.col("cu"), F.col("score_n"))
    merged = sketches.estimates(sketches.merged(by_day.withColumn("year", F.substring("run", 1, 4)), "year"), 0.5)
    whole = sketches.estimates(sketches.sketched(rows, F.col("year"), F.col("cu"), F.col("score_n")), 0.5)
    exact = rows.groupBy("year").agg(F.count_distinct("cu").alias("urls"), F.percentile("score_n", F.lit(0.47)).alias("low"), F.percentile("score_n", F.lit(0.53)).alias("high"))
    both = merged.join(whole.select(F.col("run").alias("year"), F.col("n_urls").alias("hll"), F.col("n_urls_theta").alias("theta")), "year").join(exact, "year")
    same = (F.abs(F.col("n_urls") - F.col("hll")) <= 0.01 * F.col("hll")) & (F.abs(F.col("n_urls_theta") - F.col("theta")) <= 0.02 * F.col("theta"))
    near = (F.abs(F.col("n_urls") - F.col("urls")) <= 0.04 * F.col("urls") + 1) & (F.abs(F.col("n_urls_theta") - F.col("urls")) <= 0.04 * F.col("urls") + 1) & F.col("q50").between(F.floor("low") - 1, F.ceil("high") + 1)
    return both.select("year", "n", same.alias("same"), near.alias("near"))


@query("SELECT page_id, url FROM (SELECT *, row_number() OVER (PARTITION BY regexp_replace(lower(regexp_extract(url, '^https?://([^/]*)', 1)), '[^a-z0-9]', '', 'g') ORDER BY page_id) AS m FROM pages) WHERE m = 1")
def stream_first_arrivals(spark, d):
    """Pages as a stream of teasers, the first of each host, which stands for the company of one role."""
    folder = _folder(spark, "arrivals")
    table = A.table(spark, d, "pages")
    table.write.parquet(f"{folder}/in")  # a stream of files is read from a folder
    pages = spark.readStream.schema(table.schema).parquet(f"{folder}/in")
    host = F.regexp_extract("url", "^https?://([^/]*)", 1)
    teasers = pages.select(F.col("page_id").alias("row_idx"), F.lit("role").alias("title"), host.alias("company"), F.lit("").alias("published_date"), "url")
    found = arrivals.first_arrivals(teasers, S).select(F.col("row_idx").alias("page_id"), "url")
    run = found.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{folder}/rows")

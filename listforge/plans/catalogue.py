"""Every query of the engine by name, with its DuckDB counterpart where SQL can express it."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import BODY_SOURCES, EMPLOYMENT_TYPES, EXCLUDE_TERMS, TRACKS, WORK_MODES
from ..functions import dates, jsonx, render, text
from ..operators import dedup, external, filters, lookups, stats, views
from ..sources import api, cards, pages
from . import adapter as A
from .base import ORACLE_SQL, QUERIES, S, query, sql_values, values  # noqa: F401

# --- shortlist and archive ------------------------------------------------------------------------------------------

SHORT_COLUMNS = "row_idx, cu, score_n, days_left, first_idx"


@query(f"WITH {A.SHORT} SELECT {SHORT_COLUMNS} FROM short")
def open_shortlist(spark, d):
    """Best row of each URL, view filters, urgency order."""
    return views.open_shortlist(A.archive(spark, d), S).select(*SHORT_COLUMNS.split(", "))


@query(f"WITH {A.BEST} SELECT cu, row_idx, score_n FROM best")
def best_per_url(spark, d):
    """D2."""
    return dedup.best_per_url(A.archive(spark, d)).select("cu", "row_idx", "score_n")


@query(f"WITH {A.KEYED} SELECT cu, min(row_idx) AS first_idx FROM k GROUP BY cu")
def first_seen_position(spark, d):
    """Where a URL first appears, whichever row wins."""
    return dedup.best_per_url(A.archive(spark, d)).select("cu", "first_idx")


@query("SELECT page_id, CASE WHEN q = '' THEN base ELSE base || '?' || q END AS cu FROM (SELECT page_id, regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '/+$', '') AS base, list_aggregate(list_sort(list_filter(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_source|utm_medium|utm_campaign|utm_content|utm_term|source|trid|rx_campaign|codes|gh_src|ref|referrer|mc_cid|mc_eid|fbclid|gclid)='))), 'string_agg', '&') AS q FROM (SELECT page_id, regexp_replace(lower(url[:position('/' IN url[9:]) + 8]), '://www[.]', '://') || url[position('/' IN url[9:]) + 9:] AS url FROM pages)) WHERE true".replace("CASE WHEN q = ''", "CASE WHEN coalesce(q, '') = ''"))
def canonical_url_pages(spark, d):
    """E1 E24 O7."""
    return A.table(spark, d, "pages").select("page_id", text.canonical_url(F.col("url")).alias("cu"))


@query("WITH p AS (SELECT page_id, url AS cu FROM pages), s AS (SELECT cu FROM p WHERE page_id % 2 = 0) SELECT page_id, cu FROM p WHERE cu <> '' AND NOT EXISTS (SELECT 1 FROM s WHERE s.cu = p.cu)")
def unseen_teasers(spark, d):
    """Pages that aren't in the half that was seen (raw URLs as keys)."""
    pages_ = A.table(spark, d, "pages").select("page_id", F.col("url").alias("cu"))
    return lookups.unseen(pages_, pages_.where("page_id % 2 = 0")).select("page_id", "cu")


@query(None)
def greedy_role_dedup(spark, d):
    """D1; tested against a sequential reader."""
    rows = A.archive(spark, d).withColumn("rk", text.role_key(F.concat("company", F.lit(" "), "location"), F.col("title")))
    return dedup.greedy_two_keys(rows).select("row_idx", "cu", "rk")


@query("SELECT page_id, url FROM (SELECT *, row_number() OVER (PARTITION BY regexp_extract(url, '^https?://([^/]*)', 1) ORDER BY page_id) AS n FROM pages) WHERE n = 1")
def first_per_source_url(spark, d):
    """D3: the first page of each host."""
    rows = A.table(spark, d, "pages").select("page_id", "url", F.regexp_extract("url", "^https?://([^/]*)", 1).alias("host"))
    return dedup.first_per(rows, "host", order="page_id").select("page_id", "url")


@query("SELECT 'c' AS kind, c_custkey AS id, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') || '|' || regexp_replace(lower(c_mktsegment), '[^a-z0-9]', '', 'g') AS rk FROM customer UNION ALL SELECT 'p', p_partkey, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') || '|' || regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') FROM part")
def role_key_norm(spark, d):
    """E2."""
    c = A.table(spark, d, "customer").select(F.lit("c").alias("kind"), F.col("c_custkey").alias("id"), text.role_key(F.col("c_name"), F.col("c_mktsegment")).alias("rk"))
    p = A.table(spark, d, "part").select(F.lit("p").alias("kind"), F.col("p_partkey").alias("id"), text.role_key(F.col("p_brand"), F.col("p_name")).alias("rk"))
    return c.unionByName(p)


# --- predicates -----------------------------------------------------------------------------------------------------


def _like(column: str, terms) -> str:
    return "(" + " OR ".join(f"contains({column}, '{t}')" for t in terms) + ")"


TITLE = "' ' || left(text, 40) || ' '"
KEYWORDS = f"{_like('lower(' + chr(39) + ' ' + chr(39) + ' || left(text, 40) || ' + chr(39) + ' ' + chr(39) + ' || text || ' + chr(39) + ' ' + chr(39) + ')', S.include_terms)}"


@query(f"SELECT doc_id FROM documents WHERE {KEYWORDS} AND NOT {_like(f'lower({TITLE})', EXCLUDE_TERMS)}")
def keyword_prefilter(spark, d):
    """F1 F2: title is a document's first 40 characters, snippet its text."""
    return A.table(spark, d, "documents").where(filters.passes_keywords(F.substring("text", 1, 40), F.col("text"), S)).select("doc_id")


@query(f"SELECT doc_id, lang FROM documents WHERE CASE WHEN lang = 'en' THEN NOT {_like(f'lower({TITLE})', EXCLUDE_TERMS)} ELSE {KEYWORDS} AND NOT {_like(f'lower({TITLE})', EXCLUDE_TERMS)} END")
def source_policy_filter(spark, d):
    """English documents stand for the API source."""
    site = F.when(F.col("lang") == "en", "hub").otherwise("board")
    return A.table(spark, d, "documents").where(filters.passes_source_policy(site, F.substring("text", 1, 40), F.col("text"), S)).select("doc_id", "lang")


COMPANIES = [(1, "Københavns Kommune"), (2, "Politiet"), (3, "Data ApS"), (4, ""), (5, None), (6, "Aarhus kommune")]


@query(f"SELECT id, name FROM {sql_values(COMPANIES, 'id, name')} WHERE NOT (contains(lower(coalesce(name, '')), 'kommune') OR contains(lower(coalesce(name, '')), 'politi') OR contains(lower(coalesce(name, '')), 'forsvaret') OR contains(lower(coalesce(name, '')), 'copenhagen municipality')) UNION ALL SELECT s_suppkey, s_name FROM supplier")
def excluded_company(spark, d):
    """F4."""
    rows = values(spark, COMPANIES, "id long, name string").unionByName(A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))
    return rows.where(~filters.excluded_company(F.col("name"), S))


@query("SELECT o_orderkey FROM orders WHERE cast(o_orderdate AS date) >= DATE '1998-06-07'")
def recency_filter(spark, d):
    """F5 E4."""
    published = F.col("o_orderdate").cast("date").cast("string")
    return A.table(spark, d, "orders").where(dates.is_recent(published, S.today, S.max_days_old)).select("o_orderkey")


@query(f"WITH {A.KEYED} SELECT row_idx, {A.OPEN} AS is_open, {A.DAYS} AS days_left FROM k")
def open_status_days_left(spark, d):
    """F11 E5."""
    return A.archive(spark, d).select("row_idx", filters.open_listing(S).alias("is_open"), dates.days_left(F.col("deadline"), S.today).alias("days_left"))


DEADLINES = [(1, "Ansøgningsfrist: 1. januar 1998"), (2, "deadline 5/6-98"), (3, "Frist: 1. january 1990"), (4, "frist 31.02.1990"), (5, "no date"), (6, "Deadline: 15-6-1998"), (7, "frist 14.06.1998 and frist 1.1.2099"), (8, "ANSØGNINGSFRIST 1. MARTS 1997"), (9, None)]
MONTH_CASE = "CASE lower(m) " + " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(dates.MONTHS, 1)) + " ELSE CASE WHEN regexp_matches(m, '^[0-9]{1,2}$') THEN cast(m AS int) END END"
PATTERN = "(?i)(?:ans[øo]gningsfrist|frist|deadline)[:\\s]*([0-9]{1,2})[.\\s/-]\\s*([0-9]{1,2}|[0-9a-zæøå_]+)[.\\s/-]\\s*([0-9]{2,4})"


@query(
    f"SELECT id, coalesce(try_cast(printf('%04d-%02d-%02d', CASE WHEN y < 100 THEN y + 2000 ELSE y END, mon, day) AS date) < {A.TODAY}, false) AS passed FROM (SELECT id, try_cast(d AS int) AS day, {MONTH_CASE} AS mon, try_cast(y AS int) AS y FROM (SELECT id, regexp_extract(t, '{PATTERN}', 1) AS d, regexp_extract(t, '{PATTERN}', 2) AS m, regexp_extract(t, '{PATTERN}', 3) AS y FROM {sql_values(DEADLINES, 'id, t')}))"
    + " UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN cast(o_orderdate AS date) < DATE '1998-06-15' ELSE false END FROM orders"
)
def deadline_text_gate(spark, d):
    """Odd texts, and orders whose dates are written out, written with two digits for the year, or not at all."""
    day, key = F.col("o_orderdate").cast("date"), F.col("o_orderkey")
    month = F.element_at(F.array(*[F.lit(m) for m in dates.MONTHS]), F.month(day))
    long = F.concat(F.lit("Søg nu. Ansøgningsfrist: "), F.dayofmonth(day), F.lit(". "), month, F.lit(" "), F.year(day))
    short = F.concat(F.lit("deadline "), F.dayofmonth(day), F.lit("/"), F.month(day), F.lit("-"), F.date_format(day, "yy"))
    orders = A.table(spark, d, "orders").select(key.alias("id"), F.when(key % 3 == 0, long).when(key % 3 == 1, short).otherwise("no date").alias("t"))
    return values(spark, DEADLINES, "id long, t string").unionByName(orders).select("id", dates.deadline_passed(F.col("t"), S.today).alias("passed"))


DANISH = [(-1, "Vi søger en medarbejder med erfaring og lyst til arbejde som udvikler"), (-2, "og og er"), (-3, "we are looking for you and the team with experience to apply og er til")]


def _hits(terms) -> str:
    return " + ".join(f"cast((length(s) - length(replace(s, '{t}', ''))) / {len(t)} AS int)" for t in terms)


@query(f"SELECT id, da, en, CASE WHEN n < 40 THEN false ELSE da > 0 AND en < greatest(3, da * 0.3) END AS danish FROM (SELECT id, n, {_hits(text.DANISH + text.DANISH_LETTERS)} AS da, {_hits(text.ENGLISH)} AS en FROM (SELECT id, length(t) AS n, ' ' || lower(t) || ' ' AS s FROM (SELECT id, trim(t, ' \t\n\r') AS t FROM (SELECT doc_id AS id, text AS t FROM documents UNION ALL SELECT * FROM {sql_values(DANISH, 'id, t')}))))")
def danish_marker_score(spark, d):
    """E8 E9 F13, without a detector."""
    rows = A.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("t")).unionByName(values(spark, DANISH, "id long, t string"))
    marks = F.col("marks")
    return rows.withColumn("marks", text.danish_marks(F.col("t"))).select("id", marks[0]["da"].alias("da"), marks[0]["en"].alias("en"), text.looks_danish(F.col("t"), marks=marks).alias("danish"))


# --- markup and JSON ------------------------------------------------------------------------------------------------


def _text_sql(c: str) -> str:
    bare = f"regexp_replace(regexp_replace({c}, '(?s)<!--.*?-->', '', 'g'), '(?is)<script\\b[^>]*>.*?</script>|<style\\b[^>]*>.*?</style>', '', 'g')"
    out = f"regexp_replace({bare}, '<[^>]+>', chr(10), 'g')"
    for a, b in text.ENTITIES:
        out = f"replace({out}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    return f"substr(regexp_replace(regexp_replace({out}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g'), 1, 6000)"


@query(f"SELECT page_id, {_text_sql('html')} AS body FROM pages")
def html_to_text(spark, d):
    """E3 O8."""
    return A.table(spark, d, "pages").select("page_id", text.html_to_text(F.col("html")).alias("body"))


@query("SELECT page_id, title, company, location, published_date, snippet, url, 'board' AS source_site FROM (SELECT page_id, " + pages.TITLE_SQL + " AS title, 'N/A' AS company, 'N/A' AS location, 'N/A' AS published_date, " + pages.SNIPPET_SQL + " AS snippet, url FROM pages) WHERE title <> '' AND url <> ''")
def page_card_teasers(spark, d):
    """A teaser from each page's title and paragraphs."""
    return pages.page_teasers(A.table(spark, d, "pages"))


SCORES = [(1, '{"score": 85, "track": "A"}'), (2, '{"score":"85"}'), (3, '{"score":85.7}'), (4, "{}"), (5, 'so: ```{"score": 70, "track":"B"}``` ok'), (6, '{"score": 70, "track": "A"'), (7, "no"), (8, '{"score":1,"danish_required":true}'), (9, ""), (10, None), (11, '{"score": 3, "commute_ok": false, "danish_level": "Preferred "}')]
EXPECTED = [(1, 85, "A", "none", 1, ""), (2, 85, "none", "none", 1, ""), (3, 85, "none", "none", 1, ""), (4, 0, "none", "none", 1, ""), (5, 70, "B", "none", 1, ""), (6, 70, "A", "none", 1, "regex fallback"), (7, None, None, None, None, None), (8, 1, "none", "required", 1, ""), (9, None, None, None, None, None), (10, None, None, None, None, None), (11, 3, "none", "preferred", 0, "")]


@query(f"SELECT event_id AS id, 0 AS score, 'none' AS track, 'none' AS danish_level, 1 AS commute, '' AS reasoning, cast(json_extract_string(props, '$.k') AS int) AS k FROM events UNION ALL SELECT -id, score, track, danish_level, commute, reasoning, NULL FROM {sql_values(EXPECTED, 'id, score, track, danish_level, commute, reasoning')}")
def json_score_extract(spark, d):
    """Raw answers (negative ids), and the events' properties, which have no score."""
    rows = A.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("props").alias("raw")).unionByName(values(spark, SCORES, "id long, raw string").withColumn("id", -F.col("id")))
    s = rows.withColumn("s", jsonx.parse_score(F.col("raw")))
    k = F.when(F.col("id") >= 0, jsonx.whole_number(F.get_json_object("raw", "$.k")))
    return s.select("id", *[F.col(f"s.{c}").alias(c) for c in ("score", "track", "danish_level")], F.col("s.commute_ok").cast("int").alias("commute"), F.col("s.reasoning").alias("reasoning"), k.alias("k"))


ANSWERS = [(1, '{"docs":[{"id":"a"},{"id":"b"}]}'), (2, '[{"id":"c"}]'), (3, '{"jobs":{"docs":[{"id":"d"}]},"featuredJobs":{"docs":[{"id":"e"}]},"docs":[{"id":"x"}]}'), (4, '{"hits":3,"results":[{"id":"f"}]}'), (5, '{"docs":[]}'), (6, "3")]


@query("SELECT * FROM (VALUES (-1, 0, 'a'), (-1, 1, 'b'), (-2, 0, 'c'), (-3, 0, 'd'), (-3, 1, 'e'), (-4, 0, 'f')) v(id, pos, job) UNION ALL SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1, cast(o_orderkey AS string) FROM orders WHERE o_custkey % 5 <> 4")
def json_list_explode(spark, d):
    """Odd answers, and the orders of each customer in lists of all shapes."""
    key = F.col("o_custkey")
    each = A.table(spark, d, "orders").groupBy(key).agg(F.sort_array(F.collect_list("o_orderkey")).alias("ks"))
    docs = F.concat(F.lit("["), F.array_join(F.transform("ks", lambda k: F.concat(F.lit('{"id":"'), k, F.lit('"}'))), ","), F.lit("]"))
    shape = F.when(key % 5 == 0, docs).when(key % 5 == 1, F.concat(F.lit('{"docs":'), docs, F.lit("}"))).when(key % 5 == 2, F.concat(F.lit('{"jobs":{"docs":[]},"featuredJobs":{"docs":'), docs, F.lit("}}")))
    shape = shape.when(key % 5 == 3, F.concat(F.lit('{"n":1,"items":'), docs, F.lit("}"))).otherwise(F.concat(F.lit('{"others":'), docs, F.lit("}")))
    rows = values(spark, [(-i, raw) for i, raw in ANSWERS], "id long, raw string").unionByName(each.select(key.cast("long").alias("id"), shape.alias("raw")))
    out = rows.select("id", F.posexplode(jsonx.listed(F.col("raw"))).alias("pos", "job"))
    return out.select("id", "pos", F.get_json_object("job", "$.id").alias("job"))


JOBS = [(1, '{"id":"7","title":"Dev","company":{"name":"Co"},"location":{"locality":"Aarhus"},"description":"<p>short</p>"}'), (2, '{"headline":" X ","employer":"E","city":["A","","B"],"link":{"href":"https://u/1"},"createdAt":"2026-01-05T10:00"}'), (3, '{"title":"","name":"N","uuid":"9","company":{},"description":"' + "y" * 201 + '"}'), (4, '{"company":"none"}')]


@query("SELECT * FROM (VALUES (1, 'Dev', 'Co', 'Aarhus', 'N/A', 'short', 'https://hub.example/jobs/7', NULL), (2, 'X', 'E', 'A, B', '2026-01-05', '', 'https://u/1', NULL), (3, 'N', 'N/A', 'N/A', 'N/A', repeat('y', 201), 'https://hub.example/jobs/9', 'full')) v(id, title, company, location, published_date, snippet, url, source)")
def json_teaser_map(spark, d):
    """S5 F16."""
    rows = values(spark, JOBS, "id int, raw string")
    out = rows.select("id", *[c.alias(n) for n, c in jsonx.teaser_columns(F.col("raw"), "https://hub.example/jobs/").items()])
    return out.where("title <> '' and url <> ''").select("id", "title", "company", "location", "published_date", "snippet", "url", "source")


@query("SELECT o_orderkey AS id, cast(o_orderkey % 101 AS int) AS score, (SELECT count(*) FROM orders WHERE o_orderkey % 4 <> 0) AS n_errors FROM orders WHERE o_orderkey % 4 = 0")
def error_rows_dropped(spark, d):
    """Failed scorings take the sentinel, are counted, and aren't stored."""
    key = F.col("o_orderkey")
    raw = F.when(key % 4 == 0, F.concat(F.lit('Here it is: {"score": '), key % 101, F.lit("}"))).when(key % 4 == 1, "junk").when(key % 4 == 2, "").otherwise('{"score": "x"}')
    rows = A.table(spark, d, "orders").select(key.alias("id"), F.coalesce(jsonx.parse_score(raw), jsonx.scoring_error()).alias("s")).select("id", "s.*")
    errors = rows.agg(F.count_if(F.col("reasoning") == jsonx.ERROR).alias("n_errors"))
    return filters.without_errors(rows).select("id", "score").crossJoin(F.broadcast(errors))


# --- report ---------------------------------------------------------------------------------------------------------


def _dist_sql(value: str, domain) -> str:
    dom = ", ".join(f"({i}, '{v}')" for i, v in enumerate(domain))
    return f"WITH {A.KEYED}, c AS (SELECT {value} AS value, count(*) AS n FROM k GROUP BY 1) SELECT ord, dom.value AS value, coalesce(n, 0) AS n FROM (VALUES {dom}) dom(ord, value) LEFT JOIN c ON c.value = dom.value"


def _dist(spark, d, value, domain):
    return stats.distribution(A.archive(spark, d), value, domain).select("ord", "value", "n")


@query(_dist_sql("CASE WHEN score_n >= 85 THEN '85-100' WHEN score_n >= 75 THEN '75-84' WHEN score_n >= 50 THEN '50-74' ELSE '0-49' END", stats.BUCKETS))
def score_buckets(spark, d):
    """A2."""
    return _dist(spark, d, stats.bucket(F.col("score_n")), stats.BUCKETS)


@query(_dist_sql("track", TRACKS))
def track_dist(spark, d):
    """A3."""
    return _dist(spark, d, F.col("track"), TRACKS)


@query(f"WITH {A.KEYED} SELECT count(*) FILTER (WHERE track = 'A') AS n_a, count(*) FILTER (WHERE track = 'B') AS n_b FROM k WHERE {A.MATCH}")
def track_split(spark, d):
    """A5."""
    return stats.track_split(A.archive(spark, d), S)


@query(_dist_sql("employment_type", EMPLOYMENT_TYPES))
def type_dist(spark, d):
    """A3 A14."""
    return _dist(spark, d, F.col("employment_type"), EMPLOYMENT_TYPES)


@query(_dist_sql("work_mode", WORK_MODES))
def work_mode_dist(spark, d):
    """A3."""
    return _dist(spark, d, F.col("work_mode"), WORK_MODES)


@query(_dist_sql("source", BODY_SOURCES))
def source_dist(spark, d):
    """A3 A12."""
    return _dist(spark, d, F.col("source"), BODY_SOURCES)


@query(f"WITH {A.KEYED}, c AS (SELECT track AS value, count(*) AS n FROM k GROUP BY 1), m AS (SELECT max(n) AS most FROM c) SELECT value, n, repeat('█', CASE WHEN (68 * n) % most = 0 AND ((68 * n) // most) % 2 = 1 THEN cast(((34 * n) // most) + ((34 * n) // most) % 2 AS int) ELSE cast((68 * n + most) // (2 * most) AS int) END) AS bar FROM c, m")
def dist_bars(spark, d):
    """A3 E16."""
    return stats.distribution(A.archive(spark, d), F.col("track"), TRACKS).select("value", "n", "bar")


@query(f"WITH {A.KEYED}, c AS (SELECT track AS value, count(*) AS n, min(row_idx) AS f FROM k GROUP BY 1) SELECT value, n, cast(row_number() OVER (ORDER BY n DESC, f) AS int) AS place FROM c")
def dist_by_frequency(spark, d):
    """A4: with the place of each value."""
    rows = stats.by_frequency(A.archive(spark, d), F.col("track"))
    return rows.select("value", "n", F.row_number().over(Window.orderBy(F.desc("n"), "first_idx")).alias("place"))


@query(f"WITH {A.KEYED} SELECT count(*) AS n_rows, count(DISTINCT url) AS n_urls, count(*) - count(DISTINCT url) AS n_duplicates, count(DISTINCT scraped_date) AS n_dates, min(scraped_date) AS first_date, max(scraped_date) AS last_date, count(*) FILTER (WHERE {A.MATCH}) AS n_matches, count(*) FILTER (WHERE {A.TARGET} AND NOT {A.OPEN}) AS n_closed, count(*) FILTER (WHERE score_n >= 75 AND NOT ({A.TARGET})) AS n_outside FROM k")
def overview_counts(spark, d):
    """A1 D4 D5."""
    return stats.overview(A.archive(spark, d), S)


@query(f"WITH {A.KEYED} SELECT count(*) AS n_rows, count(*) FILTER (WHERE danish_level = 'required') AS n_required, count(*) FILTER (WHERE {A.MATCH}) AS n_matches, count(*) FILTER (WHERE {A.MATCH} AND danish_level = 'required') AS n_required_matches, count(*) FILTER (WHERE {A.MATCH} AND danish_level = 'preferred') AS n_preferred_matches FROM k")
def danish_rates(spark, d):
    """A6."""
    return stats.language_rates(A.archive(spark, d), S)


def _half_even(part: str, whole: str) -> str:
    q = f"((200 * {part}) // {whole})"
    return f"CASE WHEN (200 * {part}) % {whole} = 0 AND {q} % 2 = 1 THEN {q} // 2 + ({q} // 2) % 2 ELSE (200 * {part} + {whole}) // (2 * {whole}) END"


@query(f"WITH {A.KEYED}, c AS (SELECT count(*) FILTER (WHERE danish_level = 'required') AS r, count(*) AS n FROM k) SELECT cast({_half_even('r', 'n')} AS int) AS pct FROM c")
def pct_rates(spark, d):
    """E17."""
    return stats.language_rates(A.archive(spark, d), S).select(text.percent(F.col("n_required"), F.col("n_rows")).alias("pct"))


@query(f"WITH {A.KEYED} SELECT count(*) AS n, count(*) FILTER (WHERE is_tech_company = 'True') AS n_true FROM k WHERE {A.MATCH}")
def tech_rate(spark, d):
    """A7."""
    return stats.tech_rate(A.archive(spark, d), S)


@query(f"WITH {A.KEYED} SELECT company, n, n_matches FROM (SELECT company, count(*) AS n, count(*) FILTER (WHERE {A.MATCH}) AS n_matches, min(row_idx) AS f FROM k WHERE company <> '' GROUP BY company HAVING count(*) >= 2 ORDER BY n DESC, f LIMIT 15)")
def recurring_companies(spark, d):
    """A8 J5 O4."""
    return stats.recurring_companies(A.archive(spark, d), S).select("company", "n", "n_matches")


@query(f"WITH {A.KEYED} SELECT 'm' || substr(scraped_date, 1, 7) AS day, count(*) AS n, count(*) FILTER (WHERE score_n >= 75) AS n_high FROM k GROUP BY 1 UNION ALL SELECT 'd' || cast(cast(ts AS date) AS string), count(*), count(*) FILTER (WHERE value >= 75) FROM events GROUP BY 1")
def drift_by_date(spark, d):
    """The archive by month, events by day."""
    archive = stats.drift(A.archive(spark, d), F.concat(F.lit("m"), F.substring("scraped_date", 1, 7)), F.col("score_n"), S)
    events = stats.drift(A.table(spark, d, "events"), F.concat(F.lit("d"), F.col("ts").cast("date").cast("string")), F.col("value"), S)
    return archive.unionByName(events).select("day", "n", "n_high")


@query(f"WITH {A.KEYED} SELECT row_idx, score_n FROM k WHERE score_n >= 75 AND NOT ({A.TARGET}) ORDER BY score_n DESC, row_idx LIMIT 15")
def high_fit_outside(spark, d):
    """J6 O3."""
    return stats.outside_targets(A.archive(spark, d), S).select("row_idx", "score_n")


@query(f"WITH {A.KEYED} SELECT row_idx, score_n FROM k WHERE {A.MATCH}")
def top_matches(spark, d):
    """O2."""
    archive = A.archive(spark, d)
    return archive.where(views.matches(archive, S)).orderBy(F.desc("score_n"), "row_idx").select("row_idx", "score_n")


@query(f"WITH {A.KEYED} SELECT row_idx FROM k WHERE score_n >= 75 AND employment_type IN ('student', 'part_time', 'internship', 'unknown')")
def console_matches(spark, d):
    """F15."""
    return views.console_matches(A.archive(spark, d), S).select("row_idx")


# --- tracker --------------------------------------------------------------------------------------------------------

NUMBERED = f"{A.SHORT}, numbered AS (SELECT *, cast(row_number() OVER (ORDER BY days_left ASC NULLS LAST, score_n DESC, first_idx) AS int) AS n FROM short)"


@query(f"WITH {NUMBERED}, {A.STATUSES} SELECT n, row_idx, coalesce(status, 'new') AS kind, coalesce(status, 'new') IN ('new', 'interested') AS actionable FROM numbered LEFT JOIN st ON st.cu = numbered.cu")
def shortlist_with_status(spark, d):
    """J2 E21 X7."""
    short = views.numbered(views.shortlist_rows(A.archive(spark, d), S))
    return lookups.with_status(short, A.tracker(spark, d)).select("n", "row_idx", "kind", "actionable")


@query(f"WITH {NUMBERED}, {A.STATUSES} SELECT n, row_idx FROM numbered LEFT JOIN st ON st.cu = numbered.cu WHERE coalesce(status, 'new') IN ('new', 'interested')")
def actionable_only(spark, d):
    """Numbers are given before rows are left out."""
    return shortlist_with_status(spark, d).where("actionable").select("n", "row_idx")


@query(f"WITH {NUMBERED} SELECT n, row_idx FROM numbered WHERE n = 3")
def nth_shortlist_item(spark, d):
    """J7."""
    return views.numbered(views.shortlist_rows(A.archive(spark, d), S)).where("n = 3").select("n", "row_idx")


@query(f"WITH {A.KEYED}, t AS ({A.TRACKER_SQL}) SELECT row_idx FROM k WHERE cu IN (SELECT cu FROM t)")
def tracker_semi(spark, d):
    """J3."""
    return lookups.tracked(A.archive(spark, d), A.tracker(spark, d)).select("row_idx")


@query(f"WITH {A.BEST} SELECT row_idx, score_n FROM best WHERE cu = 'https://ex.com/jobs/77'")
def archive_lookup(spark, d):
    """J4."""
    return lookups.archive_row(A.archive(spark, d), "https://ex.com/jobs/77").select("row_idx", "score_n")


@query(f"WITH t AS ({A.TRACKER_SQL}) SELECT row_idx, cu, CASE WHEN cu = 'https://ex.com/jobs/5' THEN 'offer' ELSE status END AS status FROM t")
def status_update(spark, d):
    """X4."""
    return lookups.update_status(A.tracker(spark, d), "https://ex.com/jobs/5", "offer")


@query(f"WITH {A.BEST}, t AS ({A.TRACKER_SQL}) SELECT cu, status, CAST(NULL AS string) AS next_followup FROM t UNION ALL SELECT cu, 'interested', '1998-06-22' FROM best WHERE cu NOT IN (SELECT cu FROM t)")
def tracker_insert_if_absent(spark, d):
    """X5 P6 S14."""
    tracker = A.tracker(spark, d).select("cu", "status", F.lit(None).cast("string").alias("next_followup"))
    followup = F.date_add(F.lit(S.today), 7).cast("string")
    new = dedup.best_per_url(A.archive(spark, d)).select("cu", F.lit("interested").alias("status"), followup.alias("next_followup"))
    return lookups.insert_absent(tracker, new)


# --- projections ----------------------------------------------------------------------------------------------------


@query(f"WITH {A.KEYED} SELECT row_idx, '1998-06-15' AS scraped_date, array_to_string(['sql', lower(substr(matched_skills, 6))], '; ') AS matched_skills, CASE WHEN location = 'N/A' THEN '' ELSE location END AS location, score_n AS score FROM k")
def archive_projection(spark, d):
    """The scored record's fields win over the teaser's, lists are joined."""
    scored = A.archive(spark, d).select("row_idx", text.skills(F.col("matched_skills")).alias("list"), F.when(F.col("location") != "N/A", F.col("location")).otherwise("").alias("location"), F.col("score_n").alias("score"))
    return scored.select("row_idx", F.lit(str(S.today)).alias("scraped_date"), F.array_join("list", "; ").alias("matched_skills"), "location", "score")


@query("SELECT doc_id, CASE WHEN l.doc_id IS NOT NULL AND text <> '' THEN text ELSE left(text, 20) || chr(10) || source || chr(10) || lang END AS body, CASE WHEN l.doc_id IS NOT NULL AND text <> '' THEN 'full' ELSE 'snippet' END AS body_source FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)".replace("l.doc_id IS NOT NULL", "l.got"). replace("SELECT DISTINCT doc_id FROM", "SELECT DISTINCT doc_id, true AS got FROM"))
def body_fallback(spark, d):
    """Labelled documents were fetched; the others fall back to title, company and snippet."""
    got = A.table(spark, d, "labels").select("doc_id", F.lit(True).alias("got")).distinct()
    rows = A.table(spark, d, "documents").join(got, "doc_id", "left")
    rows = rows.select("doc_id", F.when(F.col("got"), F.col("text")).alias("fetched"), F.substring("text", 1, 20).alias("title"), F.col("source").alias("company"), F.col("lang").alias("snippet"))
    return external.with_body(rows).select("doc_id", "body", F.col("source").alias("body_source"))


@query(f"WITH {A.KEYED} SELECT row_idx, CASE WHEN location = 'N/A' THEN company ELSE location END AS location FROM k")
def fill_blanks(spark, d):
    """P5 E18."""
    return A.archive(spark, d).select("row_idx", text.filled(F.col("location"), F.col("company")).alias("location"))


@query("SELECT CASE WHEN n_chars > 200 THEN 'preloaded' ELSE 'to_fetch' END AS part, count(*) AS n FROM documents GROUP BY 1")
def split_preloaded(spark, d):
    """X3 F16."""
    return A.table(spark, d, "documents").groupBy(F.when(F.col("n_chars") > jsonx.BODY_OVER, "preloaded").otherwise("to_fetch").alias("part")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey, CASE WHEN s = '' THEN 'role' ELSE s END AS slug FROM (SELECT c_custkey, left(trim(regexp_replace(regexp_replace(c_name || ' -_' || c_mktsegment, '[^\\w\\s-]', '', 'g'), '[\\s_-]+', '_', 'g'), '_'), 50) AS s FROM customer)")
def slugs(spark, d):
    """E14."""
    return A.table(spark, d, "customer").select("c_custkey", text.slug(F.concat("c_name", F.lit(" -_"), "c_mktsegment")).alias("slug"))


LISTS = [(1, "a; b ;; c"), (2, ""), (3, None)]


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN '_(none extracted)_' ELSE '- ' || c_name || chr(10) || '- ' || c_mktsegment END AS list FROM customer UNION ALL SELECT * FROM (VALUES (-1, '- a' || chr(10) || '- b' || chr(10) || '- c'), (-2, '_(none extracted)_'), (-3, '_(none extracted)_')) v(id, list)")
def bullet_lists(spark, d):
    """E15 E23."""
    joined = F.when(F.col("c_custkey") % 7 == 0, " ; ;").otherwise(F.concat("c_name", F.lit(" ;; "), "c_mktsegment", F.lit("; ")))
    rows = A.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), joined.alias("s")).unionByName(values(spark, [(-i, t) for i, t in LISTS], "id long, s string"))
    return rows.select("id", text.bullets(text.skills(F.col("s"))).alias("list"))


DUE = "CASE WHEN days_left IS NULL THEN NULL WHEN days_left <= 0 THEN '⏰ closes today (' || deadline || ')' WHEN days_left <= 7 THEN '⏰ closes in ' || cast(days_left AS string) || 'd (' || deadline || ')' ELSE 'deadline ' || deadline || ' (' || cast(days_left AS string) || 'd)' END"


@query(f"WITH {A.SHORT} SELECT row_idx, concat_ws(' · ', CASE WHEN employment_type <> 'unknown' THEN employment_type END, CASE WHEN work_mode <> 'unknown' THEN work_mode END, CASE WHEN location <> 'N/A' THEN location END, CASE WHEN danish_level = 'preferred' THEN 'Danish a plus' END, {DUE}) AS meta, CASE WHEN track = 'A' THEN 'Technical' ELSE 'Foot-in-door' END || CASE WHEN source = 'snippet' THEN ' · ⚠ teaser only' ELSE '' END AS badge, CASE WHEN days_left IS NULL THEN 'no deadline' ELSE 'closes in ' || cast(days_left AS string) || 'd' END AS due FROM short")
def report_meta_line(spark, d):
    """E20 E22."""
    return views.shortlist_rows(A.archive(spark, d), S).select("row_idx", render.meta_line().alias("meta"), render.badge().alias("badge"), render.when_phrase().alias("due"))


@query(f"WITH {A.SHORT} SELECT row_idx, '  ' || lpad(cast(score_n AS string), 3, ' ') || '  ' || rpad(track, 4, ' ') || ' ' || rpad(employment_type, 10, ' ') || ' ' || rpad(left(company, 22), 22, ' ') || ' ' || left(title, 54) || CASE WHEN f = '' THEN '' ELSE '  [' || f || ']' END AS line FROM (SELECT *, concat_ws(', ', CASE danish_level WHEN 'preferred' THEN 'DK plus' END, CASE WHEN days_left IS NOT NULL THEN 'due ' || deadline END, CASE source WHEN 'snippet' THEN 'teaser-only' END) AS f FROM short)")
def report_row_line(spark, d):
    """E19."""
    return views.shortlist_rows(A.archive(spark, d), S).select("row_idx", render.row_line().alias("line"))


# --- sources and runs -----------------------------------------------------------------------------------------------


@query("SELECT source_site, count(*) AS n FROM (SELECT s_name AS name, 'board' AS source_site FROM supplier UNION ALL SELECT c_name, 'hub' FROM customer) GROUP BY 1")
def union_sources(spark, d):
    """S7 U4 X1 A11."""
    from ..sources.registry import union

    found, failed = union({
        "board": lambda: A.table(spark, d, "supplier").select(F.col("s_name").alias("title"), F.lit("board").alias("source_site")),
        "hub": lambda: A.table(spark, d, "customer").select(F.col("c_name").alias("title"), F.lit("hub").alias("source_site"), F.lit("x").alias("description")),
    })
    return found.groupBy("source_site").agg(F.count("*").alias("n"))


@query("SELECT lang AS source_site, count(*) AS n_teasers, count(*) FILTER (WHERE p) AS n_prefiltered, count(*) FILTER (WHERE p AND n_chars > 200) AS n_preloaded FROM (SELECT lang, n_chars, " + f"{KEYWORDS} AND NOT {_like(f'lower({TITLE})', EXCLUDE_TERMS)} AS p FROM documents) GROUP BY 1")
def funnel_counters(spark, d):
    """A10 A11 A12."""
    rows = A.table(spark, d, "documents").select(F.col("lang").alias("source_site"), F.substring("text", 1, 40).alias("title"), F.col("text").alias("snippet"), F.when(F.col("n_chars") > 200, F.col("text")).alias("description"))
    return stats.funnel(rows, S)


@query("SELECT * FROM (SELECT cast(cast(ts AS date) AS string) AS run_ts, count(*) AS scored FROM events GROUP BY 1) ORDER BY run_ts DESC LIMIT 10")
def last_runs(spark, d):
    """Events of a day as a run; the last ten, ascending."""
    runs = A.table(spark, d, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("scored"))
    runs = runs.select(F.col("day").cast("string").alias("run_ts"), "scored", F.unix_date("day").alias("row_idx"))
    return stats.last_runs(runs).drop("row_idx")


CARD_DAYS = 900
CARD = {
    "title": "o_orderpriority || ' & <' || cast(o_orderkey AS string) || '>'",
    "company": "CASE WHEN o_custkey % 11 = 0 THEN 'Politi ' || c_name WHEN o_custkey % 4 = 0 THEN '' ELSE c_name || ' ApS' END",
    "url": "CASE WHEN o_orderkey % 13 = 0 THEN '' WHEN o_orderkey % 3 = 0 THEN '/jobs/' || cast(o_orderkey AS string) ELSE 'https://ats.example/' || cast(o_orderkey AS string) END",
    "day": "cast(cast(o_orderdate AS date) AS string)",
}


@query(
    f"SELECT o_orderkey // 32 AS page_id, title, CASE WHEN company = '' THEN 'N/A' ELSE company END AS company, CASE WHEN o_orderkey % 5 = 0 THEN 'N/A' WHEN o_orderkey % 7 = 0 THEN 'i dag' ELSE day END AS published_date, left(c_mktsegment || ' ' || day || ' more', 500) AS snippet, CASE WHEN url LIKE '/%' THEN 'https://board.example' ELSE '' END || url AS url FROM (SELECT *, "
    + ", ".join(f"{e} AS {n}" for n, e in CARD.items())
    + f" FROM orders LEFT JOIN customer ON o_custkey = c_custkey) WHERE url <> '' AND NOT contains(lower(company), 'politi') AND (o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 OR cast(day AS date) >= DATE '{S.today}' - {CARD_DAYS})"
)
def result_page_cards(spark, d):
    """Orders rendered as cards of result pages, 32 keys a page, and read back."""
    rows = A.table(spark, d, "orders").join(A.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").selectExpr("*", *[f"{e} AS {n}" for n, e in CARD.items()])
    safe = lambda c: F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    stamp = F.when(F.col("o_orderkey") % 5 == 0, "").when(F.col("o_orderkey") % 7 == 0, '<time datetime="soon">i dag</time>').otherwise(F.concat(F.lit('<time datetime="'), F.col("day"), F.lit('T08:00">x</time>')))
    html = F.concat(
        F.lit('<div class="a jobsearch-result b"><a href="https://logo.example"><img src="x.png"></a><div class="jix-toolbar-top__company"><a> '), safe("company"), F.lit('</a></div><div><h4><a href="'), F.col("url"), F.lit('">'), safe("title"),
        F.lit("</a></h4></div><script>var p = '<p>no</p>';</script><p>"), F.col("c_mktsegment"), F.lit(" <b>"), F.col("day"), F.lit("</b></p><p> </p><p>more</p>"), stamp, F.lit("</div>\n"),
    )
    pages_ = rows.select(F.expr("o_orderkey div 32").alias("page_id"), F.struct("o_orderkey", html.alias("h")).alias("c")).groupBy("page_id").agg(F.sort_array(F.collect_list("c")).alias("cs"))
    pages_ = pages_.select("page_id", F.concat(F.lit("<html><body><p>above</p>"), F.array_join(F.transform("cs", lambda c: c["h"]), ""), F.lit("<p>below</p></body></html>")).alias("raw"))
    found = cards.teasers(pages_, replace(S, max_days_old=CARD_DAYS, board_base="https://board.example"))
    return found.select("page_id", "title", "company", "published_date", "snippet", "url")


@query("SELECT c_name AS title, c_mktsegment AS company, 'https://hub.example/' || cast(c_custkey // 2 AS string) AS url, CASE WHEN length(c_name || repeat(' words', c_custkey % 60)) > 200 THEN 'full' END AS source FROM customer WHERE c_custkey = (SELECT min(x.c_custkey) FROM customer x WHERE x.c_custkey // 2 = customer.c_custkey // 2 AND x.c_custkey % 9 <> 0) AND c_custkey % 9 <> 0")
def api_teasers(spark, d):
    """Objects of an API, two to a URL; those published too early go, and the first of each URL stays."""
    key = F.col("c_custkey")
    old = F.when(key % 9 == 0, "1997-01-01T00:00").otherwise("1998-06-14T12:00")
    raw = F.to_json(F.struct(F.col("c_name").alias("headline"), F.struct(F.col("c_mktsegment").alias("name")).alias("company"), F.concat(F.lit("https://www.hub.example/"), F.expr("c_custkey div 2").cast("string"), F.when(key % 2 == 0, "?utm_source=a").otherwise("/")).alias("url"), old.alias("publishedAt"), F.concat("c_name", F.repeat(F.lit(" words"), (key % 60).cast("int"))).alias("description")))
    found = A.table(spark, d, "customer").select((key % 3).cast("int").alias("rank"), F.lit(1).alias("page"), key.alias("pos"), raw.alias("raw")).withColumn("rank", F.lit(0))
    out = api.teasers(found, S)
    return out.select("title", "company", F.regexp_replace(F.regexp_extract("url", r"^([^?]*)", 1), "www[.]|/$", "").alias("url"), "source")


@query("SELECT url, 'HTTP ' || cast(400 + page_id % 100 AS string) AS fetch_error FROM pages WHERE page_id % 10 = 3 ORDER BY page_id LIMIT 5")
def fetch_failure_sample(spark, d):
    """The first five of the pages that failed."""
    failed = F.when(F.col("page_id") % 10 == 3, F.concat(F.lit("HTTP "), (400 + F.col("page_id") % 100).cast("string")))
    return external.failure_sample(A.table(spark, d, "pages").select(F.col("page_id").alias("row_idx"), "url", failed.alias("fetch_error")))


@query("SELECT q AS query, p AS page, 'https://board.example/search?q=' || replace(q, ' ', '+') || '&page=' || cast(p AS string) AS url FROM (VALUES " + ", ".join(f"('{q}')" for q in S.board_queries) + ") v(q), (SELECT cast(unnest(range(1, 6)) AS int) AS p)")
def query_page_grid(spark, d):
    """S3 J8 E24."""
    return pages.grid(spark, S.board_queries, S.max_pages, "https://board.example/search")


@query(f"WITH {A.KEYED} SELECT row_idx, title, '' AS published_date, danish_level FROM k")
def schema_migrate(spark, d):
    """By name, new columns blank, unknown ones dropped."""
    from ..sources.files import by_name

    return by_name(A.archive(spark, d).select("title", "row_idx", "danish_level", F.lit("x").alias("foo")), ("row_idx", "title", "published_date", "danish_level"))


from . import extensions  # noqa: E402, F401  (registers its queries)

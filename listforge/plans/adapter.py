"""The driver's tables seen as listings: orders with their customers look like an archive, events like a tracker.

The expressions are plain SQL that Spark and DuckDB read alike, so that both sides start from the same rows.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..operators.views import keyed

SETTINGS = Settings(today=date(1998, 6, 15))

ARCHIVE = {
    "row_idx": "o_orderkey",
    "url": "'https://www.ex.com/jobs/' || cast(o_orderkey % 4999 as string) || CASE WHEN o_orderkey % 2 = 0 THEN '?utm_source=a' ELSE '/' END",
    "company": "c_name",
    "title": "o_orderpriority",
    "location": "CASE WHEN o_custkey % 4 = 0 THEN 'N/A' ELSE c_mktsegment END",
    "score": "cast(cast(floor(o_totalprice / 5000) as int) as string)",
    "track": "CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'B' ELSE 'none' END",
    "employment_type": "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'student' WHEN '2' THEN 'part_time' WHEN '3' THEN 'internship' WHEN '4' THEN 'full_time' ELSE 'unknown' END",
    "work_mode": "CASE c_mktsegment WHEN 'BUILDING' THEN 'onsite' WHEN 'FURNITURE' THEN 'hybrid' WHEN 'MACHINERY' THEN 'remote' ELSE 'unknown' END",
    "commute_ok": "CASE WHEN o_custkey % 7 = 0 THEN 'False' ELSE 'True' END",
    "danish_level": "CASE o_custkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'preferred' ELSE 'required' END",
    "is_tech_company": "CASE WHEN o_custkey % 5 = 0 THEN 'True' ELSE 'False' END",
    "scraped_date": "cast(cast(o_orderdate as date) as string)",
    "deadline": "CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'N/A' WHEN 2 THEN cast(cast(o_orderdate as date) + 30 as string) ELSE cast(cast(o_orderdate as date) + 30 as string) || 'T10:00' END",
    "source": "CASE WHEN o_orderkey % 6 = 0 THEN 'snippet' ELSE 'full' END",
    "matched_skills": "'sql; ' || lower(c_mktsegment)",
    "reasoning": "CASE WHEN o_orderkey % 50 = 0 THEN 'scoring error' ELSE 'fits' END",
}
ARCHIVE_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in ARCHIVE.items()) + " FROM orders LEFT JOIN customer ON o_custkey = c_custkey"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive rows with cu and score_n."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    return keyed(joined.selectExpr(*[f"{e} AS {n}" for n, e in ARCHIVE.items()]))


STATUS = "CASE event_type WHEN 'click' THEN 'interested' WHEN 'purchase' THEN 'Applied ' WHEN 'signup' THEN 'interview' WHEN 'error' THEN '' ELSE 'rejected' END"
TRACKER = {"row_idx": "event_id", "cu": "'https://ex.com/jobs/' || cast(user_id as string)", "status": STATUS}
TRACKER_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in TRACKER.items()) + " FROM events"


def tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*[f"{e} AS {n}" for n, e in TRACKER.items()])


# --- DuckDB ---------------------------------------------------------------------------------------------------------


def day(c: str) -> str:
    """DuckDB: a date from the first ten characters, else null."""
    s = f"substr(trim({c}), 1, 10)"
    return f"try_cast(CASE WHEN regexp_matches({s}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN {s} END AS date)"


TODAY = f"DATE '{SETTINGS.today}'"
OPEN = f"CASE WHEN {day('deadline')} IS NOT NULL THEN {day('deadline')} >= {TODAY} ELSE {TODAY} - {day('scraped_date')} <= 21 END"
DAYS = f"cast({day('deadline')} - {TODAY} AS int)"
KEYED = f"""arch AS ({ARCHIVE_SQL}), k AS (SELECT *, regexp_replace(regexp_replace(url, '^https://www.', 'https://'), '([?]utm_source=a|/)$', '') AS cu, coalesce(try_cast(score AS int), 0) AS score_n FROM arch)"""
BEST = f"{KEYED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY cu ORDER BY score_n DESC, row_idx) AS rn, min(row_idx) OVER (PARTITION BY cu) AS first_idx FROM k), best AS (SELECT * FROM ranked WHERE rn = 1)"
TARGET = "score_n >= 75 AND employment_type IN ('student', 'part_time', 'internship', 'unknown') AND lower(commute_ok) <> 'false'"
MATCH = f"({TARGET} AND {OPEN})"
SHORT = f"{BEST}, short AS (SELECT *, {DAYS} AS days_left FROM best WHERE {TARGET} AND danish_level <> 'required' AND {OPEN})"
STATUSES = f"t AS ({TRACKER_SQL}), st AS (SELECT cu, CASE WHEN trim(arg_max(status, row_idx)) = '' THEN 'tracked' ELSE lower(trim(arg_max(status, row_idx))) END AS status FROM t GROUP BY cu)"

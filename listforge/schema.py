"""Columns of the stored tables. All are strings where the table is CSV."""

from __future__ import annotations

from pyspark.sql import types as T

# Names and order of stored columns.
TEASER = ("title", "company", "location", "published_date", "snippet", "url", "source_site", "description", "source")
ARCHIVE = ("scraped_date", "title", "company", "location", "published_date", "url", "track", "score", "employment_type", "work_mode", "commute_ok", "danish_level", "is_tech_company", "deadline", "matched_skills", "source", "reasoning")
RUNS = ("run_ts", "duration_s", "scrape_s", "fetch_gate_s", "score_s", "teasers", "prefiltered", "danish_early", "danish_body", "deadline_dropped", "fetched", "scored", "errors", "matches")
TRACKER = ("date_added", "status", "company", "role", "url", "employment_type", "location", "deadline", "score", "track", "next_followup", "brief_file", "notes")


def strings(names) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


SCORE = T.StructType([
    T.StructField("score", T.IntegerType()), T.StructField("track", T.StringType()), T.StructField("is_tech_company", T.BooleanType()),
    T.StructField("employment_type", T.StringType()), T.StructField("work_mode", T.StringType()), T.StructField("location", T.StringType()),
    T.StructField("commute_ok", T.BooleanType()), T.StructField("danish_level", T.StringType()), T.StructField("deadline", T.StringType()),
    T.StructField("reasoning", T.StringType()), T.StructField("matched_skills", T.ArrayType(T.StringType())),
])

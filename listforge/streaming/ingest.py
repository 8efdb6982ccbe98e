"""A run from teasers to the archive, as a batch and as a stream of micro-batches."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import text
from ..operators import dedup, external, filters, lookups, views
from ..operators.seen import Seen
from ..schema import ARCHIVE, RUNS, strings
from ..sources import files, tables

log = logging.getLogger(__name__)


def ingest(teasers: DataFrame, archive: str | tables.Table, s: Settings, fetcher: Callable | None, scorer: Callable | None = None, detector: Callable | None = None, seen: Seen | None = None, txn: str | None = None) -> dict[str, int]:
    """Teasers (row_idx and the columns of schema.TEASER) through all gates into the archive; counts of the funnel.

    Cheap gates come first. Teasers, fetched and scored rows are written to the shared folder before they branch, so that
    a source is read once, and failed scorings aren't archived, so that the next run tries them again. Rows are archived
    in order. The counts are observed by the tasks that write: there is no job for them alone.
    Rows are scored and archived in the order of filters.bodies_last. A detector's failures are counted and leave rows in.
    archive: a folder, or a versioned table, which several writers can share and which stores a txn once. seen: an index of
    the archive's URLs; what was archived since it was last brought up to date is added first, also after a crash.
    detector: a factory of functions (text) -> language code, for the language gates where these are asked for.
    """
    spark, since = teasers.sparkSession, dedup.mark()
    detects = detector is not None and s.drop_foreign_language
    code = lambda c: external.detected(c, detector) if detects else F.lit(None).cast("string")
    keyed = teasers.withColumns({"cu": text.canonical_url(F.col("url")), "rk": text.role_key(F.col("company"), F.col("title"))})
    rows, came = dedup.counted(keyed, "arrivals", teasers=F.count("*"), last=F.max("row_idx"))
    if seen is None:
        known = stored(spark, archive).select(text.canonical_url(F.col("url")).alias("cu"))
        fresh = lookups.unseen(rows, known)
    else:
        seen.catch_up(stored(spark, archive).select(text.canonical_url(F.col("url")).alias("cu"), "row_idx"))
        fresh = seen.unseen(rows)
    fresh = dedup.greedy_two_keys(fresh)
    wanted = fresh.where(filters.passes_source_policy(F.col("source_site"), F.col("title"), F.col("snippet"), s) & ~filters.excluded_company(F.col("company"), s))
    has_body = text.blank(F.col("description")) != ""
    early = F.lit(False)
    if s.drop_foreign_language:
        # Only what would have to be fetched is judged by its teaser.
        teaser = F.concat_ws("\n", "title", "snippet")
        early = ~has_body & text.confidently_danish(teaser, code(teaser) if detects else None)
    wanted, passed = dedup.counted(wanted.withColumns({"early": early, "has_body": has_body}), "wanted", prefiltered=F.count("*"), danish_early=F.count_if("early"), fetched=F.count_if(~F.col("early") & ~F.col("has_body")))
    going = wanted.where("not early").drop("source", "early")
    preloaded = going.where("has_body").withColumns({"fetched": F.col("description"), "fetch_error": F.lit(None).cast("string")})
    to_fetch = going.where("not has_body")
    if fetcher is not None and s.fetch_bodies:
        to_fetch = external.fetched(to_fetch, fetcher, s)
    else:
        to_fetch = to_fetch.withColumns({"fetched": F.lit(""), "fetch_error": F.lit(None).cast("string")})
    bodies = dedup.written(external.with_body(to_fetch.unionByName(preloaded)), "bodies")
    bodies = bodies.withColumn("code", code(F.col("body"))).withColumn("gate", filters.gate(s, "body", F.col("code") if detects else None))
    bodies, gated = dedup.counted(bodies, "gated", undetected=F.count_if(F.col("code") == external.UNDETECTED), danish_body=F.count_if(F.col("gate") == "danish"), deadline_dropped=F.count_if(F.col("gate") == "deadline"), failed=F.count_if(F.col("fetch_error").isNotNull()))
    if gated.pop("failed"):
        for r in external.failure_sample(bodies).collect():
            log.warning("not fetched, scored by its teaser: %s (%s)", r["url"], r["fetch_error"])
    if undetected := gated.pop("undetected"):
        log.warning("language detection failed for %d pages", undetected)
    survivors = bodies.where("gate is null").drop("gate", "code")
    done = external.scored(survivors, scorer or external.rule_scorer(s), s)
    matches = (F.col("score") >= s.score_threshold) & F.col("employment_type").isin(*s.accepted_types)
    done, judged = dedup.counted(done, "scored", scored=F.count("*"), errors=F.count_if(F.col("reasoning") == "scoring error"), matches=F.count_if(matches))
    good = filters.without_errors(done).withColumn("matched_skills", F.array_join("matched_skills", "; "))
    good = good.withColumn("row_idx", filters.bodies_last(F.col("has_body"), F.col("row_idx"), came.pop("last") + 1))
    if isinstance(archive, tables.Table):
        archive.append_ordered(good, txn=txn)
    else:
        files.append_ordered(good, archive, ARCHIVE)
    dedup.clear(spark, since)
    found = came | passed | gated | judged
    return {k: found[k] for k in RUNS[-9:]}


def stored(spark: SparkSession, archive: str | tables.Table) -> DataFrame:
    """The archive's rows with row_idx."""
    return archive.read() if isinstance(archive, tables.Table) else files.read_ordered(spark, archive, ARCHIVE)


def versioned(spark: SparkSession, base: str) -> tables.Table:
    """An archive that several writers can share."""
    return tables.Table(spark, base, strings(ARCHIVE).add("row_idx", "long"))


def log_run(spark: SparkSession, path: str, run_ts: str, seconds: dict[str, float], counts: dict[str, int]) -> None:
    """One row of run metrics."""
    row = {"run_ts": run_ts} | {k: f"{v:.1f}" for k, v in seconds.items()} | {k: str(v) for k, v in counts.items()}
    one = spark.createDataFrame([tuple(row.get(c, "") for c in RUNS)], ", ".join(f"{c} string" for c in RUNS))
    files.append_ordered(one.withColumn("row_idx", F.lit(0)), path, RUNS)


def stream(teasers: DataFrame, archive: str | tables.Table, checkpoint: str, s: Settings, fetcher: Callable | None = None, seen: Seen | None = None, name: str = "stream"):
    """The same for a stream of teasers: every micro-batch is ingested once; what the archive has is never scored again.

    A micro-batch that is repeated after a failure finds what it archived before and adds only the rest; a versioned
    archive knows the batch itself, by the stream's name and the batch's number, and stores it whole or not at all.
    """

    def one(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            ingest(batch, archive, s, fetcher, seen=seen, txn=f"{name} {number}")

    return teasers.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_shortlist(spark: SparkSession, archive_path: str, s: Settings) -> DataFrame:
    """The open shortlist of a stored archive, whose rows count in their order of arrival."""
    return views.open_shortlist(views.keyed(files.read_ordered(spark, archive_path, ARCHIVE)), s)

"""The analysis report of an archive: counts, distributions, rates and lists as lines of text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import BODY_SOURCES, EMPLOYMENT_TYPES, TRACKS, WORK_MODES, Settings
from .functions import render
from .operators import stats, views
from .operators.filters import column_or


def _bars(title: str, rows: DataFrame) -> list[str]:
    got = rows.orderBy("ord").collect()
    wide = max(len(r["value"]) for r in got)
    return ["", title, *[f"  {r['value']:<{wide}}  {r['n']:>4}  {r['bar']}" for r in got]]


def _share(part: int, whole: int) -> str:
    return f"{part}/{whole} ({round(100 * part / whole)}%)"


def report(archive: DataFrame, s: Settings, runs: DataFrame | None = None) -> list[str]:
    """Lines. archive: keyed rows in their order of arrival; runs: rows of schema.RUNS in theirs (with row_idx).

    Everything that comes to the driver is an aggregate, a list of at most 15, the last ten runs, or the matches, which are
    there to be read.
    """
    o = stats.overview(archive, s).first()
    if not o["n_rows"]:
        return ["The archive is empty."]
    twice = f" ({o['n_duplicates']} rows repeat one)" if o["n_duplicates"] else ""
    out = [f"Scored rows: {o['n_rows']}", f"Different URLs: {o['n_urls']}{twice}", f"Days: {o['n_dates']}" + (f", {o['first_date']} to {o['last_date']}" if o["n_dates"] else "")]
    out.append(f"Open matches: {o['n_matches']} (score from {s.score_threshold}; {o['n_closed']} more have closed)")
    if o["n_outside"]:
        out.append(f"High scores outside the targets: {o['n_outside']}")
    types = column_or(archive, "employment_type", "unknown")
    out += _bars("Scores", stats.distribution(archive, stats.bucket(F.col("score_n")), stats.BUCKETS))
    out += _bars("Tracks", stats.distribution(archive, F.col("track"), TRACKS))
    split = stats.track_split(archive, s).first()
    out.append(f"  among matches: A {split['n_a']}, B {split['n_b']}")
    out += _bars("Types", stats.distribution(archive, types, EMPLOYMENT_TYPES))
    full = archive.where(types == "full_time").count()
    if full:
        out.append(f"  {full} full-time rows are kept; they are {'in' if 'full_time' in s.accepted_types else 'not in'} the shortlist")
    out += _bars("Work modes", stats.distribution(archive, F.col("work_mode"), WORK_MODES))
    d = stats.language_rates(archive, s).first()
    out += ["", "Danish", f"  required in {_share(d['n_required'], d['n_rows'])} of all"]
    if d["n_matches"]:
        out += [f"  required in {_share(d['n_required_matches'], d['n_matches'])} of matches", f"  a plus in {_share(d['n_preferred_matches'], d['n_matches'])} of matches"]
        tech = stats.tech_rate(archive, s).first()
        out += ["", f"Tech companies among matches: {_share(tech['n_true'], tech['n'])}"]
    out += _bars("What was scored", stats.distribution(archive, F.col("source"), BODY_SOURCES))
    out += ["", "Recurring companies"]
    again = stats.recurring_companies(archive, s).collect()
    out += [f"  {r['n']:>2}x  {r['company']}" + (f"  ({r['n_matches']} matching)" if r["n_matches"] else "") for r in again] or ["  none"]
    days = stats.drift(archive, F.col("scraped_date"), F.col("score_n"), s).orderBy("day").collect()
    if len(days) > 1:
        out += ["", "By day (scored, high)", *[f"  {r['day']}  {r['n']:>4}  {r['n_high']:>4}  {r['bar']}" for r in days]]
    line = render.row_line().alias("line")
    best = archive.where(views.matches(archive, s)).orderBy(F.desc("score_n"), "row_idx")
    out += ["", "Open matches", *[r["line"] for r in best.select(line).collect()]]
    outside = stats.outside_targets(archive, s).select(line).collect()
    out += ["", "High scores outside the targets", *[r["line"] for r in outside]] if outside else []
    last = [] if runs is None else stats.last_runs(runs).collect()
    if last:
        out += ["", "Runs", *[f"  {r['run_ts']}  {r['duration_s'] or '?'}s  {r['teasers'] or '?'} teasers, {r['scored'] or '?'} scored, {r['matches'] or '?'} matching" for r in last]]
    return out

"""Command line over a stored archive and tracker: list, --new, a number, a URL, --status URL STATUS, report."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from dataclasses import replace
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import STATUSES, Settings
from .functions import render, text
from .operators import external, lookups, views
from .schema import ARCHIVE, TRACKER
from .sources import files

log = logging.getLogger(__name__)


class Desk:
    """What a person does with the shortlist."""

    def __init__(self, spark: SparkSession, archive: str, tracker: str, settings: Settings, briefs: str = "briefs", fetcher: Callable | None = None, extractor: Callable | None = None):
        """fetcher: a factory of (url) -> text; extractor: a factory of (title, body) -> a JSON object of facts. Both are
        asked on the driver, for one listing."""
        self.spark, self.s, self.briefs, self.archive_path = spark, settings, briefs, archive
        self.fetcher, self.extractor = fetcher, extractor
        self.snapshots = files.Snapshots(spark, tracker, TRACKER)

    def archive(self) -> DataFrame:
        return views.keyed(files.read_ordered(self.spark, self.archive_path, ARCHIVE))

    def tracker(self) -> DataFrame:
        return self.snapshots.read().withColumn("cu", text.canonical_url(F.col("url")))

    def listing(self, only_new: bool = False) -> list[str]:
        """Lines of the shortlist; --new leaves rows out after they got their numbers."""
        rows = lookups.with_status(views.numbered(views.shortlist_rows(self.archive(), self.s)), self.tracker())
        rows = rows.where("actionable") if only_new else rows
        line = F.concat(render.padded_left(F.col("n").cast("string"), 4), F.lit(". "), render.row_line(), F.lit("  "), render.when_phrase(), F.lit("  · "), F.when(F.col("kind") == "new", "NEW").otherwise(F.col("kind")))
        return [r["line"] for r in rows.select("n", line.alias("line")).orderBy("n").collect()]

    def item(self, n: int) -> dict | None:
        """The row with a number; None if there is none."""
        got = views.numbered(views.shortlist_rows(self.archive(), self.s)).where(F.col("n") == n).first()
        return got.asDict() if got else None

    def row_of(self, url: str) -> dict | None:
        cu = self.spark.range(1).select(text.canonical_url(F.lit(url)).alias("c")).first()["c"]
        got = lookups.archive_row(self.archive(), cu).first()
        return got.asDict() if got else None

    def set_status(self, url: str, status: str) -> bool:
        """Whether the tracker has the URL; all its rows change. An unknown status is stored with a warning."""
        if status not in STATUSES:
            log.warning("unknown status %r; known: %s", status, ", ".join(STATUSES))
        cu = self.spark.range(1).select(text.canonical_url(F.lit(url)).alias("c")).first()["c"]
        rows = self.tracker()
        if rows.where(F.col("cu") == cu).isEmpty():
            return False
        self.snapshots.replace(lookups.update_status(rows, cu, status))
        return True

    def prepare_live(self, meta: dict) -> str:
        """Fetch a listing's page anew, draw facts from it, and write its brief; the brief's path."""
        body, error = "", "not fetched"
        if self.fetcher:
            try:
                body, error = external.page_text(self.fetcher()(meta["url"]))
            except Exception as e:  # a page may fail in any way; the brief says how
                error = str(e)[: external.ERROR_MOST]
        facts = {}
        if body and self.extractor:
            one = self.spark.createDataFrame([(meta.get("title") or "", body)], "title string, body string")
            facts = json.loads(external.extracted(one, self.extractor).first()["brief_json"] or "{}")
        return self.prepare(meta, body, facts, error)

    def prepare(self, meta: dict, body: str, facts: dict | None = None, error: str | None = None) -> str:
        """Write a brief and, unless the URL is tracked, a tracker row; the brief's path."""
        facts = facts or {}
        names = ("title", "company", "location", "employment_type", "deadline")
        given = [str(x[k]) if x.get(k) is not None else None for x in (meta, facts) for k in names]
        one = self.spark.createDataFrame([tuple(given)], ", ".join(f"{x}_{k} string" for x in ("m", "f") for k in names))
        one = one.select(*[text.filled(F.col(f"m_{k}"), F.col(f"f_{k}")).alias(k) for k in names])
        done = one.withColumn("slug", text.slug(F.col("company"))).first().asDict()
        slug = done.pop("slug")
        meta |= done
        path = files.unique_name(self.spark, self.briefs, f"{self.s.today}_{slug}")
        files.write_text(self.spark, path, brief(meta, facts, body, error, self.s))
        row = {"date_added": str(self.s.today), "status": "interested", "company": meta["company"], "role": meta["title"], "url": meta["url"], "next_followup": str(self.s.today + timedelta(days=7)), "brief_file": path.rsplit("/", 1)[-1], "notes": ""}
        row |= {k: str(meta.get(k) or "") for k in ("employment_type", "location", "deadline", "score", "track")}
        new = self.spark.createDataFrame([tuple(row[c] for c in TRACKER)], ", ".join(f"{c} string" for c in TRACKER))
        tracker = self.tracker()
        last = tracker.agg(F.max("row_idx").alias("m")).first()["m"]
        new = new.withColumns({"cu": text.canonical_url(F.col("url")), "row_idx": F.lit(0 if last is None else last + 1).cast("long")})
        if tracker.join(new.select("cu"), "cu", "left_semi").isEmpty():
            self.snapshots.replace(lookups.insert_absent(tracker, new))
        return path

    def report(self, path: str) -> int:
        """Write the shortlist as Markdown; how many listings it has."""
        rows = views.numbered(views.shortlist_rows(self.archive(), self.s)).withColumns({"_meta": render.meta_line(), "_badge": render.badge()}).orderBy("n").collect()
        kinds = ", ".join(sorted(self.s.accepted_types))
        out = [f"# Matches on {self.s.today}: {len(rows)} open (score from {self.s.score_threshold}; {kinds})\n"]
        for r in rows:
            out.append(f"### {r['n']}. [{r['title']}]({r['url']}) — {r['score_n']}/100 · {r['_badge']}\n**Company:** {r['company']}  ")
            out += [f"**Details:** {r['_meta']}  "] if r["_meta"] else []
            out.append(f"**Seen:** {r['scraped_date']}  \n**Why:** {r['reasoning']}\n\n---\n")
        files.write_text(self.spark, path, "\n".join(out))
        return len(rows)


def brief(meta: dict, facts: dict, body: str, error: str | None, s: Settings) -> str:
    """What is known of one listing, as Markdown."""

    def bullets(items) -> str:
        kept = [str(x).strip() for x in items or [] if str(x).strip()]
        return "\n".join(f"- {x}" for x in kept) or "_(none extracted)_"

    dash = lambda k: meta.get(k) or "—"
    skills = [x.strip() for x in str(meta.get("matched_skills") or "").split(";") if x.strip()]
    level = str(meta.get("danish_level") or "").lower()
    lines = [f"# Brief: {meta.get('company', '')}, {meta.get('title', '')}", "", "## Role", f"- **Location:** {dash('location')}", f"- **Type:** {dash('employment_type')} · **Work mode:** {dash('work_mode')}", f"- **Deadline:** {dash('deadline')}", f"- **Danish:** {level if level in ('required', 'preferred') else 'not stated'}", f"- **URL:** {meta.get('url', '')}"]
    if meta.get("score"):
        lines.append(f"- **Score:** {meta['score']}/100 · Track {meta.get('track') or '?'}" + (f", {meta['reasoning']}" if meta.get("reasoning") else ""))
    lines += [f"- **Matched skills:** {', '.join(skills)}"] if skills else []
    lines += ["", str(facts.get("role_summary") or "_(no summary; read the text below)_")]
    for title, key in (("Must have", "must_have"), ("Nice to have", "nice_to_have"), ("Responsibilities", "responsibilities"), ("Keywords", "ats_keywords"), ("Company facts", "company_facts"), ("Alignment (unverified)", "candidate_alignment")):
        lines += ["", f"## {title}", bullets(facts.get(key))]
    text_ = body.strip() or "Fetching failed" + (f" ({error})" if error else "") + ": paste the full text here."
    return "\n".join([*lines, "", f"## Full text, fetched {s.today}", text_, ""])


def main(argv: list[str], desk: Desk) -> int:
    """Dispatch; 0 if what was asked for could be done."""
    if not argv or argv == ["--new"]:
        print("\n".join(desk.listing(bool(argv))) or "The shortlist is empty.")
        return 0
    if argv[0] == "--status":
        if len(argv) < 3:
            print("usage: --status URL STATUS")
            return 2
        done = desk.set_status(argv[1], argv[2].strip().lower())
        print("updated" if done else "not in the tracker")
        return int(not done)
    if argv[0] == "--report":
        print(desk.report(argv[1]))
        return 0
    meta = desk.item(int(argv[0])) if argv[0].isdigit() else desk.row_of(argv[0]) or {"url": argv[0], "title": "", "company": ""}
    if meta is None:
        print("no such number")
        return 1
    print(desk.prepare_live(meta))
    return 0


def widened(s: Settings, *types: str) -> Settings:
    """Settings whose views accept further types; stored rows surface without being scored again."""
    return replace(s, accepted_types=tuple(dict.fromkeys((*s.accepted_types, *types))))

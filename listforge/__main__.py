"""python -m listforge ingest | analyse | prepare ...

  ingest                       read the sources, pass the gates, score and archive; log the run and write the report
  analyse                      print the analysis of the archive
  prepare [--new | N | URL | --status URL STATUS | --report PATH]   what cli.py does

Options: --base FOLDER (tables lie below it), --profile NAME with --profiles FOLDER, --owner, --today YYYY-MM-DD,
--board URL with --board-base URL, --api URL with --job-url URL, --no-fetch, --dump FOLDER (first pages, for a look);
--scorer, --extractor and --detector: module.function, a factory of one client (see operators/external.py), or for the last
two `rules`, what is shipped; --no-danish drops pages in Danish; --index keeps an index of the URLs that the archive has.
"""

from __future__ import annotations

import argparse
import sys
import time
from dataclasses import replace
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import analysis, cli, config
from .operators import dedup, external, numbering, views
from .operators.seen import Seen
from .schema import ARCHIVE, RUNS, TEASER
from .sources import api, cards, files, registry
from .streaming import ingest


def settings(o: argparse.Namespace) -> config.Settings:
    s = config.Settings(today=date.fromisoformat(o.today) if o.today else date.today(), base=o.base, board_url=o.board, board_base=o.board_base, api_url=o.api, api_job_url=o.job_url)
    s = replace(s, fetch_bodies=not o.no_fetch, drop_foreign_language=s.drop_foreign_language or o.no_danish)
    return config.with_profile(s, config.load_profile(o.profiles, o.profile), o.owner) if o.profile else s


def numbered(rows: DataFrame) -> DataFrame:
    """Teasers of all sources with row_idx: by source, then by query, page and place."""
    return numbering.numbered(rows, "source_rank", "rank", "page", "pos", "card", name="row_idx", start=0).select("row_idx", *TEASER)


def collected(spark: SparkSession, s: config.Settings, dump: str = "", **more: str) -> tuple[DataFrame | None, dict[str, str]]:
    """(numbered teasers of all sources, what went wrong with those that failed). Each source is read and written on its
    own, so that one that fails takes nothing along."""

    def board() -> DataFrame:
        found = dedup.written(api.read(spark, s, "html", **more), "board")
        if dump:
            files.dump_first_pages(found, dump)
        return dedup.written(cards.teasers(found, s), "cards")

    def hub() -> DataFrame:
        return dedup.written(api.teasers(api.read(spark, s, "json", **more), s).withColumn("card", F.lit(0)), "objects")

    found, failed = registry.union({"board": board, "hub": hub})
    return (None if found is None else numbered(found)), failed


def main(argv: list[str], spark: SparkSession | None = None, **more: str) -> int:
    p = argparse.ArgumentParser(prog="listforge", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("verb", choices=("ingest", "analyse", "prepare"))
    for name in ("base", "profile", "profiles", "today", "board", "board-base", "api", "job-url", "dump", "scorer", "extractor", "detector"):
        p.add_argument(f"--{name}", default={"base": ".", "profiles": "profiles"}.get(name, ""))
    p.add_argument("--owner", action="store_true")
    for name in ("no-fetch", "no-danish", "index"):
        p.add_argument(f"--{name}", action="store_true")
    o, rest = p.parse_known_args(argv)
    s = settings(o)
    detector, extractor = external.client(o.detector, external.rule_detector), external.client(o.extractor, external.rule_extractor)
    scorer = external.client(o.scorer, external.rule_scorer(s))
    spark = spark or SparkSession.builder.appName("listforge").getOrCreate()
    archive, runs = f"{s.base}/archive", f"{s.base}/runs"
    desk = cli.Desk(spark, archive, f"{s.base}/tracker", s, f"{s.base}/briefs", None if o.no_fetch else external.web_fetcher, extractor)
    if o.verb == "prepare":
        return cli.main(rest, desk)
    if o.verb == "analyse":
        print("\n".join(analysis.report(desk.archive(), s, files.read_ordered(spark, runs, RUNS))))
        return 0
    began, at = datetime.now(), time.monotonic()
    teasers, failed = collected(spark, s, o.dump, **more)
    read = time.monotonic() - at
    for name, why in failed.items():
        print(f"source {name} failed: {why}", file=sys.stderr)
    if teasers is None:
        return 1
    index = Seen(spark, f"{s.base}/seen") if o.index else None
    counts = ingest.ingest(teasers, archive, s, None if o.no_fetch else external.web_fetcher, scorer, detector, index)
    took = time.monotonic() - at
    ingest.log_run(spark, runs, f"{began:%Y-%m-%d %H:%M:%S}", {"duration_s": took, "scrape_s": read, "score_s": took - read}, counts)
    print(", ".join(f"{k} {v}" for k, v in counts.items()))
    for r in views.console_matches(desk.archive().where(F.col("scraped_date") == str(s.today)), s).orderBy(F.desc("score_n"), "row_idx").select("score_n", "title", "company").collect():
        print(f"  {r['score_n']:>3}  {r['title']}, {r['company']}")
    print(f"{desk.report(f'{s.base}/report.md')} listings in {s.base}/report.md")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

"""Python data sources for live reading: one input partition for each query, pages read until nothing new comes.

Names of parameters, the number of the first page and fixed parameters are options. `opener` is the dotted name of a
function (url) -> text, so that tests and other transports can be plugged in. `teasers` turns what was read into teasers.
"""

from __future__ import annotations

import importlib
import json
import logging
import time
from collections.abc import Iterator
from urllib.parse import parse_qsl, urlencode, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..config import Settings
from ..functions import dates, jsonx, text
from ..operators.dedup import first_per
from . import cards

log = logging.getLogger(__name__)


def http(url: str) -> str:
    """The text behind a URL."""
    import urllib.request

    with urllib.request.urlopen(urllib.request.Request(url, headers={"Accept": "application/json, text/html"}), timeout=180) as r:  # noqa: S310
        return r.read().decode("utf-8", "replace")


def stored(url: str) -> str:
    """The page of a query that a folder holds (q=TERM/page=N/, as Spark writes partitions), for replays without a network."""
    from pyarrow import fs

    from .tables import store

    at = urlsplit(url)
    asked = dict(parse_qsl(at.query))
    files, path = store(url.split("?")[0])
    found = files.get_file_info(fs.FileSelector(f"{path}/q={asked['q']}/page={asked['page']}", allow_not_found=True))
    parts = []
    for x in sorted((x for x in found if x.base_name.startswith("part-")), key=lambda x: x.path):
        with files.open_input_stream(x.path) as f:
            parts.append(f.read().decode())
    return "".join(parts) or "{}"


class Query(InputPartition):
    def __init__(self, number: int, term: str):
        self.number, self.term = number, term


class PagedReader(DataSourceReader):
    """Rows (rank, query, page, pos, raw). What is raw: an API object's JSON, or a result page's markup.

    A query ends at a page that fails (which is logged), that has no object or card, or whose objects were all seen: an
    object is known by its URL without what tracks visitors, else by its id, else by all it says.
    """

    def __init__(self, options: dict):
        self.terms = json.loads(options["queries"])
        self.base, self.kind = options.get("base", ""), options.get("kind", "json")
        self.pages, self.first = int(options.get("pages", 5)), int(options.get("first", 1))
        self.fixed, self.pause = json.loads(options.get("params", "{}")), float(options.get("pause", 0))
        self.search, self.page = options.get("search", "q"), options.get("page", "page")
        self.card = options.get("card", cards.CARD)
        self.opener = options.get("opener", f"{__name__}.http")

    def partitions(self) -> list[Query]:
        """None without a base URL: such a source yields nothing."""
        return [Query(i, t) for i, t in enumerate(self.terms)] if self.base else []

    def client(self):
        module, _, name = self.opener.rpartition(".")
        return getattr(importlib.import_module(module), name)

    def parts(self, get, term: str, page: int) -> list[tuple[str, str]]:
        """(identity, raw) of what a page has: its objects, or the page itself if it has a card."""
        answer = get(f"{self.base}?{urlencode(self.asked(term, page))}")
        if self.kind == "json":
            return [(identity(x), json.dumps(x, ensure_ascii=False)) for x in objects(json.loads(answer))]
        return [(answer, answer)] if cards.cards_of(answer, self.card) else []

    def read(self, partition: Query) -> Iterator[tuple]:
        get, seen = self.client(), set()
        for page in range(self.first, self.first + self.pages):
            try:
                parts = self.parts(get, partition.term, page)
            except Exception as e:  # a page that fails ends its query, not the source
                log.error("query %r, page %d failed: %s", partition.term, page, str(e)[:160])
                return
            new = [(i, raw) for i, (name, raw) in enumerate(parts) if name not in seen]
            if not new:
                return
            for i, raw in new:
                if parts[i][0] not in seen:
                    seen.add(parts[i][0])
                    yield partition.number, partition.term, page, i, raw
            time.sleep(self.pause)

    def asked(self, term: str, page: int) -> dict[str, str]:
        """Parameters of a request; an empty term or name leaves its parameter out."""
        own = {self.search: term if self.search else "", self.page: str(page)}
        return self.fixed | {k: v for k, v in own.items() if k and v}


def identity(found) -> str:
    """What tells one object of an answer from another."""
    if isinstance(found, dict):
        for name in jsonx.FIELDS["url"]:
            if isinstance(found.get(name), str) and found[name]:
                at = urlsplit(found[name])
                query = sorted((k, v) for k, v in parse_qsl(at.query) if k.lower() not in text.TRACKING)
                return f"{(at.hostname or '').removeprefix('www.')}{at.path.rstrip('/')}?{urlencode(query)}"
        for name in jsonx.FIELDS["id"]:
            if found.get(name) not in (None, ""):
                return f"#{found[name]}"
    return json.dumps(found, sort_keys=True)


def objects(data) -> list:
    """The objects of an answer; see jsonx.listed, which does the same to a column."""
    if isinstance(data, list):
        return data
    if not isinstance(data, dict):
        return []
    wrapped = [x for k in ("jobs", "featuredJobs") if isinstance(c := data.get(k), dict) and isinstance(c.get("docs"), list) for x in c["docs"]]
    return wrapped or next((data[k] for k in ("docs", "hits", "results", "items") if isinstance(data.get(k), list)), [])


class PagedSource(DataSource):
    """spark.dataSource.register(PagedSource); spark.read.format("listforge_paged").options(...).load()"""

    @classmethod
    def name(cls) -> str:
        return "listforge_paged"

    def schema(self) -> str:
        return "rank int, query string, page int, pos int, raw string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(dict(self.options))

    def streamReader(self, schema):
        from .live import PagedStream

        return PagedStream(dict(self.options))


def read(spark: SparkSession, s: Settings, kind: str = "json", **more: str) -> DataFrame:
    """What the settings' API (kind json) or board (kind html) answers: rank, query, page, pos and raw."""
    spark.dataSource.register(PagedSource)
    if kind == "json":
        given = {"base": s.api_url, "queries": json.dumps(s.api_queries or ("",)), "search": s.api_search_param, "page": s.api_page_param, "first": "0" if s.api_zero_indexed else "1", "params": json.dumps(dict(s.api_params))}
    else:
        given = {"base": s.board_url, "queries": json.dumps(s.board_queries)}
    return spark.read.format("listforge_paged").options(**given | {"kind": kind, "pages": str(s.max_pages)} | more).load()


def teasers(found: DataFrame, s: Settings, raw: str = "raw") -> DataFrame:
    """A teaser of each API object (rows of rank, page, pos and raw), the first of each canonical URL in that order.

    Objects without a title or a URL go, and those published before the cutoff.
    """
    given = jsonx.teaser_columns(F.col(raw), s.api_job_url)
    rows = found.select("rank", "page", "pos", *[c.alias(n) for n, c in given.items()])
    rows = rows.where((F.col("title") != "") & (F.col("url") != "") & dates.is_recent(F.col("published_date"), s.today, s.max_days_old))
    place = (F.col("rank"), F.col("page"), F.col("pos"))
    return first_per(rows.withColumn("cu", text.canonical_url(F.col("url"))), "cu", order=place).drop("cu")

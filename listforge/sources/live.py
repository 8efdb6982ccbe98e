"""The paged source as a stream: a micro-batch reads the next page of each query that goes on.

An offset says for each query which page comes next. Every page that was read is kept in a folder that all executors
share (option `spool`), under its query's number and its own, before its rows go on: a batch that runs again finds it
there and gives the same rows, and a later session goes on behind it, so that no page is asked for twice. That also is how
the driver knows which queries have ended. One spool belongs to one checkpoint; a new round of reading takes new ones.
"""

from __future__ import annotations

import hashlib
import json
import logging
from collections.abc import Iterator

from pyspark.sql.datasource import DataSourceStreamReader, InputPartition

from .api import PagedReader
from .tables import create, store

log = logging.getLogger(__name__)


class Pages(InputPartition):
    """Pages start to stop, exclusive, of one query."""

    def __init__(self, number: int, start: int, stop: int):
        self.number, self.start, self.stop = number, start, stop


class PagedStream(DataSourceStreamReader):
    """spark.readStream.format("listforge_paged").options(spool=..., ...).load(): the same options and rows as a batch."""

    def __init__(self, options: dict):
        self.source, self.spool = PagedReader(options), options["spool"].rstrip("/")

    def _read(self, number: int, page: int) -> dict | None:
        from pyarrow import fs

        files, path = store(self.spool)
        if files.get_file_info(f"{path}/{number}/{page}.json").type == fs.FileType.NotFound:
            return None
        with files.open_input_stream(f"{path}/{number}/{page}.json") as f:
            return json.loads(f.read())

    def initialOffset(self) -> dict:
        return {str(q.number): self.source.first for q in self.source.partitions()}

    def latestOffset(self) -> dict:
        """One page further than what was read, for each query that hasn't ended."""
        found, most = {}, self.source.first + self.source.pages
        for q in self.source.partitions():
            page, ended = self.source.first, False
            while not ended and page < most and (read := self._read(q.number, page)) is not None:
                page, ended = page + 1, read["ended"]
            found[str(q.number)] = page if ended or page >= most else page + 1
        return found

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        return [Pages(int(n), start[n], stop) for n, stop in end.items() if start[n] < stop]

    def read(self, partition: Pages) -> Iterator[tuple]:
        term = self.source.terms[partition.number]
        for page in range(partition.start, partition.stop):
            found = self._read(partition.number, page) or self._fetch(partition.number, term, page)
            for pos, raw in found["rows"]:
                yield partition.number, term, page, pos, raw

    def _fetch(self, number: int, term: str, page: int) -> dict:
        """Ask for a page and keep it: what earlier pages of its query didn't have. A page that fails, or that has nothing
        new, is the last."""
        seen = {i for p in range(self.source.first, page) for i in (self._read(number, p) or {"ids": []})["ids"]}
        rows = []
        try:
            for pos, (name, raw) in enumerate(self.source.parts(self.source.client(), term, page)):
                name = hashlib.sha256(name.encode()).hexdigest()
                if name not in seen:
                    seen.add(name)
                    rows.append((pos, raw, name))
        except Exception as e:  # a page that fails ends its query, not the source
            log.error("query %r, page %d failed: %s", term, page, str(e)[:160])
            rows = []
        found = {"rows": [r[:2] for r in rows], "ids": [r[2] for r in rows], "ended": not rows}
        files, path = store(self.spool)
        files.create_dir(f"{path}/{number}", recursive=True)
        if not create(files, f"{path}/{number}/{page}.json", json.dumps(found)):
            found = self._read(number, page)  # another attempt was faster; its rows count
        return found

    def commit(self, end: dict) -> None:
        """Nothing to do: the spool is what the next offsets come from."""

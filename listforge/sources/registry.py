"""Sources by name, each isolated: one that fails is left out, and the others' rows are kept."""

from __future__ import annotations

import logging
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

log = logging.getLogger(__name__)


def union(sources: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, dict[str, str]]:
    """(rows of all sources in order, with source_rank; what went wrong with those that failed).

    A failure while a plan is made counts here; a source that may fail while it is read should be written first
    (see streaming.ingest), so that only its own job fails.
    """
    found, failed = [], {}
    for rank, (name, make) in enumerate(sources.items()):
        try:
            found.append(make().withColumn("source_rank", F.lit(rank)))
        except Exception as e:  # any source may be broken in any way
            log.error("source %r failed and was skipped: %s", name, str(e)[:200])
            failed[name] = str(e)[:200]
    return (reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found) if found else None), failed

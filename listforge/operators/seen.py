"""An index of keys that a growing archive has, for the anti join of every run.

Keys lie in a table that is bucketed and sorted by key, so that a run's few rows go to the buckets and the archive's side
of the join is never shuffled. Before that, Bloom filters rule out nearly all keys that are new: a filter is a table of
blocks of 32,768 bits, a key has all its seven bits in one block, and so the test is a join of the run's keys with one
row each. Every recorded snapshot adds blocks of its own, and blocks merge by a bitwise or. Neither the keys nor the
filters pass through the driver.

The filters' rows are what commits a snapshot: they carry the mark up to which the archive has been recorded. What
crashed between keys and filters is recorded again, which an anti join doesn't notice. One writer at a time.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files
from .dedup import written

BITS = 1 << 15
#: Bits of a key: four from one hash, three from another, 15 bits of the hash each.
PLACES = [(seed, 15 * i) for seed, n in ((1, 4), (2, 3)) for i in range(n)]
#: Keys that a block is made for: at 10.9 bits a key, seven bits give 0.6 % false positives, a little more in full blocks.
KEYS_PER_BLOCK = 3000
NOTHING = -(1 << 63)


def places(key: Column) -> list[Column]:
    return [F.shiftright(F.xxhash64(key, F.lit(seed)), at).bitwiseAND(F.lit(BITS - 1)) for seed, at in PLACES]


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """block and bits of a filter over column cu; partial bitmaps are made before the shuffle."""
    each = keys.select(block_of(F.col("cu"), blocks).alias("block"), F.explode(F.array(*places(F.col("cu")))).alias("at"))
    return each.groupBy("block").agg(F.bitmap_construct_agg("at").alias("bits"))


def merged(filters: DataFrame) -> DataFrame:
    """One filter of several: block and bits."""
    return filters.groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits"))


def may_hold(bits: Column, key: Column) -> Column:
    """Whether a block has all bits of a key."""
    found = F.lit(True)
    for at in places(key):
        byte = F.conv(F.hex(F.substring(bits, F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        found = found & (F.getbit(byte, at.bitwiseAND(F.lit(7)).cast("int")) == 1)
    return found


class Seen:
    """The index under one folder, which all executors see. A later session finds it there, whatever its catalog knows.

    expected: about how many keys there will be; buckets: into how many the keys are dealt. Both can grow in compact().
    """

    def __init__(self, spark: SparkSession, base: str, expected: int = 1_000_000, buckets: int = 64):
        self.spark, self.base = spark, base.rstrip("/")
        if not files.exists(spark, f"{self.base}/shape"):
            self._shape({"folder": "0", "buckets": buckets, "blocks": max(1, -(-expected // KEYS_PER_BLOCK))})
        self._open()

    def _shape(self, shape: dict) -> None:
        """Written under another name and moved, so that a reader finds the old or the new one."""
        fs, to = files._fs(self.spark, f"{self.base}/shape")
        _, other = files._fs(self.spark, f"{self.base}/shape-{uuid.uuid4().hex}")
        files.write_text(self.spark, other.toString(), json.dumps(shape))
        if fs.exists(to):
            fs.delete(to, False)
        fs.rename(other, to)

    def _open(self) -> None:
        shape = json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.base}/shape").collect()))
        self.folder, self.buckets, self.blocks = shape["folder"], shape["buckets"], shape["blocks"]
        self.keys = self._table("keys", "cu STRING", "cu", self.folder, self.buckets)
        self.filters = self._table("filters", "block INT, bits BINARY, mark BIGINT, snapshot STRING", "block", self.folder, self.buckets)

    def _table(self, name: str, columns: str, by: str, folder: str, buckets: int) -> str:
        """A bucketed table over a folder: the catalog's entry is made anew where it is missing, the files are found."""
        at = f"{self.base}/{folder}/{name}"
        table = f"seen_{name}_{hashlib.sha256(at.encode()).hexdigest()[:20]}"
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{at}'")
        self.spark.catalog.refreshTable(table)
        return table

    def mark(self) -> int:
        """Up to which order of arrival the archive is recorded; a very low number at first."""
        found = self.spark.table(self.filters).agg(F.max("mark")).first()[0]
        return NOTHING if found is None else found

    def record(self, keys: DataFrame, mark: int | None = None) -> None:
        """Add the keys in column cu as a snapshot; empty and null ones go. Each bucket gets one sorted file."""
        mark = self.mark() if mark is None else mark
        own = written(keys.where(F.col("cu") != "").select("cu").distinct(), "seen")
        own.repartition(self.buckets, "cu").sortWithinPartitions("cu").write.insertInto(self.keys)
        rows = bloom(own, self.blocks).select("block", "bits", F.lit(mark).cast("long").alias("mark"), F.lit(uuid.uuid4().hex).alias("snapshot"))
        if mark > NOTHING:  # so that a snapshot without keys moves the mark too
            rows = rows.unionByName(self.spark.createDataFrame([(-1, bytearray(1), mark, "mark")], rows.schema))
        rows.repartition(self.buckets, "block").sortWithinPartitions("block").write.insertInto(self.filters)
        for t in (self.keys, self.filters):
            self.spark.catalog.refreshTable(t)

    def catch_up(self, archive: DataFrame) -> None:
        """Record those rows of an archive (cu, row_idx) that came after what is recorded."""
        since = self.mark()
        rest = archive.where(F.col("row_idx") > since)
        last = rest.agg(F.max("row_idx")).first()[0]
        if last is not None:
            self.record(rest, last)

    def candidates(self, keys: DataFrame) -> DataFrame:
        """Those distinct keys that the filters can't rule out."""
        asked = keys.select("cu").distinct().withColumn("block", block_of(F.col("cu"), self.blocks))
        return asked.join(merged(self.spark.table(self.filters)), "block").where(may_hold(F.col("bits"), F.col("cu"))).select("cu")

    def known(self, keys: DataFrame) -> DataFrame:
        """Those distinct keys that are recorded. The archive's side is read bucket by bucket, as it lies."""
        maybe = written(self.candidates(keys), "maybe")
        return self.spark.table(self.keys).join(maybe, "cu", "left_semi").distinct()

    def unseen(self, new: DataFrame) -> DataFrame:
        """New rows whose key isn't empty and isn't recorded."""
        rows = written(new.where(F.col("cu") != ""), "arrivals")
        return rows.join(self.known(rows), "cu", "left_anti").select(*new.columns)

    def compact(self, expected: int | None = None, buckets: int | None = None) -> None:
        """Rewrite all snapshots as one, a sorted file a bucket, with room for so many keys. The old files go last."""
        old, mark, keys = self.folder, self.mark(), self.spark.table(self.keys).distinct()
        shape = {"folder": uuid.uuid4().hex, "buckets": buckets or self.buckets, "blocks": -(-expected // KEYS_PER_BLOCK) if expected else self.blocks}
        stale = (self.keys, self.filters)
        self.folder, self.buckets, self.blocks = shape["folder"], shape["buckets"], shape["blocks"]
        self.keys = self._table("keys", "cu STRING", "cu", self.folder, self.buckets)
        self.filters = self._table("filters", "block INT, bits BINARY, mark BIGINT, snapshot STRING", "block", self.folder, self.buckets)
        self.record(keys, mark)
        self._shape(shape)
        for t in stale:
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")
        fs, p = files._fs(self.spark, f"{self.base}/{old}")
        fs.delete(p, True)

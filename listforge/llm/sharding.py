"""Sharding by histogram sort, in DataFrame operations only.

Every row gets a 64-bit sort key: the upper 40 bits hash the text, the lower 24 hash the id. Equal texts are
neighbours in that order, yet a group of copies of any size can still be divided. Splitters are found by counting
exact bytes below candidate boundaries over all partitions: each round refines only the brackets that hold an
unfinished splitter, by twelve or sixteen more bits, until the bytes below meet the tolerance or single keys are
reached. The rows then move once, to (shard, lane), where their slots are numbered.

Defined results: a null text counts as empty (size 1, crc 0); repeated rows are separate rows; an empty table gives
an empty result; other columns of the input are carried along, those named like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, table, without

#: Bits of the key that a round adds; the sum is 64, and the first three end at the edge between groups of copies.
ROUNDS = (12, 12, 16, 12, 12)
ID_BITS = 24
#: Slots are numbered in so many lanes of each shard, so that no task holds a whole shard.
LANES = 512
#: Allowed distance of a splitter from its target, as a share of one shard's bytes.
TOLERANCE = 0.001
ADDS = ("size", "text_crc32", "law", "shard", "slot", "key", "lane", "base", "grown_shard")


def sort_key(text, doc_id):
    low = (1 << ID_BITS) - 1
    return F.xxhash64(text).bitwiseAND(F.lit(~low)).bitwiseOR(F.xxhash64(doc_id).bitwiseAND(F.lit(low)))


def splitters(keys: DataFrame, n_shards: int, tolerance: float = TOLERANCE) -> list[int]:
    """Ascending boundaries: a row's shard is the number of boundaries at or below its key. keys: key long, size long.

    The driver gets at most 4,096 counts a bracket (65,536 in the third round) and n_shards - 1 brackets a round.
    """
    done = 0
    brackets: dict[int, float] = {}  # prefix of `done` bits -> bytes below it
    found: dict[int, tuple[float, int]] = {}
    open_: dict[int, int] = {i: 0 for i in range(1, n_shards)}  # splitter -> prefix of its bracket
    total = 0.0
    for bits in ROUNDS:
        shift = 64 - done - bits
        rows = keys if not done else keys.where(F.shiftright("key", 64 - done).isin([int(p) for p in set(open_.values())]))
        got = sorted((r["p"], r["b"]) for r in rows.groupBy(F.shiftright("key", shift).alias("p")).agg(F.sum("size").alias("b")).collect())
        if not done:
            total = float(sum(b for _, b in got))
            brackets = {0: 0.0}
        below: dict[int, float] = {}
        if total == 0:
            return [(1 << 63) - 1] * (n_shards - 1)
        still: dict[int, int] = {}
        for i, bracket in open_.items():
            target, run, at = total * i / n_shards, brackets[bracket], None
            for p, b in got:
                if done and p >> bits != bracket:
                    continue
                for cut, key in ((run, p), (run + b, p + 1)):
                    best = found.get(i)
                    if best is None or abs(cut - target) < best[0]:
                        found[i] = (abs(cut - target), key << shift)
                if run <= target < run + b:
                    at, below[p] = p, run
                run += b
            if found[i][0] > tolerance * total / n_shards and at is not None:
                still[i] = at
        open_, brackets, done = still, {p: below[p] for p in still.values()}, done + bits
        if not open_:
            break
    return [found[i][1] for i in range(1, n_shards)]


def keyed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with size, text_crc32 and the sort key."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return without(docs, *ADDS).withColumns({
        "size": F.octet_length(whole).cast("long") + 1,
        "text_crc32": F.crc32(whole.cast("binary")),
        "key": sort_key(whole, F.col(doc_id)),
    })


def place(rows: DataFrame, keys: DataFrame, n_shards: int, tolerance: float, doc_id: str) -> DataFrame:
    """rows (with key) in their shards and slots; keys: the same rows' key and size, cheap to read again."""
    cuts = splitters(keys, n_shards, tolerance)
    number = F.lit(0)
    for cut in cuts:
        number = number + (F.col("key") >= F.lit(min(cut, (1 << 63) - 1))).cast("int")
    lane = F.col("key").bitwiseAND(F.lit(LANES - 1)).cast("int")
    # n_shards * LANES counts, whatever the input: small enough for the driver and a broadcast.
    counts = sorted((r["shard"], r["lane"], r["count"]) for r in keys.groupBy(number.alias("shard"), lane.alias("lane")).count().collect())
    bases, run, last = [], 0, None
    for at, of, count in counts:
        run = run if at == last else 0
        bases.append((at, of, run))
        run, last = run + count, at
    offsets = rows.sparkSession.createDataFrame(bases, "shard int, lane int, base long")
    order = Window.partitionBy("shard", "lane").orderBy("key", doc_id, "text_crc32")
    return (
        rows.withColumns({"shard": number, "lane": lane})
        .withColumn("slot", F.row_number().over(order).cast("long") - 1)
        .join(F.broadcast(offsets), ["shard", "lane"])
        .withColumns({"slot": F.col("slot") + F.col("base"), "law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})
        .drop("lane", "base", "key")
    )


def shard(docs: DataFrame, n_shards: int = 8, tolerance: float = TOLERANCE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with size, text_crc32, law, shard and slot. Shards hold near equal bytes; slots are gapless from 0."""
    rows = keyed(docs, text, doc_id)
    return place(rows, materialize(rows.select("key", "size"), "shard-keys"), n_shards, tolerance, doc_id)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all documents in shards 0 to 7 under the law of equal bytes; only digests of the texts move."""
    rows = materialize(keyed(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "shard-keys")
    out = place(rows, rows, 8, TOLERANCE, "doc_id")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")

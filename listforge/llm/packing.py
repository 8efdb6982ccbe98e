"""Best-fit packing by a configuration linear program over the length histogram.

A configuration says how many pieces of each length share a sequence. The program covers the histogram with the fewest
sequences; it has far too many configurations to list, so multiplicative weights price the lengths and a knapsack
dynamic program finds the configurations worth most at these prices. Prices bound the program from below, and its end is
by the gap to that bound. Rounding takes whole numbers of configurations and closes with best-fit configurations of the
remainder, each as often as it fits. The program sees at most 1,024 counts, whatever the number of documents; pieces then
find their sequence by their length and their rank among pieces of that length, which is counted in lanes so that a
frequent length stays divided.

Defined results: a null text counts as empty and is one piece with the end id alone; repeated rows are packed each on
their own (ranks among fully equal rows are any), and so are rows of one id, whatever their texts; a text of any length is
cut into as many pieces as it takes; an empty table gives an empty result; other columns of documents, whatever their
names, don't pass through, while `pack` carries those of pieces along (see there).
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bpe
from .common import arrow, materialize, small_batches, table

CAPACITY = 1024
#: The program: how fast a length gets cheaper as its demand is met, the share of a demand that a round meets at most, the
#: gap to the bound at which it ends, and otherwise how many turns of how many rounds it takes.
ETA, STEP, GAP, TURNS, ROUNDS = 0.5, 0.5, 0.001, 6, 40
#: Lengths that a table of the dynamic program serves, and how much dearer a token of a long piece is than one of a short
#: piece when the cover is chosen: among near equals, short ones are kept to fill what long ones leave.
FROM_TABLE, LONG = 8, 1.0
#: Pieces of one length are ranked in lanes of about so many.
LANE_ROWS = 50_000
#: Tokens that configurations may leave free when not all of the program's are kept.
WASTE = (16, 4, 1)

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"

Configuration = tuple[tuple[int, int], ...]  # (length, how many), longest first


def _cut(path: str, end_id: int, capacity: int):
    def run(batches):
        encoder, end = bpe.encoder(path), np.array([end_id], "<u4").tobytes()
        for group in bpe.grouped(batches):
            ids, bounds = encoder.encoded(group.column(1)).joined()
            data, rows = memoryview(ids.astype("<u4").tobytes()), []
            for doc_id, low, high in zip(group.column(0).to_pylist(), bounds.tolist(), bounds[1:].tolist(), strict=False):
                n = high - low + 1
                first = n % capacity or capacity
                for k, start in enumerate([0, *range(first, n, capacity)]):
                    stop = first if not k else start + capacity
                    # The end id stands behind the document's own ids.
                    crc = zlib.crc32(data[4 * (low + start) : 4 * min(low + stop, high)])
                    rows.append((doc_id, k, start, stop - start, zlib.crc32(end, crc) if stop == n else crc))
            yield arrow(rows, PIECES)

    return run


def pieces_of(docs: DataFrame, path: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32: whole documents, and longer ones cut, the first piece the shorter."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_cut(path, end_id, capacity), PIECES_DDL)


def valued(prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the worth of each room at best, and the length to take there first."""
    lengths = np.flatnonzero(prices > 0)
    value, choice, worth = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64), prices[lengths]
    for c in range(1, capacity + 1):
        n = int(np.searchsorted(lengths, c, side="right"))
        value[c] = value[c - 1]
        if n:
            sums = worth[:n] + value[c - lengths[:n]]
            k = int(sums.argmax())
            if sums[k] > value[c]:
                value[c], choice[c] = sums[k], lengths[k]
    return value, choice


def chosen(choice: np.ndarray, capacity: int, first: int = 0) -> dict[int, int]:
    """The dearest configuration, or the dearest of those that hold the length `first`."""
    counts, room = ({first: 1}, capacity - first) if first else ({}, capacity)
    while room > 0:
        n = int(choice[room])
        counts[n] = counts.get(n, 0) + 1
        room -= n or 1
    counts.pop(0, None)
    return counts


@dataclass
class Program:
    """A fractional solution: configurations with counts that hold exactly the histogram, and a lower bound of any."""

    parts: list[tuple[Configuration, float]]
    bound: float

    @property
    def value(self) -> float:
        return sum(x for _, x in self.parts)


def swept(need: np.ndarray, prices: np.ndarray, capacity: int) -> list[tuple[Configuration, float]]:
    """Configurations that meet each demand exactly, the dearest at these prices for one length after the other.

    The longest length that isn't met goes first. A length whose demand is met has no more price, so that what follows is
    chosen among the others; a table of the dynamic program serves a few lengths before it is made anew.
    """
    left, prices, taken = need.copy(), prices.copy(), {}
    while len(open_ := np.flatnonzero(left)):
        _, choice = valued(prices, capacity)
        for n in open_[::-1][:FROM_TABLE]:
            config = chosen(choice, capacity, int(n))
            while all(left[k] > 0 for k in config):
                step = min(left[k] / m for k, m in config.items())
                key = tuple(sorted(config.items(), reverse=True))
                taken[key] = taken.get(key, 0.0) + step
                for k, m in config.items():
                    left[k] -= step * m
                    if left[k] <= 1e-9 * need[k]:
                        left[k] = prices[k] = 0.0
    return list(taken.items())


def fractional(histogram: np.ndarray, capacity: int = CAPACITY, eta: float = ETA) -> Program:
    """The configuration program, by multiplicative weights.

    A price for each length, scaled so that no configuration is worth more than one sequence, bounds any solution from
    below (by what all demands are worth). Prices begin in proportion to lengths. A round takes the dearest configuration
    as often as meets one of its demands in part (its width), and weights the lengths that it holds down by the share of
    their demand that it meets: lengths that rounds leave uncovered get relatively dearer, and where prices by length are
    wrong, as for pieces that leave a gap which nothing fills, they move to where the bound is. The best prices found then
    choose the configurations that cover the histogram. The program ends when its cover is within GAP of its bound, or
    after a bounded number of rounds.
    """
    need = histogram.astype(float)
    lengths = np.flatnonzero(need)
    if not len(lengths):
        return Program([], 0.0)
    prices = np.where(need > 0, np.arange(len(need)) / capacity, 0.0)
    weights, best, parts, worth, rate, tilt = np.zeros(len(need)), 0.0, [], np.inf, eta, LONG
    for turn in range(TURNS):
        for _ in range(1 if not turn else ROUNDS):
            now = prices * np.exp(weights - weights[lengths].max())
            value, choice = valued(now, capacity)
            bound = float(need @ now) / value[capacity]
            if bound > best * (1 + 1e-9):
                best, best_prices = bound, now / value[capacity]
            config = chosen(choice, capacity)
            share = STEP * min(need[k] / m for k, m in config.items())
            for k, m in config.items():
                weights[k] -= rate * share * m / need[k]
        found = swept(need, best_prices * (1 + tilt * np.arange(len(need)) / capacity), capacity)
        if (total := sum(x for _, x in found)) < worth:
            parts, worth = found, total
        if worth <= best * (1 + GAP) or not eta:
            break
        rate, tilt = rate * 0.55, tilt * 0.6  # smaller steps, nearer to the bound
    return Program(parts, best)


def best_fit(left: np.ndarray, capacity: int) -> Configuration:
    """The longest piece left, then again and again the longest that still fits."""
    room, counts, have = capacity, {}, left.copy()
    while True:
        fits = np.flatnonzero(have[: room + 1])
        if not len(fits) or not room:
            break
        n = int(fits[-1])
        k = min(int(have[n]), room // n)
        counts[n] = k
        have[n] -= k
        room -= n * k
    return tuple(sorted(counts.items(), reverse=True))


def rounded(parts: list[tuple[Configuration, float]], left: np.ndarray, capacity: int, waste: int) -> tuple[list[tuple[Configuration, int]], np.ndarray]:
    """Whole numbers of those configurations that leave at most `waste` tokens free, and what they don't hold."""
    out, left = [], left.copy()
    for config, x in sorted(parts, key=lambda cx: -cx[1]):
        times = min(int(x + 1e-6), *(int(left[n]) // k for n, k in config))
        if times and capacity - sum(n * k for n, k in config) <= waste:
            out.append((config, times))
            for n, k in config:
                left[n] -= k * times
    return out, left


def closed(left: np.ndarray, capacity: int) -> list[tuple[Configuration, int]]:
    """Best-fit configurations that hold the rest, each as often as it fits."""
    out, left = [], left.copy()
    while left.any():
        config = best_fit(left, capacity)
        times = min(int(left[n]) // k for n, k in config)
        out.append((config, times))
        for n, k in config:
            left[n] -= k * times
    return out


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Configuration, int]]:
    """Configurations and how often each is used; together they hold exactly the histogram.

    Rounding is tried with all configurations of the program and with those that leave little free, whose pieces the rest
    would miss; the fewest sequences win, among equals the largest part that the program places.
    """
    left = np.zeros(capacity + 1, np.int64)
    for n, k in histogram.items():
        left[n] = k
    out = [(((capacity, 1),), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    parts = fractional(left, capacity).parts
    found = []
    for waste in (capacity, *WASTE):
        whole, rest = rounded(parts, left, capacity, waste)
        found.append(whole + closed(rest, capacity))
    return out + min(found, key=lambda f: sum(times for _, times in f))


ADDED = ("sequence_id", "offset", "_lane", "_lanes", "_rank", "_before", "_low", "_high", "_many", "_sequence", "_place")


def ranked(pieces: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """pieces with `_rank`: gapless from 0 among those of a length. A length has as many lanes as its pieces need."""
    spark = pieces.sparkSession
    lanes = spark.createDataFrame([(n, -(-k // LANE_ROWS)) for n, k in histogram.items()], "length long, _lanes int")
    laned = pieces.join(F.broadcast(lanes), "length").withColumn("_lane", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("_lanes")).cast("int"))
    counts = sorted((r["length"], r["_lane"], r["count"]) for r in laned.groupBy("length", "_lane").count().collect())
    bases, run, last = [], 0, None
    for n, at, k in counts:  # at most one for each length and one for LANE_ROWS pieces
        run = run if n == last else 0
        bases.append((n, at, run))
        run, last = run + k, n
    before = spark.createDataFrame(bases, "length long, _lane int, _before long")
    order = Window.partitionBy("length", "_lane").orderBy("doc_id", "piece")
    return laned.withColumn("_rank", F.row_number().over(order).cast("long") - 1).join(F.broadcast(before), ["length", "_lane"]).withColumn("_rank", F.col("_rank") + F.col("_before"))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (with doc_id, piece, length and ids_crc32, a written table) with sequence_id and offset.

    Pieces that fill a sequence alone need no rank. Further columns of pieces are carried along, but for those named like
    the two and those that begin with an underscore.
    """
    spark = pieces.sparkSession
    pieces = pieces.select(*[F.col(f"`{c}`") for c in pieces.columns if c.lower() not in ADDED[:2] and not c.startswith("_")])
    histogram = {int(r["length"]): int(r["count"]) for r in pieces.groupBy("length").count().collect()}
    full = histogram.pop(capacity, 0)
    slots, used, sequence = [], {}, 0
    for config, times in solve(histogram, capacity):
        at = 0
        for n, k in config:
            low = used.get(n, 0)
            used[n] = low + k * times
            slots.append((n, low, used[n], k, sequence, at))
            at += n * k
        sequence += times
    # One row for each length of a configuration: their number depends on the capacity, not on the documents.
    table_ = spark.createDataFrame(slots, "length long, _low long, _high long, _many int, _sequence long, _place int")
    found = ranked(pieces.where(F.col("length") < capacity), histogram).join(F.broadcast(table_), "length").where((F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_high")))
    at = F.col("_rank") - F.col("_low")
    found = found.select(*pieces.columns, (F.col("_sequence") + F.floor(at / F.col("_many")).cast("long")).alias("sequence_id"), (F.col("_place") + at % F.col("_many") * F.col("length")).alias("offset"))
    if not full:
        return found
    alone = pieces.where(F.col("length") == capacity).select(*pieces.columns, (F.monotonically_increasing_id() + sequence).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return found.unionByName(alone)


def op5(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Contract query: all documents in sequences of at most 1,024 tokens. Texts are read once."""
    pieces = materialize(pieces_of(table(spark, sf_dir, "documents").select("doc_id", "text"), path or bpe.default_vocabulary()), "pieces")
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

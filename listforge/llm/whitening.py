"""Embedding whitening by hierarchical merging of singular value decompositions.

Entries become whole numbers, whose sums are exact. A task decomposes its vectors, centred on their own mean, chunk by
chunk, and keeps all singular values and right singular vectors, the number of vectors and their exact sums. Two such
parts merge without loss: their scaled singular vectors are stacked, a row for the distance of the two means is added
(times sqrt(n1 n2 / (n1 + n2))), and the stack, of at most 2 d + 1 rows for d dimensions, is decomposed again. Parts merge
16 at a time, level by level, in tasks; no product of the data with itself is formed, and no dimension is dropped on the
way. What reaches the driver and is sent to all tasks are d singular values, d * d entries and d sums: the dimension
bounds them, not the number of rows. Whitened vectors are stored, and their own covariance is measured from what was
stored, by a second tree of merges.

Defined results: rows whose vector is null, or has a null, NaN or infinite entry, go; so do those with an entry that
is beyond 2 ** 52 when multiplied by 64, since it has no exact whole number here, and those whose vector hasn't the
commonest length (the longest of equals), since they have no common space. Repeated rows count as often as they occur,
and ids, null ones too, only pass through. Components whose singular value is under a 10 ** 11th of the largest (as for
constant dimensions, or fewer vectors than dimensions) have no direction and aren't returned. An empty table, or one
whose vectors are all equal, has no components and gives no rows. Deviations that don't fit a long are null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, materialize, small_batches, table

SCALE, OFFSET = 64, 1_000_000
#: Entries times SCALE are below this, so that doubles hold them exactly.
LIMIT = float(1 << 52)
#: Rows that a task decomposes at once, and parts that a merge takes.
CHUNK, FANIN = 4096, 16
SMALLEST = 1e-11
COMPONENTS = 32

PART = "n long, sums array<decimal(38,0)>, values array<double>, vectors binary"
MOMENTS = "n long, mean array<double>, products binary"


def whole(vector: Column) -> Column:
    """x of every entry, an exact long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + OFFSET)


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is whole, in column x, all of one length."""
    ok = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) * SCALE < LIMIT))  # false for NaN, which is largest
    kept = rows.where(F.col(vector).isNotNull() & F.coalesce(ok, F.lit(False)) & (F.size(vector) > 0))
    lengths = kept.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return kept.where(F.size(vector) == (lengths[0]["d"] if lengths else -1)).withColumn("x", whole(F.col(vector)))


def matrix(column) -> np.ndarray:
    """The rows of an Arrow column of lists of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


Part = tuple[int, list[int], np.ndarray, np.ndarray]


def decomposed(x: np.ndarray) -> Part:
    """The part of a chunk: n, exact sums, singular values and vectors of the centred rows."""
    sums = [int(s) for s in (x.sum(axis=0) if np.abs(x).max() < (1 << 62) // len(x) else x.astype(object).sum(axis=0))]
    near = x[0]  # differences from a row are exact, and so is their mean's distance from it but for one division
    rest = np.array([float(s - len(x) * int(v)) / len(x) for s, v in zip(sums, near, strict=True)])
    _, values, vectors = np.linalg.svd((x - near).astype(np.float64) - rest, full_matrices=False)
    return len(x), sums, values, vectors


def merged(a: Part, b: Part) -> Part:
    """The part of all rows of two parts: nothing is lost but rounding."""
    (n, sums, values, vectors), (m, others, more, directions) = a, b
    apart = np.array([(s * m - t * n) / (n * m) for s, t in zip(sums, others, strict=True)])  # of whole numbers, rounded once
    stack = np.vstack([values[:, None] * vectors, more[:, None] * directions, np.sqrt(n / (n + m) * m) * apart])
    _, values, vectors = np.linalg.svd(stack, full_matrices=False)
    return n + m, [s + t for s, t in zip(sums, others, strict=True)], values, vectors


def _part_row(p: Part) -> tuple:
    from decimal import Decimal

    return p[0], [Decimal(s) for s in p[1]], p[2].tolist(), np.ascontiguousarray(p[3], "<f8").tobytes()


def _part(row: tuple) -> Part:
    return row[0], [int(s) for s in row[1]], np.array(row[2]), np.frombuffer(row[3], "<f8").reshape(len(row[2]), -1)


def moments(y: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    mean = y.mean(axis=0)
    return len(y), mean, (y - mean).T @ (y - mean)


def merged_moments(a: tuple, b: tuple) -> tuple:
    (n, mean, products), (m, other, more) = a, b
    apart = other - mean
    return n + m, mean + apart * (m / (n + m)), products + more + np.outer(apart, apart) * (n / (n + m) * m)


def _moments_row(p: tuple) -> tuple:
    return p[0], p[1].tolist(), np.ascontiguousarray(p[2], "<f8").tobytes()


def _moments(row: tuple) -> tuple:
    return row[0], np.array(row[1]), np.frombuffer(row[2], "<f8").reshape(len(row[1]), -1)


def _types(ddl: str):
    import pyarrow as pa

    kinds = {"long": pa.int64(), "array<decimal(38,0)>": pa.list_(pa.decimal128(38, 0)), "array<double>": pa.list_(pa.float64()), "binary": pa.binary()}
    return pa.schema([(f.split(" ")[0], kinds[f.split(" ")[1]]) for f in ddl.split(", ")])


def gathered(rows: DataFrame, column: str, ddl: str, of: Callable, merge: Callable, to_row: Callable, from_row: Callable, name: str, fanin: int = FANIN) -> tuple | None:
    """What `of` finds in chunks of rows, merged by tasks, `fanin` parts at a time until one is left; None of no rows."""

    def first(batches: Iterator) -> Iterator:
        part, waiting, n = None, [], 0
        for batch in batches:
            if batch.num_rows:
                waiting.append(matrix(batch.column(column)))
                n += batch.num_rows
            if n >= CHUNK:
                found, waiting, n = of(np.vstack(waiting)), [], 0
                part = found if part is None else merge(part, found)
        if waiting:
            found = of(np.vstack(waiting))
            part = found if part is None else merge(part, found)
        if part is not None:
            yield arrow([to_row(part)], _types(ddl))

    def further(batches: Iterator) -> Iterator:
        """Parts of one group after the other, in order."""
        at, part = None, None
        for batch in batches:
            for group, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group != at and part is not None:
                    yield arrow([to_row(part)], _types(ddl))
                at, part = group, from_row(row) if group != at else merge(part, from_row(row))
        if part is not None:
            yield arrow([to_row(part)], _types(ddl))

    names = [f.split(" ")[0] for f in ddl.split(", ")]
    parts = materialize(rows.select(column).mapInArrow(first, ddl), name)
    while (count := parts.count()) > 1:
        group = F.pmod(F.xxhash64("_at"), F.lit(-(-count // fanin)))
        dealt = parts.withColumn("_at", F.monotonically_increasing_id()).withColumn("_group", group).repartition("_group").sortWithinPartitions("_group", "_at")
        parts = materialize(dealt.select("_group", *names).mapInArrow(further, ddl), name)
    found = parts.first()
    return None if found is None else from_row(tuple(found))


def fitted(rows: DataFrame) -> Part | None:
    """n, exact sums, singular values and components (as rows) of column x, centred."""
    return gathered(rows, "x", PART, decomposed, merged, _part_row, _part, "whitening-parts")


def whiten(rows: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", components: int = COMPONENTS) -> tuple[DataFrame, np.ndarray, int]:
    """(vec_id, deviation as a decimal, whitened array of each usable row; eigenvalues' shares of the variance; n)."""
    import pyarrow as pa

    small_batches(rows.sparkSession)
    kept = usable(rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("_v")), "_v").select("vec_id", "x")
    fit = fitted(kept)
    ddl = f"vec_id {dict(kept.dtypes)['vec_id']}, deviation decimal(38,0), whitened array<double>"
    if fit is None or not len(fit[2]) or not fit[2][0]:
        return rows.sparkSession.createDataFrame([], ddl), np.zeros(0), 0 if fit is None else fit[0]
    n, sums, values, vectors = fit
    variances = values**2 / n
    k = min(components, int((values > SMALLEST * values[0]).sum()))
    project = (vectors[:k] / np.sqrt(variances[:k])[:, None]).T
    near = [s // n for s in sums]
    left = np.array([(s - n * v) / n for s, v in zip(sums, near, strict=True)])

    def run(batches: Iterator) -> Iterator:
        from decimal import Decimal

        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("x"))
            small = n * (int(np.abs(x).max()) + max(map(abs, near)) + 1) < 1 << 62
            off = n * x - np.array(sums) if small else n * x.astype(object) - np.array(sums, dtype=object)
            if not small or int(np.abs(off).max()) ** 2 * off.shape[1] >= 1 << 62:
                off = off.astype(object)
            deviation = [Decimal(int(v)) for v in (off * off).sum(axis=1)]
            y = ((x - np.array(near)).astype(np.float64) - left) @ project
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(deviation, pa.decimal128(38, 0)), pa.array(list(y), pa.list_(pa.float64()))], names=["vec_id", "deviation", "whitened"])

    return materialize(kept.mapInArrow(run, ddl), "whitened"), variances / variances.sum(), n


def identity_error(whitened: DataFrame) -> float:
    """The largest entry, in absolute terms, of the covariance of the whitened vectors minus the identity."""
    found = gathered(whitened, "whitened", MOMENTS, moments, merged_moments, _moments_row, _moments, "whitened-moments")
    return 0.0 if found is None else float(np.abs(found[2] / found[0] - np.eye(len(found[1]))).max())


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all embeddings, whitened, with up to 32 components."""
    whitened, shares, n = whiten(table(spark, sf_dir, "embeddings"))
    each = whitened.select("vec_id", F.expr("try_cast(deviation AS long)").alias("deviation"), F.posexplode("whitened").alias("i", "whitened"))
    explained = F.get(F.array(*[F.lit(float(s)) for s in shares[:COMPONENTS]]) if len(shares) else F.array().cast("array<double>"), F.col("i"))
    return each.select(
        "vec_id", (F.col("i") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"),
        F.lit(identity_error(whitened)).alias("identity_error"),
    )

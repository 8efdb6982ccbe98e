"""De-duplication. Rows carry their order of arrival in row_idx."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


_WRITTEN: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there and no executor is needed to read it again.

    The folder is spark.checkpoint.dir. Where it is unset, a session on one machine (local mode) gets one of its own; any
    other session must name one.
    """
    spark: SparkSession = df.sparkSession
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='listforge-')}"
        spark.conf.set("spark.checkpoint.dir", base)
        atexit.register(shutil.rmtree, base.removeprefix("file://"), ignore_errors=True)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """written(df, name), and aggregates of its rows, gathered by the tasks that write them.

    They hold under retries: the observation stands above all shuffles, and of a writing task only the attempt counts that
    succeeds.
    """
    seen = Observation(name)
    out = written(df.observe(seen, *[c.alias(k) for k, c in counts.items()]), name)
    found = seen.get
    return out, {k: found.get(k) or 0 for k in counts}


def clear(spark: SparkSession, since: int = 0, but: int = 0) -> int:
    """Delete what this process wrote to the shared folder, from the table numbered `since` on, but for the last so many."""
    stop = len(_WRITTEN) - but
    gone = _WRITTEN[since:stop]
    for path in gone:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    del _WRITTEN[since:stop]
    return len(gone)


def mark() -> int:
    """How many tables there are now; for clear."""
    return len(_WRITTEN)


def first_per(df: DataFrame, *keys: str, order: str | tuple = "row_idx") -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*(order if isinstance(order, tuple) else (order,)))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def best_per_url(df: DataFrame, url: str = "cu", score: str = "score_n", order: str = "row_idx") -> DataFrame:
    """The best row of each URL, the first of equals, with first_idx, where the URL appeared first. Empty URLs go.

    Score and order (which tells rows apart) are packed into one number, so that one hash aggregate with partial sums finds
    the best row of each URL, however many rows it has; the rows themselves are then joined by their order alone, and the
    URL, which may be dear to compute, comes from the aggregate.
    """
    # Orders are moved above zero; a score weighs more than any of them.
    unit = F.lit(Decimal(10**20))
    place = F.col(order).cast("decimal(20,0)") + F.lit(Decimal(1 << 63))
    packed = F.coalesce(F.col(score), F.lit(-(1 << 31))).cast("decimal(11,0)") * unit - place
    found = df.where(F.col(url) != "").groupBy(F.col(url).alias("_url")).agg(F.max(packed).alias("_best"), F.min(order).alias("first_idx"))
    best = found.select("_url", (F.pmod(-F.col("_best"), unit) - F.lit(Decimal(1 << 63))).cast("long").alias("_order"), "first_idx")
    rows = df.join(best, F.col(order).cast("long") == F.col("_order"))
    return rows.select(*[F.col("_url").alias(c) if c == url else F.col(c) for c in df.columns], "first_idx")


#: Rows that one task may read in order. Beyond them the undecided rows are divided.
READER_ROWS = 200_000
#: Rounds that decide what is first of both its keys, before rows are divided. They decide nearly all rows of usual tables.
FIRST_ROUNDS = 2


def _read_in_order(batches):
    """Rows (i, u, r) sorted by i, of which none shares a key with rows elsewhere: those that are kept."""
    import pyarrow as pa

    urls, roles = set(), set()
    for batch in batches:
        keep = []
        for u, r in zip(batch.column("u").to_pylist(), batch.column("r").to_pylist(), strict=True):
            keep.append(u not in urls and (r is None or r not in roles))
            if keep[-1]:
                urls.add(u)
                roles.add(r)
        yield batch.filter(pa.array(keep, pa.bool_()))


def _read(rows: DataFrame, readers: int, *by: str) -> DataFrame:
    """Those rows that sequential readers keep, rows of equal `by` with one reader each."""
    dealt = rows.repartition(readers, *by) if by else rows.repartition(1)
    return dealt.sortWithinPartitions("i").select("i", "u", "r").mapInArrow(_read_in_order, "i long, u string, r string")


def _without_barred(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """rows that share no key with kept rows. Rows without a role, however many, skip that join."""
    left = rows.join(kept.select("u"), "u", "left_anti").select(*rows.columns)
    by_role = left.where("r is not null").join(kept.where("r is not null").select("r"), "r", "left_anti").select(*rows.columns)
    return left.where("r is null").unionByName(by_role)


def _firsts(rows: DataFrame) -> DataFrame:
    """rows with keep: whether they are the first of both their keys."""
    by_url = rows.groupBy("u").agg(F.min("i").alias("iu"))
    by_role = rows.where("r is not null").groupBy("r").agg(F.min("i").alias("ir"))
    named = rows.where("r is not null").join(by_role, "r").unionByName(rows.where("r is null").withColumn("ir", F.col("i")))
    return named.join(by_url, "u").select("i", "u", "r", ((F.col("i") == F.col("iu")) & (F.col("i") == F.col("ir"))).alias("keep"))


def components(rows: DataFrame) -> DataFrame:
    """rows (i, u, r, with i unique) with c, the smallest i of all rows that they are tied to by shared keys.

    Every row is tied to the first row of each of its keys. Then large and small stars alternate until nothing changes: a
    row's later neighbours are tied to its first one, then its earlier ones are. Distances shrink by a factor a round, so
    that a chain of any length takes a few rounds, each one job.
    """
    by_role = rows.where("r is not null").groupBy("r").agg(F.min("i").alias("j"))
    by_url = rows.groupBy("u").agg(F.min("i").alias("j"))
    ties = rows.join(by_url, "u").select("i", "j").unionByName(rows.join(by_role, "r").select("i", "j")).where("i <> j")
    ties, before = written(ties.distinct(), "ties"), None
    while True:
        both = ties.unionByName(ties.select(F.col("j").alias("i"), F.col("i").alias("j")))
        first = both.groupBy("i").agg(F.min("j").alias("m")).withColumn("m", F.least("m", "i"))
        large = both.where("j > i").join(first, "i").select(F.col("j").alias("i"), F.col("m").alias("j")).distinct()
        # Now each row's tied rows are earlier ones: the smallest of them gets the others and the row itself.
        first = large.groupBy("i").agg(F.min("j").alias("m"))
        small = large.join(first, "i").select(F.explode(F.array("i", "j")).alias("i"), F.col("m").alias("j")).where("i <> j").distinct()
        ties = written(small, "ties")
        now = ties.agg(F.count("*"), F.sum(F.xxhash64("i", "j").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    first = ties.groupBy("i").agg(F.min("j").alias("c"))
    return rows.join(first, "i", "left").withColumn("c", F.coalesce("c", "i"))


def greedy_two_keys(df: DataFrame, url: str = "cu", role: str = "rk", order: str = "row_idx", reader_rows: int = READER_ROWS, first_rounds: int = FIRST_ROUNDS) -> DataFrame:
    """Rows that a reader in order of arrival keeps when each kept row bars its URL and, if not empty, its role.

    A dropped row bars nothing. order, a long, tells rows apart. A null role counts as empty; rows with an empty or null
    URL go. Up to reader_rows undecided rows are simply read in order by one task. Where there are more, two rounds keep
    those that are first of both their keys and drop what these bar; the rest falls into components, rows tied by shared
    keys, which don't affect one another, and tasks read whole components in order. A component that alone is beyond
    reader_rows is cut by order of arrival, and what one stretch keeps bars rows of the next, so that a task is bounded
    however rows are tied, and the number of rounds grows with the largest component, not with the longest chain.
    """
    since = mark()
    rest = df.where(F.col(url) != "").select(F.col(order).cast("long").alias("i"), F.col(url).alias("u"), F.when(F.col(role) != "", F.col(role)).alias("r"))
    rest, kept = written(rest, "dedup"), []
    n = rest.count()
    for _ in range(first_rounds):
        if n <= reader_rows:
            break
        marked = written(_firsts(rest), "dedup")
        now = marked.where("keep").drop("keep")
        kept.append(now)
        rest = written(_without_barred(marked.where("not keep").drop("keep"), now), "dedup")
        n = rest.count()
    kept += [_read(rest, 1)] if n <= reader_rows else _by_components(rest, n, reader_rows)
    found = written(reduce(DataFrame.unionByName, kept).select("i"), "kept")
    clear(df.sparkSession, since, 1)
    return df.join(found.select(F.col("i").alias(order)), order, "left_semi")


def _by_components(rest: DataFrame, n: int, reader_rows: int) -> list[DataFrame]:
    """Those of n undecided rows that are kept, in parts."""
    rest = written(components(rest), "dedup")
    sizes = written(rest.groupBy("c").agg(F.count("*").alias("n")), "sizes")
    large, most, readers = sizes.where(F.col("n") > reader_rows), sizes.agg(F.max("n")).first()[0], -(-4 * n // reader_rows)
    kept = [_read(rest.join(large.select("c"), "c", "left_anti"), readers, "c")]
    if most <= reader_rows:
        return kept
    stretches = -(-2 * most // reader_rows)
    shares = [k / stretches for k in range(1, stretches)]
    # There are at most n / reader_rows large components, of which each has its bounds in one row.
    bounds = rest.join(large.select("c"), "c").groupBy("c").agg(F.percentile_approx("i", shares, 100 * stretches).alias("bounds"))
    cut = written(rest.join(bounds, "c").withColumn("stretch", F.size(F.filter("bounds", lambda b: b < F.col("i")))).drop("bounds"), "dedup")
    done = []
    for k in range(stretches):
        rows = cut.where(F.col("stretch") == k).drop("stretch")
        if done:
            rows = _without_barred(rows, reduce(DataFrame.unionByName, done))
        done.append(written(_read(rows, readers, "c"), "dedup"))
    return kept + done

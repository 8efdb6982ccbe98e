"""What the training-data operators share: table access and the shared scratch folder."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Arrow batches hold at most so many documents, so that a batch of long ones stays small.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a session on one machine (local mode) gets a folder of its own; any other session must name one.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='listforge-')}"
        spark.conf.set("spark.checkpoint.dir", found)
        atexit.register(_remove_local, found)
    return found.rstrip("/")


def _remove_local(uri: str) -> None:
    import shutil

    shutil.rmtree(uri.removeprefix("file://"), ignore_errors=True)


_WRITTEN: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{re.sub(r'[^a-z0-9]+', '-', name.lower())}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Delete what this process wrote to the shared folder; for long sessions, once results that read it are stored."""
    for path in _WRITTEN:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    gone = len(_WRITTEN)
    _WRITTEN.clear()
    return gone


#: A small table is written in this share of the files that its shuffle partitions would make.
FEWER = 8


def materialize(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder; a lost executor loses none of it.

    small: rows come out of a shuffle and are much smaller than texts, so that fewer tasks write them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if small:
        df = df.coalesce(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // FEWER))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the Arrow batches of the Python stages that follow in this session, and give their workers this package."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


#: What worker processes keep between tasks, by operator: how to let it go.
_KEPT: dict[str, Callable[[], None]] = {}


def keeps(name: str, let_go: Callable[[], None]) -> None:
    _KEPT[name] = let_go


def works_on(name: str) -> None:
    """Let go of what this worker process, which stages share, keeps for other operators."""
    for other, let_go in _KEPT.items():
        if other != name:
            let_go()


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns whose names the operator is about to add (Spark compares names without case)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def shared_fs(uri: str):
    """(pyarrow file system, path) of a folder or file in the shared store, on driver and executors alike."""
    from pyarrow import fs

    if "://" not in uri:
        return fs.LocalFileSystem(), uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def arrow(rows: list[tuple], schema):
    """A record batch of rows."""
    import pyarrow as pa

    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

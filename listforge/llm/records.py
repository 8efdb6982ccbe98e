"""Token ids as length-delimited binary records, with an offset index beside them.

A record is: payload length (8 bytes), masked checksum of these 8 bytes (4), payload, masked checksum of the payload
(4), all little-endian; a checksum is the CRC-32 of zlib, rotated right by 15 bits plus 0xA282EAD8. A payload is the
document's id (8 bytes, the smallest number for null), its number of ids (4), and the ids (2 bytes each). Files are
named part-NNNNN.bin in ascending order of ids; the index, a Parquet table, has file, doc_id, offset and sizes, so that
a reader can take records in any order.

Files are written under a name of their own for each attempt and then renamed: an attempt that is repeated after a lost
executor writes the same bytes again, for rows have one order: by id, then by a hash of the text, then as the input lies.
That order also divides an id of any number of rows among files. What attempts left unfinished is deleted at the end.

Defined results: a null text counts as empty and holds the end id alone; null ids come first; equal ids are ordered by a
hash of their texts; repeated rows are separate records; a text of any length is one record; an empty table gives no file
and an empty result; further columns of the input, whatever their names, aren't written; a record that fails a checksum or
breaks off fails the read.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import arrow, scratch_path, shared_fs, small_batches, table

MASK = 0xA282EAD8
NO_ID = -(1 << 63)
UNFINISHED = re.compile(r"_\d{5,}-[0-9a-f]{32}")


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def serialize(doc_id: int | None, ids: bytes) -> bytes:
    return struct.pack("<qI", NO_ID if doc_id is None else doc_id, len(ids) // 2) + ids


def parse(payload: bytes) -> tuple[int | None, bytes]:
    doc_id, n = struct.unpack_from("<qI", payload)
    if len(payload) != 12 + 2 * n:
        raise ValueError("record of a wrong size")
    return None if doc_id == NO_ID else doc_id, payload[12:]


def unframe(stream) -> Iterator[tuple[int, bytes]]:
    """(offset, payload) of every record from where the stream stands."""
    at = 0
    while head := stream.read(12):
        if len(head) < 12 or struct.unpack_from("<I", head, 8)[0] != masked(head[:8]):
            raise ValueError(f"broken length at {at}")
        n = struct.unpack_from("<Q", head)[0]
        body = stream.read(n + 4)
        if len(body) < n + 4 or struct.unpack_from("<I", body, n)[0] != masked(body[:n]):
            raise ValueError(f"broken record at {at}")
        yield at, body[:n]
        at += n + 16


INDEX = pa.schema([("file", pa.int32()), ("doc_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("n_tokens", pa.int64())])
INDEX_DDL = "file int, doc_id long, offset long, length long, n_tokens long"


def _writer(uri: str, path: str, end_id: int):
    def run(batches):
        from pyspark import TaskContext

        encoder, end = bpe.encoder(path), np.array([end_id], "<u2").tobytes()
        fs, root = shared_fs(uri)
        number = TaskContext.get().partitionId()
        final, own = f"{root}/part-{number:05d}.bin", f"{root}/_{number:05d}-{uuid.uuid4().hex}"
        out, at = None, 0
        for group in bpe.grouped(batches):
            ids, bounds = encoder.encoded(group.column(1)).joined()
            data, rows = memoryview(ids.tobytes()), []
            if out is None:
                out = fs.open_output_stream(own)
            for doc_id, low, high in zip(group.column(0).to_pylist(), bounds.tolist(), bounds[1:].tolist(), strict=False):
                record = frame(serialize(doc_id, b"".join((data[2 * low : 2 * high], end))))
                out.write(record)
                rows.append((number, doc_id, at, len(record), high - low + 1))
                at += len(record)
            yield arrow(rows, INDEX)
        if out is not None:
            out.close()
            fs.move(own, final)

    return run


def write(docs: DataFrame, uri: str, path: str, end_id: int = 0, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Encode the texts and write them in ascending order of ids; the offset index, written to uri/index."""
    spark = docs.sparkSession
    small_batches(spark)
    fs, root = shared_fs(uri)
    fs.create_dir(root)
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("hash"), F.monotonically_increasing_id().alias("row"))
    ordered = rows.repartitionByRange(files, "doc_id", "hash", "row").sortWithinPartitions("doc_id", "hash", "row")
    ordered.select("doc_id", "text").mapInArrow(_writer(uri, path, end_id), INDEX_DDL).write.mode("overwrite").parquet(f"{uri}/index")
    for left in fs.get_file_info(FileSelector(root)):
        if UNFINISHED.fullmatch(left.base_name):
            fs.delete_file(left.path)
    return spark.read.schema(INDEX_DDL).parquet(f"{uri}/index")


def bases(index: DataFrame) -> list[tuple[int, int]]:
    """(file, ids in all files before it); one entry for each file."""
    out, run = [], 0
    for r in sorted(index.groupBy("file").agg(F.sum("n_tokens").alias("n")).collect(), key=lambda r: r["file"]):
        out.append((r["file"], run))
        run += r["n"]
    return out


READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _reader(uri: str):
    def run(batches):
        fs, root = shared_fs(uri)
        for batch in batches:
            for number, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(f"{root}/part-{number:05d}.bin", buffer_size=1 << 20) as stream:
                    rows = []
                    for _, payload in unframe(stream):
                        doc_id, ids = parse(payload)
                        rows.append((doc_id, start, len(ids) // 2, zlib.crc32(np.frombuffer(ids, "<u2").astype("<u4").tobytes())))
                        start += len(ids) // 2
                        if len(rows) == 1000:
                            yield arrow(rows, READ)
                            rows = []
                    yield arrow(rows, READ)

    return run


def read(spark: SparkSession, uri: str, index: DataFrame) -> DataFrame:
    """Every record of the files, checked: doc_id, start, n_tokens and the checksum of its ids as 32-bit numbers."""
    small_batches(spark)
    files = bases(index)
    if not files:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    frame_ = spark.createDataFrame(files, "file int, start long").repartition(len(files))
    return frame_.mapInArrow(_reader(uri), "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch(spark: SparkSession, uri: str, wanted: DataFrame) -> DataFrame:
    """doc_id and ids of those records that rows of the index in `wanted` name, in any order: for shuffled reads."""

    def run(batches):
        fs, root = shared_fs(uri)
        for batch in batches:
            rows = []
            for number, at, n in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                with fs.open_input_file(f"{root}/part-{number:05d}.bin") as f:
                    payload = next(unframe(pa.BufferReader(f.read_at(n, at))))[1]
                doc_id, ids = parse(payload)
                rows.append((doc_id, np.frombuffer(ids, "<u2").astype(np.int32).tolist()))
            yield arrow(rows, pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]))

    small_batches(spark)
    return wanted.select("file", "offset", "length").mapInArrow(run, "doc_id long, ids array<int>")


def op6(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Contract query: all documents written with end id 0, then read back from the files."""
    uri = scratch_path(spark, "records")
    index = write(table(spark, sf_dir, "documents").select("doc_id", "text"), uri, path or bpe.default_vocabulary(), 0)
    return read(spark, uri, index)

"""BPE encoding and decoding through a table of distinct words.

1. Documents are taken in groups of about GROUP_BYTES, as they lie in the input's partitions, and cut into words (see
   bpe.py). A group becomes the list of its distinct words and, for every word of every document, its place in that list.
2. The words of all groups meet by hash in buckets, which are read row by row: a bucket's table of words is bounded, and
   a word of the corpus is encoded once while it is in the table. Every group gets the ids of its words back.
3. Group and ids are joined again, and ids are put in place of words by position. `decode` joins ids with the table of
   pieces; the query takes pieces from the same table inside the task.

Words aren't rows of their own: all occurrences of all words, each with its document and position, would be many times
the texts, to shuffle and to sort. What moves is packed: a group's share of a bucket is one row. A bucket holds a word
once a group at most, so that frequent words don't gather; there are as many buckets as shuffle partitions.

Groups are made twice, once for their words and once for their documents, since that costs less than keeping them. Their
names say what they hold, so that groups which differ can't be joined; `encode` writes its input first unless it is told
that the input is stored.

Defined results: a null text counts as empty and has no ids; repeated rows and rows of equal ids are separate rows; an
empty table gives an empty result; a document longer than a group is a group of its own; other columns don't pass through
(join by id).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import arrow, keeps, materialize, small_batches, table

GROUPS = pa.schema([("place", pa.int64()), ("grp", pa.string()), ("bucket", pa.int32()), ("n", pa.int32()), ("data", pa.binary())])
GROUPS_DDL = "place long, grp string, bucket int, n int, data binary"
#: Between the places of a partition's groups; those of different partitions are neighbours, which deals groups evenly.
STRIDE = 7919


def _pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _strings(parts: list[bytes]) -> bytes:
    """Byte strings in one: their number, their lengths, then themselves."""
    return np.array([len(parts), *map(len, parts)], "<u4").tobytes() + b"".join(parts)


def _split(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    ends = (np.cumsum(np.frombuffer(data, "<u4", n, 4), dtype=np.int64) + 4 + 4 * n).tolist()
    return [data[a:b] for a, b in zip([4 + 4 * n, *ends], ends, strict=False)]


_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def buckets_of(words: pa.Array, buckets: int) -> np.ndarray:
    """A bucket for each word (none is empty), by a polynomial hash of its bytes."""
    bounds = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[bounds[0] : bounds[-1]].astype(np.uint64) + np.uint64(1)
    bounds = bounds - bounds[0]
    powers, back = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(data), x, np.uint64)])) for x in (_BASE, _BACK))
    found = np.add.reduceat(data * powers[:-1], bounds[:-1]) * back[bounds[:-1]]
    found = (found ^ found >> np.uint64(32)) * np.uint64(0xFF51AFD7ED558CCD)
    return (found >> np.uint64(33)).astype(np.int64) % buckets


def _rows(group: pa.RecordBatch, place: int, buckets: int, want_words: bool, whole: list[bytes]) -> list[tuple]:
    """One row of a group's words for each bucket, or one of its documents (bucket -1)."""
    words, offsets, _ = bpe.split(group.column(1).fill_null(""), whole)
    coded = words.dictionary_encode()
    at = buckets_of(coded.dictionary, buckets) if len(coded.dictionary) else np.zeros(0, np.int64)
    order = np.argsort(at, kind="stable")
    shares = coded.dictionary.take(pa.array(order))
    places = np.empty(len(order), np.uint32)
    places[order] = np.arange(len(order))
    codes = places[coded.indices.to_numpy()]
    name = f"{place}-{zlib.crc32(codes.tobytes(), zlib.crc32(b''.join(b.to_pybytes() for b in shares.buffers()[1:] if b))):08x}"
    if want_words:
        held, cuts = [w.encode() for w in shares.to_pylist()], np.searchsorted(at[order], np.arange(buckets + 1)).tolist()
        return [(place, name, k, high - low, _pack(_strings(held[low:high]))) for k, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False)) if low < high]
    planes = np.ascontiguousarray(codes.view(np.uint8).reshape(-1, 4).T).tobytes()
    ids = pa.RecordBatch.from_arrays([group.column(0)], ["doc_id"])
    return [(place, name, -1, len(order), _pack(_strings([ids.serialize().to_pybytes(), np.diff(offsets).astype("<u4").tobytes(), planes])))]


def _grouped(path: str, buckets: int, want_words: bool):
    """Groups of a partition. The same partition gives the same groups under the same names each time it is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        partition, whole = TaskContext.get().partitionId(), bpe.encoder(path).whole
        for number, group in enumerate(bpe.grouped(batches)):
            yield arrow(_rows(group, partition + STRIDE * number, buckets, want_words, whole), GROUPS)

    return run


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.encoder(path)
        for batch in batches:
            for place, grp, bucket, n, data in zip(*(batch.column(c).to_pylist() for c in GROUPS.names), strict=True):
                yield arrow([(place, grp, bucket, n, _pack(_strings(encoder.known([w.decode() for w in _split(_unpack(data))]))))], GROUPS)

    return run


CODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

#: From the ids of a group's words, what turns the places of a document's words into an output row (without its id).
Maker = Callable[[list[bytes]], Callable[[list[int]], tuple]]


def _joined(schema: pa.Schema, make: Maker):
    """Rows sorted by group back to documents: one output row for each. One group is held at a time."""

    def documents(numbers: dict[int, int], parts: dict[int, bytes]) -> pa.RecordBatch:
        if numbers.pop(-1, None) != sum(numbers.values()):
            raise ValueError("words and documents of a group don't belong together")
        head, counts, planes = _split(_unpack(parts.pop(-1)))
        doc_ids = pa.ipc.read_record_batch(pa.py_buffer(head), pa.schema([("doc_id", pa.int64())])).column(0).to_pylist()
        place = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel()
        row = make([w for bucket in sorted(parts) for w in _split(_unpack(parts[bucket]))])
        rows, at = [], 0
        for doc_id, n in zip(doc_ids, np.frombuffer(counts, "<u4").tolist(), strict=True):
            rows.append((doc_id, *row(place[at : at + n].tolist())))
            at += n
        return arrow(rows, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, numbers, parts = None, {}, {}
        for batch in batches:
            for grp, bucket, n, data in zip(*(batch.column(c).to_pylist() for c in GROUPS.names[1:]), strict=True):
                if grp != name and name is not None:
                    yield documents(numbers, parts)
                    numbers, parts = {}, {}
                name, numbers[bucket], parts[bucket] = grp, n, data
        if name is not None:
            yield documents(numbers, parts)

    return run


def _through(docs: DataFrame, path: str, schema: pa.Schema, ddl: str, make: Maker) -> DataFrame:
    """docs: doc_id and text, stored: they are read twice."""
    spark = docs.sparkSession
    small_batches(spark)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = docs.mapInArrow(_grouped(path, buckets, True), GROUPS_DDL).repartitionById(buckets, F.col("bucket"))
    coded = words.mapInArrow(_encoded(path), GROUPS_DDL)
    both = docs.mapInArrow(_grouped(path, buckets, False), GROUPS_DDL).unionByName(coded)
    dealt = both.repartitionById(buckets, F.pmod("place", F.lit(buckets)).cast("int")).sortWithinPartitions("place", "grp")
    return dealt.mapInArrow(_joined(schema, make), ddl)


def _ids(words: list[bytes]):
    return lambda places: (b"".join([words[k] for k in places]),)


def encode(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", stored: bool = False) -> DataFrame:
    """doc_id and ids (array of int) of each document. stored: docs reads a table, and gives the same rows each time."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = _through(rows if stored else materialize(rows, "texts"), path, CODED, "doc_id long, ids binary", _ids)

    @F.pandas_udf("array<int>")
    def numbers(column):
        return column.map(lambda b: np.frombuffer(b, "<u2").astype(np.int32))

    return out.select("doc_id", numbers("ids").alias("ids"))


def decode(coded: DataFrame, path: str, ids: str = "ids", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and text of each row of ids, by a join of ids with pieces; null where ids are.

    The vocabulary has at most 65,536 pieces, which bounds what is broadcast. Rows get a number once, when they are
    written. Bytes that aren't UTF-8 become U+FFFD. An id that the vocabulary doesn't have makes a text null.
    """
    spark = coded.sparkSession
    rows = materialize(coded.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids"), F.monotonically_increasing_id().alias("row")), "ids")
    pieces = spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(bpe.pieces(path))], "id int, piece binary")
    each = rows.select("row", F.posexplode("ids").alias("at", "id")).join(F.broadcast(pieces), "id", "left")
    whole = each.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", F.hex("piece").alias("hex")))).alias("found"), F.count_if(F.col("piece").isNull()).alias("unknown"))
    text = F.make_valid_utf8(F.unhex(F.array_join(F.transform("found", lambda x: x["hex"]), "")).cast("string"))
    texts = whole.select("row", F.when(F.col("unknown") == 0, text).alias("text"))
    return rows.join(texts, "row", "left").select("doc_id", F.when(F.size("ids") == 0, "").otherwise(F.col("text")).alias("text"))


def _digest(path: str) -> Maker:
    def make(words: list[bytes]):
        names, pieces = _vocabulary(path)
        numbers = [np.frombuffer(w, "<u2").tolist() for w in words]
        sizes = [len(x) for x in numbers]
        ids = [b",".join([names[i] for i in x]) for x in numbers]
        texts = [b"".join([pieces[i] for i in x]) for x in numbers]

        def row(places):
            text = b"".join([texts[k] for k in places]).decode(errors="replace")
            return sum([sizes[k] for k in places]), hashlib.sha256(b",".join([ids[k] for k in places])).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

        return row

    return make


_VOCABULARY: dict[str, tuple[list[bytes], list[bytes]]] = {}
keeps("vocabulary", _VOCABULARY.clear)


def _vocabulary(path: str) -> tuple[list[bytes], list[bytes]]:
    if path not in _VOCABULARY:
        found = bpe.pieces(path)
        _VOCABULARY[path] = [str(i).encode() for i in range(len(found))], found
    return _VOCABULARY[path]


def op2(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Contract query: ids and decoded texts of all documents, as digests."""
    path = path or bpe.default_vocabulary()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _through(docs, path, DIGEST, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", _digest(path))

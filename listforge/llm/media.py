"""Media columns: GIFs as binary columns, decoded to timed frames with colour histograms.

`text_to_gif` stores any text losslessly: its UTF-8 bytes, padded with spaces to a positive multiple of the width, are
the samples of frames of at most FRAME_ROWS rows. `frames_of` decodes any GIF column to one row a frame.

Defined results: a null text is stored like an empty one; equal texts give equal bytes; a GIF that is null or that
can't be decoded gives no frames and its message in `error`; repeated rows are separate rows; an empty table gives an
empty result; other columns are carried along, those named like an output column are replaced.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gif as G
from .common import small_batches, table, without

WIDTH = 192
#: Rows of a frame at most: a long text becomes a film, and a worker holds one canvas at a time.
FRAME_ROWS = 256
#: 256 different colours, so that samples and pictures tell the same.
PALETTE = bytes(v for i in range(256) for v in (i, i * 7 % 256, 255 - i))


def padded(data: bytes) -> bytes:
    return data + b" " * ((-len(data)) % WIDTH or (0 if data else WIDTH))


def payload_to_gif(payload: bytes) -> bytes:
    rows = len(payload) // WIDTH
    frames = []
    for y in range(0, rows, FRAME_ROWS):
        h = min(FRAME_ROWS, rows - y)
        frames.append(G.Frame(payload[y * WIDTH : (y + h) * WIDTH], WIDTH, h, delay_cs=h, disposal=G.KEEP))
    return G.encode(G.Gif(WIDTH, min(rows, FRAME_ROWS), PALETTE, frames=frames))


def picture_feature(image: G.Gif) -> str:
    """Frames, centiseconds shown, and the colour histogram over all pictures."""
    total = np.zeros(64, np.int64)
    for canvas in G.canvases(image):
        total += G.histogram(canvas)
    return f"frames={len(image.frames)};cs={sum(f.delay_cs for f in image.frames)};hist=" + ",".join(map(str, total.tolist()))


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digests(batches):
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data = (text or "").encode()
            media = payload_to_gif(padded(data))
            image = G.decode(media)
            back = b"".join(f.samples for f in image.frames)
            rows.append((doc_id, len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), picture_feature(image)))
        names = [c.split()[0] for c in DIGEST.split(", ")]
        types = [pa.string() if c.endswith("string") else pa.int64() for c in DIGEST.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), types, strict=True)], names=names)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every document stored as a GIF, read back and described."""
    small_batches(spark)
    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(_digests, DIGEST)


def text_to_gif(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a binary column `media`."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("binary")
    def stored(texts):
        return texts.map(lambda t: payload_to_gif(padded((t or "").encode())))

    return without(docs, "media").withColumn("media", stored(F.col(text)))


FRAMES = "array<struct<frame int, start_cs long, delay_cs int, disposal int, width int, height int, samples binary, histogram array<long>>>"


def frames_of(df: DataFrame, media: str = "media") -> DataFrame:
    """df with `frames` (each with its start time, its own samples and its picture's histogram) and `error`."""
    small_batches(df.sparkSession)

    def one(data):
        if data is None:
            return None, "no media"
        try:
            image = G.decode(bytes(data))
            out, start = [], 0
            for i, (f, canvas) in enumerate(zip(image.frames, G.canvases(image), strict=True)):
                out.append({"frame": i, "start_cs": start, "delay_cs": f.delay_cs, "disposal": f.disposal, "width": f.width, "height": f.height, "samples": f.samples, "histogram": G.histogram(canvas).tolist()})
                start += f.delay_cs
            return out, None
        except ValueError as e:
            return None, str(e)

    @F.pandas_udf(f"struct<frames {FRAMES}, error string>")
    def read(column):
        import pandas as pd

        got = [one(x) for x in column]
        return pd.DataFrame({"frames": [g[0] for g in got], "error": [g[1] for g in got]})

    out = without(df, "frames", "error").withColumn("_read", read(F.col(media)))
    return out.withColumns({"frames": F.col("_read.frames"), "error": F.col("_read.error")}).drop("_read")

"""Toxicity scores of restored text.

1. Character trigrams of all documents are counted; the alphabet is fixed, so the driver gets at most 64 cubed counts.
2. Disguised words are restored by the noisy channel of deobfuscate.py and join the document's own words.
3. From at most SAMPLE labelled rows outside the held-out fifth (those of the smallest hash), the FEATURES words and word
   beginnings that tell toxic from clean rows best are chosen by log-likelihood ratio, and a logistic regression is
   fitted on their presence. Both bounds don't depend on the input.
4. Every document is scored.

Labels, language, source and id are no inputs of a score. Defined results: null counts as empty and scores like a text
without known words; without labels, or with labels of one class, all scores are that class's share (0 without labels);
an id labelled more than once is toxic if any of its labels says so; a text of any length is read whole; repeated rows are
separate rows; an empty table gives an empty result; `reject` carries all columns along, whatever their names.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, keeps, materialize, small_batches, table, works_on
from .deobfuscate import SIZE, Model, trigrams

SAMPLE, FEATURES, SEEN = 20_000, 2048, 3
#: Lengths of the beginnings of words that are features beside them.
BEGINNINGS = (4, 6)
_WORD, _SPACE = re.compile(r"[^\W\d_]+"), re.compile(r"\s")

GRAMS = pa.schema([("gram", pa.int32()), ("n", pa.int64())])


def parts(text: str, size: int = 1 << 20) -> list[str]:
    """The text cut behind white space, which no trigram spans, after about `size` characters each."""
    at, out = 0, []
    while at < len(text):
        border = _SPACE.search(text, at + size)
        stop = border.end() if border else len(text)
        out.append(text[at:stop])
        at = stop
    return out


def _count(batches):
    counts = np.zeros(SIZE**3, np.int64)
    for batch in batches:
        held: list[str] = []
        size = 0
        for text in batch.column(0).to_pylist():
            # Texts are counted together (a line feed is a border), and a very long one in parts that end at a border too.
            for part in parts(text or ""):
                held.append(part)
                size += len(part)
                if size >= 1 << 20:
                    counts += np.bincount(trigrams("\n".join(held)), minlength=SIZE**3)
                    held, size = [], 0
        if held:
            counts += np.bincount(trigrams("\n".join(held)), minlength=SIZE**3)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], schema=GRAMS)


def language_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Trigram counts of all texts."""
    small_batches(docs.sparkSession)
    counts = np.zeros(SIZE**3, np.int64)
    for gram, n in docs.select(F.col(text)).mapInArrow(_count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        counts[gram] = n
    return counts


def features(text: str | None, model: Model) -> set[str]:
    """Words of a text and of its restored stretches, and their beginnings, marked by a full stop."""
    words = set(_WORD.findall((text or "").lower()))
    for reading in model.readings(text or ""):
        words.update(reading.split())
    return words.union(*({f"{w[:n]}." for w in words if len(w) >= n} for n in BEGINNINGS))


def held_out(doc_id: Column) -> Column:
    """A fifth of all ids, by checksum; no label of theirs is learned from. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def learn(docs: DataFrame, labels: DataFrame, counts) -> tuple[dict[str, float], float]:
    """Weights by feature, and the bias. counts: broadcast name and trigram counts."""
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sample = spark.createDataFrame(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).collect(), "doc_id long, toxic int")
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("toxic", "text")

    def words(batches):
        model = _model(counts)
        for batch in batches:
            out = [(toxic > 0, sorted(features(text, model))) for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield arrow(out, pa.schema([("toxic", pa.bool_()), ("words", pa.list_(pa.string()))]))

    # The sample's texts are read and decoded once.
    stored = materialize(rows.mapInArrow(words, "toxic boolean, words array<string>"), "toxicity-sample")
    sizes = stored.agg(F.count("*").alias("all"), F.count_if("toxic").alias("toxic")).first()
    if not sizes["toxic"] or sizes["toxic"] == sizes["all"]:
        return {}, 20.0 if sizes["toxic"] else -20.0
    n, t = float(sizes["all"]), float(sizes["toxic"])
    seen = stored.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count_if(~F.col("toxic")).alias("clean"), F.count_if("toxic").alias("toxic"))
    had, among = F.col("clean") + F.col("toxic"), F.col("toxic")
    part = lambda seen_, expected: F.when(seen_ > 0, seen_ * F.log(seen_ / expected)).otherwise(F.lit(0.0))
    tells = part(among, had * t / n) + part(had - among, had * (n - t) / n) + part(t - among, (n - had) * t / n) + part((n - t) - (had - among), (n - had) * (n - t) / n)
    chosen = [r["word"] for r in seen.where((had >= SEEN) & (had < n)).orderBy(F.desc(tells), "word").limit(FEATURES).collect()]
    place = spark.sparkContext.broadcast({w: i for i, w in enumerate(chosen)})

    def present(batches):
        for batch in batches:
            out = [(int(toxic), sorted(place.value[w] for w in found if w in place.value)) for toxic, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield arrow(out, pa.schema([("y", pa.int32()), ("x", pa.list_(pa.int32()))]))

    got = stored.mapInArrow(present, "y int, x array<int>").collect()
    weights, bias = logistic([r["x"] for r in got], np.array([r["y"] for r in got], float), len(chosen))
    return {w: float(x) for w, x in zip(chosen, weights, strict=True)}, float(bias)


def logistic(rows: list[list[int]], y: np.ndarray, n: int, steps: int = 400, rate: float = 0.3, penalty: float = 3e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on present features: full-batch Adam steps with an L2 penalty."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    which = np.array([i for r in rows for i in r], np.int64)
    w, share = np.zeros(n + 1), y.mean()
    w[n] = np.log(share / (1 - share))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, steps + 1):
        z = np.bincount(at, w[which], len(rows)) + w[n]
        wrong = (1 / (1 + np.exp(-z)) - y) / len(rows)
        g = np.append(np.bincount(which, wrong[at], n) + penalty * w[:n], wrong.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate / (1 + step / 50) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w[:n], w[n]


def scorer(docs: DataFrame, labels: DataFrame):
    """A column function that scores a text column, fitted on labelled rows of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    counts = spark.sparkContext.broadcast((uuid.uuid4().hex, language_model(docs)))
    fitted = spark.sparkContext.broadcast(learn(docs, labels, counts))

    @F.pandas_udf("double")
    def score(texts):
        (weights, bias), model = fitted.value, _model(counts)
        return texts.map(lambda t: 1 / (1 + np.exp(-min(30.0, max(-30.0, bias + sum(weights[w] for w in features(t, model) if w in weights))))))

    return score


_MODELS: dict = {}
keeps("toxicity", _MODELS.clear)


def _model(counts) -> Model:
    """The model of these counts; a process holds one at a time."""
    works_on("toxicity")
    name, found = counts.value
    if name not in _MODELS:
        _MODELS.clear()
        _MODELS[name] = Model(found)
    return _MODELS[name]


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: scores of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    score = scorer(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def reject(docs: DataFrame, labels: DataFrame, at: float = 0.5) -> DataFrame:
    """Those rows of docs that score below `at`, with the columns of docs."""
    score = scorer(docs, labels)
    return docs.where(score(F.col("text")) < at)

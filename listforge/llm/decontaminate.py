"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

Every item is cut into windows of ten words (an item of fewer words is one window). A window is the set of its
shingles of three words, and a text holds it only if it holds every one of them: at containment 1 the necessary prefix
of the set is one shingle, whichever is rarest. So the first pass over the documents counts how often each shingle of
the benchmark occurs in all of them, which gives the order by rarity; windows with a shingle that occurs nowhere are
done with. The second pass joins the words of each text with the rarest shingle of each window, keeps those pairs whose
window would lie within the text (bounds on length and position), and compares the words of that stretch with the
window's, exactly. Texts aren't shuffled: what leaves the pass is one row a document and one row a find.

The benchmark's side of both passes is broadcast while its measured size is under a bound, within which a text's
words go through one generated loop from the splitting to the comparison. Beyond the bound the positions of all
shingles are joined by shuffles, and the finds are compared in a join with their documents; results are the same.

Defined results: words are those of texts with A-Z in lower case; a null or empty text has no words; equal texts have
equal results, found once; items are told apart by item_id, and rows of one id are one item, whose windows are those of
all its rows; an item without an id makes words count as hit but isn't itself counted; an item without words is never
found; an empty table of either kind gives no finds; texts of any length are read whole; further columns don't matter.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

WINDOW, SHINGLE = 10, 3
#: What is between words, once A-Z are in lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The benchmark's side of a join is broadcast up to so many bytes, as counted by its rows.
BROADCAST_BYTES = 64 << 20
TOKEN_BYTES, WINDOW_BYTES = 32, 256


def framed_words(text: Column) -> Column:
    """The words of a text between two empty strings, so that places count from 1 and no end needs a test."""
    text = F.coalesce(text, F.lit(""))
    plain = F.length(text) == F.octet_length(text)  # then lower() touches A-Z alone
    lowered = F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.split(F.concat(F.lit(" "), lowered, F.lit(" ")), BETWEEN)


def token(words: Column, at: Column, size: int) -> Column:
    """The shingle of so many words from place `at` on, as a number."""
    return F.xxhash64(*[F.get(words, at + i) for i in range(size)])


def item_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id, words, window: the windows of every item; window is a digest of the words."""
    framed = items.select("item_id", framed_words(F.col("text")).alias("w")).where(F.size("w") > 2)
    starts = F.explode(F.sequence(F.lit(2), F.greatest(F.size("w") - size, F.lit(2))))
    cut = framed.select("item_id", F.col("w"), starts.alias("s")).select("item_id", F.slice("w", F.col("s"), F.least(F.lit(size), F.size("w") - 2)).alias("words"))
    return cut.withColumn("window", F.sha2(F.concat_ws(" ", "words"), 256)).distinct()


def shingles(windows: DataFrame, sizes: list[int]) -> DataFrame:
    """window, words, token, offset: every shingle of every distinct window; short windows are one shingle."""
    parts = []
    for k in sizes:
        fits = F.size("words") >= k if k == max(sizes) else F.size("words") == k
        at = windows.where(fits).select("window", "words", F.explode(F.sequence(F.lit(0), F.size("words") - k)).alias("offset"))
        parts.append(at.withColumn("token", token(F.col("words"), F.col("offset"), k)))
    return reduce(DataFrame.unionByName, parts)


def places(docs: DataFrame, sizes: list[int], *kept: Column) -> DataFrame:
    """A row for each place of each text, 0 being before the first word: kept columns, w, p and the shingle there."""
    rows = docs.select(*kept, framed_words(F.col("text")).alias("w"))
    rows = rows.select("*", F.posexplode_outer("w").alias("p", "_word"))  # outer: else the words are split twice, for a filter
    found = [token(F.col("w"), F.col("p"), k) for k in sizes]
    return rows.withColumn("token", found[0] if len(found) == 1 else F.explode(F.when(F.col("p") > 0, F.array(*found)).otherwise(F.array(found[0]))))


def digest() -> Column:
    return F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("digest")


def rarest(docs: DataFrame, grams: DataFrame, sizes: list[int], small: bool) -> DataFrame:
    """window, words, token, offset: the rarest shingle of each window that the documents may hold."""
    tokens = grams.select("token").distinct()
    at = places(docs, sizes).where("p > 0").select("token")
    if small:
        counted = at.join(F.broadcast(tokens), "token").groupBy("token").count()
    else:
        counted = at.groupBy("token").count().join(tokens, "token")
    known = grams.join(counted, "token", "left")
    best = F.min_by(F.struct("token", "offset", "words"), F.struct("count", "token", "offset"))
    held = known.groupBy("window").agg(best.alias("b"), F.count_if(F.col("count").isNull()).alias("missing")).where("missing = 0")
    return held.select("window", "b.*")


def finds(docs: DataFrame, items: DataFrame, size: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, finds, windows of items). documents: doc_id, digest, n_words. finds: digest, start, stop, window."""
    windows = materialize(item_windows(items, size), "item-windows", small=True)
    lengths = sorted(r["k"] for r in windows.select(F.least(F.size("words"), F.lit(SHINGLE)).alias("k")).distinct().collect())
    base = docs.select("doc_id", digest(), (F.size(framed_words(F.col("text"))).cast("long") - 2).alias("n_words"))
    if not lengths:
        return base, base.selectExpr("digest", "0 AS start", "0 AS stop", "'' AS window").where("false"), windows
    grams = shingles(windows.select("window", "words").distinct(), lengths)
    small = grams.count() * TOKEN_BYTES <= broadcast_bytes
    prefix = materialize(rarest(docs, grams, lengths, small), "rarest-shingles", small=True)
    small = small and (prefix.agg(F.sum(F.octet_length(F.to_json("words")) + WINDOW_BYTES).alias("b")).first()["b"] or 0) <= broadcast_bytes
    prefix = prefix.withColumnRenamed("token", "rare")
    start = F.col("p") - F.col("offset")
    fits = (F.col("token") == F.col("rare")) & (F.col("p") > 0) & (start > 0) & (start + F.size("words") <= F.size("w") - 1)
    same = F.slice("w", start + 1, F.size("words")) == F.col("words")
    bounds = [start.alias("start"), (start + F.size("words")).alias("stop")]
    if small:
        joined = places(docs, lengths, F.col("doc_id"), digest()).join(F.broadcast(prefix), fits, "left")
        joined = joined.where((F.col("p") == 0) | (F.col("window").isNotNull() & same))
        out = materialize(joined.select(F.when(F.col("p") == 0, F.col("doc_id")).alias("doc_id"), "digest", (F.size("w").cast("long") - 2).alias("n_words"), *bounds, "window"), "window-finds")
        return out.where("window is null").select("doc_id", "digest", "n_words"), out.where("window is not null").select("digest", "start", "stop", "window"), windows
    at = places(docs, lengths, digest()).where("p > 0").select("digest", "p", "token", F.size("w").alias("size"))
    near = at.join(prefix, F.col("token") == F.col("rare")).where((start > 0) & (start + F.size("words") <= F.col("size") - 1))
    near = near.select("digest", *bounds, "window", "words").distinct()
    texts = docs.select(digest(), "text").dropDuplicates(["digest"]).select("digest", framed_words(F.col("text")).alias("w"))
    sure = near.join(texts, "digest").where(F.slice("w", F.col("start") + 1, F.size("words")) == F.col("words"))
    return base, materialize(sure.select("digest", "start", "stop", "window"), "window-finds"), windows


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, spans (start and stop of the stretches of hit words, places from 1, stop exclusive), item_ids.

    One row a document, whatever its id. spans and item_ids are empty arrays where nothing was found. What one text gathers
    is bounded by its own words: no two windows of one length start at the same place.
    """
    base, found, windows = finds(docs, items, size, broadcast_bytes)
    span = F.struct(F.col("start"), F.col("stop"))
    stretches = found.groupBy("digest").agg(F.array_sort(F.collect_set(span)).alias("s"))
    nothing = F.array().cast("array<struct<start:int,stop:int>>")

    def put(done: Column, one: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["stop"], one["stop"]).alias("stop"))
        return F.when(one["start"] <= last["stop"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(one)))

    stretches = stretches.select("digest", F.aggregate("s", nothing, put).alias("spans"))
    ids = found.select("digest", "window").distinct().join(windows.select("window", "item_id").where("item_id is not null").distinct(), "window")
    ids = ids.groupBy("digest").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    # Written, so that the join below gets an exchange on both sides, of which Spark can divide that with a frequent text.
    both = materialize(stretches.join(ids, "digest", "left"), "text-finds", small=True)
    out = base.join(both, "digest", "left")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return out.select("doc_id", "n_words", F.coalesce(hit, F.lit(0).cast("long")).alias("n_hit"), F.coalesce("spans", nothing).alias("spans"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all documents against windows of ten words of all benchmark items."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = "regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS.format(t="text")}, []) AS w FROM documents),
i AS (SELECT item_id, {_WORDS.format(t="text")} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[s:s + {WINDOW - 1}] AS words FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 2}, 2))) AS s FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(words) AS n FROM win),
pl AS (SELECT r, s, n, array_to_string(w[s:s + n - 1], ' ') AS x FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)),
f AS (SELECT r, s, n, item_id FROM pl JOIN (SELECT item_id, array_to_string(words, ' ') AS x FROM win) USING (x)),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM f) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS l FROM (SELECT DISTINCT r, cast(item_id AS varchar) AS item_id FROM f WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN ids USING (r)
"""

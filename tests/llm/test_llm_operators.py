"""Operators on small tables with nulls, empty and long texts, ties, repeated rows, clashing columns, and no rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from listforge.llm import bpe, counts, media, ngram_join, packing, quality, records, secrets, sharding, toxicity, wordtable
from listforge.llm.common import materialize, scratch_path

PATH = bpe.default_vocabulary()
rng = random.Random(11)
WORDS = [a + b for a in ("th", "an", "er", "on", "re") for b in ("ing", "ed", "able", "ion", "er", "st")]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


BASE = prose(120)
TEXTS = [None, "", " \n\t", "one two", BASE, BASE, BASE.replace("thing", "thing", 1) + " tail", prose(60), prose(60) + "\n" + prose(10), "line one here\nline one here\n", "a b c a b c", prose(9000), 'token = "abcdef0123" é ' + "0f" * 14, "<|endoftext|> x", "𝒳 ünï € |#"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", -1, "clash") for i, t in enumerate(TEXTS)] + [(4, BASE, "en", "s", -1, "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard string").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def ids_of(text, end=()):
    return [*bpe.tokenizer(PATH).encode(text or "", add_special_tokens=False).ids, *end]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_media(spark, docs, none):
    stored = media.frames_of(media.text_to_gif(docs))
    for r in stored.collect():
        payload = b"".join(bytes(f["samples"]) for f in r["frames"])
        assert payload == media.padded((r["text"] or "").encode()) and r["error"] is None
        assert sum(map(sum, (f["histogram"] for f in r["frames"]))) >= len(payload) and r["shard"] == "clash"
    bad = spark.createDataFrame([(None,), (bytearray(b"GIF89a"),), (bytearray(b"x"),)], "media binary")
    assert all(r["frames"] is None and r["error"] for r in media.frames_of(bad).collect())
    assert media.text_to_gif(none).count() == 0
    digests = docs.select("doc_id", "text").mapInArrow(media._digests, media.DIGEST).collect()
    for r in digests:
        payload = media.padded((TEXTS[r["doc_id"]] or "").encode())
        assert (r["payload_sha256"], r["tail_crc32"], r["n_bytes"]) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len((TEXTS[r["doc_id"]] or "").encode()))


def test_word_table(docs, none):
    coded = wordtable.encode(docs, PATH)
    rows = coded.collect()
    assert len(rows) == len(TEXTS) + 1 and all(r["ids"] == ids_of(TEXTS[r["doc_id"]]) for r in rows)
    assert all(r["text"] == (TEXTS[r["doc_id"]] or "") for r in wordtable.decode(coded, PATH).collect())
    assert wordtable.encode(none, PATH).count() == 0


def brute_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    three = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    marked = {k for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(marked)


def test_statistics(docs, none):
    for r in quality.with_statistics(docs).collect():
        assert tuple(r[c] for c in quality.COUNTS) == brute_counts(r["text"])
    assert quality.with_statistics(none).count() == 0


def test_decision_list(spark, none):
    rows = [(i, prose(80 + i % 40) + (" $$$" * 40 if i % 4 == 0 else "")) for i in range(240)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(240)] + [(None, 0), (5, None)], "doc_id long, quality int")
    kept = quality.filter_quality(d, labels)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {i for i in range(240) if i % 4}
    stats = materialize(quality.with_statistics(d.drop("n_words")).drop("text"), "t")
    rules = quality.learn_from_labels(stats, labels)
    assert rules and all(r for r in rules)
    assert quality.learn_from_labels(stats, labels.where("quality = 1")) == [] == quality.learn_from_labels(stats, labels.limit(0))
    assert quality.filter_quality(none, labels).count() == 0
    assert "Python" not in kept._jdf.queryExecution().executedPlan().toString()


def test_toxicity(spark, none):
    bad = ["idiot", "moron", "worthless"]
    rows = [(i, prose(50) + (f" {bad[i % 3]} " if i % 3 == 0 else " ") + prose(20)) for i in range(600)]
    rows += [(1000, prose(30) + " 1d10t " + prose(30)), (1001, prose(30) + " i d i o t " + prose(30)), (1002, None), (1003, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(600)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    score = toxicity.scorer(d, labels)
    got = {r["doc_id"]: r["s"] for r in d.select("doc_id", score("text").alias("s")).collect()}
    out = {i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0}
    right = [(got[i] >= 0.5) == (i % 3 == 0) for i in out]
    assert sum(right) / len(right) > 0.97
    assert got[1000] >= 0.5 and got[1001] >= 0.5 and got[1002] < 0.5 and got[1003] < 0.5
    kept = toxicity.reject(d.withColumn("score", F.lit("clash")), labels)
    assert kept.columns == ["doc_id", "text", "score"] and 0 not in {r["doc_id"] for r in kept.collect()}
    assert toxicity.reject(d, labels.limit(0)).count() == len(rows)
    assert toxicity.reject(none, labels).count() == 0


def test_packing(docs, none):
    rows = packing.pack(materialize(packing.pieces_of(docs, PATH), "p")).collect()
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r["sequence_id"]].append(r)
        by_doc[r["doc_id"]].append(r)
    for v in by_seq.values():
        at = 0
        for r in sorted(v, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    for i, t in enumerate(TEXTS):
        ids = ids_of(t, [2])
        for r in by_doc[i]:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"] and (r["piece"] == 0 or r["length"] == 1024)
        assert sum(r["length"] for r in by_doc[i]) == len(ids) * (2 if i == 4 else 1)
    assert packing.pack(packing.pieces_of(none, PATH)).count() == 0


def test_records(spark, docs, none):
    uri = scratch_path(spark, "t")
    index = records.write(docs, uri, PATH, 0)
    rows = records.read(spark, uri, index).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == sorted([*range(len(TEXTS)), 4])
    at = 0
    for r in rows:
        ids = ids_of(TEXTS[r["doc_id"]], [0])
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    some = records.fetch(spark, uri, index.where("doc_id in (7, 13)").orderBy(F.rand())).collect()
    assert {r["doc_id"]: r["ids"] for r in some} == {i: ids_of(TEXTS[i], [0]) for i in (7, 13)}
    empty = scratch_path(spark, "t")
    assert records.read(spark, empty, records.write(none, empty, PATH, 0)).count() == 0


def test_secrets(docs, none):
    for r in secrets.find_secrets(docs).collect():
        assert [(s["start"], s["kind"], s["end"]) for s in r["secrets"]] == [(s, secrets.RULES[k][0], e) for s, k, e in secrets.spans_of(r["text"] or "")]
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert clean[0] is None and clean[12] == 'token = "abcdef0123" é '.replace('token = "abcdef0123', "<assign>") + "<hex>" and clean[4] == BASE
    assert secrets.find_secrets(none).count() == secrets.redact(none).count() == 0


def test_edit_counts(spark, docs, none):
    counted = counts.with_counts(docs.where("doc_id <> 11"), PATH).withColumn("edits", F.array(F.struct(F.lit(3).alias("start"), F.lit(1).alias("stop"), F.lit(" x").alias("insert")), F.struct(F.lit(0).alias("start"), F.lit(2).alias("stop"), F.lit(None).cast("string").alias("insert"))))
    for r in counts.edited(counted.where("n_tokens >= 0"), PATH).collect():
        t = TEXTS[r["doc_id"]] or ""
        t = (t[:3] + " x" + t[3:])[2:]
        assert r["text"] == t and r["n_tokens"] == len(ids_of(t)) and r["shard"] == "clash"
    assert counts.with_counts(none, PATH).count() == 0
    null = counts.with_counts(docs.limit(1), PATH).withColumn("edits", F.lit(None).cast(counts.EDITS))
    assert counts.edited(null, PATH).first()["n_encoded"] == 0


def test_sharding(spark, docs, none):
    many = spark.createDataFrame([(i, "same text" if i % 3 == 0 else f"text {i} " + "x" * (i % 50)) for i in range(4000)], "doc_id long, text string")
    rows = sharding.shard(many.withColumn("slot", F.lit("clash")), 8).collect()
    size, slots = Counter(), defaultdict(list)
    for r in rows:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == 4000 and max(size.values()) <= 1.01 * min(size.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(size) == set(range(8))
    got = sharding.shard(docs, 3).collect()
    assert len(got) == len(TEXTS) + 1 and all(r["size"] == len((r["text"] or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((r["text"] or "").encode()) for r in got)
    assert sharding.shard(none, 8).count() == 0
    assert "Python" not in sharding.shard(docs, 3)._jdf.queryExecution().executedPlan().toString()


def shingles(t):
    w = (t or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates(spark, docs, none):
    group = [BASE.split() for _ in range(90)]
    for k, w in enumerate(group):
        w[k % 120] = f"w{k}"
    rows = [(100 + k, " ".join(w)) for k, w in enumerate(group)] + [(300 + k, prose(80)) for k in range(40)] + [(500, "x y"), (501, "x  y\n"), (None, BASE)]
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    members, links = ngram_join.join(d)
    got, found = members.collect(), {tuple(r) for r in links.collect()}
    text_of = dict(enumerate(TEXTS)) | {i: t for i, t in rows if i is not None}
    cls = {r["doc_id"]: r["class_id"] for r in got}
    assert len(got) == d.count() and cls[500] == cls[501] == 500 and cls[0] == cls[1] == cls[2] == 0
    sets = {i: shingles(t) for i, t in text_of.items()}
    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if both and both / len(sets[i] | sets[j]) >= 0.8:
                assert cls[i] == cls[j]
    for a, b in found:
        assert len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8
    assert all(cls[300 + k] == 300 + k for k in range(40)) and None in cls and cls[None] is None
    degree = Counter(x for p in found for x in p)
    rep = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert all(r["n_links"] == degree[r["representative"]] for r in rep.values())
    kept = ngram_join.keep_one(d)
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted(set(cls.values()) - {None})
    assert ngram_join.keep_one(none).count() == 0


def test_scratch_goes(spark):
    from listforge.llm import common

    kept = materialize(spark.range(3), "t")
    assert kept.count() == 3
    path = common._WRITTEN[-1]
    own, common._WRITTEN[:] = common._WRITTEN[:-1], [path]
    assert common.clear_scratch(spark) == 1 and common._WRITTEN == []
    common._WRITTEN.extend(own)
    fs, root = common.shared_fs(path)
    assert fs.get_file_info(root).type.name == "NotFound"


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (100, 102), (103, 102)]
    got = {r["id"]: r["class"] for r in ngram_join.components(materialize(spark.createDataFrame(chain, "a long, b long"), "t")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102, 103)}


def near_copies(sizes, seed=5):
    """Groups of different texts, each a template of 200 words with one to three words replaced, mostly three."""
    draw, rows = random.Random(seed), []
    for size in sizes:
        template = [f"t{size}x{i}" for i in range(200)]
        for k in range(size):
            words = list(template)
            for at in draw.sample(range(200), draw.choice([1, 2, 3, 3, 3, 3])):
                words[at] = f"new{size}x{k}x{at}"
            rows.append((len(rows), " ".join(words)))
    return rows


def similar_pairs(rows):
    sets = [shingles(t) for _, t in rows]
    return {(i, j) for i in range(len(sets)) for j in range(i) if (both := len(sets[i] & sets[j])) and both / len(sets[i] | sets[j]) >= 0.8}


def test_large_nodes_keep_classes_whole(spark):
    rows = near_copies([60, 200, 400])
    members, _ = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"))
    cls = {r["doc_id"]: r["class_id"] for r in members.collect()}
    apart = [(i, j) for i, j in similar_pairs(rows) if cls[i] != cls[j]]
    assert not apart, len(apart)


def test_rows_of_one_id_keep_their_own_texts(spark):
    one, two = prose(80), prose(80)
    rows = [(1, one), (1, two), (1, two), (2, two + " tail"), (3, one.replace(" ", "  "))]
    members, _ = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"))
    got = Counter((r["doc_id"], r["n_copies"], r["n_links"]) for r in members.collect())
    assert got == {(1, 2, 0): 1, (3, 2, 0): 1, (1, 2, 1): 2, (2, 1, 1): 1}
    kept = ngram_join.keep_one(spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, _hash0 string, row string"))
    assert kept.columns == ["doc_id", "text", "_hash0", "row"]
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted([(1, one), (1, two)])


def test_links_of_large_nodes_are_all_counted(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 50)
    rows = near_copies([60, 200, 400])
    pairs = similar_pairs(rows)
    members, links = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"))
    found = [tuple(sorted(r, reverse=True)) for r in links.collect()]
    assert len(found) == len(set(found)) and set(found) <= pairs and len(found) >= 0.998 * len(pairs)
    degree, got = Counter(x for p in found for x in p), {r["doc_id"]: r["n_links"] for r in members.collect()}
    assert all(got[i] == degree[i] for i, _ in rows)


def test_prefixes_are_shortened_while_nodes_are_small(spark):
    """A crowd that shares all of trie 0, some that share 3 of its values with it, two that share 3, and one that is alone."""
    import struct

    def sig(first, other):
        return struct.pack(f">{ngram_join.K}H", *first, *[other * 100 + i for i in range(ngram_join.K - 4)])

    rows = [(i, sig([1, 2, 3, 4], i)) for i in range(30)]
    rows += [(100 + i, sig([1, 2, 3, 5], 100 + i)) for i in range(3)] + [(200, sig([1, 2, 3, 6], 200))]
    rows += [(300 + i, sig([9, 9, 9, i], 300 + i)) for i in range(2)] + [(400, sig([8, 8, 8, 8], 400))]
    nodes, longer = ngram_join.forest_of(spark.createDataFrame(rows, "rep long, sig binary"))
    got = {r["rep"]: (r["depth"], r["size"]) for r in nodes.where("tree = 0").collect()}
    assert all(got[i] == (4, 30) for i in range(30)) and all(got[100 + i] == (4, 3) for i in range(3))
    assert got[300] == got[301] == (3, 2) and 200 not in got and 400 not in got
    assert {r["rep"] for r in longer.where("tree = 0 and depth = 4").collect()} == {*range(30), 100, 101, 102, 200}


def test_packing_carries_columns_and_divides_lengths(spark, monkeypatch):
    """Names that the operator uses itself; a frequent length; rows of one null id; pieces that fill a sequence."""
    from listforge.llm import packing

    monkeypatch.setattr(packing, "LANE_ROWS", 50)
    rows = [(None, i, 1024 if i % 3 == 0 else 100 + i % 2, i, "l", "r", 7, 8) for i in range(600)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, length long, ids_crc32 long, lane string, rank string, sequence_id int, many int")
    got = packing.pack(pieces).collect()
    assert set(got[0].asDict()) == set(pieces.columns) | {"offset"} and {(r["lane"], r["rank"], r["many"]) for r in got} == {("l", "r", 8)}
    assert sorted(r["piece"] for r in got) == list(range(600))
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in places.values():
        at = 0
        for start, n in sorted(held):
            assert start == at
            at += n
        assert at <= 1024
    assert len(places) <= 200 + 41
    assert packing.pack(pieces.where("false")).count() == 0 and packing.pack(pieces.where("length = 1024")).count() == 200

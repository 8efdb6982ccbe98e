"""The registered queries over a whole small table against plain Python, and the pipeline."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from listforge.llm import bpe, queries

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{D}/documents.parquet").collect()}


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def run(spark, n):
    name = next(q for q in queries.QUERIES if q.startswith(f"op{n}_"))
    return {r["doc_id"]: r for r in queries.QUERIES[name](spark, D).collect()}


def test_op2(spark, rows):
    t, got = bpe.tokenizer(bpe.default_vocabulary()), run(spark, 2)
    assert set(got) == set(rows)
    for i, text in rows.items():
        ids = t.encode(text, add_special_tokens=False).ids
        assert tuple(got[i])[1:] == (len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))


def test_op6(spark, rows):
    t, got, at = bpe.tokenizer(bpe.default_vocabulary()), run(spark, 6), 0
    for i in sorted(rows):
        ids = [*t.encode(rows[i], add_special_tokens=False).ids, 0]
        assert tuple(got[i])[1:] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_op7(spark, rows):
    from test_codecs import brute_spans
    from listforge.llm.secrets import RULES

    for i, r in run(spark, 7).items():
        base = [s for s in brute_spans(rows[i]) if s[1] < 3]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[1] == k for s in base) for k in range(3))
        assert r["base_sha256"] == sha(",".join(f"{RULES[k][0]}:{s}:{e}" for s, k, e in base))


def test_op8(spark, rows):
    from listforge.llm import counts

    t, got = bpe.tokenizer(bpe.default_vocabulary()), run(spark, 8)
    docs = spark.read.parquet(f"{D}/documents.parquet")
    edits = {r["doc_id"]: r["e"] for r in docs.select("doc_id", counts.sample_edits(F.col("doc_id"), F.coalesce("text", F.lit(""))).alias("e")).collect()}
    assert set(got) == set(rows)
    for i, text in rows.items():
        new = text
        for e in edits[i]:
            start = min(e["start"], len(new))
            new = new[:start] + e["insert"] + new[max(start, min(e["stop"], len(new))) :]
        n = [len(t.encode(x, add_special_tokens=False).ids) for x in (text, new)]
        assert (got[i]["n_tokens"], got[i]["n_tokens_edited"], got[i]["edited_crc32"]) == (*n, zlib.crc32(new.encode()))
        assert got[i]["n_encoded"] <= 3 * (len(text) + 40) and (len(text) < 20000 or got[i]["n_encoded"] < len(text) / 2)


def test_op1(spark, rows):
    from listforge.llm import gif, media

    got = run(spark, 1)
    assert set(got) == set(rows)
    for i, text in rows.items():
        data = text.encode()
        payload = data + b" " * (-len(data) % 192 or (0 if data else 192))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-16:])
        stored = media.payload_to_gif(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert b"".join(f.samples for f in gif.decode(stored).frames) == payload


def test_op3(spark, rows):
    from test_llm_operators import brute_counts

    from listforge.llm import quality

    for i, r in run(spark, 3).items():
        n = brute_counts(rows[i])
        assert tuple(r[c] for c in quality.COUNTS) == n
        assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and not (r["kept"] and r["base_failed"])


def test_op4(spark):
    big = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.QUERIES["op4_noisy_channel_toxicity"](spark, big).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{big}/documents.parquet").count()
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    out = [(got[i]["score"], y) for i, y in labels.items() if got[i]["held_out"] and y is not None]
    pairs = [(a, b) for a, y in out if y for b, z in out if not z]
    assert sum((a > b) + (a == b) / 2 for a, b in pairs) / len(pairs) > 0.75
    assert not any(s >= 0.5 for s, y in out if not y)


def test_op5(spark, rows):
    from listforge.llm import packing

    t = bpe.tokenizer(bpe.default_vocabulary())
    found = queries.QUERIES["op5_configuration_packing"](spark, D).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(rows)
    tokens = 0
    for i, text in rows.items():
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        tokens += len(ids)
        at = 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r["piece"])):
            part = ids[at : at + r["length"]]
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, zlib.crc32(np.array(part, "<u4").tobytes())) and (k == 0 or r["length"] == 1024)
            at += r["length"]
        assert at == len(ids) and len(by_doc[i]) == -(-len(ids) // 1024)
    for part in by_sequence.values():
        at = 0
        for r in sorted(part, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    lengths = sorted((r["length"] for r in found), reverse=True)
    room: list[int] = []
    for n in lengths:  # first-fit decreasing, as a yardstick
        at = next((k for k, free in enumerate(room) if free >= n), None)
        if at is None:
            room.append(1024 - n)
        else:
            room[at] -= n
    assert -(-tokens // 1024) <= len(by_sequence) <= len(room) + 1
    assert sum(n * k for config, k in packing.solve(Counter(lengths)) for n, k in [(sum(a * b for a, b in config), k)]) == tokens


def test_op9(spark, rows):
    got = run(spark, 9)
    assert set(got) == set(rows)
    sizes, slots, shards = Counter(), defaultdict(list), defaultdict(set)
    for i, r in got.items():
        data = rows[i].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        shards[rows[i]].add(r["shard"])
    assert set(slots) == set(range(8)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in got.values())


def test_op10(spark, rows):
    from test_llm_operators import shingles

    got = run(spark, 10)
    assert set(got) == set(rows)
    texts = defaultdict(list)
    for i in sorted(rows):
        texts[frozenset(shingles(rows[i]))].append(i)
    sets = list(texts)
    head = {s: min(ids) for s, ids in texts.items()}
    parent = {h: h for h in head.values()}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = Counter()
    for k, a in enumerate(sets):
        for b in sets[k + 1 :]:
            both = len(a & b)
            if both and both / len(a | b) >= 0.8:
                links[head[a]] += 1
                links[head[b]] += 1
                x, y = sorted((root(head[a]), root(head[b])))
                parent[y] = x
    for s, ids in texts.items():
        for i in ids:
            assert (got[i]["class_id"], got[i]["n_copies"], got[i]["n_links"], got[i]["representative"]) == (root(head[s]), len(ids), links[head[s]], head[s])


def test_pipeline(spark, rows):
    import corpus_pipeline

    docs = spark.read.parquet(f"{D}/documents.parquet")
    got = corpus_pipeline.run(spark, D)
    assert {r["doc_id"] for r in got.collect()} <= set(rows) and got.count() > 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, docs.limit(0), D)
        assert empty.columns == docs.columns and empty.count() == 0


def test_stages_on_odd_rows(spark):
    """Nulls, empty and long texts, ties, repeated rows and clashing names."""
    import corpus_pipeline
    from test_llm_operators import TEXTS

    texts = [*TEXTS, "fine words of a plain text about nothing much " * 12, 'token = "abcdef0123456" ' + " ".join(f"word{i}" for i in range(90)), "x" * 300_000]
    rows = [(i, t, "en", "s", len(t or ""), 0.5, 1, "h", "c") for i, t in enumerate(texts)]
    rows += [rows[4], (None, texts[-2], None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, n_words int, hash string, class_id string").repartition(3)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, D)
        got = out.collect()
        if name == "packing":
            assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and {r["doc_id"] for r in got} == {r[0] for r in rows}
            continue
        assert out.columns == docs.columns and {tuple(r)[0] for r in got} <= {r[0] for r in rows}
        if name == "near_duplicates":
            ids = [r["doc_id"] for r in got if r["doc_id"] is not None]
            assert len(ids) == len(set(ids)) and {0, 3, 7} <= set(ids) and not {1, 2} & set(ids) and len(got) == len(ids) + 2
        if name == "secrets":
            assert len(got) == len(rows) and all(r["n_chars"] is None or r["n_chars"] == len(r["text"]) for r in got if r["text"] is not None)
            assert not any("abcdef0123" in (r["text"] or "") for r in got)
            assert "n_chars" not in stage(spark, docs.drop("n_chars"), D).columns
        if name == "quality_rules":
            assert all(len((r["text"] or "").split()) >= 50 for r in got) and any(r["doc_id"] == len(TEXTS) + 1 for r in got)
    empty = docs.limit(0)
    assert all(stage(spark, empty, D).count() == 0 for _, stage in corpus_pipeline.STAGES)

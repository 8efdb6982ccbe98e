"""Decontamination, manifest and whitening: contract queries, odd rows, and what their methods promise."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from listforge.llm import decontaminate, merkle, queries, whitening

D = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    df = queries.QUERIES[name](spark, D)
    found = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(found)


# --- decontamination --------------------------------------------------------------------------------------------------


def words_of(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_contamination(docs, items, size=10):
    windows = set()
    for item, text in items:
        w = words_of(text)
        windows |= {(item, tuple(w[s : s + size])) for s in range(max(1, len(w) - size + 1)) if w}
    out = []
    for doc_id, text in docs:
        w, hit, found = words_of(text), set(), set()
        for item, x in windows:
            for s in range(len(w) - len(x) + 1):
                if tuple(w[s : s + len(x)]) == x:
                    hit |= set(range(s, s + len(x)))
                    found |= {str(item)} - {"None"}
        out.append((doc_id, len(w), len(hit), sorted(found)))
    return sorted(map(str, out))


def odd_texts():
    rng = random.Random(7)
    word = lambda: rng.choice(["a", "b", "ab", "É", "é", "x1", "日本", "the"])
    texts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(40)]
    return [*texts, texts[3], texts[3], None, "", " .. ", "a", "A-b", "the " * 3000, "É\x00é", "x" * 100_000]


@pytest.mark.parametrize("broadcast_bytes", [decontaminate.BROADCAST_BYTES, 0])
def test_contamination_of_odd_texts(spark, broadcast_bytes):
    rng = random.Random(8)
    docs = [*enumerate(odd_texts()), (None, "a b ab"), (3, "the the the")]
    items = [(1, "the " * 12), (1, "b"), (2, "É"), (3, "a b"), (4, None), (5, " "), (None, "ab ab"), (6, "The a B ab é x1"), (6, "The a B ab é x1"), (7, "nowhere b")]
    items += [(10 + i, " ".join((docs[rng.randrange(40)][1] or "").split()[:k])) for i, k in enumerate((3, 9, 10, 11, 40, 60))]
    d = spark.createDataFrame([(i, t, "odd", 1) for i, t in docs], "doc_id long, text string, window string, n_words int")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.contamination(d, b, broadcast_bytes=broadcast_bytes).collect()
    assert sorted(str((r["doc_id"], r["n_words"], r["n_hit"], list(r["item_ids"]))) for r in rows) == brute_contamination(docs, items)
    for r in rows:  # stretches are apart, in order, and as long as the words that they hit
        ends = [x for s in r["spans"] for x in (s["start"], s["stop"])]
        assert ends == sorted(set(ends)) and sum(ends[1::2]) - sum(ends[::2]) == r["n_hit"]


def test_contamination_of_empty_tables(spark):
    d, b = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert decontaminate.contamination(d.where("false"), b).collect() == []
    for none in (b.where("false"), spark.createDataFrame([(1, "."), (2, None)], b.schema)):
        assert [tuple(r) for r in decontaminate.contamination(d, none).collect()] == [(1, 2, 0, [], [])]


def test_decontamination_joins_rare_shingles_in_one_loop(spark):
    """No Python, no shuffle of texts: between the scan and the comparison there is one broadcast join."""
    docs, tokens = spark.read.parquet(f"{D}/documents.parquet"), F.broadcast(spark.createDataFrame([(1,)], "token long"))
    plan = decontaminate.places(docs, [3]).where("p > 0").select("token").join(tokens, "token")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.count("split(") == 1 and not re.search("Python|Arrow|SortMerge|Cartesian", plan)


# --- manifest ---------------------------------------------------------------------------------------------------------


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded root) of rows (doc_id, text, lang, source, n_chars)."""

    def levels(nodes):
        found = [nodes]
        while len(nodes) > 1:
            nodes = [sha("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
            found.append(nodes)
        return found

    def leaf_of(r, more=0):
        return sha(field(r[0]) + field(r[3]) + field(r[2]) + field(None if r[4] is None else r[4] + more) + field(r[1]))

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[g] = levels([leaf_of(r) for r in groups[g]])
    top = levels([trees[g][-1][0] for g in order])
    out = []
    for at, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node, siblings = leaf_of(r, int(changed)), []
            for tree, place in ((trees[g], i), (top, at)):
                for level in tree[:-1]:
                    other = level[place ^ 1 : (place ^ 1) + 1]
                    siblings += other
                    node = sha("".join(other + [node] if place & 1 else [node] + other))
                    place >>= 1
            out.append((r[0], leaf_of(r), trees[g][-1][0], top[-1][0], sha("".join(siblings)), node))
    return sorted(map(str, out))


@pytest.mark.parametrize("height", [1, 2, 10])
def test_manifest_of_odd_rows(spark, height):
    rng = random.Random(height)
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, "", "é", "a:b-"]), rng.choice([None, "", "-", "de", "é", "日"]), rng.choice([None, "s"]), rng.choice([None, -1, 5, (1 << 63) - 1])) for _ in range(150)]
    rows += [(7, "same", "en", "s", 4)] * 70 + [(8, "x" * 100_000, "alone", None, None)]
    df = spark.createDataFrame([(*r, "y", 0) for r in rows], DOCS + ", leaf string, pos int").repartition(5)
    found = merkle.proved(merkle.manifest(merkle.leaves(df), height)).collect()
    assert sorted(str(tuple(r)[:6]) for r in found) == brute_manifest(rows)
    assert all(r["verified"] == (r["folded_root"] == r["root"]) for r in found) and not all(r["verified"] for r in found)


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_manifest_of_few_rows(spark, n):
    rows = [(i, "t", "en", "s", 1) for i in range(n)]
    found = merkle.proved(merkle.manifest(merkle.leaves(spark.createDataFrame(rows, DOCS)))).collect()
    assert sorted(str(tuple(r)[:6]) for r in found) == brute_manifest(rows)


def test_manifest_divides_equal_rows_and_groups(spark):
    """4,000 equal rows of one group: places are gapless, and no partition of the ordering holds them all."""
    rows = merkle.leaves(spark.createDataFrame([(1, "t", "en", "s", 1)], DOCS).crossJoin(spark.range(4000)).drop("id"))
    got = merkle.placed(rows, "doc_id", "leaf")
    assert sorted(r["pos"] for r in got.select("pos").collect()) == list(range(4000))
    assert rows.withColumn("t", F.monotonically_increasing_id()).repartitionByRange(4, "group", "doc_id", "leaf", "t").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 2000


# --- whitening --------------------------------------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, n string, x int")


def checked(spark, table, x, k):
    """The result for vectors x (ids 0, 1, ...) against the covariance's eigenvectors."""
    whitened, shares, n = whitening.whiten(table)
    assert n == len(x)
    rows = {r["vec_id"]: r for r in whitened.collect()}
    assert sorted(rows) == list(range(n))
    c = x - x.mean(axis=0)
    values, basis = np.linalg.eigh(c.T @ c / n)
    values, basis = values[::-1], basis[:, ::-1]
    got = np.array([rows[i]["whitened"] for i in range(n)])
    assert got.shape == (n, k) and np.allclose(shares[:k], (values / values.sum())[:k], rtol=1e-9)
    expected = (c @ basis / np.sqrt(values))[:, :k]
    assert np.allclose(got, expected * np.sign((got * expected).sum(axis=0)), atol=1e-6)
    for i in range(n):
        assert int(rows[i]["deviation"]) == sum((n * int(v) - int(s)) ** 2 for v, s in zip(x[i], x.sum(axis=0), strict=True))
    return whitening.identity_error(whitened)


def test_op13(spark):
    got = queries.QUERIES["op13_embedding_whitening"](spark, D).toPandas()
    table = spark.read.parquet(f"{D}/embeddings.parquet").toPandas()
    x = np.floor(64 * np.array(table.embedding.tolist(), dtype=float)).astype(np.int64) + 1_000_000
    n, c = len(x), x - x.mean(axis=0)
    values, basis = np.linalg.eigh(c.T @ c / n)
    values, basis = values[::-1][:32], basis[:, ::-1][:, :32]
    expected = (c @ basis / np.sqrt(values))[np.argsort(table.vec_id)]
    y = got.sort_values(["vec_id", "component"]).whitened.to_numpy().reshape(n, 32)
    assert np.allclose(y, expected * np.sign((y * expected).sum(axis=0)), atol=1e-8)
    assert (got.n == n).all() and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    assert abs(got.identity_error[0] - np.abs(np.cov(y.T, bias=True) - np.eye(32)).max()) < 1e-12
    deviations = dict(zip(got.vec_id, got.deviation, strict=True))
    assert all(deviations[i] == sum((n * int(v) - int(s)) ** 2 for v, s in zip(r, x.sum(axis=0), strict=True)) for i, r in zip(table.vec_id, x, strict=True))


def test_whitening_in_many_parts(spark):
    """Hundreds of parts, some of one row or none, merge to the same as the whole; means are far apart."""
    rng = np.random.default_rng(1)
    points = np.round(rng.normal(size=(900, 5)) * [9, 5, 3, 2, 1] + np.arange(900)[:, None] // 300 * 50, 3)
    table = vectors(spark, [(i, p.tolist(), "a", 1) for i, p in enumerate(points)]).repartition(300, F.col("vec_id") % 290)
    x = np.floor(64 * points.astype(np.float32).astype(float)).astype(np.int64) + 1_000_000
    assert checked(spark, table, x, 5) < 1e-9


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(2)
    points = rng.integers(-9, 9, size=(30, 3)).astype(float)
    odd = [None, [], [1.0, None, 2.0], [1.0, float("nan"), 0.0], [float("inf"), 0.0, 0.0], [1e30, 0.0, 0.0], [1.0, 2.0]]
    rows = [(i, p.tolist(), "a", 1) for i, p in enumerate(points)] + [(100 + i, v, "a", 1) for i, v in enumerate(odd)]
    x = (64 * points).astype(np.int64) + 1_000_000
    assert checked(spark, vectors(spark, rows).repartition(7), x, 3) < 1e-9
    # Repeated rows, null ids and a constant dimension: the constant one has no component.
    rows = [(None, [float(i), 2.0], "a", 1) for i in range(5)] * 2
    whitened, shares, n = whitening.whiten(vectors(spark, rows))
    assert n == 10 and len(whitened.first()["whitened"]) == 1 and whitened.count() == 10 and abs(shares[0] - 1) < 1e-12
    for none in ([], [(1, [1.0, 2.0], "a", 1)] * 3, [(1, None, "a", 1)]):
        assert whitening.whiten(vectors(spark, none))[0].count() == 0


def test_merging_is_lossless():
    rng = np.random.default_rng(3)
    x = rng.integers(-1000, 1000, size=(200, 6)) + 1_000_000
    a, b = whitening.decomposed(x[:7]), whitening.decomposed(x[7:])
    n, sums, values, directions = whitening.merged(a, b)
    c = x - x.mean(axis=0)
    assert n == 200 and sums == x.sum(axis=0).tolist() and len(values) == 6
    assert np.allclose((values[:, None] * directions).T @ (values[:, None] * directions), c.T @ c, rtol=1e-9)
    # Without the row for the means' distance, scatter would be missing.
    without = np.vstack([a[2][:, None] * a[3], b[2][:, None] * b[3]])
    assert not np.allclose(without.T @ without, c.T @ c, rtol=1e-3)

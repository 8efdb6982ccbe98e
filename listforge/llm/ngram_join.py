"""N-gram Jaccard self-join with a MinHash LSH forest and exact verification.

1. Texts with equal sets of 5-word shingles are copies: one representative of them, the first row, goes on.
2. A representative has TREES * DEPTH MinHash values of 16 bits. In each of the TREES tries its label is DEPTH of them; a
   node of a trie is a prefix of labels. Matched prefixes are shortened node by node: from the longest length at which a
   pair at the threshold is met with the target recall (`longest`), even if all tries matched at that length, on to
   LEAST values as long as the node has no more than SMALL members. Most prefixes end at LEAST, where recall is higher;
   crowded places of a trie keep longer ones.
3. Nodes are sorted within partitions. In a node of at most SMALL members all pairs are candidates whose signatures agree
   well enough; each candidate is verified on the two texts. A pair that meets in several tries counts in the first of
   them alone; the lengths of its texts' prefixes tell where they met.
4. The members of a node that is crowded at its longest prefix are dealt by a hash into blocks of about BLOCK, and for
   every two blocks one group verifies all pairs between them exactly, with a product of their shingle matrices. What a
   group gives is the number of these pairs by text and a spanning forest of them, fewer rows than twice its members, so
   that m near copies don't make m * m / 2 rows and no class falls apart.
5. Verified pairs are links; connected documents are one class, named by its smallest document id.

`n_links` is the number of different texts that a verified link joins to the document's text, in nodes of any size. Copies
count once, as `n_copies`.

Defined results: null counts as empty; texts without words are copies of one another; a text of fewer than five words
has one shingle, all its words; a text of any length is read whole; rows with a null id are classes of their own, with a
null class; repeated rows are repeated in the result, and rows that share an id but not a text are joined each by its own
text; an empty table gives an empty result; other columns don't pass through (join by id), whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, materialize, small_batches, table, works_on

WORDS, THRESHOLD = 5, 0.8
TREES, DEPTH, LEAST, RECALL = 15, 4, 3, 0.999
K = TREES * DEPTH
SMALL = 24
#: Agreeing values of K from which a pair is a candidate (3.5 standard deviations below the threshold).
CANDIDATE = 37
#: Members of a block of a large node, and columns of a shingle matrix that are multiplied at once.
BLOCK, COLUMNS = 1024, 2048

_rng = np.random.Generator(np.random.PCG64(7))
_A = _rng.integers(1, 1 << 63, K, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 1 << 63, K, dtype=np.uint64)
_M = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)
_WORDS_AT_MOST = 500_000


def longest(trees: int = TREES, depth: int = DEPTH, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The longest prefix at which pairs at the threshold still meet in one of the trees with the target recall."""
    return next((d for d in range(depth, 1, -1) if 1 - (1 - threshold**d) ** trees >= recall), 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """64-bit hashes of the 5-word shingles of texts, sorted, each once."""

    def __init__(self):
        self.hashes: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words, known = (text or "").split(), self.hashes
        if not words:
            return np.zeros(0, np.uint64)
        try:
            found = [known[w] for w in words]
        except KeyError:
            if len(known) > _WORDS_AT_MOST:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w)
            found = [known[w] for w in words]
        h = np.array(found, np.uint64)
        n = max(1, len(h) - WORDS + 1)
        mixed = np.full(n, len(h) if len(h) < WORDS else WORDS, np.uint64)
        for i in range(min(WORDS, len(h))):
            mixed = _mixed(mixed + h[i : i + n] * _M[i])
        return np.unique(mixed)


def signature(shingles: np.ndarray) -> bytes:
    low = np.full(K, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        low = np.minimum(low, (shingles[None, at : at + 4096] * _A[:, None] + _B[:, None]).min(axis=1))
    return (_mixed(low) & np.uint64(0xFFFF)).astype(">u2").tobytes()


SIGNED = pa.schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("key", pa.binary()), ("sig", pa.binary())])


def _sign(batches):
    works_on("join")
    shingler = Shingler()
    for batch in batches:
        rows = []
        for doc_id, text, hash_ in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            shingles = shingler(text)
            rows.append((doc_id, hash_, hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), signature(shingles)))
        yield arrow(rows, SIGNED)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 0.0


def met_before(one: np.ndarray, two: np.ndarray, tree: int, lengths: np.ndarray) -> np.ndarray:
    """Whether each signature of one is with each of two in a node of a trie before this one.

    lengths: of the prefixes of one in each trie; what is in the same node has the same length.
    """
    met = np.zeros((len(one), len(two)), bool)
    one, two = np.ascontiguousarray(one.T), np.ascontiguousarray(two.T)
    for t in range(tree):
        same = np.ones(met.shape, bool)
        for k in range(DEPTH):
            longer = lengths[:, t] > k
            if not longer.any():
                break
            same[longer] &= one[t * DEPTH + k][longer, None] == two[t * DEPTH + k][None, :]
        met |= same
    return met


def gather(sigs: np.ndarray, lengths: np.ndarray, tree: int) -> np.ndarray:
    """Candidate pairs (rows of two places) of a small node of a trie that have met in no earlier trie."""
    close = (sigs[:, None, :] == sigs[None, :, :]).sum(axis=2) >= CANDIDATE
    return np.argwhere(np.triu(close, 1) & ~met_before(sigs, sigs, tree, lengths))


def signatures(column: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """MinHash values and lengths of prefixes: a packed signature is the former in 16 bits each, then the latter in 8."""
    packed = np.frombuffer(b"".join(column), np.uint8).reshape(-1, 2 * K + TREES)
    return np.ascontiguousarray(packed[:, : 2 * K]).view(">u2").astype(np.uint16), packed[:, 2 * K :]


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _nodes(batches):
    """Candidates of small nodes: rows of tree, node, rep and sig, sorted by node. Holds one node at a time."""
    tree, node, ids, sigs = None, None, [], []
    rows: list[tuple] = []

    def pairs():
        if len(ids) < 2:
            return []
        held = np.array(ids)
        a, b = held[gather(*signatures(sigs), tree).T]
        return zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True)

    for batch in batches:
        for t, n, id_, sig in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if (t, n) != (tree, node):
                rows += pairs()
                tree, node, ids, sigs = t, n, [], []
            ids.append(id_)
            sigs.append(sig)
        yield arrow(rows, LINKS)
        rows = []
    rows += pairs()
    yield arrow(rows, LINKS)


def similar(one: list[np.ndarray], two: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Whether the exact Jaccard similarity of each set of one with each of two (of one, if null) reaches the threshold."""

    def flat(sets):
        return np.concatenate([*sets, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(sets)), [len(x) for x in sets])

    values, rows = flat(one)
    others, places = (values, rows) if two is None else flat(two)
    if two is None:
        found, times = np.unique(values, return_counts=True)
        shared = found[times > 1]
    else:
        shared = np.intersect1d(values, others)

    def columns(v, r):
        at = np.searchsorted(shared, v)
        here = at < len(shared)
        here[here] = shared[at[here]] == v[here]
        at, r = at[here], r[here]
        order = np.argsort(at, kind="stable")
        return at[order], r[order]

    sizes = [np.array([len(x) for x in sets], float) for sets in (one, one if two is None else two)]
    (at, rows), (to, places) = columns(values, rows), columns(others, places)
    both = np.zeros((len(sizes[0]), len(sizes[1])), np.float32)
    for low in range(0, len(shared), COLUMNS):
        width = min(COLUMNS, len(shared) - low)
        sides = []
        for c, r, n in ((at, rows, both.shape[0]), (to, places, both.shape[1])):
            part = slice(*np.searchsorted(c, [low, low + width]))
            side = np.zeros((n, width), np.float32)
            side[r[part], c[part] - low] = 1
            sides.append(side)
        both += sides[0] @ sides[1].T
    met = both.astype(float)
    return met / np.maximum(sizes[0][:, None] + sizes[1][None, :] - met, 1) >= threshold


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric matrix of neighbours."""
    edges, unseen = [], np.ones(len(near), bool)
    for root in np.flatnonzero(near.any(axis=1)).tolist():
        if not unseen[root]:
            continue
        unseen[root] = False
        todo = [root]
        while todo:
            i = todo.pop()
            new = np.flatnonzero(near[i] & unseen)
            unseen[new] = False
            edges += [(i, j) for j in new.tolist()]
            todo += new.tolist()
    return edges


def _verified_block(key, group, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids of two blocks of a node (or of one) and the symmetric matrix of their verified pairs."""
    shingler, tree, x, y = Shingler(), key[0].as_py(), key[2].as_py(), key[3].as_py()
    ids, block = group.column("rep").to_numpy(), group.column("block").to_numpy()
    sigs, lengths = signatures(group.column("sig").to_pylist())
    sets = [shingler(t) for t in group.column("text").to_pylist()]
    one, two = np.flatnonzero(block == x), np.flatnonzero(block == y)
    met = similar([sets[i] for i in one], None if x == y else [sets[i] for i in two], threshold)
    if met.any():
        met &= ~met_before(sigs[one], sigs[two], tree, lengths[one])
    near = np.zeros((len(ids), len(ids)), bool)
    near[np.ix_(one, two)] = met
    near |= near.T
    np.fill_diagonal(near, False)
    return ids, near


COUNTED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def _within(threshold: float):
    """A spanning forest of the verified pairs of two blocks (n is null) and their number by text (b is null)."""

    def run(key, group):
        ids, near = _verified_block(key, group, threshold)
        rows = [(*sorted((int(ids[i]), int(ids[j]))), None) for i, j in forest(near)]
        rows += [(i, None, n) for i, n in zip(ids.tolist(), near.sum(axis=1).tolist(), strict=True) if n]
        return pa.Table.from_batches([arrow(rows, COUNTED)], schema=COUNTED)

    return run


def _all_within(threshold: float):
    def run(key, group):
        ids, near = _verified_block(key, group, threshold)
        i, j = np.nonzero(np.triu(near))
        return pa.table([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])], schema=LINKS)

    return run


def _verified(threshold: float):
    def run(batches):
        shingler, held = Shingler(), {}

        def of(id_, text):
            if id_ not in held:
                if len(held) >= 256:
                    held.clear()
                held[id_] = shingler(text)
            return held[id_]

        for batch in batches:
            rows = []
            for a, b, one, two in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if jaccard(of(a, one), of(b, two)) >= threshold:
                    rows.append((a, b))
            yield arrow(rows, LINKS)

    return run


def forest_of(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, longer). nodes: tree, node (a prefix of labels), rep, size and depth of each representative that isn't alone
    in its node; longer: rep, tree and depth where a prefix is longer than LEAST, the largest depth counts.

    Prefixes are shortened node by node, see above. reps: rep and sig, stored.
    """
    labels = F.array(*[F.struct(F.lit(t).alias("tree"), F.substring("sig", 1 + 2 * DEPTH * t, 2 * longest()).alias("label")) for t in range(TREES)])
    rows = reps.select("rep", F.explode(labels).alias("x")).select("x.tree", "x.label", "rep")
    prefix = lambda d: F.substring("label", 1, 2 * d)
    out = longer = None
    for depth in range(LEAST, longest() + 1):
        rows = rows.withColumn("node", prefix(depth))
        sizes = rows.groupBy("tree", "node").agg(F.count("*").alias("size")).where("size > 1")
        # Both sides grow with the input, so that this join sorts and merges; a crowded node is divided as a skewed key.
        sized = materialize(rows.hint("merge").join(sizes, ["tree", "node"]), "nodes", depth > LEAST)
        done = sized if depth == longest() else sized.where(F.col("size") <= SMALL)
        done = done.select("tree", "node", "rep", "size", F.lit(depth).alias("depth"))
        out = done if out is None else out.unionByName(done)
        rows = sized.where(F.col("size") > SMALL).select("tree", "label", "rep")
        if depth < longest():
            deeper = rows.select("rep", "tree", F.lit(depth + 1).alias("depth"))
            longer = deeper if longer is None else longer.unionByName(deeper)
    return out, longer


def candidates(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, crowds). pairs: a < b, each pair once, of small nodes, stored; crowds: members of crowded nodes, once for
    every two blocks x and y that their block is one of. reps: rep and sig, stored."""
    parts = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes, longer = forest_of(reps)
    lengths = longer.groupBy("rep").agg(*[F.max(F.when(F.col("tree") == t, F.col("depth"))).alias(f"d{t}") for t in range(TREES)])
    packed = F.concat("sig", *[F.unhex(F.lpad(F.hex(F.coalesce(f"d{t}", F.lit(LEAST))), 2, "0")) for t in range(TREES)])
    signed = materialize(reps.hint("merge").join(lengths, "rep", "left").select("rep", packed.alias("sig")), "lengths", True)
    placed = nodes.hint("merge").join(signed, "rep")
    small = placed.where(F.col("size") <= SMALL).select("tree", "node", "rep", "sig").repartition(parts, "tree", "node").sortWithinPartitions("tree", "node")
    pairs = materialize(small.mapInArrow(_nodes, "a long, b long"), "candidates")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    crowd = placed.where(F.col("size") > SMALL).select("tree", "node", "rep", "sig", blocks.alias("blocks"), F.pmod(F.xxhash64("rep"), blocks).cast("int").alias("block"))
    met = crowd.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return pairs, met.select("tree", "node", "rep", "sig", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))


def components(links: DataFrame) -> DataFrame:
    """id and class (the smallest id connected to it) of every id in links (a, b), cheap to read again.

    Each round takes the smallest class among neighbours and then that class's own class, and is written to the shared
    folder; links of shallow forests need few rounds.
    """
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links", True)
    labels = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("c")), "classes", True)
    while True:
        seen = both.join(labels.select(F.col("a").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("near"))
        nearer = labels.join(seen, "a").select("a", F.col("c").alias("old"), F.least("c", "near").alias("c"))
        jump = labels.select(F.col("a").alias("c"), F.col("c").alias("far"))
        new = materialize(nearer.join(jump, "c", "left").select("a", F.least("c", "far").alias("c"), "old"), "classes", True)
        labels = new.select("a", "c")
        if new.where("c <> old").isEmpty():
            return labels.select(F.col("a").alias("id"), F.col("c").alias("class"))


def join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(members, links). members: doc_id, hash (of the text, with which it names a row of docs), representative (the
    smallest id of its copies), class (a number, which tells classes apart whose ids are equal), class_id, n_copies, n_links; links: a, b of representatives.

    links are found anew when they are read: only there the links of crowded nodes, m * m / 2 of m near copies, are rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("hash"))
    signed = materialize(rows.mapInArrow(_sign, "doc_id long, hash long, key binary, sig binary").withColumn("row", F.monotonically_increasing_id()), "signed")
    known = signed.where("doc_id is not null")
    # Rows are numbered where they are stored, so that representatives with equal ids stay apart.
    first = F.min_by(F.struct("doc_id", "hash", "sig"), "row").alias("first")
    copies = known.groupBy("key").agg(F.min("row").alias("rep"), F.min("doc_id").alias("least"), F.count("*").alias("n_copies"), first)
    reps = materialize(copies.select("key", "rep", "least", "n_copies", "first.*"), "representatives", True)
    pairs, crowds = candidates(reps.select("rep", "sig"))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("rep")).unionByName(crowds.select("rep")).distinct()
    # Candidates grow with the input, so these joins sort and merge at every size: one plan, and nothing is broadcast.
    wanted = reps.hint("merge").join(ends, "rep").select("rep", "doc_id", "hash")
    texts = rows.hint("merge").join(wanted, ["doc_id", "hash"]).select("rep", "text").dropDuplicates(["rep"])
    one = pairs.hint("merge").join(texts.select(F.col("rep").alias("a"), F.col("text").alias("one")), "a")
    two = one.hint("merge").join(texts.select(F.col("rep").alias("b"), F.col("text").alias("two")), "b")
    apart = materialize(two.select("a", "b", "one", "two").mapInArrow(_verified(threshold), "a long, b long"), "verified")
    whole = crowds.hint("merge").join(texts, "rep").groupBy("tree", "node", "x", "y")
    within = materialize(whole.applyInArrow(_within(threshold), "a long, b long, n long"), "within")
    pairs = apart.unionByName(whole.applyInArrow(_all_within(threshold), "a long, b long"))
    named = [reps.select(F.col("rep").alias(n), F.col("least").alias(f"id_{n}")) for n in ("a", "b")]
    links = pairs.join(named[0], "a").join(named[1], "b").select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))
    enough = apart.unionByName(within.where("n is null").select("a", "b"))
    counts = apart.select(F.explode(F.array("a", "b")).alias("rep"), F.lit(1).cast("long").alias("n")).unionByName(within.where("b is null").select(F.col("a").alias("rep"), "n"))
    degrees = counts.groupBy("rep").agg(F.sum("n").alias("n_links"))
    linked = components(enough).select(F.col("id").alias("rep"), "class").join(reps.select("rep", "least"), "rep")
    names = linked.groupBy("class").agg(F.min("least").alias("class_id"))
    table_ = linked.join(names, "class").select("rep", "class", "class_id").join(degrees, "rep")
    named = reps.select("key", "least", "n_copies", "rep").join(table_, "rep", "left").select("key", F.col("least").alias("representative"), F.coalesce("class", "rep").alias("class"), F.coalesce("class_id", "least").alias("class_id"), "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    members = known.select("doc_id", "hash", "key").join(named, "key").drop("key")
    lone = signed.where("doc_id is null").select("doc_id", "hash", *[F.lit(None).cast("long").alias(n) for n in ("representative", "class", "class_id")], F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"))
    return members.unionByName(lone), links


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents joined on shared 5-word shingles at a Jaccard similarity of 0.8: classes and links."""
    return join(table(spark, sf_dir, "documents").select("doc_id", "text"))[0].drop("hash", "class")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class, that with the smallest id (of equal ids, the smallest hash of its text), with the columns of
    docs; rows with a null id all stay."""
    members, _ = join(docs)
    kept = members.where("class is not null").groupBy("class").agg(F.min(F.struct("doc_id", "hash")).alias("kept"))
    mark = next(f"_hash{i}" for i in range(len(docs.columns) + 1) if f"_hash{i}" not in {c.lower() for c in docs.columns})
    rows = docs.withColumn(mark, F.xxhash64("text"))
    found = rows.join(kept.select(F.col("kept.doc_id").alias("doc_id"), F.col("kept.hash").alias(mark)), ["doc_id", mark], "left_semi")
    return found.dropDuplicates(["doc_id", mark]).select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.where("doc_id is null"))

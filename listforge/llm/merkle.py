"""Merkle manifest of a table: a root over all rows, and for each row the siblings that prove it.

Rows become leaves inside Spark's functions. Leaves get their places by one range partitioning over group and order, whose
partitions' counts are added up; nothing orders a whole group in one task. A group is then cut into aligned blocks of
1,024 leaves. A task walks its blocks one after the other: a recursion in postorder returns the digest of a subtree and,
while it unwinds, appends the digest of each half to the leaves in the other half, so that every leaf ends up with its
siblings inside the block. The digests of the blocks are the leaves of the next such walk, until one is left of each
group; the roots of the groups, in order, go the same way. Upper siblings are joined down, block by block.

A node whose run has no sibling becomes the digest of itself alone, at every level at which its group still has several
nodes; a group of one leaf is that leaf. Which side a sibling is on, and whether there is one, follows from a leaf's
place and the number of leaves, so that a proof holds digests alone.

Defined results: groups go by lang, null before all others, which go by their bytes; within a group null ids come first,
and rows of one id go by their leaf; equal rows have equal leaves and places of their own. A null field is a dash in the
leaf's input. An empty table has no rows. Columns other than the five of a leaf aren't part of it and don't pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow, materialize, small_batches, table

#: Levels of the tree within a block; a block has up to 2 ** HEIGHT leaves.
HEIGHT = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows whose id's checksum is divisible by this are tampered with in the query.
TAMPERED = 7


def leaf(*fields: Column) -> Column:
    """The digest of a row's fields: each its length in bytes and its value as text, or a dash."""
    parts = []
    for c in fields:
        c = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """rows of a written table with pos, their place within their group, from 0, and n, the group's number of rows."""
    spread = rows.withColumn("_tie", F.monotonically_increasing_id())  # equal rows too can be divided
    by = ("group", *order, "_tie")
    # The id that a sorted partition gives its rows is the partition's number, and from bit 33 down the row's place in it.
    there = materialize(spread.repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "placed")
    there = there.withColumn("_part", F.shiftright("_at", 33))
    runs = there.groupBy("group", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_m"))
    before = Window.partitionBy("group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumns({"_before": F.coalesce(F.sum("_m").over(before), F.lit(0)), "n": F.sum("_m").over(Window.partitionBy("group"))}).drop("_m")
    return there.join(runs, ["group", "_part"]).withColumn("pos", F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_before")


def pair(left: str, right: str = "") -> str:
    return hashlib.sha256((left + right).encode()).hexdigest()


def walk(leaves: list[str], height: int) -> tuple[str, list[list[str]]]:
    """The digest of an aligned block of at most 2 ** height leaves, and each leaf's siblings in it from the bottom up."""
    siblings: list[list[str]] = [[] for _ in leaves]

    def subtree(start: int, height: int) -> str:
        if not height:
            return leaves[start]
        middle, stop = start + (1 << height - 1), min(start + (1 << height), len(leaves))
        left = subtree(start, height - 1)
        if middle >= stop:
            return pair(left)
        right = subtree(middle, height - 1)
        for i in range(start, middle):
            siblings[i].append(right)
        for i in range(middle, stop):
            siblings[i].append(left)
        return pair(left, right)

    return subtree(0, height), siblings


def _walked(batches: Iterator, most: int) -> Iterator:
    """Blocks, one after the other, of rows sorted by group, block and pos; siblings come as one string of raw digests."""
    import pyarrow as pa

    schema = pa.schema([("group", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("siblings", pa.binary()), ("root", pa.binary())])

    def done(group, block, n, leaves):
        height = min(most, (n - 1).bit_length())
        root, found = walk([x.hex() for x in leaves], height)
        rows = [(group, (block << most) + i, n, x, bytes.fromhex("".join(s)), None if i else bytes.fromhex(root)) for i, (x, s) in enumerate(zip(leaves, found, strict=True))]
        return arrow(rows, schema)

    at, leaves, n = None, [], 0
    for batch in batches:
        for group, pos, count, digest in zip(*(batch.column(c).to_pylist() for c in ("group", "pos", "n", "digest")), strict=True):
            if at != (group, pos >> most):
                if leaves:
                    yield done(*at, n, leaves)
                at, leaves, n = (group, pos >> most), [], count
            leaves.append(digest)
    if leaves:
        yield done(*at, n, leaves)


def blocks(nodes: DataFrame, height: int) -> DataFrame:
    """nodes (group, pos, n, digest) with their siblings in their block, and on a block's first row its root."""
    nodes = nodes.select("group", "pos", "n", "digest").withColumn("block", F.shiftright("pos", height))
    nodes = nodes.repartition("group", "block").sortWithinPartitions("group", "block", "pos").drop("block")
    return materialize(nodes.mapInArrow(lambda batches: _walked(batches, height), "group string, pos long, n long, digest binary, siblings binary, root binary"), "blocks")


def tree(nodes: DataFrame, height: int = HEIGHT) -> tuple[DataFrame, DataFrame]:
    """(nodes with their siblings up to the root of their group; group and digest of the roots).

    As many traversals as a group has levels of blocks: each is a job over a thousandth of the rows of the one before.
    """
    levels, rest = [], nodes
    while True:
        level = blocks(rest, height)
        levels.append(level)
        rest = level.where("root IS NOT NULL").select("group", F.shiftright("pos", height).alias("pos"), F.ceil(F.col("n") / (1 << height)).cast("long").alias("n"), F.col("root").alias("digest"))
        if rest.where("n > 1").isEmpty():
            break
    found = levels.pop()
    while levels:
        above = found.select("group", F.col("pos").alias("block"), F.col("siblings").alias("above"))
        below = levels.pop().withColumn("block", F.shiftright("pos", height))
        found = below.join(above, ["group", "block"]).withColumn("siblings", F.concat("siblings", "above")).drop("block", "above")
    return found.drop("root"), rest.select("group", "digest")


def manifest(rows: DataFrame, height: int = HEIGHT) -> DataFrame:
    """rows (group, leaf and what else tells them apart, in order) with place, proof and roots.

    Added: pos, n (place in the group), group_pos, group_n (place among groups), siblings (raw digests, from the leaf to
    the root), subroot, root. rows: a written table with columns group string, doc_id and leaf binary.
    """
    at = placed(rows, "doc_id", "leaf")
    at = materialize(at, "leaves-placed")
    paths, subroots = tree(at.withColumn("digest", F.col("leaf")), height)
    groups = subroots.withColumns({"member": F.col("group"), "subroot": F.col("digest")}).withColumn("group", F.lit(""))
    groups = materialize(placed(materialize(groups, "subroots", small=True), "member"), "subroots-placed", small=True)
    tops, root = tree(groups, height)
    tops = tops.select("pos", F.col("siblings").alias("above"))
    groups = groups.join(tops, "pos").join(F.broadcast(root.withColumnRenamed("digest", "root")), "group")  # one row: the root
    groups = groups.select(F.col("member").alias("group"), F.col("pos").alias("group_pos"), F.col("n").alias("group_n"), "above", "subroot", "root")
    out = at.join(paths.select("group", "pos", "siblings"), ["group", "pos"]).join(groups, "group")
    return out.withColumn("siblings", F.concat("siblings", "above")).drop("above")


def folded(leaf: str, siblings: list[str], places: tuple[tuple[int, int], ...]) -> str:
    """The root that follows from a leaf and its siblings. places: (place, number of nodes) in the group, then of the group."""
    node, rest = leaf, iter(siblings)
    for at, n in places:
        while n > 1:
            node = pair(next(rest), node) if at & 1 else pair(node, next(rest)) if at + 1 < n else pair(node)
            at, n = at >> 1, (n + 1) >> 1
    return node


def proved(found: DataFrame, claim: str = "claim") -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (from the claimed leaf) and verified of manifest()'s rows."""
    import pyarrow as pa

    small_batches(found.sparkSession)
    doc_id = dict(found.dtypes)["doc_id"]
    names = ("leaf", "subroot", "root", "proof_sha256", "folded_root")

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("leaf", "subroot", "root", "siblings", "claim", "pos", "n", "group_pos", "group_n"))
            for own, subroot, root, raw, claimed, pos, n, group_pos, group_n in zip(*columns, strict=True):
                path = raw.hex()
                siblings = [path[i : i + 64] for i in range(0, len(path), 64)]
                out.append((own.hex(), subroot.hex(), root.hex(), pair(path), folded(claimed.hex(), siblings, ((pos, n), (group_pos, group_n)))))
            made = arrow(out, pa.schema([(c, pa.string()) for c in names]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made.columns], names=["doc_id", *names])

    found = found.select("doc_id", "leaf", "subroot", "root", "siblings", F.col(claim).alias("claim"), "pos", "n", "group_pos", "group_n")
    out = found.mapInArrow(run, f"doc_id {doc_id}, " + ", ".join(f"{c} string" for c in names))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def leaves(docs: DataFrame) -> DataFrame:
    """group, doc_id, leaf and claim of documents, written. claim: the leaf, or what it would be after tampering."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    # As a decimal, since the largest long has no successor of its type.
    more = [(F.col(c).cast("decimal(38,0)") + 1) if c == "n_chars" else F.col(c) for c in FIELDS]
    group = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-"))  # "-" sorts before "="
    own = leaf(*[F.col(c) for c in FIELDS])
    return materialize(docs.select(group.alias("group"), "doc_id", own.alias("leaf"), F.when(tampered, leaf(*more)).alias("claim")), "leaves").withColumn("claim", F.coalesce("claim", "leaf"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the manifest of all documents, each proof folded again, some from tampered rows."""
    small_batches(spark)
    found = proved(manifest(leaves(table(spark, sf_dir, "documents").select(*FIELDS))))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(cast({c} AS varchar)) || ':' || cast({c} AS varchar) END"


_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(cast(doc_id AS varchar), ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"


def _climb(name: str, leaves: str) -> str:
    return f"""{name} AS (SELECT 0 AS l, g, pos, h, count(*) OVER (PARTITION BY g) AS n FROM {leaves}
UNION ALL SELECT l + 1, g, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 1) // 2) FROM {name} WHERE n > 1 GROUP BY l, g, pos // 2)"""


OP12_SQL = f"""
WITH RECURSIVE src AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '-') AS g, sha256({" || ".join(map(_field, FIELDS))}) AS h,
CASE WHEN {_CRC} % {TAMPERED} = 0 THEN sha256({" || ".join(_field("(n_chars::HUGEINT + 1)" if c == "n_chars" else c) for c in FIELDS)}) END AS changed FROM documents),
leaf AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS pos FROM src),
{_climb("low", "leaf")},
sub AS (SELECT g AS member, h, row_number() OVER (ORDER BY g) - 1 AS pos, '' AS g FROM low WHERE n = 1),
{_climb("high", "sub")},
steps AS (SELECT leaf.r, low.l AS l, (leaf.pos >> low.l) & 1 AS odd, sib.h AS s FROM leaf JOIN low ON low.g = leaf.g AND low.pos = leaf.pos >> low.l AND low.n > 1 LEFT JOIN low sib ON sib.g = low.g AND sib.l = low.l AND sib.pos = xor(low.pos, 1)
UNION ALL SELECT leaf.r, 100 + high.l, (sub.pos >> high.l) & 1, sib.h FROM leaf JOIN sub ON sub.member = leaf.g JOIN high ON high.pos = sub.pos >> high.l AND high.n > 1 LEFT JOIN high sib ON sib.l = high.l AND sib.pos = xor(high.pos, 1)),
path AS (SELECT r, string_agg(s, '' ORDER BY l) AS p FROM steps GROUP BY r),
numbered AS (SELECT r, row_number() OVER (PARTITION BY r ORDER BY l) AS k, odd, s FROM steps),
fold AS (SELECT r, 0::BIGINT AS k, coalesce(changed, h) AS h FROM leaf UNION ALL SELECT fold.r, fold.k + 1, sha256(CASE WHEN s IS NULL THEN h WHEN odd = 1 THEN s || h ELSE h || s END) FROM fold JOIN numbered ON numbered.r = fold.r AND numbered.k = fold.k + 1),
folded AS (SELECT r, arg_max(h, k) AS folded_root FROM fold GROUP BY r),
top AS (SELECT h AS root FROM high WHERE n = 1)
SELECT doc_id, leaf.h AS leaf, sub.h AS subroot, root, sha256(coalesce(p, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaf JOIN sub ON sub.member = leaf.g JOIN folded USING (r) LEFT JOIN path USING (r), top
"""

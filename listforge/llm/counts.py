"""Edit-aware token counts: a segment tree over each document's words.

Leaves hold about LEAF_WORDS words each and end where a space stands between two characters other than white space; the
tokenizer never joins characters across such a place. A node knows the characters and tokens below it. An edit finds
the leaves it touches by descending along character sums; their region, widened until both its ends are such places
again, is encoded anew, its leaves take the places of the old ones and the sums above them are renewed; where they are
more than the places, the tree is put together anew from the leaves' sums. Everything else keeps its counts: whatever its
size, only the region is encoded. A leaf is as long as the text between two such places.

Defined results: a null text counts as empty and has no tokens; edits of a row apply in their order, each to the text
that the one before left; positions are code points and are cut to the text, a stop before its start counts as the
start; null edits are none; repeated rows are separate rows; an empty table gives an empty result; other columns are
carried along, those named like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import small_batches, table, without

LEAF_WORDS = 64


class Tree:
    """Node k has children 2k and 2k + 1; leaves begin at `n`, a power of two."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.n = 1 << max(0, len(chars) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.n), [0] * (2 * self.n)
        self.chars[self.n : self.n + len(chars)] = chars
        self.tokens[self.n : self.n + len(tokens)] = tokens
        for k in range(self.n - 1, 0, -1):
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def find(self, at: int) -> tuple[int, int]:
        """(leaf, its first character) of the leaf that holds character `at`; at the text's end, the last that holds any."""
        k, start = 1, 0
        at = min(at, self.chars[1] - 1)
        while k < self.n:
            k *= 2
            if at - start >= self.chars[k]:
                start += self.chars[k]
                k += 1
        return k - self.n, start

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        k = leaf + self.n
        self.chars[k], self.tokens[k] = chars, tokens
        while k > 1:
            k //= 2
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    def dump(self) -> bytes:
        kept = [(c, t) for c, t in zip(self.chars[self.n :], self.tokens[self.n :], strict=True) if c]
        return np.array(kept, "<u4").reshape(-1, 2).tobytes()

    @classmethod
    def load(cls, data: bytes) -> Tree:
        return cls(*np.frombuffer(data, "<u4").reshape(-1, 2).T.tolist())


def leaves(coded: bpe.Words) -> Iterator[tuple[list[int], list[int]]]:
    """Characters and tokens of the leaves of each text, LEAF_WORDS words a leaf."""
    chars = pc.utf8_length(coded.words).to_numpy()
    for low, high in zip(coded.offsets.tolist(), coded.offsets[1:].tolist(), strict=False):
        if low == high:
            yield [], []
            continue
        at = np.concatenate([[low], low + np.flatnonzero(coded.spaced[low:high])[LEAF_WORDS - 1 :: LEAF_WORDS]])
        yield np.add.reduceat(chars[:high], at, dtype=np.int64).tolist(), np.add.reduceat(coded.sizes[:high], at).tolist()


def build(text: str, encoder: bpe.Encoder) -> Tree:
    return Tree(*next(leaves(encoder.encoded(pa.array([text], pa.string())))))


def edit(text: str, tree: Tree, start: int, stop: int, insert: str, encoder: bpe.Encoder) -> tuple[str, Tree, int]:
    """The edited text, its tree, and how many characters were encoded."""
    start = min(max(start, 0), len(text))
    stop = min(max(stop, start), len(text))
    new = text[:start] + insert + text[stop:]
    if not text:
        return new, build(new, encoder), len(new)
    first, low = tree.find(start)
    last, high = tree.find(max(start, stop - 1))
    high += tree.chars[tree.n + last]
    grown = len(new) - len(text)
    while True:
        # The region's ends in the old text are low and high; in the new text the end has moved.
        left = low == 0 or (high + grown - low > 1 and new[low] == " " and not new[low + 1].isspace() and not new[low - 1].isspace())
        right = high == len(text) or (high + grown > low and not new[high + grown - 1].isspace())
        if left and right:
            break
        if not left:
            first, low = tree.find(low - 1)
        if not right:
            last, at = tree.find(high)
            high = at + tree.chars[tree.n + last]
    region = new[low : high + grown]
    words, ids = encoder.short(region)
    cut = range(0, len(words), LEAF_WORDS)
    chars = [sum(map(len, words[k : k + LEAF_WORDS])) for k in cut]
    tokens = [sum(map(len, ids[k : k + LEAF_WORDS])) // 2 for k in cut]
    if len(chars) > last + 1 - first:
        n = tree.n
        held = [*zip(tree.chars[n : n + first], tree.tokens[n : n + first], strict=True), *zip(chars, tokens, strict=True), *zip(tree.chars[n + last + 1 :], tree.tokens[n + last + 1 :], strict=True)]
        return new, Tree([c for c, _ in held if c], [t for c, t in held if c]), len(region)
    for k in range(first, last + 1):
        at = k - first
        if at < len(chars) or tree.chars[tree.n + k]:
            tree.put(k, *((chars[at], tokens[at]) if at < len(chars) else (0, 0)))
    return new, tree, len(region)


def with_counts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with n_tokens and token_tree."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("struct<n long, tree binary>")
    def counted(texts):
        import pandas as pd

        coded = bpe.encoder(path).encoded(pa.array(texts, pa.string(), from_pandas=True))
        rows = [(sum(tokens), np.array([chars, tokens], "<u4").T.tobytes()) for chars, tokens in leaves(coded)]
        return pd.DataFrame(rows, columns=["n", "tree"])

    out = without(docs, "n_tokens", "token_tree", "_counted").withColumn("_counted", counted(F.col(text)))
    return out.withColumns({"n_tokens": F.col("_counted.n"), "token_tree": F.col("_counted.tree")}).drop("_counted")


EDITS = "array<struct<start int, stop int, insert string>>"


def edited(docs: DataFrame, path: str, text: str = "text", edits: str = "edits") -> DataFrame:
    """docs (with n_tokens and token_tree) after the edits of each row; n_encoded counts the characters encoded for them."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("struct<text string, n long, tree binary, encoded long>")
    def changed(texts, trees, lists):
        import pandas as pd

        rows = []
        for t, data, steps in zip(texts, trees, lists, strict=True):
            t, tree, encoded = t or "", Tree.load(data), 0
            for step in () if steps is None else steps:
                t, tree, n = edit(t, tree, step["start"] or 0, step["stop"] or 0, step["insert"] or "", bpe.encoder(path))
                encoded += n
            rows.append((t, tree.total, tree.dump(), encoded))
        return pd.DataFrame(rows, columns=["text", "n", "tree", "encoded"])

    out = without(docs, "n_encoded", "_changed").withColumn("_changed", changed(F.col(text), F.col("token_tree"), F.col(edits)))
    return out.withColumns({text: F.col("_changed.text"), "n_tokens": F.col("_changed.n"), "token_tree": F.col("_changed.tree"), "n_encoded": F.col("_changed.encoded")}).drop("_changed")


def sample_edits(doc_id, text):
    """Three edits at places that the id decides: a replacement, an insertion with white space, a deletion."""
    size = F.greatest(F.length(text), F.lit(1))
    place = lambda salt: F.pmod(F.xxhash64(doc_id, F.lit(salt)), size).cast("int")
    one = lambda at, n, s: F.struct(at.alias("start"), (at + n).alias("stop"), F.lit(s).alias("insert"))
    return F.array(one(place(1), 12, "edited words"), one(place(2), 0, "  new\n line "), one(place(3), 20, "")).cast(EDITS)


def op8(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Token counts of all documents before and after three edits each, and how much was encoded for these.

    doc_id, n_chars, n_tokens, n_tokens_edited, n_encoded (characters encoded for the edits), edited_crc32.
    """
    path = path or bpe.default_vocabulary()
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counted = with_counts(docs, path).withColumn("n_tokens_before", F.col("n_tokens")).withColumn("n_before", F.length("text").cast("long"))
    after = edited(counted.withColumn("edits", sample_edits(F.col("doc_id"), F.col("text"))), path)
    return after.select("doc_id", F.col("n_before").alias("n_chars"), F.col("n_tokens_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"), "n_encoded", F.crc32(F.col("text").cast("binary")).alias("edited_crc32"))

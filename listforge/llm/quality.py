"""Quality rules in DataFrame operations only: text statistics and a learned decision list.

`statistics` computes a document's counts with array functions inside its row, so that no text is shuffled.
`learn` grows an ordered list of rules by sequential covering: on two thirds of the labelled rows a rule adds the
threshold condition with the highest FOIL gain until no good document is left in it, on the last third it loses the
conditions that don't hold there; what it covers is set aside and the next rule is grown. The list becomes one Spark
conditional expression.

Defined results: a null or empty text has no words, fails the base rules and isn't kept; without labelled bad documents
the list is empty and the base rules decide alone; a document labelled twice counts twice; repeated rows are separate
rows; a text of any length is counted whole; an empty table gives an empty result; other columns, whatever their names,
are carried along by `filter_quality`.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: White space between words, and what isn't counted as a symbol.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"
BANGS, DIGITS, UPPER = r"[^!?]+", r"[^0-9]+", r"[^\p{Lu}]+"
#: Everything that none of these four counts.
MARKED = r"[^#*$%&|<>!?0-9\p{Lu}]+"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_upper", "n_bangs", "n_digits")


def statistics(text: Column) -> dict[str, Column]:
    """What one pass over a text gives; null counts as empty."""
    whole = F.coalesce(text, F.lit(""))
    return {
        "_words": F.filter(F.split(whole, SPACE), lambda w: w != ""),
        "_lines": F.filter(F.split(whole, "\n"), lambda x: F.regexp_replace(x, SPACE, "") != ""),
        "_marks": F.regexp_replace(whole, MARKED, ""),
        "word_chars": F.length(F.regexp_replace(whole, SPACE, "")).cast("long"),
    }


def marks(kind: str) -> Column:
    return F.length(F.regexp_replace("_marks", kind, "")).cast("long")


def windows() -> Column:
    """Every 3-word window of `_words`, as a 64-bit hash, with its place, sorted by hash.

    Two of a text's windows share a hash by chance once in 10^14 texts of 500 words.
    """
    at = F.sequence(F.lit(0), F.greatest(F.size("_words") - 3, F.lit(0)))
    three = F.transform(at, lambda i: F.struct(F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)).alias("w"), i.alias("i")))
    return F.when(F.size("_words") >= 3, F.sort_array(three)).otherwise(F.array().cast("array<struct<w long, i int>>"))


def repeated_starts() -> Column:
    """Places of those windows of `_windows` that have an equal neighbour, ascending."""
    same = lambda x, i, d: F.coalesce(F.get("_windows", i + d).getField("w") == x.getField("w"), F.lit(False))
    return F.sort_array(F.transform(F.filter("_windows", lambda x, i: same(x, i, -1) | same(x, i, 1)), lambda x: x.getField("i")))


def covered() -> Column:
    """Words that the windows starting at `_starts` cover: a window adds three, less what it shares with the one before."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    step = lambda a, i: F.struct((a["n"] + F.least(i - a["last"], F.lit(3))).alias("n"), i.alias("last"))
    return F.aggregate("_starts", zero, step, lambda a: a["n"])


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts of COUNTS and MORE."""
    first = docs.withColumns(statistics(F.col(text)))
    # Each of these steps reads the arrays of the one before more than once, so the planner keeps them apart.
    second = first.withColumns({
        "n_words": F.size("_words").cast("long"),
        "n_symbols": marks(SYMBOLS), "n_bangs": marks(BANGS), "n_digits": marks(DIGITS), "n_upper": marks(UPPER),
        "_windows": windows(),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
    })
    third = second.withColumn("_starts", repeated_starts()).withColumn("n_repeat_words", covered())
    # A later filter on a count is not pushed through a generator; through projections it would be, and would then
    # compute an array anew for each of its elements.
    counts = F.inline_outer(F.array(F.struct(*[F.col(c) for c in (*COUNTS, *MORE)])))
    return third.select(*[F.col(f"`{c}`") for c in docs.columns], counts)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


#: What rules may test: shares in thousandths, so that thresholds are whole numbers.
FEATURES: dict[str, str] = {
    "n_words": "n_words",
    "symbols": "1000 * n_symbols div greatest(n_words, 1)",
    "bangs": "1000 * n_bangs div greatest(n_words, 1)",
    "upper": "1000 * n_upper div greatest(word_chars, 1)",
    "digits": "1000 * n_digits div greatest(word_chars, 1)",
    "word_length": "1000 * word_chars div greatest(n_words, 1)",
    "dup_lines": "n_dup_lines",
    "repeats": "1000 * n_repeat_words div greatest(n_words, 1)",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: int

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>' if self.above else '<='} {self.threshold}"


Rule = tuple[Condition, ...]


def matches(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, [F.expr(c.sql()) for c in rule])


def learn(labelled: DataFrame, bad: str, key: str, max_rules: int = 8, max_conditions: int = 4, cuts: int = 24, least: int = 5, precision: float = 0.95) -> list[Rule]:
    """Rules, in order, each of which covers bad documents with the given precision on both parts of the labelled rows.

    labelled has the counts, a boolean column `bad` and a column `key` that is hashed to choose the part of a row. All
    labelled rows count. The driver gets two counts for each of at most len(FEATURES) * 3 * cuts intervals at a time.
    """
    part = (F.pmod(F.xxhash64(key), F.lit(3)) == 0).alias("prune")
    values = labelled.select(*[F.expr(e).alias(n) for n, e in FEATURES.items()], F.col(bad).alias("bad"), part)
    points = [i / cuts for i in range(1, cuts)]
    got = values.where(~F.col("prune")).agg(F.count_if("bad").alias("bad"), *[F.percentile_approx(n, points, 1000).alias(f"all_{n}") for n in FEATURES], *[F.percentile_approx(F.when(F.col("bad"), F.col(n)), points, 1000).alias(f"bad_{n}") for n in FEATURES]).first()
    if not got["bad"] or got["bad"] < least:
        return []
    thresholds = {n: sorted({*got[f"all_{n}"], *got[f"bad_{n}"], *(x - 1 for x in got[f"bad_{n}"])}) for n in FEATURES}
    # A row's value becomes the number of thresholds below it.
    rank_of = lambda n: F.size(F.filter(F.lit(thresholds[n]), lambda t: t < F.col(n)))
    ranks = [rank_of(n).alias(n) for n in FEATURES]
    rows = materialize(values.select(*ranks, "bad", "prune"), "quality-labelled", True)

    def tests(rule: Rule) -> Column:
        place = [(F.col(c.feature), thresholds[c.feature].index(c.threshold), c.above) for c in rule]
        return reduce(lambda a, b: a & b, [rank > k if above else rank <= k for rank, k, above in place], F.lit(True))

    def counts(frame: DataFrame, rules: list[Rule]) -> list[tuple[int, int]]:
        """(bad, good) of each of a few rules."""
        row = frame.agg(*[F.count_if(tests(r) & (F.col("bad") if want else ~F.col("bad"))).alias(f"c{i}_{want}") for i, r in enumerate(rules) for want in (1, 0)]).first()
        return [(row[f"c{i}_1"], row[f"c{i}_0"]) for i in range(len(rules))]

    def candidates(frame: DataFrame):
        """(condition, bad, good) of every single condition, from one count by feature and interval."""
        at = frame.select("bad", F.posexplode(F.array(*FEATURES)).alias("feature", "rank"))
        held = {(r["feature"], r["rank"], r["bad"]): r["count"] for r in at.groupBy("feature", "rank", "bad").count().collect()}
        for f, name in enumerate(FEATURES):
            sums = {want: [held.get((f, k, want), 0) for k in range(len(thresholds[name]) + 1)] for want in (True, False)}
            for j, t in enumerate(thresholds[name]):
                yield Condition(name, False, t), sum(sums[True][: j + 1]), sum(sums[False][: j + 1])
                yield Condition(name, True, t), sum(sums[True][j + 1 :]), sum(sums[False][j + 1 :])

    found: list[Rule] = []
    for _ in range(max_rules):
        left = reduce(lambda d, r: d.where(~tests(r)), found, rows)
        grow, prune = left.where(~F.col("prune")), left.where("prune")
        rule: Rule = ()
        bad_in, good_in = counts(grow, [()])[0]
        while bad_in >= least and good_in and len(rule) < max_conditions:
            scored = [(_gain(b, g, bad_in, good_in), b, c, g) for c, b, g in candidates(grow.where(tests(rule))) if b >= least]
            best = max(scored, key=lambda s: s[:2], default=(0,))
            if best[0] <= 0:
                break
            rule, bad_in, good_in = (*rule, best[2]), best[1], best[3]
        if not rule:
            break
        # Final conditions go as long as the rule does no worse without them on rows that didn't shape it.
        shorter = [rule[:k] for k in range(1, len(rule) + 1)]
        on_prune, on_grow = counts(prune, shorter), counts(grow, shorter)
        worth = [(b - g) / (b + g) if b + g else -1.0 for b, g in on_prune]
        best_k = max(range(len(shorter)), key=lambda k: (worth[k], -k))
        (b, g), (pb, pg) = on_grow[best_k], on_prune[best_k]
        if b < least or b < precision * (b + g) or pb < precision * (pb + pg):
            break
        found.append(shorter[best_k])
    return found


def _gain(bad: int, good: int, bad_before: int, good_before: int) -> float:
    """FOIL gain: bad documents kept, times the bits by which they stand out more."""
    from math import log2

    return bad * (log2(bad / (bad + good)) - log2(bad_before / (bad_before + good_before))) if bad else 0.0


def verdict(rules: list[Rule]) -> Column:
    """Ordered conditional: the first rule that matches rejects; true for what none matches."""
    out = None
    for rule in rules:
        out = (F if out is None else out).when(matches(rule), F.lit(False))
    return out.otherwise(F.lit(True)) if out is not None else F.lit(True)


def learn_from_labels(stats: DataFrame, labels: DataFrame) -> list[Rule]:
    """stats: counts by doc_id, cheap to read; labels: doc_id and quality (0 is bad; null is no label)."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", (F.col("quality") == 0).alias("bad"))
    return learn(stats.join(known, "doc_id"), "bad", "doc_id")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: counts and verdicts of all documents. Texts are read once; the small counts are kept."""
    stats = materialize(with_statistics(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "quality-counts")
    rules = learn_from_labels(stats, table(spark, sf_dir, "labels"))
    return stats.select("doc_id", *COUNTS, base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"))


def filter_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Those rows of docs that neither the base rules nor the learned list reject, with the columns of docs."""
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("text").alias("_text"))
    # Counts are computed once, and stored with the rows, whose columns may have any names.
    stored = materialize(with_statistics(held, "_text").drop("_text"), "quality-counts")
    rules = learn_from_labels(stored.select("_doc.doc_id", *COUNTS, *MORE), labels)
    return stored.where(~base_failed() & verdict(rules)).select("_doc.*")

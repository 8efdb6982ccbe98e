"""Secret scans with one combined deterministic automaton.

All rules are compiled together (see automaton.py); a document's bytes are read once for all of them, and only where a
rule ends does a rule's own small automaton settle start and end. Three base kinds come first, further kinds of
credentials after them.

Defined results: a null text counts as empty and holds nothing; offsets are code points of the text, end exclusive;
matches of one kind never overlap, those of different kinds may; repeated rows are separate rows; an empty table gives
an empty result; other columns are carried along, those named like an output column are replaced.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .automaton import Scanner
from .common import small_batches, table, without, works_on

#: name, expression, letters in either case, characters of a match at least. Runs are taken whole and measured after
#: that: a short match hides what lies inside it, and the automaton needs no counters.
RULES = [
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", True, 0),
    ("access", r"AKIA[A-Z0-9]+", False, 20),
    ("hex", r"[0-9a-f]{24,}", False, 24),
    ("forge", r"gh[pousr]_[A-Za-z0-9]+", False, 40),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]+", False, 15),
    ("web", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", False, 30),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", False, 0),
    ("cloud", r"AIza[A-Za-z0-9_-]+", False, 39),
    ("pay", r"[srp]k_(live|test)_[A-Za-z0-9]+", False, 24),
    ("bearer", r"bearer\x20+[A-Za-z0-9._~+/-]+=*", True, 23),
]
BASE = 3
VALUE_AT_LEAST = 6
PEM = next(k for k, r in enumerate(RULES) if r[0] == "pem")
#: What belongs to a private key after its first line: all up to the END line or, without one, the header lines and lines
#: of base64 that follow (line breaks may be escaped, lines indented or quoted).
_END = re.compile(r"-----END [A-Z ]*PRIVATE KEY-----")
_BODY = re.compile(r"""(?:(?:[ \t"'+]*(?:\\r|\\n|\r|\n))+[ \t>"'+]*(?:(?:Proc-Type|DEK-Info):[^\r\n\\]*|[A-Za-z0-9+/]{16,}={0,2}|[A-Za-z0-9+/]{1,15}={1,2}))*""")
#: Where the value of an assignment begins.
_HEAD = re.compile(rb"""[A-Za-z_]+["']?\x20*[:=]\x20*["']?""")


@cache
def scanner() -> Scanner:
    """Compiled once a process."""
    return Scanner([r[:3] for r in RULES])


def spans_of(text: str) -> list[tuple[int, int, int]]:
    """(start, rule, end) in code points, by start, then rule."""
    data = text.encode()
    found = []
    for rule, start, end in scanner().scan(data):
        if end - start < RULES[rule][3] or rule == 0 and end - _HEAD.match(data, start).end() < VALUE_AT_LEAST:
            continue
        found.append((start, rule, end))
    if found and not text.isascii():
        points = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
        found = [(int(points[s]), rule, int(points[e])) for s, rule, e in found]
    return sorted(found)


def _key_end(text: str, at: int) -> int:
    """Where the private key ends whose first line ends at this place."""
    other = text.find("-----BEGIN ", at)
    last = _END.search(text, at, len(text) if other < 0 else other)
    return last.end() if last else _BODY.match(text, at).end()


def secrets_of(text: str) -> list[tuple[int, int, int]]:
    """spans_of with private keys whole, not their first lines alone."""
    return [(start, rule, _key_end(text, end) if rule == PEM else end) for start, rule, end in spans_of(text)]


def _joined(spans) -> str:
    return ",".join(f"{RULES[rule][0]}:{s}:{e}" for s, rule, e in spans)


DIGEST = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def _digests(batches):
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            spans = secrets_of(text or "")
            base = [x for x in spans if x[1] < BASE]
            counts = [sum(x[1] == k for x in base) for k in range(BASE)]
            rows.append((doc_id, *counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
        yield pa.RecordBatch.from_pylist([dict(zip(DIGEST.names, r, strict=True)) for r in rows], schema=DIGEST)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all secrets of all documents."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(_digests, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `secrets`: array of kind, start, end."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("array<struct<kind string, start int, end int>>")
    def found(texts):
        return texts.map(lambda t: [{"kind": RULES[rule][0], "start": s, "end": e} for s, rule, e in secrets_of(t or "")])

    return without(docs, "secrets").withColumn("secrets", found(F.col(text)))


def masked(text: str | None) -> str | None:
    """text with every secret replaced by <kind>; overlapping spans become one, named after the first."""
    spans = secrets_of(text or "")
    if not spans:
        return text
    out, at = [], 0
    for start, rule, end in spans:
        if start >= at:
            out += [text[at:start], f"<{RULES[rule][0]}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every secret of the text masked; a null text stays null."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(texts):
        works_on("secrets")
        return texts.map(masked, na_action="ignore")

    return docs.withColumn(text, clean(F.col(text)))

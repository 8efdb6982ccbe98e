"""Seams for what runs outside Spark: page fetching, scoring by a model, structured extraction, language detection.

Each seam takes a factory that makes one client for a partition. Results are not deterministic, so callers write them
once before they branch. The clients shipped here work without a network: a rule scorer and a fetcher that knows a map.
"""

from __future__ import annotations

import html
import importlib
import re
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import jsonx, text
from ..shipping import ship

#: Fetched bodies shorter than this are failures; longer ones are cut.
BODY_LEAST, BODY_MOST, ERROR_MOST = 200, 6000, 140
PROMPT_SCORE, PROMPT_BRIEF = 5000, 5500
TOO_SHORT = "the page has too little text"

Fetcher = Callable[[str], str]
Scorer = Callable[[str, str, str, str], str]


def page_text(body: str) -> tuple[str, str | None]:
    """(text, error) of a fetched body."""
    body = re.sub(r"\n{3,}", "\n\n", body).strip()
    return ("", TOO_SHORT) if len(body) < BODY_LEAST else (body[:BODY_MOST], None)


def fetched(df: DataFrame, make: Callable[[], Fetcher], s: Settings) -> DataFrame:
    """df with fetched and fetch_error, one client a partition and fetch_workers partitions at a time."""
    ship(df.sparkSession)
    names = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = started(make)
        for pdf in batches:
            found = [attempt(lambda u: page_text(get(u)), url) for url in pdf["url"]]
            out = [("", error) if error else page for page, error in found]
            yield pdf.assign(fetched=[x for x, _ in out], fetch_error=[e for _, e in out])[[*names, "fetched", "fetch_error"]]

    ddl = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", fetched string, fetch_error string"
    return df.repartition(s.fetch_workers).mapInPandas(run, ddl)


def failure_sample(df: DataFrame, most: int = 5) -> DataFrame:
    """url and fetch_error of the first fetches that failed, in order of arrival."""
    return df.where(F.col("fetch_error").isNotNull()).orderBy("row_idx").limit(most).select("url", "fetch_error")


def web_fetcher() -> Fetcher:
    """A client for pages behind URLs, as text."""
    from ..sources.api import http

    def get(url: str) -> str:
        page = re.sub(r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ", http(url))
        return html.unescape(re.sub(r"[ \t]+", " ", re.sub(r"<[^>]+>", "\n", page)))

    return get


def with_body(df: DataFrame) -> DataFrame:
    """body and source: the fetched text, else title, company and snippet."""
    has = text.blank(F.col("fetched")) != ""
    return df.withColumns({"body": F.when(has, F.col("fetched")).otherwise(F.concat_ws("\n", "title", "company", "snippet")), "source": F.when(has, "full").otherwise("snippet")})


def scored(df: DataFrame, make: Callable[[], Scorer], s: Settings) -> DataFrame:
    """df with the fields of a score, which win over those of df; a model that fails or babbles gives the sentinel."""
    ship(df.sparkSession)

    @F.pandas_udf("string")
    def answers(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        ask = started(make)

        def one(title, company, location, body):
            # The sentinel stands for any failure.
            return attempt(ask, title or "", company or "", location or "", (body or "")[:PROMPT_SCORE])[0]

        for columns in batches:
            yield pd.Series([one(*row) for row in zip(*columns, strict=True)], dtype=object)

    answers = answers.asNondeterministic()
    out = df.repartition(s.score_workers).withColumn("_raw", answers("title", "company", "location", "body"))
    out = out.withColumn("_s", F.coalesce(jsonx.parse_score(F.col("_raw")), jsonx.scoring_error()))
    fields = [f.name for f in out.schema["_s"].dataType.fields]
    return out.withColumns({n: F.col(f"_s.{n}") for n in fields} | {"scraped_date": F.lit(str(s.today))}).drop("_raw", "_s")


def rule_scorer(s: Settings) -> Callable[[], Scorer]:
    """A deterministic stand-in for a model: terms found, each worth ten points, on a base of 45."""

    def make() -> Scorer:
        import json

        def ask(title: str, company: str, location: str, body: str) -> str:
            words = f" {title} {body} ".lower()
            tech = [t.strip() for t in s.tech_terms if t in words]
            bridge = [t for t in s.bridge_terms if t in words]
            student = "student" in words or "studenter" in words
            return json.dumps({"score": min(100, 45 + 10 * len(tech) + 5 * len(bridge)) if tech or bridge else 10, "track": "A" if tech else "B" if bridge else "none", "is_tech_company": len(tech) > 2, "employment_type": "student" if student else "unknown", "work_mode": "remote" if "remote" in words else "unknown", "location": location, "commute_ok": True, "danish_level": "required" if "flydende dansk" in words else "none", "deadline": "", "reasoning": f"{len(tech)} technical terms", "matched_skills": tech[:10]})

        return ask

    return make


def extracted(df: DataFrame, make: Callable[[], Callable[[str, str], str]], body: str = "body") -> DataFrame:
    """df with brief_json, a JSON object that a model drew from title and body, null where it gave none, and brief_error.

    brief_error says what a call failed with; a row whose call fails loses its brief and nothing else.
    """
    ship(df.sparkSession)

    @F.pandas_udf("raw string, error string")
    def answers(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        ask = started(make)
        for titles, bodies in batches:
            yield pd.DataFrame([attempt(ask, t or "", (b or "")[:PROMPT_BRIEF]) for t, b in zip(titles, bodies, strict=True)], columns=["raw", "error"])

    out = df.withColumn("_a", answers.asNondeterministic()("title", body))
    return out.withColumns({"brief_json": jsonx.valid_object(F.col("_a.raw")), "brief_error": F.col("_a.error")}).drop("_a")


def started(make: Callable[[], Callable]) -> Callable:
    """The client of a partition; one that can't be made fails each of its calls in the same way."""
    try:
        return make()
    except Exception as e:  # a model may be away
        return partial(_fails, str(e)[:ERROR_MOST])


def _fails(why: str, *_) -> None:
    raise RuntimeError(why)


def attempt(ask: Callable, *given: str) -> tuple[str | None, str | None]:
    """(answer, None), or (None, what the call failed with)."""
    try:
        return ask(*given), None
    except Exception as e:  # a model may fail in any way; the row says how
        return None, str(e)[:ERROR_MOST] or type(e).__name__


#: The code of a text whose detection failed. Gates treat it like a text whose language isn't known.
UNDETECTED = "?"


def detected(text_column: Column, make: Callable[[], Callable[[str], str | None]]):
    """A column of language codes from a detector, of the first 2,000 characters; UNDETECTED where it fails."""

    @F.pandas_udf("string")
    def codes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = started(make)
        for column in batches:
            found = [attempt(of, (t or "")[:2000]) for t in column]
            yield pd.Series([UNDETECTED if error else code for code, error in found], dtype=object)

    return codes(text_column)


def rule_extractor() -> Callable[[str, str], str]:
    """A deterministic stand-in for a model: the first sentence, and the lists below headings that name their kind."""

    def ask(title: str, body: str) -> str:
        import json

        kinds = {"require": "must_have", "qualif": "must_have", "nice": "nice_to_have", "plus": "nice_to_have", "task": "responsibilities", "responsib": "responsibilities"}
        found: dict = {"title": title, "role_summary": re.split(r"(?<=[.!?])\s", body.strip(), maxsplit=1)[0][:300]}
        kind = None
        for line in body.splitlines():
            item = re.match(r"\s*[-*•]\s*(.+)", line)
            if item and kind:
                found.setdefault(kind, []).append(item[1].strip())
            elif line.strip() and not item:
                kind = next((v for k, v in kinds.items() if k in line.lower()), None)
        return json.dumps(found)

    return ask


#: Words that tell four languages apart, for the detector that is shipped.
COMMON = {
    "da": "og er til af ikke det vi du at på som med har der også hos jeg blive arbejde",
    "en": "the and of to is you we with for are our will have this your be work",
    "no": "og er til av ikke det vi du at på som med har også hos jeg blir å arbeid",
    "sv": "och är till av inte det vi du att på som med har också hos jag blir arbete",
}


def rule_detector() -> Callable[[str], str | None]:
    """A deterministic stand-in for a detector: the language with the most common words, if it leads and has five."""
    words = {k: frozenset(v.split()) for k, v in COMMON.items()}

    def of(body: str) -> str | None:
        seen = re.findall(r"\w+", body.lower())
        ranked = sorted(((sum(w in known for w in seen), k) for k, known in words.items()), reverse=True)
        return ranked[0][1] if ranked[0][0] >= 5 and ranked[0][0] > ranked[1][0] else None

    return of


def client(name: str, shipped: Callable) -> Callable | None:
    """The factory that a command names: module.function, `rules` for the shipped one, none without a name."""
    if not name:
        return None
    if name == "rules":
        return shipped
    module, _, function = name.rpartition(".")
    return getattr(importlib.import_module(module), function)

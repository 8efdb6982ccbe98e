"""Column functions that read model output and API answers, however broken they are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, html_to_text, stripped

LEVELS = ("none", "preferred", "required")
ERROR = "scoring error"


def valid_object(raw: Column) -> Column:
    """The JSON object in a text: all of it, or what is between its first and last brace; null if neither parses."""
    braces = F.regexp_extract(blank(raw), r"(?s)\{.*\}", 0)
    whole = stripped(blank(raw))
    ok = lambda c: c.startswith("{") & F.try_parse_json(c).isNotNull()
    return F.when(ok(whole), whole).when(ok(braces), braces)


def whole_number(c: Column) -> Column:
    """85, 85.7 and "85" are 85; null for anything else."""
    return c.try_cast("double").try_cast("int")


def level(current: Column, legacy: Column) -> Column:
    """The language level, else what the older yes or no says, else none."""
    now = F.lower(stripped(blank(current)))
    return F.when(now.isin(*LEVELS), now).when(F.lower(blank(legacy)) == "true", "required").otherwise("none")


def parse_score(raw: Column) -> Column:
    """A struct of score fields, null where no score can be found.

    A missing field has its default: 0, none, unknown, commutable. In text that isn't JSON single fields are looked for,
    and without a score there is no result.
    """
    found, text = valid_object(raw), blank(raw)
    get = lambda name: F.get_json_object(found, f"$.{name}")
    grab = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    or_ = lambda c, default: F.coalesce(c, F.lit(default))
    has_score = F.regexp_extract(text, r'"score"\s*:\s*(\d+)', 1)
    says = lambda s: F.contains(F.lower(text), F.lit(s))
    number = F.when(get("score").isNull(), 0).otherwise(whole_number(get("score")))
    full = F.struct(
        number.alias("score"), or_(get("track"), "none").alias("track"), (or_(get("is_tech_company"), "false") == "true").alias("is_tech_company"),
        or_(get("employment_type"), "unknown").alias("employment_type"), or_(get("work_mode"), "unknown").alias("work_mode"), or_(get("location"), "").alias("location"),
        (or_(get("commute_ok"), "true") != "false").alias("commute_ok"), level(get("danish_level"), get("danish_required")).alias("danish_level"),
        or_(get("deadline"), "").alias("deadline"), or_(get("reasoning"), "").alias("reasoning"),
        F.coalesce(F.from_json(get("matched_skills"), "array<string>"), F.array().cast("array<string>")).alias("matched_skills"),
    )
    rest = F.struct(
        has_score.try_cast("int").alias("score"), or_(grab(r'"track"\s*:\s*"([AB]|none)"'), "none").alias("track"), says('"is_tech_company": true').alias("is_tech_company"),
        or_(grab(r'"employment_type"\s*:\s*"(\w+)"'), "unknown").alias("employment_type"), or_(grab(r'"work_mode"\s*:\s*"(\w+)"'), "unknown").alias("work_mode"), or_(grab(r'"location"\s*:\s*"([^"]*)"'), "").alias("location"),
        (~says('"commute_ok": false')).alias("commute_ok"), F.coalesce(grab(r'"danish_level"\s*:\s*"(none|preferred|required)"'), F.when(says('"danish_required": true'), "required").otherwise("none")).alias("danish_level"),
        or_(grab(r'"deadline"\s*:\s*"([^"]*)"'), "").alias("deadline"), or_(grab(r'"reasoning"\s*:\s*"([^"]+)"'), "regex fallback").alias("reasoning"),
        F.array().cast("array<string>").alias("matched_skills"),
    )
    return F.when(found.isNotNull() & number.isNotNull(), full).when(has_score != "", rest)


def scoring_error() -> Column:
    """What stands for a score that could not be had."""
    return F.struct(
        F.lit(0).alias("score"), F.lit("none").alias("track"), F.lit(False).alias("is_tech_company"), F.lit("unknown").alias("employment_type"), F.lit("unknown").alias("work_mode"), F.lit("").alias("location"),
        F.lit(True).alias("commute_ok"), F.lit("none").alias("danish_level"), F.lit("").alias("deadline"), F.lit(ERROR).alias("reasoning"), F.array().cast("array<string>").alias("matched_skills"),
    )


def listed(raw: Column) -> Column:
    """The objects of an answer, as JSON texts: the answer itself if it is a list, the lists under jobs and featuredJobs if
    they hold any, else the first list among docs, hits, results, items; else none."""
    read = lambda path: F.when(F.get_json_object(raw, path).startswith("["), F.from_json(F.get_json_object(raw, path), "array<string>"))
    none = F.array().cast("array<string>")
    wrapped = F.concat(F.coalesce(read("$.jobs.docs"), none), F.coalesce(read("$.featuredJobs.docs"), none))
    flat = F.coalesce(*[read(f"$.{k}") for k in ("docs", "hits", "results", "items")], none)
    whole = F.when(stripped(blank(raw)).startswith("["), F.from_json(raw, "array<string>"))
    return F.coalesce(whole, F.when(F.size(wrapped) > 0, wrapped).otherwise(flat))


def pick(raw: Column, *names: str) -> Column:
    """The first of the fields that isn't empty (null, "", [] and {} are), as text; else an empty text."""
    return F.coalesce(*[F.when(~F.get_json_object(raw, f"$.{n}").isin("", "[]", "{}"), F.get_json_object(raw, f"$.{n}")) for n in names], F.lit(""))


def inside(value: Column, *names: str) -> Column:
    """value, or if it is an object the first of its fields that isn't empty."""
    return F.when(value.startswith("{"), pick(value, *names)).otherwise(value)


def joined_list(value: Column) -> Column:
    """value, or if it is a list its items that aren't empty, joined by a comma and a space."""
    items = F.filter(F.from_json(value, "array<string>"), lambda x: F.coalesce(x != "", F.lit(False)))
    return F.when(value.startswith("["), F.array_join(items, ", ")).otherwise(value)


# Names that fields of an API's objects go by, in order of preference.
FIELDS = {
    "title": ("title", "headline", "name", "jobTitle"),
    "company": ("companyName", "company", "employer", "organisation", "organization"),
    "id": ("id", "_id", "objectID", "uuid"),
    "url": ("url", "applicationUrl", "jobUrl", "link", "permalink"),
    "body": ("description", "descriptionHtml", "jobDescription", "body", "content", "text"),
    "location": ("location", "city", "workplace", "region"),
    "published": ("publishedAt", "published", "createdAt", "datePosted", "created", "postedAt"),
    "snippet": ("excerpt", "teaser", "summary", "shortDescription"),
}
BODY_OVER = 200


def teaser_columns(raw: Column, job_url: str) -> dict[str, Column]:
    """Teaser columns of an API object; title or url are empty where it has none."""
    from .dates import parse_date

    text = lambda c: F.when(stripped(c) == "", "N/A").otherwise(stripped(c))
    company = inside(pick(raw, *FIELDS["company"]), "name", "title", "companyName")
    place = joined_list(inside(pick(raw, *FIELDS["location"]), "locality", "city", "address", "name", "country"))
    url, number = inside(pick(raw, *FIELDS["url"]), "href"), pick(raw, *FIELDS["id"])
    url = F.when(url != "", url).when(number != "", F.concat(F.lit(job_url), number)).otherwise("")
    body = html_to_text(pick(raw, *FIELDS["body"]))
    short = pick(raw, *FIELDS["snippet"])
    published = parse_date(pick(raw, *FIELDS["published"]))
    return {
        "title": stripped(pick(raw, *FIELDS["title"])), "company": text(company), "location": text(place),
        "published_date": F.coalesce(published.cast("string"), F.lit("N/A")),
        "snippet": F.substring(F.when(short != "", short).otherwise(body), 1, 500), "url": stripped(url), "source_site": F.lit("hub"),
        "description": F.when(F.length(body) > BODY_OVER, body), "source": F.when(F.length(body) > BODY_OVER, "full"),
    }

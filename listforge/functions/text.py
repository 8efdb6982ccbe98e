"""Column functions on text: identity keys, markup, slugs, bars. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track a visitor.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "source", "trid", "rx_campaign", "codes", "gh_src", "ref", "referrer", "mc_cid", "mc_eid", "fbclid", "gclid")
# Words and letters that mark Danish and English.
DANISH = (" og ", " er ", " til ", " som ", " med ", " af ", " vi ", " du ", "erfaring", "medarbejder", "ansøg", "arbejde")
DANISH_LETTERS = ("æ", "ø", "å")
ENGLISH = (" the ", " and ", " you ", " we ", " with ", " for ", "experience", "responsibilities", "requirements", "apply")


def stripped(c: Column) -> Column:
    """Without white space at both ends; trim() would leave tabs and line feeds."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def any_in(text: Column, terms) -> Column:
    """Whether any term is in the text, which is computed once; false without terms."""
    return F.exists(F.array(text), lambda x: reduce(lambda a, b: a | b, [F.contains(x, F.lit(t)) for t in terms], F.lit(False)))


def unescaped(c: Column) -> Column:
    """A query part as read: + is a space, escapes are decoded, and what can't be decoded stays."""
    return F.coalesce(F.try_url_decode(c), F.replace(c, F.lit("+"), F.lit(" ")))


def escaped(c: Column) -> Column:
    """A query part as written: letters, digits and -._~ stay, a space is +."""
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def query_pairs(query: Column) -> Column:
    """Array of name and value for each part of a query string; a part without = has an empty value."""
    parts = F.filter(F.split(query, "&"), lambda p: p != "")

    def pair(p):
        at = F.instr(p, "=")
        name = F.when(at > 0, F.substring_index(p, "=", 1)).otherwise(p)
        value = F.when(at > 0, p.substr(at + 1, F.length(p))).otherwise(F.lit(""))
        return F.struct(unescaped(name).alias("k"), unescaped(value).alias("v"))

    return F.transform(parts, pair)


def canonical_url(url: Column) -> Column:
    """The identity of a URL: host in lower case without www., no tracking parameters, sorted query, no fragment.

    Null and empty give an empty string; text that is no URL stays as it is.
    """
    # Each step is an array of one struct, so that what several later parts use is computed once.
    part = lambda u, n: F.regexp_extract(u, r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$", n)
    whole = F.array(stripped(blank(url)))
    parts = F.transform(whole, lambda u: F.struct(u.alias("u"), part(u, 1).alias("scheme"), part(u, 2).alias("host"), part(u, 3).alias("path"), part(u, 4).alias("query")))

    def cleaned(p: Column) -> Column:
        kept = F.array_sort(F.filter(query_pairs(p["query"]), lambda q: ~F.lower(q["k"]).isin(*TRACKING)))
        text = F.array_join(F.transform(kept, lambda q: F.concat(escaped(q["k"]), F.lit("="), escaped(q["v"]))), "&")
        bare = F.regexp_replace(p["path"], "/+$", "")
        host = F.regexp_replace(F.lower(p["host"]), r"^www\.", "")
        scheme = F.when(p["scheme"] == "", "https").otherwise(F.lower(p["scheme"]))
        return F.struct(p["u"].alias("u"), ((p["scheme"] == "") & (p["host"] == "")).alias("no_url"), scheme.alias("scheme"), host.alias("host"), F.when(bare == "", "/").otherwise(bare).alias("path"), F.when(p["query"] == "", "").otherwise(text).alias("query"))

    def joined(p: Column) -> Column:
        path = F.when((p["host"] == "") | p["path"].startswith("/"), p["path"]).otherwise(F.concat(F.lit("/"), p["path"]))
        front = F.concat(p["scheme"], F.lit(":"), F.when(p["host"] == "", "").otherwise(F.concat(F.lit("//"), p["host"])))
        return F.when(p["no_url"], p["u"]).otherwise(F.concat(front, path, F.when(p["query"] == "", "").otherwise(F.concat(F.lit("?"), p["query"]))))

    return F.get(F.transform(F.transform(parts, cleaned), joined), F.lit(0))


def alnum(c: Column) -> Column:
    return F.regexp_replace(F.lower(blank(c)), "[^a-z0-9]", "")


def role_key(company: Column, title: Column) -> Column:
    """The identity of a role under different URLs; empty if either side has no ASCII letter or digit."""
    c, t = alnum(company), alnum(title)
    return F.when((c != "") & (t != ""), F.concat(c, F.lit("|"), t)).otherwise(F.lit(""))


# Character references that are decoded. The ampersand comes last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
BODY_CAP, SNIPPET_CAP = 6000, 500


def decoded(c: Column) -> Column:
    return reduce(lambda a, e: F.replace(a, F.lit(e[0]), F.lit(e[1])), ENTITIES, c)


def html_to_text(html: Column) -> Column:
    """Readable text of markup: no comments, a line feed for each tag, at most two line feeds together, at most 6,000."""
    bare = F.regexp_replace(blank(html), r"(?s)<!--.*?-->", "")
    bare = F.regexp_replace(bare, r"(?is)<(script|style)\b[^>]*>.*?</\1>", "")
    lines = decoded(F.regexp_replace(bare, r"<[^>]+>", "\n"))
    return F.substring(stripped(F.regexp_replace(lines, r"\n{3,}", "\n\n")), 1, BODY_CAP)


def occurrences(text: Column, needle: str) -> Column:
    """How often a needle is in the text, without overlap."""
    # Bytes are known without reading the text; characters aren't.
    return ((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle.encode())).cast("int")


def danish_marks(text: Column) -> Column:
    """Array of one struct: da, the marks of Danish, and en, those of English in a text, which is lowered once."""
    s = F.concat(F.lit(" "), F.lower(stripped(blank(text))), F.lit(" "))
    total = lambda x, terms: reduce(lambda a, b: a + b, [occurrences(x, t) for t in terms])
    return F.transform(F.array(s), lambda x: F.struct(total(x, DANISH + DANISH_LETTERS).alias("da"), total(x, ENGLISH).alias("en")))


def looks_danish(text: Column, detected: Column | None = None, marks: Column | None = None) -> Column:
    """Main language Danish: what a detector says (da, or en, no, sv), else by marks. Under 40 characters: false.

    marks: danish_marks of the text, where a query has them already.
    """
    by_marks = F.exists(danish_marks(text) if marks is None else marks, lambda m: (m["da"] > 0) & (m["en"] < F.greatest(F.lit(3.0), m["da"] * 0.3)))
    if detected is not None:
        by_marks = F.when(detected == "da", True).when(detected.isin("en", "no", "sv"), False).otherwise(by_marks)
    return F.when(F.length(stripped(blank(text))) < 40, False).otherwise(by_marks)


def confidently_danish(text: Column, detected: Column | None = None, least: int = 60) -> Column:
    """What a detector alone says, of a text long enough; false without a detector."""
    known = F.lit(False) if detected is None else F.coalesce(detected == "da", F.lit(False))
    return (F.length(stripped(blank(text))) >= least) & known


def slug(c: Column) -> Column:
    """A file name part: word characters, runs of space, _ and - as one _, at most 50, else `role`."""
    s = F.regexp_replace(stripped(blank(c)), r"(?U)[^\w\s-]", "")
    s = F.substring(F.btrim(F.regexp_replace(s, r"(?U)[\s_-]+", "_"), F.lit("_")), 1, 50)
    return F.when(s == "", "role").otherwise(s)


def bullets(items: Column, empty: str = "_(none extracted)_") -> Column:
    """A Markdown list of an array's items that aren't blank."""
    kept = F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: stripped(blank(x))), lambda x: x != "")
    return F.when(F.size(kept) > 0, F.array_join(F.transform(kept, lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise(F.lit(empty))


def filled(c: Column, other: Column) -> Column:
    """c, or where it is null, empty or N/A, the other; c itself (empty for null) where there is no other."""
    return F.when(F.coalesce(c, F.lit("")).isin("") | (F.upper(c) == "N/A"), F.coalesce(other, c, F.lit(""))).otherwise(c)


def bar(n: Column, most: Column, width: int = 34) -> Column:
    """Blocks in proportion, halves rounded to even; none if the most is not positive."""
    return F.when(most > 0, F.repeat(F.lit("█"), F.bround(width * n.cast("double") / most, 0).cast("int"))).otherwise(F.lit(""))


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, halves rounded to even; null of nothing."""
    return F.bround(100.0 * part / F.nullif(whole, F.lit(0)), 0).cast("int")


def skills(joined: Column) -> Column:
    """The array that `"; "` joins."""
    return F.filter(F.transform(F.split(blank(joined), ";"), stripped), lambda x: x != "")


def search_url(base: str, keyword: Column, page: Column) -> Column:
    return F.concat(F.lit(base), F.lit("?q="), F.replace(keyword, F.lit(" "), F.lit("+")), F.lit("&page="), page.cast("string"))

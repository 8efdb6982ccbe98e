"""Teasers from the cards of a result page.

Cards nest, close late or not at all, and hold further markup, which patterns over text can't follow; so pages are read
by an HTML parser in Arrow batches. What follows (dates, excluded employers, addresses) are column functions.
"""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import dates, text
from ..operators import filters
from ..shipping import ship

# Classes of a card and of the employer's name in it, and elements that have no end.
CARD, COMPANY = "jobsearch-result", "jix-toolbar-top__company"
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
HEADS = ("h3", "h4")

CARD_DDL = "array<struct<title string, url string, company string, stamp string, shown string, snippet string>>"


class Cards(HTMLParser):
    """The cards of a page, each a dict of texts; shown is what a <time> shows, stamp its attribute (null without)."""

    def __init__(self, card: str = CARD, company: str = COMPANY):
        super().__init__(convert_charrefs=True)
        self.card, self.company = card, company
        self.open: list[tuple[str, list[str], list[dict]]] = []  # name, texts inside, cards that it began
        self.found: list[dict] = []

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        given, texts = dict(attrs), []
        classes = (given.get("class") or "").split()
        for card in self._around():
            if tag == "a" and "title" not in card and any(name in HEADS for name, _, _ in self.open[card["depth"] :]):
                card |= {"title": texts, "url": (given.get("href") or "").strip()}
            if self.company in classes and "company" not in card:
                card["company"] = texts
            if tag == "time" and "shown" not in card:
                card |= {"shown": texts, "stamp": given.get("datetime")}
            if tag == "p":
                card["paragraphs"].append(texts)
        began = []
        if tag == "div" and self.card in classes:
            began = [{"depth": len(self.open), "paragraphs": []}]
            self.found += began
        self.open.append((tag, texts, began))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is not None:
            del self.open[at:]

    def handle_data(self, data):
        data = data.strip()
        if data and not any(name in ("script", "style") for name, _, _ in self.open):
            for _, texts, _ in self.open:
                texts.append(data)

    def _around(self) -> list[dict]:
        return [card for _, _, began in self.open for card in began]


def cards_of(page: str | None, card: str = CARD, company: str = COMPANY) -> list[dict]:
    """title, url, company, stamp, shown and snippet of every card of a page; empty texts for what it lacks."""
    reader = Cards(card, company)
    reader.feed(page or "")
    reader.close()
    return [
        {
            "title": "".join(c.get("title", [])), "url": c.get("url", ""), "company": " ".join(c.get("company", [])), "stamp": c.get("stamp"),
            "shown": "".join(c.get("shown", [])), "snippet": " ".join(p for p in (" ".join(texts) for texts in c["paragraphs"]) if p)[: text.SNIPPET_CAP],
        }
        for c in reader.found
    ]


def cards(page: Column, card: str = CARD, company: str = COMPANY) -> Column:
    """The cards of a page, in its order."""

    @F.pandas_udf(CARD_DDL)
    def found(pages):
        return pages.map(lambda p: cards_of(p, card, company))

    return found(page)


def teasers(pages: DataFrame, s: Settings, page: str = "raw") -> DataFrame:
    """A teaser of each card, with `card`, its place on the page, and the other columns of pages.

    Cards without a title or an address go, those of excluded employers, and those dated before the cutoff; an unreadable
    date stays as it is shown.
    """
    ship(pages.sparkSession)
    kept = [F.col(f"`{c}`") for c in pages.columns if c != page]
    each = pages.select(*kept, F.posexplode(cards(F.col(page))).alias("card", "_c"))
    day = dates.parse_date(F.col("_c.stamp"))
    shown = F.coalesce(day.cast("string"), F.col("_c.shown"))
    or_none = lambda c: F.when(text.blank(c) == "", "N/A").otherwise(c)
    url = F.when(F.col("_c.url").startswith("/"), F.concat(F.lit(s.board_base), F.col("_c.url"))).otherwise(F.col("_c.url"))
    good = (F.col("_c.title") != "") & ~F.col("_c.url").isin("", "N/A") & ~filters.excluded_company(F.col("_c.company"), s)
    return each.where(good & dates.is_recent(F.col("_c.stamp"), s.today, s.max_days_old)).select(
        *kept, "card", F.col("_c.title").alias("title"), or_none(F.col("_c.company")).alias("company"), F.lit("N/A").alias("location"),
        or_none(shown).alias("published_date"), F.col("_c.snippet").alias("snippet"), url.alias("url"), F.lit("board").alias("source_site"),
        F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("source"),
    )

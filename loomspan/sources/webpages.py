"""Events listed on web pages: nested lists to flat rows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

from loomspan.functions.dates import free_text_range

_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}


class _Tree(HTMLParser):
    """A tree of [tag, attributes, children], where children are texts and trees."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root: list = ["", {}, []]
        self.open = [self.root]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag == "li" and self.open[-1][0] == "li":
            self.open.pop()
        node = [tag, dict(attrs), []]
        self.open[-1][2].append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1][2].append([tag, dict(attrs), []])

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1][2].append(data)


def _walk(node, skip=()):
    """Trees below a node in order; not inside tags of ``skip``."""
    for x in node[2]:
        if isinstance(x, list):
            yield x
            if x[0] not in skip:
                yield from _walk(x, skip)


def _text(node, skip=(), line_breaks: bool = False) -> str:
    out = []
    for x in node[2]:
        if isinstance(x, str):
            out.append(x)
        elif x[0] == "br" and line_breaks:
            out.append("\n")
        elif x[0] not in skip:
            out.append(_text(x, skip, line_breaks))
    return "".join(out)


def _links(node, skip=()) -> dict[str, str]:
    return {_text(a).strip(): a[1]["href"] for a in _walk(node, skip) if a[0] == "a" and a[1].get("href")}


def _flat(item, category, date, above: list) -> Iterator[dict]:
    inner = [x for x in _walk(item, skip=("li",)) if x[0] == "li"]
    if inner:
        # The item is a heading: its own text and links go to all that is listed below it.
        head = (_text(item, skip=("li",)).strip(), _links(item, skip=("li",)))
        for x in inner:
            yield from _flat(x, category, date, [head, *above])
        return
    own = _links(item)
    sections = {k: v for _, links in above for k, v in links.items()}
    yield {"text": _text(item).strip(), "urls": {**own, **sections}, "section": [t for t, _ in above], "category": category, "date": date, "text_urls": own, "section_urls": sections}


def events_of(html: str | None) -> list[dict]:
    """The events of a page: text, links, the headings above it from the nearest on, category and day."""
    out = []
    tree = _Tree(html or "").root
    for box in (x for x in _walk(tree) if x[0] in ("table", "div") and "vevent" in (x[1].get("class") or "").split()):
        title = next((_text(x) for x in _walk(box) if x[0] == "span" and "summary" in (x[1].get("class") or "").split()), "")
        m = re.search(r"\((\d{4}-\d{2}-\d{2})\)", title)
        if not m:
            continue
        category = None
        for x in _walk(box, skip=("li",)):
            if x[0] == "dl" or (x[0] == "div" and x[1].get("role") == "heading"):
                category = _text(x, skip=("li",)).strip()
            elif x[0] == "li":
                out += _flat(x, category, m[1], [])
    return out


def infobox_date_text(html: str | None) -> str | None:
    """Text of the date row of a page's info box, lines kept."""
    for box in (x for x in _walk(_Tree(html or "").root) if x[0] == "table" and "infobox" in (x[1].get("class") or "").split()):
        for row in (x for x in _walk(box) if x[0] == "tr"):
            cells = [x for x in _walk(row) if x[0] in ("th", "td")]
            if len(cells) == 2 and _text(cells[0]).strip().lower() == "date":
                return _text(cells[1], skip=("sup",), line_breaks=True)
    return None


EVENT = "text string, urls map<string,string>, section array<string>, category string, date string, text_urls map<string,string>, section_urls map<string,string>"


def events(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, event fields ...): one row per event of each page; pages without events give none."""
    kind = pages.schema[key].dataType.simpleString()

    def flat(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{key: k, **e} for k, h in zip(b[key], b[html]) for e in events_of(h)]
            yield pd.DataFrame(rows, columns=[key, "text", "urls", "section", "category", "date", "text_urls", "section_urls"])

    return pages.select(key, html).mapInPandas(flat, f"`{key}` {kind}, {EVENT}")


def section_dates(events_df: DataFrame, wiki: DataFrame, key: str) -> DataFrame:
    """(key, text, section, first, last): the dates of the pages that an event's headings link to.

    ``wiki`` has url and html; each linked page is parsed once.
    """
    from pyspark.sql import functions as F

    links = events_df.select(key, "text", "date", F.explode("section_urls").alias("section", "url"))
    need = wiki.select("url", "html").join(links.select("url").distinct(), "url", "left_semi")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"url": b.url, "when": [infobox_date_text(h) for h in b.html]})

    dates = need.mapInPandas(parse, "url string, when string").where("when is not null")
    days = free_text_range(F.col("when"), F.col("date"))
    found = links.join(dates, "url").select(key, "text", "section", days.alias("days")).where("days is not null")
    return found.select(key, "text", "section", F.col("days")[0].alias("first"), F.col("days")[1].alias("last"))

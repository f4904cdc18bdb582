"""Web pages to readable text, and listings to links.

A page becomes a tree of elements; the text is what is left of the wanted branch after branches that are never shown are cut off, with
line breaks around blocks. Defined results: null gives null; a page without the container is read whole; unclosed and unopened tags do no harm.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Elements that are never shown, elements that stand on lines of their own, and elements without content.
HIDDEN = frozenset("script style noscript nav header footer s strike del".split())
BLOCKS = frozenset("p div li tr td th h1 h2 h3 h4".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())

TOKEN = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-z][\w:-]*)(?P<rest>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>")
ATTRIBUTE = re.compile(r"(?is)([\w:-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
STRUCK = re.compile(r"(?is)text-decoration(?:-line)?\s*:[^;]*line-through")


@dataclass
class Element:
    tag: str = ""
    attributes: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)
    parent: Element | None = None

    def shown(self) -> bool:
        return self.tag not in HIDDEN and not STRUCK.search(self.attributes.get("style", ""))


def tree_of(page: str) -> Element:
    root = here = Element()
    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            here.children.append(html.unescape(page[at : m.start()]))
        at = m.end()
        tag = (m["tag"] or "").lower()
        if tag and m["end"]:
            owner = here
            while owner is not root and owner.tag != tag:
                owner = owner.parent
            here = owner.parent if owner is not root else here  # an end without a beginning is passed over
        elif tag:
            new = Element(tag, {k.lower(): html.unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(m["rest"])}, [], here)
            here.children.append(new)
            if tag not in EMPTY and not m["rest"].endswith("/"):
                here = new
    here.children.append(html.unescape(page[at:]))
    return root


def _pieces(branch: Element) -> Iterator[str]:
    """Texts and line breaks in reading order; no recursion, as pages nest without bound."""
    waiting: list = [branch]
    while waiting:
        x = waiting.pop()
        if isinstance(x, str):
            yield x
        elif x.shown():
            block = x.tag in BLOCKS
            waiting += (["\n"] if block else []) + x.children[::-1]
            if block or x.tag == "br":
                yield "\n"


def _branch(root: Element, name: str) -> Element | None:
    waiting = [root]
    while waiting:
        x = waiting.pop()
        if x.attributes.get("id", "").lower() == name:
            return x
        waiting += [c for c in reversed(x.children) if isinstance(c, Element)]
    return None


def html_text(page: str | None, container: str = "content") -> str | None:
    """Readable text of a page: of its container if it has one, else of all; without navigation, scripts and struck-out wording."""
    if page is None:
        return None
    root = tree_of(page)
    lines = "".join(_pieces(_branch(root, container.lower()) or root)).split("\n")
    return "\n".join(x for line in lines if (x := " ".join(line.split())))


def pages_to_text(pages: DataFrame, key: str, page: str, container: str = "content") -> DataFrame:
    """key, text. ``container``: the id of the element that holds the content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "text": [html_text(h, container) for h in b[page]]})

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, page).mapInPandas(run, f"{key} {kind}, text string")


def listed_links(pages: DataFrame, key: str, page: str, base: str, words: list[str] | None = None) -> DataFrame:
    """key, url, title, place: the links of listing pages, absolute by the column ``base``; of a repeated address the last title, at the first place.

    ``words``: only titles with one of them. Links without title, fragments and scripts are none.
    """
    anchors = F.regexp_extract_all(page, F.lit(r"(?is)<a\b[^>]*\bhref\s*=\s*[\"'][^\"']+[\"'][^>]*>.*?</a\s*>"), F.lit(0))
    rows = pages.select(key, F.col(base).alias("base"), F.posexplode(anchors).alias("place", "a"))
    href = F.regexp_extract("a", r"(?is)\bhref\s*=\s*[\"']([^\"']+)[\"']", 1)
    title = F.trim(F.regexp_replace(F.regexp_replace("a", r"(?s)<[^>]*>", " "), r"\s+", " "))
    origin = F.regexp_extract("base", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract("base", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    absolute = F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(F.startswith(href, F.lit("/")), F.concat(origin, href)).otherwise(F.concat(F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(folder, F.lit("/"))), href))
    rows = rows.select(key, "place", F.when(~F.startswith(href, F.lit("#")) & ~href.rlike("(?i)^(?:javascript|mailto):"), absolute).alias("url"), title.alias("title")).filter("url is not null and title <> ''")
    if words:
        rows = rows.filter(F.lower("title").rlike("|".join(words)))
    once = rows.groupBy(key, "url").agg(F.max_by("title", "place").alias("title"), F.min("place").alias("first"))
    return once.select(key, "url", "title", (F.row_number().over(Window.partitionBy(key).orderBy("first")) - 1).alias("place"))


def media_type(header: Column, url: Column) -> Column:
    """pdf, html or text by the delivered header, else by the address's ending, else pdf."""
    known = lambda c: F.when(c.rlike("(?i)pdf"), "pdf").when(c.rlike("(?i)html?"), "html").when(c.rlike("(?i)text|txt|md"), "text")
    ending = F.regexp_extract(F.regexp_replace(url, "[?#].*$", ""), r"\.([A-Za-z0-9]{2,5})$", 1)
    return F.coalesce(known(header), known(ending), F.lit("pdf"))

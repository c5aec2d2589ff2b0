"""Text of web pages by their structure: a small element tree over the standard library's HTML parser.

Spark has no HTML parser, so these run as Arrow-batched UDFs; a page is bounded by its own
size. Null pages give null; pages without elements give their text or null, as stated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Parts of classes and ids of blocks that are no content, elements that never are, and selectors in order.
BLOCKS = [
    "ad", "ads", "advert", "banner", "menu", "nav", "navbar", "sidebar", "related", "recomend", "recommend", "social", "share", "comment", "newsletter", "subscribe", "popup", "modal", "footer",
    "breadcrumb", "pagination", "tags", "categories", "author-box", "widget", "promo", "cta", "mais-lidas", "leia-tambem", "leia também", "outros-links", "links-uteis", "links úteis", "footer-links",
    "menu-footer", "topo", "cookies", "cookie", "consent", "gpt-ad", "ad-slot", "adsense",
]
NO_CONTENT = "script style noscript iframe form svg canvas object embed audio video figure nav aside footer header".split()
SELECTORS = [".content-v1", ".entry-content", ".post-content", ".content", "article", "main"]
APPEALS = [r"(?i)A grande mídia esconde.*?nossa única força é você\.", r"(?i)Faça sua doação.*?ICL", r"Por \w+ \w+ e \w+ \w+", r"\(Folhapress\)"]


class Element:
    __slots__ = ("attributes", "inside", "tag")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.inside = tag, attributes, []

    def all(self) -> Iterator[Element]:
        """The element's descendants, in order."""
        stack = [x for x in reversed(self.inside) if isinstance(x, Element)]
        while stack:
            e = stack.pop()
            yield e
            stack += [x for x in reversed(e.inside) if isinstance(x, Element)]

    def pieces(self) -> Iterator[str]:
        stack: list = list(reversed(self.inside))
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                yield x
            else:
                stack += reversed(x.inside)

    def without(self, unwanted) -> None:
        """Drop the descendants that are unwanted, with all that they hold."""
        stack = [self]
        while stack:
            e = stack.pop()
            e.inside = [x for x in e.inside if isinstance(x, str) or not unwanted(x)]
            stack += [x for x in e.inside if isinstance(x, Element)]

    def first(self, wanted) -> Element | None:
        return next((e for e in self.all() if wanted(e)), None)


class _Builder(HTMLParser):
    """An end tag closes the nearest open element of its name; others are ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        e = Element(tag, {k: v or "" for k, v in attrs})
        self.open[-1].inside.append(e)
        if tag not in VOID:
            self.open.append(e)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].inside.append(Element(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        self.open[-1].inside.append(data)


def parsed(html: str) -> Element:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def stripped_length(e: Element) -> int:
    parts = [p for x in e.pieces() if (p := x.strip())]
    return sum(map(len, parts)) + max(0, len(parts) - 1)


def link_share(e: Element) -> float:
    """Share of a block's text that stands in links; a block of links without text counts as links."""
    links = [x for x in e.all() if x.tag == "a"]
    if not links:
        return 0.0
    whole = stripped_length(e)
    return sum(map(stripped_length, links)) / whole if whole else 1.0


def article_text(html: str) -> str:
    """The main text of an article: without blocks of navigation, advertising and links; article, main, the marked body or the page."""
    root = parsed(html)

    def unwanted(e: Element) -> bool:
        names = e.attributes.get("id", "").lower(), e.attributes.get("class", "").lower()
        return e.tag in NO_CONTENT or any(b in n for b in BLOCKS for n in names)

    root.without(unwanted)
    root.without(lambda e: e.tag in ("div", "section", "ul", "ol", "table") and link_share(e) > 0.5)
    for wanted in (lambda e: e.tag == "article", lambda e: e.tag == "main", lambda e: e.attributes.get("itemprop") == "articleBody", lambda e: e.tag == "body"):
        if body := root.first(wanted):
            break
    text = re.sub(r"[ \t]+| ", " ", "\n".join((body or root).pieces()))
    return re.sub(r"(?m)^[ \t]+|[ \t]+$", "", re.sub(r"\n{3,}", "\n\n", text)).strip()


def page_text(html: str, least: int = 100, most: int = 3000) -> str | None:
    """The first selector's text of more than `least` words, else all paragraphs, else the body; `most` words of it, as the rule has it."""
    root = parsed(html)
    root.without(lambda e: e.tag in ("script", "style", "nav", "footer", "header", "aside", "form", "noscript", "iframe"))
    content = ""
    for s in SELECTORS:
        e = root.first((lambda e: e.tag == "div" and s[1:] in e.attributes.get("class", "").split()) if s[0] == "." else lambda e: e.tag == s)  # noqa: B023
        if e and len((text := " ".join(e.pieces())).split()) > least:
            content = text
            break
    body = root.first(lambda e: e.tag == "body")
    if not content and body:
        paragraphs = [" ".join(e.pieces()) for e in body.all() if e.tag == "p"]
        content = " ".join(paragraphs) if paragraphs else " ".join(body.pieces())
    if not content:
        return None
    for pattern in APPEALS:
        content = re.sub(pattern, "", content)
    return " ".join(content.split()[:most])


def encyclopedia_text(html: str, least: int = 20) -> str:
    """Paragraphs, headings and list items of more than `least` characters, without edit marks and reference numbers."""
    root = parsed(html)
    root.without(lambda e: e.tag in ("style", "script", "nav", "footer", "header"))
    parts = ("".join(x.strip() for x in e.pieces()) for e in root.all() if e.tag in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6"))
    text = " ".join(p for p in parts if len(p) > least)
    return " ".join(re.sub(r"\[(?:editar|carece de fontes|nota \d+|\d+)\]", " ", text).split())


def _column(fn):
    @F.pandas_udf(StringType())
    def apply(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else fn(x))

    return apply


article_column, page_column, encyclopedia_column = _column(article_text), _column(page_text), _column(encyclopedia_text)

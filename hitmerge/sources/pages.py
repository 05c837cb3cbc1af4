"""Result pages (HTML) as rows. The only place that needs Python: an Arrow UDF that walks one page
with the standard library parser; everything after it is built-in."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitmerge.functions.columns import squeeze_white, trim_white
from hitmerge.functions.text import card_type, clean_snippet
from hitmerge.functions.urls import unwrap_redirect
from hitmerge.sources.landed import pack

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCK = {"p", "div", "ul", "ol", "li", "h1", "h2", "h3", "h4", "h5", "h6", "table", "section", "article", "form"}
_ITEMS = "array<struct<title:string,url:string,snippet:string,card:string>>"


class _Node:
    __slots__ = ("tag", "attrs", "parent", "kids")

    def __init__(self, tag, attrs=(), parent=None):
        self.tag, self.attrs, self.parent, self.kids = tag, dict(attrs), parent, []

    def has(self, cls):
        return cls in (self.attrs.get("class") or "").split()

    def walk(self):
        """All elements below, in page order; however deep they are nested."""
        todo = self.kids[::-1]
        while todo:
            k = todo.pop()
            if isinstance(k, _Node):
                yield k
                todo += k.kids[::-1]

    def text(self):
        todo, out = self.kids[::-1], []
        while todo:
            k = todo.pop()
            if isinstance(k, str):
                out.append(k)
            else:
                todo += k.kids[::-1]
        return "".join(out)

    def first(self, test):
        return next((n for n in self.walk() if test(n)), None)

    def all(self, test):
        return [n for n in self.walk() if test(n)]


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("")

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCK:
            self._leave("p", _BLOCK)
        if tag == "li":
            self._leave("li", {"ul", "ol"})
        node = _Node(tag, attrs, self.at)
        self.at.kids.append(node)
        if tag not in _VOID:
            self.at = node

    def _leave(self, tag, stop):
        """Close an element whose end tag was left out."""
        n = self.at
        while n.parent is not None and n.tag != tag and n.tag not in stop - {tag}:
            n = n.parent
        if n.tag == tag:
            self.at = n.parent

    def handle_endtag(self, tag):
        n = self.at
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.kids.append(data)


def _web(link):
    link = (link or "").strip()
    return link if link.startswith(("http://", "https://")) else ""


def _bing(root):
    for block in root.all(lambda n: n.tag == "li" and n.has("b_algo")):
        head = next((a for h in block.all(lambda n: n.tag == "h2")
                     for a in h.all(lambda n: n.tag == "a" and "href" in n.attrs)), None)
        link = _web(head.attrs["href"]) if head else ""
        if not link:
            continue
        caption = next((p for c in block.all(lambda n: n.has("b_caption"))
                        for p in c.all(lambda n: n.tag == "p")), None)
        choices = (caption, block.first(lambda n: n.has("b_snippet")), block.first(lambda n: n.tag == "p"))
        texts = [c.text() for c in choices if c is not None]
        yield head.text(), link, next((t for t in texts if t), ""), ""


def _titles(n):
    return n.all(lambda x: x.has("qk-title-text")) + ([n] if n.has("qk-title-text") else [])


def _longest_paragraph(n):
    own = [n] if n.has("qk-paragraph-text") else []
    texts = [p.text() for p in own + n.all(lambda x: x.has("qk-paragraph-text"))]
    return max(texts, key=lambda t: len(t.encode()), default="")


def _quark_snippet(anchor):
    after = anchor.parent.kids
    for sibling in after[after.index(anchor) + 1:]:
        if isinstance(sibling, _Node):
            if _titles(sibling):
                break
            if text := _longest_paragraph(sibling):
                return text
    node, depth = anchor.parent, 0
    while node is not None and depth < 8 and len(_titles(node)) <= 1:
        if text := _longest_paragraph(node):
            return text
        node, depth = node.parent, depth + 1
    return _longest_paragraph(anchor)


def _quark(root):
    for card in root.all(lambda n: n.tag == "div" and n.has("sc")):
        for a in card.all(lambda n: n.tag == "a" and n.has("qk-link-wrapper")):
            title = a.first(lambda n: n.has("qk-title-text"))
            link = _web(a.attrs.get("data-openpageurl")) or _web(a.attrs.get("href"))
            if title is not None and link:
                yield title.text(), link, _quark_snippet(a), card.attrs.get("data-sc") or ""


def page_reader(container: str, title: str, paragraph: str):
    """Reader of landed pages that are one hit each: the first ``container``, its first ``title`` and the text of all its
    ``paragraph`` elements."""
    def read(root):
        block = root.first(lambda n: n.tag == container)
        if block is not None:
            head = block.first(lambda n: n.tag == title)
            yield head.text() if head else "", "", " ".join(p.text() for p in block.all(lambda n: n.tag == paragraph)), ""
    return read


_READERS = {"bing": _bing, "quark": _quark, "page": page_reader("article", "h1", "p")}


def _extractor(engine: str):
    def extract(bodies: pd.Series) -> pd.Series:
        def one(body):
            tree = _Tree()
            tree.feed(body or "")
            tree.close()
            return [dict(zip(("title", "url", "snippet", "card"), item)) for item in _READERS[engine](tree.root)]
        return bodies.map(one)

    extract.__annotations__ = {"bodies": pd.Series, "return": pd.Series}
    return F.pandas_udf(extract, _ITEMS)


def html_rows(pages: DataFrame, engine: str) -> DataFrame:
    """pages(query_id, page, html) -> query_id, page, pos, title, url, snippet, signals, in document
    order and with nothing dropped yet; ``page_merge`` makes the engine's list of it."""
    found = pages.select("query_id", "page", F.posexplode(_extractor(engine)("html")).alias("pos", "r"))
    title = trim_white(F.col("r.title")) if engine == "bing" else squeeze_white(F.col("r.title"))
    url = unwrap_redirect(F.col("r.url")) if engine == "bing" else F.col("r.url")
    return found.select("query_id", "page", "pos", title.alias("title"), url.alias("url"),
                        clean_snippet(F.col("r.snippet")).alias("snippet"),
                        pack({"card_type": card_type(F.col("r.card"))}).alias("signals"))

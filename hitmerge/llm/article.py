"""Main text of landed pages by the distribution of text over line blocks.

The page is cut into blocks at block-level tags. What cannot be part of an article by its element or
its name (menus, scripts, forms, adverts, comments, ...) holds no text; a name does not count where it
would hide the densest text of the page. Sums of text lengths over sliding windows of blocks then show where
the text surges and where it dives, and the blocks between are the article. Where the page itself marks an
article, and the marked blocks hold the fullest window, surge and dive are sought inside the marks."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements whose content is never text of an article.
NO_TEXT = frozenset("script style noscript template svg math iframe object canvas head title select option textarea button".split())
AROUND = frozenset("nav header footer aside menu dialog".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2
h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
# Blocks that lie beside one another in one of the other, holding elements.
LINES = frozenset("p h1 h2 h3 h4 h5 h6 hgroup pre li dt dd hr blockquote figure figcaption address legend summary details".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that their own kind ends, and where that stops.
ENDS_ITSELF = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
# Names inside this many others count as part of the innermost of them.
NAMES_DEEP = 32
# Names of parts around an article, and words that go with them: a token of a class, id or role is such a name, or several
# of these joined by - or _. Any other word beside a name (has-sidebar, share-enabled) says something about an element that is none.
NAMED = re.compile(
    r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side-bar|widget\w*|footer\w*|"
    r"header|masthead|topbar|comments?|commentlist|respond|replies|reply|disqus\w*|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|"
    r"newsletter|subscribe\w*|signup|login|social\w*|share|sharing|related\w*|recommend\w*|pagination|pager|toolbar|skip-link|copyright|legal|"
    r"navigation|complementary|contentinfo|search\w*|discussion|feedback", re.I)
BESIDE = frozenset("""area bar block blocks body bottom box button buttons card cards container form group holder icons inner item items left link
links list main outer panel posts primary right row secondary section site slot text thread title top unit wrap wrapper""".split())
# Start of what is no text; the rest of a tag, where quotes count only behind an equals sign; its attributes.
MARKUP = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])))*+>""")
ATTRIBUTE = re.compile(r"""([^\s=/]+)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|(\S+)))?""")
COMMENT_END = re.compile("--!?>")
# Elements whose content is no markup, and where each ends.
RAW = {t: re.compile(f"</{t}(?=[\\s/>])", re.I) for t in "script style textarea title noscript iframe noembed noframes xmp".split()}
SPACE = re.compile(r"\s+")


def _named(value: str) -> bool:
    for token in value.split():
        parts = [x for x in re.split("[-_]+", token) if x and not x.isdigit()]
        names = [bool(NAMED.fullmatch(x)) for x in parts]
        if NAMED.fullmatch(token) or any(names) and all(n or x.lower() in BESIDE for n, x in zip(names, parts, strict=True)):
            return True
    return False


def _aside(tag: str, attributes: str, marked: bool) -> tuple[bool, bool]:
    """Whether an element holds no text, and whether only its name (or being a form, which may wrap a page) says so.
    The header of a marked article is its headline, not that of the page."""
    if tag in NO_TEXT or tag in AROUND and not (tag == "header" and marked):
        return True, False
    named = tag == "form"
    if not attributes.strip() or tag in ("html", "body"):
        return named, named
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden" and not value.lower() == "until-found" or name == "aria-hidden" and value.lower() == "true":
            return True, False
        named = named or name in ("class", "id", "role") and _named(value)
    return named, named


def pieces(body: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) of a page in page order; the kinds are ``text`` (with references), ``plain``, ``start`` and ``end``.

    One pass: comments, character data, raw elements and tags each end before the next begins, so markup inside
    one of them is none. A comment, raw element or tag that the page never ends goes on to its end, as in
    browsers, but a quote that is never closed is no quote."""
    at, shown, quotes, final = 0, 0, True, body.rfind(">")
    while (m := MARKUP.search(body, at)) is not None:
        comment, data, other, slash, tag = m.groups()
        if m.start() > shown:
            yield "text", body[shown:m.start()], ""
        if comment:
            # The dashes that open it may close it as well.
            end = COMMENT_END.search(body, m.end() - 2)
            at = end.end() if end else len(body)
        elif data and (end := body.find("]]>", m.end())) >= 0:
            yield "plain", body[m.end():end], ""
            at = end + 3
        elif data or other:
            at = body.find(">", m.end()) + 1 or len(body)
        else:
            if m.end() > final:
                return
            end = REST.match(body, m.end()) if quotes else None
            if end is None:
                # From here a quote stays open to the end of the page; no later tag looks for its end again.
                quotes = False
                at = body.index(">", m.end()) + 1
            else:
                at = end.end()
            tag = tag.lower()
            yield "end" if slash else "start", tag, body[m.end():at - 1]
            if tag in RAW and not slash:
                end = RAW[tag].search(body, at)
                at = end.start() if end else len(body)
        shown = at
    if shown < len(body):
        yield "text", body[shown:], ""


def blocks(body: str) -> tuple[list[tuple[str, int, int, int, int]], list[int]]:
    """(text, outermost article mark, characters of links, innermost named element, holding element) of each block of a page,
    in page order, and for each named element the next one around it; -1: none."""
    out: list[tuple[str, int, int, int, int]] = []
    around: list[int] = []
    text: list[str] = []
    open_: list[tuple[str, bool, bool, bool, int]] = []     # tag, hides its text, marks the article, hides it by name, holder around
    places: dict[str, list[int]] = defaultdict(list)        # where in open_ each tag is open
    standing: list[int] = []                                # where in open_ the blocks are
    hidden = marked = links = linked = marks_seen = holder = holders = deep = 0
    name = -1

    def flush():
        nonlocal links
        line = SPACE.sub(" ", unescape("".join(text))).strip()
        if line:
            out.append((line, marks_seen if marked else -1, links, name, holder))
        text.clear()
        links = 0

    def close(upto: int):
        nonlocal hidden, marked, linked, name, holder, deep
        while len(open_) > upto:
            tag, hides, marks, names, before = open_[-1]
            if tag in BLOCK or names:
                flush()
            open_.pop()
            places[tag].pop()
            if tag in BLOCK:
                standing.pop()
            hidden, marked, linked, holder = hidden - hides, marked - marks, linked - (tag == "a"), before
            if names:
                name, deep = around[name], deep - 1

    def say(piece: str):
        nonlocal links
        if piece and not hidden:
            text.append(piece)
            if linked:
                links += len(piece.strip())

    for kind, tag, attributes in pieces(body):
        if kind == "text":
            say(tag)
        elif kind == "plain":
            say(tag.replace("&", "&amp;"))
        elif tag == "br":
            say(" ")
        elif kind == "end":
            if places[tag]:
                close(places[tag][-1])
            elif tag in BLOCK:
                flush()
        else:
            if tag in BLOCK or tag == "body":
                if places["head"]:
                    close(places["head"][0])        # a head need not be closed
                flush()
            for own, enders in ENDS_ITSELF.items():
                # A paragraph or item that was not closed ends here, unless a container stands between.
                if tag in enders and standing and open_[standing[-1]][0] == own:
                    close(standing[-1])
            if tag in RAW:
                say(" ")
            if tag in VOID or attributes.rstrip().endswith("/") and tag not in BLOCK and tag not in RAW:
                continue
            aside, names = _aside(tag, attributes, marked > 0)
            hides, marks, names = aside and not names, tag in ("article", "main") and not aside, names and deep < NAMES_DEEP
            places[tag].append(len(open_))
            if tag in BLOCK:
                standing.append(len(open_))
            open_.append((tag, hides, marks, names, holder))
            if names:
                flush()
                around.append(name)
                name, deep = len(around) - 1, deep + 1
            if (tag in BLOCK or tag == "body") and tag not in LINES:
                holders += 1
                holder = holders
            marks_seen += marks and not marked
            hidden, marked, linked = hidden + hides, marked + marks, linked + (tag == "a")
    close(0)
    flush()
    return out, around


def _fullest(own: np.ndarray, window: int) -> np.ndarray:
    return np.convolve(own, np.ones(window, np.int64))[(window - 1) // 2:][:own.size]


def _visible(found: list, around: list[int], own: np.ndarray, window: int) -> np.ndarray:
    """Blocks that no name hides. A name does not count where it hides the fullest window (of the marked blocks, if
    there are any) and the page has no window half as full without it."""
    name = np.array([b[3] for b in found])
    mark = np.array([b[1] >= 0 for b in found])
    asked = own * mark if (own * mark).any() else own
    shown: set[int] = set()
    while True:
        top: list[int] = []                             # outermost element that hides the blocks of each
        for n, outer in enumerate(around):
            above = top[outer] if outer >= 0 else -1
            top.append(above if above >= 0 else -1 if n in shown else n)
        hider = np.array([*top, -1])[name]
        seen = hider < 0
        if seen.all():
            return seen
        # The blocks of an element stand together.
        cut = np.flatnonzero(np.diff(hider)) + 1
        most, best = max((int(_fullest(asked[x], window).max()), int(hider[x[0]])) for x in np.split(np.arange(own.size), cut) if hider[x[0]] >= 0)
        if most <= 2 * _fullest(own * seen, window).max():
            return seen
        shown.add(best)


def article(body: str | None, window: int = 3, surge: int = 80) -> list[str]:
    """Blocks of the article, between the first surge and the last dive of text.

    Each window sums the text of ``window`` blocks, without links. Text surges where a window reaches
    ``surge`` characters, or half of the fullest window if that is less, and dives where it falls below. If the
    blocks that the page marks as article hold the fullest window, each mark with a surge is an article from its
    first to its last block: headline, short lines and all, but for lists of links before the surge and after the dive."""
    found, around = blocks(body) if body else ([], [])
    if not found:
        return []
    own = np.array([len(t) - min(links, len(t)) for t, _, links, *_ in found])
    seen = _visible(found, around, own, window)
    found, own = [b for b, s in zip(found, seen, strict=True) if s], own[seen]
    if not found:
        return []
    mark = np.array([b[1] for b in found])
    inside = mark >= 0
    most = _fullest(own * inside, window).max()
    if inside.any() and most >= _fullest(own * ~inside, window).max():
        out: list[str] = []
        for m in np.unique(mark[inside]):
            at = np.flatnonzero(mark == m)
            ends = _between(own[at], window, min(surge, most / 2))
            if ends is None and most:
                continue
            first, last = ends or (0, at.size - 1)
            link = own[at] == 0
            # A link on its own may be a line of the article, several are a list.
            several = link & (np.append(link[1:], False) | np.append(False, link[:-1]))
            out += [found[i][0] for k, i in enumerate(at) if first <= k <= last or not several[k]]
        return out
    # Marks beside fuller text are teasers or the like: none of them is where the text begins or ends.
    own = own * ~inside
    ends = _between(own, window, min(surge, _fullest(own, window).max() / 2), np.array([b[4] for b in found]))
    return [b[0] for b in found[ends[0]:ends[1] + 1]] if ends else []


def _between(own: np.ndarray, window: int, level: float, holder: np.ndarray | None = None) -> tuple[int, int] | None:
    """First and last block between surge and dive, if there is text. With ``holder`` also the blocks beside them
    that fill a window, and the short ones before and after that lie in the same element as the surge or the dive."""
    total = _fullest(own, window)
    dense = np.flatnonzero((total >= level) & (own > 0))
    if dense.size == 0:
        return None
    # The surge and the dive lie at blocks, not at the windows around them that they fill.
    heavy = dense[own[dense] >= min(level / window, own.max() / 2)]
    first, last = (heavy[0], heavy[-1]) if heavy.size else (dense[0], dense[-1])
    if holder is not None:
        goes_on = lambda at, edge: own[at] > 0 and (total[at] >= level or holder[at] == edge)
        edges = holder[first], holder[last]
        while first > 0 and goes_on(first - 1, edges[0]):
            first -= 1
        while last + 1 < own.size and goes_on(last + 1, edges[1]):
            last += 1
    return int(first), int(last)


def main_text(pages: DataFrame, window: int = 3, surge: int = 80) -> DataFrame:
    """Main text of every landed page.

    :param pages: ``page_id``, ``url``, ``body`` (the whole HTML); other columns are not read, whatever their names
    :param window: blocks of a sliding window
    :param surge: characters at which a window is text
    :return: one row per row of ``pages`` with ``page_id``, ``url``, ``blocks`` (array) and ``snippet`` (the blocks,
        joined by an empty line). White space inside a block is one space and character references are
        decoded. A null or empty body, and a page without text, has no block and the empty snippet; any
        column may be null and rows may repeat. Time grows with the length of a page, also of a broken one; a tag that is cut
        off by the end of the page is no text.
    """
    def run(batches):
        for b in batches:
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "blocks": [article(x, window, surge) for x in b["body"]]})

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "body")
    return rows.mapInPandas(run, "page_id long, url string, blocks array<string>") \
        .withColumn("snippet", F.concat_ws("\n\n", "blocks"))

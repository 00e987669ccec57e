"""Main text of web pages by line-block distribution."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.arrowtext import chunks
from surveyloom.llm.common import whole_text

# Lines summed at each place of the distribution.
WINDOW = 3
# Characters in a window from which on the text surges; half of the fullest window on pages that have less.
SURGE = 40
# Longest notice of rights at the end of a page.
NOTICE = 120

# Elements whose content is never text of a page.
_OUT = {"script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "head", "title", "textarea",
        "math", "audio", "video", "map"}
# Elements, and words in class, id and role, of what stands around an article.
_AROUND = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "header"}
_AROUND_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "alert", "banner", "breadcrumb", "breadcrumbs",
    "captcha", "comment", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "disclaimer",
    "disqus", "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation",
    "newsletter", "notice", "notices", "notification", "overlay", "pager", "pagination", "popup", "promo", "promotion",
    "recommended", "related", "replies", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social",
    "sponsor", "sponsored", "subscribe", "teaser", "toolbar", "topbar", "widget", "widgets"}
# Words that say nothing of the content, beside one of those above in a name such as site-header.
_NEUTRAL = {
    "area", "bar", "block", "bottom", "box", "container", "fixed", "form", "global", "group", "inner", "item", "items", "left",
    "link", "links", "list", "outer", "page", "panel", "posts", "articles", "primary", "right", "secondary", "section", "site",
    "slot", "stories", "sticky", "top", "unit", "wrap", "wrapper"}
_ARTICLE = {"article", "main"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div",
    "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header",
    "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_TABLE = {"caption", "colgroup", "thead", "tbody", "tfoot", "tr", "td", "th"}
# Elements whose end tag may be left out, the start tags that imply it, and the elements it is not sought beyond.
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option", "optgroup"}, {"select"}), "optgroup": ({"optgroup"}, {"select"}),
    "td": (_TABLE, {"table"}), "th": (_TABLE, {"table"}), "tr": (_TABLE - {"td", "th"}, {"table"}),
    "p": (_BLOCK - {"option", "optgroup", "legend", "summary"}, {"button", "object", "table", "td", "th", "caption"}),
    **{x: ({"thead", "tbody", "tfoot"}, {"table"}) for x in ("thead", "tbody", "tfoot")}}
_ENDED_BY = {start: {x for x, (starts, _) in _IMPLIED.items() if start in starts}
             for start in set().union(*(starts for starts, _ in _IMPLIED.values()))}
_RIGHTS = re.compile(r"^\s*(?:©|\(c\)\s|copyright\s*(?:©|\(c\)|\d{4}|by\b))", re.IGNORECASE)

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|"""
                     r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>""",
                     re.DOTALL)
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in
            ("script", "style", "noscript", "template", "textarea", "title", "iframe")}
_HINTS = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_PARTS = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$|/)|display\s*:\s*none""", re.IGNORECASE)


@dataclass
class Line:
    """A block of text: how much of it is not links, the article it is in, and what it stands around the article by."""

    text: str
    weight: int
    inside: int
    around: bool
    hint: int    # place of the element whose class, id or role puts the line around; -1 if it is there by itself


def _hinted(attributes: str) -> bool:
    """Whether a name in class, id or role is that of something around, such as sidebar or site-header, but not share-price."""
    for m in _HINTS.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            parts = _PARTS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
            if not _AROUND_WORDS.isdisjoint(parts) and all(x in _AROUND_WORDS or x in _NEUTRAL for x in parts):
                return True
    return False


def lines_of(page: str, ignored: frozenset[int] = frozenset()) -> list[Line]:
    """The blocks of a page as lines, without markup, scripts and styles; names of the ``ignored`` elements say nothing."""
    lines: list[Line] = []
    parts: list[tuple[str, bool]] = []
    opened: list[str] = []       # open elements
    held: Counter[str] = Counter()
    around = 0                   # how many are open with the outermost one that stands around the article, if one does
    article: list[int] = []      # numbers of the open article elements
    articles, links, at, end, hint = 0, 0, 0, len(page), -1

    def close(length: int) -> None:
        nonlocal around
        held.subtract(opened[length:])
        del opened[length:]
        if around > length:
            around = 0

    def imply(name: str) -> None:
        """End the elements whose end tag the start of ``name`` lets one leave out."""
        ended = _ENDED_BY.get(name, ())
        for x in ("p", "td", "th", "tr", "thead", "tbody", "tfoot", "li", "dt", "dd", "option", "optgroup"):
            if x in ended and held[x]:
                for i in range(len(opened) - 1, -1, -1):
                    if opened[i] == x:
                        close(i)
                        break
                    if opened[i] in _IMPLIED[x][1]:
                        break

    def flush() -> None:
        text = " ".join(html.unescape("".join(p for p, _ in parts)).split())
        if text:
            own = "".join(p for p, linked in parts if not linked)
            weight = 0 if around else len(" ".join(html.unescape(own).split()))
            lines.append(Line(text, weight, article[0] if article else 0, bool(around), hint if around else -1))
        parts.clear()

    while at < end:
        m = _MARKUP.search(page, at)
        if m is None:
            parts.append((page[at:], links > 0))
            break
        if m.start() > at:
            parts.append((page[at:m.start()], links > 0))
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in _RAW_END and not closing and not attributes.endswith("/"):
            over = _RAW_END[name].search(page, at)
            # A raw element that is never closed holds the rest of the page.
            at = over.end() if over else end
            continue
        if name in _BLOCK or name in ("head",):
            flush()
        elif name == "br":
            parts.append((" ", links > 0))
        if name == "a":
            links = max(links + (-1 if closing else 1), 0)
        elif name in _BLOCK and not around:
            links = 0
        if closing:
            if name in _ARTICLE and article and not around:
                article.pop()
            # The end of an element ends all in it; that of a phrase does not end blocks, that of a list's item not the list's.
            stop = _IMPLIED[name][1] if name in _IMPLIED else {"table"} if name not in ("body", "html", "table") else set()
            for i in range(len(opened) - 1, -1, -1) if held[name] else ():
                if opened[i] == name:
                    was = around
                    close(i)
                    # An article that holds an unclosed element around it ends with it.
                    if was and not around and name in _ARTICLE and article and i + 1 < was:
                        article.pop()
                    break
                if opened[i] in stop or (name not in _BLOCK and name not in _OUT and opened[i] in _BLOCK):
                    break
            continue
        if name in _BLOCK:
            imply(name)
        if name in _VOID or attributes.endswith("/"):
            continue
        named = bool(attributes) and m.start() not in ignored and _hinted(attributes)
        if name in ("body", *_ARTICLE) and not named:
            # These end whatever before them was left open, but not an element they lie in by a hint.
            if name == "body" or (around and opened[around - 1] in ("head", "header", "nav")):
                around = 0
        opened.append(name)
        held[name] += 1
        if around:
            continue
        if name in _OUT or (name in _AROUND and not (name == "header" and article)) or (
                name not in ("body", "html") and attributes and _HIDDEN.search(attributes)):
            around, hint = len(opened), -1
        elif named and name not in ("body", "html"):
            around, hint = len(opened), m.start()
        elif name in _ARTICLE:
            articles += 1
            article.append(articles)
    flush()
    return lines


def _settled_lines(page: str) -> list[Line]:
    """The lines of a page; a name never puts the element around that holds most of the text."""
    ignored: frozenset[int] = frozenset()
    while True:
        lines = lines_of(page, ignored)
        total, held = 0, Counter()
        for x in lines:
            total += len(x.text)
            if x.hint >= 0:
                held[x.hint] += len(x.text)
        most = max(held, key=held.get, default=-1)
        if most < 0 or 2 * held[most] <= total:
            return lines
        ignored |= {most}


def _weights(lines: list[Line]) -> list[int]:
    """What each line counts for: its characters outside links, or, where an article is marked, all of those in it and none outside.

    A marked article counts if it holds half of the text outside links, or if there is no such text.
    """
    total, held, full = sum(x.weight for x in lines), Counter(), Counter()
    for x in lines:
        if x.inside and not x.around:
            held[x.inside] += x.weight
            full[x.inside] += len(x.text)
    if full and 2 * sum(held.values()) >= total:
        marked = {k for k in full if held[k] or not total}
        return [len(x.text) if x.inside in marked and not x.around else 0 for x in lines]
    weights = [x.weight for x in lines]
    for i in reversed(range(len(lines))):  # a notice of rights at the very end
        if not lines[i].around:
            if not lines[i].inside and len(lines[i].text) <= NOTICE and _RIGHTS.match(lines[i].text) and sum(weights) > weights[i]:
                weights[i] = 0
            break
    return weights


def main_text(page: str, window: int = WINDOW) -> str:
    """The lines between the surges and the dives of the page's text, joined by line feeds.

    Every line weighs its characters outside links; lines of menus, footers and
    the like weigh nothing, and where an element is marked as the article only
    lines in it do, links and all.  The weights are summed over sliding windows of
    lines.  Text surges at the first window of ``SURGE`` characters (half of the
    fullest window on pages with less), with the lines that lead to it without a
    gap, and dives where one is empty; all lines between are kept but those that
    stand around.
    """
    lines = _settled_lines(page)
    weights = _weights(lines)
    sums = [sum(weights[i:i + window]) for i in range(len(lines))]
    surge = min(SURGE, (max(sums, default=0) + 1) // 2)
    in_article = any(w and lines[i].inside for i, w in enumerate(weights))
    kept, inside = [], False
    for i, total in enumerate(sums):
        if not inside and weights[i] and (total >= surge or in_article):
            inside, start = True, i
            while start and weights[start - 1]:  # short lines that lead to it
                start -= 1
            kept.append([(j, lines[j].text) for j in range(start, i)])
        elif inside and not total:
            inside = False
        if inside and not lines[i].around:
            kept[-1].append((i, lines[i].text))
    # Lines without weight at the dive belong to what follows.
    texts = []
    for stretch in kept:
        last = max((i for i, _ in stretch if weights[i]), default=-1)
        texts += [text for i, text in stretch if i <= last]
    return "\n".join(texts)


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars.

    Null, empty and markup-only pages have empty text; unclosed and wrongly
    nested elements are read as far as they go; an element ends with its parent.  Rows are independent, so
    repeated rows and ids give a row each.  Other columns are not read.
    """
    rows = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"), whole_text(html_column).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            texts = [main_text(page) for page in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    kind, address = (pages.schema[c].dataType.simpleString() for c in (id_column, url_column))
    return rows.mapInArrow(work, f"id {kind}, url {address}, text string, n_chars long")

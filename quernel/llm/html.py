"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped to lines: one for each block of text, and a blank one for each boundary of a container. Lines inside menus,
headers, footers, sidebars, notices, adverts, forms and reader comments are left out, as told by element names and by whole
words of class, id and role, so that a box in mid-article doesn't part it. A line weighs as many letters as it has outside
links. The weights are summed over a sliding window of lines, on every page alike: the text surges where the sums rise from
nothing and pass the threshold before they fall, and dives where they fall to nothing again; kept is all text between
a surge and its dive, every such stretch of the page. Where no stretch passes the threshold, the heaviest one is kept.

<article> and <main> are weights and blank lines only: their borders are as many blank lines as a window has, there are none
inside an <article>, whose links weigh too, and where they hold at least half of a page's text, other lines weigh a quarter.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows

#: Fixed lists: elements whose text is never part of the article, elements that end a block, those of them whose borders are
#: blank lines, and void elements.
BARE = {"script", "style", "noscript", "template", "svg", "iframe", "object", "head", "title", "select", "textarea", "button", "canvas", "math", "audio", "video"}
OUTSIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset"}
BLOCKS = set("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = set("div section ul ol dl table details figure center hr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
WORDS = set("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr masthead menu nav navbar navigation newsletter notice pagination pager popup modal promo promoted promotion related recommended remark respond reply replies replylist share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split())
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar"}

_NAME = re.compile(r"/?([a-zA-Z][^\s/>\0]*+)")
#: The rest of a tag: quotes hold a ">" in the value of an attribute only.
_REST = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>")
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]++))?", re.I)
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "noscript", "template", "textarea", "title", "iframe")}
_LONG_NUMBER = re.compile(r"&#[xX]?[0-9a-fA-F]{7,}")
_CLOSES_P = BLOCKS - {"br"}
_MARKS = ("article", "main")
#: Blank lines at the borders of <article> and <main>: more than any window has lines.
_BORDER = 1 << 20


def outside(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element holds no article text."""
    if tag in BARE or (tag in OUTSIDE and not (tag == "header" and in_article)):
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in ROLES):
            return True
        if name in ("class", "id") and WORDS & set(re.split(r"[^a-z]+", value)):
            return True
    return False


def tags_of(page: str):  # noqa: ANN201
    """Text before each tag, the tag's name in lower case ("" at the end of the page), whether it closes, and its attributes.

    One pass: comments, declarations and the contents of raw elements are skipped, character data of CDATA is text. Once the
    end of a tag can't be found with regard to quotes, tags end at the next ">"; what has none is text.
    """
    at, text, n = 0, [], len(page)
    quotes = cdata = ends = True
    while (lt := page.find("<", at)) >= 0:
        text.append(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = end + 3 if end >= 0 else n
            continue
        if cdata and page.startswith("<![CDATA[", lt):
            end = page.find("]]>", lt)
            if cdata := end >= 0:
                text.append(page[lt + 9 : end])
                at = end + 3
                continue
        name = _NAME.match(page, lt + 1)
        if not name:
            end = page.find(">", lt) if ends and page[lt + 1 : lt + 2] in ("!", "?") else lt
            ends = end >= 0
            if end <= lt:
                text.append("<")
            at = max(lt, end) + 1
            continue
        rest = _REST.match(page, name.end()) if quotes else None
        quotes = rest is not None
        end = rest.end() if rest else page.find(">", name.end()) + 1
        if not end:
            text.append(page[lt:])
            at = n
            break
        tag, slash, attributes, at = name[1].lower(), page[lt + 1] == "/", page[name.end() : end - 1], end
        if not slash and tag in _RAW:
            close = _RAW[tag].search(page, at)
            at = (page.find(">", close.end()) + 1 if close else 0) or n
            continue
        yield "".join(text), tag, slash, attributes
        text = []
    yield "".join([*text, page[at:]]), "", False, ""


def unescaped(text: str) -> str:
    """Character references decoded; numbers beyond all characters become U+FFFD."""
    if _LONG_NUMBER.search(text):
        text = re.sub(r"&#([xX]?)0++(?=[0-9a-fA-F])", r"&#\1", text)
        text = re.sub(r"&#(?:[xX][0-9a-fA-F]{7,}+|[0-9]{8,}+);?", "�", text)
    return entities.unescape(text)


def lines_of(page: str) -> tuple[list[str], list[int], list[int], list[bool]]:
    """The blocks of text that may belong to the article: text, letters that weigh, blank lines before, and whether each lies in
    <article> or <main>."""
    lines, letters, blanks, inner = [], [], [], []
    stack: list[tuple[str, bool]] = []  # open elements, and whether each holds no article text
    opened: dict[str, int] = {}
    held: list[str] = []
    linked = out = marked = gap = 0

    def end() -> None:
        nonlocal gap, linked
        if held:
            if not out and (text := " ".join(unescaped("".join(held)).split())):
                lines.append(text)
                letters.append(len(text) if opened.get("article") else max(0, len(text) - linked))
                blanks.append(gap)
                inner.append(marked > 0)
                gap = 0
            held.clear()
        linked = 0

    def border(tag: str) -> None:
        nonlocal gap
        if tag in _MARKS:
            gap += _BORDER
        elif tag in CONTAINERS and not out and not opened.get("article"):
            gap += 1

    def pop() -> None:
        nonlocal out, marked
        tag, flag = stack.pop()
        if flag or tag in _MARKS:
            end()
        out -= flag
        marked -= tag in _MARKS
        opened[tag] -= 1
        border(tag)

    for text, tag, slash, attributes in tags_of(page):
        if text:
            held.append(text)
            if opened.get("a"):
                linked += len(text)
        if tag in BLOCKS:
            end()
        if slash:
            if opened.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if not tag or tag in VOID or (attributes.rstrip().endswith("/") and tag not in BLOCKS):
            if tag == "hr":
                border(tag)
            continue
        if stack and ((tag in _CLOSES_P and stack[-1][0] == "p") or (tag in ("li", "dd", "dt", "td", "th", "tr", "option") and stack[-1][0] == tag)):
            pop()
        flag = outside(tag, attributes, opened.get("article", 0) > 0)
        if flag or tag in _MARKS:
            end()
        border(tag)
        stack.append((tag, flag))
        opened[tag] = opened.get(tag, 0) + 1
        out += flag
        marked += tag in _MARKS
    end()
    return lines, letters, blanks, inner


def stretches(weights: np.ndarray, window: int) -> list[tuple[int, int, float, float]]:
    """First line, line after the last, largest windowed sum and whole weight of each run of lines between a rise of the windowed
    sums from nothing and their fall to nothing. A sum is that of a line and those after it in the window."""
    total = np.concatenate([[0.0], np.cumsum(weights)])
    n = len(weights)
    sums = total[np.minimum(np.arange(n) + window, n)] - total[:-1]
    edges = np.diff(np.concatenate([[0], (sums > 0).astype(np.int8), [0]]))
    return [(a, b, float(sums[a:b].max()), float(total[b] - total[a])) for a, b in zip(np.flatnonzero(edges > 0).tolist(), np.flatnonzero(edges < 0).tolist(), strict=True)]


def main_text(page: str | None, window: int = 3, threshold: int = 86) -> str:
    """The main text; empty for null, for a page without text, and for one whose text is all outside the article."""
    if not page:
        return ""
    lines, letters, blanks, inner = lines_of(page)
    if not lines:
        return ""
    size, mark = np.array([len(x) for x in lines], np.float64), np.array(inner)
    weight = np.array(letters, np.float64) if any(letters) else size
    if 2 * size[mark].sum() >= size.sum():
        weight = np.where(mark, weight, weight / 4)
    place = np.cumsum(np.minimum(blanks, window) + 1) - 1  # of each line among blank ones
    spread = np.zeros(int(place[-1]) + 1)
    spread[place] = weight
    found = stretches(spread, window)
    kept = [s for s in found if s[2] > threshold] or [max(found, key=lambda s: (s[3], -s[0]))]
    inside = np.zeros(len(spread), bool)
    for a, b, _, _ in kept:
        inside[a:b] = True
    return " ".join([x for x, k in zip(lines, inside[place].tolist(), strict=True) if k])


def extract(pages: DataFrame, window: int = 3, threshold: int = 86) -> DataFrame:
    """page_id, url, text and n_chars of every row (page_id, url, html). Null html gives an empty text; repeated rows give
    repeated results; other columns are ignored; an empty table gives an empty result. Whole pages, however long, in time
    proportional to their length."""

    def run(batch: pa.RecordBatch) -> dict:
        texts = [main_text(x, window, threshold) for x in batch.column(2).to_pylist()]
        return {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n": [len(t) for t in texts]}

    return map_rows(pages.select(pages["page_id"].cast("bigint"), "url", "html"), run, "page_id bigint, url string, text string, n_chars bigint", rows=512)

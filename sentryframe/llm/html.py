"""Main text of web pages by tree scoring.

The html is read into a tree of elements.  Furniture is cut off first: navigation, header,
footer, aside, form, script and style elements, and elements whose role, class or id names a
menu, sidebar, notice, advert, comment or the like.  A class or id alone, or being a form, does not cut an element
that holds an article or main (not half links); on a page without those, none that holds three quarters of
the paragraphs' points; nor do words after has-, with-, no- and the like.  A mark that is also a word of other things
(market-share, header-image) cuts beside words of places only, else an element that is half links.
A header inside an article or main gives its headings.  Every paragraph then passes points to its
ancestors: one, one for each comma and up to three for length, all to the parent, half to the
grandparent, a third and less to the three above; an element's points are discounted by its link density.
A best container inside an article or main element is lifted to that element, and on to what
holds no more text.  It and its siblings are kept whole, whatever their length; siblings that
have half of their text or more in links are left out.

Character references are decoded, white space inside a block becomes one space, blocks are
trimmed and joined in page order by an empty line.  Nothing is dropped or cut for its length.

Null and empty html give the empty text, as does a page with no text.  Unclosed and misnested
tags are closed where the next element requires it; text outside any tag counts as a block.  A
text of any size is read in one pass and held by its own row only.  Rows are judged one by
one: null ids, ties and repeated rows come back as they are; other columns are not read; an
empty table gives no rows.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, ship

# HTML's own lists of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody "
    "tfoot thead tr ul".split()
)
CLOSES_P = BLOCK - {"body", "html", "caption", "tbody", "tfoot", "thead", "tr", "legend"}
FURNITURE = frozenset(
    "head nav header footer aside script style noscript template button select textarea iframe object svg canvas "
    "audio video dialog menu title datalist input fieldset".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of a class or id that mark furniture.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion banner sidebar "
    "nav navbar navigation menu header masthead footer comment comments commentlist disqus reply replies respond cookie "
    "cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup "
    "login share sharing social related recommended breadcrumb breadcrumbs pagination pager toolbar widget disclaimer "
    "copyright skip".split()
)
#: Marks that are also words of other things: market-share, social-science, header-image.
AMBIGUOUS = frozenset(
    "banner header menu share sharing social related notice notices notification alert overlay toolbar widget disclaimer copyright "
    "reply replies respond consent navigation promotion skip".split()
)
#: Words that leave a mark its meaning: site-header, share-buttons, notice-bar.
PLACES = frozenset(
    "site page post posts article articles entry stories content main top bottom left right inner outer wrapper wrap container box "
    "block bar panel section area list item items link links row col column group global primary secondary mobile desktop sticky "
    "fixed icon icons button buttons btn btns this on us policy message".split()
)
#: Words of a name after which it speaks of other elements.
OTHERS = frozenset("has have with without no not non hide".split())
#: Whole names that make even an article element furniture.
OWN_MARKS = {"comment", "comments", "reply", "ad", "advert", "advertisement", "promo", "teaser"}
#: Points that a container has by its element alone.
BONUS = {"article": 25.0, "main": 15.0, "section": 3.0, "div": 3.0, "td": 2.0, "blockquote": 2.0, "ul": -3.0, "ol": -3.0, "body": -1.0}

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are parts of a line.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt "
    "u var wbr".split()
)
#: Beside the best container, what has this share of its text in links is left out.
LINKED = 0.5
#: An element with a furniture name and more than this share of the paragraphs' points is not cut.
MOST = 0.75

#: What a paragraph passes to its parent and the ancestors above it.
SHARES = (1.0, 0.5, 1 / 3, 1 / 6, 1 / 9)

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)>?", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


class Element:
    __slots__ = ("bad", "children", "commas", "doubtful", "link_chars", "marked", "parent", "points", "tag", "text_chars")

    def __init__(self, tag: str, parent: Element | None, bad: bool, marked: bool = False, doubtful: bool = False):
        self.tag, self.parent, self.bad, self.marked, self.doubtful = tag, parent, bad, marked, doubtful
        self.children: list[Element | str] = []
        self.points, self.text_chars, self.link_chars, self.commas = 0.0, 0, 0, 0


def _is_furniture(tag: str, attributes: str) -> bool:
    if tag in FURNITURE:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        value = m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "role" and value.lower() in ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name in ("class", "id") and tag in ("article", "main") and OWN_MARKS & set(value.lower().split()):
            return True
    return False


def _marks(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether a class or id names furniture, and whether one only might: an ambiguous mark beside other words.

    What comes after has-, with-, no- and the like is not the element itself.
    """
    doubtful = False
    if not attributes or tag in ("html", "body", "article", "main"):
        return False, False
    for m in ATTRIBUTE.finditer(attributes):
        if m[1].lower() in ("class", "id"):
            for name in (m[2] or m[3] or m[4] or "").split():
                words = [w.lower() for w in NAME.findall(name)]
                words = words[:next((i for i, w in enumerate(words) if w in OTHERS), len(words))]
                marks = [w for w in words if w in MARKS]
                plain = all(w in MARKS or w in PLACES or w.isdigit() for w in words)
                if marks and (plain or any(w not in AMBIGUOUS for w in marks)):
                    return True, False
                doubtful = doubtful or bool(marks)
    return False, doubtful


def _inside(e: Element | None, *tags: str) -> bool:
    while e is not None and e.tag not in tags:
        e = e.parent
    return e is not None


def parse(html: str) -> Element:
    """The page as a tree; furniture is ``bad`` with all that it holds, unless it is a form or its name alone says so.

    A header in an article or main is read for its headings, a label is furniture in a form only.
    """
    root = here = Element("#root", None, False)
    headers: list[Element] = []
    at, n = 0, len(html)
    while at < n:
        m = TAG.search(html, at)
        if m is None:
            here.children.append(html[at:])
            break
        if m.start() > at:
            here.children.append(html[at:m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                here.children.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            here = _close(here, tag)
            continue
        here = _make_room(here, tag)
        named, doubtful = _marks(tag, m[3])
        element = Element(tag, here, here.bad or _is_furniture(tag, m[3]), named or tag == "form", doubtful)
        if tag == "header" and not here.bad and _inside(here, "article", "main"):
            element.bad = _is_furniture("div", m[3])
            headers.append(element)
        elif tag == "label" and _inside(here, "form"):
            element.bad = True
        here.children.append(element)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = end.end() if end else n
        elif tag not in VOID and not m[3].endswith("/"):
            here = element
        elif tag not in VOID and tag in BLOCK:
            here = element  # a slash does not close an html element
    for header in headers:
        header.children = [e for e in _walk(header) if e.tag in HEADINGS]
        header.marked = header.doubtful = False
        for e in header.children:
            e.parent, e.marked, e.doubtful = header, False, False
    return root


def _close(here: Element, tag: str) -> Element:
    """The parent of the nearest open element of that name; an inline end tag stays in its block."""
    e = here
    while e is not None and e.tag != tag:
        if tag not in BLOCK and e.tag in BLOCK:
            return here
        e = e.parent
    return e.parent if e is not None and e.parent is not None else here


_ENDS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)),
         "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",)), "body": ("head", ("html",))}


def _make_room(here: Element, tag: str) -> Element:
    """Close what the new element cannot stand in: an open paragraph, the item before it."""
    if tag in CLOSES_P:
        e = here
        while e is not None and e.tag != "p" and e.tag not in BLOCK and e.tag not in ("td", "th"):
            e = e.parent
        if e is not None and e.tag == "p":
            here = e.parent
    if tag in _ENDS:
        names, limits = _ENDS[tag]
        e, last = here, None
        while e is not None and e.tag not in limits and e.tag != "#root":
            if e.tag in names.split():
                last = e
            e = e.parent
        if last is not None and last.parent is not None:
            here = last.parent
    return here


def _walk(root: Element):
    """Every element that is not furniture, in page order."""
    stack = [root]
    while stack:
        e = stack.pop()
        yield e
        stack.extend(c for c in reversed(e.children) if isinstance(c, Element) and not c.bad)


def _measure(root: Element) -> list[Element]:
    """Text, commas and link text of every element; leaves of the walk first."""
    order = list(_walk(root))
    for e in reversed(order):
        e.text_chars = e.commas = e.link_chars = 0
        for c in e.children:
            if isinstance(c, str):
                e.text_chars += len(c.strip())
                e.commas += c.count(",")
            elif not c.bad:
                e.text_chars += c.text_chars
                e.commas += c.commas
                e.link_chars += _linked(c)
    return order


def _linked(e: Element) -> int:
    return e.text_chars if e.tag == "a" else e.link_chars


def _is_paragraph(e: Element) -> bool:
    if e.tag in ("p", "pre", "blockquote", "td", "dd", "li"):
        return True
    return e.tag in ("div", "section", "article", "main", "body") and any(isinstance(c, str) and c.strip() for c in e.children)


def _points(e: Element) -> float:
    """What a paragraph passes on; nothing from other elements."""
    if not e.text_chars or not _is_paragraph(e):
        return 0.0
    return (1 + e.commas + min(e.text_chars / 100, 3.0)) * (1 - e.link_chars / e.text_chars)


def _cut_marked(root: Element) -> None:
    """Cut forms and elements with a furniture name, but not the one around the page's articles or, without any, three quarters
    of its points; those with a doubtful name only if half of their text is links."""
    order = _measure(root)
    if not any(e.marked or e.doubtful for e in order):
        return
    points: dict[int, float] = {}
    articles: dict[int, int] = {}
    for e in reversed(order):
        inner = [c for c in e.children if isinstance(c, Element) and not c.bad]
        points[id(e)] = _points(e) + sum(points[id(c)] for c in inner)
        itself = e.tag in ("article", "main") and e.link_chars < LINKED * e.text_chars
        articles[id(e)] = itself + sum(articles[id(c)] for c in inner)
    for e in order:
        cut = e.marked or (e.doubtful and e.link_chars >= LINKED * e.text_chars)
        if cut and not (articles[id(e)] if articles[id(root)] else points[id(e)] > MOST * points[id(root)]):
            e.bad = True


def _lifted(best: Element) -> Element:
    """The article, else main, around the best container, and what is around that and holds no more text."""
    around, e = {}, best
    while e is not None:
        around[e.tag] = e
        e = e.parent
    best = around.get("article") or around.get("main") or best
    while best.parent is not None and best.parent.text_chars == best.text_chars:
        best = best.parent
    return best


def _beside(best: Element) -> list[Element | str]:
    """The best container and its siblings of low link density; text and inline elements in a row are judged as one."""
    kept: list[Element | str] = []
    run: list[Element | str] = []

    def end() -> None:
        chars = sum(len(c.strip()) if isinstance(c, str) else c.text_chars for c in run)
        if chars and sum(_linked(c) for c in run if isinstance(c, Element)) < LINKED * chars:
            kept.extend(run)
        run.clear()

    for c in best.parent.children:
        if isinstance(c, str) or (c.tag in INLINE and c is not best):
            if isinstance(c, str) or not c.bad:
                run.append(c)
            continue
        end()
        if c is best or (not c.bad and c.text_chars and _linked(c) < LINKED * c.text_chars):
            kept.append(c)
    end()
    return kept


def best_containers(root: Element) -> list[Element | str]:
    """The best container and what is kept beside it, in page order."""
    _cut_marked(root)
    order = _measure(root)
    scored: dict[int, Element] = {}
    for e in order:
        if not e.text_chars or not _is_paragraph(e):
            continue
        points = _points(e)
        up = e if e.tag in ("div", "section", "article", "main", "body") else e.parent
        for share in SHARES:
            if up is None:
                break
            up.points += points * share
            scored[id(up)] = up
            up = up.parent
    best, top = None, 0.0
    for e in order:
        if (id(e) in scored or e.tag in ("article", "main")) and e.text_chars:
            score = (e.points + BONUS.get(e.tag, 0.0)) * (1 - e.link_chars / e.text_chars)
            if best is None or score > top:
                best, top = e, score
    if best is None:
        return [root]
    best = _lifted(best)
    return [best] if best.parent is None else _beside(best)


def blocks_of(containers: list[Element | str]) -> list[str]:
    """The text blocks below the containers, decoded and trimmed."""
    blocks, parts = [], []

    def end() -> None:
        text = " ".join(unescape("".join(parts)).split())
        parts.clear()
        if text:
            blocks.append(text)

    for container in containers:
        inline = isinstance(container, str) or container.tag in INLINE
        if not inline:
            end()
        stack: list[Element | str | None] = [container]
        while stack:
            x = stack.pop()
            if x is None:
                end()
            elif isinstance(x, str):
                parts.append(x)
            elif not x.bad:
                if x.tag in ("br", "td", "th", "option"):
                    parts.append(" ")
                if x.tag in BLOCK:
                    end()
                    stack.append(None)
                stack.extend(reversed(x.children))
        if not inline:
            end()
    end()
    return blocks


def extract_text(html: str | None) -> str:
    """The page's main text, blocks joined by an empty line."""
    if not html:
        return ""
    return "\n\n".join(blocks_of(best_containers(parse(html))))


def _run(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = [extract_text(x.as_py()) for x in batch.column(1)]
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["kept", "text"])


def extract(pages: DataFrame, *, keep: tuple[str, ...] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """The ``keep`` columns and ``text``."""
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("kept"), F.col(f"`{html}`").alias("body"))
    kept_type = rows.schema["kept"].dataType.simpleString()
    found = map_batches(rows, _run, f"kept {kept_type}, text string")
    return found.select(*(F.col("kept")[c].alias(c) for c in keep), "text")


ship(__name__)

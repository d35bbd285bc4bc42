"""Main text of web pages: flat text blocks, shallow features, a decision tree.

A page is cut into blocks at block-level tags. A block's features are its words and link density,
those of the blocks before and after it, and whether it stands in page furniture (by tag, or by the words of
class, id or role), in the article's element, or is a heading. A decision tree, trained here on
the small labelled table below, says which blocks are main text.

Names that only sound like furniture do not decide alone. An element is none if, for all its name, it holds prose
inside an article, or most of the words of a page without an article element; names of readers' comments, notices and
the like stand in any case. So does a form that holds most of the page. On a page without an article
element, or a name for one, the smallest element that holds most of the unlinked words is taken for it.

A null html is empty and gives an empty text. Broken markup is read as browsers do: an open
comment, script or tag runs to the end, missing end tags are implied; only raw elements written as
self-closing (``<iframe/>``) are empty, as XHTML pages mean them. Pages are judged one by
one, so repeated rows and ids give repeated results; an empty table gives no rows; columns other than
``page_id``, ``url`` and ``html`` are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style noscript template svg iframe object textarea select title".split()
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot "
    "th thead tr ul".split()
)
CHROME = frozenset("nav footer aside dialog menu button fieldset".split())
CONTENT = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner sponsor sponsored sponsors promo promotion "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription "
    "signup login sidebar sidebars menu nav navbar navigation navbox breadcrumb breadcrumbs pagination pager toolbar "
    "footer header masthead topbar share sharing social comment comments commentlist disqus replies reply respond "
    "related recommended widget widgets copyright disclaimer skip search tags".split()
)
#: Of these the names that stand whatever the element holds, and those of advertising.
FIRM_HINTS = frozenset(
    "cookie cookies consent gdpr notification alert popup modal overlay newsletter subscribe subscription signup login "
    "breadcrumb breadcrumbs pagination pager comment comments commentlist disqus replies reply respond related "
    "recommended copyright disclaimer".split()
)
AD_HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner sponsor sponsored sponsors promo promotion".split()
)
CONTENT_HINTS = frozenset("article content post entry story articlebody maincontent".split())
#: Words from which on an unlinked block is prose, and the share of links up to which it is unlinked.
PROSE, UNLINKED = 8, 0.3

_TAG = re.compile(
    r"<!--.*?(?:-->|--!>|\Z)|<(?:!|\?)[^>]*(?:>|\Z)"
    r"|<(?:" + "|".join(RAW) + r")(?:/|(?=\s)(?:[^>\"']|\"[^\"]*\"|'[^']*')*?(?<=[\s\"'])/)>"
    r"|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*[^>]*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_PAIR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_NONE = re.compile(r"display\s*:\s*none", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def _hidden(attrs: str) -> bool:
    """Do the attributes themselves, not words of their values, hide the element?"""
    for name, value in _PAIR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").strip().lower()
        if name == "hidden" and value != "false" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and _NONE.search(value):
            return True
    return False


@lru_cache(maxsize=65536)
def _hints(attrs: str) -> tuple[str, bool, bool]:
    """What furniture do class, id or role name ("firm", "ad", "weak" or none), do they name content, is it hidden?"""
    parts = {p.lower() for v in _ATTR.findall(attrs) for p in _PART.findall(v)}
    kind = "firm" if parts & FIRM_HINTS else "ad" if parts & AD_HINTS else "weak" if parts & HINTS else ""
    return kind, bool(parts & CONTENT_HINTS), _hidden(attrs)


class Block:
    __slots__ = ("text", "words", "linked", "chrome", "content", "heading", "doubts", "element")

    def __init__(self, text, linked, where):
        self.text, self.linked = text, linked
        self.words = text.count(" ") + 1
        self.chrome, self.content, self.heading = where.furniture, where.article, where.heading
        self.doubts, self.element = where.doubts, where.element

    @property
    def unlinked(self) -> bool:
        return self.linked <= UNLINKED * self.words


class Open(NamedTuple):
    """An open element: where its text would stand. ``firm`` is furniture that an article inside does not undo,
    ``doubts`` are the elements around it that may be furniture."""

    name: str
    furniture: bool = False
    article: bool = False
    link: bool = False
    heading: bool = False
    firm: bool = False
    doubts: tuple[int, ...] = ()
    element: int = 0


class Doubt(NamedTuple):
    """An element that is furniture by its name only, or a form."""

    kind: str  # "weak", "ad" or "form"
    named: bool  # it is also named as content
    inside: bool  # it stands in an article


def _settle(blocks: list[Block], doubts: list[Doubt], parents: list[int], article: bool) -> None:
    """Decide which doubtful elements are furniture; find the text's element on a page that names none."""
    if doubts:
        total = sum(b.words for b in blocks if not b.chrome)
        words, prose = [0] * len(doubts), [0] * len(doubts)
        for b in blocks:
            if not b.chrome:
                for d in b.doubts:
                    words[d] += b.words
                    prose[d] += b.unlinked and b.words >= PROSE
        kept = []
        for d, n, p in zip(doubts, words, prose):
            most = 2 * n >= total and p > 0
            if d.kind == "weak":
                kept.append(p > 0 and (d.inside or d.named) or most and not article)
            else:
                kept.append(most and (not d.inside and not article or d.named))
        for b in blocks:
            b.chrome = b.chrome or not all(kept[d] for d in b.doubts)
    if not article and not any(b.content for b in blocks):
        held = [0] * len(parents)
        for b in blocks:
            if not b.chrome and b.unlinked:
                held[b.element] += b.words
        for e in range(len(parents) - 1, 0, -1):
            held[parents[e]] += held[e]
        # Elements are numbered as they open, so the last one that holds enough is the smallest.
        best = max((e for e in range(1, len(parents)) if held[e] > 0 and 10 * held[e] >= 6 * held[0]), default=0)
        if best:
            inside = [False] * len(parents)
            for e in range(best, len(parents)):
                inside[e] = e == best or inside[parents[e]]
            for b in blocks:
                b.content = inside[b.element]


def blocks_of(page: str) -> list[Block]:
    out: list[Block] = []
    stack = [Open("")]
    doubts: list[Doubt] = []
    parents = [0]  # of the elements that may hold the text, by number; the page itself is 0
    article = False
    text: list[tuple[str, bool]] = []
    where = stack[0]

    def flush():
        nonlocal text
        if text:
            whole = " ".join(entities.unescape("".join(t for t, _ in text)).split())
            if whole:
                linked = sum(len(entities.unescape(t).split()) for t, a in text if a)
                out.append(Block(whole, linked, where))
            text = []

    at = 0
    for m in _TAG.finditer(page):
        if m.start() > at:
            text.append((page[at : m.start()], stack[-1].link))
            where = stack[-1]
        at = m.end()
        name = m["name"]
        if name is None:
            if m["raw"] and m["raw"].lower() in ("textarea", "select"):
                flush()
            continue
        if not page.endswith(">", m.start(), at) and at == len(page):
            break  # an unfinished tag ends the page
        name = name.lower()
        if name == "br":
            text.append((" ", False))
            continue
        if name == "head":
            # Its end may be left out; what it may hold is raw or void, other text belongs to the body.
            flush()
            continue
        if name in BLOCK:
            flush()
        if m["close"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    del stack[i:]
                    break
            continue
        if name in VOID:
            continue
        if name in BLOCK:
            # A block ends an open paragraph, an item ends the open item of its list.
            ends = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}.get(name, ()) + ("p",)
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in ends:
                    del stack[i:]
                    break
                if stack[i].name in BLOCK:
                    break
        attrs = m["attrs"]
        up = stack[-1]
        kind, good, hidden = _hints(attrs) if "=" in attrs or attrs.strip() else ("", False, False)
        # An article that is not called furniture itself is none for the names of what holds it.
        fresh = name in CONTENT and not kind and not hidden
        inherited, around = (up.firm, ()) if fresh else (up.furniture, up.doubts)
        article = article or name in CONTENT and not inherited and not kind
        if name in ("html", "body") or name in CONTENT or name in HEADINGS:
            kind, hidden = "", False
        # A header inside an article that is not furniture itself holds the article's title.
        outside = name in ("header", "address") and not up.article
        firm = up.firm or name in CHROME or (hidden and name != "header") or outside
        furniture = inherited or firm or kind == "firm" and name != "header"
        if not furniture and (name == "form" or kind and name != "header"):
            around = (*around, len(doubts))
            doubts.append(Doubt("form" if name == "form" else kind, good, up.article))
        good = good and not (kind or hidden) and name != "body"
        element = up.element
        if name in BLOCK and name not in ("html", "body", "p", "li", "tr", "td", "th", *HEADINGS):
            element = len(parents)
            parents.append(up.element)
        stack.append(
            Open(name, furniture, up.article or name in CONTENT or good, up.link or name == "a", up.heading or name in HEADINGS, firm, around, element)
        )
        if attrs.endswith("/") and name not in BLOCK:
            stack.pop()
    if at < len(page):
        text.append((page[at:], stack[-1].link))
        where = stack[-1]
    where = stack[-1] if text and not page.endswith(">") else where
    flush()
    _settle(out, doubts, parents, article)
    return out


FEATURES = ("words", "density", "words before", "density before", "words after", "density after", "furniture", "article", "heading")
#: A small labelled table: features as named above, then 1 for main text.
LABELLED = np.array(
    [
        # furniture, whatever it says
        (1, 1.0, 0, 0.0, 1, 1.0, 1, 0, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0, 0), (8, 0.0, 1, 1.0, 12, 0.0, 1, 0, 0, 0),
        (20, 0.0, 40, 0.0, 0, 0.0, 1, 0, 0, 0), (45, 0.0, 60, 0.0, 30, 0.0, 1, 1, 0, 0), (6, 0.0, 80, 0.0, 50, 0.0, 1, 1, 0, 0),
        (3, 0.0, 0, 0.0, 9, 0.1, 1, 0, 1, 0), (90, 0.02, 70, 0.0, 60, 0.0, 1, 0, 0, 0), (2, 0.5, 12, 0.0, 2, 0.5, 1, 1, 0, 0),
        (4, 0.0, 120, 0.0, 35, 0.0, 1, 1, 1, 0), (30, 0.0, 6, 0.0, 25, 0.0, 1, 1, 0, 0), (12, 0.25, 90, 0.0, 0, 0.0, 1, 0, 0, 0),
        # the article's element
        (8, 0.0, 8, 0.0, 12, 0.0, 0, 1, 1, 1), (1, 0.0, 90, 0.0, 60, 0.0, 0, 1, 0, 1), (120, 0.0, 40, 0.0, 80, 0.0, 0, 1, 0, 1),
        (60, 0.1, 1, 0.0, 0, 0.0, 0, 1, 0, 1), (5, 0.0, 2, 0.0, 3, 0.0, 0, 1, 0, 1), (25, 0.2, 30, 0.0, 10, 0.3, 0, 1, 0, 1),
        (2, 0.0, 0, 0.0, 1, 0.0, 0, 1, 1, 1), (9, 0.0, 1, 1.0, 0, 0.0, 0, 1, 0, 1), (3, 0.33, 50, 0.0, 70, 0.0, 0, 1, 0, 1),
        (15, 0.0, 45, 0.0, 4, 1.0, 0, 1, 0, 1), (6, 0.0, 7, 0.0, 100, 0.0, 0, 1, 1, 1), (40, 0.45, 90, 0.0, 30, 0.0, 0, 1, 0, 1),
        (7, 0.14, 1, 0.0, 1, 1.0, 0, 1, 0, 1), (2, 0.0, 1, 1.0, 1, 1.0, 0, 1, 0, 1), (1, 0.0, 3, 0.5, 2, 0.5, 0, 1, 0, 1),
        (9, 0.3, 4, 1.0, 4, 1.0, 0, 1, 0, 1), (4, 0.5, 30, 0.0, 0, 0.0, 0, 1, 0, 1), (200, 0.05, 0, 0.0, 6, 1.0, 0, 1, 0, 1),
        # links only, in an article's element: lists of other pages
        (4, 1.0, 60, 0.0, 5, 1.0, 0, 1, 0, 0), (5, 1.0, 4, 1.0, 6, 1.0, 0, 1, 0, 0), (7, 1.0, 5, 1.0, 0, 0.0, 0, 1, 0, 0),
        (2, 1.0, 30, 0.0, 2, 1.0, 0, 1, 0, 0), (9, 0.9, 7, 1.0, 3, 1.0, 0, 1, 0, 0),
        # pages without such an element
        (80, 0.0, 60, 0.0, 70, 0.0, 0, 0, 0, 1), (45, 0.05, 9, 0.0, 60, 0.0, 0, 0, 0, 1), (30, 0.1, 50, 0.0, 2, 1.0, 0, 0, 0, 1),
        (18, 0.0, 40, 0.0, 35, 0.0, 0, 0, 0, 1), (12, 0.0, 55, 0.0, 48, 0.0, 0, 0, 0, 1), (25, 0.0, 3, 1.0, 30, 0.0, 0, 0, 0, 1),
        (7, 0.0, 1, 1.0, 60, 0.0, 0, 0, 1, 1), (5, 0.0, 70, 0.0, 65, 0.0, 0, 0, 1, 1), (16, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1),
        (3, 1.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0, 0), (10, 0.8, 4, 1.0, 5, 1.0, 0, 0, 0, 0),
        (4, 0.0, 1, 1.0, 2, 1.0, 0, 0, 0, 0), (6, 0.0, 2, 1.0, 3, 0.5, 0, 0, 0, 0), (3, 0.0, 0, 0.0, 2, 1.0, 0, 0, 0, 0),
        (5, 0.4, 60, 0.0, 2, 1.0, 0, 0, 0, 0), (8, 0.0, 3, 1.0, 2, 1.0, 0, 0, 0, 0), (30, 0.7, 12, 0.8, 15, 0.6, 0, 0, 0, 0),
        (2, 0.0, 2, 0.0, 2, 0.0, 0, 0, 0, 0), (6, 0.0, 5, 0.0, 4, 0.0, 0, 0, 0, 0), (14, 0.6, 40, 0.0, 9, 1.0, 0, 0, 0, 0),
    ]
)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 7) -> tuple:
    """A decision tree by Gini impurity: leaves ``(class,)``, nodes ``(feature, cut, left, right)``."""
    if depth == 0 or len(set(y.tolist())) == 1:
        return (int(y.mean() >= 0.5),)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] < cut
            gini = sum(s.sum() * y[s].mean() * (1 - y[s].mean()) for s in (low, ~low))
            if best is None or gini < best[0] - 1e-12:
                best = (gini, f, float(cut), low)
    if best is None:
        return (int(y.mean() >= 0.5),)
    _, f, cut, low = best
    return (f, cut, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


@lru_cache(maxsize=1)
def _tree() -> tuple:
    return grow(LABELLED[:, :-1], LABELLED[:, -1].astype(int))


def is_main(tree: tuple, row: tuple) -> bool:
    while len(tree) > 1:
        f, cut, low, high = tree
        tree = low if row[f] < cut else high
    return bool(tree[0])


def main_text(page: str | None) -> str:
    if not page:
        return ""
    blocks = blocks_of(page)
    tree = _tree()
    shallow = [(0, 0.0), *((b.words, b.linked / b.words) for b in blocks), (0, 0.0)]
    out = []
    for i, b in enumerate(blocks, 1):
        row = (*shallow[i], *shallow[i - 1], *shallow[i + 1], b.chrome, b.content, b.heading)
        if is_main(tree, row):
            out.append(b.text)
    return "\n".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` per row of ``pages(page_id, url, html)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                some = batch.slice(low, 512)
                texts = [main_text(h) for h in some.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    cols = pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string"))
    kind = cols.schema["page_id"].dataType.simpleString()
    return cols.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")

"""Main-text extraction by composite text density.

Every element of the page tree gets the composite density

    C/T * log_b(C/LC * T/LT),   b = ln(C/(C-LC) * LC + LC_body/C_body * C + e)

with C characters, T tags, LC characters in links and LT link tags of its
subtree (zeros in denominators count as 1).  The element whose children have
the largest density sum is the core of the page; the smallest density on the
path from the body to it is the threshold.

The threshold decides what joins the core.  Going up from it, neighbours that reach
the threshold are added, and headings before it; parts whose text is mostly
links and whose density is under the threshold are left out, inside the core
too.  An ``article`` or ``main`` around the core only says how far up to go:
within it, neighbours that are not mostly links belong to the text.

Elements that are never article text (``_NEVER``, ``_SELDOM``, and names in
``_NAMES``) are left out before densities are taken.  An element of ``_SELDOM``
or with such a name stays if it is a wrapper: it holds more than half of the
page's text outside links, and a ``main`` or an ``article`` (or, for forms and
names, an ``h1``).

Null or empty html gives an empty text, a page of menus only too.  Rows are
independent: repeated rows give repeated results, an empty table an empty
result.  Parsing takes time in proportion to the page, however deep it nests.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweir.llm.common import table

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption dd details div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_NEVER = frozenset("head title script style noscript template button select textarea iframe object svg dialog menu".split())
_SELDOM = frozenset("nav header footer aside form".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words that mark notices, adverts, menus and comments where a class, id or role ends in one, or in one and a word for a box.
_NAMES = re.compile(
    r"(?:(?!has|with|without|no|is|show)[a-z0-9]+-)*"
    r"(?:ads?|advert\w*|banner|breadcrumbs?|comments?(?:list|section|area|thread|box|wrap|form)?|consent|cookies?|disqus|footer|gdpr|masthead|"
    r"menu|modal|nav|navbar|navigation|newsletter|notices?|pagination|popup|promo\w*|related|replies|respond|"
    r"sidebar|sponsor\w*|subscribe|toolbar|widgets?)"
    r"(?:-(?:area|bar|block|body|bottom|box|container|content|form|inner|item|left|links?|list|message|panel|right|section|slot|text|thread|top|unit|wrapper|\d+))*"
)
#: Words that mark buttons for sharing, but may as well name a part about it: such an element goes if it says little besides links.
_BUTTONS = re.compile(r"(?:[a-z0-9]+-)*(?:share|sharing|social)(?:-[a-z0-9]+)*")
_LITTLE = 60
#: Elements that may be lists of links; paragraphs and headings are text however many links they hold.
_LISTS = _BLOCK - _HEADINGS - {"p", "blockquote", "pre", "figcaption", "caption", "address"}
_CLOSES_P = _BLOCK - {"html", "body"}
_SAME = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("table td th ul ol dl body html article section div".split())


@lru_cache(maxsize=10_000)
def _named(value: str) -> bool:
    """Is one of the words of a class, id or role such a name?"""
    words = re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower().replace("_", "-").split()
    return any(w == "hidden" or _NAMES.fullmatch(w) for w in words)


@lru_cache(maxsize=10_000)
def _buttons(value: str) -> bool:
    return any(_BUTTONS.fullmatch(w) for w in value.lower().replace("_", "-").split())


class _Node:
    __slots__ = ("tag", "parent", "parts", "skip", "named", "buttons", "within", "c", "t", "lc", "lt", "density", "article", "h1")

    def __init__(self, tag: str, parent: _Node | None, named: bool = False, skip: bool = False, buttons: bool = False):
        self.tag, self.parent, self.parts, self.named, self.skip, self.buttons = tag, parent, [], named, skip, buttons
        self.within = parent is not None and (parent.within or parent.tag == "article")  # an article
        self.c = self.t = self.lc = self.lt = 0
        self.density, self.article, self.h1 = 0.0, False, False

    def children(self) -> list[_Node]:
        return [y for y in self.parts if not isinstance(y, str) and not y.skip]

    def plain(self) -> int:
        return self.c - self.lc


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Node("html", None)
        self.open = [self.root]
        self.depths: dict[str, list[int]] = {"html": [0]}  # of the open elements of each tag
        self.looked, self.last_end = None, -1

    def _deepest(self, tags: set | frozenset) -> int:
        return max((d[-1] for t in tags if (d := self.depths.get(t))), default=-1)

    def _pop_to(self, depth: int) -> None:
        while len(self.open) > max(depth, 1):
            self.depths[self.open.pop().tag].pop()

    def _close(self, tags: set | frozenset, stop: frozenset) -> None:
        """Ends the innermost open element of ``tags``, unless one of ``stop`` is open inside it."""
        depth = self._deepest(tags)
        if depth > self._deepest(stop - tags):
            self._pop_to(depth)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "html":
            return
        if tag in _CLOSES_P:
            self._close({"p"}, _SCOPE)
        if tag in _SAME:
            self._close(_SAME[tag], _SCOPE - {"td", "th"} if tag == "tr" else _SCOPE - _SAME[tag])
        named = tag not in ("body", "main") and any(v and k in ("class", "id", "role") and _named(v) for k, v in attrs)
        hidden = any(k == "hidden" or (k == "aria-hidden" and v == "true") for k, v in attrs)
        buttons = not named and tag not in ("body", "main", "article") and any(v and k in ("class", "id", "role") and _buttons(v) for k, v in attrs)
        if tag == "header" and not named and (self.open[-1].within or self.open[-1].tag == "article"):
            tag = "div"  # an article's own heading
        node = _Node(tag, self.open[-1], named or tag in _SELDOM, tag in _NEVER or hidden, buttons)
        self.open[-1].parts.append(node)
        if tag not in _VOID:
            self.depths.setdefault(tag, []).append(len(self.open))
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "path", "use"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == "header" and not self.depths.get("header"):
            tag = "div"
        depth = self._deepest({tag})
        if depth > 0:
            self._pop_to(depth)

    def handle_data(self, data: str) -> None:
        self.open[-1].parts.append(data)

    def parse_comment(self, i: int, report: int = 1) -> int:
        """A comment that never ends is none: what follows ``<!--`` stays. Whether there is an end is looked up once."""
        if self.looked is not self.rawdata:
            self.looked, self.last_end = self.rawdata, self.rawdata.rfind("-->")
        if i + 2 > self.last_end:
            return i + 4
        return self.rawdata.find("-->", i + 2) + 3

    def read(self, html: str) -> None:
        """The whole page. After the last ``>`` no tag can end, so that the rest is text; looking for ends from each ``<`` there would take quadratic time."""
        last = html.rfind(">") + 1
        self.feed(html[:last])
        self.close()
        if last < len(html):
            self.handle_data(unescape(html[last:]))

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """``<![`` of any kind is a comment up to the next ``>``, as in browsers; the base class raises or looks far ahead."""
        return self.parse_bogus_comment(i, report)


def _measure(root: _Node) -> list[_Node]:
    """Counts of every kept node, children before parents."""
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += x.children()
    order.reverse()
    for x in order:
        x.c = sum(len(" ".join(y.split())) for y in x.parts if isinstance(y, str))
        x.t = x.lc = x.lt = 0
        for y in x.children():
            x.c, x.t, x.lc, x.lt = x.c + y.c, x.t + y.t + 1, x.lc + y.lc, x.lt + y.lt
            x.article = x.article or y.article or y.tag == "main" or (y.tag == "article" and not y.named)
            x.h1 = x.h1 or y.h1 or y.tag == "h1"
        if x.tag == "a":
            x.lc, x.lt = x.c, x.lt + 1
    return order


def _leave_out(order: list[_Node]) -> None:
    """Marks as skipped what is named or seldom text, but for wrappers."""
    page = order[-1].plain()
    for x in order:
        inside = x.article or (x.h1 and x.tag not in _SELDOM - {"form"})
        x.skip = x.skip or (x.named and not (inside and 2 * x.plain() > page)) or (x.buttons and x.plain() < _LITTLE)


def _density(x: _Node, link_share: float) -> float:
    if not x.c:
        return 0.0
    t, lc, lt = max(x.t, 1), max(x.lc, 1), max(x.lt, 1)
    base = math.log(x.c / max(x.c - x.lc, 1) * x.lc + link_share * x.c + math.e)
    return x.c / t * math.log(max(x.c / lc * t / lt, 1.0)) / max(math.log(base), 1e-3)


def _blocks(nodes: list[_Node], left_out: set[int]) -> list[str]:
    blocks, now = [], []

    def flush() -> None:
        text = " ".join("".join(now).split())
        if text:
            blocks.append(text)
        now.clear()

    todo: list = list(reversed(nodes))
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            now.append(x)
        elif x.skip or id(x) in left_out:
            if x.tag in _BLOCK:
                flush()
        elif x.tag == "br":
            now.append(" ")
        else:
            edge = [None] if x.tag in _BLOCK else []
            todo += [*edge, *reversed(x.parts), *edge]
    flush()
    return blocks


def _core(order: list[_Node]) -> tuple[_Node, float]:
    """The element with the largest sum of its children's densities, and the least density from the body to it."""
    body = next((x for x in reversed(order) if x.tag == "body"), order[-1])
    share = body.lc / max(body.c, 1)
    for x in order:
        x.density = _density(x, share)
    best = max(order, key=lambda x: sum(y.density for y in x.children()) or x.density)
    path, x = [], best
    while x is not None:
        path.append(x)
        x = x.parent
    return best, min((x.density for x in path if x.tag != "html"), default=0.0)


def _joined(core: _Node, threshold: float) -> list:
    """The core with its neighbours on the way up, in page order."""
    frame, x = None, core
    while x is not None and frame is None:
        frame, x = (x if x.tag in ("article", "main") else None), x.parent
    left: list = []  # what comes before the core, last first
    right: list = [core]
    while core is not frame and core.parent is not None and core.parent.tag != "html":
        parent, sides, side = core.parent, ([], []), 0
        for y in parent.parts:
            if y is core:
                side = 1
            elif isinstance(y, str):
                sides[side].extend([y] if frame is not None else [])
            elif not y.skip and (y.density >= threshold > 0 or (frame is not None and 2 * y.lc <= y.c) or (not side and y.tag in _HEADINGS)):
                sides[side].append(y)
            elif y.tag in _BLOCK:
                sides[side].append(None)
        edge = [None] if parent.tag in _BLOCK else []
        left += [*reversed(sides[0]), *edge]
        right += [*sides[1], *edge]
        core = parent
    return [*reversed(left), *right]


def main_text(html: str | None) -> str:
    """The article of one page; '' if there is none."""
    if not html:
        return ""
    tree = _Tree()
    tree.read(html)
    _leave_out(_measure(tree.root))
    order = _measure(tree.root)
    core, threshold = _core(order)
    link_lists = {id(x) for x in order if x is not core and x.tag in _LISTS and x.lt > 1 and 2 * x.lc > x.c and x.density < threshold}
    return "\n".join(_blocks(_joined(core, threshold), link_lists))


def extract_main_text(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text of ``html`` as ``out`` (replaced if there is one)."""

    @F.pandas_udf("string")
    def extract(s: pd.Series) -> pd.Series:
        return s.map(main_text, na_action=None)

    return pages.withColumn(out, extract(F.col(html)))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))

"""Main text of HTML pages by text-to-tag ratios.

The standard library's parser streams events. Text between two block boundaries is a line, with the number of tags in it;
its ratio of characters to tags is smoothed over its neighbours by a Gaussian, and the lines whose ratio reaches the standard
deviation of the page's form the content cluster. The region is the innermost container that holds the bulk of that cluster:
an article or main element where there is one, else what a walk down from the body finds. All of the region's lines are the
text, short ones and headings as well, but for menus, headers, footers, asides, notices, adverts, forms and comments, told by
element, role or name, and for lines of links outside the cluster.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import per_text, table

#: The kernel's standard deviation and reach, in lines.
SIGMA, REACH = 1.0, 2
#: Share of the cluster's ratios that a container holds for the region to lie in it.
BULK = 0.7
#: Share of a line's characters in links from which it is one of links.
LINKED = 0.6

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a line.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
#: Elements whose text is never the article's, and those whose content is no text at all.
OUTSIDE = frozenset("aside button datalist dialog footer menu nav search select textarea".split())
SILENT = frozenset("audio canvas embed head iframe math noembed noframes noscript object script style svg template title video".split())
IN_HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Where a region can lie.
CONTAINERS = frozenset("article body center div html main section table tbody td tr".split())
#: An element ends those of the first set that are open, unless one of the second lies between.
ENDS = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
#: Words of classes and ids by which an element is no article; the second set's may hold articles of their own.
NAMES = frozenset(
    "ad ads adv advert advertisement advertisements adverts advertising alert banner breadcrumb breadcrumbs consent cookie cookies copyright footer gdpr login masthead menu menus modal nav navbar navigation navigations newsletter notice notices notification overlay pager pagination popup promo promotion share sharing signup skip social sponsor sponsored subscribe subscription toolbar".split()
)
NAMES_APART = frozenset("aside comment comments disqus discussion recommendations recommended related replies reply respond sidebar widget widgets".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Headings from which on an element holds its readers' comments.
ABOUT_COMMENTS = frozenset("comments|reader comments|leave a comment|leave a reply|kommentare|leserkommentare|commentaires|comentarios".split("|"))

#: Elements inside of lines, whose own text alone a name can take out.
PHRASE = frozenset("a abbr b bdi bdo cite code data del em font i ins kbd mark q s samp small span strong sub sup time u var".split())
#: How an element keeps its lines out: not at all, unless an article begins in it (by its name, or a form), but for headings in an article, always.
IN, NAMED, FORM, HEADER, OUT = range(5)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Line(NamedTuple):
    text: str
    tags: int
    linked: int
    node: int
    heading: bool


class Node:
    __slots__ = ("article", "holds", "kind", "out", "parent")

    def __init__(self, parent: int, kind: str, out: int, article: bool):
        self.parent, self.kind, self.out, self.article = parent, kind, out, article
        self.holds = False  # an article or main element, as far as is known


def _names(attrs: dict) -> set[str]:
    return {w.lower() for a in ("class", "id") for w in _WORD.findall(attrs.get(a) or "")}


def _kept_out(tag: str, attrs: dict) -> int:
    if tag in OUTSIDE or "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true" or _HIDDEN.search((attrs.get("style") or "").lower()):
        return OUT
    if (attrs.get("role") or "").lower() in ROLES:
        return OUT
    if tag == "header":
        return HEADER
    if tag in ("form", "fieldset"):
        return FORM
    if tag in ("html", "body", "main") or not attrs:
        return IN
    names = _names(attrs)
    if names & NAMES_APART:
        return OUT
    if tag == "article":
        return IN
    return NAMED if names & NAMES else HEADER if "header" in names else IN


class Page(HTMLParser):
    """A page's lines and the tree of its elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.nodes = [Node(-1, "html", IN, False)]
        self.stack: list[tuple[str, int, bool]] = []  # open elements, each with its node or that around it, and whether its text is none
        self.open: Counter[str] = Counter()
        self.comments: list[tuple[int, int]] = []  # elements in which comments begin, and at which line
        self.parts: list[str] = []
        self.tags, self.linked = 0, 0
        self.link = self.silent = 0

    def _node(self) -> int:
        return self.stack[-1][1] if self.stack else 0

    def _end_line(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                heading = any(self.open[h] for h in HEADINGS)
                self.lines.append(Line(text, max(1, self.tags), self.linked, self._node(), heading))
                if heading and text.lower().rstrip(" :()0123456789") in ABOUT_COMMENTS:
                    around = self._node()
                    while around and self.nodes[around].kind in (*HEADINGS, "header", "hgroup"):
                        around = self.nodes[around].parent
                    self.comments.append((around, len(self.lines) - 1))
                self.tags = 0
            self.parts, self.linked = [], 0

    def _pop(self) -> str:
        tag, _, mute = self.stack.pop()
        self.open[tag] -= 1
        self.silent -= mute
        return tag

    def _pop_to(self, tag: str) -> None:
        while self._pop() != tag:
            pass

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if self.open["head"] and tag not in IN_HEAD:
            self._pop_to("head")
        if tag in BLOCK:
            self._end_line()
            if self.open["p"]:
                self._pop_to("p")
        if tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            return
        if tag in ENDS:
            ended, walls = ENDS[tag]
            if any(self.open[t] for t in ended):
                for k in range(len(self.stack) - 1, -1, -1):
                    if self.stack[k][0] in walls:
                        break
                    if self.stack[k][0] in ended:
                        while len(self.stack) > k:
                            self._pop()
                        break
        if tag == "a":
            self.link = 1
        if tag in ("article", "main") and self.open["nav"]:  # a menu that nobody closed
            self._pop_to("nav")
        named = dict(attrs)
        out = _kept_out(tag, named)
        node = self._node()
        if tag in ("article", "main") and out == IN:
            k = node
            while k > 0 and not self.nodes[k].holds and self.nodes[k].out in (IN, NAMED, FORM):
                self.nodes[k].out, self.nodes[k].holds = IN, True
                k = self.nodes[k].parent
        mute = tag in SILENT or tag in PHRASE and out in (NAMED, OUT)
        if tag in BLOCK or out != IN and not mute:
            inside = self.nodes[node].article or tag == "article" or named.get("role") == "article"
            self.nodes.append(Node(node, tag, out, inside))
            node = len(self.nodes) - 1
        self.stack.append((tag, node, mute))
        self.open[tag] += 1
        self.silent += mute

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK:
            self._end_line()
        if tag == "a":
            self.link = 0
        if tag not in ("html", "body") and self.open[tag]:
            self._pop_to(tag)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # outside of void elements the slash means nothing

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)
            if self.link:
                self.linked += len(data.strip())

    def end(self) -> None:
        if self.rawdata.startswith("<") and self.rawdata[1:2].isalpha() | (self.rawdata[1:2] in ("/", "!", "?")):
            self.rawdata = ""  # a tag that the page's end cuts is no text
        self.close()
        self._end_line()


def smoothed(ratios: np.ndarray, sigma: float = SIGMA, reach: int = REACH) -> np.ndarray:
    """Each line's ratio as the mean of those around it, weighed by a Gaussian; at the ends by what there is of it."""
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    spread = lambda x: np.convolve(x, kernel)[reach : reach + len(x)]
    return spread(ratios) / spread(np.ones(len(ratios)))


def _outside(nodes: list[Node]) -> np.ndarray:
    """How each element is kept out, by itself or by one around it."""
    out = np.zeros(len(nodes), np.int8)
    for k, node in enumerate(nodes):  # parents come first
        mine = OUT if node.out == HEADER and not node.article else node.out
        out[k] = max(mine, out[node.parent] if k else IN)
    return out


def _inside(nodes: list[Node], root: int) -> np.ndarray:
    """Whether each element is that one or in it."""
    inside = np.zeros(len(nodes), bool)
    for k, node in enumerate(nodes):
        inside[k] = k == root or k > 0 and inside[node.parent]
    return inside


def _region(page: Page, mass: np.ndarray) -> int:
    """The innermost container with the bulk of the lines' mass; one with a heading or such lines directly in it isn't left for a part of it."""
    nodes = page.nodes
    held, direct = np.zeros(len(nodes)), np.zeros(len(nodes), bool)
    for line, m in zip(page.lines, mass, strict=True):
        around = line.node
        held[around] += m
        while around > 0 and nodes[around].kind not in CONTAINERS:
            around = nodes[around].parent
        direct[around] |= line.heading or m > 0
    for k in range(len(nodes) - 1, 0, -1):
        held[nodes[k].parent] += held[k]
    at = 0
    for k, node in enumerate(nodes):  # those with the bulk lie in one another, the outer first
        if k and node.kind in CONTAINERS and held[k] >= BULK * held[0] > 0:
            if nodes[at].kind == "article" or direct[at] and node.kind not in ("article", "main"):
                break
            at = k
    return at


def _misnamed(page: Page, of: np.ndarray, out: np.ndarray) -> bool:
    """Whether what a name keeps out is the page's bulk, on a page without an article or main element."""
    if any(n.kind in ("article", "main") for n in page.nodes):
        return False
    sizes = np.array([len(x.text) for x in page.lines])
    named = sizes[out == NAMED]
    return len(named) > 3 and 2 * named.sum() > sizes.sum()


def extract(html: str) -> str:
    """The page's main text, a line a block; empty if it has none."""
    if not html:
        return ""
    page = Page()
    page.feed(html)
    page.end()
    if not page.lines:
        return ""
    ratios = smoothed(np.array([len(x.text) / x.tags for x in page.lines]))
    cluster = ratios >= ratios.std()
    of, heading = np.array([x.node for x in page.lines]), np.array([x.heading for x in page.lines])
    out = _outside(page.nodes)[of]
    kept = (out == IN) | (out == HEADER) & heading
    if page.comments:
        until = np.full(len(page.nodes), len(page.lines))
        for node, first in page.comments:
            until[node] = min(until[node], first)
        for k in range(1, len(page.nodes)):  # parents come first
            until[k] = min(until[k], until[page.nodes[k].parent])
        kept &= np.arange(len(page.lines)) < until[of]
    if not kept.any() and _misnamed(page, of, out):
        kept = out == NAMED
    if not kept.any():
        return ""
    region = _region(page, ratios * (kept & cluster if (kept & cluster).any() else kept))
    inside = _inside(page.nodes, region)
    links = np.array([x.linked >= LINKED * len(x.text) for x in page.lines])
    chosen = kept & inside[of] & ~(links & ~cluster)
    return "\n".join(line.text for line, yes in zip(page.lines, chosen, strict=True) if yes)


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): each page's main text, empty for a null or empty html or a page without any.

    Repeated rows and null ids give a row each; other columns are left out; an empty table gives none.
    """

    def prepare():
        def one(html: str) -> tuple:
            text = extract(html)
            return text, len(text)

        return one

    fields = per_text(prepare, "text string, n_chars bigint")
    return pages.select("page_id", "url", fields(F.col("html")).alias("_fields")).select("page_id", "url", "_fields.text", "_fields.n_chars")


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))

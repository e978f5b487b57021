"""Main text of web pages (operator 8): flat blocks classified by a decision tree.

A page is read once from left to right. Block elements cut its text into blocks; a block knows its
words, the share of them in links, whether it stands in an article or in one of the kinds of element
that hold no article text (by element name, role, or a whole class or id), whether the page has an
article elsewhere, and whether it is a heading. Each block is classified by its own measures and the
word count and link density of its neighbours. The tree is grown from PAGES, a small table of blocks
labelled by hand in the order of their pages, whenever a query begins.

Class names count as whole names ("sidebar", "site-footer", "comment-list"), so "has-sidebar" or "ad-hoc"
say nothing; those of article, main and body elements are not read, but for "comment". Within an article
nothing is dropped but what stands in an aside, a form, a notice and the like: lists of links, formulas
and buttons stay.

Defined results: a null or empty page has no text; tags that aren't closed end with the element around
them; script, style, title and textarea without an end tag run to the end of the page, other elements
without one are read as text; self-closed elements are empty; a ``<`` that opens no tag is text; repeated
rows are treated alike; other columns pass through; no page is cut.
"""

from __future__ import annotations

import html
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import appended

FEATURES = ("aside", "inside", "outside", "words", "density", "words_before", "density_before", "words_after", "density_after", "heading")
#: Pages labelled by hand: (words, share of words in links, heading, where it stands, whether it belongs to
#: the article) of each block. Where: "-" nothing said, "m" in an article, "a" in an element without article
#: text, "b" in one inside an article.
PAGES: tuple[tuple[tuple[float, float, int, str, int], ...], ...] = (
    # an article element between menu, advert and footer
    ((1, 1, 0, "a", 0), (2, 1, 0, "a", 0), (1, 1, 0, "a", 0), (9, 0, 0, "a", 0), (11, 0, 1, "m", 1), (60, 0, 0, "m", 1), (4, 0, 0, "m", 1), (120, 0.05, 0, "m", 1), (10, 0, 0, "a", 0)),
    # lists of links, one-word blocks and an aside inside the article
    ((2, 1, 0, "a", 0), (8, 0, 1, "m", 1), (40, 0.1, 0, "m", 1), (2, 0, 1, "m", 1), (3, 1, 0, "m", 1), (6, 1, 0, "m", 1), (1, 1, 0, "m", 1), (25, 0, 0, "b", 0), (1, 0, 0, "m", 1), (70, 0, 0, "m", 1), (5, 0.8, 0, "m", 1), (40, 0, 0, "b", 0), (3, 0, 1, "b", 0)),
    ((3, 1, 0, "m", 1), (1, 0, 0, "m", 1), (1, 0, 1, "m", 1), (2, 1, 0, "m", 1), (4, 0, 0, "m", 1), (1, 1, 0, "m", 1), (1, 0, 0, "m", 1), (3, 1, 0, "a", 0)),
    # an article element of a few words, and long texts outside it
    ((45, 0, 0, "-", 0), (3, 1, 0, "-", 0), (4, 0, 1, "m", 1), (9, 0, 0, "m", 1), (2, 0.5, 0, "m", 1), (60, 0, 0, "-", 0), (90, 0.1, 0, "-", 0), (5, 0, 1, "-", 0), (300, 0, 0, "a", 0)),
    # no article element: menu, text, footer
    ((1, 1, 0, "-", 0), (2, 1, 0, "-", 0), (3, 1, 0, "-", 0), (7, 0, 1, "-", 1), (60, 0, 0, "-", 1), (4, 0, 1, "-", 1), (80, 0.05, 0, "-", 1), (5, 0, 0, "-", 1), (70, 0, 0, "-", 1), (2, 1, 0, "-", 0), (1, 1, 0, "-", 0), (6, 0, 0, "-", 0)),
    ((2, 1, 0, "-", 0), (2, 1, 0, "-", 0), (5, 0, 1, "-", 1), (4, 0, 0, "-", 1), (35, 0, 0, "-", 1), (6, 1, 0, "-", 1), (50, 0, 0, "-", 1), (18, 0.3, 0, "-", 1), (9, 0, 0, "-", 1), (45, 0, 0, "-", 1), (3, 1, 0, "-", 0), (2, 1, 0, "-", 0), (4, 0, 0, "-", 0)),
    # a short text beside a menu
    ((1, 1, 0, "-", 0), (1, 1, 0, "-", 0), (6, 0, 1, "-", 1), (22, 0, 0, "-", 1), (14, 0, 0, "-", 1), (3, 1, 0, "-", 0), (5, 0, 0, "-", 0)),
    ((1, 1, 0, "a", 0), (3, 0, 0, "-", 1), (2, 0, 0, "a", 0)),
    ((2, 1, 0, "a", 0), (2, 1, 0, "a", 0), (3, 0, 1, "-", 1), (10, 0, 0, "-", 1), (8, 0, 0, "-", 1), (6, 0, 0, "a", 0)),
    ((2, 1, 0, "-", 0), (1, 1, 0, "-", 0), (25, 0, 0, "-", 1), (8, 0, 0, "-", 1), (6, 0, 0, "a", 0), (1, 1, 0, "a", 0)),
    # nothing but text
    ((3, 0, 0, "-", 1),),
    ((2, 0, 1, "-", 1), (5, 0, 0, "-", 1)),
    ((4, 0, 1, "-", 1), (12, 0, 0, "-", 1), (3, 0, 0, "-", 1), (9, 0, 0, "-", 1)),
    ((200, 0, 0, "-", 1), (150, 0.02, 0, "-", 1), (1, 0, 0, "-", 1)),
    # nothing but links, and headings over links
    ((2, 1, 0, "-", 0), (4, 1, 0, "-", 0), (3, 1, 0, "-", 0)),
    ((2, 0, 1, "-", 0), (3, 1, 0, "-", 0), (5, 1, 0, "-", 0), (2, 0, 1, "-", 0), (12, 0.9, 0, "-", 0), (10, 1, 0, "-", 0), (20, 0.8, 0, "-", 0), (4, 1, 0, "-", 0)),
    # text, then other texts announced by links
    ((8, 0, 1, "-", 1), (90, 0, 0, "-", 1), (110, 0, 0, "-", 1), (2, 0, 1, "-", 0), (9, 1, 0, "-", 0), (11, 1, 0, "-", 0), (8, 1, 0, "-", 0), (2, 1, 0, "-", 0), (7, 0, 0, "-", 0)),
    # sidebars and comments beside a text, by what stands around them
    ((6, 0, 1, "-", 1), (75, 0, 0, "-", 1), (20, 0, 0, "-", 1), (60, 0, 0, "a", 0), (4, 0, 1, "a", 0), (25, 0, 0, "a", 0), (3, 1, 0, "a", 0), (30, 0, 0, "-", 1), (120, 0, 0, "a", 0), (5, 0, 0, "a", 0)),
)

#: Their content is never text of a page; the first four run to the end of a page that doesn't close them.
RAW = frozenset("script style title textarea template noscript iframe select canvas audio video svg".split())
TO_THE_END = frozenset(("script", "style", "title", "textarea"))
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][\w:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+>|<(?P<tag2>[a-zA-Z][\w:-]*)[^>]*+>|(?P<text><?[^<]++|<)",
    re.DOTALL,
)
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ASIDE = frozenset("nav header footer aside form menu dialog fieldset".split())
ASIDE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status".split())
#: What class and id names of elements without article text end in, once WRAPPERS are taken off.
ASIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising breadcrumb breadcrumbs comment comments consent cookie cookies disqus disclaimer footer gdpr "
    "header login masthead menu modal nav navbar navigation newsletter notice notices notification notifications pager pagination paywall popup promo promos "
    "promoted promotion recommendations recommended related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe subscription "
    "tagcloud toolbar widget widgets".split()
)
WRAPPERS = frozenset("area articles banner bar block body bottom box buttons cloud container content form group holder inner item items left links list main outer panel posts primary right row secondary section slot stories thread top unit wrap wrapper".split())
#: Names that begin so tell what an element has or does, not what it is.
STATES = frozenset("has hide is js no not show toggle with without".split())
MAIN_NAMES = frozenset("article maincontent main-content article-body article-content entry-content post-content story-body".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a b i em strong u small font sup sub".split())
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.IGNORECASE)
SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/$")


def names_aside(name: str) -> bool:
    """Whether a class or id, taken whole, is that of an element without article text."""
    parts = re.sub(r"([a-z0-9])([A-Z])", r"\1-\2", name).lower().split("--")[0]
    parts = [p for p in re.split(r"[-_]+", parts) if p]
    if not parts or parts[0] in STATES:
        return False
    while len(parts) > 1 and (parts[-1] in WRAPPERS or parts[-1].isdigit()):
        parts.pop()
    return parts[-1] in ASIDE_NAMES


def kinds(tag: str, attrs: str, in_main: bool) -> tuple[bool, bool]:
    """(aside, main) as an element's name and attributes tell."""
    aside, main = tag in ASIDE and not (tag == "header" and in_main), tag in ("article", "main")
    if "=" not in attrs or tag in ("html", "body"):
        return aside, main
    for m in ATTRIBUTE.finditer(attrs):
        for name in (m[2] or m[3] or m[4] or "").split():
            if m[1].lower() == "role":
                aside = aside or (not main and name.lower() in ASIDE_ROLES)
                main = main or name.lower() in ("main", "article")
            elif main:
                aside = aside or (tag == "article" and name.lower() in ("comment", "comments"))
            elif name.lower() in MAIN_NAMES:
                main = True
            elif not aside and names_aside(name):
                aside = not (in_main and re.split(r"[-_]", name.lower())[-1] == "header")
    return aside, main and not (aside and tag != "article" and tag != "main")


Block = tuple[str, int, float, bool, bool, bool]


def blocks(page: str) -> list[Block]:
    """(text, words, share of words in links, aside, main, heading) of each block with text, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # name, aside, main: of the element and those around it
    opened: dict[str, int] = {}
    parts: list[str] = []
    unclosed: set[str] = set()
    linked, links, heading, at = 0, 0, False, 0

    def close() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            n = text.count(" ") + 1
            _, aside, main = stack[-1] if stack else ("", False, False)
            out.append((text, n, min(1.0, linked / n), aside, main, heading))
        linked = 0

    def pop() -> str:
        name = stack.pop()[0]
        opened[name] -= 1
        return name

    last = page.rfind(">")
    while at < len(page):
        if at > last:  # no tag ends any more
            rest = page[at:].partition("<!--")[0]
            parts.append(rest)
            linked += len(html.unescape(rest).split()) if links else 0
            break
        m = TOKEN.match(page, at)
        at = m.end()
        text = m["text"]
        if text is not None:
            parts.append(text)
            if links:
                linked += len(html.unescape(text).split())
            continue
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag, attrs = tag.lower(), m["attrs"] or ""
        closed = attrs.endswith("/") and SELF_CLOSED.search(attrs) is not None
        if tag in RAW:
            if m["end"] or closed or tag in unclosed:
                continue
            end = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, at)
            if end:
                at = end.end()
            elif tag in TO_THE_END:
                at = len(page)
            else:
                unclosed.add(tag)
            continue
        if tag == "a":
            links = 0 if m["end"] else 1
        elif tag == "br":
            parts.append(" ")
        if tag in BLOCKS:
            close()
            if not m["end"]:
                heading = tag in HEADINGS
            elif tag in HEADINGS:
                heading = False
        if tag in VOID or tag in INLINE:
            continue
        if m["end"]:
            if opened.get(tag):
                while pop() != tag:
                    pass
            continue
        if tag in BLOCKS:
            links = 0
        if tag in ("p", "li", "td", "th", "tr", "dd", "dt") and stack and stack[-1][0] == tag:
            pop()
        elif tag in BLOCKS and stack and stack[-1][0] in ("p", "span"):
            while stack and stack[-1][0] in ("p", "span"):
                pop()
        if closed:
            continue
        _, aside, main = stack[-1] if stack else ("", False, False)
        a, b = kinds(tag, attrs, main)
        stack.append((tag, aside or a, main or b))
        opened[tag] = opened.get(tag, 0) + 1
    close()
    return out


def features(found: Sequence[Block]) -> np.ndarray:
    n = len(found)
    words = np.zeros(n + 2)
    density = np.zeros(n + 2)
    words[1:-1], density[1:-1] = [x[1] for x in found], [x[2] for x in found]
    aside, main, heading = (np.array([x[i] for x in found], float) for i in (3, 4, 5))
    inside = (main == 1) & (aside == 0)
    return np.column_stack([aside, inside, ~inside & inside.any(), words[1:-1], density[1:-1], words[:-2], density[:-2], words[2:], density[2:], heading])


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of PAGES; a page's blocks all belong to the text where an article holds them all."""
    held = [tuple((w, d, h, "m", 1) for w, d, h, _, _ in p) for p in PAGES]
    pages = [[("", w, d, where in "ab", where in "mb", bool(h)) for w, d, h, where, _ in p] for p in [*PAGES, *held]]
    return np.concatenate([features(p) for p in pages]), np.array([float(b[4]) for p in [*PAGES, *held] for b in p])


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 1):
    """A tree by Gini impurity: the share of 1 in a leaf, or (feature, bound, at most, above)."""
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return float(y.mean())
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        k = np.flatnonzero(v[1:] > v[:-1]) + 1
        k = k[(k >= least) & (k <= len(y) - least)]
        if not len(k):
            continue
        p, q = ones[k - 1] / k, (ones[-1] - ones[k - 1]) / (len(y) - k)
        cost = k * p * (1 - p) + (len(y) - k) * q * (1 - q)
        i = int(np.argmin(cost))
        if best is None or cost[i] < best[0] - 1e-9:
            best = (cost[i], f, (v[k[i] - 1] + v[k[i]]) / 2)
    if best is None:
        return float(y.mean())
    _, f, bound = best
    low = x[:, f] <= bound
    return f, bound, grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)


def trained():
    return grow(*labelled())


def classify(tree, x: np.ndarray) -> np.ndarray:
    """Whether each row belongs to the article."""
    if isinstance(tree, float):
        return np.full(len(x), tree >= 0.5)
    f, bound, low, high = tree
    below = x[:, f] <= bound
    out = np.empty(len(x), bool)
    out[below], out[~below] = classify(low, x[below]), classify(high, x[~below])
    return out


def main_text(page: str | None, tree) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    kept = classify(tree, features(found))
    return "\n".join(b[0] for b, k in zip(found, kept, strict=True) if k)


def extract(df: DataFrame, page: str = "html", out: str = "text") -> DataFrame:
    """df with the string column out: the main text of the column page."""
    tree = trained()

    def make():
        return lambda pages: [pa.array([main_text(p, tree) for p in pages.to_pylist()], pa.string())]

    return appended(df, make, [page], [(out, T.StringType())])

"""Main text of web pages by tree scoring.

The page's tags are read into a tree, however badly they nest. Every paragraph-like block passes
points (for its length and its commas) to its ancestors, halved with each step up; a container's
points are discounted by the share of its text that stands in links. The best container is kept, or
the article element around it, and those of its siblings that score near it, hold the heading or are
running text themselves, with bare text between them. All sums go up the tree in one pass, so time is
linear in the page, however deep it nests.

What is kept loses menus, headers, footers, sidebars, notices, adverts, forms and comments on its way
out. Elements and roles that mean these go. Class names and ids are evidence only: a name without
another sense (`cookie-notice`) drops an element that doesn't hold the article or most of the page; one
with other words in it (`tags-intro`) lowers a score, and drops only what is mostly links or has controls.

Text: character references are decoded, white space inside a block becomes one space, blocks are
trimmed and joined in page order by one space; nothing is capped.

Cases: null or empty html gives an empty text; text without any tags is one block; unclosed,
misnested and cut-off tags are read as far as they go; of equal containers the first in the page is
the best; pages of any length and depth are read whole; repeated rows stay; columns besides
page_id, url, html are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches

# Names of HTML elements by their role, and words by which page builders name
# the parts of a page that are not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object select xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr label img".split())
DROPPED = frozenset("nav footer aside form button dialog menu head fieldset canvas audio video select option datalist applet".split()) | RAW
PARAGRAPHS = frozenset("p pre td blockquote li dd dt h1 h2 h3 h4 h5 h6 figcaption".split())
CLOSES_P = frozenset("address article aside blockquote center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table ul".split())
ALIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUNDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
# Words that name what is no part of an article; words that name comments; words that say nothing by
# themselves; words that name the article.
UNLIKELY = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus discussion donate "
    "footer form gdpr header hidden login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup privacy promo promoted promotion "
    "related remark recommendations recommended replies reply responses rss share sharing shoutbox sidebar signup skip social sponsor sponsored sponsors subscribe subscription tag tags tagcloud teaser toolbar topbar tracking widget widgets".split()
)
COMMENTS = frozenset("comment comments commentlist disqus reply replies responses".split())
NEUTRAL = frozenset("area aside bar block body bottom box btn button buttons col column container footer global group holder icons inner item items left link links list main module outer panel primary right row secondary section site slot top unit user wrap wrapper".split())
LIKELY = frozenset("article content entry hentry page post story text blog".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar status".split())
CONTROLS = frozenset("input button textarea select".split())

# A quote opens a value only after an equals sign; without one a value goes on to white space or the tag's end.
_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|$)|'[^']*+(?:'|$)|[^\s>]*+))*+)(?:>|$)", re.S)
_ATTR = re.compile(r"([^\s/=>][^\s/=>]*)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|$)", re.I) for t in RAW}


class Node:
    """An element. size and linked: its characters, and those of them in links; core: whether it holds the
    page's heading or an article; doubt: 2 if its name says that it is no part of an article, 1 if it hints so."""

    __slots__ = ("tag", "parent", "items", "out", "bonus", "doubt", "link", "size", "linked", "core", "controls", "score")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.items, self.out = tag, parent, [], False
        self.bonus, self.doubt, self.link, self.score = 0.0, 0, False, 0.0
        self.size = self.linked = self.controls = 0
        self.core = False

    def share(self) -> float:
        """The share of its text that stands in links."""
        return self.linked / self.size if self.size else 0.0


def _doubt(token: str, tag: str) -> int:
    """What one class name or id says: 2 if it has no other sense, 1 if its words can mean anything else."""
    words = {w.lower() for w in _WORD.findall(token)}
    bad = words & (COMMENTS if tag == "article" else UNLIKELY)
    if words & LIKELY:
        bad = bad - {"header", "hidden", "form"}
    if not bad:
        return 0
    return 2 if words <= UNLIKELY | NEUTRAL | LIKELY else 1


def _judge(node: Node, attrs: str) -> None:
    """What the element's name and attributes say of it."""
    tag = node.tag
    node.out, node.bonus = tag in DROPPED, {"article": 25.0, "main": 15.0, "section": 2.0}.get(tag, 0.0)
    if not attrs or attrs.isspace():
        return
    given: dict[str, str | None] = {}
    for m in _ATTR.finditer(attrs):
        given.setdefault(m[1].lower(), next((x for x in m.groups()[1:] if x is not None), None))  # the first of a name counts
    node.link = tag == "a" and "href" in given
    if tag in ("body", "html"):
        return
    names = [t for k in ("class", "id") for t in unescape(given.get(k) or "").split()]
    if tag != "main":
        node.doubt = max((_doubt(t, tag) for t in names), default=0)
    if node.doubt:
        node.bonus -= 10.0
    elif any(w.lower() in LIKELY for t in names for w in _WORD.findall(t)):
        node.bonus += 10.0
    node.out |= "hidden" in given or (given.get("role") or "").lower() in ROLES or (given.get("aria-hidden") or "").lower() == "true"
    node.out |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", given.get("style") or "", re.I))


def parse(html: str) -> list[Node]:
    """The page's elements, each after its parent; the first is the root. Raw-text elements keep no content;
    stray end tags are passed over; only elements that never hold anything end with their own tag."""
    root = Node("#root", None)
    nodes = [root]
    at, here, open_tags = 0, root, {}
    size = len(html)
    while at < size:
        m = _TAG.search(html, at)
        if m is None:
            here.items.append(html[at:])
            break
        if m.start() > at:
            here.items.append(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if not tag:
            if m[0].startswith("<![CDATA["):
                here.items.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m[1]:
            if open_tags.get(tag):
                node = here
                while node.tag != tag:
                    open_tags[node.tag] -= 1
                    node = node.parent
                open_tags[tag] -= 1
                here = node.parent
            continue
        if tag in CLOSES_P and open_tags.get("p"):
            here = _close(here, {"p"}, {"#root", "table", "td", "th", "button", "object"}, open_tags)
        if tag in ALIKE and any(open_tags.get(t) for t in ALIKE[tag]):
            here = _close(here, ALIKE[tag], BOUNDS[tag], open_tags)
        node = Node(tag, here)
        _judge(node, m[3])
        # a header of the page is none of the article's; one inside the article holds its title
        node.out |= tag == "header" and not open_tags.get("article") and not open_tags.get("main")
        here.items.append(node)
        nodes.append(node)
        if tag in RAW:
            end = _RAW_END[tag].search(html, at)
            if end is None:
                if tag in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp"):
                    at = size  # it never ends
                continue
            at = html.find(">", end.end())
            at = size if at < 0 else at + 1
        elif tag not in VOID:
            open_tags[tag] = open_tags.get(tag, 0) + 1
            here = node
    return nodes


def _close(here: Node, tags: set[str], bounds: set[str], open_tags: dict[str, int]) -> Node:
    """Closes the nearest open element of these tags, if no bound stands in between."""
    node = here
    while node.parent is not None and node.tag not in bounds:
        if node.tag in tags:
            while here is not node:
                open_tags[here.tag] -= 1
                here = here.parent
            open_tags[node.tag] -= 1
            return node.parent
        node = node.parent
    return here


def blocks(node: Node) -> list[tuple[str, Node]]:
    """The text blocks below node, in order, with the block element each stands in."""
    found: list[tuple[str, Node]] = []
    piece: list[str] = []

    def flush(owner: Node) -> None:
        if piece:
            text = " ".join(unescape("".join(piece)).split())
            piece.clear()
            if text:
                found.append((text, owner))

    stack: list[tuple[Node, int, Node]] = [(node, 0, node)]
    while stack:
        here, i, owner = stack.pop()
        if i == len(here.items):
            if here is owner:
                flush(owner)
            continue
        stack.append((here, i + 1, owner))
        x = here.items[i]
        if isinstance(x, str):
            piece.append(x)
        elif x.out:
            if x.tag not in INLINE:
                flush(owner)
        elif x.tag == "br":
            piece.append(" ")
        elif x.tag in INLINE:
            stack.append((x, 0, owner))
        else:
            flush(owner)
            stack.append((x, 0, x))
    return found


def measure(nodes: list[Node]) -> None:
    """size, linked, core and controls of every element, from what isn't out. One pass, children first."""
    for node in nodes:
        node.size = sum(len(x) for x in node.items if isinstance(x, str) and not x.isspace())
        node.linked, node.core, node.controls = 0, node.tag in ("article", "main", "h1"), int(node.tag in CONTROLS)
    for node in reversed(nodes):
        if node.link:
            node.linked = node.size
        up = node.parent
        if up is not None:
            up.controls += node.controls  # a dropped form's controls tell of what holds it, too
            if not node.out:
                up.size += node.size
                up.linked += node.linked
                up.core |= node.core


def drop_doubtful(nodes: list[Node]) -> None:
    """Leaves out what is named as no part of an article, where its structure agrees.

    A name without any other sense stands unless the element holds the article or most of the page's
    text; one that hints takes links for half of the text, or controls to fill in. A form that holds the
    article is kept, but for its controls.
    """
    measure(nodes)
    for node in nodes:
        if node.tag == "form" and node.core:
            node.out = False
    measure(nodes)
    whole = nodes[0].size
    for node in nodes:
        if node.doubt == 2:
            node.out |= not node.core and (2 * node.size <= whole or node.share() >= 0.5 or node.controls > 0 or node.tag == "article")
        elif node.doubt == 1:
            node.out |= not node.core and (node.share() >= 0.5 or node.controls > 0)
    measure(nodes)


def weigh(nodes: list[Node], found: list[tuple[str, Node]]) -> None:
    """score of every element: points of the text blocks below it, halved with each step up, and its bonus.

    One pass, children first: what an element hands on is half of what it has, whatever it holds.
    """
    for node in nodes:
        node.score = 0.0
    for text, owner in found:
        if len(text) >= 25 or owner.tag in PARAGRAPHS:
            points = 1.0 + text.count(",") + text.count("，") + min(len(text) / 100, 3.0)
            to = owner.parent if owner.tag in PARAGRAPHS and owner.parent is not None else owner
            to.score += points
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.score += node.score / 2
        if node.score:
            node.score += node.bonus


def _units(parent: Node) -> list[list]:
    """The children of an element: a block each, or a run of bare text and inline elements."""
    units: list[list] = []
    for x in parent.items:
        inline = isinstance(x, str) or x.tag in INLINE
        if not inline and x.out:
            continue
        if inline and units and units[-1][0] is None:
            units[-1][1].append(x)
        else:
            units.append([None, [x]] if inline else [x, [x]])
    return units


def _texts(items: list) -> list[str]:
    """The text blocks of some items of one element."""
    holder = Node("#some", None)
    holder.items = items
    return [t for t, _ in blocks(holder)]


def _beside(unit: list, top: float) -> bool:
    """Whether a sibling of the best container belongs to the article."""
    node, items = unit
    size = sum(len(x) if isinstance(x, str) and not x.isspace() else 0 if isinstance(x, str) or x.out else x.size for x in items)
    linked = sum(0 if isinstance(x, str) or x.out else x.linked for x in items)
    if not size:
        return False
    if node is not None and node.score * (1 - node.share()) >= max(10.0, 0.2 * top):
        return True
    if linked >= 0.25 * size or node is not None and node.doubt:
        return False
    if node is not None and (node.core or node.tag in ("h1", "h2", "h3", "h4", "h5", "h6")):
        return linked == 0
    text = " ".join(_texts(items))
    return len(text) > 80 or linked == 0 and re.search(r"[.!?…。！？][\"'”’»)]*( |$)", text) is not None


def main_text(html: str | None) -> str:
    if not html:
        return ""
    nodes = parse(html)
    drop_doubtful(nodes)
    found = blocks(nodes[0])
    if not found:
        return ""
    weigh(nodes, found)
    best, top = nodes[0], float("-inf")
    gone: set[int] = set()
    for node in nodes:  # the first of equals
        if node.out or node.parent is not None and id(node.parent) in gone:
            gone.add(id(node))
        elif node.score and (worth := node.score * (1 - node.share())) > top:
            best, top = node, worth
    if best.tag in PARAGRAPHS and best.parent is not None:
        best = best.parent
    node = best
    while node is not None and node.tag != "article":
        node = node.parent
    best = node or best  # the whole of the article that holds the best container
    if best.parent is None or best.tag in ("main", "body"):
        return " ".join(t for t, _ in blocks(best))
    if best.tag == "article":
        kept = [[x, [x]] for x in best.parent.items if x is best or not isinstance(x, str) and x.tag == "article" and not x.out and x.score * (1 - x.share()) >= max(30.0, 0.5 * top)]
    else:
        units = _units(best.parent)
        near = [unit[0] is best or _beside(unit, top) for unit in units]
        first, last = near.index(True), len(near) - 1 - near[::-1].index(True)
        # bare text between parts of the article is the article's too
        kept = [u for i, u in enumerate(units) if near[i] or u[0] is None and first < i < last]
    return " ".join(t for _, items in kept for t in _texts(items))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) for every row of pages."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for htmls in batches:
            yield pd.Series([main_text(h) for h in htmls], dtype=object)

    short_batches(pages.sparkSession)
    texts = pages.select("page_id", "url", F.pandas_udf(run, "string")("html").alias("text"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))

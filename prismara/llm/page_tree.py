"""Pages as trees of blocks: tags are read leniently, and texts become the leaves.

Inline tags belong to the text they stand in. Scripts, styles, comments and other content that is not shown
leave nothing. Every step is linear in the page: no pattern is tried again from a place that it has passed.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

TAG = re.compile(
    r"<!--(?:-?>|.*?(?:-->|--!>|\Z))"
    r"|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)(?:>|(?=<)|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.DOTALL,
)
NAMING = re.compile(r"(?<![^\s\"'/])(class|id|role|itemprop|style|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?(?![\w-])", re.IGNORECASE)
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
LETTERS = re.compile(r"[a-z]+")

INLINE = frozenset("a abbr acronym b bdi bdo big blink cite code data del dfn em font i ins kbd label mark nobr output q rb rp rt rtc ruby s samp small span strike strong sub sup time tt u var".split())
VOID = frozenset("area base basefont bgsound col embed frame img input keygen link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
UNSEEN = frozenset("button select svg math canvas object audio video noscript template dialog map applet datalist meter progress".split())
PLAIN = frozenset("html body head".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTED = HEADINGS | frozenset("p li tr td th dt dd option pre blockquote figure figcaption caption tbody thead tfoot".split())
#: What an opening tag ends, if nothing of the second set lies between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
#: Names by which parts beside an article go.
BESIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising alert aside banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright dialog disqus foot footer form gdpr hidden login masthead menu modal nav navbar "
    "navigation newsletter notice overlay pager pagination popup promo promotion recommendations recommended related replies reply respond search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
DEPTH = 100


@dataclass(slots=True)
class Node:
    """An element, or a text (key ``#``). ``texts`` are numbers of the page's texts, ``stats`` what a host's pages have at a text."""

    key: str
    kids: list[Node] = field(default_factory=list)
    optional: bool = False
    repeated: bool = False
    texts: list[int] = field(default_factory=list)
    stats: list | None = None

    @property
    def tag(self) -> str:
        return self.key.partition(".")[0]

    @property
    def names(self) -> set[str]:
        return set(self.key.split(".")[1:])


@dataclass(slots=True)
class Page:
    root: Node
    texts: list[str]
    linked: list[float]  # share of each text that stands in links


def named(tag: str, attributes: str) -> str:
    """``tag`` with the words of its class, id and role, sorted."""
    words: set[str] = set()
    for name, value in NAMING.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE)):
            words.add("hidden")
        elif name not in ("style", "aria-hidden"):
            words.update(LETTERS.findall(HUMP.sub(" ", value).lower()))
    return ".".join([tag, *sorted(words)])


class _Reader:
    def __init__(self) -> None:
        self.page = Page(Node("page"), [], [])
        self.stack: list[tuple[str, Node]] = [("page", self.page.root)]
        self.open: Counter[str] = Counter()
        self.buffer: list[str] = []
        self.in_link = False
        self.chars = self.link_chars = 0

    def text(self, piece: str) -> None:
        self.buffer.append(piece)
        n = len(piece.strip())
        self.chars += n
        self.link_chars += n if self.in_link else 0

    def flush(self) -> None:
        if self.buffer:
            whole = " ".join(unescape("".join(self.buffer)).split())
            if whole:
                self.stack[-1][1].kids.append(Node("#", texts=[len(self.page.texts)]))
                self.page.texts.append(whole)
                self.page.linked.append(self.link_chars / max(self.chars, 1))
            self.buffer.clear()
        self.in_link, self.chars, self.link_chars = False, 0, 0

    def push(self, tag: str, attributes: str) -> None:
        self.flush()
        if self.stack[-1][0] == "p" or (self.stack[-1][0] in HEADINGS and tag in HEADINGS):
            self.pop()
        if tag in ENDS:
            ended, between = ENDS[tag]
            if any(self.open[x] for x in ended):
                at = len(self.stack) - 1
                while at > 0 and self.stack[at][0] not in ended and self.stack[at][0] not in between:
                    at -= 1
                if self.stack[at][0] in ended:
                    while len(self.stack) > at:
                        self.pop()
        above = self.stack[-1][1]
        if len(self.stack) < DEPTH:
            node = Node(named(tag, attributes) if attributes else tag)
            above.kids.append(node)
        else:
            node = above
        self.stack.append((tag, node))
        self.open[tag] += 1

    def pop(self) -> None:
        self.open[self.stack.pop()[0]] -= 1

    def close(self, tag: str) -> None:
        self.flush()
        if self.open[tag] and (tag != "p" or self.stack[-1][0] == "p"):
            while self.stack[-1][0] != tag:
                self.pop()
            self.pop()


def read_page(html: str) -> Page:
    """The page's tree, its texts in their order and how much of each is linked.

    Character references are decoded and white space becomes single spaces. Elements without text are left out. Elements
    deeper than 100 belong to the one above them, with their texts.
    """
    reader, at, size = _Reader(), 0, len(html)
    hidden, inner = "", Counter()  # an element that is not shown, and what has been opened in it
    unclosed: set[str] = set()
    while at < size:
        found = html.find("<", at)
        if found < 0:
            found = size
        if found > at and not hidden:
            reader.text(html[at:found])
        if found == size:
            break
        match = TAG.match(html, found)
        if match is None:  # a sign and no tag
            if not hidden:
                reader.text("<")
            at = found + 1
            continue
        at = match.end()
        tag = (match[2] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(match[1]), match[3]
        if not closing and tag in RAW and tag not in unclosed:
            end = re.compile(f"</{tag}(?![a-z])", re.IGNORECASE).search(html, at)
            if end is not None:
                at = end.start()
            elif tag in ("script", "style", "xmp"):
                at = size
            else:
                unclosed.add(tag)
            continue
        if tag in RAW or tag in VOID or tag in PLAIN:
            continue
        if hidden:
            if not closing:
                inner[tag] += not attributes.endswith("/")
            elif inner[tag]:
                inner[tag] -= 1
                if tag == hidden and not inner[tag]:
                    hidden = ""
                continue
            elif reader.open[tag]:
                hidden = ""
                reader.close(tag)
            continue
        if tag == "br":
            reader.text(" ")
        elif tag == "hr":
            reader.flush()
        elif tag in UNSEEN or (tag in INLINE and not closing and attributes and BESIDE & set(named(tag, attributes).split(".")[1:])):
            if not closing and not attributes.endswith("/"):
                hidden, inner = tag, Counter([tag])
        elif tag in INLINE:
            if tag == "a":
                reader.in_link = not closing
        elif closing:
            reader.close(tag)
        else:
            reader.push(tag, attributes)
    reader.flush()
    _prune(reader.page.root)
    return reader.page


def _prune(node: Node) -> bool:
    node.kids = [k for k in node.kids if k.key == "#" or _prune(k)]
    return bool(node.kids)

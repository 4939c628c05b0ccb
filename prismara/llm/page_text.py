"""Main text of pages by wrappers: union-free regular expressions inferred from the pages of a host.

A wrapper is a tree of elements in which each may be optional or repeated, with slots where texts stand. Two of them are
aligned level by level; what does not match is resolved into a repeated group, where the neighbour is of the same kind, or into an
optional one. A page is a wrapper without optional parts, so pages and wrappers are aligned alike and in any grouping. Slots carry what the
host's pages have there: how much text, how much of it linked, and whether it is always the same. A page's texts are
then judged by the slots that they fall into.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, spread_join
from .page_tree import BESIDE, HEADINGS, LISTED, Node, Page, read_page

FAN = 16
LONGEST, RUN = 48, 4
#: Different pages that must agree on a text before it counts as the template's.
AGREED = 3
VARIED = -1
SHAPES = "host string, shape string, stats string, pages long"
UNSHOWN = frozenset("nav header footer aside form fieldset".split())
BODIES = frozenset("article post entry story content main".split())


# ---- folding and alignment


def _kinds(node: Node) -> frozenset[str]:
    return frozenset(k.key for k in node.kids)


def likeness(a: Node, b: Node) -> float:
    """0 where two nodes cannot be the same part of a template, else 1 to 2 by what they have in common below."""
    if a.key != b.key:
        return 0.0
    x, y = _kinds(a), _kinds(b)
    return 2.0 if x == y else 1 + len(x & y) / len(x | y)


def _alike(a: Node, b: Node) -> bool:
    return a.key == b.key and (a.key == "#" or a.tag in LISTED or likeness(a, b) >= 1.6)


def _joined(a: list | None, b: list | None, same_page: bool) -> list | None:
    """Stats [pages, hash, chars, linked chars, least page hashes] of two slots that become one."""
    if a is None or b is None:
        return a or b
    text = a[1] if a[1] == b[1] and not same_page else VARIED
    return [max(a[0], b[0]) if same_page else a[0] + b[0], text, a[2] + b[2], a[3] + b[3], sorted({*a[4], *b[4]})[:AGREED]]


def merged(a: Node, b: Node, same_page: bool = False) -> Node:
    """What both nodes are instances of. ``same_page``: they are two rounds of one repeated part."""
    kids = [] if a.key == "#" else aligned(a.kids, b.kids, same_page)
    return Node(a.key, kids, a.optional or b.optional, a.repeated or b.repeated, a.texts + b.texts, _joined(a.stats, b.stats, same_page))


def round_of(a: Node, b: Node) -> Node:
    """``b`` as one round more of ``a``; optional where a page may have neither."""
    both = merged(a, b, True)
    both.optional, both.repeated = a.optional and b.optional, True
    return both


def matched(a: list[Node], b: list[Node]) -> list[tuple[int | None, int | None]]:
    """The alignment of two rows of nodes with the greatest likeness, unmatched ones in their order."""
    if len(a) == len(b) and all(x.key == y.key for x, y in zip(a, b, strict=True)) and (len(a) < 2 or len({x.key for x in a}) == len(a)):
        return [(i, i) for i in range(len(a))]
    best = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(len(b) - 1, -1, -1):
            w = likeness(a[i], b[j])
            row[j] = max(below[j], row[j + 1], below[j + 1] + w if w else 0.0)
    i = j = 0
    out: list[tuple[int | None, int | None]] = []
    while i < len(a) and j < len(b):
        w = likeness(a[i], b[j])
        if w and best[i][j] == best[i + 1][j + 1] + w:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            out.append((i, None))
            i += 1
        else:
            out.append((None, j))
            j += 1
    return [*out, *((k, None) for k in range(i, len(a))), *((None, k) for k in range(j, len(b)))]


def aligned(a: list[Node], b: list[Node], same_page: bool = False) -> list[Node]:
    out: list[Node] = []
    for i, j in matched(a, b):
        if i is not None and j is not None:
            out.append(merged(a[i], b[j], same_page))
            continue
        lone = a[i] if i is not None else b[j]
        if out and _alike(out[-1], lone):  # one round more than the other has
            out[-1] = round_of(out[-1], lone)
        else:
            lone.optional = True
            out.append(lone)
    return looped(squared(out))


def squared(row: list[Node]) -> list[Node]:
    """Neighbours of the same kind as one repeated node: always for parts of lists and running text, for others from four on."""
    out: list[Node] = []
    at = 0
    while at < len(row):
        end = at + 1
        while end < len(row) and _alike(row[end - 1], row[end]):
            end += 1
        listed = row[at].key == "#" or row[at].tag in LISTED
        if end - at >= (2 if listed else RUN):
            one = row[at]
            for other in row[at + 1 : end]:
                one = round_of(one, other)
            out.append(one)
        else:
            out += row[at:end]
        at = end
    return out


def looped(row: list[Node]) -> list[Node]:
    """Rows beyond ``LONGEST`` become rounds of optional parts, one of each kind, by their first place: any order of them fits."""
    if len(row) <= LONGEST:
        return row
    for strict in (True, False):
        kinds: dict[object, Node] = {}
        for node in row:
            kind = (node.key, _kinds(node) if strict and node.tag not in LISTED else None)
            kinds[kind] = round_of(kinds[kind], node) if kind in kinds else node
        row = list(kinds.values())
        for node in row:
            node.optional = node.repeated = True
        if len(row) <= LONGEST:
            return row
    if len({n.tag for n in row}) < len(row):  # too many names: by tag alone
        for node in row:
            node.key = node.tag
        return looped(row)
    return row


def folded(node: Node) -> Node:
    """A page's own repetitions as repeated parts; each text slot lists the texts that fall into it."""
    if node.key != "#":
        node.kids = looped(squared([folded(k) for k in node.kids]))
    return node


def slots(node: Node) -> Iterator[Node]:
    if node.key == "#":
        yield node
    for k in node.kids:
        yield from slots(k)


def dumped(node: Node) -> str:
    def plain(n: Node) -> list:
        return [n.key, n.optional + 2 * n.repeated, [plain(k) for k in n.kids]] if n.kids else [n.key, n.optional + 2 * n.repeated]

    return json.dumps(plain(node), separators=(",", ":"))


def loaded(shape: str, stats: str) -> Node:
    values = iter(json.loads(stats))

    def node(x: list) -> Node:
        made = Node(x[0], [node(k) for k in x[2]] if len(x) > 2 else [], bool(x[1] & 1), bool(x[1] & 2))
        if made.key == "#":
            made.stats = next(values)
        return made

    return node(json.loads(shape))


def measured(page: Page) -> Node:
    """A page as a wrapper of its own."""
    root, whole = folded(page.root), crc32("\n".join(page.texts).encode())
    for slot in slots(root):
        texts = [page.texts[t] for t in slot.texts]
        chars = sum(map(len, texts))
        linked = sum(round(len(page.texts[t]) * page.linked[t]) for t in slot.texts)
        slot.stats = [1, crc32("\n".join(texts).encode()), chars, linked, [whole]]
    return root


# ---- judging


def _beside(node: Node, inside: bool) -> bool:
    """Whether an element is a menu, header, footer, sidebar, notice, advert, form or comments. Names alone, and forms, do not
    count where the page's heading or body stands inside."""
    tag, names = node.tag, node.names
    if tag in ("header", "hgroup") and inside:
        return False
    if tag in UNSHOWN and tag not in ("form", "fieldset"):
        return True
    if "hidden" in names:
        return True
    if not (tag in ("form", "fieldset") or names & BESIDE or ("header" in names and not inside and tag not in HEADINGS)):
        return False
    return not any(k.tag in ("h1", "main") or (k.tag == "article" and not k.names & BESIDE) for k in _below(node))


def _below(node: Node) -> Iterator[Node]:
    for k in node.kids:
        yield k
        yield from _below(k)


def _template(stats: list) -> bool:
    return stats[1] != VARIED and len(stats[4]) >= AGREED


def _link_share(stats: list) -> float:
    return stats[3] / max(stats[2], 1)


def kept_slots(root: Node) -> set[int]:
    """Numbers of the slots, in their order, that hold the article.

    Parts beside the article go by their tags and names. The rest is the page's articles, else its main parts, else the part that holds
    most of what is neither linked nor the same on all pages of the host; there template texts and lists of links go too.
    """
    number = {id(s): i for i, s in enumerate(slots(root))}
    mass: dict[int, float] = {}

    def weigh(node: Node, inside: bool) -> float:
        if node.key == "#":
            here = 0.0 if _template(node.stats) else (node.stats[2] - node.stats[3]) / max(node.stats[0], 1)
        elif _beside(node, inside):
            here = 0.0
        else:
            here = sum(weigh(k, inside or node.tag == "article") for k in node.kids)
        mass[id(node)] = here
        return here

    def collect(node: Node, scope: bool, inside: bool, titles: bool) -> set[int]:
        """Slots of a part; ``scope``: it is marked as the article's, ``titles``: of an article's header only headings stay."""
        found: set[int] = set()
        for k in node.kids:
            if k.key != "#":
                if not _beside(k, inside):
                    found |= collect(k, scope, inside or k.tag == "article", (titles or k.tag in ("header", "hgroup")) and k.tag not in HEADINGS)
            elif not titles and (scope or not (_template(k.stats) or _link_share(k.stats) > 0.6)):
                found.add(number[id(k)])
        return found

    def parts(node: Node, wanted: Callable[[Node], bool]) -> list[Node]:
        found: list[Node] = []
        for k in node.kids:
            if k.key != "#" and not _beside(k, False):
                found += [k] if wanted(k) else parts(k, wanted)
        return found

    def filled(found: list[Node]) -> list[Node]:
        return found if any(s.stats[2] > s.stats[3] for f in found for s in slots(f)) else []

    weigh(root, False)
    mains = filled(parts(root, lambda k: k.tag == "main" or ("main" in k.names and k.tag in ("div", "section"))))
    articles = filled([x for w in mains or [root] for x in parts(w, lambda k: k.tag == "article" or "articlebody" in k.names)])
    marked = articles or (mains if all(m.tag == "main" for m in mains) else [])
    if marked:
        return set().union(*(collect(x, True, True, False) for x in marked))
    return set().union(*(collect(_heaviest(w, mass), False, False, False) for w in mains or [root]))


def _heaviest(node: Node, mass: dict[int, float]) -> Node:
    """The deepest part with most of the text, its headings included."""
    while True:
        heavy = max((k for k in node.kids if k.key != "#" and k.tag not in LISTED), key=lambda k: mass.get(id(k), 0.0) * (1.25 if k.names & BODIES else 1), default=None)
        if heavy is None or mass.get(id(heavy), 0.0) < 0.6 * mass.get(id(node), 0.0) or not mass.get(id(heavy), 0.0):
            return node
        rest = [k for k in node.kids if k is not heavy and k.key != "#" and mass.get(id(k), 0.0) > 0]
        if any(x.tag in HEADINGS and any(not _template(s.stats) for s in slots(x)) for k in rest for x in (k, *_below(k))) and not any(x.tag == "h1" for x in _below(heavy)):
            return node
        node = heavy


def informed(page: Node, wrapper: Node) -> None:
    """Gives a page's slots the stats of the host's slots that they fall into."""
    if page.key == "#":
        page.stats = wrapper.stats
        return
    for i, j in matched(page.kids, wrapper.kids):
        if i is not None and j is not None:
            informed(page.kids[i], wrapper.kids[j])
        elif i is not None:  # of rows that became rounds of parts
            like = max(wrapper.kids, key=lambda w: likeness(page.kids[i], w), default=None)
            if like is not None and likeness(page.kids[i], like):
                informed(page.kids[i], like)


def main_text(html: str, wrapper: Node | None = None, known: dict[str, set[int]] | None = None) -> str:
    """The blocks of a page's article, one a line. ``known``: what pages of the same shape have under this wrapper."""
    page = read_page(html)
    if not page.texts:
        return ""
    root = measured(page)
    if wrapper is None:
        keep = kept_slots(root)
    else:
        shape = dumped(root)
        keep = known.get(shape) if known is not None else None
        if keep is None:
            informed(root, wrapper)
            keep = kept_slots(root)
            if known is not None:
                known[shape] = keep
    texts = sorted(t for i, slot in enumerate(slots(root)) if i in keep for t in slot.texts)
    return "\n".join(page.texts[t] for t in texts)


# ---- Spark


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shapes of a partition's pages by host, with the sums of their stats."""
    known: dict[tuple[str, str], list] = {}

    def batch() -> pa.RecordBatch:
        rows = [(h, s, json.dumps(v[0], separators=(",", ":")), v[1]) for (h, s), v in known.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if i == 3 else pa.string()) for i in range(4)], ["host", "shape", "stats", "pages"])

    for rows in batches:
        hosts, pages = rows.column("host"), rows.column("html")
        for i in range(rows.num_rows):
            page = read_page(pages[i].as_py())
            if not page.texts:
                continue
            root = measured(page)
            key, stats = (hosts[i].as_py(), dumped(root)), [s.stats for s in slots(root)]
            if key in known:
                had = known[key]
                had[0], had[1] = [_joined(a, b, False) for a, b in zip(had[0], stats, strict=True)], had[1] + 1
            else:
                known[key] = [stats, 1]
            if len(known) >= 2000:
                yield batch()
                known.clear()
    if known:
        yield batch()


def _wrap(group: pa.Table) -> pa.Table:
    """One wrapper of a host's shapes or wrappers, the most frequent first."""
    rows = sorted(group.select(["shape", "stats", "pages"]).to_pylist(), key=lambda r: (-r["pages"], r["shape"], r["stats"]))
    one = loaded(rows[0]["shape"], rows[0]["stats"])
    for r in rows[1:]:
        one = merged(one, loaded(r["shape"], r["stats"]))
    stats = json.dumps([s.stats for s in slots(one)], separators=(",", ":"))
    return pa.table({"host": [group["host"][0].as_py()], "shape": [dumped(one)], "stats": [stats], "pages": [sum(r["pages"] for r in rows)]})


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, shape, stats, pages): the wrapper of each host of ``pages`` (host, html) with more than one page.

    Pages become shapes where they are read; a host's shapes are dealt into groups of about ``FAN`` and aligned, and so are the
    groups' wrappers, so a host with most of the pages is worked on by many tasks and every round leaves a sixteenth of its rows.
    """
    left = materialise(pages.where("html <> ''").mapInArrow(_shapes, SHAPES))
    done = left.limit(0)
    while True:
        counts = materialise(left.groupBy("host").agg(F.count(F.lit(1)).alias("n")))
        if counts.where("n > 1").isEmpty():
            return done.unionByName(left).where("pages > 1")
        sized = spread_join(left, counts, ["host"], "stats", share=200)
        done = done.unionByName(sized.where("n = 1").drop("n"))
        deal = F.pmod(F.xxhash64("shape", "stats", "pages"), F.ceil(F.col("n") / FAN))
        left = materialise(sized.where("n > 1").groupBy("host", deal.alias("deal")).applyInArrow(_wrap, SHAPES))


def _texts(batches: Iterator[pa.RecordBatch], sent: list[str]) -> Iterator[pa.RecordBatch]:
    """The columns ``sent`` and the text of pages that carry their host's wrapper."""
    wrappers: dict[str, tuple[Node, dict[str, set[int]]]] = {}
    for rows in batches:
        names = rows.schema.names
        html, host, shape, stats = (rows.column(names.index(c)) for c in ("__html", "__host", "__shape", "__stats"))
        out = []
        for i in range(rows.num_rows):
            source = html[i].as_py() or ""
            if not shape[i].is_valid:
                out.append(main_text(source))
                continue
            key = host[i].as_py()
            if key not in wrappers:
                if len(wrappers) >= 200:
                    wrappers.clear()
                wrappers[key] = (loaded(shape[i].as_py(), stats[i].as_py()), {})
            wrapper, known = wrappers[key]
            if len(known) >= 500:
                known.clear()
            out.append(main_text(source, wrapper, known))
        yield pa.RecordBatch.from_arrays([*(rows.column(names.index(n)) for n in sent), pa.array(out, pa.string())], [*sent, "text"])


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(F.regexp_extract(url, "^.*?://([^/?#]*)", 1), F.lit("")), upper, upper.lower())


def extract_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", keep: Sequence[str] | None = None, broadcast_bytes: int = 1 << 24) -> DataFrame:
    """``pages`` (of their columns ``keep``, if given) with ``text``: the blocks of the page's article, in their order, one a line; empty where there is none.

    White space inside a block, line breaks too, is one space. Null and empty pages give the empty text, pages without tags are one block.
    Wrappers are inferred from all pages of a host; pages without a host, and a host's only page, are judged by themselves. Repeated pages
    count once where it is asked whether a text is the template's, and get the same text. An empty table gives an empty one. A column
    called ``text`` is replaced; other names do not matter.

    Where an ``article`` or ``main`` element is there, all of it stays but for menus, headers, notices and the like inside; an article's own
    header keeps its headings. Elsewhere the wrapper's slots decide: text that differs between the host's pages and is not linked.
    The wrappers' table has a row a host. Up to ``broadcast_bytes`` it is sent to the pages; beyond that the pages go to it, hosts with
    more than a 200th of them spread over 32 tasks.
    """
    kept = [c for c in (pages.columns if keep is None else keep) if c != "text"]
    others = F.struct(F.lit(0).alias("__none"), *[c for c in kept if c != html_col]).alias("__page")
    rows = pages.select(others, F.col(html_col).alias("__html"), host_of(F.col(url_col)).alias("__host"), F.monotonically_increasing_id().alias("__row"))
    wrappers = infer_wrappers(rows.where("__host <> ''").select(F.col("__host").alias("host"), F.col("__html").alias("html")))
    wrappers = materialise(wrappers.select(F.col("host").alias("__host"), F.col("shape").alias("__shape"), F.col("stats").alias("__stats")))
    size = wrappers.agg(F.sum(F.length("__host") + F.length("__shape") + F.length("__stats"))).first()[0] or 0
    met = rows.join(F.broadcast(wrappers), "__host", "left") if size <= broadcast_bytes else spread_join(rows, wrappers, ["__host"], "__row", "left", share=200)
    sent = ["__page", "__html"] if html_col in kept else ["__page"]
    schema = T.StructType([*(rows.schema[c] for c in sent), T.StructField("text", T.StringType())])
    found = met.select("__page", "__html", "__host", "__shape", "__stats").mapInArrow(lambda b: _texts(b, sent), schema)
    return found.select(*[F.col("__html").alias(c) if c == html_col else F.col("__page")[c].alias(c) for c in kept], "text")

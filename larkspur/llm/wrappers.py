"""Main text of web pages by wrapper induction.

Pages become DOM trees in which runs of alike siblings are one node. Every host has
a reference page (the smallest hash of page_id); each page is aligned with it by
simple tree matching: roots must be alike and the children's alignment keeps order
and holds the most nodes. Nodes whose text stays the same across the pages of a
host are its template, nodes whose text varies are slots. Agreement is counted over
all pages of a host (pages equal to the reference tell nothing and are left out),
summed per task before it is shuffled, so a host of any size costs a few rows a
task.

Template nodes without a slot below them are cut, slots are content. An element that declares itself the article (article, then main, then a named
content container) is a prior only: slots outside it are left out as long as those
inside hold at least as much text, else it is overruled. Pages of hosts with too few
pages for a wrapper are read by their elements alone. ``decided`` says which it was:
``wrapper`` where the text is not the one that the elements alone give.

Menus, page headers, footers, sidebars, notices, adverts, forms, comments and the like
are cut by element and by words of class, id and role, also if their text varies. Words
that tell a state (has-sidebar, with-share) name nothing, headings are not cut by
words, and no element is cut that holds the article. Words that articles use as well
(search, related) cut no paragraphs of it, and nothing if the page would be empty. Inline elements within a text of
their own block stay with it. Without an article element, blocks that are mostly links
are cut, too.

References and wrappers are broadcast while their summed size is below
``broadcast_bytes``, else joined by host with the hot hosts' rows salted.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.words import slices
from larkspur.shared import materialise

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe textarea select option object audio video canvas head title".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that end an open element of the given kind.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CUT_TAGS = frozenset("nav footer aside form button menu dialog label".split()) | RAW
#: Words of class, id or role that mark what is not the article.
CUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner banners breadcrumb breadcrumbs byline comment comments consent cookie cookies disclaimer discussion disqus footer "
    "header login masthead menu menus modal nav navbar navigation newsletter notice notices notification notifications pager pagination popup promo promotion promoted related "
    "replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar widget widgets alert complementary contentinfo".split()
)
#: Of these, words that articles use as well: they cut nothing that reads like an article's text.
WEAK_WORDS = frozenset("banner discussion header masthead related search".split())
CONTENT_WORDS = frozenset("article content entry post story main body text".split())
#: Words of a class that tell a state of the page, not what the element is.
STATE_WORDS = frozenset("has with no without on off".split())
#: Elements that words of class, id or role never cut.
KEPT_TAGS = frozenset("html body main h1 h2 h3 h4 h5 h6".split())

START = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
EDGE = re.compile("[\"'>]")
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
WORDS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass(slots=True)
class Node:
    """An element: its label, what it is for, and its children (nodes and texts)."""

    tag: str
    label: str
    cut: bool = False
    words: frozenset = frozenset()
    weak: bool = False
    children: list = field(default_factory=list)


def _attributes(tag: str, raw: str) -> tuple[str, bool, frozenset, bool]:
    """Label, whether the element is cut, the words that name it, and whether weak words alone cut it."""
    if not raw.strip():
        return tag, tag in CUT_TAGS, frozenset(), False
    found, hidden = {}, False
    for name, value in ATTRIBUTE.findall(raw):
        name, value = name.lower(), value.strip("\"'")
        hidden |= name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and bool(HIDDEN.search(value))
        found[name] = value
    named = [{w.lower() for w in WORDS.findall(part)} for name in ("class", "id", "role") for part in found.get(name, "").split()]
    words = frozenset(w for part in named if not part & STATE_WORDS for w in part)
    cut = tag not in KEPT_TAGS and bool(words & CUT_WORDS) and not (tag == "article" and words & CONTENT_WORDS)
    return f"{tag}.{found.get('class', '')}#{found.get('id', '')}".rstrip("#."), hidden or tag in CUT_TAGS or cut, words, cut and not (hidden or tag in CUT_TAGS or words & CUT_WORDS - WEAK_WORDS)


_ATTRIBUTES: dict[tuple[str, str], tuple[str, bool, frozenset, bool]] = {}


class Source:
    """Tags, comments and texts of a page, each character looked at a bounded number of times."""

    def __init__(self, html: str):
        self.html, self.last, self.quoted, self.missing = html, html.rfind(">"), True, set()

    def _end(self, at: int) -> int:
        """Where a tag ends: at the first > that no quotes hold.

        A quote that nothing closes is a character like others. If quotes hold all that
        is left, they are no quotes from there on.
        """
        place = at
        while self.quoted and (m := EDGE.search(self.html, place)):
            if m[0] == ">":
                return m.end()
            close = -1 if m[0] in self.missing else self.html.find(m[0], m.end())
            if close < 0:
                self.missing.add(m[0])
            place = max(close + 1, m.end())
        self.quoted = False
        return self.html.find(">", at) + 1

    def __iter__(self) -> Iterator[tuple[str | None, bool, str]]:
        """(tag, whether it closes, attributes) or (None, _, text)."""
        html, at, end = self.html, 0, len(self.html)
        while at < end:
            if html.startswith("<!--", at):
                at = html.find("-->", at + 4)
                at = end if at < 0 else at + 3
            elif at > self.last:  # no tag ends any more
                yield None, False, html[at:]
                return
            elif html.startswith(("<!", "<?"), at):
                at = html.find(">", at) + 1
            elif m := START.match(html, at):
                at = self._end(m.end())
                yield m[2].lower(), bool(m[1]), html[m.end() : at - 1]
                if not m[1]:
                    at = self._after(m[2].lower(), at)
            else:
                stop = html.find("<", at + 1)
                stop = end if stop < 0 else stop
                yield None, False, html[at:stop]
                at = stop

    def _after(self, tag: str, at: int) -> int:
        """Where reading goes on: after the end of what is no markup."""
        if tag not in RAW or tag in ("head", "svg", "math", "object", "audio", "video", "canvas", "select"):
            return at
        close = re.compile(f"</{re.escape(tag)}\\s*>", re.I).search(self.html, at)
        return close.end() if close else len(self.html)


def parse(html: str) -> Node:
    """A tree from any text: unclosed, crossed and stray tags included."""
    root = Node("#", "#")
    stack: list[Node] = [root]
    open_tags: Counter[str] = Counter()

    def close(depth: int) -> None:
        open_tags.subtract(n.tag for n in stack[depth:])
        del stack[depth:]

    for tag, closes, rest in Source(html):
        if tag is None:
            stack[-1].children.append(rest)
            continue
        if closes:
            if open_tags[tag] > 0:
                close(next(d for d in range(len(stack) - 1, 0, -1) if stack[d].tag == tag))
            continue
        if tag in BLOCKS and open_tags["p"] > 0:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":  # a block ends an open paragraph
                    close(depth)
                    break
                if stack[depth].tag in BLOCKS:
                    break
        if tag in ENDS and any(open_tags[t] > 0 for t in ENDS[tag]):
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in ENDS[tag]:
                    close(depth)
                    break
                if stack[depth].tag in ("ul", "ol", "dl", "table", "select"):
                    break
        key = (tag, rest)
        if (known := _ATTRIBUTES.get(key)) is None:
            known = _attributes(*key)
            if len(_ATTRIBUTES) < 50_000 and len(rest) < 1000:
                _ATTRIBUTES[key] = known
        node = Node(tag, *known)
        stack[-1].children.append(node)
        if tag in VOID or rest.endswith("/") and tag not in BLOCKS:
            continue
        if tag in RAW and tag not in ("head", "svg", "math", "object", "audio", "video", "canvas", "select"):
            continue  # what it holds has been passed over
        stack.append(node)
        open_tags[tag] += 1
    return root


def blocks(node: Node, skip: frozenset = frozenset(), only: frozenset = frozenset()) -> list[str]:
    """Texts of the blocks below a node, in page order, without ``skip`` and what is cut but for ``only`` (ids of nodes)."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append(text)

    # an explicit stack: pages may nest deeper than Python recurses
    todo: list = [node]
    while todo:
        item = todo.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            held.append(item)
        elif item.cut and item is not node and id(item) not in only or id(item) in skip:
            if item.tag in BLOCKS:
                flush()
        elif item.tag == "br":
            held.append(" ")
        else:
            block = item.tag in BLOCKS
            if block:
                flush()
                todo.append(None)
            todo.extend(reversed(item.children))
    flush()
    return out


@dataclass(slots=True)
class Shape:
    """A tree in which runs of alike siblings are one node."""

    label: str
    key: str
    nodes: list
    children: list
    size: int = 1


def shape(root: Node) -> Shape:
    """Shapes of a tree, children first; ``nodes`` are the elements that a shape stands for."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if not isinstance(c, str) and c.tag not in RAW and c.tag not in VOID]
    made: dict[int, Shape] = {}
    for node in reversed(order):
        own: list[Shape] = []
        for child in node.children:
            if isinstance(child, str) or child.tag in RAW or child.tag in VOID:
                continue
            s = made.pop(id(child))
            if own and own[-1].key == s.key:
                _merge(own[-1], s)
            else:
                own.append(s)
        key = f"{node.label}({''.join(c.key for c in own)})"
        made[id(node)] = Shape(node.label, key if len(key) < 2000 else xxhash.xxh64_hexdigest(key), [node], own, 1 + sum(c.size for c in own))
    return made[id(root)]


def _merge(into: Shape, other: Shape) -> None:
    todo = [(into, other)]
    while todo:
        a, b = todo.pop()
        a.nodes += b.nodes
        todo += zip(a.children, b.children, strict=True)


def listing(root: Shape) -> list[Shape]:
    """All shapes in page order."""
    out, todo = [], [root]
    while todo:
        s = todo.pop()
        out.append(s)
        todo += reversed(s.children)
    return out


def match(a: Shape, b: Shape) -> list[tuple[Shape, Shape]]:
    """Simple tree matching: the pairs of the largest order-keeping alignment of two trees.

    Trees of any depth: pairs are listed parents first and weighed children first.
    """
    if a.label != b.label:
        return []
    pairs: list[tuple[Shape, Shape]] = [(a, b)]
    below: list[dict[tuple[int, int], int]] = []  # of each pair: the pairs of its children
    for x, y in pairs:
        found: dict[tuple[int, int], int] = {}
        below.append(found)
        if x.key == y.key:
            continue
        places: dict[str, list[int]] = {}
        for j, child in enumerate(y.children):
            places.setdefault(child.label, []).append(j)
        for i, child in enumerate(x.children):
            for j in places.get(child.label, ()):
                found[i, j] = len(pairs)
                pairs.append((child, y.children[j]))
    weights = [0] * len(pairs)
    chosen: list[list[int]] = [[] for _ in pairs]
    for at in range(len(pairs) - 1, -1, -1):
        x, y = pairs[at]
        if x.key == y.key:
            weights[at] = x.size
            continue
        m, n, found = len(x.children), len(y.children), below[at]
        gain = np.zeros((m, n), np.int64)
        for (i, j), k in found.items():
            gain[i, j] = weights[k]
        best = np.zeros((m + 1, n + 1), np.int64)
        for i in range(m):
            best[i + 1, 1:] = np.maximum.accumulate(np.maximum(best[i, 1:], best[i, :-1] + gain[i]))
        i, j = m, n
        while i and j:
            if best[i, j] == best[i - 1, j]:
                i -= 1
            elif best[i, j] == best[i, j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                chosen[at].append(found[i, j])
        weights[at] = 1 + int(best[m, n])
    out, todo = [], [0]
    while todo:
        at = todo.pop()
        x, y = pairs[at]
        out += zip(listing(x), listing(y), strict=True) if x.key == y.key else [(x, y)]
        todo += chosen[at]  # the last child first, so that the first is on top
    return out


def own_text(node: Node) -> str:
    """Text that stands directly in an element."""
    return " ".join("".join(c if isinstance(c, str) else " " for c in node.children).split())


class Reference:
    """A host's reference page; alignments are remembered by the shape of a page."""

    def __init__(self, html: str):
        self.root = shape(parse(html))
        self.list = listing(self.root)
        self.texts = [[own_text(n) for n in s.nodes] for s in self.list]
        self.first = np.cumsum([0] + [len(t) for t in self.texts]).tolist()
        self.places = {id(s): i for i, s in enumerate(self.list)}
        self.known: dict[str, list[tuple[int, int]]] = {}

    def align(self, root: Shape) -> list[tuple[int, Shape]]:
        """(place in the reference, shape of the page) of every matched pair."""
        own = listing(root)
        if (pairs := self.known.get(root.key)) is None:
            at = {id(s): i for i, s in enumerate(own)}
            pairs = [(self.places[id(x)], at[id(y)]) for x, y in match(self.root, root)]
            if len(self.known) < 2_000:
                self.known[root.key] = pairs
        return [(i, own[j]) for i, j in pairs]


    def fixed(self, template: list[int]) -> dict[int, set[str]]:
        """Template texts by place, from numbers of elements."""
        out: dict[int, set[str]] = {}
        for number in template:
            place = bisect_right(self.first, number) - 1
            out.setdefault(place, set()).add(self.texts[place][number - self.first[place]])
        return out


def article(root: Node, wrapper: tuple[Reference, list[int]] | None) -> str:
    """The main text of a parsed page."""
    return main_text(root, wrapper)[0]


def main_text(root: Node, wrapper: tuple[Reference, list[int]] | None) -> tuple[str, str]:
    """The main text of a parsed page, and what decided: wrapper, element or page.

    ``wrapper`` is told only where the text is not the one that the page's elements give.
    """
    tops = _declared(root)
    _settle(root, tops)
    plain, by = _read(root, tops, None)
    if wrapper:
        text, _ = _read(root, tops, _constant(root, wrapper))
        if text != plain:
            return text, "wrapper"
    if not plain and _settle(root, tops, everywhere=True):
        return _read(root, tops, None)
    return plain, by


def _read(root: Node, tops: list[Node], template: set[int] | None) -> tuple[str, str]:
    """The text that is left of a page, without a wrapper (none) or without its template nodes."""
    skip = frozenset(template or ())
    inner = [t for n in tops for t in blocks(n, skip=skip)]
    if tops and (template is None or not template and not _outside(root, tops)):  # all slots but those of menus and the like are inside
        return "\n".join(inner), "element"
    whole = blocks(root, skip=skip | _furniture(root, tops), only=_holding(root, tops))
    if tops and 2 * sum(map(len, inner)) >= sum(map(len, whole)):
        return "\n".join(inner), "element"
    return "\n".join(whole), "page"


def _settle(root: Node, tops: list[Node], everywhere: bool = False) -> bool:
    """Keeps elements that weak words alone would cut, if they read like an article's text; whether any is kept.

    That is one with a word for content beside, or one in the article: its header, a
    paragraph, or what has paragraphs and does not call itself related.
    """
    wanted, kept, todo = {id(n) for n in tops}, False, [(root, False)]
    while todo:
        node, inside = todo.pop()
        inside = inside or id(node) in wanted
        if node.cut and node.weak and not _mostly_links(node):
            named = bool(node.words & CONTENT_WORDS)
            prose = node.tag == "p" or "header" in node.words or "search" in node.words and any(n.tag == "p" for n in _below(node))
            if everywhere or named or inside and prose:
                node.cut, kept = False, True
        todo += [(c, inside) for c in node.children if not isinstance(c, str)]
    return kept


def _declared(root: Node) -> list[Node]:
    """The outermost elements that declare themselves the article."""
    free, inside, todo = [], [], [(root, False)]
    while todo:  # page order; nothing below what is cut by its element, second choice below what is cut by words
        node, cut = todo.pop()
        if node.cut and (node.tag in CUT_TAGS or node.tag == "article" or "comments" in node.words or "comment" in node.words):
            continue
        cut = cut or node.cut
        (inside if cut else free).append(node)
        todo += [(c, cut) for c in reversed(node.children) if not isinstance(c, str)]
    kinds = (
        lambda n: n.tag == "article",
        lambda n: n.tag == "main" or "main" in n.words and n.tag in BLOCKS and n.tag not in ("html", "body", "header"),
        lambda n: bool(n.words & CONTENT_WORDS) and n.tag in ("div", "section", "td"),
    )
    for order in (free, inside):
        for kind in kinds[: 3 if order is free else 2]:
            if named := [n for n in order if kind(n) and not (n.cut and n.tag != "article")]:
                held = {id(x) for n in named for x in _below(n)}
                return [n for n in named if id(n) not in held]
    return []


def _holding(root: Node, tops: list[Node]) -> frozenset:
    """Ids of the elements that hold the declared article: they are not cut."""
    wanted, order, todo = {id(n) for n in tops}, [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if not isinstance(c, str)]
    held: set[int] = set()
    for node in reversed(order):
        if any(not isinstance(c, str) and (id(c) in wanted or id(c) in held) for c in node.children):
            held.add(id(node))
    return frozenset(held)


def _outside(root: Node, tops: list[Node]) -> bool:
    """Whether any text stands outside the article and what is cut."""
    wanted, todo = {id(n) for n in tops}, [root]
    while todo:
        node = todo.pop()
        for c in node.children:
            if isinstance(c, str):
                if not c.isspace():
                    return True
            elif not c.cut and id(c) not in wanted:
                todo.append(c)
    return False


def _furniture(root: Node, tops: list[Node]) -> frozenset:
    """Ids of page headers and blocks that are mostly links, outside the article."""
    out, wanted, todo = set(), {id(n) for n in tops}, [(root, False)]
    while todo:
        node, inside = todo.pop()
        inside = inside or id(node) in wanted or node.tag in ("article", "main", "section")
        if node.tag == "header" and not inside or node.tag in ("header", "ul", "ol", "div", "p", "table") and not (tops and inside) and _mostly_links(node):
            out.add(id(node))
        todo += [(c, inside) for c in node.children if not isinstance(c, str) and not c.cut]
    return frozenset(out - _holding(root, tops))


def _constant(root: Node, wrapper: tuple[Reference, list[int]]) -> set[int]:
    """Ids of a page's template nodes: their text and all text below them is the template's."""
    reference, template = wrapper
    fixed = reference.fixed(template)
    same = {id(n) for place, s in reference.align(shape(root)) if place in fixed for n in s.nodes if own_text(n) in fixed[place]}
    order, todo = [], [(root, False)]
    while todo:  # parents first
        node, prose = todo.pop()
        order.append((node, prose))
        inside = bool(own_text(node)) or prose and node.tag not in BLOCKS
        todo += [(c, inside) for c in node.children if not isinstance(c, str)]
    slots: set[int] = set()  # with text that varies, in themselves or below
    for node, _ in reversed(order):
        if not node.cut and (id(node) not in same and own_text(node) or any(not isinstance(c, str) and id(c) in slots for c in node.children)):
            slots.add(id(node))
    # an inline element in running text is part of it
    return {id(n) for n, prose in order if id(n) in same and id(n) not in slots and (n.tag in BLOCKS or not prose)}


def _below(node: Node) -> Iterator[Node]:
    todo = [c for c in node.children if not isinstance(c, str)]
    while todo:
        n = todo.pop()
        yield n
        todo += [c for c in n.children if not isinstance(c, str)]


def _mostly_links(node: Node) -> bool:
    linked = total = 0
    todo: list = [(node, False)]
    while todo:
        item, inside = todo.pop()
        if isinstance(item, str):
            size = len(item.strip())
            total += size
            linked += size * inside
        else:
            todo += [(c, inside or item.tag == "a") for c in item.children]
    return linked > 0.6 * total


HOST = r"^[^:]*://([^/?#]*)"


def hosted(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, host); pages without a host share the empty one."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host"))


class _References:
    """References of a task, parsed when first used; a bounded number is kept."""

    def __init__(self, keep: int = 500):
        self.keep, self.made = keep, {}

    def get(self, host: str, html: str) -> Reference:
        if (found := self.made.get((host, len(html)))) is None:
            if len(self.made) >= self.keep:
                self.made.clear()
            found = self.made[host, len(html)] = Reference(html)
        return found


def _beside(rows: DataFrame, small: DataFrame, size: int, broadcast_bytes: int, salts: int = 16) -> DataFrame:
    """Joins a row per host to all pages: by broadcast while small, else with salted hosts."""
    if size <= broadcast_bytes:
        return rows.join(F.broadcast(small), "host", "left")
    salted = small.withColumn("salt", F.explode(F.array(*map(F.lit, range(salts)))))
    key = F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")
    return rows.withColumn("salt", key).join(salted, ["host", "salt"], "left").drop("salt")


def induce(pages: DataFrame, least_pages: int = 3, agreement: float = 0.7, broadcast_bytes: int = 32 << 20) -> tuple[DataFrame, int]:
    """(host, reference, template) of every host, and the bytes of all references.

    ``template`` lists the elements of the reference whose text the share
    ``agreement`` of at least ``least_pages`` aligned pages repeat; it is null for
    hosts with fewer pages, which have no wrapper, and empty if all text varies.
    """
    rows = hosted(pages).where("html is not null")
    first = F.min_by("html", F.struct(F.xxhash64("page_id", "url"), F.xxhash64("html"))).alias("reference")
    chosen = materialise(rows.groupBy("host").agg(first), "wrapper-references")
    size = chosen.agg(F.sum(F.octet_length("reference"))).first()[0] or 0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        references, found = _References(), Counter()

        def rows_of() -> pa.RecordBatch:
            keys = [(*k, v) for k, v in found.items()]
            columns = list(zip(*keys, strict=True)) or [()] * 4
            kinds = (pa.string(), pa.int32(), pa.bool_(), pa.int64())
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["host", "place", "same", "n"])

        for batch in batches:
            for host, html, other in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "reference")), strict=True):
                reference = references.get(host, other)
                pairs = []
                for place, s in reference.align(shape(parse(html))):
                    own = {own_text(n) for n in s.nodes}
                    pairs += [(number, t in own) for number, t in enumerate(reference.texts[place], reference.first[place]) if t]
                if not all(same for _, same in pairs):
                    found.update((host, number, same) for number, same in pairs)
            if len(found) > 100_000:
                yield rows_of()
        yield rows_of()

    counted = _beside(rows, chosen, size, broadcast_bytes).select("host", "html", "reference").mapInArrow(count, "host string, place int, same boolean, n long")
    counted = counted.groupBy("host", "place").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("same"), F.col("n")).otherwise(0)).alias("same"))
    constant = F.when((F.col("n") >= least_pages) & (F.col("same") >= agreement * F.col("n")), F.col("place"))
    fixed = counted.groupBy("host").agg(F.sort_array(F.collect_list(constant)).alias("template"), F.max("n").alias("n")).where(F.col("n") >= least_pages)
    return materialise(chosen.join(fixed.drop("n"), "host", "left"), "wrappers"), size


EXTRACTED = "page_id long, url string, text string, n_chars long, decided string"


def extract(pages: DataFrame, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """(page_id, url, text, n_chars, decided) of every page.

    Null html is empty text (decided by nothing: null), as is html without an article;
    equal rows give equal rows; an empty table gives none; pages without a host are one
    host; other columns are ignored. Pages of any length and depth are parsed in time that
    grows with their length, whatever tags, quotes and comments they leave open.
    """
    wrappers, size = induce(pages, broadcast_bytes=broadcast_bytes)
    joined = _beside(hosted(pages), wrappers, size, broadcast_bytes).select("page_id", "url", "html", "host", "reference", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        references = _References()
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in ("html", "host", "reference", "template")}
            found = []
            for html, host, other, template in zip(*columns.values(), strict=True):
                wrapper = (references.get(host, other), template) if other and template is not None else None
                found.append(main_text(parse(html), wrapper) if html else ("", None))
            texts = [t for t, _ in found]
            for a, b in slices(texts):
                own = [pa.array(texts[a:b], pa.string()), pa.array(list(map(len, texts[a:b])), pa.int64()), pa.array([d for _, d in found[a:b]], pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column("page_id").slice(a, b - a), batch.column("url").slice(a, b - a), *own], names=["page_id", "url", "text", "n_chars", "decided"])

    return joined.mapInArrow(run, EXTRACTED)

"""Main text of web pages through wrappers inferred for each host.

A page's token stream is nested by its tags, and runs of equal neighbours (up to three tokens wide) become repeated
groups.  Streams of one host are then aligned one after another, as in Crescenzi et al., "RoadRunner" (2001): a tag
that the other side lacks becomes an optional group, a repetition on one side a repeated group, and texts that differ a
slot; texts that agree stay part of the template.  The result is a union-free regular expression, the host's wrapper.

Wrappers are made inside partitions and merged by host in two steps, so that no task gets the pages of a large host.
They keep every optional group, however few pages show it; the size of a host's wrapper is bounded by its pages alone.

The wrapper says where the article is: from the root down, the group that holds most of the text that fills slots and is
no link is followed to the last one that holds more than one paragraph or a heading.  A page is aligned with its
wrapper, and its text is read at that group; what fills the template is dropped.  Names break ties: an element called
article is not taken apart, and what tag or class call a menu, footer, advert, form, comment and so on neither counts nor
is read.  A page on which that group is missing, or whose host has no such group, is read by the names alone.
"""

from __future__ import annotations

import html
import json
import re
import sys
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import materialise, texts

#: Pages that must show a text at one place for it to count as template.
TEMPLATE_PAGES = 3
#: A wrapper of which pages need more nodes than this goes once to every PAGES_DEALT pages of its host, and not with each
#: page.  A partial one with more than RARE times as many nodes goes on to be merged, so that pages are aligned with no
#: larger ones.
MAX_NODES, RARE, PAGES_DEALT = 1500, 16, 1000
#: Hosts whose wrappers a task builds at a time, and salts by which the partial wrappers of a host are merged first.
HOSTS_HELD, SALTS = 2000, 16

# Element names of HTML by kind.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
NOISE_TAGS = set("head nav aside form footer button select option svg canvas object audio video map dialog menu".split()) | RAW
#: Roles, and words that begin or end a class name or id of what isn't the article.
NOISE_ROLES = set("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
NOISE_WORDS = set("nav navbar navigation menu header masthead footer sidebar aside ad ads adv advert adverts advertisement advertising adsense banner promo promotion promoted sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments commentlist disqus discussion reply replies respond responses announcement adsbygoogle taboola outbrain breadcrumb breadcrumbs pagination pager related recommended widget search form toolbar disclaimer paywall skip".split())
JOINING_WORDS = {"with", "without", "has", "no", "not"}
MAIN_WORDS = {"article", "content", "post", "entry", "story", "main", "maincontent"}

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<([a-zA-Z][^\s/>]*)([^>]*)>?""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/"']+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")


# Pages may nest deeper than Python's own limit. Calls between Python functions take no C stack, so the limit can go.
sys.setrecursionlimit(1_000_000)


class Element:
    __slots__ = ("name", "words", "classes", "role", "hidden", "kids")

    def __init__(self, name: str, attributes: str = ""):
        self.name, self.kids = name, []
        found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)} if "=" in attributes else {}
        self.classes = found.get("class", "").lower().split()
        self.words = [*self.classes, *found.get("id", "").lower().split()]
        self.role = found.get("role", "").lower()
        bare = re.sub(r"""=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", "", attributes).lower().split()
        style = re.sub(r"\s", "", found.get("style", "").lower())
        self.hidden = "hidden" in bare or "display:none" in style or found.get("aria-hidden", "").lower() == "true"

    def signature(self) -> str:
        """Name and class words, less digits, which differ from page to page, as ids do."""
        return " ".join([self.name, *sorted({re.sub(r"\d+", "", w) for w in self.classes})])

    def is_noise(self, by_class: bool) -> bool:
        if self.name in NOISE_TAGS or self.hidden or self.role in NOISE_ROLES:
            return True
        if not by_class or self.name in ("html", "body", "main"):
            return False
        for name in self.words:
            parts = [p for p in re.split(r"[^a-z]+", name) if p]
            if parts and not JOINING_WORDS.intersection(parts) and (parts[0] in NOISE_WORDS or parts[-1] in NOISE_WORDS):
                return True
        return False


def parse(page: str) -> Element:
    """The page's tokens nested by its tags; end tags that are missing or astray are made up for or ignored."""
    root = Element("#root")
    stack = [root]
    opened: Counter[str] = Counter()
    at = 0

    def text(s: str) -> None:
        if s:
            stack[-1].kids.append(html.unescape(s))

    def close(name: str, barrier: frozenset[str] = frozenset()) -> None:
        if not opened[name]:  # spares the search of a deep stack
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name == name:
                opened.subtract(e.name for e in stack[i:])
                del stack[i:]
                return
            if stack[i].name in barrier:
                return

    while True:
        m = TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            return root
        text(page[at : m.start()])
        at = m.end()
        end, start = m[1], m[2] or m[4]
        if end:
            close(end.lower())
        elif start:
            name = start.lower()
            attributes = (m[3] if m[2] else m[5]) or ""
            if name in RAW:
                stop = re.compile(f"</{re.escape(name)}(?=[\\s/>]|\\Z)[^>]*>?", re.I).search(page, at)
                at = stop.end() if stop else len(page)
                continue
            if name in BLOCK:
                close("p", SCOPE)
            if name in SIBLINGS:
                for other in SIBLINGS[name]:
                    close(other, LISTS)
            own = Element(name, attributes)
            stack[-1].kids.append(own)
            if name not in VOID and not attributes.rstrip().endswith("/") or name in BLOCK and name != "hr":
                stack.append(own)
                opened[name] += 1


SCOPE = frozenset(BLOCK - {"p"} | {"td", "th", "button", "object"})
LISTS = frozenset("ul ol dl table tbody thead tfoot article main body section div".split())
SIBLINGS = {"li": ["li"], "dt": ["dt", "dd"], "dd": ["dt", "dd"], "tr": ["td", "th", "tr"], "td": ["td", "th"], "th": ["td", "th"], "option": ["option"]}

CONTAINERS = frozenset("article aside center details div dl fieldset form main ol section table tbody td th tr ul".split())

# A wrapper is a list of nodes: [signature, pages, repeated, optional, wrapper of what it holds], and for texts
# ["#", pages, repeated, optional, hash of the text or 0 for a slot, characters over all pages].


def _hash(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace")) | 1 << 32


def stream(element: Element) -> list:
    """The wrapper of a single page."""
    out = []
    for kid in element.kids:
        if isinstance(kid, str):
            if words := " ".join(kid.split()):
                out.append(["#", 1, False, False, _hash(words), len(words)])
        elif kid.name not in VOID:
            out.append([kid.signature(), 1, False, False, stream(kid)])
    return fold(out)


def _kind(node: list) -> str:
    """What neighbours must have in common to be repetitions: containers must also hold the same."""
    name = node[0].split(" ", 1)[0]
    return node[0] + "(" + ",".join(k[0] for k in node[4]) + ")" if name in CONTAINERS else node[0]


def fold(nodes: list) -> list:
    """``nodes`` with runs of equal neighbours, one to three nodes wide, as repeated groups."""
    for width in (1, 2, 3):
        out: list = []
        at = 0
        names = [_kind(n) for n in nodes]
        while at < len(nodes):
            end = at + width
            while names[at : at + width] == names[end : end + width] and end + width <= len(nodes) and width <= len(nodes) - at:
                end += width
            group = nodes[at : at + width]
            if end > at + width and (width == 1 or len(set(names[at : at + width])) > 1):
                for i in range(at + width, end, width):
                    group = [merge(a, b) for a, b in zip(group, nodes[i : i + width], strict=True)]
                for n in group:
                    n[1], n[2] = 1, True
                out += group
                at = end
            else:
                out.append(nodes[at])
                at += 1
        nodes = out
    return nodes


def merge(a: list, b: list) -> list:
    held = [a[4] if a[4] == b[4] else 0, a[5] + b[5]] if a[0] == "#" else [align(a[4], b[4])]
    return [a[0], a[1] + b[1], a[2] or b[2], a[3] or b[3], *held]


def align(a: list, b: list) -> list:
    """One wrapper for what two wrappers match: mismatches become optional groups."""
    out, i, j = [], 0, 0
    where: list[dict[str, list[int]]] = [{}, {}]
    for side, nodes in enumerate((a, b)):
        for at in range(len(nodes) - 1, -1, -1):
            where[side].setdefault(nodes[at][0], []).append(at)  # places from the last to the first

    def ahead(side: int, name: str, at: int) -> int:
        places = where[side].get(name, [])
        while places and places[-1] < at:
            places.pop()
        return places[-1] - at if places else 1 << 30

    def skipped(node: list) -> list:
        return [node[0], node[1], node[2], True, *node[4:]]

    while i < len(a) and j < len(b):
        if a[i][0] == b[j][0]:
            out.append(merge(a[i], b[j]))
            i, j = i + 1, j + 1
        elif ahead(1, a[i][0], j) < ahead(0, b[j][0], i):
            out.append(skipped(b[j]))
            j += 1
        else:
            out.append(skipped(a[i]))
            i += 1
    return out + [skipped(n) for n in a[i:]] + [skipped(n) for n in b[j:]]


def _size(nodes: list) -> int:
    size, left = 0, [nodes]
    while left:
        some = left.pop()
        size += len(some)
        left += [n[4] for n in some if n[0] != "#" and n[4]]
    return size


def dumped(nodes: list) -> str:
    """A wrapper as JSON without nesting: the number of its nodes, and each node with that of what it holds."""
    out, left = [len(nodes)], nodes[::-1]
    while left:
        n = left.pop()
        out.append(n if n[0] == "#" else [*n[:4], len(n[4])])
        if n[0] != "#":
            left += n[4][::-1]
    return json.dumps(out)


class Nodes(list):
    """Nodes that know the places of each signature once they are asked for one."""

    __slots__ = ("places",)

    def first(self, name: str, at: int) -> int | None:
        """The first place from ``at`` on of a node with a signature."""
        if not hasattr(self, "places"):
            self.places: dict[str, list[int]] = {}
            for i, n in enumerate(self):
                self.places.setdefault(n[0], []).append(i)
        own = self.places.get(name, [])
        i = bisect_left(own, at)
        return own[i] if i < len(own) else None


def loaded(text: str) -> Nodes:
    count, *rows = json.loads(text)
    whole = Nodes()
    open_ = [(whole, count)]
    for row in rows:
        while len(open_[-1][0]) == open_[-1][1]:
            open_.pop()
        open_[-1][0].append(row)
        if row[0] != "#":
            open_.append((Nodes(), row[4]))
            row[4] = open_[-1][0]
    return whole


def combine(a: list, b: list) -> list:
    """Both wrappers aligned; nothing is given up."""
    return align(a, b)


def template_texts(element: Element, wrapper: list) -> set[tuple[int, int]]:
    """Places (id of the holder and index) of texts that are the wrapper's own."""
    fixed: set[tuple[int, int]] = set()

    def walk(e: Element, nodes: list, repeated: bool) -> None:
        for index, found in _matched(e, nodes):
            kid, node = e.kids[index], nodes[found]
            if not isinstance(kid, str):
                walk(kid, node[4], repeated or node[2])
            elif not repeated and not node[2] and node[1] >= TEMPLATE_PAGES and node[4] == _hash(" ".join(kid.split())):
                fixed.add((id(e), index))

    walk(element, wrapper, False)
    return fixed


def _called(signature: str) -> Element:
    name, *classes = signature.split(" ")
    out = Element(name)
    out.words = out.classes = classes
    return out


def _weights(nodes: list) -> list[int]:
    """Characters that fill slots of each node, but for those in links and in what its name says isn't the article."""
    out = []
    for n in nodes:
        if n[0] == "#":
            out.append(0 if n[4] and n[1] >= TEMPLATE_PAGES and not n[2] else n[5])
        else:
            called = _called(n[0])
            out.append(0 if called.name == "a" or called.is_noise(True) else sum(_weights(n[4])))
    return out


#: Share of the text that a group must hold for the article to be looked for inside it.
MOST = 0.6
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 header hgroup".split())


def main_path(wrapper: list) -> list[int]:
    """Places, from the root down, that lead to the group with the article; empty if no group below the body has it.

    A single page tells nothing about what its host repeats.
    """
    path, inside, nodes = [], 0, wrapper if max((n[1] for n in wrapper), default=0) > 1 else []
    while nodes:
        weights = _weights(nodes)
        at = max(range(len(nodes)), key=weights.__getitem__)
        name = nodes[at][0].split(" ", 1)[0]
        headed = any(n[0].split(" ", 1)[0] in HEADINGS for n in nodes)
        if name not in GROUPS or nodes[at][2] or weights[at] < MOST * sum(weights) or not weights[at] or headed and inside:
            break
        path.append(at)
        inside += name not in ("html", "body")
        if name == "article":
            break
        nodes = nodes[at][4]
    return path if inside else []


GROUPS = frozenset("html body main article section div center table tbody tr td".split())


def _matched(element: Element, nodes: list) -> Iterator[tuple[int, int]]:
    """Places of kids of an element with those of the nodes that they match, in order."""
    at = 0
    nodes = nodes if isinstance(nodes, Nodes) else Nodes(nodes)
    for index, kid in enumerate(element.kids):
        plain = isinstance(kid, str)
        if plain and not kid.strip() or not plain and kid.name in VOID:
            continue
        name = "#" if plain else kid.signature()
        found = nodes.first(name, at)
        if found is not None:
            at = found if nodes[found][2] else found + 1
            yield index, found


def located(root: Element, wrapper: list, path: list[int]) -> Element | None:
    """The page's element at the wrapper's place."""
    for place in path:
        index = next((i for i, found in _matched(root, wrapper) if found == place), None)
        if index is None:
            return None
        root, wrapper = root.kids[index], wrapper[place][4]
    return root


def essential(wrapper: list, path: list[int]) -> list:
    """``wrapper`` less what is inside groups that neither lead to the article nor hold template texts."""

    def holds(n: list) -> bool:
        if n[0] == "#":
            return bool(n[4]) and n[1] >= TEMPLATE_PAGES and not n[2]
        return not n[2] and any(map(holds, n[4]))

    def cut(nodes: list, way: list[int]) -> list:
        out = []
        for i, n in enumerate(nodes):
            own = way[1:] if way and way[0] == i else []
            out.append(n if n[0] == "#" else [*n[:4], cut(n[4], own) if own or holds(n) else []])
        return out

    return cut(wrapper, path)


PROSE = frozenset("h1 h2 h3 h4 h5 h6 p li blockquote pre dd dt td b i em strong a".split())


class Blocks:
    """Collects the blocks of a region in page order."""

    def __init__(self, fixed: set, by_class: bool, named: bool):
        self.fixed, self.by_class = fixed, by_class
        #: Near copies of a page share its text, so inside an article headings and paragraphs are never template.
        self.kept = PROSE if named else frozenset()
        self.out: list[tuple[str, int, int]] = []  # text, its characters, those inside links
        self.parts: list[str] = []
        self.linked = 0

    def end(self) -> None:
        if text := " ".join("".join(self.parts).split()):
            self.out.append((text, len(text), min(self.linked, len(text))))
        self.parts, self.linked = [], 0

    def add(self, e: Element, link: bool = False) -> None:
        for index, kid in enumerate(e.kids):
            if isinstance(kid, str):
                if (id(e), index) not in self.fixed or e.name in self.kept:
                    self.parts.append(kid)
                    self.linked += link * len(" ".join(kid.split()))
            elif kid.name == "br" or kid.name in ("td", "th"):
                self.parts.append(" ")
                self.add(kid, link)
            elif kid.name in BLOCK:
                self.end()
                if not kid.is_noise(self.by_class) and not (kid.name == "header" and e.name != "article"):
                    self.add(kid, link)
                self.end()
            elif not kid.is_noise(self.by_class):
                self.add(kid, link or kid.name == "a")


def regions(root: Element, by_class: bool) -> list[Element]:
    """Outermost articles, else main elements, else none."""

    def find(wanted) -> list[Element]:
        out = []

        def walk(e: Element) -> None:
            for kid in e.kids:
                if not isinstance(kid, str) and not kid.is_noise(by_class):
                    if wanted(kid):
                        out.append(kid)
                    else:
                        walk(kid)

        walk(root)
        return out

    for wanted in (lambda e: e.name == "article", lambda e: e.name == "main" or e.role == "main", _named_main):
        if found := find(wanted):
            return found
    return []


def _named_main(e: Element) -> bool:
    """A container whose class or id names it the content."""
    return e.name in CONTAINERS and any(MAIN_WORDS.intersection(re.split(r"[^a-z]+", w)) for w in e.words)


def _collected(places: list[Element], fixed: set, by_class: bool, named: bool) -> list[tuple[str, int, int]]:
    blocks = Blocks(fixed, by_class, named)
    for place in places:
        blocks.add(place)
        blocks.end()
    return blocks.out


def main_text(page: str, wrapper: list | None = None, path: list[int] | None = None) -> str:
    """The main text of a page: its blocks, joined by an empty line.

    It is read where the wrapper has the article (``path``, by default as :func:`main_path` finds it).  Should nothing be
    there, or without a wrapper, the page is read by names: of article and main elements, else of parts
    named the content by their class if they hold the larger part of the text, else of all of it but lists of links.
    Should nothing be left, the template is kept as well, and then names of classes are ignored.
    """
    root, wrapper = parse(page), wrapper or []
    path = main_path(wrapper) if path is None else path
    fixed = template_texts(root, wrapper) if wrapper else set()
    place = located(root, wrapper, path) if path else None
    if place is not None and (found := _collected([place], fixed, True, True)):
        return "\n\n".join(t for t, _, _ in found)
    for template, by_class in ((fixed, True), (set(), True), (set(), False)):
        places = regions(root, by_class)
        sure = bool(places) and not _named_main(places[0]) or any(p.name in ("article", "main") for p in places)
        found = _collected(places, template, by_class, bool(places))
        if not sure:
            whole = [b for b in _collected([root], template, by_class, False) if b[2] < 0.8 * b[1]]
            if 2 * sum(n for _, n, _ in found) < sum(n for _, n, _ in whole):
                found = whole
        if found:
            return "\n\n".join(t for t, _, _ in found)
    return ""


def host(url: str | None) -> str | None:
    try:
        return urlsplit((url or "").strip()).hostname or None
    except ValueError:
        return None


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}

    def emptied() -> pa.RecordBatch:
        rows = [(h, zlib.crc32(s.encode()) % SALTS, s) for h, w in held.items() for s in [dumped(w)]]
        held.clear()
        return _wrapper_batch(rows)

    for batch in batches:
        for url, page in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
            if name := host(url):
                own = stream(parse(page))
                held[name] = combine(held[name], own) if name in held else combine(own, [])
                if len(held) > HOSTS_HELD or _size(held[name]) > RARE * MAX_NODES:
                    yield emptied()
    yield emptied()


def _wrapper_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[], [], []]
    types = (pa.string(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["host", "salt", "wrapper"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by host and salt.  Wrappers are merged two by two, so that large ones are aligned a few times only."""
    key: tuple | None = None
    held: list[tuple[int, list]] = []

    def put(wrapper: list) -> None:
        n = 1
        while held and held[-1][0] <= n:
            m, other = held.pop()
            n, wrapper = n + m, combine(other, wrapper)
        held.append((n, wrapper))

    def merged() -> str:
        while len(held) > 1:
            n, wrapper = held.pop()
            m, other = held.pop()
            held.append((n + m, combine(other, wrapper)))
        return dumped(held.pop()[1])

    for batch in batches:
        out = []
        for name, salt, wrapper in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != (name, salt):
                if key is not None:
                    out.append((*key, merged()))
                key = (name, salt)
            put(loaded(wrapper))
        yield _wrapper_batch(out)
    if key is not None:
        yield _wrapper_batch([(*key, merged())])


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """``host, wrapper`` (JSON) of every host of ``pages`` (``url``, ``html``), from all its pages."""
    schema = "host string, salt int, wrapper string"
    parts = pages.select("url", "html").mapInArrow(_infer, schema)
    for salt in (F.col("salt"), F.lit(0)):
        parts = parts.select("host", salt.alias("salt"), "wrapper").repartition("host", "salt").sortWithinPartitions("host", "salt", "wrapper")
        parts = parts.mapInArrow(_merge, schema)
    return parts.select("host", "wrapper")


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What pages need of the wrappers of their hosts, and its number of nodes."""
    for batch in batches:
        out, sizes = [], []
        for text in batch.column(1).to_pylist():
            whole = loaded(text)
            path = main_path(whole)
            needed = essential(whole, path)
            out.append(json.dumps([path, dumped(needed)]))
            sizes.append(_size(needed))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(sizes, pa.int64())], names=["host", "wrapper", "nodes"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, tuple] = {None: (None, None)}
    for batch in batches:
        found = []
        for page, wrapper in zip(texts(batch.column(2)), batch.column(3).to_pylist(), strict=True):
            if wrapper not in known:
                if len(known) > HOSTS_HELD:
                    known = {None: (None, None)}
                path, whole = json.loads(wrapper)
                known[wrapper] = loaded(whole), path
            found.append(main_text(page, *known[wrapper]))
        columns = [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])


def _extract_dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of groups of a host's pages, each behind a row with the wrapper (``page`` is false)."""
    known: tuple = (None, None)
    for batch in batches:
        found: list[str] = []
        for is_page, html_, wrapper in zip(batch.column(4).to_pylist(), texts(batch.column(2)), batch.column(3).to_pylist(), strict=True):
            if is_page:
                found.append(main_text(html_, *known))
            else:
                path, whole = json.loads(wrapper)
                known = loaded(whole), path
        rows = batch.filter(batch.column(4))
        columns = [rows.column(0), rows.column(1), pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])


def _dealt(rows: DataFrame, large: DataFrame) -> DataFrame:
    """The texts of pages whose host is in ``large`` (``host, wrapper``)."""
    own = rows.join(large.select("host"), "host")
    groups = materialise(own.groupBy("host").agg(F.ceil(F.count("*") / PAGES_DEALT).cast("int").alias("groups")), "page-groups")
    salt = F.pmod(F.xxhash64("page_id", "url", "html"), "groups").cast("int").alias("salt")
    pages = own.join(groups, "host").select("page_id", "url", "html", F.lit(None).cast("string").alias("wrapper"), F.lit(True).alias("page"), "host", salt)
    each = F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("salt")
    none = [F.lit(None).cast(t).alias(c) for c, t in pages.dtypes[:3]]
    wrappers = large.join(groups, "host").select(*none, "wrapper", F.lit(False).alias("page"), "host", each)
    both = pages.unionByName(wrappers).repartition("host", "salt").sortWithinPartitions("host", "salt", "page")
    return both.select("page_id", "url", "html", "wrapper", "page").mapInArrow(_extract_dealt, EXTRACTED)


EXTRACTED = "page_id long, url string, text string, n_chars long"


def _host_column(url: Column) -> Column:
    def hosts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(map(host, batch.to_pylist()), pa.string())

    hosts.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(hosts, "string")(url)


def extract_main_text(pages: DataFrame, carried: int = MAX_NODES) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages`` (``page_id``, ``url``, ``html``; others are ignored).

    A null or empty page, and one without text of its own, has an empty text.  Pages without a host in their url are
    read without a wrapper.  Repeated rows are all returned; an empty table gives an empty one.
    """
    schema = "host string, wrapper string, nodes long"
    wrappers = materialise(infer_wrappers(pages).mapInArrow(_finished, schema), "wrappers")
    rows = pages.select("page_id", "url", "html", _host_column(F.col("url")).alias("host"))
    large = wrappers.where(F.col("nodes") > carried).select("host", "wrapper")
    none_large = large.isEmpty()
    if none_large:
        joined = rows.join(wrappers, "host", "left")
    else:
        joined = rows.join(large, "host", "left_anti").join(wrappers.where(F.col("nodes") <= carried), "host", "left")
    found = joined.select("page_id", "url", "html", "wrapper").mapInArrow(_extract, EXTRACTED)
    return found if none_large else found.unionByName(_dealt(rows, large))

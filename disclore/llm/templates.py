"""Main text of web pages, by deducing each host's template from equivalence classes of tokens.

1. Every page is read as tokens: opening and closing block tags, told apart by their path (tag, class and id of all
   ancestors), and whole text runs with the path they stand in. ``vectors`` counts each token on each page of its host.
   An occurrence vector is never gathered: it is told by sums over the pages of hashes of (page, count), four sums
   modulo a prime, which tasks and Spark add up as they please.
2. Tokens of one host with equal vectors, found on at least half of its pages, are an equivalence class. A text run counts as
   template text if its class holds tags too and spans MIN_TEXT_PAGES pages: it comes whenever that piece of the layout
   does.
3. ``checked`` walks the pages again with their host's classes and keeps those that are ordered (their tokens come in one
   order, instance after instance) and nested (an instance lies in one gap of the instance around it). Hosts with invalid
   classes are walked once more without them. What is left between the tokens of valid classes are the template's slots;
   per slot and container it sums the text found there.
4. ``_decided`` picks, for each host, the container of the main text: the deepest article or main element, or element named
   like one, with half of the slots' text; else the deepest element that stands once on a page and has three quarters of
   it. Slots inside it are main unless they are mostly links. Text under menus, forms, notices and the like, told by tag or
   name, is in no slot's sum and no result.
5. ``main_text`` reads the pages a last time and joins the text of main slots.

Only sums for each host's tokens, classes and slots are shuffled, pre-added in each task; pages never are, unless there are
too many templates to broadcast: then pages and templates meet by host and a salt, so that a host with a third of all
pages is many tasks. A host's classes and slots meet in one task: they grow with its layout, not with its pages.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Container, Iterator
from functools import reduce
from hashlib import blake2b
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, is_empty, small_batches, written

PRIME = (1 << 31) - 1
#: Pages from which a constant text run can be template text: below, it may as well be a copied article.
MIN_TEXT_PAGES = 5
SUPPORT, MAIN_SHARE, ANY_SHARE, LINK_SHARE = 0.5, 0.5, 0.75, 0.7
#: Walks over a host's pages at most, to find classes that are invalid. Those of most hosts are valid at once.
WALKS = 3
#: Bytes of all templates together up to which they are broadcast, entries a task adds up before it emits, parts of a host.
BROADCAST_BYTES, ENTRIES, SALTS = 32 << 20, 200_000, 64

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav noframes noscript ol optgroup option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul button iframe object audio video canvas svg math".split())
RAW = frozenset("script style textarea title iframe noembed noframes noscript xmp".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
P_SCOPES = frozenset("table td th caption button object html".split())
#: tag: (what it closes, where the search for it ends)
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select", "optgroup"}), "body": ({"head"}, {"html"})}
CONTAINERS = frozenset("article main section div td body center".split())

#: Tags and names of what is no main text.
OUT_TAGS = frozenset("head nav footer aside form button select textarea dialog menu search script style noscript template iframe noembed noframes object svg math canvas audio video title".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
OUT_WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar aside footer masthead cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login signin share sharing social related recommended recommendations teaser teasers pagination pager paging toolbar widget widgets copyright disclaimer skip hidden form comment comments commentlist respond reply replies discussion disqus feedback".split())
#: Of these, the ones that may also name a frame around the main text.
LAYOUT_WORDS = frozenset("sidebar nav navbar menu aside widget widgets footer masthead banner notice cookie cookies".split())
MAIN_WORDS = frozenset("article articlebody content main post entry story".split())
FRAMED_WORDS = MAIN_WORDS - {"content"}

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>")
_BARE_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"([^\s=/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|[^A-Za-z0-9]+")


def _hash(*parts: object) -> int:
    return int.from_bytes(blake2b("\x00".join(map(str, parts)).encode("utf-8", "replace"), digest_size=8).digest(), "big") >> 2


class Node:
    """An element's path: its hash, that of its parent's path, and what its names tell."""

    __slots__ = ("key", "parent", "tag", "out", "soft", "main", "container", "within", "up")

    def __init__(self, up: Node | None, tag: str, attrs: str) -> None:
        found = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attrs)} if attrs.strip(" /") else {}
        # numbers of ids, and long ones of classes, name the page rather than the place
        names = re.sub(r"\d{3,}", "0", found.get("class", "")) + " " + re.sub(r"\d+", "0", found.get("id", ""))
        self.up, self.tag, self.parent = up, tag, up.key if up else 0
        self.key = _hash(self.parent, tag, names.strip().lower())
        words = {w.lower() for w in _CAMEL.split(names) if w}
        if words & {"with", "has", "no", "without"}:  # names like with-sidebar tell of a frame around everything
            words -= LAYOUT_WORDS
        role = found.get("role", "").lower()
        self.within = tag in ("article", "main") or (up is not None and up.within)
        self.main = tag in ("article", "main") or role == "main" or found.get("itemprop", "").lower() == "articlebody" or (tag in CONTAINERS and tag != "body" and bool(words & MAIN_WORDS))
        hard = tag in OUT_TAGS or role in OUT_ROLES or "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I) is not None
        hard |= (tag == "header" or "header" in words) and not self.within and not self.main and tag not in ("body", "html")
        soft = words & OUT_WORDS if tag not in ("html", "body", "main") else set()
        if tag == "article":
            soft -= LAYOUT_WORDS
        above = up is not None and up.out
        if above and up.soft and (tag in ("article", "main") or (self.main and words & FRAMED_WORDS)):
            above = False  # a frame that is named after one of its parts
        self.out = above or hard or bool(soft)
        self.soft = self.out and not hard and (up.soft if above else soft <= LAYOUT_WORDS)
        self.container = tag in CONTAINERS


_nodes: dict[tuple, Node] = {}


def _node(up: Node | None, tag: str, attrs: str) -> Node:
    key = (up.key if up else 0, tag, attrs)
    node = _nodes.get(key)
    if node is None:
        if len(_nodes) >= 50_000:
            _nodes.clear()
        node = _nodes[key] = Node(up, tag, attrs)
    return node


OPEN, CLOSE, TEXT = 0, 1, 2


def events(html: str) -> list[tuple]:
    """(OPEN or CLOSE, node), and (TEXT, node, text, linked characters) for text that no tag or name rules out, in page order.

    White space in a block is one blank; character references are decoded. Tags that HTML allows to leave out are
    closed; what follows an unfinished tag, comment, script or style is part of it. Each character is looked at a bounded
    number of times.
    """
    out: list[tuple] = []
    stack: list[Node] = []
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked, in_link = 0, False
    root = top = _node(None, "", "")
    open_p: list[int] = []  # of each open element: where the paragraph is that a new block would close, or -1

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append((TEXT, top, text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def pop_to(depth: int) -> None:
        nonlocal top
        for n in stack[depth:]:
            opened[n.tag] -= 1
        del stack[depth:]
        del open_p[depth:]
        top = stack[-1] if stack else root

    def close_sibling(tags: set[str], stop: set[str]) -> None:
        for d in range(len(stack) - 1, -1, -1):
            if stack[d].tag in tags:
                while d and stack[d - 1].tag in tags:
                    d -= 1
                return pop_to(d)
            if stack[d].tag in stop or stack[d].tag not in ("p", "div", "address"):
                return

    quotes = True  # until a quote turns out to have no end: from there on tags end at their first >
    i, n = 0, len(html)
    while i < n:
        j = html.find("<", i)
        if j < 0:
            j = n
        if j > i and not top.out:
            raw = html[i:j]
            parts.append(raw)
            if in_link:
                linked += len(raw)
        if j >= n:
            break
        nxt = html[j + 1 : j + 2]
        if nxt in ("!", "?"):
            end = html.find("-->", j + 4) if html.startswith("<!--", j) else html.find(">", j)
            if html.startswith(("<!-->", "<!--->"), j):
                end = html.find(">", j) - 2
            if end < 0:
                break
            i = end + (3 if html.startswith("<!--", j) else 1)
            continue
        if not (nxt.isascii() and (nxt.isalpha() or nxt == "/")):
            if not top.out:
                parts.append("<")
            i = j + 1
            continue
        m = _TAG.match(html, j) if quotes else _BARE_TAG.match(html, j)
        if m is None and quotes and (m := _BARE_TAG.match(html, j)) is not None:
            quotes = False
        if m is None:
            end = html.find(">", j)
            if end < 0:
                break
            if nxt == "/":  # an end tag without a name is a comment
                i = end + 1
            else:
                i = j + 1
            continue
        i = m.end()
        end_tag, tag, attrs = m[1], m[2].lower(), m[3]
        if tag == "a":
            in_link = not end_tag
        if tag in ("br", "hr"):
            parts.append(" ")
        if end_tag:
            if tag in BLOCK and opened[tag] > 0 and (tag != "p" or open_p[-1] >= 0):
                flush()
                d = len(stack) - 1
                while stack[d].tag != tag:
                    d -= 1
                out.append((CLOSE, stack[d]))
                pop_to(d)
            elif tag in BLOCK:
                flush()
            continue
        if tag in BLOCK or tag in RAW:
            flush()
            if tag in CLOSES_P and open_p and open_p[-1] >= 0:
                pop_to(open_p[-1])
            if tag in SIBLINGS and any(opened[t] > 0 for t in SIBLINGS[tag][0]):
                close_sibling(*SIBLINGS[tag])
            if tag in ("html", "body") and opened[tag] > 0:
                continue
            if tag in RAW:
                closing = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, i)
                if closing is None:
                    break
                end = html.find(">", closing.end())
                if end < 0:
                    break
                i = end + 1
                continue
            if tag not in VOID:
                top = _node(top if stack else None, tag, attrs)
                open_p.append(len(stack) if tag == "p" else -1 if tag in P_SCOPES or not open_p else open_p[-1])
                stack.append(top)
                opened[tag] += 1
                out.append((OPEN, top))
                if attrs.endswith("/") and tag in ("svg", "math"):
                    pop_to(len(stack) - 1)
    flush()
    return out


def token_of(event: tuple) -> int:
    kind, node = event[0], event[1]
    return _hash(node.key, event[2]) | 1 << 62 if kind == TEXT else open_token(node) + kind


def open_token(node: Node) -> int:
    return node.key * 2 % (1 << 62)


def nearest(node: Node, containers: Container, known: dict[int, int]) -> int:
    """The token of the innermost element around (or at) ``node`` that is in ``containers``, or 0; ``known`` remembers."""
    path, at, found = [], node, 0
    while at is not None:
        token = open_token(at)
        if token in known:
            found = known[token]
            break
        path.append(token)
        if token in containers:
            found = token
            break
        at = at.up
    for token in path:
        known[token] = found
    return found


def host_of(url: Column) -> Column:
    """The host of an address, in lower case; '' for null and for what is no address."""
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


VECTORS = "host string, token long, is_text boolean, pages long, total long, first long, f0 long, f1 long, f2 long, f3 long, parent long, container boolean, main boolean"


def vectors(pages: DataFrame) -> DataFrame:
    """(host, token, is_text, pages, total, first, f0 .. f3, parent, container, main) of ``pages`` (host, html): on how many
    pages a token stands, how often in all, the sum of its first places, and its occurrence vector as four sums.

    A task leaves out text runs that share their vector, on the task's pages of the host, with no tag: they share it with
    none on all pages either.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], list] = {}

        def emit() -> pa.RecordBatch:
            tags = {(host, *v[3:7]) for (host, _), v in sums.items() if not v[0]}
            rows = [(host, token, *v) for (host, token), v in sums.items() if not v[0] or (host, *v[3:7]) in tags]
            rows = [(h, t, x, p, n, first, *f, parent, c, m) for h, t, x, p, n, *f, first, parent, c, m in rows]
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 13, kinds)], names=names)

        names = [f.split()[0] for f in VECTORS.split(", ")]
        kinds = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[f.split()[1]] for f in VECTORS.split(", ")]
        for batch in batches:
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = events(html)
                counts: dict[int, list] = {}
                for place, e in enumerate(found):
                    entry = counts.setdefault(token_of(e), [0, place, e])
                    entry[0] += 1
                page, mixed = blake2b(html.encode("utf-8", "replace"), digest_size=16).digest(), {}
                for token, (k, place, e) in counts.items():
                    mix = mixed.get(k)
                    if mix is None:
                        d = blake2b(page + k.to_bytes(8, "big"), digest_size=16).digest()
                        mix = mixed[k] = [int.from_bytes(d[x : x + 4], "big") % PRIME for x in (0, 4, 8, 12)]
                    old = sums.get((host, token))
                    if old is None:
                        node = e[1]
                        sums[host, token] = [e[0] == TEXT, 1, k, *mix, place, open_token(node) if e[0] == TEXT else node.parent * 2 % (1 << 62), e[0] == OPEN and node.container and not node.out, e[0] == OPEN and node.main and not node.out]
                    else:
                        old[1] += 1
                        old[2] += k
                        for x in range(4):
                            old[3 + x] = (old[3 + x] + mix[x]) % PRIME
                        old[7] += place
            if len(sums) >= ENTRIES:
                yield emit()
        yield emit()

    raw = small_batches(pages.select("host", "html")).mapInArrow(work, VECTORS)
    added = raw.groupBy("host", "token").agg(F.first("is_text").alias("is_text"), *[F.sum(c).alias(c) for c in ("pages", "total", "first")], *[(F.sum(f"f{x}") % PRIME).alias(f"f{x}") for x in range(4)], F.min("parent").alias("parent"), F.max("container").alias("container"), F.max("main").alias("main"))
    return added


class Template:
    """A host's classes: for each token its class and its place in it; of each class how many tokens it has."""

    def __init__(self, place: dict[int, tuple[int, int]], sizes: list[int], texts: set[int], containers: dict[int, tuple[int, bool, bool]]) -> None:
        self.place, self.sizes, self.texts, self.containers = place, sizes, texts, containers
        self.keep: set[tuple[int, int, int]] = set()
        self.chosen = 0

    def walk(self, found: list[tuple]) -> tuple[list[tuple[tuple[int, int, int], tuple]], set[int], dict[int, tuple[int, int]]]:
        """(slot and text event) of a page, the classes that are out of order or cross another one, and each class's gap.

        A slot is (class, gap, container): the innermost open instance, its last token seen, and the nearest element of
        the template that may hold a main text.
        """
        slots, bad, inside = [], set(), {}
        stack: list[list[int]] = []
        live: Counter[int] = Counter()
        near: dict[int, int] = {}
        for e in found:
            kind = e[0]
            token = token_of(e)
            at = self.place.get(token)
            if at is not None and not (kind == TEXT and token not in self.texts):
                c, k = at
                if k == 0 and not live[c]:
                    gap = (stack[-1][0], stack[-1][1]) if stack else (-1, 0)
                    if inside.setdefault(c, gap) != gap:
                        bad.add(c)
                    stack.append([c, 0])
                    live[c] += 1
                else:
                    while live[c] and stack[-1][0] != c:  # it crosses the end of what it lies in
                        bad.add(stack[-1][0])
                        live[stack.pop()[0]] -= 1
                    if not live[c] or stack[-1][1] != k - 1:
                        bad.add(c)
                    if live[c]:
                        stack[-1][1] = k
                if stack and stack[-1][0] == c and stack[-1][1] == self.sizes[c] - 1:
                    live[stack.pop()[0]] -= 1
            if kind == TEXT and token not in self.texts:
                slots.append(((*(stack[-1] if stack else (-1, 0)), nearest(e[1], self.containers, near)), e))
        bad |= {s[0] for s in stack}
        return slots, bad, inside

    def without(self, bad: set[int]) -> Template:
        return Template({t: p for t, p in self.place.items() if p[0] not in bad}, self.sizes, {t for t in self.texts if self.place[t][0] not in bad}, self.containers)


def _classes(rows: pd.DataFrame) -> Template:
    """A host's template from its frequent tokens' vectors, before order and nesting are checked."""
    place, sizes, texts, containers = {}, [], set(), {}
    for _, group in rows.groupby(["f0", "f1", "f2", "f3", "pages", "total"], sort=True):
        tags = int((~group["is_text"]).sum())
        group = group[~group["is_text"] | ((group["pages"] >= MIN_TEXT_PAGES) & (tags > 0))]
        if len(group) < 2:
            continue
        ordered = group.sort_values(["first", "token"])
        for k, (token, is_text) in enumerate(zip(ordered["token"], ordered["is_text"])):
            place[int(token)] = (len(sizes), k)
            if is_text:
                texts.add(int(token))
        sizes.append(len(ordered))
    for r in rows[rows["container"]].itertuples():
        containers[int(r.token)] = (int(r.parent), bool(r.main), r.total == r.pages)
    # parents that are no containers themselves lead to those above
    up = {int(r.token): int(r.parent) for r in rows.itertuples() if not r.is_text}
    known: dict[int, int] = {c: c for c in containers}
    for token, (parent, main, once) in list(containers.items()):
        path = []
        while parent not in known and parent in up:
            path.append(parent)
            parent = up[parent]
        for x in path:
            known[x] = known.get(parent, 0)
        containers[token] = (known.get(parent, 0), main, once)
    return Template(place, sizes, texts, containers)


def _decided(template: Template, slots: dict[tuple[int, int, int], tuple[int, int]]) -> Template:
    """``template`` with its main slots; ``slots`` has characters and linked characters of each."""
    kinds = template.containers
    depth: dict[int, int] = {0: 0}
    for c in kinds:
        path = []
        while c not in depth:
            path.append(c)
            c = kinds[c][0] if c in kinds else 0
        for x in reversed(path):
            depth[x] = depth[kinds[x][0]] + 1
    inward = sorted(kinds, key=lambda c: (depth[c], c))
    mass: Counter[int] = Counter()
    for (_, _, c), (chars, linked) in slots.items():
        mass[c] += chars - linked
    for c in reversed(inward):
        mass[kinds[c][0]] += mass[c]
    total, chosen = mass[0], 0
    for share, fits in ((MAIN_SHARE, lambda c: kinds[c][1]), (ANY_SHARE, lambda c: kinds[c][2])):
        found = [(depth[c], mass[c], c) for c in inward if total and fits(c) and mass[c] >= share * total]
        if found and not chosen:
            chosen = max(found)[2]
    inside = {chosen}
    for c in inward:
        if kinds[c][0] in inside:
            inside.add(c)
    template.chosen = chosen
    template.keep = {s for s, (chars, linked) in slots.items() if linked <= LINK_SHARE * chars and s[2] in inside}
    return template


def _page_text(template: Template, html: str) -> str:
    found = events(html)
    slots, _, _ = template.walk(found)
    kept = [e[2] for slot, e in slots if slot in template.keep]
    if not kept and not any(e[0] == OPEN and open_token(e[1]) == template.chosen for e in found):
        kept = [e[2] for e in _own_text(found)]  # a page that is built unlike its host's others
    return " ".join(kept)


def _own_text(found: list[tuple]) -> list[tuple]:
    """The main text events of a page by itself: its own best container, without parts that are mostly links."""
    opened = [e[1] for e in found if e[0] == OPEN and e[1].container and not e[1].out]
    seen = Counter(open_token(x) for x in opened)
    near: dict[int, int] = {}
    containers = {open_token(x): (nearest(x.up, seen, near) if x.up else 0, x.main, seen[open_token(x)] == 1) for x in opened}
    sums: dict[tuple[int, int, int], tuple[int, int]] = {}
    where = []
    for e in found:
        if e[0] == TEXT:
            slot = (e[1].key, 0, nearest(e[1], containers, near))
            old = sums.get(slot, (0, 0))
            sums[slot] = (old[0] + len(e[2]), old[1] + e[3])
            where.append((slot, e))
    keep = _decided(Template({}, [], set(), containers), sums).keep
    return [e for slot, e in where if slot in keep]


def _with_templates(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """``pages`` with their host's ``template``: broadcast while all of them are small, else by host and salt."""
    size = templates.agg(F.sum(F.length("template") + F.length("host") + 16)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return pages.join(F.broadcast(templates), "host", "left")
    spread = templates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pages.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")).join(spread, ["host", "salt"], "left").drop("salt")


def _cached(blob: bytes, cache: dict[bytes, Template]) -> Template:
    key = blake2b(blob, digest_size=16).digest()
    if key not in cache:
        if len(cache) >= 256:
            cache.clear()
        cache[key] = pickle.loads(blob)
    return cache[key]


STATS = "host string, kind string, class long, gap long, container long, a long, b long"


def checked(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """(host, kind, class, gap, container, a, b): ``slot`` rows have the characters (a) and linked characters (b) found in a
    slot, ``bad`` rows name classes that some page has out of order or crossing, ``in`` rows the least and greatest gap
    (a, b) that holds a class's instances."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, Template] = {}
        sums: dict[tuple, list[int]] = {}

        def emit() -> pa.RecordBatch:
            rows = [(*k, *v) for k, v in sums.items()]
            sums.clear()
            kinds = [pa.string(), pa.string(), *[pa.int64()] * 5]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names=[f.split()[0] for f in STATS.split(", ")])

        for batch in batches:
            for host, html, blob in zip(*[batch.column(x).to_pylist() for x in range(3)]):
                slots, bad, inside = _cached(blob, cache).walk(events(html))
                for slot, e in slots:
                    old = sums.setdefault((host, "slot", *slot), [0, 0])
                    old[0] += len(e[2])
                    old[1] += e[3]
                for c in bad:
                    sums[host, "bad", c, 0, 0] = [0, 0]
                for c, (outer, gap) in inside.items():
                    code = (outer + 1) << 32 | gap
                    old = sums.setdefault((host, "in", c, 0, 0), [code, code])
                    old[0], old[1] = min(old[0], code), max(old[1], code)
            if len(sums) >= ENTRIES:
                yield emit()
        yield emit()

    raw = _with_templates(pages, templates).where("template is not null").select("host", "html", "template").mapInArrow(work, STATS)
    slot = F.col("kind") == "slot"
    out = raw.groupBy("host", "kind", "class", "gap", "container").agg(F.sum("a").alias("s"), F.sum("b").alias("t"), F.min("a").alias("x"), F.max("b").alias("y"))
    return out.select("host", "kind", "class", "gap", "container", F.when(slot, F.col("s")).otherwise(F.col("x")).alias("a"), F.when(slot, F.col("t")).otherwise(F.col("y")).alias("b"))


def templates(pages: DataFrame) -> DataFrame:
    """(host, template) of ``pages`` (host, html), as binary: valid classes, main slots and the main container."""
    counted = written(vectors(pages), "vectors")
    sizes = pages.groupBy("host").agg(F.count("*").alias("of"))
    few = counted.join(F.broadcast(sizes) if sizes.count() <= 1_000_000 else sizes, "host").where(F.col("pages") >= F.greatest(SUPPORT * F.col("of"), F.lit(1)))
    made = written(few.drop("of").groupBy("host").applyInPandas(lambda rows: pd.DataFrame({"host": rows["host"].iloc[:1], "template": [pickle.dumps(_classes(rows))]}), "host string, template binary"), "classes")
    discard(counted)
    done: list[DataFrame] = []
    for left in range(WALKS - 1, -1, -1):
        stats = written(checked(pages, made), "slots")
        judged = written(made.groupBy("host").cogroup(stats.groupBy("host")).applyInPandas(_judge_last if left == 0 else _judge, "host string, template binary, again boolean"), "templates")
        discard(made)
        discard(stats)
        done.append(judged.where("not again").drop("again"))
        made = judged.where("again").drop("again")
        if is_empty(made):
            break
    return reduce(DataFrame.union, done)


def _judged(left: pd.DataFrame, right: pd.DataFrame, last: bool) -> pd.DataFrame:
    """The decided template of a host or, if classes turned out to be invalid, the template without them, to be walked
    ``again``. After the last walk it is left with no classes: its slots are its containers."""
    template: Template = pickle.loads(left["template"].iloc[0])
    bad = set(right.loc[(right["kind"] == "bad") | ((right["kind"] == "in") & (right["a"] != right["b"])), "class"])
    again = bool(bad) and not last
    if again:
        template = template.without(bad)
    else:
        slots: dict[tuple[int, int, int], tuple[int, int]] = {}
        for r in right[right["kind"] == "slot"].itertuples(index=False):
            slot = (-1, 0, int(r[4])) if bad else (int(r[2]), int(r[3]), int(r[4]))
            old = slots.get(slot, (0, 0))
            slots[slot] = (old[0] + int(r[5]), old[1] + int(r[6]))
        template = _decided(Template({}, [], set(), template.containers) if bad else template, slots)
    return pd.DataFrame({"host": left["host"].iloc[:1], "template": [pickle.dumps(template)], "again": [again]})


def _judge(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    return _judged(left, right, False)


def _judge_last(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    return _judged(left, right, True)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a page: page_id, url, text, n_chars (code points).

    Null html counts as empty: text ''. Pages with a null url, or one without a host, are taken for pages of one host ''.
    Null ids and repeated rows keep rows of their own; an empty table gives no rows; other columns are not read. Whole
    pages are read, whatever their length. Pages that have nothing of their host's main container, and those of hosts
    with a single page, are judged by their own text alone.
    """
    slim = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), host_of(pages[url_col]).alias("host"), F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("html"))
    known = templates(slim.select("host", "html"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, Template] = {}
        empty = Template({}, [], set(), {})
        for batch in batches:
            texts = [_page_text(_cached(blob, cache) if blob else empty, html) for html, blob in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = small_batches(_with_templates(slim, known)).select("page_id", "url", "html", "template")
    return rows.mapInArrow(work, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url {rows.schema['url'].dataType.simpleString()}, text string, n_chars long")

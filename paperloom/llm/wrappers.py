"""The main body of pages, apart from menus, notices, inserts and footers.

For every host a wrapper is inferred, a union-free regular expression over the
tokens of its pages: containers in order, some of them optional, some repeated,
and in each a repeated group of text slots. The pages of a host are aligned to
its wrapper one after the other. Where a container has no partner it becomes
optional; where a region of text holds several containers of one kind they
become one repeated group; where texts differ, the place becomes a slot; texts
that recur stay constants. Partial wrappers of parts of a host are aligned to
each other in the same way, so a host of any size is spread over all tasks. No
container is forgotten, however many a host has and however rare one is. Then
each page is aligned to the whole wrapper, which gives its containers their
places; pages, blocks and texts of each place are counted, all of them.

The body is the group of slots with most running text a page, with the lists and
tables in it, the groups in and beside it that hold running text as it does, and
the page's own headline. Pages without their full markup have only a list of blocks;
there the constants the host's wrapper has outside the body, the links and the
order of blocks tell what belongs to it.

Defined results: pages with neither markup give no rows, and so do pages whose
body is wholly replaced by an error, a demand for scripts, filler or
placeholders; a page alone on its host is its own wrapper; null hosts form one
host; block numbers that occur twice are given once; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as _html
import json
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm import residue
from paperloom.llm.unify import one_form
from paperloom.session import settle

#: A text is a constant of its place from one page in COMMON on.
COMMON = 16
#: Pages are merged one by one into a wrapper of up to this many containers; a wider one is merged
#: with its equals only (:func:`gather`). What is held doesn't depend on it.
WIDE = 400
#: A task hands on its partial wrappers when they have so many containers together.
HELD = 300_000
#: Pages of a host that are taken together with its rule, at least.
CHUNK = 1000
#: A place beside the body belongs to it if it has so much of the body's running text a page.
ALIKE = 0.35

TOKEN = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
COMMENT = re.compile(r"<!--.*?-->", re.S)
MARK = re.compile(r"\bdata-b\s*=\s*[\"']?(\d+)", re.I)
ATTRIBUTE = re.compile(r"\b(class|id|role|colspan|valign|align)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
VOID = frozenset("br img hr meta link input wbr source".split())
# Elements that hold regions of a page.
CONTAINERS = frozenset("body div section article main aside header footer nav ul ol dl table tbody thead tr td th center form fieldset figure details".split())
#: Of these, those that belong to the text they stand in.
LISTED = frozenset("ul ol dl table tbody thead tr td th figure details".split())
HIDDEN = frozenset("script style title head noscript template svg".split())
HIDING = re.compile(r"<(script|style|title|noscript|template|svg)\b.*?</\1\s*>", re.S | re.I)
DIGITS = str.maketrans("123456789", "0" * 9)


@dataclass
class Leaf:
    """A marked element: its number, tag, text, how it begins and what of it are links."""

    mark: int
    tag: str
    parts: list = field(default_factory=list)
    linked: list = field(default_factory=list)
    href: str = ""
    leads: bool = False

    @property
    def text(self) -> str:
        raw = "".join(self.parts)
        return _html.unescape(raw) if "&" in raw else raw


@dataclass
class Box:
    """A container, of a page or of a wrapper."""

    sig: str
    kids: list = field(default_factory=list)
    leaves: list = field(default_factory=list)  # of a page
    pages: int = 1
    #: blocks, blocks that are links, bytes of running text, headlines
    stats: list = field(default_factory=lambda: [0, 0, 0, 0])
    texts: dict = field(default_factory=dict)  # hash: [pages, bytes of running text]
    #: whether one page has several of its kind here
    many: int = 0
    #: number of the place in the whole wrapper of its host
    no: int = -1

    def pack(self):
        return [self.sig, self.pages, self.stats, self.texts, [k.pack() for k in self.kids], self.many]

    @staticmethod
    def unpack(p) -> Box:
        return Box(p[0], [Box.unpack(k) for k in p[4]], [], p[1], p[2], p[3], p[5])

    @property
    def listed(self) -> bool:
        return re.match("[a-z0-9]+", self.sig)[0] in LISTED


def parse(markup: str) -> Box:
    """The containers of a page and the marked elements directly in each."""
    if "<!--" in markup:
        markup = COMMENT.sub("", markup)
    markup = HIDING.sub("", markup)
    root = Box("page")
    stack: list[tuple[str, Box]] = [("", root)]
    leaf: Leaf | None = None
    in_link, at = False, 0
    for m in TOKEN.finditer(markup):
        if leaf is not None and m.start() > at:
            text = markup[at : m.start()]
            if not leaf.parts and not leaf.linked and in_link and text.strip():
                leaf.leads = True
            leaf.parts.append(text)
            if in_link:
                leaf.linked.append(text)
        at = m.end()
        closing, tag, attributes = m[1], m[2].lower(), m[3]
        if closing:
            if tag == "a":
                in_link = False
            elif leaf is not None and tag == leaf.tag:
                leaf = None
            elif tag in CONTAINERS and any(t == tag for t, _ in stack):
                leaf = None
                while stack[-1][0] != tag:
                    stack.pop()
                stack.pop()
            continue
        mark = MARK.search(attributes) if "data-b" in attributes or "DATA-B" in attributes else None
        if mark:
            leaf, in_link = Leaf(int(mark[1]), tag), False
            stack[-1][1].leaves.append(leaf)
        elif tag == "a":
            in_link = True
            if leaf is not None and not leaf.href:
                href = re.search(r"href\s*=\s*[\"']?([^\"'\s>]+)", attributes, re.I)
                leaf.href = href[1] if href else "#"
        elif tag in CONTAINERS:
            leaf = None
            if tag in ("tr", "td", "th") and stack[-1][0] in ("td", "th") and tag != "table":
                while stack[-1][0] in ("td", "th") or (tag == "tr" and stack[-1][0] == "tr"):
                    stack.pop()
            sig = tag + "".join(f"[{a[0].lower()}={a[1] or a[2] or a[3]}]" for a in ATTRIBUTE.findall(attributes))
            box = Box(sig)
            stack[-1][1].kids.append(box)
            stack.append((tag, box))
    return root


def _hash(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=6).hexdigest()


def masked(text: str, host: str) -> str:
    """A text without what varies between hosts and days."""
    label = host.split(".")[0]
    text = text.strip().translate(DIGITS)
    return re.sub(r"0+", "0", text.replace(label, "@") if label else text)


def fingerprint(text: str, host: str) -> str:
    return _hash(masked(text, host))


def running(leaf: Leaf) -> int:
    """Bytes of running text: neither a link, nor led by one, nor a control."""
    if leaf.leads or leaf.tag in ("button", "span", "label", "option"):
        return 0
    own = sum(len(p.encode("utf-8", "surrogatepass")) for p in leaf.parts) - sum(len(p.encode("utf-8", "surrogatepass")) for p in leaf.linked)
    return own if own >= 30 else 0


def skeleton(markup: str, host: str) -> Box:
    """A page as a wrapper of one page: its leaves become counts and texts, and
    containers of one kind in a region of text become one."""

    def settle_box(box: Box) -> None:
        kids: dict = {}
        if box.leaves:
            for k in box.kids:
                if k.sig in kids:
                    kids[k.sig].kids += k.kids
                    kids[k.sig].leaves += k.leaves
                    kids[k.sig].many = 1
                else:
                    kids[k.sig] = k
            box.kids = list(kids.values())
        for k in box.kids:
            settle_box(k)
        if box.sig.startswith("tr"):
            box.sig += "(" + ",".join(k.sig for k in box.kids) + ")"
        for leaf in box.leaves:
            n = running(leaf)
            box.stats[0] += 1
            box.stats[1] += int(leaf.leads)
            box.stats[2] += n
            box.stats[3] += int(leaf.tag == "h1")
            key = fingerprint(leaf.text, host)
            box.texts[key] = [1, max(n, box.texts.get(key, [1, 0])[1])]

    root = parse(markup)
    settle_box(root)
    return root


def _likeness(a: Box, b: Box) -> float:
    """Of two containers of one kind, by how much and what kind of text they hold."""
    total = 0.0
    for i, scale in ((0, 12.0), (1, 6.0), (2, 800.0), (3, 0.5)):
        x, y = a.stats[i] / a.pages, b.stats[i] / b.pages
        total += abs(x - y) / (x + y + scale)
    return 1.0 - total / 4


def _where(row: Sequence[Box]) -> dict[str, list[int]]:
    """The positions of each kind of container in a row."""
    where: dict[str, list[int]] = {}
    for i, k in enumerate(row):
        where.setdefault(k.sig, []).append(i)
    return where


def matches(a: Sequence[Box], b: Sequence[Box], where: dict[str, list[int]] | None = None) -> list[tuple[int, int]]:
    """The best alignment of two rows of containers: the positions of those that
    are partners, in order. ``where`` is that of ``a``."""
    if len(a) == len(b):
        sigs = [k.sig for k in a]
        if sigs == [k.sig for k in b] and len(set(sigs)) == len(sigs):
            return [(i, i) for i in range(len(a))]
    where = _where(a) if where is None else where
    points = [(i, j) for j, k in enumerate(b) for i in where.get(k.sig, ())]
    return _by_grid(a, b) if 4 * len(points) >= len(a) * len(b) else _by_points(a, b, points)


def _by_grid(a: Sequence[Box], b: Sequence[Box]) -> list[tuple[int, int]]:
    """For rows in which most containers are of one kind."""
    best = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1])
            if a[i].sig == b[j].sig:
                best[i][j] = max(best[i][j], best[i + 1][j + 1] + 0.5 + _likeness(a[i], b[j]))
    out: list[tuple[int, int]] = []
    i = j = 0
    while i < len(a) and j < len(b):
        if a[i].sig == b[j].sig and best[i][j] == best[i + 1][j + 1] + 0.5 + _likeness(a[i], b[j]):
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return out


def _by_points(a: Sequence[Box], b: Sequence[Box], points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same alignment from the pairs of one kind alone, so that the width of a
    row counts only by what it has in common with the other."""
    tree = [0.0] * (len(b) + 1)  # the best after each position of b, as a Fenwick tree from the end
    top = 0.0
    after: dict[tuple[int, int], float] = {}  # the best behind a pair
    valued: dict[float, list[tuple[int, int]]] = {}  # pairs by the best from them on
    for i, j in sorted(points, key=lambda p: (-p[0], p[1])):
        rest, k = 0.0, len(b) - 1 - j
        while k > 0:
            rest = max(rest, tree[k])
            k -= k & -k
        value = rest + 0.5 + _likeness(a[i], b[j])
        after[i, j] = rest
        valued.setdefault(value, []).append((i, j))
        top = max(top, value)
        k = len(b) - j
        while k <= len(b):
            tree[k] = max(tree[k], value)
            k += k & -k
    out: list[tuple[int, int]] = []
    i = j = 0
    while top:
        open_ = [p for p in valued[top] if p[0] >= i and p[1] >= j]
        # of equals, as the grid does: first the next container of b with its first partner, else the last of a
        x, y = min((p for p in open_ if p[1] == j), default=None) or min(open_, key=lambda p: (-p[0], p[1]))
        out.append((x, y))
        top, i, j = after[x, y], x + 1, y + 1
    return out


def pairs(a: Sequence[Box], b: Sequence[Box]) -> list[tuple[Box | None, Box | None]]:
    """The alignment of two rows of containers, with those that have no partner."""
    out: list[tuple[Box | None, Box | None]] = []
    i = j = 0
    for x, y in [*matches(a, b), (len(a), len(b))]:
        out += [(k, None) for k in a[i:x]]
        out += [(None, k) for k in b[j:y]]
        if x < len(a):
            out.append((a[x], b[y]))
        i, j = x + 1, y + 1
    return out


def merge(a: Box, b: Box) -> Box:
    """``a`` generalised to what ``b`` holds too. Changes ``a``."""
    a.kids = [y if x is None else x if y is None else merge(x, y) for x, y in pairs(a.kids, b.kids)]
    a.pages += b.pages
    a.many |= b.many
    a.stats = [x + y for x, y in zip(a.stats, b.stats)]
    for key, (n, size) in b.texts.items():
        own = a.texts.get(key)
        a.texts[key] = [n, size] if own is None else [own[0] + n, own[1] + size]
    return a


def _boxes(box: Box) -> Iterator[Box]:
    yield box
    for k in box.kids:
        yield from _boxes(k)


def gather(stack: list[list], box: Box, n: int) -> None:
    """Adds a wrapper of ``n`` containers to those of its host, ``[wrapper,
    containers]``. A wide one waits for one of half its size, so each container
    is merged some log(containers) times even where every page has its own."""
    stack.append([box, n])
    while len(stack) > 1 and stack[-2][1] <= max(WIDE, 2 * stack[-1][1]):
        _join_last(stack)


def _join_last(stack: list[list]) -> None:
    box, n = stack.pop()
    stack[-1][0] = merge(stack[-1][0], box)
    stack[-1][1] += n
    if stack[-1][1] > WIDE:
        stack[-1][1] = sum(1 for _ in _boxes(stack[-1][0]))


def joined(stack: list[list]) -> Box:
    """All of them as one wrapper."""
    while len(stack) > 1:
        _join_last(stack)
    return stack[0][0]


def constants(box: Box) -> dict[str, list]:
    """Texts that stay as they are in this place: on several of its pages."""
    least = max(2, box.pages / COMMON)
    return {k: v for k, v in box.texts.items() if v[0] >= least}


def body_score(box: Box, trust: bool = True) -> float:
    """Bytes of running text a page that isn't constant, more for a place of headlines."""
    fixed = sum(v[1] for v in constants(box).values()) if trust else 0
    return max(0, box.stats[2] - fixed) / box.pages * (1 + 2 * min(1.0, box.stats[3] / box.pages))


def rule(root: Box) -> str:
    """What extraction needs of a wrapper: score and running text of each place, and
    the constants outside the body."""
    boxes = list(_boxes(root))
    scores, plain = ([body_score(b, trust) for b in boxes] for trust in (True, False))

    def usual(of: Sequence[float]) -> float:
        """What bodies are like on this host: one page in COMMON has a place of this score or more."""
        n = 0
        for x, b in sorted(zip(of, boxes), key=lambda p: -p[0]):
            n += b.pages
            if COMMON * n >= root.pages:
                break
        return x

    # where nearly all text recurs, the host has copies of a page, not constants
    trust = usual(scores) >= 0.2 * usual(plain)
    scores = scores if trust else plain
    top = usual(scores)
    outside = sorted({k for b, x in zip(boxes, scores) if trust and x < 0.3 * top for k in constants(b)})
    own = [max(0, b.stats[2] - (sum(v[1] for v in constants(b).values()) if trust else 0)) / b.pages for b in boxes]
    places = [[b.no, round(x, 1), round(y, 1)] for b, x, y in zip(boxes, scores, own)]
    return json.dumps([round(top, 1), outside, int(trust and root.pages >= 3), places], separators=(",", ":"))


def expression(root: Box) -> str:
    """The wrapper written as a union-free regular expression."""

    def write(b: Box, pages: int) -> str:
        fixed = constants(b)
        slots = ["(#TEXT)+"] if b.stats[0] > sum(v[0] for v in fixed.values()) else []
        inner = "".join([*(["(#CONST)*"] if fixed else []), *slots, *(write(k, b.pages) for k in b.kids)])
        one = f"<{b.sig}>{inner}</>"
        return {(0, 0): one, (0, 1): f"({one})?", (1, 0): f"({one})+", (1, 1): f"({one})*"}[b.many, int(b.pages < pages)]

    return write(root, root.pages)


def _numbered(text: str) -> Box:
    root = Box.unpack(json.loads(text))
    for n, box in enumerate(_boxes(root)):
        box.no = n
    return root


class Wrapper:
    """The whole wrapper of a host, ready for its pages to be aligned to it."""

    def __init__(self, text: str):
        self.root = _numbered(text)
        for box in _boxes(self.root):
            box.where = _where(box.kids)

    def places(self, page: Box) -> list[int]:
        """The place of each container of ``page``, -1 where it has none."""
        out: list[int] = []

        def walk(place: Box | None, own: Box) -> None:
            out.append(-1 if place is None else place.no)
            partners = {} if place is None or not own.kids else {j: place.kids[i] for i, j in matches(place.kids, own.kids, place.where)}
            for j, k in enumerate(own.kids):
                walk(partners.get(j), k)

        walk(self.root, page)
        return out


class Rule:
    """The rule of a host, ready to be applied to its pages."""

    def __init__(self, text: str):
        self.top, outside, self.sure, places = json.loads(text)
        self.scores = {n: x for n, x, _ in places}
        self.own = {n: y for n, _, y in places}
        self.outside = frozenset(outside)

    def body(self, page: Box, numbers: Sequence[int]) -> list[int]:
        """The places in ``page`` (a skeleton, with the number of each place) that
        make its body: the place with most running text, the lists and tables in
        it, and the places in and beside it whose slots hold running text as it does."""
        places: list[tuple[Box, list[int], int]] = []  # page, kids, parent

        def walk(own: Box, parent: int) -> int:
            at = len(places)
            places.append((own, [], parent))
            for k in own.kids:
                places[at][1].append(walk(k, at))
            return at

        walk(page, -1)
        score, best = max(((self.scores[n] if n >= 0 else body_score(places[at][0], trust=False), at) for at, n in enumerate(numbers)), key=lambda f: (f[0], -f[1]))
        if score <= 0 or score < 0.3 * self.top:
            return []
        own_text = lambda at: self.own[numbers[at]] if numbers[at] >= 0 else float(places[at][0].stats[2])
        marks: list[int] = []

        def goes_on(at: int) -> bool:
            box = places[at][0]
            # on a host of one or two pages, or of copies, nothing is known to be constant
            return self.sure and box.stats[2] > 0 and 10 * box.stats[1] < 3 * box.stats[0] and own_text(at) >= ALIKE * own_text(best)

        def take(at: int) -> None:
            marks.extend(places[at][0].marks)
            for kid in places[at][1]:
                box = places[kid][0]
                if box.listed and 2 * box.stats[1] <= box.stats[0] or not box.listed and goes_on(kid):
                    take(kid)

        take(best)
        parent = places[best][2]
        for kid in places[parent][1] if parent >= 0 else ():
            if kid != best and not places[kid][0].listed and goes_on(kid):
                take(kid)
        return [*page.heads, *marks]


# pages as rows ----------------------------------------------------------------


def _bare(box: Box, heads: Sequence[int] = ()):
    """A page's skeleton without texts: what extraction needs."""
    return [box.sig, box.stats, [leaf.mark for leaf in box.leaves], [_bare(k) for k in box.kids], list(heads), box.many]


def _unbare(p) -> Box:
    box = Box(p[0], [_unbare(k) for k in p[3]], [], 1, p[1], {}, p[5])
    box.marks, box.heads = p[2], p[4]
    return box


def _titled(leaves: Sequence[Leaf], title: str | None) -> list[int]:
    """The headings that are the page's title."""
    want = residue._plain(one_form(title)) if isinstance(title, str) else ""
    return [x.mark for x in leaves if x.tag[0] == "h" and x.tag[1:].isdigit() and residue._plain(one_form(x.text)) == want] if want else []


def _odd(leaves: Sequence[Leaf], title: str | None, model: residue.Model) -> dict[int, list]:
    """Of a page without its headline: kind and weight of each text."""
    segments = [residue.Segment(one_form(x.text), "link" if x.leads or x.tag == "button" else "text", 0) for x in leaves]
    kinds = residue.judged(model, [segments])[0]
    return {x.mark: [int(k), residue._weight(s.text), int(s.place == "link")] for x, s, k in zip(leaves, segments, kinds)}


def _all_leaves(box: Box) -> list[Leaf]:
    return [leaf for b in _boxes(box) for leaf in b.leaves]


def read_pages(pages: DataFrame, model: residue.Model) -> DataFrame:
    """Each page with markup once parsed: its skeleton, the texts of each container
    (where it has its full markup) and, where its headline is missing, what kind
    of text its blocks are."""
    shared = pages.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.least))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here = residue.Model(*shared.value)
        for b in batches:
            out = []
            for page, site, title, full, reader in zip(b["page_id"], b["site"], b["title"], b["full_html"], b["reader_html"]):
                site = site if isinstance(site, str) else ""
                whole = isinstance(full, str) and full.strip() != ""
                markup = full if whole else reader
                if not isinstance(markup, str) or not markup.strip():
                    continue
                box = skeleton(markup, site)
                leaves = _all_leaves(box)
                if not leaves:
                    continue
                titled = _titled(leaves, title)
                odd = {} if titled else _odd(leaves, title, here)
                blocks = None
                if not whole:
                    plain = residue._plain(one_form(title or "")) if isinstance(title, str) else ""
                    blocks = json.dumps([[x.mark, x.tag, int(x.leads), running(x), x.href, fingerprint(x.text, site), int(bool(plain) and residue._plain(one_form(x.text)) == plain)] for x in leaves])
                out.append((page, site, json.dumps(_bare(box, titled[:1]), separators=(",", ":")), json.dumps([[[key, size] for key, (_, size) in b.texts.items()] for b in _boxes(box)], separators=(",", ":")) if whole else None, json.dumps(odd) if odd else None, blocks))
            yield pd.DataFrame(out, columns=["page_id", "site", "bones", "texts", "odd", "blocks"])

    return pages.select("page_id", "site", "title", "full_html", "reader_html").mapInPandas(
        rows, "page_id long, site string, bones string, texts string, odd string, blocks string"
    )


def _packed(box: Box) -> str:
    return json.dumps(box.pack(), separators=(",", ":"), ensure_ascii=False)


def fold(read: DataFrame) -> DataFrame:
    """Partial wrappers (``site, wrapper``) of the pages of a task; a task hands on
    what it holds whenever that is much."""

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[list]] = {}
        total = 0

        def handed() -> pd.DataFrame:
            out = [(site, _packed(box)) for site, stack in held.items() for box, _ in stack]
            return pd.DataFrame(out, columns=["site", "wrapper"], dtype=object)

        for b in batches:
            for site, bones in zip(b["site"], b["bones"]):
                box = _unbare(json.loads(bones))
                n = sum(1 for _ in _boxes(box))
                stack = held.setdefault(site, [])
                total -= sum(x[1] for x in stack)
                gather(stack, box, n)
                total += sum(x[1] for x in stack)
                if total > HELD:
                    yield handed()
                    held.clear()
                    total = 0
        if held:
            yield handed()

    return read.where(F.col("texts").isNotNull()).select("site", "bones").mapInPandas(combine, "site string, wrapper string")


def infer(read: DataFrame) -> DataFrame:
    """The whole wrapper of each host (``site, wrapper, pages, boxes``), still
    without its texts. Pages are combined where they are read; only partial
    wrappers are moved."""

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        site, stack = None, []

        def whole() -> pd.DataFrame:
            box = joined(stack)
            return pd.DataFrame([(site, _packed(box), box.pages, sum(1 for _ in _boxes(box)))], columns=["site", "wrapper", "pages", "boxes"])

        for b in batches:
            out = []
            for host, text in zip(b["site"], b["wrapper"]):
                if host != site:
                    if stack:
                        out.append(whole())
                    site, stack = host, []
                box = Box.unpack(json.loads(text))
                gather(stack, box, sum(1 for _ in _boxes(box)))
            if out:
                yield pd.concat(out)
        if stack:
            yield whole()

    rows = fold(read).repartition("site").sortWithinPartitions("site", "wrapper")
    return rows.mapInPandas(combine, "site string, wrapper string, pages long, boxes long")


def beside(pages: DataFrame, hosts: DataFrame, text: str, make: Callable, each: Callable, schema: str) -> DataFrame:
    """``each(made, *page)``, a list of rows, for every one of ``pages``; ``made``
    is ``make`` of the column ``text`` of its host, None where there is no such host.

    A host is written once for a chunk of its pages, not for each page. There is a
    page in a chunk for every 16 containers of the host at least, so what is
    written stays in proportion to the pages however wide the wrapper is."""
    chunks = F.expr(f"cast(ceil(pages / greatest({CHUNK}, boxes / 16)) as int)")
    columns = [c for c in pages.columns if c != "site"]
    kinds = dict(pages.dtypes)
    blank = [(F.lit(0) if c == "page_id" else F.lit(None)).cast(kinds[c]).alias(c) for c in columns]
    first = hosts.select("site", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), F.col(text).alias("made"), *blank)
    # pages of hosts without a wrapper may lie anywhere
    then = pages.join(hosts.select("site", chunks.alias("chunks")), "site", "left")
    then = then.select("site", F.expr("pmod(hash(page_id), coalesce(chunks, 1000))").alias("chunk"), F.lit(None).cast("string").alias("made"), *columns)
    names = [f.split()[0] for f in schema.split(", ")]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        site = made = None
        for b in batches:
            out: list[tuple] = []
            for host, given, *page in zip(b["site"], b["made"], *(b[c] for c in columns)):
                if not isinstance(given, str):
                    out += each(made if host == site else None, host, *page)
                elif host != site:
                    site, made = host, make(given)
            yield pd.DataFrame(out, columns=names)

    both = first.unionByName(then).repartition("site", "chunk").sortWithinPartitions("site", "chunk", F.col("made").isNull())
    return both.select("site", "made", *columns).mapInPandas(rows, schema)


def place(read: DataFrame, hosts: DataFrame) -> DataFrame:
    """The pages with full markup aligned to the whole wrapper of their host:
    ``numbers``, the place of each container; ``held``, the statistics of those
    that have one; ``at, keys, sizes``, of each text its place, its key and its
    bytes of running text."""

    def each(wrapper: Wrapper, site: str, page: int, bones: str, odd: str | None, texts: str) -> list[tuple]:
        box = _unbare(json.loads(bones))
        numbers = wrapper.places(box)
        held = [[n, *b.stats] for n, b in zip(numbers, _boxes(box)) if n >= 0]
        found = [(n, key, size) for n, own in zip(numbers, json.loads(texts)) if n >= 0 for key, size in own]
        at, keys, sizes = zip(*found) if found else ((), (), ())
        return [(page, site, bones, odd, numbers, held, list(at), list(keys), list(sizes))]

    pages = read.where(F.col("texts").isNotNull()).select("page_id", "site", "bones", "odd", "texts")
    return beside(pages, hosts, "wrapper", Wrapper, each, "page_id long, site string, bones string, odd string, numbers array<int>, held array<array<long>>, at array<int>, keys array<string>, sizes array<long>")


def _counted(hosts: DataFrame, placed: DataFrame) -> DataFrame:
    """The wrappers with ``held``, pages and statistics of each place, and ``fixed``,
    its constants."""
    sums = [F.sum(F.col("h")[i]).alias(f"s{i}") for i in range(1, 5)]
    held = placed.select("site", F.explode("held").alias("h")).groupBy("site", F.col("h")[0].cast("int").alias("at")).agg(F.count("*").alias("pages"), *sums)
    text = F.arrays_zip("at", "keys", "sizes")
    texts = placed.select("site", F.explode(text).alias("t")).groupBy("site", "t.at", "t.keys").agg(F.count("*").alias("n"), F.sum("t.sizes").alias("size"))
    fixed = texts.where("n >= 2").join(held.select("site", "at", "pages"), ["site", "at"]).where(f"n >= pages / {COMMON}")
    listed = lambda rows, name, *columns: rows.groupBy("site").agg(F.collect_list(F.concat_ws(" ", *columns)).alias(name))
    return hosts.join(listed(held, "held", "at", "pages", "s1", "s2", "s3", "s4"), "site").join(listed(fixed, "fixed", "at", "keys", "n", "size"), "site", "left")


def _filled(wrapper: str, held: Sequence[str], fixed: Sequence[str] | None) -> Box:
    """A wrapper with what the pages aligned to it have in each place. Where
    parts of a host were merged in another order there may be places no page has."""
    root = _numbered(wrapper)
    boxes = list(_boxes(root))
    for box in boxes:
        box.pages = 0
    for text in held:
        at, pages, *stats = map(int, text.split(" "))
        boxes[at].pages, boxes[at].stats = pages, stats
    for box in boxes:
        box.kids = [k for k in box.kids if k.pages]
    for text in () if fixed is None else fixed:
        at, key, n, size = text.split(" ")
        boxes[int(at)].texts[key] = [int(n), int(size)]
    return root


def rules(hosts: DataFrame, placed: DataFrame) -> DataFrame:
    """The rule of each host (``site, rule, pages, boxes``)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"site": b["site"], "rule": [rule(_filled(*x)) for x in zip(b["wrapper"], b["held"], b["fixed"])], "pages": b["pages"], "boxes": b["boxes"]})

    return _counted(hosts, placed).mapInPandas(rows, "site string, rule string, pages long, boxes long")


def expressions(read: DataFrame) -> DataFrame:
    """``site, n_pages, expression``: the wrappers to be read by people."""
    hosts = settle(infer(read), "wrappers")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"site": b["site"], "n_pages": b["pages"], "expression": [expression(_filled(*x)) for x in zip(b["wrapper"], b["held"], b["fixed"])]})

    return _counted(hosts, settle(place(read, hosts), "places")).mapInPandas(rows, "site string, n_pages long, expression string")


def _from_blocks(blocks: list, outside: frozenset) -> list[int]:
    """The body among the blocks of a page without its full markup."""
    start = next((i for i, x in enumerate(blocks) if x[6] and x[1][0] == "h"), 0)
    kept: list[int] = []
    last_prose = max((i for i, x in enumerate(blocks) if i >= start and x[3] and x[5] not in outside), default=-1)
    for i in range(start, len(blocks)):
        mark, tag, leads, n, href, key, own_title = blocks[i]
        if own_title and tag[0] == "h":
            kept.append(i)
        elif key in outside or tag in ("button", "span"):
            continue
        elif leads:
            # a list of links in the body: close to what is kept, before its last running text
            near = bool(kept) and mark - blocks[kept[-1]][0] <= 2
            if near and i < last_prose and not n:
                kept.append(i)
        else:
            kept.append(i)
    return [blocks[i][0] for i in kept]


def _stays(marks: Sequence[int], odd: dict) -> bool:
    """Whether a body without its headline is content still."""
    if not odd:
        return True
    own = [odd[str(m)] for m in marks if str(m) in odd]
    bad = sum(w for k, w, link in own if k != residue.REAL and not link)
    good = sum(w for k, w, link in own if k == residue.REAL and not link and w >= 40)
    return good > bad


def extract(read: DataFrame, placed: DataFrame, known: DataFrame) -> DataFrame:
    """``page_id, block_no`` of the body of each page."""

    def each(host: Rule | None, site: str, page: int, bones: str, odd: str | None, numbers, blocks: str | None) -> list[tuple]:
        if isinstance(blocks, str):
            marks = _from_blocks(json.loads(blocks), host.outside if host else frozenset())
        else:
            marks = host.body(_unbare(json.loads(bones)), numbers.tolist())
        return [(page, m) for m in dict.fromkeys(marks)] if marks and _stays(marks, json.loads(odd) if isinstance(odd, str) else {}) else []

    full = placed.select("page_id", "site", "bones", "odd", "numbers", F.lit(None).cast("string").alias("blocks"))
    bare = read.where(F.col("blocks").isNotNull()).select("page_id", "site", F.lit(None).cast("string").alias("bones"), "odd", F.lit(None).cast("array<int>").alias("numbers"), "blocks")
    return beside(full.unionByName(bare), known, "rule", Rule, each, "page_id long, block_no long")


def main_body(pages: DataFrame, model: residue.Model) -> DataFrame:
    """``page_id, block_no`` of the main body of each of ``pages``
    (``page_id, site, title, full_html, reader_html``). Pages are parsed once;
    what is kept of them is a fraction of their markup."""
    read = settle(read_pages(pages, model), "pages")
    hosts = settle(infer(read), "wrappers")
    placed = settle(place(read, hosts), "places")
    return extract(read, placed, settle(rules(hosts, placed), "rules"))

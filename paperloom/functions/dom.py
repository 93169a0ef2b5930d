"""Document trees of uneven HTML, selectors over them, and Markdown of them.

Built on the standard library's tokenizer: void elements, implied ends of
paragraphs, list items, table parts and options, text of scripts and styles.
Used inside vectorised functions, one parse a page however many selectors ask.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements without content, elements whose start ends an open one.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ENDS = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
STOPS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "p": set(BLOCKS) - {"p"}, "option": {"select"}}


class Element:
    __slots__ = ("tag", "attributes", "children", "parent")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None, parent: Element | None = None):
        self.tag, self.attributes, self.children, self.parent = tag, attributes or {}, [], parent

    def descendants(self) -> Iterator[Element]:
        for c in self.children:
            if isinstance(c, Element):
                yield c
                yield from c.descendants()

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def elements(self) -> list[Element]:
        return [c for c in self.children if isinstance(c, Element)]

    def detach(self) -> None:
        if self.parent is not None and self in self.parent.children:
            self.parent.children.remove(self)

    def inner_html(self) -> str:
        return "".join(_html.escape(c, quote=False) if isinstance(c, str) else c.outer_html() for c in self.children)

    def outer_html(self) -> str:
        head = self.tag + "".join(f' {k}="{_html.escape(v)}"' for k, v in self.attributes.items())
        return f"<{head}>" if self.tag in VOID else f"<{head}>{self.inner_html()}</{self.tag}>"


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("body")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body"):
            self.root.attributes.update({k: v or "" for k, v in attrs})
            return
        # a start may end elements of its kind, up to the list or table they are in
        for i in range(len(self.open) - 1, 0, -1):
            name = self.open[i].tag
            if tag in ENDS.get(name, ()):
                del self.open[i:]
                break
            if name in STOPS.get(tag, ()) or name in STOPS.get("p", ()) and tag in BLOCKS:
                break
        e = Element(tag, {k: v or "" for k, v in attrs}, self.open[-1])
        self.open[-1].children.append(e)
        if tag not in VOID:
            self.open.append(e)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(text: str) -> Element:
    """The tree of a page; its head's elements come first."""
    b = _Builder()
    b.feed(text)
    b.close()
    return b.root


# selectors ---------------------------------------------------------------------

_SIMPLE = re.compile(r"([a-zA-Z][\w-]*|\*)|#([\w-]+)|\.([\w-]+)|\[\s*([\w:-]+)\s*(?:([~|^$*]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([^\]\s]+))\s*)?\]|:([\w-]+)(?:\(([^)]*)\))?")


@lru_cache(2000)
def selector(css: str) -> tuple:
    """Alternatives, each a list of (combinator, simple selectors)."""
    out = []
    for part in re.split(r",(?![^\[]*\])(?![^(]*\))", css):
        steps, combinator = [], " "
        for token in re.findall(r"\s*[>+~]\s*|\s+|(?:[^\s>+~\[(]|\[[^\]]*\]|\([^)]*\))+", part.strip()):
            if token.strip() in (">", "+", "~"):
                combinator = token.strip()
            elif token.strip():
                pieces, at = [], 0
                for m in _SIMPLE.finditer(token):
                    if m.start() != at:
                        raise ValueError(f"unknown selector {css}")
                    pieces.append(m.groups())
                    at = m.end()
                if at != len(token):
                    raise ValueError(f"unknown selector {css}")
                steps.append((combinator, tuple(pieces)))
                combinator = " "
        if steps:
            out.append(tuple(steps))
    return tuple(out)


def _nth(spec: str, i: int) -> bool:
    spec = spec.replace(" ", "").lower()
    spec = {"odd": "2n+1", "even": "2n"}.get(spec, spec)
    m = re.fullmatch(r"([+-]?\d*)n([+-]\d+)?|([+-]?\d+)", spec)
    if not m:
        return False
    if m[3]:
        return i == int(m[3])
    a, b = int(m[1] + "1" if m[1] in ("", "+", "-") else m[1]), int(m[2] or 0)
    return (i - b) % a == 0 and (i - b) // a >= 0 if a else i == b


def _matches_simple(e: Element, pieces: tuple) -> bool:
    for tag, ident, cls, attr, op, d, s, bare, pseudo, arg in pieces:
        if tag and tag != "*" and e.tag != tag.lower():
            return False
        if ident and e.attributes.get("id") != ident:
            return False
        if cls and cls not in e.attributes.get("class", "").split():
            return False
        if attr:
            if attr.lower() not in e.attributes:
                return False
            have, want = e.attributes[attr.lower()], d if d is not None else s if s is not None else bare
            test = {
                None: lambda h, w: True, "=": lambda h, w: h == w, "~=": lambda h, w: w in h.split(), "|=": lambda h, w: h == w or h.startswith(w + "-"),
                "^=": lambda h, w: bool(w) and h.startswith(w), "$=": lambda h, w: bool(w) and h.endswith(w), "*=": lambda h, w: bool(w) and w in h,
            }[op or None]
            if not test(have, want):
                return False
        if pseudo:
            siblings = e.parent.elements() if e.parent else [e]
            alike = [x for x in siblings if x.tag == e.tag]
            places = {"first-child": siblings[0] is e, "last-child": siblings[-1] is e, "only-child": len(siblings) == 1, "first-of-type": alike[0] is e, "last-of-type": alike[-1] is e, "empty": not e.children}
            if pseudo in places:
                if not places[pseudo]:
                    return False
            elif pseudo == "nth-child":
                if not _nth(arg or "", siblings.index(e) + 1):
                    return False
            elif pseudo == "nth-of-type":
                if not _nth(arg or "", alike.index(e) + 1):
                    return False
            elif pseudo == "not":
                if any(_matches(e, alt) for alt in selector(arg or "")):
                    return False
            else:
                return False
    return True


def _matches(e: Element, steps: tuple) -> bool:
    *before, (combinator, pieces) = steps
    if not _matches_simple(e, pieces):
        return False
    if not before:
        return True
    before = tuple(before)
    if combinator == ">":
        return e.parent is not None and _matches(e.parent, before)
    if combinator in "+~":
        siblings = e.parent.elements() if e.parent else []
        left = siblings[: siblings.index(e)] if e in siblings else []
        return any(_matches(x, before) for x in (left[-1:] if combinator == "+" else left))
    up = e.parent
    while up is not None:
        if _matches(up, before):
            return True
        up = up.parent
    return False


def select(root: Element, css: str) -> list[Element]:
    alternatives = selector(css)
    return [e for e in root.descendants() if any(_matches(e, alt) for alt in alternatives)]


def extract(root: Element, css: str, attribute: str | None = None, as_html: bool = False) -> list[str]:
    """Text, an attribute or the HTML of what a selector finds; nothing for a selector that isn't understood."""
    try:
        found = select(root, css)
    except ValueError:
        return []
    return [e.attributes.get(attribute.lower(), "") if attribute else e.outer_html() if as_html else e.text().strip() for e in found]


def selected(html: Column, wanted: Sequence[tuple[str, str | None, bool]]) -> Column:
    """All selectors of a template over one parse: an array of arrays of text."""
    wanted = tuple(wanted)

    @F.pandas_udf("array<array<string>>")
    def each(pages: pd.Series) -> pd.Series:
        out = []
        for p in pages:
            root = parse(p) if isinstance(p, str) else Element("body")
            out.append([extract(root, *w) for w in wanted])
        return pd.Series(out, dtype=object)

    return each(html)


def _own_text(e: Element, attribute: str) -> str:
    """The text of an element without that of marked elements in it; breaks are blanks."""
    out = []
    for c in e.children:
        if isinstance(c, str):
            out.append(c)
        elif attribute not in c.attributes:
            out.append("\n" if c.tag == "br" else _own_text(c, attribute))
    return "".join(out)


def marked(html: Column, attribute: str) -> Column:
    """The texts of all elements with an attribute, in their order; null has none."""

    @F.pandas_udf("array<string>")
    def each(pages: pd.Series) -> pd.Series:
        return pd.Series([[_own_text(e, attribute) for e in parse(p).descendants() if attribute in e.attributes] if isinstance(p, str) else [] for p in pages], dtype=object)

    return each(html)


# pages ---------------------------------------------------------------------------

# Attributes that hold the address of an image loaded late.
LATE_SOURCES = ("data-src", "data-original", "data-lazy-src", "data-actualsrc", "data-url")
LATE_SETS = ("data-srcset", "data-lazy-srcset")
_PLACEHOLDER = re.compile(r"(?:^|/)(?:transparent|blank|placeholder|spacer)\.(?:gif|png|jpe?g|webp)(?:[?#].*)?$", re.I)


def is_placeholder(source: str | None) -> bool:
    s = (source or "").strip()
    return not s or s.startswith("data:image/") or s == "about:blank" or bool(_PLACEHOLDER.search(s))


def with_images(root: Element) -> Element:
    """Images loaded late get their address."""
    for e in root.descendants():
        if e.tag == "img":
            for name, late, missing in (("src", LATE_SOURCES, is_placeholder(e.attributes.get("src"))), ("srcset", LATE_SETS, not e.attributes.get("srcset"))):
                found = next((v for a in late if (v := e.attributes.get(a, "").strip())), None)
                if missing and found:
                    e.attributes[name] = found
    return root


def cleaned(text: str, base: str | None = None) -> str:
    """A page without scripts, styles and style attributes, its addresses absolute."""
    root = with_images(parse(text))
    for e in list(root.descendants()):
        if e.tag in ("script", "style", "noscript"):
            e.detach()
            continue
        e.attributes.pop("style", None)
        for name in ("src", "href"):
            if base and e.attributes.get(name):
                e.attributes[name] = absolute(e.attributes[name], base)
        if base and e.attributes.get("srcset"):
            e.attributes["srcset"] = ", ".join(" ".join([absolute(p.split()[0], base), *p.split()[1:]]) for p in e.attributes["srcset"].split(",") if p.strip())
    return root.inner_html()


def absolute(address: str, base: str) -> str:
    try:
        return urljoin(base, address)
    except ValueError:
        return address


# Elements of a page that aren't its content, in order of preference of those that are.
ASIDE = frozenset("script style noscript nav header footer aside form button svg iframe".split())
CONTENT = ("article", "main", "[role=main]", ".post-content", ".entry-content", "#content", ".article")


def main_content(root: Element) -> Element:
    """The part of a page with most running text: a content element, or the densest container."""
    for css in CONTENT:
        found = select(root, css)
        if found:
            return max(found, key=lambda e: len(e.text()))
    best, most = root, 0.0
    for e in root.descendants():
        if e.tag in ("div", "section", "td", "body"):
            own = sum(len(c.text()) for c in e.elements() if c.tag in ("p", "h1", "h2", "h3", "blockquote", "pre", "ul", "ol"))
            if own > most:
                best, most = e, own
    return best


def markdown(text: str, base: str | None = None) -> str:
    """Markdown of HTML: headings, paragraphs, lists, quotes, code, tables, links, images, emphasis."""
    return re.sub(r"\n{3,}", "\n\n", "".join(_block(parse(text), base))).strip()


def _inline(node, base: str | None) -> str:
    if isinstance(node, str):
        return re.sub(r"\s+", " ", node)
    inner = "".join(_inline(c, base) for c in node.children)
    tag, a = node.tag, node.attributes
    if tag in ("strong", "b"):
        return f"**{inner.strip()}**" if inner.strip() else ""
    if tag in ("em", "i"):
        return f"*{inner.strip()}*" if inner.strip() else ""
    if tag == "code":
        return f"`{node.text()}`"
    if tag in ("del", "s"):
        return f"~~{inner}~~"
    if tag == "mark":
        return f"=={inner}=="
    if tag == "br":
        return "  \n"
    if tag == "img":
        src = a.get("src", "")
        return f"![{a.get('alt', '')}]({absolute(src, base) if base else src})" if src else ""
    if tag == "a":
        href = a.get("href", "")
        return f"[{inner.strip()}]({absolute(href, base) if base else href})" if href and inner.strip() else inner
    if tag in ("script", "style", "noscript", "head", "title"):
        return ""
    return inner


def _block(node: Element, base: str | None, depth: int = 0) -> list[str]:
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if joined := "".join(line).strip():
            out.append(f"{joined}\n\n")
        line.clear()

    for c in node.children:
        if isinstance(c, str) or c.tag not in BLOCKS | {"li", "dt", "dd", "tr", "tbody", "thead", "figcaption", "center", "td", "th"}:
            line.append(_inline(c, base))
            continue
        flush()
        tag = c.tag
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            out.append(f"{'#' * int(tag[1])} {_inline(c, base).strip()}\n\n")
        elif tag == "pre":
            code = next((x for x in c.elements() if x.tag == "code"), c)
            language = next((k.split("-", 1)[1] for k in code.attributes.get("class", "").split() if k.startswith("language-")), "")
            out.append(f"```{language}\n{c.text().strip(chr(10))}\n```\n\n")
        elif tag == "blockquote":
            inner = "".join(_block(c, base)).strip() or c.text().strip()
            out.append("\n".join(f"> {x}".rstrip() for x in inner.split("\n")) + "\n\n")
        elif tag in ("ul", "ol"):
            n = int(c.attributes.get("start", "1")) if c.attributes.get("start", "1").isdigit() else 1
            for item in c.elements():
                if item.tag != "li":
                    continue
                own = "".join(_inline(x, base) for x in item.children if isinstance(x, str) or x.tag not in ("ul", "ol")).strip()
                out.append(f"{chr(9) * depth}{f'{n}.' if tag == 'ol' else '-'} {own}\n")
                for x in item.elements():
                    if x.tag in ("ul", "ol"):
                        wrap = Element("div")
                        wrap.children = [x]
                        out += [s.rstrip("\n") + "\n" for s in _block(wrap, base, depth + 1) if s.strip()]
                n += 1
            if depth == 0:
                out.append("\n")
        elif tag == "table":
            rows = [[_inline(x, base).strip().replace("|", "\\|") for x in r.elements() if x.tag in ("td", "th")] for r in c.descendants() if r.tag == "tr"]
            rows = [r for r in rows if r]
            if rows:
                width = max(map(len, rows))
                lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
                out.append("\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]]) + "\n\n")
        elif tag == "hr":
            out.append("---\n\n")
        elif tag == "p":
            if inner := "".join(_inline(x, base) for x in c.children).strip():
                out.append(f"{inner}\n\n")
        else:
            out += _block(c, base, depth)
    flush()
    return out

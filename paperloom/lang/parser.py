"""From tokens to a tree."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from paperloom.lang.scanner import ParseError, Reader, place, read_string, tokenize

# expressions


@dataclass(frozen=True)
class Literal:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Selector:
    css: str
    attribute: str | None = None
    as_html: bool = False


@dataclass(frozen=True)
class Member:
    of: object
    key: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Not:
    of: object


@dataclass(frozen=True)
class Filter:
    of: object
    name: str
    args: tuple = ()


# nodes


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Output:
    value: object
    line: int = 0


@dataclass(frozen=True)
class If:
    branches: tuple  # (condition, nodes)
    otherwise: tuple | None = None


@dataclass(frozen=True)
class For:
    name: str
    items: object
    body: tuple = ()


@dataclass(frozen=True)
class Set:
    name: str
    value: object


def split_top(raw: str, sep: str) -> list[str]:
    """Cut at ``sep`` outside quotes, brackets and ``/patterns/``."""
    out, start, depth, quote, i = [], 0, 0, "", 0
    while i < len(raw):
        ch = raw[i]
        if quote:
            if ch == "\\":
                i += 1
            elif ch == quote:
                quote = ""
        elif ch in "\"'":
            quote = ch
        elif ch == "/" and not raw[start:i].strip() and "/" in raw[i + 1 :]:
            i = raw.index("/", i + 1)
        elif ch in "([{":
            depth += 1
        elif ch in ")]}":
            depth -= 1
        elif ch == sep and not depth:
            out.append(raw[start:i])
            start = i + 1
        i += 1
    return [*out, raw[start:]]


def unquoted(raw: str) -> str:
    raw = raw.strip()
    if len(raw) > 1 and raw[0] in "\"'" and raw[-1] == raw[0]:
        return read_string(raw, 0)[0]
    return raw


def arguments(raw: str) -> tuple:
    """The arguments of a filter: texts, and pairs where quoted texts are joined by a colon."""
    raw = raw.strip()
    if not raw:
        return ()
    if "=>" in raw and re.match(r"\(?\s*\w+\s*=>", raw):
        return (raw,)
    if raw.startswith("(") and raw.endswith(")"):
        raw = raw[1:-1]
    out: list = []
    for part in split_top(raw, ","):
        pieces = split_top(part.strip(), ":")
        quoted = len(pieces) > 1 and re.match(r"\s*(?:[\"']|/.+/[gimsuy]*\s*$)", pieces[0])
        out.append(tuple(map(unquoted, pieces)) if quoted else unquoted(part))
    return tuple(out)


class _Expressions(Reader):
    def nullish(self):
        left = self.piped()
        while self.peek().value == "??" and self.peek().kind == "op":
            self.next()
            left = Binary("??", left, self.piped())
        return left

    def piped(self):
        left = self.either()
        while (t := self.peek()).kind == "op" and t.value == "|":
            self.next()
            name = self.next()
            if name.kind not in ("name", "word"):
                raise self.fail("expected the name of a filter")
            args: tuple = ()
            if self.peek().kind == "op" and self.peek().value == ":":
                self.next()
                args = arguments(self.arguments())
            left = Filter(left, name.value, args)
        return left

    def _chain(self, words: set, below):
        left = below()
        while (t := self.peek()).value in words and t.kind in ("word", "op"):
            self.next()
            left = Binary(t.value, left, below())
        return left

    def either(self):
        return self._chain({"or"}, self.both)

    def both(self):
        return self._chain({"and"}, self.negated)

    def negated(self):
        t = self.peek()
        if (t.kind, t.value) in (("word", "not"), ("op", "!")):
            self.next()
            return Not(self.negated())
        return self.compared()

    def compared(self):
        left = self.postfix()
        t = self.peek()
        if t.kind == "op" and t.value in ("==", "!=", "<", ">", "<=", ">=") or (t.kind, t.value) == ("word", "contains"):
            self.next()
            return Binary(t.value, left, self.postfix())
        return left

    def postfix(self):
        left = self.primary()
        while (t := self.peek()).kind == "op" and t.value == "[":
            self.next()
            key = self.either()
            if self.next().value != "]":
                raise self.fail("expected ]")
            left = Member(left, key)
        return left

    def primary(self):
        t = self.next()
        if t.kind == "string":
            return Literal(t.value)
        if t.kind == "number":
            return Literal(float(t.value))
        if t.kind == "word" and t.value in ("true", "false", "null"):
            return Literal({"true": True, "false": False, "null": None}[t.value])
        if t.kind == "op" and t.value == "(":
            inner = self.either()
            if self.next().value != ")":
                raise self.fail("expected )")
            return inner
        if t.kind == "name":
            m = re.fullmatch(r"(selector|selectorHtml):(.*)", t.value, re.S)
            if m:
                css, _, attribute = m[2].partition("?") if "?" in m[2] and "[" not in m[2].rsplit("?", 1)[-1] else (m[2], "", "")
                return Selector(css.strip().replace('\\"', '"'), attribute.strip() or None, m[1] == "selectorHtml")
            return Name(t.value)
        raise self.fail(f"unexpected {t.value or 'end'!r}")

    def whole(self):
        value = self.nullish()
        if self.peek().kind != "end":
            raise self.fail(f"unexpected {self.peek().value!r}")
        return value


def expression(source: str, line: int = 1, column: int = 1):
    return _Expressions(source, line, column).whole()


@dataclass
class _Open:
    kind: str
    nodes: list
    data: dict = field(default_factory=dict)


def parse(source: str) -> tuple:
    """The nodes of a template; raises :class:`ParseError`."""
    stack = [_Open("top", [])]
    for t in tokenize(source):
        here = stack[-1].nodes
        if t.kind == "text":
            here.append(Text(t.value))
        elif t.kind == "value":
            here.append(Output(expression(t.value, t.line, t.column + 2), t.line))
        else:
            _tag(t, stack, source)
    if len(stack) > 1:
        raise ParseError(f"unclosed {stack[-1].kind}", stack[-1].data.get("line", 1), 1)
    return tuple(stack[0].nodes)


def _tag(t, stack: list, source: str) -> None:
    m = re.match(r"\s*-?\s*(\w+)\s*(.*?)\s*-?\s*\Z", t.value, re.S)
    if not m:
        raise ParseError("empty tag", t.line, t.column)
    word, rest, top = m[1].lower(), m[2], stack[-1]
    line, column = place(source, t.at + m.start(2))
    if word == "if":
        stack.append(_Open("if", [], {"branches": [], "condition": expression(rest, line, column), "line": t.line}))
    elif word in ("elseif", "else", "endif"):
        if top.kind != "if":
            raise ParseError(f"{word} without if", t.line, t.column)
        if top.data.get("else"):
            top.data["otherwise"] = tuple(top.nodes)
        else:
            top.data["branches"].append((top.data["condition"], tuple(top.nodes)))
        top.nodes = []
        if word == "endif":
            stack.pop()
            stack[-1].nodes.append(If(tuple(top.data["branches"]), top.data.get("otherwise")))
        elif top.data.get("else"):
            raise ParseError(f"{word} after else", t.line, t.column)
        elif word == "else":
            top.data["else"] = True
        else:
            top.data["condition"] = expression(rest, line, column)
    elif word == "for":
        f = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
        if not f:
            raise ParseError("expected: for name in list", t.line, t.column)
        stack.append(_Open("for", [], {"name": f[1], "items": expression(f[2], line, column), "line": t.line}))
    elif word == "endfor":
        if top.kind != "for":
            raise ParseError("endfor without for", t.line, t.column)
        stack.pop()
        stack[-1].nodes.append(For(top.data["name"], top.data["items"], tuple(top.nodes)))
    elif word == "set":
        f = re.fullmatch(r"([A-Za-z_][\w-]*)\s*=\s*(.+)", rest, re.S)
        if not f:
            raise ParseError("expected: set name = value", t.line, t.column)
        top.nodes.append(Set(f[1], expression(f[2], line, column)))
    else:
        raise ParseError(f"unknown tag {word}", t.line, t.column)


def show(node, depth: int = 0) -> str:
    """A tree to be read by people."""
    pad = "  " * depth
    if isinstance(node, tuple):
        return "\n".join(show(n, depth) for n in node)
    name = type(node).__name__
    if isinstance(node, Literal | Name | Text):
        return f"{pad}{name} {getattr(node, 'value', getattr(node, 'name', ''))!r}"
    if not hasattr(node, "__dataclass_fields__"):
        return f"{pad}{node!r}"
    parts = [show(v, depth + 1) if hasattr(v, "__dataclass_fields__") or isinstance(v, tuple) else f"{'  ' * (depth + 1)}{k}: {v!r}" for k, v in vars(node).items() if v not in (None, ())]
    return "\n".join([f"{pad}{name}", *parts])

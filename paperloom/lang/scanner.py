"""Templates cut into text, values and tags, and expressions into tokens, each with its line and column."""

from __future__ import annotations

import re
from dataclasses import dataclass


class ParseError(ValueError):
    """What can't be read, and where."""

    def __init__(self, message: str, line: int = 1, column: int = 1):
        super().__init__(f"{message} (line {line}, column {column})")
        self.message, self.line, self.column = message, line, column


@dataclass(frozen=True)
class Token:
    """``kind``: text, value, tag (of a template); string, number, name, word, op, end (of an expression)."""

    kind: str
    value: str
    at: int
    line: int
    column: int


def place(source: str, at: int) -> tuple[int, int]:
    return source.count("\n", 0, at) + 1, at - (source.rfind("\n", 0, at) + 1) + 1


def closing(source: str, at: int, end: str) -> int:
    """Where ``end`` next stands outside quotes and brackets of a selector; -1 nowhere."""
    quote, square = "", 0
    i = at
    while i < len(source):
        ch = source[i]
        if quote:
            if ch == "\\":
                i += 1
            elif ch == quote:
                quote = ""
        elif source.startswith(end, i):
            return i
        elif ch in "\"'" and (i == at or source[i - 1] in " \t\n(,:|=<>![{+?&"):
            quote = ch
        i += 1
    return -1


def tokenize(source: str) -> list[Token]:
    """Text, values and tags in their order."""
    out: list[Token] = []
    at = 0
    opening = re.compile(r"\{\{|\{%")
    while at < len(source):
        m = opening.search(source, at)
        if not m:
            out.append(Token("text", source[at:], at, *place(source, at)))
            break
        if m.start() > at:
            out.append(Token("text", source[at : m.start()], at, *place(source, at)))
        kind, end = ("value", "}}") if m[0] == "{{" else ("tag", "%}")
        stop = closing(source, m.end(), end)
        if stop < 0:
            raise ParseError(f"unclosed {'variable' if kind == 'value' else 'tag'}", *place(source, m.start()))
        out.append(Token(kind, source[m.end() : stop], m.end(), *place(source, m.start())))
        at = stop + 2
    return out


ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_OPERATOR = re.compile(r"\?\?|==|!=|<=|>=|&&|\|\||[|<>!()\[\]=,:]")
_NUMBER = re.compile(r"-?\d+(?:\.\d+)?")
_NAME = re.compile(r"[A-Za-z_@][\w@.-]*")
#: Names that go on with a colon: values looked up by kind.
PREFIXES = ("schema", "meta", "selector", "selectorHtml")
WORDS = frozenset("and or not true false null contains in if elseif else endif for endfor set".split())


def read_string(source: str, at: int) -> tuple[str, int]:
    """A quoted text and where it ends."""
    quote, out, i = source[at], [], at + 1
    while i < len(source):
        ch = source[i]
        if ch == "\\" and i + 1 < len(source):
            nxt = source[i + 1]
            out.append(ESCAPES.get(nxt, nxt if nxt in "\\\"'" else "\\" + nxt))
            i += 2
            continue
        if ch == quote:
            return "".join(out), i + 1
        out.append(ch)
        i += 1
    raise ParseError("unclosed string", *place(source, at))


class Reader:
    """Tokens of an expression, one at a time; arguments of filters are read raw."""

    def __init__(self, source: str, line: int = 1, column: int = 1):
        self.source, self.at, self.line, self.column = source, 0, line, column

    def fail(self, message: str) -> ParseError:
        line, column = place(self.source, min(self.at, len(self.source)))
        return ParseError(message, self.line + line - 1, column + (self.column if line == 1 else 0))

    def blanks(self) -> None:
        while self.at < len(self.source) and self.source[self.at].isspace():
            self.at += 1

    def peek(self) -> Token:
        was = self.at
        token = self.next()
        self.at = was
        return token

    def next(self) -> Token:
        self.blanks()
        at, s = self.at, self.source
        if at >= len(s):
            return Token("end", "", at, self.line, self.column)
        if s[at] in "\"'":
            value, self.at = read_string(s, at)
            return Token("string", value, at, self.line, self.column)
        m = _NUMBER.match(s, at)
        if m:
            self.at = m.end()
            return Token("number", m[0], at, self.line, self.column)
        m = _NAME.match(s, at)
        if m:
            name = m[0].rstrip(".")
            self.at = at + len(name)
            if name in PREFIXES and s.startswith(":", self.at):
                self.at = self._lookup_end(name)
                return Token("name", s[at : self.at].strip(), at, self.line, self.column)
            if name.lower() in WORDS:
                return Token("word", name.lower(), at, self.line, self.column)
            return Token("name", name, at, self.line, self.column)
        m = _OPERATOR.match(s, at)
        if m:
            self.at = m.end()
            return Token("op", {"&&": "and", "||": "or"}.get(m[0], m[0]), at, self.line, self.column)
        raise self.fail(f"unexpected {s[at]!r}")

    def _lookup_end(self, prefix: str) -> int:
        """A lookup runs to the next bar outside brackets and quotes; all but selectors end at a blank too."""
        i, square, round_, quote = self.at, 0, 0, ""
        while i < len(self.source):
            ch = self.source[i]
            if quote:
                quote = "" if ch == quote else quote
            elif ch in "\"'" and square:
                quote = ch
            elif ch == "[":
                square += 1
            elif ch == "]":
                square -= 1
            elif ch == "(":
                round_ += 1
            elif ch == ")":
                if not round_:
                    break
                round_ -= 1
            elif not square and not round_ and (ch == "|" or self.source.startswith("??", i) or ch.isspace() and not prefix.startswith("selector")):
                break
            i += 1
        return i

    def arguments(self) -> str:
        """The raw arguments of a filter: up to the next bar or ``??`` outside quotes, brackets and patterns."""
        i, depth, quote = self.at, 0, ""
        s = self.source
        while i < len(s):
            ch = s[i]
            if quote:
                if ch == "\\":
                    i += 1
                elif ch == quote:
                    quote = ""
            elif ch in "\"'":
                quote = ch
            elif ch == "/" and not s[self.at : i].rstrip(" (,:")[-1:].isalnum() and "/" in s[i + 1 :]:
                i = s.index("/", i + 1)
            elif ch in "([{":
                depth += 1
            elif ch in ")]}":
                if not depth:
                    break
                depth -= 1
            elif not depth and (ch == "|" and not s.startswith("||", i) or s.startswith("??", i)):
                break
            i += 1
        raw, self.at = s[self.at : i], i
        return raw.strip()

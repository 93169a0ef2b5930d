"""Markup in text: Markdown taken off, tags and attributes changed.

What patterns can say stays in built-in expressions; what needs a document
tree goes through vectorised functions over :mod:`paperloom.functions.dom`.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from paperloom.functions import dom
from paperloom.functions.values import BLANK

# Marks of Markdown in the order they are taken off, and what is left of each.
MARKDOWN_MARKS = (
    (r"!\[([^\]]*)\]\([^\)]+\)", ""), (r"!\[\[([^\]]+)\]\]", ""), (r"\[([^\]]+)\]\([^\)]+\)", "$1"), (r"https?://\S+", ""),
    (r"(\*\*|__)(.*?)\1", "$2"), (r"(\*|_)(.*?)\1", "$2"), (r"==(.*?)==", "$1"), (r"(?m)^#+\s+", ""), (r"`([^`]+)`", "$1"),
    (r"```[\s\S]*?```", ""), (r"~~(.*?)~~", "$1"), (r"(?m)^[-*+] (\[[x ]\] )?", ""), (r"(?m)^([-*_]){3,}\s*$", ""), (r"(?m)^>\s+", ""),
    (r"\|.*\|", ""), (r"([~^])(\w+)\1", "$2"), (r":[a-z_]+:", ""), (r"<[^>]+>", ""), (r"\[\s*\]", ""), (r"\[\^[^\]]+\]", ""),
    (r"(?m)^\*\[[^\]]+\]:.+$", ""), (r"\[\[[^\]|]+\|([^\]]+)\]\]", "$1"), (r"\[\[([^\]|]+)\|?\]\]", "$1"), (r"\n{3,}", "\n\n"),
)
# Entities in the order they are resolved.
ENTITIES = (
    ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&ldquo;", '"'), ("&rdquo;", '"'),
    ("&lsquo;", "'"), ("&rsquo;", "'"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"),
)


def _vectorised(change: Callable[[str], str]) -> Callable[[Column], Column]:
    @F.pandas_udf(StringType())
    def each(values: pd.Series) -> pd.Series:
        return pd.Series([change(v) if isinstance(v, str) else None for v in values], dtype=object)

    return each


def _trimmed(s: Column) -> Column:
    return F.regexp_replace(s, f"^{BLANK}+|{BLANK}+$", "")


def stripped_md(s: Column) -> Column:
    for pattern, left in MARKDOWN_MARKS:
        s = F.regexp_replace(s, pattern, left)
    return _trimmed(s)


def _code_points(text: str) -> str:
    """Numeric entities resolved; code units beyond the first plane wrap around."""
    text = re.sub(r"&#(\d+);", lambda m: chr(int(m[1]) & 0xFFFF), text)
    return re.sub(r"&#x([0-9A-Fa-f]+);", lambda m: chr(int(m[1], 16) & 0xFFFF), text)


def stripped_tags(s: Column, keep: Sequence[str] = (), numeric: bool = True) -> Column:
    """Tags taken off but for some; entities resolved in order, so ``&amp;lt;`` becomes ``<``."""
    names = [n.strip() for k in keep for n in k.split(",") if n.strip()]
    if names:
        s = F.regexp_replace(s, rf"(?i)<(?!/?(?:{'|'.join(map(re.escape, names))})\b)[^>]+>", "")
    else:
        s = F.regexp_replace(s, r"</?[^>]+(>|$)", "")
    for entity, ch in ENTITIES:
        s = F.replace(s, F.lit(entity), F.lit(ch))
    if numeric:
        s = _vectorised(_code_points)(s)
    return _trimmed(F.regexp_replace(s, r"\n{3,}", "\n\n"))


def stripped_attributes(s: Column, keep: Sequence[str] = ()) -> Column:
    names = [n.strip() for k in keep for n in k.split(",") if n.strip()]
    if not names:
        return F.regexp_replace(s, r"<(\w+)\s+[^>]*?>", "<$1>")

    def change(text: str) -> str:
        def tag(m: re.Match) -> str:
            kept = [a[0].strip() for n in names if (a := re.search(rf"\s{re.escape(n)}\s*=\s*(?:\"[^\"]*\"|'[^']*')", m[0], re.I))]
            return f"<{m[1]}{''.join(' ' + k for k in kept)}>"

        return re.sub(r"<(\w+)\s+(?:[^>]*?)>", tag, text)

    return _vectorised(change)(s)


def removed_tags(s: Column, tags: Sequence[str] = ()) -> Column:
    names = [n.strip() for k in tags for n in k.split(",") if n.strip()]
    return F.regexp_replace(s, rf"(?i)</?(?:{'|'.join(map(re.escape, names))})\b[^>]*>", "") if names else s


_ATTRIBUTE = re.compile(r"([\w:-]+)(?:\s*=\s*(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|[^'\"\s>]+))?|(/)\s*$")


def removed_attributes(s: Column, attributes: Sequence[str] = ()) -> Column:
    gone = {n.strip().lower() for k in attributes for n in k.split(",") if n.strip()}
    if not gone:
        return s

    def change(text: str) -> str:
        def tag(m: re.Match) -> str:
            kept = [a[0].strip() for a in _ATTRIBUTE.finditer(m[2]) if a[2] or a[1].lower() not in gone]
            return f"<{m[1]}{''.join(' ' + k for k in kept)}>"

        return re.sub(r"<(\w+)\s+([^>]*?)>", tag, text)

    return _vectorised(change)(s)


def replaced_tags(s: Column, pairs: Sequence[tuple[str, str]] = ()) -> Column:
    for source, target in pairs:
        if source:
            s = F.regexp_replace(s, rf"<{re.escape(source)}(\s+[^>]*?)?>", f"<{target}$1>" if target else "")
            s = F.regexp_replace(s, f"</{re.escape(source)}>", f"</{target}>" if target else "")
    return s


def removed_elements(s: Column, selectors: Sequence[str] = ()) -> Column:
    """Elements taken out with what they hold: by tag, ``#id`` or ``.part-of-a-class``."""
    wanted = [x.strip() for k in selectors for x in k.split(",") if x.strip()]
    if not wanted:
        return s

    def gone(e: dom.Element) -> bool:
        return any(
            x[1:] in e.attributes.get("class", "") if x[0] == "." else e.attributes.get("id") == x[1:] if x[0] == "#" else e.tag == x.lower() for x in wanted
        )

    def change(text: str) -> str:
        body = dom.parse(text)
        for e in [e for e in body.descendants() if gone(e)]:
            e.detach()
        return body.inner_html()

    return _vectorised(change)(s)


def _node_json(node) -> dict | None:
    if isinstance(node, str):
        return {"type": "text", "content": node.strip()} if node.strip() else None
    out: dict = {"type": "element", "tag": node.tag}
    if node.attributes:
        out["attributes"] = dict(node.attributes)
    children = [c for c in map(_node_json, node.children) if c is not None]
    if children:
        out["children"] = children
    return out


def _html_json(text: str) -> str:
    nodes = [n for n in map(_node_json, dom.parse(text).children) if n is not None]
    return json.dumps(nodes[0] if len(nodes) == 1 else nodes, ensure_ascii=False, separators=(",", ":"))


as_json = _vectorised(_html_json)


def as_markdown(s: Column, base: str | Column | None = None) -> Column:
    """HTML as Markdown, addresses made absolute where a base is known."""

    @F.pandas_udf("string")
    def each(values: pd.Series, bases: pd.Series) -> pd.Series:
        return pd.Series([dom.markdown(v, b if isinstance(b, str) else None) if isinstance(v, str) else None for v, b in zip(values, bases)], dtype=object)

    return each(s, base if isinstance(base, Column) else F.lit(base).cast("string"))


def unescaped(s: str) -> str:
    return html.unescape(s)

"""Values of the template language as columns of known kind.

A value that a template handles is text; text that begins with a bracket may
be a JSON array, with a brace a JSON object. Where the compiler knows more - a
list made by ``split``, a number made by ``words`` - it keeps the column in its
own type, so lists stay arrays and nothing is parsed twice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blank characters of the template language: ASCII ones, no-break and other Unicode spaces, the byte order mark.
BLANK = r"[\t\n\x0b\f\r    -     　﻿]"


@dataclass(frozen=True)
class Val:
    """A column and its kind: text, list (array of text), num, bool or none."""

    col: Column
    kind: str = "text"


def lit(value) -> Val:
    if value is None:
        return Val(F.lit(None).cast("string"), "none")
    if isinstance(value, bool):
        return Val(F.lit(value), "bool")
    if isinstance(value, int | float):
        return Val(F.lit(float(value)), "num")
    return Val(F.lit(str(value)), "text")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), body), 0)


def number_text(x: Column) -> Column:
    """A number as scripts write it: 3, 2.5, 1e-7, Infinity."""
    return let(x, _number_text)


def _number_text(x: Column) -> Column:
    plain = F.when((x == F.floor(x)) & (F.abs(x) < 1e15), F.floor(x).cast("bigint").cast("string"))
    short = F.regexp_replace(F.regexp_replace(x.cast("string"), r"\.0E", "E"), r"E(-?)", "e$1")
    small = F.when((F.abs(x) >= 1e-6) & (F.abs(x) < 1e-3), F.regexp_replace(F.format_string("%.15f", x), "0+$", ""))
    return F.coalesce(plain, small, short)


def text(v: Val) -> Column:
    """The value as text, nothing as the empty text."""
    if v.kind == "list":
        return F.coalesce(F.to_json(v.col), F.lit(""))
    if v.kind == "num":
        return F.coalesce(number_text(v.col), F.lit(""))
    if v.kind == "bool":
        return F.coalesce(v.col.cast("string"), F.lit(""))
    return F.coalesce(v.col, F.lit(""))


NUMERIC = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def number(v: Val) -> Column:
    """The value as a number; the empty text is 0, what isn't a number null."""
    if v.kind == "num":
        return v.col
    if v.kind == "bool":
        return v.col.cast("double")
    s = F.trim(text(v))
    return F.when(s == "", F.lit(0.0)).when(s.rlike(NUMERIC), s.try_cast("double"))


def leading_number(s: Column) -> Column:
    """The number a text begins with, null where it begins with none."""
    return F.nullif(F.regexp_extract(s, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1), F.lit("")).try_cast("double")


def json_list(s: Column) -> Column:
    """The elements of a JSON array as text, null where the text is none."""
    return F.when(s.rlike(r"^\s*\["), F.from_json(s, "array<string>"))


def raw_list(s: Column) -> Column:
    """The elements of a JSON array as JSON, null where the text is none."""
    return F.when(s.rlike(r"^\s*\["), F.transform(F.from_json(s, "array<variant>"), lambda x: F.to_json(x)))


def raw_text(s: Column) -> Column:
    """A text as JSON."""
    quoted = F.to_json(F.array(s))
    return F.substr(quoted, F.lit(2), F.length(quoted) - 2)


def rejoined(raws: Column) -> Column:
    """The JSON array of elements given as JSON."""
    return F.concat(F.lit("["), F.array_join(raws, ","), F.lit("]"))


def json_map(s: Column) -> Column:
    """The members of a JSON object as text in their order, null where the text is none."""
    return F.when(s.rlike(r"^\s*\{"), F.from_json(s, "map<string,string>"))


def truthy(v: Val) -> Column:
    """Whether a condition holds: nothing, false, 0, the empty text and the empty list don't."""
    if v.kind == "none":
        return F.lit(False)
    if v.kind == "bool":
        return F.coalesce(v.col, F.lit(False))
    if v.kind == "num":
        return F.coalesce(v.col != 0, F.lit(False))
    if v.kind == "list":
        return F.coalesce(F.size(v.col) > 0, F.lit(False))
    return F.coalesce((v.col != "") & (v.col != "[]"), F.lit(False))


def over_list(v: Val, on_list: Callable[[Column], Column], on_text: Callable[[Column], Column]) -> Column:
    """A text made of the elements of a list, or of a text that isn't one."""
    if v.kind == "list":
        return on_list(v.col)
    s = text(v)
    arr = json_list(s)
    return F.when(arr.isNotNull(), on_list(arr)).otherwise(on_text(s))


def each(v: Val, change: Callable[[Column], Column]) -> Val:
    """A change of text made to each element of a list, or to a text."""
    if v.kind == "list":
        return Val(F.transform(v.col, change), "list")
    s = text(v)
    arr = json_list(s)
    return Val(F.when(arr.isNotNull(), F.to_json(F.transform(arr, change))).otherwise(change(s)))


def to_kind(v: Val, kind: str) -> Val:
    if v.kind == kind:
        return v
    if kind == "text":
        return Val(text(v))
    if kind == "num":
        return Val(number(v), "num")
    if kind == "bool":
        return Val(truthy(v), "bool")
    if kind == "list":
        s = text(v)
        return Val(F.when(s == "", F.array().cast("array<string>")).otherwise(F.coalesce(json_list(s), F.array(s))), "list")
    raise ValueError(kind)

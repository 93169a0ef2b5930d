"""Dates, moved dates and durations as text. Times are read and shown in the session's zone."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.values import leading_number, let

# Tokens of date formats, longest first, with the pattern that writes each.
TOKENS = {
    "YYYY": "yyyy", "MMMM": "MMMM", "dddd": "EEEE", "MMM": "MMM", "ddd": "EEE", "SSS": "SSS", "YY": "yy", "MM": "MM", "DD": "dd",
    "HH": "HH", "hh": "hh", "mm": "mm", "ss": "ss", "ZZ": "xx", "M": "M", "D": "d", "H": "H", "h": "h", "m": "m", "s": "s", "Z": "xxx", "Q": "q",
}
_TOKEN = re.compile(r"\[([^\]]*)\]|Do|" + "|".join(TOKENS) + "|WW|W|ww|w|dd|d|A|a|X|x|kk|k")


def parsed(s: Column, pattern: str | None = None) -> Column:
    """The time a text says: strictly by a format, or in ISO and common notations."""
    if pattern:
        java = "".join(TOKENS.get(m[0], "'" + m[1] + "'" if m[1] is not None else "a" if m[0] in "Aa" else m[0]) if (m := _TOKEN.match(part)) else part.replace("'", "''") for part in _parts(pattern))
        return F.try_to_timestamp(s, F.lit(java))
    iso = F.when(s.rlike(r"^\d{4}(-\d{1,2}(-\d{1,2}([T ]\d{1,2}:\d{2}(:\d{2}([.,]\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})?)?)?)?$"), s.try_cast("timestamp"))
    slashed = F.when(s.rlike(r"^\d{4}/\d{1,2}/\d{1,2}"), F.regexp_replace(s, "/", "-").try_cast("timestamp"))
    return F.coalesce(iso, slashed, *(_named(s, day, order) for day, order in _NAMED))


_MONTH, _YEAR = r"([A-Za-z]{3})[a-z]*\.?", r"(\d{4})"
_REST = r"(?:,?\s+(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([AaPp][Mm])?)?\s*(GMT|UTC|Z|[+-]\d{2}:?\d{2})?$"
#: Days with the month's name, and which groups hold year, month and day.
_NAMED = (
    (rf"^(?:[A-Z][a-z]{{2,8}},?\s+)?{_MONTH}\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+{_YEAR}", (3, 1, 2)),
    (rf"^(?:[A-Z][a-z]{{2,8}},?\s+)?(\d{{1,2}})(?:st|nd|rd|th)?\s+{_MONTH},?\s+{_YEAR}", (3, 2, 1)),
)


def _named(s: Column, day: str, order: tuple[int, int, int]) -> Column:
    """The time of a text that names its month, at midnight without a clock and in its own zone if it has one."""
    shape = day + _REST
    part = lambda i: F.regexp_extract(s, shape, i)
    number = lambda i: F.coalesce(part(i).try_cast("int"), F.lit(0))
    half, zone = F.lower(part(7)), F.regexp_replace(F.regexp_replace(part(8), "^(GMT|UTC|Z)$", "+0000"), ":", "")
    hour = F.when(half == "", number(4)).otherwise(number(4) % 12 + F.when(half == "pm", 12).otherwise(0))
    clock = F.concat_ws(":", *(F.lpad(x.cast("string"), 2, "0") for x in (hour, number(5), number(6))))
    written = F.concat_ws(" ", part(order[0]), F.initcap(part(order[1])), part(order[2]), clock)
    at = F.when(zone == "", F.try_to_timestamp(written, F.lit("yyyy MMM d HH:mm:ss"))).otherwise(F.try_to_timestamp(F.concat_ws(" ", written, zone), F.lit("yyyy MMM d HH:mm:ss xx")))
    return F.when(s.rlike(shape), at)


def _parts(pattern: str) -> list[str]:
    out, at = [], 0
    for m in _TOKEN.finditer(pattern):
        if m.start() > at:
            out.append(pattern[at : m.start()])
        out.append(m[0])
        at = m.end()
    return [*out, *([pattern[at:]] if at < len(pattern) else [])]


def _ordinal(t: Column) -> Column:
    d = F.dayofmonth(t)
    suffix = F.when((d % 100).between(11, 13), "th").when(d % 10 == 1, "st").when(d % 10 == 2, "nd").when(d % 10 == 3, "rd").otherwise("th")
    return F.concat(d.cast("string"), suffix)


def shown(t: Column, pattern: str) -> Column:
    """A time in a format."""

    def one(part: str) -> Column:
        m = _TOKEN.fullmatch(part)
        if not m:
            return F.lit(part)
        if m[1] is not None:
            return F.lit(m[1])
        special = {
            "Do": lambda: _ordinal(t), "W": lambda: F.weekofyear(t).cast("string"), "WW": lambda: F.lpad(F.weekofyear(t).cast("string"), 2, "0"),
            "w": lambda: F.ceil((F.dayofyear(t) + F.dayofweek(F.trunc(t, "year")) - 1) / 7).cast("string"),
            "ww": lambda: F.lpad(F.ceil((F.dayofyear(t) + F.dayofweek(F.trunc(t, "year")) - 1) / 7).cast("string"), 2, "0"),
            "d": lambda: (F.dayofweek(t) - 1).cast("string"), "dd": lambda: F.substring(F.date_format(t, "EEE"), 1, 2),
            "A": lambda: F.date_format(t, "a"), "a": lambda: F.lower(F.date_format(t, "a")),
            "X": lambda: F.unix_seconds(t).cast("string"), "x": lambda: F.unix_millis(t).cast("string"),
            "k": lambda: F.date_format(t, "k"), "kk": lambda: F.date_format(t, "kk"),
        }
        return special[part]() if part in special else F.date_format(t, TOKENS[part])

    return F.concat(*(one(p) for p in _parts(pattern))) if pattern else F.lit("")


def formatted(s: Column, pattern: str | None, read_as: str | None = None) -> Column:
    """``date``: a text that says no time stays as it is; without a format it is an invalid date."""
    t = F.when(s == "now", F.current_timestamp()).otherwise(parsed(s, read_as))
    as_text = let(t, lambda x: shown(x, pattern or "YYYY-MM-DD"))
    return F.when(s == "", s).otherwise(F.coalesce(as_text, s if pattern else F.lit("Invalid Date")))


def moved(s: Column, change: str) -> Column:
    """``date_modify``: the day some time before or after."""
    m = re.fullmatch(r"\s*([+-])\s*(\d+)\s*(year|month|week|day|hour|minute|second)s?\s*", change, re.I)
    if not m:
        return s
    n, unit = int(m[1] + m[2]), m[3].lower()
    t = parsed(s)
    if unit in ("year", "month"):
        day = F.add_months(t, n * (12 if unit == "year" else 1)).cast("timestamp")
        t = F.timestamp_micros(F.unix_micros(day) + F.pmod(F.unix_micros(t), F.lit(86_400_000_000)))
    else:
        seconds = {"week": 604800, "day": 86400, "hour": 3600, "minute": 60, "second": 1}[unit]
        t = F.timestamp_micros(F.unix_micros(t) + F.lit(n * seconds * 1_000_000))
    return F.coalesce(F.date_format(t, "yyyy-MM-dd"), s)


def duration(s: Column, pattern: str | None) -> Column:
    """``duration``: ISO 8601 or seconds as a clock; a year has 365 days, a month 30."""
    plain = F.regexp_replace(s, "^[\"'](.*)[\"']$", "$1")
    iso = r"^P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?$"
    weights = (31_536_000, 2_592_000, 86_400, 3600, 60, 1)
    parts = [F.coalesce(F.nullif(F.regexp_extract(plain, iso, i + 1), F.lit("")).try_cast("bigint"), F.lit(0)) * w for i, w in enumerate(weights)]
    whole = F.when(plain.rlike(iso), reduce(lambda a, b: a + b, parts)).otherwise(F.floor(leading_number(plain)))
    return F.when(s == "", s).otherwise(F.coalesce(let(whole, lambda total: _clock(total, pattern)), s))


def _clock(total: Column, pattern: str | None) -> Column:
    h, mi, sec = F.floor(total / 3600), F.floor(total / 60) % 60, total % 60
    two = lambda x: F.when(x < 10, F.concat(F.lit("0"), x.cast("string"))).otherwise(x.cast("string"))
    values = {"HH": two(h), "H": h.cast("string"), "mm": two(mi), "m": mi.cast("string"), "ss": two(sec), "s": sec.cast("string")}

    def write(p: str) -> Column:
        return F.concat(*(values[x] if x in values else F.lit(x) for x in re.split(r"(HH|H|mm|m|ss|s)", p) if x))

    return write(pattern) if pattern else F.when(total >= 3600, write("HH:mm:ss")).otherwise(write("mm:ss"))

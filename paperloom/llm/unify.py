"""Texts that look the same but differ in characters, in one form.

Quick-check properties tell the characters that may change (or be changed by
their neighbours): those that Unicode's NFC quick check answers with no or
maybe, marks, wide and narrow forms, kinds of blank and hyphen, ligatures,
radicals drawn like ideographs, invisible characters, and letters of other
scripts drawn like Latin ones. Runs of such characters, with the one character
before them that they may combine with, are cut out, brought to one form and
spliced back; everything else is copied as it is.

The form serves as a key. In the text that is given out, words that hold letters
only Cyrillic or Greek has are written in that script again, and so are words
that could be of either script where such words prevail: a rule on the form
alone, so look-alike texts still come out equal, and others apart.

What a reader can see stays: case, accents, added marks, raised and circled
figures, and joiners inside emoji or in scripts where they shape letters.

Defined results: null gives null; the empty text and texts of blanks give the
empty text; two texts look the same exactly if their forms are equal. Texts of
any length are read whole. Repeated rows give equal forms, ties can't occur.
"""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters drawn like Latin letters.
LOOK_ALIKES = dict(
    zip(
        "асԁеһіјԛорѕуԝхАВСЕНІЈКМОРԚЅТԜХ" + "νοΑΒΕΗΙΚΜΝΟΡΤΥΖΧ",
        "acdehijqopsywxABCEHIJKMOPQSTWX" + "voABEHIKMNOPTYZX",
        strict=True,
    )
)
# Drawn as a hyphen, as a line end, as nothing.
HYPHENS = "\u2010\u2011"
LINE_ENDS = {"\r\n": "\n", "\r": "\n", "\x85": "\n", "\u2028": "\n", "\u2029": "\n"}
INVISIBLE = "\u00ad\u034f\u061c\u180e\u200b\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff"
ZWNJ, ZWJ = "\u200c", "\u200d"
MARKUP = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>|</?[A-Za-z!](?:[^>\"']|\"[^\"]*\"|'[^']*')*>", re.S | re.I)


def _one_form(ch: str) -> str:
    """The form of a single character that looks like ``ch``."""
    if ch in LOOK_ALIKES:
        return LOOK_ALIKES[ch]
    if ch in HYPHENS:
        return "-"
    if ch in INVISIBLE:
        return ""
    kind, code = unicodedata.decomposition(ch).split(" ")[0], ord(ch)
    if unicodedata.category(ch) == "Zs" or ch in "\t\u2800\u3164\u115f\u1160\uffa0":
        return " "
    if 0x2160 <= code <= 0x217F:  # Roman numerals
        return unicodedata.normalize("NFKC", ch)
    if kind in ("<wide>", "<narrow>", "<noBreak>") or 0x2E80 <= code <= 0x2FD5 or 0xFB00 <= code <= 0xFB06:
        return "".join(map(_one_form, unicodedata.normalize("NFKC", ch))) if kind else ch
    parts = unicodedata.normalize("NFD", ch)
    if len(parts) > 1 and parts[0] in LOOK_ALIKES:
        return unicodedata.normalize("NFC", LOOK_ALIKES[parts[0]] + parts[1:])
    return ch


@lru_cache(1)
def _tables() -> tuple[dict[str, str], re.Pattern, re.Pattern]:
    """Characters with another form; one unstable character; a segment: the
    character before and the run of unstable ones."""
    forms, unstable, joins = {}, [], set()
    codes = [*range(9, 0xD800), *range(0xE000, 0x11000), *range(0x1D100, 0x1D250), *range(0x2F800, 0x2FA20)]
    for code in codes:
        d = unicodedata.decomposition(chr(code))
        if d and d[0] != "<" and " " in d:
            joins.add(int(d.split(" ")[1], 16))
    joins |= {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}
    for code in codes:
        ch = chr(code)
        form = _one_form(ch)
        if form != ch:
            forms[ch] = form
        if form != ch and ch != " " or code in joins or unicodedata.combining(ch) or not unicodedata.is_normalized("NFC", ch) or ch in (ZWNJ, ZWJ, *LINE_ENDS):
            unstable.append(code)
    ranges, start = [], None
    for a, b in zip(unstable, [*unstable[1:], -9]):
        start = a if start is None else start
        if b != a + 1:
            ranges.append(f"{re.escape(chr(start))}-{re.escape(chr(a))}" if a > start else re.escape(chr(a)))
            start = None
    chars = "".join(ranges)
    return forms, re.compile(f"[{chars}]"), re.compile(f"[^{chars}]?[{chars}]+")


def _pictorial(ch: str) -> bool:
    return ch == "️" or "☀" <= ch <= "➿" or "\U0001f000" <= ch <= "\U0001faff"


def _shaped(ch: str) -> bool:
    """In a script in which joiners change how letters are drawn."""
    return "\u0590" <= ch <= "\u0dff" or "\u1000" <= ch <= "\u109f" or "\u1780" <= ch <= "\u18af"


@lru_cache(100_000)
def _settle(segment: str, following: str) -> str:
    forms = _tables()[0]
    if any(j in segment for j in (ZWNJ, ZWJ)):
        kept = []
        for i, ch in enumerate(segment):
            if ch in (ZWNJ, ZWJ):
                before, after = segment[i - 1] if i else "", segment[i + 1] if i + 1 < len(segment) else following
                if not (before and after and (ch == ZWJ and _pictorial(before) and _pictorial(after) or _shaped(before) and _shaped(after))):
                    continue
            kept.append(ch)
        segment = "".join(kept)
    if segment.endswith("\r") and following == "\n":
        segment = segment[:-1]
    for old, new in LINE_ENDS.items():
        segment = segment.replace(old, new)
    return unicodedata.normalize("NFC", "".join([forms.get(ch, ch) for ch in segment]))


def one_form(text: str) -> str:
    """The one form of all texts that look like ``text``."""
    _, unstable, segments = _tables()
    if unstable.search(text):

        def splice(m: re.Match) -> str:
            segment, end = m[0], m.end()
            # what follows matters to joiners and line ends only
            matters = ZWJ in segment or ZWNJ in segment or segment[-1] == "\r"
            return _settle(segment, text[end : end + 1] if matters else "")

        text = segments.sub(splice, text)
    return text.strip(" \n")


_WORD = re.compile(r"[^\W\d_]+")
#: Scripts with look-alikes: letters of their own, and Latin letters written back (without those of a few languages).
_SCRIPTS = [
    (re.compile(f"[{own}]"), {latin: ch for ch, latin in LOOK_ALIKES.items() if low <= ch <= high and latin not in "hdqwQWY"})
    for own, low, high in (("\u0400-\u052f", "\u0400", "\u052f"), ("\u0370-\u03ff\u1f00-\u1fff", "\u0370", "\u03ff"))
]


def _written(word: str, back: dict[str, str], own: re.Pattern) -> str | None:
    """A word in another script, or null if a letter of it hasn't that script."""
    out = []
    for ch in word:
        if own.match(ch):
            out.append(ch)
            continue
        base, *marks = unicodedata.normalize("NFD", ch)
        if base not in back:
            return None
        letter = unicodedata.normalize("NFC", back[base] + "".join(marks))
        if len(letter) > 1:
            return None
        out.append(letter)
    return "".join(out)


def restored(form: str) -> str:
    """A form with its Cyrillic and Greek words in their own letters. Its form is ``form`` again."""
    for own, back in _SCRIPTS:
        if not own.search(form):
            continue
        words = set(_WORD.findall(form))
        written = {w: x for w in words if (x := _written(w, back, own)) is not None}
        sure = {w for w in written if own.search(w)}
        either = written.keys() - sure
        latin = sum(w not in written and w[0] < "\u0250" for w in words)
        known = sure | either if len(sure) > latin else sure
        form = _WORD.sub(lambda m: written[m[0]] if m[0] in known else m[0], form)
    return form


def shown(markup: str) -> str:
    """What a page shows: without markup, character references resolved."""
    text = MARKUP.sub("", markup)
    return html.unescape(text) if "&" in text else text


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _each(values: pd.Series, markup: bool) -> Iterator[tuple[str | None, str | None]]:
    for v in values:
        if v is None or v != v:
            yield None, None
        else:
            raw = shown(v) if markup else v
            yield raw, one_form(raw)


def unified(markup: bool = False):
    """A vectorised function of a text column: its one form, in its own scripts."""

    @F.pandas_udf("string")
    def form(values: pd.Series) -> pd.Series:
        return pd.Series([None if f is None else restored(f) for _, f in _each(values, markup)], dtype=object)

    return form


def fingerprints(markup: bool = False):
    """A vectorised function of a text column: 128-bit digests of the text as
    it is (``raw``) and of its one form (``form``), so that texts needn't be moved."""

    @F.pandas_udf("struct<form binary, raw binary>")
    def both(values: pd.Series) -> pd.DataFrame:
        pairs = [(None, None) if r is None else (_digest(f), _digest(r)) for r, f in _each(values, markup)]
        return pd.DataFrame(pairs, columns=["form", "raw"], dtype=object)

    return both


def look_alike_pairs(records: DataFrame) -> DataFrame:
    """Pairs ``rec_a < rec_b`` of different records of one ``src_table`` with
    equal ``form`` and different ``raw``. Takes ``src_table, rec_id, form, raw``.

    Only forms with several raw texts matter; they are found by an aggregation
    that combines map-side, so copies of one text cost a row per task. Pairs
    are made of classes of identical texts first and only then of their
    members, so no comparison is made that isn't a result.
    """
    key = ["src_table", "form"]
    members = records.where(F.col("form").isNotNull() & F.col("rec_id").isNotNull()).select("src_table", "rec_id", "form", "raw")
    varied = members.groupBy(*key).agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select(*key)
    members = members.join(varied, key, "left_semi").distinct()
    classes = members.select(*key, "raw").distinct()
    a, b = (classes.select(*key, F.col("raw").alias(x)) for x in ("raw_a", "raw_b"))
    pairs = a.join(b, key).where("raw_a < raw_b")
    one, two = (members.select(*key, F.col("raw").alias(f"raw_{x}"), F.col("rec_id").alias(x)) for x in ("a", "b"))
    rows = pairs.join(one, [*key, "raw_a"]).join(two, [*key, "raw_b"]).where("a <> b")
    return rows.select("src_table", F.least("a", "b").alias("rec_a"), F.greatest("a", "b").alias("rec_b")).distinct()


def look_alike_classes(records: DataFrame) -> DataFrame:
    """One row for each record with a text: ``class_id`` of all that look like
    it, the number of different texts among them, and the number of records."""
    key = ["src_table", "form"]
    members = records.where(F.col("form").isNotNull() & F.col("rec_id").isNotNull()).select("src_table", "rec_id", "form", "raw").distinct()
    texts = members.groupBy(*key, "raw").agg(F.count("*").alias("n"), F.min("rec_id").alias("least"))
    sizes = texts.groupBy(*key).agg(F.count("*").alias("n_texts"), F.sum("n").alias("n_records"), F.min("least").alias("class_id"))
    return members.join(sizes, key).select("src_table", "rec_id", "class_id", "n_texts", "n_records")

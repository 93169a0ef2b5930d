"""Personal information inside free text, replaced with typed placeholders.

E-mail addresses, phone numbers, identity numbers, street addresses and names
of persons are found and each is replaced by its type and a pseudonym. The
pseudonym of a validated number keeps its format: a keyed Feistel network
permutes its digits within that format (the date in an identity number within
the calendar, its check digit made anew), so equal values stay linked across
documents and different values stay different. Addresses, names and mailboxes
have no alphabet of their own; they get a keyed tag of their normal form.

Names need a given and a family name together. The known parts are the given
list, and parts that occur with several known ones in the names of users. As
long as there are few, they are broadcast; more are a table that is joined with
the pieces of the texts that could be parts, which finds the same.

Matching is done on a folded copy of the text of equal length (wide forms,
look-alike letters and kinds of blank as plain characters), so what is replaced
is exactly what is written. Invisible characters inside a value are kept out of
the copy and go with the value.

Defined results: null gives null and no kinds, the empty text itself; texts
are read whole; where two kinds overlap the one that begins first stays, of
those the longer, of those the earlier of KINDS; extra columns don't matter.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import date, timedelta
from functools import lru_cache
from itertools import repeat

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.unify import INVISIBLE, LOOK_ALIKES, ZWJ, ZWNJ
from paperloom.session import settle

KINDS = ("email", "id_number", "phone", "address", "person")
#: Most parts of names that are broadcast; more are joined with the texts, with the same result.
LEXICON = 100_000

# folding ----------------------------------------------------------------------

_WIDE = {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}
_BLANKS = dict.fromkeys([*map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)), "\t"], " ")
_DASHES = dict.fromkeys(map(chr, (0x2010, 0x2011, 0x2013)), "-")
_RADICALS = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0x2F00, 0x2FD6)}
_FOLD = str.maketrans({k: v for k, v in LOOK_ALIKES.items() if len(v) == 1} | _WIDE | _BLANKS | _DASHES | _RADICALS)
#: What makes a text worth folding; wide punctuation that no value has doesn't.
_FOLDED = re.compile("[" + "".join(map(re.escape, sorted({*_WIDE, *_BLANKS, *LOOK_ALIKES, *_DASHES, *_RADICALS} - set("，。：；！？（）～")))) + "]")
_UNSEEN = re.compile(f"[{INVISIBLE}{ZWNJ}{ZWJ}]")


def fold(text: str) -> tuple[str, list[int] | None]:
    """A plain copy, and the place of each of its characters where they moved."""
    places = None
    if not text.isascii():
        if _UNSEEN.search(text):
            places = [i for i, ch in enumerate(text) if ch not in INVISIBLE and ch not in (ZWNJ, ZWJ)]
            text = "".join([text[i] for i in places])
        if _FOLDED.search(text):
            text = text.translate(_FOLD)
    return text, places


# patterns ---------------------------------------------------------------------

_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_LOCAL = r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9])?"
EMAIL = re.compile(
    rf"{_LOCAL} ?(?:@|\(at\)|\[at\]) ?{_LABEL}(?:\.{_LABEL})*\.[A-Za-z]{{2,24}}(?![A-Za-z0-9@])"
    rf"|{_LOCAL} (?:\[at\]|\(at\)|at) {_LABEL}(?: (?:\[dot\]|\(dot\)|dot) {_LABEL})+(?![A-Za-z0-9@])",
    re.I,
)
# Endings of file names, which are no top-level domains here.
FILES = frozenset("png jpg jpeg gif svg webp bmp pdf js css html htm md txt zip mp3 mp4 json csv xml".split())

_ID_CN = r"(?<![0-9A-Za-z])\d{6} ?(?:18|19|20)\d{6} ?\d{3}[0-9Xx](?![0-9A-Za-z])"
_ID_US = r"(?<![0-9A-Za-z.-])\d{3}-\d{2}-\d{4}(?![0-9-])"
_ID_UK = r"(?<![0-9A-Za-z])[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D](?![0-9A-Za-z])"
ID_NUMBER = re.compile(f"{_ID_CN}|{_ID_US}|{_ID_UK}")
ID_WEIGHTS, ID_CHECKS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2), "10X98765432"

_END = r"(?![0-9]|[-.]\d)"
PHONE = re.compile(
    r"(?<![0-9A-Za-z.+-])(?:"
    rf"\+\d{{1,3}}[ .-]?(?:\(\d{{1,4}}\)[ .-]?)?\d{{2,5}}(?:[ .-]?\d{{2,8}}){{1,4}}{_END}"
    rf"|00\d{{2}}[ .-]?(?:\(0\)[ .-]?)?\d{{2,4}}(?:[ .-]?\d{{2,8}}){{1,3}}{_END}"
    rf"|1[3-9]\d(?:[ -]?\d{{4}}){{2}}{_END}"
    rf"|0\d{{2,3}}-\d{{7,8}}{_END}"
    rf"|0\d{{4}} \d{{3}} ?\d{{3}}{_END}"
    rf"|0\d{{2}} \d{{4}} \d{{4}}{_END}"
    rf"|\(\d{{3}}\) ?\d{{3}}[-.]\d{{4}}{_END}"
    rf"|\d{{3}}([.-])\d{{3}}\1\d{{4}}{_END})"
    r"|(?<![〇零一二三四五六七八九])一[三四五六七八九][〇零一二三四五六七八九]{9}(?![〇零一二三四五六七八九])"
)
_HAN_DIGITS = "〇零一二三四五六七八九"

# Kinds of streets.
STREETS_EN = "Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Drive|Dr|Close|Court|Ct|Row|Hill|Way|Place|Square|Terrace|Crescent|Boulevard|Blvd|Gardens|Grove|Walk|Mews|Parade|Quay"
STREETS_DE = "straße|strasse|str\\.|gasse|weg|steig|stieg|zeile|platz|allee|ring|damm|ufer|chaussee|pfad|winkel"
STREETS_FR = "rue|avenue|boulevard|place|chemin|allée|impasse|quai|route|cours"
_TOWN = r"[A-ZÄÖÜ][A-Za-zäöüßé]+(?:-[A-ZÄÖÜ][A-Za-zäöüßé]+)?"
_POST = r"(?:,? (?:\d{5}|[A-Z]{1,2}\d{1,2}[A-Z]? ?\d[A-Z]{2}))?"
ADDRESS = re.compile(
    # number, street, town
    r"(?<![0-9A-Za-z:.-])(?:(?:Flat|Unit|Apt\.?|Suite) \d{1,4}[A-Za-z]?, )?\d{1,5}[A-Za-z]? (?:[A-Z][a-z]+ ){0,3}"
    rf"(?:(?:{STREETS_EN})(?![A-Za-z])(?:, {_TOWN}{_POST})?|[A-Z][a-z]+, {_TOWN}{_POST})"
    # street, number, town
    rf"|(?<![A-Za-zäöüß])(?:[A-ZÄÖÜ][a-zäöüß]+(?:{STREETS_DE})|(?:[A-ZÄÖÜ][a-zäöüß]+ )?(?:Straße|Platz|Weg|Gasse|Allee|Ring)) \d{{1,4}} ?[a-z]?(?![A-Za-z0-9])(?:, \d{{5}} {_TOWN})?"
    rf"|(?<![0-9A-Za-z])\d{{1,4}}(?: bis| ter)?,? (?:{STREETS_FR}) (?:de |du |des |la |le |l')*[A-ZÉÈÀ][\wéèêàç'-]+"
    # town, district, street, number
    r"|(?:[一-鿿]{2,4}(?:省|市|县|州))?(?:[一-鿿]{1,4}(?:区|镇|县|乡))?[一-鿿]{1,6}?(?:大道|胡同|路|街|道|巷|弄) ?[0-9〇零一二三四五六七八九十百]{1,6}号(?!线|店|选手|文件)(?:[0-9]{1,4}(?:栋|单元|幢|号楼|楼|座))?(?:[0-9]{1,4}(?:单元))?(?:[0-9]{1,5}室?)?"
)
#: Words that lead to an address and aren't of it.
_LEADS = re.compile(r"[一-鿿]*?[在到于住址是往](?=[一-鿿]{2,4}[省市县州区镇])")
_EN_HINT = re.compile(r"\d[A-Za-z]? [A-Z]|[a-zß.] \d|\d[, ]")


def id_check(text: str) -> bool:
    """Whether an identity number is valid: its date and check digit, or its blocks."""
    plain = text.replace(" ", "").upper()
    if len(plain) == 18:
        try:
            born = date(int(plain[6:10]), int(plain[10:12]), int(plain[12:14]))
        except ValueError:
            return False
        return born.year >= 1850 and _check_digit(plain) == plain[17]
    if "-" in plain:
        area, group, serial = plain.split("-")
        return area not in ("000", "666") and group != "00" and serial != "0000"
    return plain[0] not in "DFIUV" and plain[1] not in "DFIOUV"


def _check_digit(plain: str) -> str:
    return ID_CHECKS[sum(int(c) * w for c, w in zip(plain, ID_WEIGHTS)) % 11]


# pseudonyms -------------------------------------------------------------------


@dataclass(frozen=True)
class Cipher:
    """A keyed Feistel network on numbers of a given range."""

    key: bytes
    rounds: int = 10

    def _round(self, i: int, tweak: str, size: int, value: int) -> int:
        h = hashlib.blake2b(f"{i}|{tweak}|{size}|{value}".encode(), key=self.key[:64], digest_size=16)
        return int.from_bytes(h.digest(), "big")

    def permute(self, value: int, n: int, tweak: str) -> int:
        """A permutation of 0..n-1: an unbalanced network on the next product of
        two numbers, walked until the result is in range."""
        if n < 2:
            return value
        a = math.isqrt(n - 1) + 1
        b = -(-n // a)
        while True:
            left, right = value % a, value // a
            for i in range(0, self.rounds, 2):
                left = (left + self._round(i, tweak, n, right)) % a
                right = (right + self._round(i + 1, tweak, n, left)) % b
            value = right * a + left
            if value < n:
                return value

    def restore(self, value: int, n: int, tweak: str) -> int:
        if n < 2:
            return value
        a = math.isqrt(n - 1) + 1
        b = -(-n // a)
        while True:
            left, right = value % a, value // a
            for i in range(self.rounds - 2, -2, -2):
                right = (right - self._round(i + 1, tweak, n, left)) % b
                left = (left - self._round(i, tweak, n, right)) % a
            value = right * a + left
            if value < n:
                return value

    def digits(self, text: str, tweak: str, valid: Callable[[str], bool] | None = None) -> str:
        """Digits permuted among digits of equal number; of those that are
        ``valid`` among the valid ones, by walking on until the next of them."""
        if not text:
            return ""
        walks = valid is not None and valid(text)
        while True:
            text = f"{self.permute(int(text), 10 ** len(text), f'{tweak}{len(text)}'):0{len(text)}d}"
            if not walks or valid(text):
                return text

    def tag(self, kind: str, normal: str) -> str:
        h = hashlib.blake2b(f"{kind}|{normal}".encode("utf-8", "surrogatepass"), key=self.key[:64], digest_size=5)
        return h.hexdigest()


_DAY_ONE = date(1850, 1, 1)
_DAYS = (date(2100, 1, 1) - _DAY_ONE).days


def _refill(shape: str, chars: str) -> str:
    """``shape`` with its letters and digits replaced in order."""
    left = iter(chars)
    return "".join(next(left) if ch.isalnum() else ch for ch in shape)


# Calling codes of one and two digits; all others have three.
CALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: What national numbers of a country look like, where that is more than their length.
_NATIONAL = {"86": lambda d: len(d) == 11 and d[0] == "1" and d[1] in "3456789", "1": lambda d: len(d) == 10 and d[0] in "23456789" and d[3] in "23456789"}


def phone_parts(plain: str) -> tuple[str, list[int]]:
    """The calling code of a number and the places of its national digits, so
    that all writings of a number have the same of both. A number without code
    has that of the country whose format it is written in."""
    places = [i for i, c in enumerate(plain) if c.isdigit()]
    digits = "".join(plain[i] for i in places)
    begin = 0 if plain[0] == "+" else 2 if digits.startswith("00") else None
    if begin is not None:
        n = next((n for n in (1, 2) if digits[begin : begin + n] in CALLING), 3)
        country, begin = digits[begin : begin + n], begin + n
        if digits[begin : begin + 1] == "0" and country != "39":
            begin += 1
        return country, places[begin:]
    if len(digits) == 11 and digits[0] == "1":
        return "86", places
    if digits[0] == "0":
        return "86" if re.fullmatch(r"0\d{2,3}-\d{7,8}", plain) else "44", places[1:]
    return "1", places


def pseudonym(kind: str, value: str, cipher: Cipher) -> str:
    """The placeholder of a found value (given as folded text)."""
    if kind == "id_number":
        plain = value.replace(" ", "").replace("-", "").upper()
        if len(plain) == 18:
            day = (date(int(plain[6:10]), int(plain[10:12]), int(plain[12:14])) - _DAY_ONE).days
            moved = _DAY_ONE + timedelta(cipher.permute(day, _DAYS, "born"))
            body = cipher.digits(plain[:6], "place") + moved.strftime("%Y%m%d") + cipher.digits(plain[14:17], "order")
            return f"[ID_NUMBER {_refill(value, body + _check_digit(body))}]"
        letters = [c for c in plain if not c.isdigit()]
        written = lambda d: d if letters else f"{d[:3]}-{d[3:5]}-{d[5:]}"
        digits = cipher.digits("".join(c for c in plain if c.isdigit()), kind, None if letters else lambda d: id_check(written(d)))
        parts = iter(digits)
        return f"[ID_NUMBER {_refill(value, ''.join(next(parts) if c.isdigit() else c for c in plain))}]"
    if kind == "phone":
        plain = "".join(str(max(0, _HAN_DIGITS.index(c) - 1)) if c in _HAN_DIGITS else c for c in value)
        country, places = phone_parts(plain)
        moved = iter(cipher.digits("".join(plain[i] for i in places), "phone+" + country, _NATIONAL.get(country)))
        places = frozenset(places)
        return f"[PHONE {''.join(next(moved) if i in places else c for i, c in enumerate(plain))}]"
    return f"[{kind.upper()} {cipher.tag(kind, normal_form(kind, value))}]"


@lru_cache(50_000)
def normal_form(kind: str, value: str) -> str:
    """One writing of values that mean the same."""
    low = value.casefold()
    if kind == "email":
        low = re.sub(r" ?(?:\[dot\]|\(dot\)| dot ) ?", ".", low)
        return re.sub(r" ?(?:@|\(at\)|\[at\]| at ) ?", "@", low)
    if kind == "person":
        family, comma, given = low.partition(", ")
        low = f"{given} {family}" if comma else low
        return re.sub(r" [a-z]\. ", " ", low)
    return re.sub(r"[\s,]+", " ", low)


# names ------------------------------------------------------------------------


@dataclass
class Names:
    """Parts of names in lower case, by role; found with one automaton."""

    given: frozenset
    family: frozenset
    _machine: object = field(default=None, repr=False)

    def hits(self, low: str) -> list[tuple[int, int, str]]:
        if self._machine is None:
            self._machine = _machine(self.given | self.family)
        return [(end + 1 - len(word), end + 1, word) for end, word in self._machine.iter(low)] if self._machine else []


_LATIN_RUN, _HAN_RUN = re.compile("[a-zäöüßé]+(?:-[a-zäöüßé]+)*"), re.compile("[一-鿿]+")


def _lowered(text: str) -> str:
    """In lower case, of equal length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def candidates(low: str) -> list[tuple[int, int, str]]:
    """The places that a learned part can have in a text in lower case: of Latin
    letters from edge to edge (letters beyond ASCII are no edge by themselves but
    may stand beside one), of ideographs any one to four."""
    found = []
    for m in _LATIN_RUN.finditer(low):
        s, e, word = m.start(), m.end(), m[0]
        found.append((s, e, word))
        if not word.isascii():
            odd = [i for i in range(s, e) if low[i] > "\x7f"]
            starts, ends = {s, *(i + 1 for i in odd)}, {e, *odd}
            found += [(a, b, low[a:b]) for a in starts for b in ends if a < b and (a, b) != (s, e)]
    for m in _HAN_RUN.finditer(low):
        s, e = m.span()
        found += [(a, b, low[a:b]) for a in range(s, e) for b in range(a + 1, min(a + 4, e) + 1)]
    return found


class _Either:
    """Membership in one of two sets."""

    def __init__(self, a, b):
        self.a, self.b = a, b

    def __contains__(self, x) -> bool:
        return x in self.a or x in self.b


class JoinedNames:
    """The listed parts with those of the learned ones that a text was found to hold."""

    def __init__(self, listed: Names, given: frozenset, family: frozenset):
        self.listed, self.learned = listed, given | family
        self.given, self.family = _Either(listed.given, given), _Either(listed.family, family)

    def hits(self, low: str) -> list[tuple[int, int, str]]:
        return sorted({*self.listed.hits(low), *(c for c in candidates(low) if c[2] in self.learned)}) if self.learned else self.listed.hits(low)


def _machine(words):
    """An automaton over ``words``; by pattern where the library is missing."""
    if not words:
        return None
    try:
        import ahocorasick
    except ImportError:
        return _Slow(words)
    machine = ahocorasick.Automaton()
    for w in words:
        machine.add_word(w, w)
    machine.make_automaton()
    return machine


class _Slow:
    def __init__(self, words):
        self.pattern = re.compile("(?=(" + "|".join(map(re.escape, sorted(words, key=len, reverse=True))) + "))")

    def iter(self, text: str):
        for m in self.pattern.finditer(text):
            for n in range(len(m[1]), 0, -1):
                yield m.start() + n - 1, m[1][:n]
                break


_GAP = re.compile(r" (?:[a-z]\. )?\Z")
_WORD = re.compile(r"[\w@+]|-(?=\w)")


def _han(ch: str) -> bool:
    return "㐀" <= ch <= "鿿"


def persons(text: str, names: Names) -> list[tuple[int, int]]:
    """Spans of a given and a family name together."""
    low = _lowered(text)
    hits = names.hits(low)
    if len(hits) < 2:
        return []
    hits = sorted(hits, key=lambda h: (h[0], -h[1]))
    spans, by_start = [], {}
    for s, e, w in hits:
        if not _han(w[0]):
            before, after = low[s - 1 : s], low[e : e + 2]
            if before and (before.isalnum() and before.isascii() or before in "@_-+.") or after[:1] and (after[0].isalnum() and after[0].isascii() or after[0] in "@_") or after[:1] == "-" and after[1:].isalnum():
                continue
        by_start.setdefault(s, []).append((e, w))
    starts = sorted(by_start)
    for s in starts:
        for e, w in by_start[s]:
            if _han(w[0]):
                # family, then given
                if w in names.family:
                    ends = [e2 for e2, w2 in by_start.get(e, []) if w2 in names.given and _han(w2[0])]
                    if ends:
                        spans.append((s, max(ends)))
                continue
            for gap in (1, 2, 4):
                for e2, w2 in by_start.get(e + gap, []):
                    between = low[e : e + gap]
                    straight = w in names.given and w2 in names.family and (between == " " or gap == 4 and _GAP.fullmatch(between))
                    turned = w in names.family and w2 in names.given and between == ", "
                    if straight or turned:
                        spans.append((s, e2))
    return spans


_LATIN_NAME = re.compile(r"(?:(?:Ms|Mr|Mrs|Dr|Prof|Frau|Herr|Mme|M)\.? )?([A-ZÄÖÜ][a-zäöüßé]+)(?: [A-Z]\.)? ([A-ZÄÖÜ][a-zäöüßé]+(?:-[A-ZÄÖÜ][a-zäöüßé]+)?)")


def named(text: str, names: Names) -> bool:
    """Whether a user's whole name is shaped as a person's and one part is known."""
    m = _LATIN_NAME.fullmatch(text)
    if m and (m[1].lower() in names.given or m[2].lower() in names.family):
        return True
    return 2 <= len(text) <= 5 and all(map(_han, text)) and any(text[:n] in names.family and text[n:] in names.given for n in (1, 2))


def learn_names(users: DataFrame, parts: DataFrame, support: int = 2, bound: int = LEXICON) -> Names | DataFrame:
    """The given lexicon (``part_role, name_part``) and the parts that stand with
    ``support`` different known ones in users' names (``user_name``), twice over.

    Up to ``bound`` parts come as :class:`Names`, more as a table (``part, role,
    listed``); :func:`replace` takes either and finds the same.
    """
    name = F.trim(F.col("user_name"))
    latin = r"^(?:(?:Ms|Mr|Mrs|Dr|Prof|Frau|Herr|Mme|M)\.? )?([A-ZÄÖÜ][a-zäöüßé]+)(?: [A-Z]\.)? ([A-ZÄÖÜ][a-zäöüßé]+(?:-[A-ZÄÖÜ][a-zäöüßé]+)?)$"
    turned = r"^([A-ZÄÖÜ][a-zäöüßé]+(?:-[A-ZÄÖÜ][a-zäöüßé]+)?), ([A-ZÄÖÜ][a-zäöüßé]+)$"
    han = r"^[一-鿿]{2,5}$"
    pair = lambda g, f: F.struct(F.lower(g).alias("given"), F.lower(f).alias("family"))
    splits = F.when(name.rlike(latin), F.array(pair(F.regexp_extract(name, latin, 1), F.regexp_extract(name, latin, 2))))
    splits = splits.when(name.rlike(turned), F.array(pair(F.regexp_extract(name, turned, 2), F.regexp_extract(name, turned, 1))))
    tail = lambda n: F.expr(f"substring(trim(user_name), {n + 1})")
    splits = splits.when(name.rlike(han), F.array(*(pair(tail(n), F.substring(name, 1, n)) for n in (1, 2))))
    pairs = users.select(F.explode(splits).alias("p")).select("p.given", "p.family").where("given <> '' and family <> ''").distinct()
    pairs = settle(pairs, "names")
    known = parts.select(F.lower("part_role").alias("role"), F.lower("name_part").alias("part")).distinct()
    given = known.where("role = 'given'").select(F.col("part").alias("given"))
    family = known.where("role = 'family'").select(F.col("part").alias("family"))
    grow = lambda a, b: pairs.join(a, a.columns, "left_semi").groupBy(b).agg(F.count("*").alias("n")).where(F.col("n") >= support).select(b)
    for _ in range(2):
        family, given = family.union(grow(given, "family")).distinct(), given.union(grow(family, "given")).distinct()
    both = given.select(F.col("given").alias("part"), F.lit("given").alias("role")).union(family.select(F.col("family").alias("part"), F.lit("family").alias("role")))
    listed = known.select("part", "role", F.lit(True).alias("listed"))
    lexicon = settle(both.where("part <> ''").join(listed, ["part", "role"], "left").withColumn("listed", F.coalesce("listed", F.lit(False))), "lexicon")
    return lexicon if lexicon.count() > bound else _collected(lexicon)


def _collected(lexicon: DataFrame) -> Names:
    rows = lexicon.collect()
    return Names(frozenset(r.part for r in rows if r.role == "given"), frozenset(r.part for r in rows if r.role == "family"))


def _held(df: DataFrame, lexicon: DataFrame, text: str, digest: str) -> DataFrame:
    """``digest, given, family``: the learned parts that each different text holds."""

    @F.pandas_udf("array<string>")
    def pieces(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted({w for _, _, w in candidates(_lowered(fold(t)[0]))}) for t in texts], dtype=object)

    texts = df.select(F.col(f"`{text}`").alias("t")).where("t is not null").distinct()
    each = texts.select(F.sha2("t", 256).alias(digest), F.explode(pieces("t")).alias("part"))
    of = lambda role: F.collect_set(F.when(F.col("role") == role, F.col("part"))).alias(role)
    return each.join(lexicon.where("not listed").select("part", "role"), "part").groupBy(digest).agg(of("given"), of("family"))


# detection --------------------------------------------------------------------

_MANY = re.compile(r"\d[\d .()-]{5,}|[A-Z]{2} ?\d\d|[〇零一二三四五六七八九]{9}")


def spans(text: str, names: Names, whole_name: bool = False) -> list[tuple[int, int, str]]:
    """What is found in folded text: start, end and kind, without overlaps."""
    found: list[tuple[int, int, str]] = []
    low_at = "@" in text or " dot " in text or "at)" in text or "at]" in text or "DOT" in text
    if low_at:
        found += [(m.start(), m.end(), "email") for m in EMAIL.finditer(text) if m[0].rsplit(".", 1)[-1].lower() not in FILES]
    if _MANY.search(text):
        found += [(m.start(), m.end(), "id_number") for m in ID_NUMBER.finditer(text) if id_check(m[0])]
        for m in PHONE.finditer(text):
            n = sum(c.isdigit() or c in _HAN_DIGITS for c in m[0])
            if 7 <= n <= 15:
                found.append((m.start(), m.end(), "phone"))
    if "号" in text or _EN_HINT.search(text):
        for m in ADDRESS.finditer(text):
            lead = _LEADS.match(m[0])
            found.append((m.start() + (lead.end() if lead else 0), m.end(), "address"))
    found += [(s, e, "person") for s, e in persons(text, names)]
    if whole_name and not found and named(text.strip(), names):
        found.append((0, len(text), "person"))
    if len(found) > 1:
        found.sort(key=lambda f: (f[0], -f[1], KINDS.index(f[2])))
        kept, end = [], -1
        for f in found:
            if f[0] >= end:
                kept.append(f)
                end = f[1]
        found = kept
    return found


def pseudonymised(text: str, names: Names, cipher: Cipher, whole_name: bool = False) -> tuple[str, list[str]]:
    """The text with placeholders, and the kinds found."""
    plain, places = fold(text)
    found = spans(plain, names, whole_name)
    if not found:
        return text, []
    out, at = [], 0
    for s, e, kind in found:
        a, b = (s, e) if places is None else (places[s], places[e - 1] + 1)
        out += [text[at:a], pseudonym(kind, plain[s:e], cipher)]
        at = b
    return "".join([*out, text[at:]]), sorted({k for _, _, k in found}, key=KINDS.index)


def replace(df: DataFrame, names: Names | DataFrame, key: bytes, text: str = "text", slot: str = "slot", user_slot: str = "user") -> DataFrame:
    """``df`` with ``clean`` (the text with placeholders) and ``kinds``."""
    prefix = "_found"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    listed = names if isinstance(names, Names) else _collected(names.where("listed"))
    shared = df.sparkSession.sparkContext.broadcast((listed.given, listed.family))

    @F.pandas_udf("struct<clean string, kinds array<string>>")
    def both(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        here, cipher = Names(*shared.value), Cipher(key)
        for texts, slots, *learned in batches:
            own = (JoinedNames(here, *(frozenset(() if x is None else x) for x in gf)) for gf in zip(*learned)) if learned else repeat(here)
            rows = [(None, []) if t is None else pseudonymised(t, n, cipher, s == user_slot) for t, s, n in zip(texts, slots, own)]
            yield pd.DataFrame(rows, columns=["clean", "kinds"], dtype=object)

    columns, more = df.columns, []
    if not isinstance(names, Names):
        digest, given, family = (f"{prefix}{x}" for x in ("digest", "given", "family"))
        held = _held(df, names, text, digest).withColumnsRenamed({"given": given, "family": family})
        df, more = df.withColumn(digest, F.sha2(F.col(f"`{text}`"), 256)).join(held, digest, "left"), [F.col(given), F.col(family)]
    out = df.withColumn(prefix, both(F.col(f"`{text}`"), F.col(f"`{slot}`"), *more)).withColumns({"clean": F.col(f"{prefix}.clean"), "kinds": F.col(f"{prefix}.kinds")})
    return out.select(*(F.col(f"`{c}`") for c in columns if c not in ("clean", "kinds")), "clean", "kinds")

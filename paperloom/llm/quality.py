"""Statistics of a document's text that tell prose from lists, tables and junk.

Each line that isn't blank is described by numbers only. Its geometry: how far
bars, gaps (in equal columns), separators of cells, list marks and keys stand
one below the other in the run of lines it is in; its indent, the period of the
document's indents and how evenly long its lines are, both as autocorrelations
at lags of one to four lines. Its ratios: symbols, digits, signs of programs,
ends of sentences, common words, lengths and vowels of words, turns of case,
tokens and lines that occur again, bytes read with the wrong table. A linear
score of them (``WEIGHTS``) gives running text, table, list, pairs, code or
junk; whichever kinds hold the greater part of a document give the document's.

A document is prose if running text is at least half of it and is more than a
sentence before a list or table.

All lines of many documents are measured at once on arrays of code points.
Documents are read whole; of one beyond ``STRETCH`` characters the measures are
taken on stretches of whole lines and added up, so the lines beside a cut miss
a neighbour and ``length_autocorr`` and ``indent_period`` are means by lines.

Defined results: null gives null statistics and kind ``empty``, as do the
empty text and blanks; null or unknown languages count common words in the
language that has most of them; equal texts have equal rows, ties between kinds
of structure go to the first of KINDS and those with running text to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("table", "list", "pairs", "code", "junk")
STATS = {
    "n_words": "long", "mean_word_len": "double", "symbol_ratio": "double", "digit_ratio": "double", "n_lines": "long", "end_punct_share": "double",
    "common_share": "double", "delimiter_share": "double", "marker_share": "double", "indent_period": "double", "length_autocorr": "double",
    "repeat_share": "double", "n_sentences": "long", "prose_share": "double", "text_kind": "string",
}

#: Weights of a line's measures for running text and each of KINDS. Found by :func:`fitted` on the
#: lines of the documents at sf0.1, labelled by patterns, and on copies of them without their marks and delimiters.
WEIGHTS = {
    "bars": (0.1, 3.8, -1.8, -0.4, -0.1, -1.6),
    "columns": (-0.9, 3.1, -1.4, -0.2, -0.2, -0.4),
    "cells": (-0.1, 2.8, -1.8, 0.0, -0.8, 0.0),
    "marks": (-2.7, -1.4, 3.9, -0.7, 1.7, -0.9),
    "keys": (-1.3, -1.7, -2.0, 4.5, 1.2, -0.7),
    "indent": (-2.2, -0.4, 1.7, -0.4, 1.5, -0.2),
    "period": (-1.3, -0.3, 0.5, -0.3, 1.6, -0.2),
    "evenness": (-0.3, 1.4, 1.0, -1.3, 1.4, -2.2),
    "autocorrelation": (-0.5, -0.3, -1.7, -0.7, -0.7, 3.9),
    "shortness": (-5.0, 1.9, 5.1, 2.1, -1.5, -2.8),
    "symbols": (-1.0, 1.2, -2.2, 0.2, -0.9, 2.7),
    "digits": (-2.9, 4.6, -2.0, 1.0, 0.5, -1.2),
    "program": (-2.6, 0.6, -1.2, -2.1, 5.1, 0.2),
    "colons": (-0.8, -3.4, 0.8, 3.4, 2.8, -2.9),
    "leaders": (-2.2, -0.8, 3.9, -0.3, -0.1, -0.6),
    "items": (-3.2, 1.0, 4.3, -0.4, 1.2, -3.0),
    "tagged": (-0.2, 3.0, -0.5, -0.2, -0.6, -1.4),
    "sentences": (0.8, -0.6, 0.5, -1.0, 0.8, -0.6),
    "ends": (1.2, -0.5, -0.6, -0.4, -0.8, 1.0),
    "capital": (0.3, -0.8, 1.1, -0.1, -0.9, 0.5),
    "word_length": (0.4, -0.5, -1.0, 0.7, 0.3, 0.2),
    "no_vowels": (-2.9, 2.1, -0.9, -0.1, -2.0, 3.8),
    "common": (3.5, -1.4, 2.8, -1.2, -1.9, -1.9),
    "turns": (-1.0, -2.8, -1.9, -0.5, 3.4, 2.8),
    "longest": (-1.7, 0.5, 1.1, -0.9, 0.8, 0.1),
    "repeats": (-3.2, 0.3, -1.1, -0.4, -0.3, 4.8),
    "broken": (-3.9, -0.1, -0.4, 0.0, 0.0, 4.4),
    "bias": (5.1, -1.1, -1.5, -1.7, -2.1, 0.8),
}
#: Characters measured at once, and most of a document measured as one.
STRETCH = 300_000

LETTER, DIGIT, BLANK, IDEOGRAPH = 1, 2, 3, 4
# Characters by what they do in a line.
_SIGNS = {
    "bar": "|", "separator": ",;、；", "program": "{}[]()<>=$&\\/;_#*`", "stop": "。！？.!?…", "colon": ":：", "vowel": "aeiouyäöüáéíóúàèìòùâêîôûëïœæAEIOUYÄÖÜÉÈÀ",
    "closing": "\"'”’»）)]】」*_", "bullet": "-*+•◦▪‣·–—", "inner": "'’-", "item": "·•|/>›", "tag": "#@",
    # the first and second characters of two or three bytes read with the wrong table
    "first": "ÃÂâåæçèéäïã", "second": "¡¢£¤¥¦§¨©ª«¬®¯°±²³´µ¶·¸¹º»¼½¾¿€‚„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸƒ­",
    "broken": "".join(map(chr, (*range(9), 11, 12, *range(14, 32), *range(0x80, 0x85), *range(0x86, 0xA0), 0xFFFD))),
}
_BIT = {name: i for i, name in enumerate(_SIGNS)}
_MIX = np.uint64(0x9E3779B97F4A7C15)
_HAN = re.compile("[㐀-鿿豈-﫿぀-ヿ가-힯]")
_LONGEST_TERM = 64


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code point: class, columns, lower case, signs; and powers for hashes."""
    kind, wide, signs = np.zeros(0x110000, np.uint8), np.ones(0x110000, np.uint8), np.zeros(0x110000, np.uint16)
    low = np.arange(0x110000, dtype=np.uint64)
    for code in range(0x110000):
        ch = chr(code)
        kind[code] = LETTER if ch.isalpha() else DIGIT if ch.isdigit() else BLANK if ch.isspace() else 0
        if kind[code] == LETTER and len(lower := ch.lower()) == 1:
            low[code] = ord(lower)
    for a, b in ((0x3400, 0xA000), (0xF900, 0xFB00), (0x3040, 0x3100), (0xAC00, 0xD7B0)):
        kind[a:b] = np.where(kind[a:b] == LETTER, IDEOGRAPH, kind[a:b])
    for a, b in ((0x1100, 0x1160), (0x2E80, 0xA4D0), (0xAC00, 0xD7A4), (0xF900, 0xFB00), (0xFE30, 0xFE70), (0xFF00, 0xFF61), (0xFFE0, 0xFFE7), (0x1F300, 0x1FAFF), (0x20000, 0x3FFFE)):
        wide[a:b] = 2
    for name, chars in _SIGNS.items():
        for ch in chars:
            signs[ord(ch)] |= 1 << _BIT[name]
    powers = np.full(_LONGEST_TERM, _MIX)
    powers[0] = 1
    return kind, wide, low, signs, np.cumprod(powers, dtype=np.uint64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def prepared(common: Mapping[str, Sequence[str]]) -> list[dict[int, np.ndarray]]:
    """For each language the hashes of its words (0) and of its ideographs by length."""
    *_, powers = _tables()
    out = []
    for _, terms in sorted(common.items()):
        by: dict[int, set] = {}
        for t in terms:
            codes = _codes(t)[:_LONGEST_TERM].astype(np.uint64)
            by.setdefault(len(t) if _HAN.search(t) else 0, set()).add(int((codes * powers[: len(codes)]).sum(dtype=np.uint64)))
        out.append({n: np.array(sorted(hashes), np.uint64) for n, hashes in by.items()})
    return out


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _before(x: np.ndarray, n: int = 1) -> np.ndarray:
    return np.concatenate([np.zeros(n, x.dtype), x[:-n]])[: len(x)]


def _after(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x[1:], np.zeros(1, x.dtype)])[: len(x)]


def _runs(keys: np.ndarray, there: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """How long the run of equal keys is in which a line stands, as 0 (alone) to 1."""
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1]) | ~there[1:] | ~there[:-1]
    run = np.cumsum(new) - 1
    return np.where(there, 1 - 1 / np.bincount(run)[run], 0.0)


def autocorrelation(x: np.ndarray, doc: np.ndarray, n: int, lags: Sequence[int] = (1, 2, 3, 4)) -> tuple[np.ndarray, np.ndarray]:
    """Of each document the highest autocorrelation of its lines' values at some
    lags, at least 0 (and 0 where there are under three lines or no variance),
    and the deviation of the values."""
    lines = np.maximum(np.bincount(doc, minlength=n), 1)
    off = x - (np.bincount(doc, weights=x, minlength=n) / lines)[doc]
    variance = np.bincount(doc, weights=off * off, minlength=n)
    best = np.zeros(n)
    for lag in lags:
        same = doc[lag:] == doc[:-lag]
        at = doc[lag:][same]
        together = np.bincount(at, weights=(off[lag:] * off[:-lag])[same], minlength=n)
        enough = (np.bincount(at, minlength=n) >= 2) & (variance > 1e-9) & (lines >= 3)
        best = np.maximum(best, np.where(enough, together / np.maximum(variance, 1e-9), 0.0))
    return best, np.sqrt(variance / lines)


#: How a line begins: nothing, a bullet, a number, a clock reading, a letter, a circled figure.
BULLET, NUMBER, CLOCK, LETTERED, CIRCLED = range(1, 6)


def lines_of(texts: Sequence[str], common: Sequence[Mapping[int, np.ndarray]]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """The measures of all lines that aren't blank, in the order of WEIGHTS, and
    counts that make the statistics of documents. ``texts`` have ``\\n`` only."""
    kind_of, wide_of, low_of, signs_of, powers = _tables()
    code = _codes("\n".join(texts))
    n = len(code)
    kind, signs, wide, low = kind_of[code], signs_of[code], wide_of[code], low_of[code]
    has = lambda name: (signs >> _BIT[name]) & 1 > 0
    ends_line, blank = code == 10, kind == BLANK
    row = np.cumsum(_before(ends_line), dtype=np.int64)
    solid = np.flatnonzero(~blank)
    if not len(solid):
        empty = np.zeros(0)
        return {name: empty for name in WEIGHTS}, {"doc": np.zeros(0, np.int64)}
    begins = np.concatenate([[True], row[solid][1:] != row[solid][:-1]])
    stands = np.concatenate([begins[1:], [True]])
    first, last = solid[begins], solid[stands]
    line = np.full(int(row[-1]) + 1, -1, np.int64)
    line[row[first]] = np.arange(len(first))
    of = line[row]  # the line of each character, -1 on blank ones
    m = len(first)
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]])
    doc = np.searchsorted(starts, first, side="right") - 1
    count = lambda mask: np.bincount(of[mask & ~blank], minlength=m).astype(float)
    at = lambda p: np.where(p < n, code[np.minimum(p, n - 1)], 10)

    size = np.bincount(of[solid], minlength=m).astype(float)
    width = np.bincount(of[solid], weights=wide[solid], minlength=m)
    is_letter, is_digit, is_han = kind == LETTER, kind == DIGIT, kind == IDEOGRAPH
    latin, digits, han = count(is_letter), count(is_digit), count(is_han)
    letters = latin + han
    line_start = np.concatenate([[0], np.flatnonzero(ends_line) + 1])[row[first]]
    indent = (first - line_start).astype(float)

    # how lines begin
    c0, c1, c2 = at(first), at(first + 1), at(first + 2)
    no_digit = np.flatnonzero(~is_digit)
    past = lambda p: np.append(no_digit, n)[np.searchsorted(no_digit, p)]
    stop_at = past(first)
    numbered = is_digit[first] & (stop_at - first <= 4)
    mark = np.zeros(m, np.int64)
    mark[has("bullet")[first] & (kind_of[c1] == BLANK) & (c1 != 10)] = BULLET
    mark[(numbered & np.isin(at(stop_at), [ord(c) for c in ".)、）"]) & (kind_of[at(stop_at + 1)] != DIGIT)) | ((c0 == 40) & (kind_of[c1] == DIGIT))] = NUMBER
    clock = past(np.minimum(stop_at + 1, n))
    mark[numbered & (at(stop_at) == 58) & (clock - stop_at == 3) & ((kind_of[at(clock)] == BLANK) | (at(clock) == 58))] = CLOCK
    mark[(kind_of[c0] == LETTER) & np.isin(c1, [46, 41]) & (kind_of[c2] == BLANK)] = LETTERED
    mark[(c0 >= 0x2460) & (c0 <= 0x2473)] = CIRCLED
    heading = (c0 == 35) & ((kind_of[c1] == BLANK) | (c1 == 35)) & (letters >= 0.5 * size)

    # sentences and how lines end
    stop, closing = has("stop"), has("closing")
    goes_on = _before(stop)
    sentence = stop & ~goes_on & ((code > 0x2FFF) | _after(blank) | _after(closing))
    sentence[n - 1] |= stop[n - 1] & ~goes_on[n - 1]
    stops, dots = count(sentence), count(stop & goes_on)
    back = lambda k: np.maximum(last - k, 0)
    ends = stop[last] | (closing[last] & (stop[back(1)] | (closing[back(1)] & stop[back(2)])))

    # delimiters one below the other
    inline = blank & ~ends_line
    tab = code == 9
    gap = np.flatnonzero(~blank & ((_before(inline) & _before(inline, 2)) | _before(tab)))
    gap = gap[gap > first[of[gap]]]
    columns_at = np.concatenate([[0], np.cumsum(wide, dtype=np.int64)])
    column = np.minimum(columns_at[gap] - columns_at[line_start[of[gap]]], 4095)
    place, holder = np.sort(of[gap] * 4096 + column), of[gap]
    above, below = np.concatenate([[False], doc[1:] == doc[:-1]]), np.concatenate([doc[1:] == doc[:-1], [False]])
    shared = (_among(holder * 4096 + column - 4096, place) & above[holder]) | (_among(holder * 4096 + column + 4096, place) & below[holder])
    gaps = np.bincount(holder, minlength=m).astype(float)
    in_column = np.bincount(holder, weights=shared, minlength=m) / np.maximum(gaps, 1)
    tabbed = np.bincount(of[tab & (of >= 0)], minlength=m) > 0
    bars, separators, colons = count(has("bar")), count(has("separator")), count(has("colon"))
    piece = (last - first + 1) / (separators + 1)
    alone = _before(blank) & ((_after(blank) & has("item")) | (_after(is_letter | is_han) & has("tag")))
    items = count(has("separator") | alone)
    key_end = np.full(m, -1, np.int64)
    signs_of_key = np.flatnonzero((has("colon") | (code == 61)) & (of >= 0))[::-1]
    key_end[of[signs_of_key]] = signs_of_key  # the first of a line stays
    keyed = (key_end > first) & (key_end - first <= 30) & (key_end < last) & (last - key_end <= 40) & (mark == 0) & ~np.isin(c0, [123, 91, 60, 46])

    # indents and lengths of lines
    many = len(texts)
    period, _ = autocorrelation(np.minimum(indent, 40.0), doc, many)
    follows, spread = autocorrelation(np.log1p(width), doc, many)
    n_lines = np.bincount(doc, minlength=many)
    follows = np.where((spread <= 1e-6) & (n_lines >= 3), 1.0, follows)
    even = np.where(n_lines >= 3, np.exp(-spread), 0.0)

    # words
    within = is_letter | (has("inner") & _before(is_letter) & _after(is_letter))
    word = np.flatnonzero(within & ~_before(within))
    long = np.flatnonzero(within & ~_after(within)) + 1 - word
    words = np.bincount(of[word], minlength=m).astype(float)
    spelt = np.flatnonzero(within)
    offset = np.minimum(spelt - np.repeat(word, long), _LONGEST_TERM - 1)
    hashes = np.add.reduceat(low[spelt] * powers[offset], np.cumsum(long) - long) if len(word) else np.zeros(0, np.uint64)
    frequent = np.zeros((max(1, len(common)), m))
    for k, terms in enumerate(common):
        for length, known in terms.items():
            if length == 0:
                frequent[k] += np.bincount(of[word[_among(hashes, known)]], minlength=m)
            elif length <= n:
                tail = n - length + 1
                h, whole = np.zeros(tail, np.uint64), np.ones(tail, bool)
                for i in range(length):
                    h += low[i : i + tail] * powers[i]
                    whole &= is_han[i : i + tail]
                frequent[k] += length * np.bincount(of[np.flatnonzero(whole & _among(h, known))], minlength=m)
    upper = is_letter & (low != code)
    lower = is_letter & ~upper
    turn = np.concatenate([(lower[:-1] & (upper[1:] | is_digit[1:])) | (is_digit[:-1] & is_letter[1:]) | (upper[:-1] & is_digit[1:]), [False]])
    vowels = count(has("vowel") & is_letter)

    # tokens, and what occurs again
    token, token_end = np.flatnonzero(~blank & ~_before(~blank)), np.flatnonzero(~blank & ~_after(~blank)) + 1
    has_han = np.concatenate([[0], np.cumsum(is_han)])
    plain = np.where(has_han[token_end] > has_han[token], 0, token_end - token)
    longest = np.zeros(m)
    np.maximum.at(longest, of[token], plain)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((low + np.uint64(7)) * (low * _MIX ^ (low >> np.uint64(3))), dtype=np.uint64)])
    own, holder = sums[token_end] - sums[token], of[token]
    tokens, again = np.bincount(holder, minlength=m), np.zeros(m)
    for lag in range(1, 9):
        equal = (own[lag:] == own[:-lag]) & (holder[lag:] == holder[:-lag])
        again = np.maximum(again, np.bincount(holder[lag:], weights=equal, minlength=m) / np.maximum(tokens - lag, 1))
    again = np.where((tokens >= 6) & (letters > 0), again, 0.0)
    in_line = (np.arange(len(solid)) - np.repeat(np.flatnonzero(begins), size.astype(np.int64))).astype(np.uint64)
    mixed = (low[solid] + np.uint64(1)) * (in_line * np.uint64(2) + np.uint64(1)) * _MIX
    whole_line = np.add.reduceat(mixed ^ (mixed >> np.uint64(31)), np.flatnonzero(begins)) ^ doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    _, which, times = np.unique(whole_line, return_inverse=True, return_counts=True)
    times = times[which]
    repeated = np.where((times >= 3) & (letters + digits > 0), np.minimum(1, 2 * times / n_lines[doc]), 0.0)
    broken = count(has("broken") | (_before(has("first")) & (has("second") | has("broken"))))

    measures = {
        "bars": np.maximum(_runs(bars, bars >= 2, doc), (bars >= 2) & (c0 == 124)),
        "columns": np.maximum(np.maximum(0.75 * in_column * (gaps > 0), _runs(gaps, (gaps > 0) & tabbed, doc)), _runs(gaps, gaps > 0, doc) * in_column),
        "cells": _runs(separators, separators >= 2, doc) * np.exp(-np.maximum(0, piece - 6) / 6),
        "marks": np.maximum(_runs(np.ones(m), mark > 0, doc), 0.3 * (mark > 0)),
        "keys": _runs(np.ones(m), keyed, doc),
        "indent": np.minimum(indent, 8) / 8,
        "period": period[doc],
        "evenness": even[doc],
        "autocorrelation": follows[doc],
        "shortness": np.where(n_lines[doc] >= 2, np.exp(-width / 40), 0.0),
        "symbols": (size - letters - digits) / size,
        "digits": digits / size,
        "program": np.minimum(1, 4 * count(has("program")) / size),
        "colons": np.minimum(1, 8 * colons / size),
        "leaders": np.minimum(1, dots / 4),
        "items": np.clip((items - 2) / 3, 0, 1) * np.exp(-np.maximum(0, width / (items + 1) - 14) / 8),
        "tagged": ((c0 == 60) | (c0 == 123)).astype(float),
        "sentences": np.minimum(1, stops / np.maximum(1, width / 60)),
        "ends": ends.astype(float),
        "capital": ((kind_of[c0] == IDEOGRAPH) | (low_of[c0] != c0)).astype(float),
        "word_length": np.minimum(1, np.bincount(of[word], weights=long, minlength=m) / np.maximum(words, 1) / 12),
        "no_vowels": np.where(latin >= 8, np.maximum(0, 0.28 - vowels / np.maximum(latin, 1)) / 0.28, 0.0),
        "common": np.minimum(1, frequent.max(axis=0) / np.maximum(words + han, 1)),
        "turns": np.minimum(1, 4 * count(turn) / size),
        "longest": np.minimum(1, longest / 40),
        "repeats": np.maximum(repeated, again),
        "broken": np.minimum(1, 60 * np.maximum(0, broken - 1) / size),
    }
    counts = {
        "doc": doc, "width": width, "heading": heading, "stops": stops, "ends": ends, "words": words + han, "letters_in_words": np.bincount(of[word], weights=long, minlength=m) + han, "size": size,
        "digits": digits, "symbols": size - letters - digits, "marked": mark > 0, "times": times, "period": period[doc], "follows": follows[doc],
        "aligned": np.maximum.reduce([measures[k] for k in ("bars", "columns", "cells", "keys")]) > 0, **{f"frequent{k}": f for k, f in enumerate(frequent)},
    }
    return measures, counts


def line_kinds(measures: Mapping[str, np.ndarray], weights: Mapping[str, Sequence[float]] | None = None) -> np.ndarray:
    """The kind of each line: 0 running text, then as KINDS."""
    weights = WEIGHTS if weights is None else weights
    scores = np.asarray(weights["bias"])[None, :] + sum(np.outer(x, weights[name]) for name, x in measures.items())
    return scores.argmax(axis=1)


def fitted(measures: Mapping[str, np.ndarray], kinds: np.ndarray, importance: np.ndarray | None = None, steps: int = 2500, decay: float = 1e-4) -> dict[str, list[float]]:
    """Weights for labelled lines: regularised softmax regression, rounded to tenths."""
    x = np.stack([*measures.values(), np.ones(len(kinds))], axis=1)
    y = np.eye(len(KINDS) + 1)[kinds]
    importance = np.ones(len(kinds)) if importance is None else importance
    w, slope, square = (np.zeros((x.shape[1], y.shape[1])) for _ in range(3))
    for t in range(1, steps + 1):
        raw = x @ w
        p = np.exp(raw - raw.max(axis=1, keepdims=True))
        g = x.T @ ((p / p.sum(axis=1, keepdims=True) - y) * importance[:, None]) / importance.sum() + decay * w
        slope, square = 0.9 * slope + 0.1 * g, 0.999 * square + 0.001 * g * g
        w -= 0.05 * slope / (1 - 0.9**t) / (np.sqrt(square / (1 - 0.999**t)) + 1e-9)
    return {name: [round(float(v), 1) for v in row] for name, row in zip([*measures, "bias"], w)}


def _stretches(text: str) -> list[str]:
    """A text in pieces of whole lines; a line beyond STRETCH is cut."""
    text = text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text
    out, at = [], 0
    while len(text) - at > STRETCH:
        cut = text.rfind("\n", at, at + STRETCH)
        cut = at + STRETCH if cut <= at else cut
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def unwritten(n_words: np.ndarray, common_share: np.ndarray) -> np.ndarray:
    """Text without the words every text has: many words, hardly a common one."""
    return (n_words >= 25) & (common_share < 0.02)


def _statistics(texts: Sequence[str], owner: np.ndarray, n: int, common: Sequence[Mapping[int, np.ndarray]], weights: Mapping[str, Sequence[float]] | None) -> np.ndarray:
    """Sums by document of what its statistics are made of."""
    measures, c = lines_of(texts, common)
    out = np.zeros((n, 19 + len(KINDS) + len(common)))
    if not len(c["doc"]):
        return out
    doc = owner[c["doc"]]
    kinds = np.where(c["heading"], -1, line_kinds(measures, weights))
    text = kinds == 0
    total = lambda x: np.bincount(doc, weights=x, minlength=n)
    sums = [
        c["words"], c["letters_in_words"], c["size"], c["digits"], c["symbols"], np.ones(len(doc)), c["ends"], c["aligned"], c["marked"], c["period"], c["follows"], 1 - 1 / c["times"],
        np.where(text, np.maximum(1, c["stops"]), 0), text, kinds > 0, np.where(text, c["width"], 0), *(np.where(kinds == k + 1, c["width"], 0) for k in range(len(KINDS))), *(c[f"frequent{k}"] for k in range(len(common))),
    ]
    for i, x in enumerate(sums):
        out[:, i] = total(x.astype(float))
    return out


def measured_texts(texts: Sequence[str | None], common: Sequence[Mapping[int, np.ndarray]], weights: Mapping[str, Sequence[float]] | None = None) -> pd.DataFrame:
    """The statistics of texts, as columns in the order of STATS."""
    sums = np.zeros((len(texts), 19 + len(KINDS) + len(common)))
    pieces: list[str] = []
    owner: list[int] = []

    def done() -> None:
        nonlocal sums
        low = owner[0]
        part = _statistics(pieces, np.array(owner) - low, owner[-1] - low + 1, common, weights)
        sums[low : owner[-1] + 1] += part
        pieces.clear()
        owner.clear()

    held = 0
    for i, t in enumerate(texts):
        for piece in _stretches(t) if isinstance(t, str) and t.strip() else ():
            if pieces and held + len(piece) > STRETCH:
                done()
                held = 0
            pieces.append(piece)
            owner.append(i)
            held += len(piece)
    if pieces:
        done()
    words, spelt, size, digits, symbols, lines, ends, aligned, marked, period, follows, again, sentences, n_text, n_odd, prose = sums.T[:16]
    by_kind, frequent = sums.T[16 : 16 + len(KINDS)], sums.T[16 + len(KINDS) : 16 + len(KINDS) + len(common)]
    there, one = size > 0, np.maximum(lines, 1)
    share = frequent.max(axis=0) / np.maximum(words, 1) if len(common) else np.zeros(len(texts))
    rest = by_kind.sum(axis=0)
    # a sentence before a list or table doesn't make prose
    mainly = (rest > prose) | ((n_odd >= 3) & (sentences <= 1) & (n_text <= 2) & (n_odd >= 2 * n_text))
    junk = ~mainly & unwritten(words, share) if len(common) else np.zeros(len(texts), bool)
    kind = np.array(KINDS, dtype=object)[by_kind.argmax(axis=0)]
    kind = np.where(junk, "junk", np.where(mainly, kind, "prose"))
    columns = [
        words, spelt / np.maximum(words, 1), symbols / np.maximum(size, 1), digits / np.maximum(size, 1), lines, ends / one, share, aligned / one, marked / one, period / one, follows / one, again / one,
        sentences, prose / np.maximum(1, prose + rest), np.where(there, kind, "empty"),
    ]
    out = {}
    for (name, t), values in zip(STATS.items(), columns):
        if t == "string":
            out[name] = pd.Series(values, dtype=object)
        else:
            out[name] = pd.Series(np.where(there, values, np.nan)).astype("Int64" if t == "long" else "float64")
    return pd.DataFrame(out)


def measured(df: DataFrame, common: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the statistics of its column ``text`` (they replace columns of
    the same names). ``common`` (``lang, term``) is a fixed table of frequent words."""
    terms: dict = {}
    for r in common.select("lang", "term").where("lang is not null and term is not null").distinct().collect():
        terms.setdefault(r.lang, set()).add(r.term.lower())
    shared = df.sparkSession.sparkContext.broadcast(prepared(terms))

    @F.pandas_udf(f"struct<{', '.join(f'{k} {t}' for k, t in STATS.items())}>")
    def stats(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        here = shared.value
        for texts in batches:
            yield measured_texts(list(texts), here)

    prefix = "_stats"
    while prefix in df.columns:
        prefix += "_"
    return df.withColumn(prefix, stats(F.col(f"`{text}`"))).withColumns({k: F.col(f"{prefix}.{k}") for k in STATS}).drop(prefix)

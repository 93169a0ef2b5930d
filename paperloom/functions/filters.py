"""The functions a template pipes values through.

Each takes a value and its arguments and gives a value; all are built-in
expressions, so a template's field is one projection in generated code. Only
functions that need a document tree or nested callbacks use vectorised Python
(see :mod:`paperloom.functions.markup`).

:func:`register` adds functions or replaces them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions import dates, markup
from paperloom.functions.values import BLANK, Val, each, json_list, json_map, leading_number, lit, number, number_text, over_list, raw_list, raw_text, rejoined, text

Filter = Callable[[Val, Sequence], Val]
FILTERS: dict[str, Filter] = {}


def register(name: str, function: Filter | None = None):
    """Add a function under a name; as a decorator too."""

    def put(f: Filter) -> Filter:
        FILTERS[name] = f
        return f

    return put(function) if function else put


def apply(name: str, value: Val, args: Sequence = ()) -> Val:
    """The value through the function; unknown functions change nothing."""
    return FILTERS[name](value, args) if name in FILTERS else value


def _arg(args: Sequence, i: int, default=None):
    if i >= len(args):
        return default
    a = args[i]
    return ":".join(a) if isinstance(a, tuple) else a


def _texts(change: Callable[[Column], Column]) -> Filter:
    """A function on text alone: lists pass as JSON text."""
    return lambda v, args: Val(change(text(v)))


# text -------------------------------------------------------------------------

register("lower", lambda v, args: each(v, F.lower))
register("upper", lambda v, args: each(v, F.upper))
register("trim", _texts(lambda s: F.regexp_replace(s, f"^{BLANK}+|{BLANK}+$", "")))
register("kebab", _texts(lambda s: F.lower(F.regexp_replace(F.regexp_replace(s, "([a-z])([A-Z])", "$1-$2"), f"({BLANK}|_)+", "-"))))
register("snake", _texts(lambda s: F.lower(F.regexp_replace(F.regexp_replace(s, "([a-z])([A-Z])", "$1_$2"), f"({BLANK}|-)+", "_"))))
register("uncamel", _texts(lambda s: F.lower(F.regexp_replace(F.regexp_replace(s, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z])([A-Z][a-z])", "$1 $2"))))
register("unescape", _texts(lambda s: F.replace(F.replace(s, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n"))))


def _capital(w: Column, rest_lower: bool = True) -> Column:
    tail = w.substr(F.lit(2), F.length(w))
    return F.concat(F.upper(w.substr(1, 1)), F.lower(tail) if rest_lower else tail)


def _unquoted(raw: Column) -> Column:
    """The text of a JSON value."""
    return F.get(F.from_json(F.concat(F.lit("["), raw, F.lit("]")), "array<string>"), 0)


@register("capitalize")
def capitalize(v: Val, args: Sequence) -> Val:
    out = each(v, lambda w: _capital(w))
    if out.kind == "list":
        return out
    # keys and texts of an object, other values as they are
    s = text(v)
    m = raw_map(s)
    value = lambda raw: F.when(raw.startswith('"'), raw_text(_capital(_unquoted(raw)))).otherwise(raw)
    made = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(raw_text(_capital(e["key"])), F.lit(":"), value(e["value"]))), ","), F.lit("}"))
    return Val(F.when(m.isNotNull(), made).otherwise(out.col))


register("pascal", _texts(lambda s: F.array_join(F.transform(F.split(s, f"(?:{BLANK}|[_-])+(?=.)"), lambda w: _capital(w, False)), "")))


@register("camel")
def camel(v: Val, args: Sequence) -> Val:
    words = F.split(text(v), r"(?<=[^A-Za-z0-9_])(?=[A-Za-z0-9_])")
    upper = F.array_join(F.transform(words, lambda w: _capital(w, False)), "")
    first = F.concat(F.lower(upper.substr(1, 1)), upper.substr(F.lit(2), F.length(upper)))
    return Val(F.regexp_replace(F.when(text(v).rlike(r"^[A-Za-z0-9_]"), first).otherwise(upper), f"(?:{BLANK}|[_-])+", ""))


# Words that titles write small.
SMALL_WORDS = ["a", "an", "the", "and", "but", "or", "for", "nor", "on", "at", "to", "from", "by", "in", "of"]


@register("title")
def title(v: Val, args: Sequence) -> Val:
    def one(s: Column) -> Column:
        words = F.split(s, f"{BLANK}+", -1)
        return F.array_join(F.transform(words, lambda w, i: F.when((i > 0) & F.lower(w).isin(SMALL_WORDS), F.lower(w)).otherwise(_capital(w))), " ")

    return each(v, one)


def _escapes(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "r": "\r", "t": "\t"}.get(m[1], m[1]), s, flags=re.S)


def _java_replacement(s: str) -> str:
    """A replacement in which $1 and $& refer to the match."""
    return re.sub(r"\$(?![\d&])", r"\\$", s.replace("\\", "\\\\")).replace("$&", "$0")


@register("replace")
def replace(v: Val, args: Sequence) -> Val:
    s = text(v)
    for a in args:
        search, new = (a[0], a[1] if len(a) > 1 else "") if isinstance(a, tuple) else (a, "")
        m = re.fullmatch(r"/(.+)/([gimsuy]*)", search, re.S)
        if m:
            flags = "".join(f for f in "ims" if f in m[2])
            pattern = (f"(?{flags})" if flags else "") + m[1]
            if "g" in m[2]:
                s = F.regexp_replace(s, pattern, _java_replacement(_escapes(new)))
            else:
                # only the first match: the text before it is a group of its own, then come those of the
                # pattern that must not match earlier, the match, and its groups
                groups = len(re.findall(r"(?<!\\)(?:\\\\)*\((?!\?(?!<[A-Za-z]))", m[1]))
                one = f"(?{flags}:{m[1]})"
                new = re.sub(r"\$([\d&])", lambda d: f"${groups + 2 + (0 if d[1] == '&' else int(d[1]))}", _escapes(new))
                s = F.regexp_replace(s, f"^((?:(?!{one})[\\s\\S])*+)({one})", "$1" + _java_replacement(new))
            continue
        search, new = _escapes(search), _escapes(new)
        if "|" in search and search != "|" and not re.search(r"[\n\r\t]", search):
            # a bar between words means either
            s = F.regexp_replace(s, "|".join(re.escape(p) for p in search.split("|")), _java_replacement(new))
        else:
            s = F.replace(s, F.lit(search), F.lit(new))
    return Val(s)


@register("safe_name")
def safe_name(v: Val, args: Sequence) -> Val:
    system = (_arg(args, 0) or "").lower().strip()
    s = F.regexp_replace(text(v), r"[#|\^\[\]]", "")
    control = r"\x00-\x1F"
    reserved = r"(?i)^(con|prn|aux|nul|com[0-9]|lpt[0-9])(\..*)?$"
    if system in ("mac", "linux"):
        s = F.regexp_replace(s, f"[/{':' if system == 'mac' else ''}{control}]", "")
    else:
        s = F.regexp_replace(s, rf'[<>:"/\\|?*{control}]', "")
        s = F.regexp_replace(F.regexp_replace(s, reserved, "_$1$2"), f"({BLANK}|\\.)+$", "")
    if system != "windows":
        s = F.regexp_replace(s, r"^\.", "_")
    s = F.substring(F.regexp_replace(s, r"^\.+", ""), 1, 245)
    return Val(F.when(s == "", "Untitled").otherwise(s))


@register("decode_uri")
def decode_uri(v: Val, args: Sequence) -> Val:
    s = text(v)
    return Val(F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), s))


# notes ------------------------------------------------------------------------


def _quoted(s: Column) -> Column:
    return F.array_join(F.transform(F.split(s, "\n", -1), lambda x: F.concat(F.lit("> "), x)), "\n")


#: Lists in lists are quoted to this depth, as Markdown indents them; deeper ones stay JSON.
QUOTED = 5


@register("blockquote")
def blockquote(v: Val, args: Sequence) -> Val:
    def nested(raws: Column, depth: int) -> Column:
        def one(raw: Column) -> Column:
            plain = F.when(raw.rlike(r"^[\[{]"), raw).otherwise(_unquoted(raw))
            quoted = F.array_join(F.transform(F.split(plain, "\n", -1), lambda x: F.concat(F.lit("> " * depth), x)), "\n")
            return F.when(raw.startswith("["), nested(raw_list(raw), depth + 1)).otherwise(quoted) if depth < QUOTED else quoted

        return F.array_join(F.transform(raws, one), "\n")

    if v.kind == "list":
        return Val(nested(F.transform(v.col, lambda x: F.when(x.rlike(r"^\s*\["), x).otherwise(raw_text(x))), 1))
    s = text(v)
    return Val(F.when(raw_list(s).isNotNull(), nested(raw_list(s), 1)).otherwise(_quoted(s)))


@register("callout")
def callout(v: Val, args: Sequence) -> Val:
    kind, heading = _arg(args, 0) or "info", _arg(args, 1) or ""
    fold = {"true": "-", "false": "+"}.get((_arg(args, 2) or "").lower(), "")
    return Val(F.concat(F.lit(f"> [!{kind}]{fold}{' ' + heading if heading else ''}\n"), _quoted(text(v))))


@register("footnote")
def footnote(v: Val, args: Sequence) -> Val:
    def of_map(s: Column) -> Column:
        name = lambda k: F.lower(F.regexp_replace(F.regexp_replace(k, "([a-z])([A-Z])", "$1-$2"), f"({BLANK}|_)+", "-"))
        entries = F.map_entries(json_map(s))
        notes = F.transform(entries, lambda e: F.concat(F.lit("[^"), name(e["key"]), F.lit("]: "), e["value"]))
        return F.coalesce(F.array_join(notes, "\n\n"), s)

    numbered = lambda a: F.array_join(F.transform(a, lambda x, i: F.concat(F.lit("[^"), (i + 1).cast("string"), F.lit("]: "), F.coalesce(x, F.lit("null")))), "\n\n")
    return Val(over_list(v, numbered, of_map))


def _encoded(s: Column) -> Column:
    """Encoded as a part of an address: blanks as %20, with ~'()!* as they are."""
    out = F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))
    for code, ch in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(ch))
    return out


def _escaped_md(s: Column) -> Column:
    return F.regexp_replace(s, r"([\[\]])", r"\\$1")


@register("fragment_link")
def fragment_link(v: Val, args: Sequence) -> Val:
    """A link to the place of a text in a page; the last argument is the page's address."""
    if not args:
        return Val(F.array(text(v)), "list")
    address = args[-1] if isinstance(args[-1], Column) else F.lit(str(_arg(args, len(args) - 1)))
    label = _arg(args, 0) if len(args) > 1 else "link"

    def one(s: Column) -> Column:
        words = F.filter(F.split(markup.stripped_md(s), f"{BLANK}+"), lambda w: w != "")
        few = _encoded(F.array_join(words, " "))
        many = F.concat(_encoded(F.array_join(F.slice(words, 1, 5), " ")), F.lit(","), _encoded(F.array_join(F.slice(words, -5, 5), " ")))
        return F.concat(s, F.lit(f" [{label}]("), address, F.lit("#:~:text="), F.when(F.size(words) > 10, many).otherwise(few), F.lit(")"))

    s = text(v)
    items = v.col if v.kind == "list" else F.coalesce(json_list(s), F.array(s))
    return Val(F.when(F.trim(s) == "", F.array(s)).otherwise(F.transform(items, one)), "list")


def _linked(make: Callable[[Column, Column], Column], plain: Callable[[Column], Column]) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """Entries of an object, and of each object of a list."""
    entries = lambda s: F.transform(F.map_entries(json_map(s)), lambda e: make(e["key"], e["value"]))
    item = lambda x: F.when(x.rlike(r"^\s*\{"), F.coalesce(entries(x), F.array(plain(x)))).otherwise(F.array(F.when(F.coalesce(x, F.lit("")) == "", "").otherwise(plain(x))))
    return entries, item


@register("link")
def link(v: Val, args: Sequence) -> Val:
    label = _arg(args, 0) or "link"
    spaces = lambda s: F.replace(_escaped_md(s), F.lit(" "), F.lit("%20"))
    plain = lambda s: F.concat(F.lit(f"[{label}]("), spaces(s), F.lit(")"))
    entries, item = _linked(lambda k, x: F.concat(F.lit("["), _escaped_md(x), F.lit("]("), spaces(k), F.lit(")")), plain)
    on_text = lambda s: F.when(F.trim(s) == "", s).otherwise(F.coalesce(F.array_join(entries(s), "\n"), plain(s)))
    return Val(over_list(v, lambda a: F.array_join(F.transform(a, lambda x: F.array_join(item(x), ",")), "\n"), on_text))


@register("image")
def image(v: Val, args: Sequence) -> Val:
    alt = _arg(args, 0) or ""
    plain = lambda s: F.concat(F.lit(f"![{alt}]("), _escaped_md(s), F.lit(")"))
    entries, item = _linked(lambda k, x: F.concat(F.lit("!["), _escaped_md(x), F.lit("]("), _escaped_md(k), F.lit(")")), plain)
    if v.kind == "list":
        return Val(F.flatten(F.transform(v.col, item)), "list")
    on_text = lambda s: F.when(F.trim(s) == "", s).otherwise(F.coalesce(F.to_json(entries(s)), plain(s)))
    return Val(over_list(v, lambda a: F.to_json(F.flatten(F.transform(a, item))), on_text))


@register("wikilink")
def wikilink(v: Val, args: Sequence) -> Val:
    alias = _arg(args, 0) or ""
    plain = lambda s: F.concat(F.lit("[["), s, F.lit(f"|{alias}]]" if alias else "]]"))
    entries, item = _linked(lambda k, x: F.concat(F.lit("[["), k, F.lit("|"), x, F.lit("]]")), plain)
    if v.kind == "list":
        return Val(F.flatten(F.transform(v.col, item)), "list")
    on_text = lambda s: F.when(F.trim(s) == "", s).otherwise(F.coalesce(F.to_json(entries(s)), plain(s)))
    return Val(over_list(v, lambda a: F.to_json(F.flatten(F.transform(a, item))), on_text))


@register("list")
def list_(v: Val, args: Sequence) -> Val:
    kind = _arg(args, 0) or ""
    number_mark, task = kind.startswith("numbered"), kind.endswith("task")

    def line(x: Column, i: Column | None, depth: int) -> Column:
        # only the first level counts on: deeper numbers follow a tab
        lead = F.concat((i + 1).cast("string"), F.lit(". ")) if number_mark and depth == 0 and i is not None else F.lit("1. " if number_mark else "- ")
        return F.concat(F.lit("\t" * depth), lead, F.lit("[ ] " if task else ""), F.coalesce(x, F.lit("null")))

    def level(arr: Column, depth: int) -> Column:
        def entry(x: Column, i: Column) -> Column:
            if depth >= 2:
                return line(x, i, depth)
            inner = F.when(x.rlike(r"^\s*\["), F.from_json(x, "array<string>"))
            return F.when(inner.isNotNull(), level(inner, depth + 1)).otherwise(line(x, i, depth))

        return F.array_join(F.transform(arr, entry), "\n")

    return Val(over_list(v, lambda a: level(a, 0), lambda s: F.when(s == "", s).otherwise(line(s, F.lit(0), 0))))


@register("table")
def table(v: Val, args: Sequence) -> Val:
    heads = [str(_arg(args, i)) for i in range(len(args))]
    cell = lambda s: F.replace(s, F.lit("|"), F.lit("\\|"))
    row = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    known = lambda s: F.when(F.coalesce(s, F.lit("")).isin("", "0", "false", "null"), "").otherwise(cell(s))

    def rows(arr: Column) -> Column:
        first = F.get(arr, 0)
        keys = F.array(*map(F.lit, heads)) if heads else F.json_object_keys(first)
        objects = F.concat_ws(
            "\n", row(keys), row(F.transform(keys, lambda k: F.lit("-"))),
            F.array_join(F.transform(arr, lambda o: row(F.transform(keys, lambda k: known(F.try_element_at(F.from_json(o, "map<string,string>"), k))))), "\n"),
        )
        if heads:
            n = len(heads)
            starts = F.sequence(F.lit(0), F.greatest(F.size(arr) - 1, F.lit(0)), F.lit(n))
            plain = F.concat_ws(
                "\n", row(keys), row(F.transform(keys, lambda k: F.lit("-"))),
                F.array_join(F.transform(starts, lambda i: row(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.coalesce(cell(F.get(arr, i + j)), F.lit(""))))), "\n"),
            )
        else:
            plain = F.concat_ws("\n", F.lit("| Value |\n| - |"), F.array_join(F.transform(arr, lambda x: row(F.array(cell(F.coalesce(x, F.lit("null")))))), "\n"))
        # lists in a list: the places of the first are the columns
        inner = lambda x: F.coalesce(json_list(x), F.array())
        places = F.array(*map(F.lit, heads)) if heads else F.transform(inner(first), lambda _, i: i.cast("string"))
        at = lambda x, k: F.lit(None).cast("string") if heads else F.get(inner(x), k.cast("int"))
        lists = F.concat_ws("\n", row(places), row(F.transform(places, lambda k: F.lit("-"))), F.array_join(F.transform(arr, lambda x: row(F.transform(places, lambda k: known(at(x, k))))), "\n"))
        return F.when(first.rlike(r"^\s*\{"), objects).when(first.rlike(r"^\s*\["), lists).otherwise(plain)

    def of_map(s: Column) -> Column:
        entries = F.map_entries(json_map(s))
        lines = F.transform(entries, lambda e: row(F.array(cell(e["key"]), cell(e["value"]))))
        made = F.concat_ws("\n", F.get(lines, 0), F.lit("| - | - |"), F.nullif(F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), "\n"), F.lit("")))
        return F.when(F.size(entries) > 0, made).otherwise(s)

    return Val(over_list(v, rows, of_map))


# numbers ----------------------------------------------------------------------


@register("calc")
def calc(v: Val, args: Sequence) -> Val:
    m = re.fullmatch(r"\s*(\*\*|[-+*/^])\s*(.*)", str(_arg(args, 0) or "").strip())
    try:
        operand = float(m[2]) if m else None
    except ValueError:
        operand = None
    s = text(v)
    if operand is None:
        return Val(s)
    x, op = number(v), m[1]
    if op in ("^", "**"):
        y = F.pow(x, F.lit(operand))
    elif op == "/":
        y = F.coalesce(F.try_divide(x, F.lit(operand)), F.when(x > 0, float("inf")).when(x < 0, float("-inf")).when(x == 0, float("nan")))
    else:
        y = {"+": x + operand, "-": x - operand, "*": x * operand}[op]
    rounded = F.when(F.abs(y) < 1e11, F.round(y, 10)).otherwise(y)
    return Val(F.when(x.isNull(), s).otherwise(number_text(rounded)))


def _rounded(x: Column, digits: int | None) -> Column:
    factor = 10.0 ** (digits or 0)
    return F.floor(x * factor + 0.5).cast("double") / factor


@register("round")
def round_(v: Val, args: Sequence) -> Val:
    a = _arg(args, 0)
    if a is not None and not re.fullmatch(r"\s*[+-]?\d+\s*", str(a)):
        return v
    digits = None if a is None else int(a)
    if v.kind == "num":
        return Val(_rounded(v.col, digits), "num")
    one = lambda s: F.coalesce(number_text(_rounded(leading_number(s), digits)), s)
    return each(v, one)


@register("number_format")
def number_format(v: Val, args: Sequence) -> Val:
    try:
        digits = int(str(_arg(args, 0, "0")).strip() or 0)
    except ValueError:
        digits = 0
    point, thousands = _arg(args, 1, "."), _arg(args, 2, ",")

    def one(s: Column) -> Column:
        x = leading_number(s)
        # half away from zero, as fixed notation has it for what doubles can hold
        plain = F.format_number(F.abs(x), digits)
        parts = F.split(plain, r"\.")
        whole = F.replace(parts[0], F.lit(","), F.lit(thousands))
        out = F.concat(F.when(x < 0, "-").otherwise(""), whole, *([F.lit(point), parts[1]] if digits > 0 else []))
        return F.when(x.isNull(), s).otherwise(out)

    return each(v, one)


@register("length")
def length(v: Val, args: Sequence) -> Val:
    def of_text(s: Column) -> Column:
        keys = F.when(s.rlike(r"^\s*\{"), F.size(F.json_object_keys(s)))
        # surrogate pairs count twice
        units = F.length(s) + F.regexp_count(s, F.lit(r"[\x{10000}-\x{10FFFF}]"))
        return F.coalesce(keys, units).cast("string")

    return Val(over_list(v, lambda a: F.size(a).cast("string"), of_text))


# lists ------------------------------------------------------------------------


@register("split")
def split(v: Val, args: Sequence) -> Val:
    s, sep = text(v), _arg(args, 0)
    if not sep:
        return Val(F.filter(F.split(s, "(?!^)(?!$)"), lambda x: x != ""), "list")
    return Val(F.split(s, re.escape(sep) if len(sep) == 1 else sep, -1), "list")


@register("join")
def join(v: Val, args: Sequence) -> Val:
    sep = _arg(args, 0, ",").replace("\\n", "\n")
    return Val(over_list(v, lambda a: F.array_join(a, sep, ""), lambda s: F.when(s.isin("undefined", "null"), "").otherwise(s)))


register("first", lambda v, args: Val(over_list(v, lambda a: F.coalesce(F.get(a, 0), text(v)), lambda s: s)))
register("last", lambda v, args: Val(over_list(v, lambda a: F.coalesce(F.get(a, F.size(a) - 1), text(v)), lambda s: s)))


@register("nth")
def nth(v: Val, args: Sequence) -> Val:
    spec = ",".join(str(_arg(args, i)) for i in range(len(args))).strip()
    if ":" in spec:
        left, basis = spec.split(":", 1)
        wanted = [int(x) for x in left.split(",") if x.strip().isdigit()]
        size = int(basis) if basis.strip().isdigit() else 1
        keep = lambda x, i: ((i % size) + 1).isin(wanted)
    elif m := re.fullmatch(r"(\d+)n", spec):
        keep = lambda x, i: (i + 1) % int(m[1]) == 0
    elif m := re.fullmatch(r"n\+(\d+)", spec):
        keep = lambda x, i: i + 1 >= int(m[1])
    elif spec.isdigit():
        keep = lambda x, i: i + 1 == int(spec)
    else:
        return v
    if v.kind == "list":
        return Val(F.filter(v.col, keep), "list")
    return over_raw(v, lambda a: F.filter(a, keep), lambda s: s)


def over_raw(v: Val, change: Callable[[Column], Column], on_text: Callable[[Column], Column]) -> Val:
    """A change of the elements of a JSON array, which keep their types."""
    s = text(v)
    raws = raw_list(s)
    return Val(F.when(raws.isNotNull(), rejoined(change(raws))).otherwise(on_text(s)))


def _bounds(n: Column, args: Sequence) -> tuple[Column, Column]:
    """Start and length of a slice, negative places counted from the end."""
    parts = [x.strip() for a in range(len(args)) for x in str(_arg(args, a)).split(",")]
    place = lambda p: F.greatest(n + int(p), F.lit(0)) if int(p) < 0 else F.least(F.lit(int(p)), n)
    start = place(parts[0]) if parts and re.fullmatch(r"-?\d+", parts[0]) else F.lit(0)
    end = place(parts[1]) if len(parts) > 1 and re.fullmatch(r"-?\d+", parts[1]) else n
    return start, F.greatest(end - start, F.lit(0))


@register("slice")
def slice_(v: Val, args: Sequence) -> Val:
    if not args:
        return v

    def of_list(a: Column) -> Column:
        start, n = _bounds(F.size(a), args)
        cut = F.slice(a, start + 1, n)
        several = F.to_json(cut) if v.kind == "list" else rejoined(F.slice(raw_list(text(v)), start + 1, n))
        return F.when(F.size(cut) == 1, F.get(cut, 0)).otherwise(several)

    def of_text(s: Column) -> Column:
        start, n = _bounds(F.length(s), args)
        return F.substr(s, start + 1, n)

    return Val(over_list(v, of_list, of_text))


def _raw(x: Column) -> Column:
    """An element of a list of text as JSON."""
    return F.when(x.isNull(), "null").when(x.rlike(r"^\s*[\[{]"), x).otherwise(raw_text(x))


@register("merge")
def merge(v: Val, args: Sequence) -> Val:
    more = [F.lit(str(_arg(args, i))) for i in range(len(args))]
    extra = F.array(*more) if more else F.array().cast("array<string>")
    if v.kind == "list":
        return Val(F.concat(v.col, extra), "list")
    s = text(v)
    arr = json_list(s)
    scalar = s.rlike(r'^\s*(-?\d+(\.\d+)?|true|false|".*")\s*$')
    joined = rejoined(F.concat(raw_list(s), F.transform(extra, raw_text)))
    made = F.when(s.isin("", "undefined", "null"), F.lit("[]")).when(arr.isNotNull(), joined)
    return Val(made.when(scalar, F.to_json(F.concat(F.array(s), extra))).otherwise(s))


def raw_map(s: Column) -> Column:
    """The members of a JSON object as JSON in their order, null where the text is none."""
    return F.when(s.rlike(r"^\s*\{"), F.transform_values(F.from_json(s, "map<string,variant>"), lambda k, x: F.to_json(x)))


def remapped(entries: Column) -> Column:
    """The JSON object of entries whose values are JSON."""
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(raw_text(e["key"]), F.lit(":"), e["value"])), ","), F.lit("}"))


@register("unique")
def unique(v: Val, args: Sequence) -> Val:
    if v.kind == "list":
        return Val(F.array_distinct(v.col), "list")

    def of_map(s: Column) -> Column:
        entries = F.map_entries(raw_map(s))
        last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["value"] == e["value"]))
        return F.coalesce(remapped(last), s)

    return over_raw(v, F.array_distinct, of_map)


@register("reverse")
def reverse(v: Val, args: Sequence) -> Val:
    if v.kind == "list":
        return Val(F.reverse(v.col), "list")

    def of_text(s: Column) -> Column:
        flipped = remapped(F.reverse(F.map_entries(raw_map(s))))
        scalar = s.rlike(r'^\s*(-?\d+(\.\d+)?|true|false|null|".*")\s*$')
        return F.when(s.isin("undefined", "null"), "").when(scalar, s).otherwise(F.coalesce(flipped, F.reverse(s)))

    return over_raw(v, F.reverse, of_text)


@register("object")
def object_(v: Val, args: Sequence) -> Val:
    part, s = _arg(args, 0), text(v)
    m = raw_map(s)
    made = {
        "keys": F.to_json(F.json_object_keys(s)),
        "values": rejoined(F.map_values(m)),
        "array": rejoined(F.transform(F.map_entries(m), lambda e: rejoined(F.array(raw_text(e["key"]), e["value"])))),
    }.get(part)
    return Val(s if made is None else F.when(m.isNotNull(), made).otherwise(s))


def _path(name: str, body: str) -> str | None:
    """The JSON path of ``x.a.b[0]`` for the argument ``x``."""
    m = re.fullmatch(rf"\s*{re.escape(name)}((?:\.\w+|\[\d+\])*)\s*", body)
    return "$" + m[1] if m else None


@register("map")
def map_(v: Val, args: Sequence) -> Val:
    """``x => x.a``, ``x => "text ${x}"`` or ``x => ({k: x.a})``, over a list."""
    m = re.fullmatch(r"\s*(\w+)\s*=>\s*(.+)", str(_arg(args, 0) or ""), re.S)
    if not m:
        return v
    name, body = m[1], m[2].strip()
    if body.startswith("(") and body.endswith(")"):
        body = body[1:-1].strip()
    is_object = lambda x: x.rlike(r"^\s*[\[{]")
    quoted = len(body) > 1 and body[0] == body[-1] and body[0] in "\"'"
    if quoted:
        pieces = body[1:-1].split(f"${{{name}}}")

        def change(x: Column) -> Column:
            return F.concat(*[c for i, p in enumerate(pieces) for c in ([x] if i else []) + [F.lit(p)]])

    elif body.startswith("{") and body.endswith("}"):
        pairs = [p.split(":", 1) for p in body[1:-1].split(",") if ":" in p]

        def member(x: Column, code: str) -> Column:
            path = _path(name, code)
            return F.when(is_object(x), F.get_json_object(x, path)).otherwise(x) if path else F.lit(code.strip().strip("\"'"))

        def change(x: Column) -> Column:
            fields = [F.concat(F.lit(f'"{k.strip().strip(chr(34) + chr(39))}":'), _raw(member(x, code))) for k, code in pairs]
            return F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))

    else:
        path = _path(name, body)
        if path is None:
            return v
        change = lambda x: F.when(is_object(x), F.get_json_object(x, path)).otherwise(x)
    if v.kind == "list":
        return Val(F.transform(v.col, change), "list")
    s = text(v)
    return Val(F.transform(F.coalesce(json_list(s), F.array(s)), change), "list")


@register("template")
def template(v: Val, args: Sequence) -> Val:
    pattern = _arg(args, 0)
    if not pattern:
        return v
    pieces = re.split(r"\$\{([\w.]+)\}", pattern.replace("\\n", "\n"))

    def one(x: Column) -> Column:
        cols = []
        for i, p in enumerate(pieces):
            if i % 2 == 0:
                cols.append(F.lit(p))
            else:
                got = F.when(x.rlike(r"^\s*\{"), F.get_json_object(x, "$." + p))
                cols.append(F.coalesce(F.nullif(got, F.lit("undefined")), F.when(~x.rlike(r"^\s*\{"), x) if p == "str" else F.lit(None).cast("string"), F.lit("")))
        filled = F.concat(*cols)
        return F.trim(F.array_join(F.filter(F.split(filled, "\n", -1), lambda s: F.trim(s) != ""), "\n"))

    return Val(over_list(v, lambda a: F.array_join(F.transform(a, one), "\n\n"), one))


# dates and markup are in modules of their own -----------------------------------

register("date", lambda v, args: Val(dates.formatted(text(v), _arg(args, 0), _arg(args, 1))))
register("date_modify", lambda v, args: Val(dates.moved(text(v), str(_arg(args, 0) or ""))))
register("duration", lambda v, args: Val(dates.duration(text(v), _arg(args, 0))))
register("strip_md", _texts(markup.stripped_md))
register("stripmd", _texts(markup.stripped_md))
register("strip_tags", lambda v, args: Val(markup.stripped_tags(text(v), [str(a) for a in args])))
register("strip_attr", lambda v, args: Val(markup.stripped_attributes(text(v), [str(a) for a in args])))
register("remove_tags", lambda v, args: Val(markup.removed_tags(text(v), [str(a) for a in args])))
register("remove_attr", lambda v, args: Val(markup.removed_attributes(text(v), [str(a) for a in args])))
register("remove_html", lambda v, args: Val(markup.removed_elements(text(v), [str(a) for a in args])))
register("replace_tags", lambda v, args: Val(markup.replaced_tags(text(v), [a if isinstance(a, tuple) else (a, "") for a in args])))
register("html_to_json", _texts(markup.as_json))
register("markdown", lambda v, args: Val(markup.as_markdown(text(v), args[0] if args else None)))


def names() -> list[str]:
    return sorted(FILTERS)


__all__ = ["FILTERS", "apply", "lit", "names", "register"]

"""From pages to notes: variables, front matter, properties, the note itself."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

from paperloom.functions import dates, filters
from paperloom.functions.urls import domain, without_text_fragment
from paperloom.functions.values import BLANK, Val, leading_number, number_text
from paperloom.lang import render
from paperloom.operators.routing import Property, Template

#: Facts of a page and the columns that hold them, where they are not of the same name.
FACTS = "title author content contentHtml url fullHtml description favicon image published site language selection selectionHtml highlights".split()


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), f"^{BLANK}+|{BLANK}+$", "")


def sanitized(name: Column) -> Column:
    """A title as the name of a file."""
    s = F.regexp_replace(F.coalesce(name, F.lit("")), r'[#|\^\[\]<>:"/\\?*\x00-\x1F]', "")
    s = F.regexp_replace(F.regexp_replace(s, r"^\.", "_"), r"^\.+", "")
    s = F.substring(_trimmed(s), 1, 245)
    return F.when(s == "", "Untitled").otherwise(s)


def variables(facts: Mapping[str, Column], at: datetime, words: Column | None = None, attachments: Column | None = None) -> dict[str, Val]:
    """The preset variables of a page; ``at`` is when it is clipped, an argument so that runs repeat."""
    got = lambda k: facts.get(k, F.lit("").cast("string"))
    url = without_text_fragment(F.coalesce(got("url"), F.lit("")))
    stamp = F.lit(at.strftime("%Y-%m-%dT%H:%M:%S") + "+00:00")
    listed = F.lit("") if attachments is None else F.array_join(F.transform(attachments, lambda a: F.concat(F.lit("- 📎 ["), a["name"], F.lit("]("), a["url"], F.lit(")"))), "\n")
    plain = {k: Val(_trimmed(got(k))) for k in ("author", "content", "contentHtml", "selection", "selectionHtml", "description", "fullHtml", "site", "title", "language")}
    return plain | {
        "attachments": Val(listed), "date": Val(stamp), "time": Val(stamp), "domain": Val(domain(url)), "favicon": Val(F.coalesce(got("favicon"), F.lit(""))),
        "highlights": Val(F.coalesce(got("highlights"), F.lit(""))), "image": Val(F.coalesce(got("image"), F.lit(""))), "noteName": Val(sanitized(got("title"))),
        "published": Val(F.trim(F.split(F.coalesce(got("published"), F.lit("")), ",")[0])), "url": Val(F.trim(url)),
        "words": Val(F.coalesce((words if words is not None else F.lit(0)).cast("string"), F.lit("0"))),
    }


def schema_variables(schemas: str | Column) -> Column:
    """The variables of a page's JSON-LD as a map: ``schema:@Type:key`` to its
    text, lists and objects as JSON, members of objects and lists by path."""
    def walk(data, found: dict, prefix: str = "") -> None:
        dumps = lambda x: json.dumps(x, ensure_ascii=False, separators=(",", ":"))
        if isinstance(data, list):
            for i, item in enumerate(data):
                if isinstance(item, dict):
                    types = item.get("@type")
                    for lead in [f"@{t}:" for t in types] if isinstance(types, list) else [f"@{types}:"] if types else [f"[{i}]:"]:
                        walk(item, found, lead)
        elif isinstance(data, dict):
            found[f"schema:{prefix.removesuffix('.')}"] = dumps(data)
            for k, v in data.items():
                if k == "@type" or v is None:
                    continue
                name = f"schema:{prefix}{k}"
                if isinstance(v, dict):
                    walk(v, found, f"{prefix}{k}.")
                elif isinstance(v, list):
                    found[name] = dumps(v)
                    for i, item in enumerate(v):
                        walk(item, found, f"{prefix}{k}[{i}].")
                else:
                    found[name] = v if isinstance(v, str) else dumps(v)

    @F.pandas_udf(MapType(StringType(), StringType()))
    def flat(values: pd.Series) -> pd.Series:
        out = []
        for v in values:
            found: dict = {}
            try:
                data = json.loads(v) if isinstance(v, str) else None
                walk(data if isinstance(data, list) else [data], found)
            except ValueError:
                pass
            out.append(found)
        return pd.Series(out, dtype=object)

    return flat(F.col(schemas) if isinstance(schemas, str) else schemas)


def meta_variables(metas: Column) -> Column:
    """Meta tags (array of name, property, content) as a map of variables; later ones win."""
    entry = lambda kind: F.transform(F.filter(metas, lambda m: (F.coalesce(m[kind], F.lit("")) != "") & (F.coalesce(m["content"], F.lit("")) != "")), lambda m: F.struct(F.concat(F.lit(f"meta:{kind}:"), m[kind]).alias("key"), m["content"].alias("value")))
    entries = F.concat(entry("name"), entry("property"))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


# properties -----------------------------------------------------------------------


def formatted(value: Column, kind: str, source: str) -> Column:
    """A compiled property as its type wants it."""
    if kind == "number":
        digits = F.regexp_replace(value, r"[^\d.-]", "")
        return F.when(digits != "", F.coalesce(number_text(leading_number(digits)), F.lit("NaN"))).otherwise(value)
    if kind == "checkbox":
        return ((F.lower(value) == "true") | (value == "1")).cast("string")
    if kind in ("date", "datetime") and "|date:" not in source:
        t = dates.parsed(value)
        return F.coalesce(dates.shown(t, "YYYY-MM-DD" if kind == "date" else "YYYY-MM-DDTHH:mm:ssZ"), value)
    return value


def yaml_key(name: str) -> str:
    trimmed = name.strip()
    odd = re.search(r"[:\s{}\[\],&*#?|<>=!%@\\-]", trimmed) or re.match(r"\d", trimmed) or re.fullmatch(r"(?i)true|false|null|yes|no|on|off", trimmed)
    if not odd:
        return name
    return "'" + name.replace("'", "''") + "'" if '"' in name else f'"{name}"'


def yaml_value(value: Column, kind: str) -> Column:
    """What follows the colon, with its line end."""
    quoted = lambda x: F.replace(x, F.lit('"'), F.lit('\\"'))
    some = F.trim(value) != ""
    if kind == "multitext":
        t = F.trim(value)
        # commas within a wiki link don't separate
        cut = F.transform(F.split(value, r",(?![^\[]*\]\])"), lambda x: F.trim(x))
        items = F.coalesce(F.when(t.startswith('["') & t.endswith('"]'), F.from_json(value, "array<string>")), cut)
        lines = F.transform(F.filter(items, lambda x: x != ""), lambda x: F.concat(F.lit('  - "'), quoted(x), F.lit('"\n')))
        return F.concat(F.lit("\n"), F.array_join(lines, ""))
    if kind == "number":
        digits = F.regexp_replace(value, r"[^\d.-]", "")
        return F.when(digits != "", F.concat(F.lit(" "), F.coalesce(number_text(leading_number(digits)), F.lit("NaN")), F.lit("\n"))).otherwise("\n")
    if kind == "checkbox":
        return F.concat(F.lit(" "), (value == "true").cast("string"), F.lit("\n"))
    if kind in ("date", "datetime"):
        return F.when(some, F.concat(F.lit(" "), value, F.lit("\n"))).otherwise("\n")
    return F.when(some, F.concat(F.lit(' "'), quoted(value), F.lit('"\n'))).otherwise("\n")


def frontmatter(properties: Sequence[tuple[str, Column, str]]) -> Column:
    """Properties (name, value, type) as front matter, nothing if there are none."""
    if not properties:
        return F.lit("")
    lines = [c for name, value, kind in properties for c in (F.lit(yaml_key(name) + ":"), yaml_value(value, kind))]
    return F.concat(F.lit("---\n"), *lines, F.lit("---\n"))


def property_type(p: Property, types: Mapping[str, str]) -> str:
    return types.get(p.name) or p.type or "text"


def clip(df: DataFrame, template: Template, facts: Mapping[str, Column], at: datetime, types: Mapping[str, str] | None = None, html: str | None = None, table: str | None = None, words: Column | None = None) -> DataFrame:
    """``df`` with the note of each page: ``note_name, frontmatter, content, full_content``."""
    presets = variables(facts, at, words)
    names = {f"_p{i}": p for i, p in enumerate(template.properties)}
    fields = {"_note": template.note_name} | {k: p.value for k, p in names.items()} | {"_body": template.content}
    out = render(df, fields, presets, html, table)
    kinds = {k: property_type(p, types or {}) for k, p in names.items()}
    props = [(p.name, formatted(F.col(k), kinds[k], p.value), kinds[k]) for k, p in names.items()]
    front = frontmatter(props)
    out = out.withColumns({"note_name": filters.apply("safe_name", Val(F.col("_note"))).col, "frontmatter": front, "content": F.col("_body")})
    return out.withColumn("full_content", F.concat("frontmatter", "content")).drop("_note", "_body", *names)


def write_address(base: str, behavior: str, path: Column, name: Column, content: Column, vault: str | None = None) -> Column:
    """The address that hands a note to an application that opens addresses of scheme ``base``."""
    e = filters._encoded
    mode = {"create": "", "overwrite": "&overwrite=true", "append-specific": "&append=true", "prepend-specific": "&prepend=true", "append-daily": "&append=true", "prepend-daily": "&prepend=true"}[behavior]
    target = F.lit(f"{base}daily?") if behavior.endswith("daily") else F.concat(F.lit(f"{base}new?file="), e(F.concat(path, name)))
    return F.concat(target, F.lit(f"{mode}{'&vault=' + vault if vault else ''}&content="), e(content))


def written(existing: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """Notes after new ones are written by their ``behavior``: ``create`` keeps
    what is there, ``overwrite`` replaces it, ``append*`` and ``prepend*`` add to it."""
    e = existing.select(F.col(key), F.col("content").alias("_old"))
    n = new.select(F.col(key), "behavior", F.col("content").alias("_new"))
    both = e.join(n, key, "full")
    content = (
        F.when(F.col("_old").isNull(), F.col("_new")).when(F.col("_new").isNull(), F.col("_old")).when(F.col("behavior") == "overwrite", F.col("_new"))
        .when(F.col("behavior").startswith("append"), F.concat_ws("\n", "_old", "_new")).when(F.col("behavior").startswith("prepend"), F.concat_ws("\n", "_new", "_old")).otherwise(F.col("_old"))
    )
    return both.select(key, content.alias("content"))

"""Which template a page is clipped with.

A handful of templates, known when the plan is made, becomes one CASE over the
address: no join. Triggers kept in a table are joined on the host their prefix
names, so pages are compared with the triggers of their host alone; patterns,
which name none, are few and broadcast only below a checked number.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.urls import host


@dataclass(frozen=True)
class Property:
    name: str
    value: str
    type: str | None = None


@dataclass(frozen=True)
class Template:
    name: str
    note_name: str = "{{title}}"
    content: str = "{{content}}"
    properties: Sequence[Property] = ()
    triggers: Sequence[str] = ()
    behavior: str = "create"
    path: str = ""
    extra: dict = field(default_factory=dict)


def url_matches(trigger: str, url: Column) -> Column:
    """A trigger between slashes is a pattern, another a prefix."""
    if len(trigger) > 1 and trigger.startswith("/") and trigger.endswith("/"):
        try:
            re.compile(trigger[1:-1])
        except re.error:
            return F.lit(False)
        return F.coalesce(url.rlike(trigger[1:-1]), F.lit(False))
    return F.coalesce(url.startswith(trigger), F.lit(False))


_SCHEMA = re.compile(r"schema:(@\w+)?(?:\.(.+?))?(?:=(.+))?")


def schema_matches(trigger: str, schemas: Column) -> Column:
    """``schema:@Type.key=value`` against a JSON text of one object or a list of them."""
    m = _SCHEMA.fullmatch(trigger)
    if not m or not (m[1] or m[2]):
        return F.lit(False)
    kind, key, value = m.groups()
    items = F.when(schemas.rlike(r"^\s*\["), F.from_json(schemas, "array<string>")).otherwise(F.array(schemas))

    def one(s: Column) -> Column:
        ok = F.lit(True)
        if kind:
            types = F.get_json_object(s, "$['@type']")
            listed = F.array_contains(F.from_json(types, "array<string>"), kind[1:])
            ok = ok & F.coalesce(F.when(types.startswith("["), listed).otherwise(types == kind[1:]), F.lit(False))
        if key:
            got = F.get_json_object(s, "$." + key)
            if value:
                among = F.array_contains(F.from_json(got, "array<string>"), value)
                ok = ok & F.coalesce(F.when(got.startswith("["), among).otherwise(got == value), F.lit(False))
            else:
                ok = ok & got.isNotNull()
        return ok

    return F.coalesce(F.exists(items, one), F.lit(False))


def first_match(templates: Sequence[Template], url: Column, schemas: Column | None = None) -> Column:
    """The number of the first template with a trigger that fits: addresses of
    all templates are looked at before schemas."""
    out = F.lit(None).cast("int")
    tests: list[tuple[Column, int]] = [(url_matches(t, url), i) for i, x in enumerate(templates) for t in x.triggers if not t.startswith("schema:")]
    if schemas is not None:
        tests += [(schema_matches(t, schemas), i) for i, x in enumerate(templates) for t in x.triggers if t.startswith("schema:")]
    for test, i in reversed(tests):
        out = F.when(test, i).otherwise(out)
    return out


def longest_match(templates: Sequence[Template], url: Column, schemas: Column | None = None) -> Column:
    """The number of the template with the longest prefix that fits, else the
    first pattern, else the first schema."""
    triggers = [(t, i) for i, x in enumerate(templates) for t in x.triggers]
    pattern = lambda t: len(t) > 1 and t[0] == t[-1] == "/"
    prefixes = sorted((x for x in triggers if not x[0].startswith("schema:") and not pattern(x[0])), key=lambda x: -len(x[0]))
    tests = [(url_matches(t, url), i) for t, i in [*prefixes, *(x for x in triggers if pattern(x[0]))]]
    if schemas is not None:
        tests += [(schema_matches(t, schemas), i) for t, i in triggers if t.startswith("schema:")]
    out = F.lit(None).cast("int")
    for test, i in reversed(tests):
        out = F.when(test, i).otherwise(out)
    return out


#: Patterns without a host that may be compared with every page.
PATTERNS = 1000


def routed(pages: DataFrame, triggers: DataFrame, key: str = "page_id", url: str = "url", longest: bool = False) -> DataFrame:
    """``<key>, template_idx, trigger_idx`` of the trigger that wins for each page.

    ``triggers`` has ``template_idx, trigger_idx, pattern``. Prefixes that name
    a host are joined on it; a hot host has as many pages but no more triggers,
    and the skew join splits it. Other prefixes and patterns are compared with
    all pages, at most ``PATTERNS`` of them.
    """
    t = triggers.withColumn("_h", host(F.col("pattern")))
    is_pattern = F.col("pattern").rlike("^/.+/$")
    whole = F.col("pattern").rlike("^[A-Za-z]+://[^/?#]+[/?#]")
    p = pages.select(F.col(key), F.col(url).alias("_url"), host(F.col(url)).alias("_h"))
    by_host = p.join(t.where(~is_pattern & whole), "_h").where(F.col("_url").startswith(F.col("pattern")))
    others = t.where((is_pattern | ~whole) & ~F.col("pattern").startswith("schema:"))
    if others.limit(PATTERNS + 1).count() > PATTERNS:
        raise ValueError(f"more than {PATTERNS} triggers name no host")
    fits = F.when(F.col("pattern").rlike("^/.+/$"), F.expr("_url rlike substring(pattern, 2, length(pattern) - 2)")).otherwise(F.col("_url").startswith(F.col("pattern")))
    anywhere = p.drop("_h").join(F.broadcast(others.drop("_h")), fits)
    cols = [key, "template_idx", "trigger_idx", "pattern"]
    found = by_host.select(*cols).unionByName(anywhere.select(*cols))
    rank = F.struct(F.when(F.col("pattern").rlike("^/.+/$"), 1).otherwise(0), -F.length("pattern"), "template_idx", "trigger_idx") if longest else F.struct("template_idx", "trigger_idx")
    return found.groupBy(key).agg(F.min_by(F.struct("template_idx", "trigger_idx"), rank).alias("_w")).select(key, "_w.template_idx", "_w.trigger_idx")


def ranked(found: DataFrame, key: str) -> DataFrame:
    """All matches of each page in the order they win."""
    w = Window.partitionBy(key).orderBy("template_idx", "trigger_idx")
    return found.withColumn("place", F.row_number().over(w))

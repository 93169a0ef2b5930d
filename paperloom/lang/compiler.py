"""From trees to columns.

A template's field becomes one expression; conditions are CASE, loops over
lists are lambdas, variables set are substituted. All selectors of all fields
of a template share one parse of the page.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import dom, filters
from paperloom.functions.values import Val, json_list, lit, number, over_list, text, to_kind, truthy
from paperloom.lang import parser as p
from paperloom.lang.scanner import ParseError

TRIM = r"^[\t ]*\r?\n?"
#: Filters that are given the page's address where they have no argument for it.
ADDRESSED = ("markdown", "fragment_link")


@dataclass
class Scope:
    """Names: ``presets`` can't be set over, ``names`` are set or looped over,
    ``table`` is a map column of all other variables."""

    presets: Mapping[str, Val] = field(default_factory=dict)
    names: dict[str, Val] = field(default_factory=dict)
    table: Column | None = None
    responses: Column | None = None

    def inner(self) -> Scope:
        return Scope(self.presets, dict(self.names), self.table, self.responses)

    def find(self, name: str) -> Val | None:
        return self.presets.get(name) or self.names.get(name)


class Compiler:
    """Compiles fields of a template; ``selectors`` collects what they select,
    to be given as the array column ``selected``."""

    def __init__(self, scope: Scope, selected: str = "_selected"):
        self.scope, self.selected, self.selectors = scope, selected, []
        self.errors: list[str] = []

    # nodes

    def compile(self, source: str) -> Column:
        """The text a template makes; the empty text if it can't be read."""
        try:
            nodes = p.parse(source)
        except ParseError as e:
            self.errors.append(str(e))
            return F.lit("")
        return self.nodes(nodes, self.scope)

    def nodes(self, nodes: tuple, scope: Scope) -> Column:
        out: list[Column] = []
        pending: bool | Column = False
        for node in nodes:
            if isinstance(node, p.Set):
                scope.names[node.name] = self.value(node.value, scope)
                pending = True
                continue
            if isinstance(node, p.Text):
                short = re.sub(TRIM, "", node.value)
                if pending is True:
                    out.append(F.lit(short))
                elif isinstance(pending, Column) and short != node.value:
                    out.append(F.when(pending, short).otherwise(node.value))
                else:
                    out.append(F.lit(node.value))
                pending = False
                continue
            if isinstance(node, p.Output):
                made = self.output(node.value, scope)
            elif isinstance(node, p.If):
                made, after = self.condition(node, scope)
            else:
                made = self.loop(node, scope)
            if pending is True:
                made = F.regexp_replace(made, TRIM, "")
            elif isinstance(pending, Column):
                made = F.when(pending, F.regexp_replace(made, TRIM, "")).otherwise(made)
            out.append(made)
            pending = after if isinstance(node, p.If) else isinstance(node, p.For)
        return F.concat(*out) if out else F.lit("")

    def output(self, expr, scope: Scope) -> Column:
        if self.prompt(expr) is not None:
            return text(self.value(expr, scope, prompt=True))
        v = self.value(expr, scope)
        if v.kind == "list" and not isinstance(expr, p.Filter):
            # a single element that was selected stands alone, none is nothing
            return F.when(F.size(v.col) == 1, F.coalesce(F.get(v.col, 0), F.lit(""))).when(F.size(v.col) == 0, "").otherwise(text(v))
        return text(v)

    def condition(self, node: p.If, scope: Scope) -> tuple[Column, Column]:
        made, other = None, F.lit("") if node.otherwise is None else self.nodes(node.otherwise, scope.inner())
        first, any_ = None, F.lit(False)
        for test, body in node.branches:
            c = truthy(self.value(test, scope))
            first = c if first is None else first
            any_ = any_ | c
            inner = self.nodes(body, scope.inner())
            made = F.when(c, inner) if made is None else made.when(c, inner)
        # blanks after the tag go where the first branch, or none, is taken
        after = first | (~any_ if node.otherwise is None else F.lit(False))
        return made.otherwise(other), after

    def loop(self, node: p.For, scope: Scope) -> Column:
        v = self.value(node.items, scope)
        items = v.col if v.kind == "list" else json_list(text(v))
        if v.kind in ("num", "bool", "none"):
            return F.lit("")
        n = F.size(items)

        def one(x: Column, i: Column) -> Column:
            own = scope.inner()
            own.names |= {
                node.name: Val(x), f"{node.name}_index": Val((i).cast("double"), "num"), "loop.index": Val((i + 1).cast("double"), "num"),
                "loop.index0": Val(i.cast("double"), "num"), "loop.first": Val(i == 0, "bool"), "loop.last": Val(i == n - 1, "bool"), "loop.length": Val(n.cast("double"), "num"),
            }
            return F.trim(F.regexp_replace(self.nodes(node.body, own), r"^\s+|\s+$", ""))

        return F.coalesce(F.array_join(F.transform(items, one), "\n"), F.lit(""))

    # expressions

    def prompt(self, expr) -> str | None:
        """The question of a value that begins with a text: it is answered elsewhere."""
        while isinstance(expr, p.Filter):
            expr = expr.of
        return expr.value if isinstance(expr, p.Literal) and isinstance(expr.value, str) else None

    def value(self, e, scope: Scope, prompt: bool = False) -> Val:
        if isinstance(e, p.Literal):
            if prompt and isinstance(e.value, str):
                return Val(F.coalesce(F.try_element_at(scope.responses, F.lit(e.value)), F.lit("")) if scope.responses is not None else F.lit(""))
            return lit(e.value)
        if isinstance(e, p.Name):
            return self.name(e.name, scope)
        if isinstance(e, p.Selector):
            key = (e.css, e.attribute, e.as_html)
            if key not in self.selectors:
                self.selectors.append(key)
            return Val(F.col(self.selected)[self.selectors.index(key)], "list")
        if isinstance(e, p.Filter):
            of = self.value(e.of, scope, prompt)
            args = e.args
            if e.name in ADDRESSED and (url := scope.presets.get("url")) is not None and (e.name == "fragment_link" or not args):
                args = (*args, text(url))
            return filters.apply(e.name, of, args)
        if isinstance(e, p.Not):
            return Val(~truthy(self.value(e.of, scope)), "bool")
        if isinstance(e, p.Member):
            return self.member(self.value(e.of, scope), self.value(e.key, scope), e.key)
        if isinstance(e, p.Binary):
            return self.binary(e, scope)
        raise TypeError(e)

    def name(self, name: str, scope: Scope) -> Val:
        found = scope.find(name)
        if found is not None:
            return found
        if name.startswith("schema:") and scope.table is not None:
            return self.schema(name, scope.table)
        parts = name.split(".")
        for cut in range(len(parts) - 1, 0, -1):
            base = scope.find(".".join(parts[:cut]))
            if base is not None:
                return Val(F.get_json_object(text(base), "$" + "".join(f".{x}" if not x.isdigit() else f"[{x}]" for x in parts[cut:])))
        if scope.table is not None:
            return Val(F.try_element_at(scope.table, F.lit(name)))
        return lit(None)

    def schema(self, name: str, table: Column) -> Val:
        """``schema:@Type:key``, shorthand ``schema:key``, and ``key[n].p``, ``key[*].p``."""
        key = name.removeprefix("schema:")
        m = re.fullmatch(r"(.+?)\[(\*|\d+)\](?:\.(.+))?", key)
        base = m[1] if m else key
        exact = F.try_element_at(table, F.lit(f"schema:{base}"))
        shorthand = F.get(F.filter(F.map_keys(table), lambda k: k.contains("@") & k.endswith(f":{base}") & k.startswith("schema:")), 0)
        found = F.coalesce(exact, F.try_element_at(table, shorthand) if "@" not in base else F.lit(None))
        if not m:
            return Val(found)
        items, path = json_list(found), f"$.{m[3]}" if m[3] else None
        inner = lambda x: F.get_json_object(x, path) if path else x
        if m[2] == "*":
            return Val(F.transform(items, inner), "list")
        return Val(inner(F.get(items, int(m[2]))))

    def member(self, of: Val, key: Val, expr) -> Val:
        if key.kind == "num":
            i = key.col.cast("int")
            if of.kind == "list":
                return Val(F.when(i >= 0, F.get(of.col, i)))
            return Val(F.when(i >= 0, F.get(json_list(text(of)), i)))
        if isinstance(expr, p.Literal):
            return Val(F.try_element_at(F.from_json(text(of), "map<string,string>"), F.lit(str(expr.value))))
        return Val(F.try_element_at(F.from_json(text(of), "map<string,string>"), text(key)))

    def binary(self, e: p.Binary, scope: Scope) -> Val:
        a, b = self.value(e.left, scope), self.value(e.right, scope)
        if e.op == "??":
            kind = a.kind if a.kind == b.kind else b.kind if a.kind == "none" else "text"
            return Val(F.when(truthy(a), to_kind(a, kind).col).otherwise(to_kind(b, kind).col), kind)
        if e.op in ("and", "or"):
            x, y = truthy(a), truthy(b)
            return Val(x & y if e.op == "and" else x | y, "bool")
        if e.op == "contains":
            needle = F.lower(text(b))
            inside = lambda items: F.exists(items, lambda x: F.lower(x) == needle)
            return Val(F.coalesce(over_list(a, inside, lambda s: F.contains(F.lower(s), needle)), F.lit(False)), "bool")
        if e.op in ("==", "!="):
            same = self.equal(a, b)
            return Val(same if e.op == "==" else ~same, "bool")
        if a.kind == b.kind == "text":
            x, y = text(a), text(b)
        else:
            x, y = number(a), number(b)
        test = {"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[e.op]
        return Val(F.coalesce(test, F.lit(False)), "bool")

    @staticmethod
    def equal(a: Val, b: Val) -> Column:
        """Loose equality: numbers are compared with what texts say, nothing equals only nothing."""
        if "none" in (a.kind, b.kind):
            return a.col.isNull() & b.col.isNull()
        if a.kind == b.kind:
            return a.col.eqNullSafe(b.col)
        if "list" in (a.kind, b.kind):
            joined = lambda v: F.array_join(v.col, ",", "") if v.kind == "list" else text(v)
            return joined(a) == joined(b)
        return F.coalesce(number(a) == number(b), F.lit(False)) & a.col.isNotNull() & b.col.isNotNull()


def render(df: DataFrame, fields: Mapping[str, str], presets: Mapping[str, Val | Column | str], html: str | None = None, table: str | None = None, responses: str | None = None) -> DataFrame:
    """``df`` with a column for each of ``fields`` (name: template). ``presets``
    are the variables by name; ``html`` the column that selectors look in,
    ``table`` a map of more variables, ``responses`` a map of answered prompts."""
    vals = {k: v if isinstance(v, Val) else Val(v if isinstance(v, Column) else F.col(v)) for k, v in presets.items()}
    name = "_selected"
    while name in df.columns:
        name += "_"
    scope = Scope(vals, {}, F.col(table) if table else None, F.col(responses) if responses else None)
    compiler = Compiler(scope, name)
    made = {k: compiler.compile(source) for k, source in fields.items()}
    if compiler.selectors:
        found = dom.selected(F.col(html), compiler.selectors) if html else F.array(*[F.array().cast("array<string>")] * len(compiler.selectors))
        df = df.withColumn(name, found)
    return df.withColumns(made).drop(name)

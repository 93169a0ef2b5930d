"""What an editor says about a template before it is used."""

from __future__ import annotations

import re
from collections.abc import Iterable

from paperloom.functions import filters
from paperloom.lang import parser as p

PRESETS = (
    "attachments author content contentHtml selection selectionHtml date time description domain favicon fullHtml highlights image noteName "
    "published site title url language words transcript"
).split()


def distance(a: str, b: str) -> int:
    """Levenshtein's distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def nearest(name: str, known: Iterable[str]) -> str | None:
    """The known name that is nearest, the first of equals, if it is near enough."""
    best = min(((distance(name.lower(), k.lower()), i, k) for i, k in enumerate(known)), default=None)
    return best[2] if best and best[0] < max(len(name), len(best[2])) / 2 else None


def _expressions(node):
    if isinstance(node, tuple):
        for n in node:
            yield from _expressions(n)
    elif hasattr(node, "__dataclass_fields__"):
        yield node
        for v in vars(node).values():
            yield from _expressions(v)


def variables(source: str, known: Iterable[str] = PRESETS) -> list[str]:
    """Names that nothing defines where they are used."""
    known = list(known)
    problems: list[str] = []

    def walk(nodes: tuple, names: set[str]) -> None:
        for n in nodes:
            parts = [n.value] if isinstance(n, p.Output | p.Set) else [n.items] if isinstance(n, p.For) else [c for c, _ in n.branches] if isinstance(n, p.If) else []
            for e in _expressions(tuple(parts)):
                if isinstance(e, p.Name) and ":" not in e.name and e.name.split(".")[0] not in names | set(known):
                    near = nearest(e.name, [*names, *known])
                    problems.append(f"unknown variable {e.name}" + (f", did you mean {near}?" if near else ""))
            if isinstance(n, p.Set):
                names.add(n.name)
            elif isinstance(n, p.For):
                walk(n.body, names | {n.name, f"{n.name}_index", "loop"})
            elif isinstance(n, p.If):
                for _, body in n.branches:
                    walk(body, set(names))
                walk(n.otherwise or (), set(names))

    walk(p.parse(source), set())
    return problems


def _whole(a) -> str:
    return ":".join(a) if isinstance(a, tuple) else str(a)


#: What the arguments of a filter must look like.
RULES = {
    "calc": r"\s*(\*\*|[-+*/^])\s*-?[\d.]+\s*", "date_modify": r"\s*[+-]\s*\d+\s*(year|month|week|day|hour|minute|second)s?\s*", "list": r"(numbered|task|numbered-task)?",
    "map": r"(?s)\s*\w+\s*=>\s*.+", "nth": r"\s*(\d+|\d+n|n\+\d+|\d+(\s*,\s*\d+)*\s*:\s*\d+)?\s*", "object": r"array|keys|values", "round": r"\s*\d*\s*",
    "safe_name": r"(?i)\s*(windows|mac|linux)?\s*", "slice": r"\s*-?\d*\s*(,\s*-?\d*\s*)?", "template": r"(?s).+",
}


def used_filters(source: str) -> list[str]:
    """Filters that don't exist, and arguments that don't fit."""
    problems = []
    for e in _expressions(p.parse(source)):
        if not isinstance(e, p.Filter):
            continue
        if e.name not in filters.FILTERS:
            near = nearest(e.name, filters.names())
            problems.append(f"unknown filter {e.name}" + (f", did you mean {near}?" if near else ""))
        elif e.name == "replace":
            if not e.args or not all(isinstance(a, tuple) for a in e.args):
                problems.append("replace needs quoted pairs")
        elif e.name in RULES and not re.fullmatch(RULES[e.name], ",".join(map(_whole, e.args))):
            problems.append(f"{e.name} can't use {','.join(map(_whole, e.args))!r}")
    return problems

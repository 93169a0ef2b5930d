"""Records of several sources mixed so that each has its share of the size.

Weights go down a tree, domain - language - source. Every node gives its
children the budget their weights ask for; a child that can't use its budget,
as its records may be repeated only so often, leaves the rest to its siblings,
and only what all of them together can't use goes back to be shared among the
siblings of their parent. A leaf then takes its records in seeded epochs: each
epoch is all its records in an order of its own, and the last epoch is cut
where the leaf's tokens are used up.

The order of an epoch is that of a keyed hash. Tokens are summed over ranges
of the hash first, so only one range of each leaf is summed record by record.

Defined results: records of sources without a target, of null sources and of
no tokens are left out; a null, unknown or oddly written language is ``und`` or
its plain name; targets without a positive share or repeat count nothing;
repeated keys are records of their own; a leaf's last record is taken if at
least half of it is within the budget, so shares are met to within a record.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.session import settle

LANGUAGES = ("de", "en", "fr", "zh")
#: The domain of each source; others are a domain of their own.
DOMAINS = {
    "web_article": "reading", "wiki_doc": "reading", "help_page": "reading", "podcast_notes": "speech", "interview": "speech",
    "forum_thread": "speech", "auction_lot": "trade",
}
#: Records of a leaf in one range of the hash, about.
RANGE = 50_000


@dataclass
class Node:
    """A part of the tree: its name, weight, what it can use at most, its parts."""

    name: str
    weight: float = 0.0
    most: float = 0.0
    parts: list = field(default_factory=list)
    budget: float = 0.0


def shared_out(budget: float, parts: Sequence[tuple[float, float]]) -> list[float]:
    """A budget among parts of given weight and most, in proportion to weight,
    shortages being shared again among those that have room."""
    given = [0.0] * len(parts)
    open_ = [i for i, (w, m) in enumerate(parts) if w > 0 and m > 0]
    left = min(budget, sum(parts[i][1] for i in open_))
    while open_ and left > 1e-9:
        total = sum(parts[i][0] for i in open_)
        full = [i for i in open_ if given[i] + left * parts[i][0] / total >= parts[i][1]]
        if not full:
            for i in open_:
                given[i] += left * parts[i][0] / total
            break
        for i in full:
            left -= parts[i][1] - given[i]
            given[i] = parts[i][1]
        open_ = [i for i in open_ if i not in full]
    return given


def budgeted(node: Node, budget: float) -> None:
    """Budgets of all nodes below, siblings before ancestors."""
    node.budget = budget
    for part, b in zip(node.parts, shared_out(budget, [(p.weight, p.most) for p in node.parts])):
        budgeted(part, b)


def tree(leaves: Sequence[tuple[str, str, float]], targets: Mapping[str, tuple[float, int]], domains: Mapping[str, str] = DOMAINS) -> Node:
    """The tree of ``(source, language, tokens)`` under ``source: (share, repeats)``.
    A source's weight goes to its languages by their tokens."""
    totals: dict = {}
    for source, _, n in leaves:
        totals[source] = totals.get(source, 0.0) + n
    root = Node("all")
    found: dict = {}
    for source, language, n in sorted(leaves):
        share, repeats = targets.get(source, (0.0, 0))
        if share <= 0 or repeats < 1 or n <= 0:
            continue
        domain = domains.get(source, source)
        if domain not in found:
            found[domain] = Node(domain)
            root.parts.append(found[domain])
        if (domain, language) not in found:
            found[domain, language] = Node(language)
            found[domain].parts.append(found[domain, language])
        leaf = Node(source, share * n / totals[source], n * repeats)
        found[domain, language].parts.append(leaf)
        for up in (found[domain, language], found[domain], root):
            up.weight += leaf.weight
            up.most += leaf.most
    return root


def leaf_budgets(root: Node) -> list[tuple[str, str, str, float]]:
    return [(d.name, l.name, s.name, s.budget) for d in root.parts for l in d.parts for s in l.parts]


def language(column: str, known: Sequence[str] = LANGUAGES):
    plain = F.lower(F.trim(F.regexp_extract(F.coalesce(F.col(column), F.lit("")), r"^\s*([A-Za-z]+)", 1)))
    return F.when(plain.isin(list(known)), plain).otherwise("und")


def mixed(sized: DataFrame, targets: DataFrame, key: str = "doc_id", size: str = "n_tokens", total: int | None = None, seed: int = 11, domains: Mapping[str, str] = DOMAINS) -> DataFrame:
    """The mixture: ``<key>, domain, lang, source, epoch, n_tokens``, a row for
    each time a record is used.

    ``sized`` has ``<key>, source, lang, <size>``; ``targets`` (``source,
    target_share, max_repeats``) is a fixed table. ``total`` tokens are asked
    for, by default as many as the targeted sources have.
    """
    spark = sized.sparkSession
    wanted: dict = {}
    for r in targets.where("source is not null and target_share > 0 and max_repeats >= 1").groupBy("source").agg(F.max("target_share").alias("s"), F.max("max_repeats").alias("r")).collect():
        wanted[r.source] = (float(r.s), int(r.r))
    schema = f"{key} {dict(sized.dtypes)[key]}, domain string, lang string, source string, epoch int, n_tokens long"
    rows = sized.select(F.col(key), "source", language("lang").alias("lang"), F.col(size).cast("long").alias("n_tokens"))
    rows = settle(rows.where(F.col("source").isin(sorted(wanted)) & (F.col("n_tokens") > 0)), "mix") if wanted else None
    # a row for each targeted source and known language
    leaves = [] if rows is None else rows.groupBy("source", "lang").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()
    if not leaves:
        return spark.createDataFrame([], schema)
    root = tree([(r.source, r.lang, float(r.t)) for r in leaves], wanted, domains)
    budgeted(root, float(sum(r.t for r in leaves) if total is None else total))
    tokens = {(r.source, r.lang): int(r.t) for r in leaves}
    plan = []
    for domain, lang, source, budget in leaf_budgets(root):
        b = min(int(round(budget)), tokens[source, lang] * wanted[source][1])
        plan.append((domain, lang, source, b // tokens[source, lang], b % tokens[source, lang]))
    plan_rows = F.broadcast(spark.createDataFrame(plan, "domain string, lang string, source string, full int, rest long"))
    rows = rows.join(plan_rows, ["lang", "source"])
    # the last epoch in order of a keyed hash, by ranges of it
    ranges = max(16, int(sum(r.n for r in leaves) // RANGE))
    order = F.xxhash64(F.lit(seed), "full", "source", key)
    rows = rows.withColumns({"_h": order, "_r": F.floor((order.cast("double") / 2.0**63 + 1.0) * (ranges / 2)).cast("long")})
    leaf = ["lang", "source"]
    sums = rows.groupBy(*leaf, "_r").agg(F.sum("n_tokens").alias("t"))
    up_to = Window.partitionBy(*leaf).orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.select(*leaf, "_r", "t", F.sum("t").over(up_to).alias("_end"))
    rows = rows.join(sums.select(*leaf, "_r", (F.col("_end") - F.col("t")).alias("_start"), "_end"), [*leaf, "_r"])
    cut = (F.col("_start") < F.col("rest")) & (F.col("_end") > F.col("rest"))
    within = Window.partitionBy(*leaf, "_r").orderBy("_h", key, "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    edge = rows.where(cut).withColumn("_before", F.col("_start") + F.sum("n_tokens").over(within) - F.col("n_tokens"))
    edge = edge.withColumn("_last", F.col("_before") + F.col("n_tokens") / 2 <= F.col("rest"))
    sure = rows.where(~cut).withColumn("_last", F.col("_end") <= F.col("rest"))
    taken = sure.select(key, "domain", "lang", "source", "full", "n_tokens", "_last").unionByName(edge.select(key, "domain", "lang", "source", "full", "n_tokens", "_last"))
    times = F.col("full") + F.when(F.col("_last"), 1).otherwise(0)
    return taken.where(times > 0).select(key, "domain", "lang", "source", F.explode(F.sequence(F.lit(0), times - 1)).alias("epoch"), "n_tokens")


def shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """What each source was to have and has."""
    have = mixture.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_records"), (F.max("epoch") + 1).alias("n_epochs"))
    wanted = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    out = wanted.join(have, "source", "left").fillna(0, ["n_tokens", "n_records", "n_epochs"])
    whole = Window.partitionBy(F.lit(1))  # over the few rows of the report
    return out.withColumn("share", F.col("n_tokens") / F.greatest(F.sum("n_tokens").over(whole), F.lit(1)))

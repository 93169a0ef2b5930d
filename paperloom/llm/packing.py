"""Items of varying length in containers of fixed capacity.

Lengths are counted in a histogram, which is as small as a container is large.
On it the configuration linear program (how often to fill a container in which
way) is solved by multiplicative weights: each round prices the lengths by how
far they are covered, finds the best filling by dynamic programming over the
knapsack, and adds a little of it. The solution is rounded down to whole
containers, and what is left goes, longest first, into the fullest containers it
fits, by runs of containers with equal room, so the plan for k times as many
items of each length is about k times the plan. Only then are items given places: an item
of the k-th in its length takes the k-th place for that length, so no task
holds more than a share of the items of one length.

Texts longer than a container are cut into full pieces and a rest; no other
text is split. Capacities up to ``LEVELS`` are planned on exact lengths; beyond,
lengths are rounded up to so many steps of the capacity, so a container never
overflows and a step an item at most stays empty.

Defined results: texts of no tokens (null or empty ones too) have one piece of
length 0 in container 0; equal lengths are placed by key; repeated keys are
items of their own, told apart by their order; capacities that are null or
below one are left out; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.session import settle

#: Steps of a capacity that lengths are rounded up to while planning.
LEVELS = 2048
#: Rounds of multiplicative weights.
ROUNDS = 260
#: Every so many rounds all lengths are priced, which bounds the optimum; in between, of more than
#: ``ALL`` lengths, only so many as are dearest for their size.
EXACT, DEAR, ALL = 20, 240, 600
#: Items of one length ranked by one task, about.
BUCKET = 200_000


def level(size: int, capacity: int) -> int:
    """Length in steps, rounded up."""
    steps = min(LEVELS, capacity)
    return -(-size * steps // capacity)


def knapsack(sizes: np.ndarray, values: np.ndarray, most: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable filling: how often each length is taken, at most ``most`` times."""
    parts: list[tuple[int, int]] = []  # length index, times
    for i, (s, m) in enumerate(zip(sizes, most)):
        left, times = int(min(m, room // s)), 1
        while left > 0 and values[i] > 0:
            parts.append((i, min(times, left)))
            left -= times
            times *= 2
    best = np.zeros(room + 1)
    taken = np.zeros((len(parts), room + 1), dtype=bool)
    for k, (i, times) in enumerate(parts):
        weight = int(sizes[i]) * times
        if weight > room:
            continue
        other = best[: room + 1 - weight] + values[i] * times
        better = other > best[weight:] + 1e-15
        taken[k, weight:] = better
        best[weight:] = np.where(better, other, best[weight:])
    counts, at = np.zeros(len(sizes), dtype=np.int64), room
    for k in range(len(parts) - 1, -1, -1):
        if taken[k, at]:
            i, times = parts[k]
            counts[i] += times
            at -= int(sizes[i]) * times
    return float(best[room]), counts


def solve(demand: dict[int, int], room: int, rounds: int = ROUNDS, step: float = 0.2) -> tuple[list[tuple[np.ndarray, float]], np.ndarray, float]:
    """The configuration LP: fillings with how often each is used, the lengths
    they count, and a lower bound on the number of containers from the best prices."""
    sizes = np.array(sorted(s for s in demand if s > 0), dtype=np.int64)
    need = np.array([demand[int(s)] for s in sizes], dtype=float)
    if not len(sizes):
        return [], sizes, 0.0
    covered, used, bound = np.zeros(len(sizes)), {}, 0.0
    rate = np.log(len(sizes) + 1) / step
    for turn in range(rounds):
        share = covered / need
        prices = np.exp(-rate * np.minimum(share - share.min(), 60.0 / rate)) / need
        dear = np.arange(len(sizes))
        if turn % EXACT and len(sizes) > ALL:
            dear = np.sort(np.argpartition(-prices / sizes, DEAR)[:DEAR])
        value, some = knapsack(sizes[dear], prices[dear], need[dear], room)
        counts = np.zeros(len(sizes), dtype=np.int64)
        counts[dear] = some
        if len(dear) == len(sizes):
            bound = max(bound, float((prices * need).sum()) / value)
        picked = counts > 0
        amount = step * float((need[picked] / counts[picked]).min())
        key = counts.tobytes()
        used[key] = used.get(key, 0.0) + amount
        covered += amount * counts
        if share.min() >= 1.0:
            break
    # scaled to cover what most lengths need, then never above need in rounding
    scale = 1.0 / max(1e-9, float(np.average(covered / need, weights=need * sizes)))
    return [(np.frombuffer(k, dtype=np.int64), x * scale) for k, x in used.items()], sizes, bound


@dataclass
class Plan:
    """Places for items: runs of ranks of a length, each with a first container
    and how many of the length go into one."""

    containers: int = 0
    bound: float = 0.0
    #: length (in steps): starts, containers, items a container
    runs: dict = field(default_factory=dict)

    def add(self, size: int, start: int, container: int, each: int) -> None:
        self.runs.setdefault(size, []).append((start, container, each))


def plan(demand: dict[int, int], room: int) -> Plan:
    """Where each item of a length goes, from the histogram of lengths."""
    out = Plan()
    fillings, sizes, out.bound = solve(demand, room)
    left = Counter({int(s): int(demand[int(s)]) for s in sizes})
    given: Counter = Counter()
    free: list[tuple[int, int, int]] = []  # room left, first container, how many
    for counts, x in sorted(fillings, key=lambda f: (-f[1], f[0].tobytes())):
        parts = [(int(sizes[i]), int(counts[i])) for i in np.nonzero(counts)[0]]
        copies = min([int(x), *(left[s] // c for s, c in parts)])
        if copies <= 0:
            continue
        for s, c in parts:
            out.add(s, given[s], out.containers, c)
            given[s] += copies * c
            left[s] -= copies * c
        rest = room - sum(s * c for s, c in parts)
        if rest > 0:
            insort(free, (rest, out.containers, copies))
        out.containers += copies

    def put(s: int, container: int, each: int, copies: int) -> None:
        out.add(s, given[s], container, each)
        given[s] += copies * each
        left[s] -= copies * each

    for s in sorted(left, reverse=True):
        while left[s] > 0 and (k := bisect_left(free, (s, -1, -1))) < len(free):
            rest, container, copies = free.pop(k)
            each = min(rest // s, left[s])
            used = min(copies, left[s] // each)
            put(s, container, each, used)
            if used < copies:
                insort(free, (rest, container + used, copies - used))
            if rest > each * s:
                insort(free, (rest - each * s, container, used))
        while left[s] > 0:
            each = min(room // s, left[s])
            copies = left[s] // each
            put(s, out.containers, each, copies)
            if room > each * s:
                insort(free, (room - each * s, out.containers, copies))
            out.containers += copies
    for s in out.runs:
        out.runs[s].sort()
    return out


def pieces(sized: DataFrame, kinds: list[tuple[str, int]], key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """Each piece to be placed: kind, key, piece, its first token and length."""
    rows = []
    for kind, capacity in kinds:
        n = F.greatest(F.ceil(F.col(size) / capacity).cast("long"), F.lit(1).cast("long"))
        part = F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("piece_no")
        rows.append(sized.select(F.lit(kind).alias("container_kind"), F.lit(capacity).cast("long").alias("_c"), F.col(key), F.col(size).cast("long").alias("_n"), part))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    first = F.col("piece_no") * F.col("_c")
    return out.select("container_kind", "_c", key, "piece_no", first.alias("first_token"), F.least(F.col("_c"), F.greatest(F.col("_n") - first, F.lit(0).cast("long"))).alias("n_tokens"))


def packed(sized: DataFrame, containers: DataFrame, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """``container_kind, container_no, <key>, piece_no, first_token, n_tokens``
    for containers ``container_kind, capacity_tokens`` (a fixed table)."""
    spark = sized.sparkSession
    kinds = sorted((r.container_kind, int(r.capacity_tokens)) for r in containers.where("container_kind is not null and capacity_tokens >= 1").distinct().collect())
    schema = f"container_kind string, container_no long, {key} {dict(sized.dtypes)[key]}, piece_no long, first_token long, n_tokens long"
    if not kinds:
        return spark.createDataFrame([], schema)
    sized = settle(sized.select(key, size), "sizes")
    items = pieces(sized, kinds, key, size)
    steps = F.least(F.lit(LEVELS).cast("long"), F.col("_c"))
    items = items.withColumn("level", F.ceil(F.col("n_tokens") * steps / F.col("_c")).cast("long"))
    buckets = max(1, sized.count() // BUCKET)
    items = items.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)))
    # the histogram: at most LEVELS + 1 rows of a kind and bucket
    counts = items.groupBy("container_kind", "level", "bucket").agg(F.count("*").alias("n"))
    counts = settle(counts, "lengths")
    demand: dict = {}
    for r in counts.groupBy("container_kind", "level").agg(F.sum("n").alias("n")).collect():
        demand.setdefault(r.container_kind, {})[int(r.level)] = int(r.n)
    plans = {kind: plan({s: n for s, n in demand.get(kind, {}).items() if s > 0}, min(LEVELS, capacity)) for kind, capacity in kinds}
    # ranks: within a bucket by key, after the buckets before it
    before = Window.partitionBy("container_kind", "level").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("container_kind", "level", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("container_kind", "level", "bucket").orderBy(key, "piece_no")
    ranked = items.withColumn("own", F.row_number().over(within) - 1).join(starts, ["container_kind", "level", "bucket"])
    ranked = ranked.select("container_kind", "level", (F.col("before") + F.col("own")).alias("rank"), key, "piece_no", "first_token", "n_tokens")
    tables = {
        kind: {s: tuple(np.array(column, dtype=np.int64) for column in zip(*runs)) for s, runs in p.runs.items()} for kind, p in plans.items()
    }
    shared = spark.sparkContext.broadcast(tables)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places = shared.value
        for b in batches:
            number = np.zeros(len(b), dtype=np.int64)
            for (kind, s), rows in b.groupby(["container_kind", "level"], sort=False).indices.items():
                if s > 0:
                    start, container, each = places[kind][int(s)]
                    rank = b["rank"].to_numpy()[rows]
                    run = np.searchsorted(start, rank, side="right") - 1
                    number[rows] = container[run] + (rank - start[run]) // each[run]
            yield b.assign(container_no=number)[["container_kind", "container_no", key, "piece_no", "first_token", "n_tokens"]]

    return ranked.mapInPandas(place, schema)


def filled(rows: DataFrame, containers: DataFrame) -> DataFrame:
    """How full the containers of each kind are, and the fewest there could be by size alone."""
    each = rows.groupBy("container_kind", "container_no").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("k"))
    kinds = containers.groupBy("container_kind").agg(F.max("capacity_tokens").alias("capacity_tokens"))
    total = each.groupBy("container_kind").agg(F.count("*").alias("n_containers"), F.sum("t").alias("n_tokens"), F.sum("k").alias("n_pieces"), F.max("t").alias("fullest"))
    out = total.join(kinds, "container_kind")
    return out.withColumns({"fill_share": F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), "least_containers": F.ceil(F.col("n_tokens") / F.col("capacity_tokens"))})

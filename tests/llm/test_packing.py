from collections import Counter, defaultdict
from itertools import combinations_with_replacement

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.llm import packing as p


def fill(demand, plan):
    """Contents of the containers of a plan."""
    out = defaultdict(Counter)
    for s, n in demand.items():
        runs = plan.runs.get(s, [])
        for rank in range(n):
            start, container, each = [r for r in runs if r[0] <= rank][-1]
            out[container + (rank - start) // each][s] += 1
    return out


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=12), st.integers(40, 64))
def test_every_item_has_a_place_and_no_container_overflows(demand, room):
    plan = p.plan(demand, room)
    out = fill(demand, plan)
    assert sum((c for c in out.values()), Counter()) == Counter(demand)
    assert all(sum(s * k for s, k in c.items()) <= room for c in out.values())
    assert len(out) == plan.containers >= -(-sum(s * n for s, n in demand.items()) // room)
    assert plan.bound <= plan.containers + 1e-6


@pytest.mark.parametrize("room,sizes", [(10, [3, 4, 7]), (12, [5, 5, 2, 1]), (9, [9]), (7, [8])])
def test_knapsack_against_brute_force(room, sizes):
    values = np.array([s**1.1 for s in sizes])
    best = max(sum(values[i] for i in pick) for k in range(0, room + 1) for pick in combinations_with_replacement(range(len(sizes)), k) if sum(sizes[i] for i in pick) <= room and all(c <= 2 for c in Counter(pick).values()))
    value, counts = p.knapsack(np.array(sizes), values, np.full(len(sizes), 2), room)
    assert value == pytest.approx(best) and int((counts * np.array(sizes)).sum()) <= room


def test_little_room_is_unused():
    rng = np.random.default_rng(1)
    demand = Counter(int(x) for x in np.clip(rng.lognormal(4.2, 1.0, 40_000), 1, 512))
    plan = p.plan(dict(demand), 512)
    assert sum(s * n for s, n in demand.items()) / 512 / plan.containers > 0.985


def test_table(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(x), "clash") for i, x in enumerate([*rng.integers(1, 300, 400), 0, 100, 101, 1000, 2500])] + [(3, 50, ""), (None, 7, "")]
    sized = spark.createDataFrame(rows, "doc_id long, n_tokens int, level string")
    kinds = spark.createDataFrame([("small", 100), ("big", 777), (None, 5), ("bad", 0)], "container_kind string, capacity_tokens long")
    got = p.packed(sized, kinds).collect()
    for kind, capacity in (("small", 100), ("big", 777)):
        own = [r for r in got if r.container_kind == kind]
        load, parts = Counter(), defaultdict(list)
        for r in own:
            load[r.container_no] += r.n_tokens
            parts[r.doc_id].append((r.first_token, r.n_tokens))
        assert max(load.values()) <= capacity
        for i, n, _ in rows:
            if i != 3:
                assert sum(x for _, x in parts[i]) == n and (n <= capacity) == (len(parts[i]) == 1)
        assert sorted(n for _, n in parts[3]) and sum(n for _, n in parts[3]) == rows[3][1] + 50
    assert {r.container_kind for r in got} == {"small", "big"}
    assert p.packed(sized.limit(0), kinds).count() == 0 == p.packed(sized, kinds.limit(0)).count()


def test_ranks_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(p, "BUCKET", 50)
    sized = spark.createDataFrame([(i, 30) for i in range(500)], "doc_id long, n_tokens int")
    kinds = spark.createDataFrame([("k", 100)], "container_kind string, capacity_tokens long")
    load = Counter(r.container_no for r in p.packed(sized, kinds).collect())
    assert sum(load.values()) == 500 and max(load.values()) == 3 and len(load) == 167


@pytest.mark.parametrize("k", [1, 10, 100])
def test_plans_grow_with_the_items(k):
    demand = {400: 6000 * k, 112: 2000 * k, 50: 4000 * k, 3: 3000 * k}
    plan = p.plan(demand, 512)
    assert plan.containers == 6000 * k
    check(plan, demand, 512)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), min_size=1, max_size=12))
def test_every_item_has_a_place(demand):
    check(p.plan(demand, 64), demand, 64)


def check(plan, demand, room):
    """All ranks of all lengths have a container, and none holds more than its room."""
    filled = np.zeros(plan.containers, dtype=np.int64)
    for s, n in demand.items():
        start, container, each = (np.array(x) for x in zip(*plan.runs[s]))
        rank = np.arange(n)
        run = np.searchsorted(start, rank, side="right") - 1
        np.add.at(filled, container[run] + (rank - start[run]) // each[run], s)
    assert filled.max() <= room and filled.min() > 0

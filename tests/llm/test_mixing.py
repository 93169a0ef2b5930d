from collections import Counter

import pytest

from paperloom.llm import mixing as m


def test_shortages_go_to_siblings():
    assert m.shared_out(100, [(1, 1000), (1, 1000)]) == [50, 50]
    assert m.shared_out(100, [(1, 10), (1, 1000), (2, 1000)]) == pytest.approx([10, 30, 60])
    assert m.shared_out(100, [(1, 10), (1, 20)]) == [10, 20]
    assert m.shared_out(100, [(0, 10), (1, 200)]) == [0, 100]
    assert m.shared_out(100, []) == []


def test_siblings_before_ancestors():
    leaves = [("a", "en", 10.0), ("b", "en", 1000.0), ("c", "en", 1000.0)]
    root = m.tree(leaves, {"a": (0.4, 1), "b": (0.2, 1), "c": (0.4, 1)}, {"a": "x", "b": "x", "c": "y"})
    m.budgeted(root, 1000.0)
    got = {s: b for _, _, s, b in m.leaf_budgets(root)}
    # what a can't use goes to b of its domain, not to c
    assert got == pytest.approx({"a": 10, "b": 590, "c": 400})


def rows(spark, items):
    return spark.createDataFrame(items, "doc_id long, source string, lang string, n_tokens int, domain string")


TARGETS = [("a", 0.5, 2), ("b", 0.3, 3), ("c", 0.2, 4), ("none", 0.0, 1), (None, 0.5, 1)]


def targets(spark):
    return spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")


def test_mixture(spark):
    items = [(i, "a", ["en", "EN", None, "zh"][i % 4], 10 + i % 7, "clash") for i in range(3000)]
    items += [(10_000 + i, "b", "en", 12, "") for i in range(400)] + [(20_000 + i, "c", "fr", 9, "") for i in range(50)]
    items += [(30_000, None, "en", 100, ""), (30_001, "other", "en", 100, ""), (30_002, "a", "en", 0, ""), (30_003, "b", "en", None, "")]
    got = m.mixed(rows(spark, items), targets(spark)).collect()
    assert {r.source for r in got} == {"a", "b", "c"}
    uses = Counter((r.doc_id, r.source) for r in got)
    assert all(n <= {"a": 2, "b": 3, "c": 4}[s] for (_, s), n in uses.items())
    assert len({(r.doc_id, r.epoch) for r in got}) == len(got)
    tokens = Counter()
    for r in got:
        tokens[r.source] += r.n_tokens
    total = sum(n for _, s, _, n, _ in items if s in ("a", "b", "c") and n)
    assert tokens["c"] == 50 * 9 * 4  # all it has, as often as allowed
    assert abs(sum(tokens.values()) - total) < 100
    again = m.mixed(rows(spark, items), targets(spark)).collect()
    assert sorted(again) == sorted(got)
    report = {r.source: r for r in m.shares(m.mixed(rows(spark, items), targets(spark)), targets(spark)).collect()}
    assert report["c"].n_tokens == 1800 and sum(r.share for r in report.values() if r.source) == pytest.approx(1)


def test_shares_are_met_where_they_can_be(spark):
    items = [(i, "abc"[i % 3], "en", 20, "") for i in range(3000)]
    got = m.mixed(rows(spark, items), targets(spark), total=30_000)
    report = {r.source: r.share for r in m.shares(got, targets(spark)).collect()}
    assert report["a"] == pytest.approx(0.5, abs=0.002) and report["b"] == pytest.approx(0.3, abs=0.002) and report["c"] == pytest.approx(0.2, abs=0.002)


def test_empty(spark):
    assert m.mixed(rows(spark, []), targets(spark)).count() == 0
    assert m.mixed(rows(spark, [(1, "a", "en", 5, "")]), targets(spark).limit(0)).count() == 0

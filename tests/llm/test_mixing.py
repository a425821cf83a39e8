import re
from collections import defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F
from quarrystone.llm import mixing


def brute_targets(sizes, weights, total, most):
    """Water-filling by bisection on the common level."""
    low, high = 0.0, 1e12
    for _ in range(200):
        mid = (low + high) / 2
        if sum(min(w * mid, most * s) for w, s in zip(weights, sizes, strict=True)) < total:
            low = mid
        else:
            high = mid
    return [min(w * high, most * s) for w, s in zip(weights, sizes, strict=True)]


def test_targets():
    for sizes in ([100, 50, 20, 1], [10, 10, 10], [5, 1000], [0, 7, 9], [0, 0]):
        w = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
        got = mixing.targets(sizes, w, 1.5 * sum(sizes))
        assert got == pytest.approx(brute_targets(sizes, w, 1.5 * sum(sizes), 2.0), rel=1e-6, abs=1e-6)


def test_flow_is_cheapest_by_brute_force():
    patterns, quotas = {("a",): 2, ("b",): 1, ("a", "b"): 2}, {"a": 4, "b": 3}
    got = mixing.min_cost_flow(patterns, quotas)
    cost = lambda n, size: max(0, n - size)
    best = None
    for a, b, x, y in product(range(5), range(3), range(5), range(5)):
        if x + y <= 4 and a + x <= 4 and b + y <= 3:
            key = (-(a + b + x + y), cost(a, 2) + cost(b, 1) + cost(x + y, 2))
            best = min(best, key) if best else key
    taken = {p: sum(v.values()) for p, v in got.items()}
    assert (-sum(taken.values()), sum(cost(taken[p], n) for p, n in patterns.items())) == best
    for s in quotas:
        assert sum(v.get(s, 0) for v in got.values()) <= quotas[s]


def test_report(awkward, nothing):
    rows = {(r.doc_id, r.text): r for r in awkward.collect()}
    got = mixing.mix(awkward)
    assert got.columns == [*awkward.columns, "size", "source_size", "target", "taken"]
    got = got.collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(awkward).collect()))
    assert len(got) == awkward.count()
    size, taken, target, largest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in got:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        assert r.size == n and r.taken in (0, n, 2 * n) and rows[r.doc_id, r.text].source == r.source
        size[r.source] += n
        taken[r.source] += r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], n)
    names = sorted(size, key=lambda s: (s is None, s or ""))
    want = brute_targets([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5 * sum(size.values()), 2.0)
    assert [target[s] for s in names] == pytest.approx(want)
    for s in names:
        assert abs(taken[s] - target[s]) <= largest[s]
    assert all(r.source_size == size[r.source] for r in got)
    assert mixing.mix(nothing).collect() == []


def test_overlapping_sources(awkward):
    got = mixing.mix(awkward.where("coalesce(length(text), 0) < 5000"), F.array("source", F.coalesce("lang", F.lit("en"))), share=0.5).collect()
    assert all(r.taken in (0, r.size, 2 * r.size) for r in got)
    assert 0.4 < sum(r.taken for r in got) / sum(r.size for r in got) < 0.6

import math
import random

import numpy as np
import pytest
from quarrystone.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score string, no int"


def brute(rows):
    e = []
    for i, v, label, *_ in rows:
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            e.append((i, [math.floor(256 * float(np.float32(x))) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a in e:
        if a[0] % 100:
            continue
        scored = sorted(((-dot(a[1], b[1]), b[0], b[2]) for b in e if b[0] != a[0]), key=lambda x: x[:2])
        for p in [x for x in scored if x[2] == a[2]][:5]:
            fit = [x for x in scored if x[2] != a[2] and 80 * -p[0] <= 100 * -x[0] <= 100 * -p[0]][:5]
            out += [(a[0], p[1], k, x[1], -p[0], -x[0]) for k, x in enumerate(fit, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    """Clusters, a big group of one vector, nulls, NaN, infinity, short and empty vectors, repeated rows and anchors."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 20)) * np.geomspace(1, 0.05, 20)
    out = []
    for i in range(1500):
        v = (centres[rng.integers(12)] + 0.3 * rng.normal(size=20) * np.geomspace(1, 0.05, 20)).astype(np.float32).tolist()
        out.append((i, v, int(rng.integers(10))))
    same = out[3][1]
    out += [(2000 + i, same, i % 3) for i in range(300)]
    out += [(3000, [0.0] * 20, 1), (3001, [], 1), (3002, None, 1), (3003, same, None), (None, same, 1), (3004, [float("nan")] * 20, 2), (3005, [float("inf")] + same[1:], 2)]
    out += [(3006, [None, *same[1:]], 2), (3007, same[:7], 3), (3100, same[:3], 4), out[100], out[100], out[41], (200, same, 5)]
    out = [(*r, "s", 7) for r in out]
    random.Random(2).shuffle(out)
    return out


def test_report(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute(rows)
    assert sorted(map(tuple, negatives.report(df).collect())) == want and len(want) > 300


def test_small_blocks_tiles_and_steps(spark, rows, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_BYTES", 2000)
    df = spark.createDataFrame(rows[:700], SCHEMA).repartition(2)
    assert sorted(map(tuple, negatives.report(df).collect())) == brute(rows[:700])


def test_bounds_keep_every_pair_in_range():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(-200, 200, size=(n, 70)).astype(float) * np.geomspace(1, 0.01, 70) for n in (30, 50))
    exact = a @ b.T
    low, high = np.quantile(exact, 0.9, axis=1), np.quantile(exact, 0.97, axis=1)
    steps = negatives._steps(70)
    i, j = negatives._survivors(a, b, negatives._rests(a, steps), negatives._rests(b, steps), steps, np.ones((30, 50), bool), low, high)
    kept = set(zip(i.tolist(), j.tolist(), strict=True))
    want = {(x, y) for x in range(30) for y in range(50) if low[x] <= exact[x, y] <= high[x]}
    assert want <= kept and len(kept) < 600


def test_the_rotation_keeps_products_and_leads_with_the_largest(spark, rows):
    df = negatives.eligible(spark.createDataFrame(rows, SCHEMA))
    space = negatives.fit(df)
    assert np.allclose(space.rotation @ space.rotation.T, np.eye(20), atol=1e-12)
    x = np.array([np.floor(256 * np.array(r.embedding)) for r in df.where("size(embedding) = 20").collect()]) @ space.rotation
    power = (x * x).sum(axis=0)
    assert (np.diff(power) < 1e-6 * power[0]).all()


def test_nothing(spark):
    assert negatives.report(spark.createDataFrame([], SCHEMA)).collect() == []
    assert negatives.report(spark.createDataFrame([(1, [1.0], 1, "", 1), (2, [1.0], 2, "", 1)], SCHEMA)).collect() == []
    assert negatives.report(spark.createDataFrame([(100, [], 1, "", 1)], SCHEMA)).collect() == []


def test_too_long_vectors_are_refused(spark):
    with pytest.raises(Exception, match="too l"):
        negatives.report(spark.createDataFrame([(100, [1e30], 1, "", 1)], SCHEMA)).collect()

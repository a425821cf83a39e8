import hashlib
import random

import numpy as np
import pytest
from quarrystone.llm import fingerprint as fp


@pytest.mark.parametrize("partitions", [1, 7])
def test_report(spark, awkward, nothing, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    got = fp.report(awkward).collect()
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(got) == len(rows)
    ids = [d for d, _ in rows]
    unique = {d: t or "" for d, t in rows if ids.count(d) == 1}
    by = {r.doc_id: r for r in got}
    ordered = sorted(set(ids), key=lambda d: (d is not None, d))
    for i, d in enumerate(ordered):
        following = ordered[(i + 1) % len(ordered)]
        if d not in unique or following not in unique:
            continue
        t, x, r = unique[d], unique[following], by[d]
        k = len(t) // 4
        e = t[: len(t) - k] + x[:k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        a, b, c = (set(map(int, fp.text_digests(s.encode()))) for s in (t, e, x))
        exact = lambda p, q: 1 - len(p ^ q) / (len(p) + len(q)) if p or q else 1.0
        assert abs(r.near_edited - exact(a, b)) < 1e-9 and abs(r.near_next - exact(a, c)) < 1e-9
    prints = {}
    for d, t in rows:
        if ids.count(d) == 1:
            assert prints.setdefault(t or "", by[d].fingerprint) == by[d].fingerprint
    assert len(set(prints.values())) == len(prints) - sum(not s.strip("\n") and s != "" for s in prints)
    assert fp.report(nothing).collect() == []


def test_peeling_recovers_the_difference():
    rng = random.Random(1)
    draw = lambda n: [rng.getrandbits(64) for _ in range(n)]
    cases = [(draw(c), draw(x), draw(y)) for c, x, y in ((0, 0, 0), (500, 3, 4), (50, 0, 9), (10, 200, 300), (0, 1, 0), (0, 900, 0))]
    as_set = lambda x: np.array(x, np.uint64)
    for (_, x, y), got in zip(cases, fp.differing([as_set(c + x) for c, x, _ in cases], [as_set(c + y) for c, _, y in cases]), strict=True):
        assert (set(map(int, got[0])), set(map(int, got[1]))) == (set(x), set(y))


def test_paragraphs_before_an_edit_stay():
    t = b"abc " * 100 + b"\n\nx " + b"some words " * 40
    at = fp.ends(t)
    assert at[-1] == len(t) and at == sorted(set(at))
    for k in range(0, len(t), 7):
        e = t[:k] + b"other"
        keep = [a for a in at if a < k]
        assert fp.ends(e)[: len(keep)] == keep and keep + fp.ends(e, keep[-1] if keep else 0) == fp.ends(e)

import hashlib
import random

import numpy as np
import pytest
from quarrystone.llm import suffix


def brute(rows, k=100):
    """Over rows (doc_id, text): the rule as it is stated."""
    first = {}
    data = [(d if d is not None else suffix._NULL, (t or "").encode()) for d, t in rows]
    for d, t in data:
        for i in range(len(t) - k + 1):
            w = t[i : i + k]
            first[w] = min(first.get(w, (d, i)), (d, i))
    out = []
    for (d, _), (e, t) in zip(rows, data, strict=True):
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - k + 1):
            if first[t[i : i + k]] < (e, i):
                gone[i : i + k] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((d if d is not None else -1, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def rows_of(df):
    return sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in df.collect())


def test_report(awkward):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    got = rows_of(suffix.report(awkward))
    assert got == brute(rows)
    assert sum(r[2] > 0 for r in got) > 15 and any(r[3] > 1 for r in got)


@pytest.mark.parametrize("hot", [5000, 3])
def test_small_alphabets(spark, hot):
    """Periodic and highly repetitive texts, in tiny chunks, with and without splitting of hot anchors."""
    rng = random.Random(hot)
    piece = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 60))) for _ in range(12)]
    texts = ["".join(rng.choice(piece) for _ in range(rng.randint(0, 25))) for _ in range(60)]
    texts += ["and " * 60, "and " * 60 + "x", "é" * 130, "ab" * 90, "z" * 99, "z" * 100, "z" * 101, "", None] + texts[:5]
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).checkpoint()
    assert rows_of(suffix.report(df, chunk_bytes=3000, hot=hot)) == brute(rows)
    assert rows_of(suffix.report(df, 10, chunk_bytes=3000, hot=hot)) == brute(rows, 10)


def test_remove(awkward, nothing):
    out = suffix.remove(awkward)
    assert out.columns == awkward.columns and out.count() == awkward.count()
    assert suffix.report(nothing).collect() == []

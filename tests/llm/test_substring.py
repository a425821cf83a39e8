import hashlib
import re
from collections import Counter

from quarrystone.llm import substring


def brute(rows, k=35):
    split = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    seen = Counter(tuple(w[i : i + k]) for w in split for i in range(len(w) - k + 1))
    out = []
    for (d, _), w in zip(rows, split, strict=True):
        gone = {j for i in range(len(w) - k + 1) if seen[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((d if d is not None else -1, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def rows_of(df):
    return sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in df.collect())


def test_report(awkward):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    got = rows_of(substring.report(awkward))
    assert got == brute(rows)
    assert sum(r[2] > 0 for r in got) > 20 and any(0 < r[2] < r[1] for r in got)


def test_short_windows_in_tiny_chunks(awkward):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert rows_of(substring.report(awkward, 3, chunk_bytes=500)) == brute(rows, 3)


def test_remove(awkward, nothing):
    out = substring.remove(awkward)
    assert out.columns == awkward.columns and out.count() == awkward.count()
    assert substring.report(nothing).collect() == []

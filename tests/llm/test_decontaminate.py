import hashlib
import re

import pytest
from quarrystone.llm import decontaminate
from quarrystone.llm.common import cut

SPLIT = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return SPLIT.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()))


def brute(rows, items, n=10):
    windows = {}
    for item, text in items:
        w = words(text)
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(str(item))
    out = []
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if s := windows.get(tuple(w[i : i + k])):
                    hit |= set(range(i, i + k))
                    found |= s
        out.append((d if d is not None else -1, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.fixture(scope="module")
def benchmark(spark, awkward):
    t = [r.text for r in awkward.where("length(text) > 300").orderBy("doc_id").limit(6).collect()]
    items = [(1, t[0][10:200]), (20, t[1].upper()), (3, "One, two"), (4, None), (5, "..."), (6, t[2][:40]), (7, t[0][10:200]), (8, "zzz")]
    return cut(spark.createDataFrame(items, "item_id long, text string"))


@pytest.mark.parametrize("block", [1 << 24, 400])
def test_report(awkward, benchmark, block, monkeypatch):
    monkeypatch.setattr(decontaminate.scan, "__defaults__", (10, block))
    rows, items = [(r.doc_id, r.text) for r in awkward.collect()], [tuple(r) for r in benchmark.collect()]
    got = sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in decontaminate.report(awkward, benchmark).collect())
    assert got == brute(rows, items)
    assert sum(x[-1] for x in got) > 5


def test_removal(awkward, benchmark, nothing):
    hit = {(r.doc_id, r.n_words) for r in decontaminate.report(awkward, benchmark).where("contaminated").collect()}
    left = decontaminate.remove_documents(awkward, benchmark)
    assert left.columns == awkward.columns
    assert left.count() == awkward.count() - decontaminate.report(awkward, benchmark).where("contaminated").count()
    spans = cut(decontaminate.remove_spans(awkward, benchmark))
    assert spans.columns == awkward.columns and spans.count() == awkward.count() and hit
    assert spans.where("text like '%zzz%'").count() == 0
    assert decontaminate.report(nothing, benchmark).collect() == []
    assert decontaminate.report(awkward, benchmark.where("false")).where("contaminated").count() == 0

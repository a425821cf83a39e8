import corpus_pipeline
import pytest
from quarrystone.llm import mixing, pii
from quarrystone.llm.common import cut

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(cut(stage(spark, out[-1], DATA)))
    return out


def test_stages(steps):
    docs, quality, dedup, clean, private, mixed = steps
    for x in steps[:-1]:
        assert x.columns == docs.columns
    assert mixed.columns == [*docs.columns, "size", "source_size", "target", "taken"]
    n = [x.count() for x in steps]
    assert n[0] > n[1] > n[2] >= n[3] == n[4] == n[5] > 0.6 * n[0]
    assert dedup.select("text").distinct().count() == n[2]
    before = {r.doc_id: r.text for r in clean.collect()}
    for r in private.collect():
        old = [x for _, _, _, x in pii.find(before[r.doc_id])]
        assert r.n_chars == len(r.text) and not any(x in r.text for x in old)
        assert old or r.text == before[r.doc_id]
    got = {r.doc_id: (r["size"], r.source_size, r.taken) for r in mixed.collect()}
    assert got == {r.doc_id: (r["size"], r.source_size, r.taken) for r in mixing.report(private).collect()}


def test_run(spark, steps):
    got = corpus_pipeline.run(spark, DATA)
    assert sorted(map(str, got.collect())) == sorted(map(str, steps[-1].collect()))

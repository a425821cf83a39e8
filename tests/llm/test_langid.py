import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from quarrystone.llm import langid

DATA = "/root/testdata/sf0.01"


def runs(text):
    """Counts of hashed runs, letter by letter."""
    out = [" "]
    for c in text:
        kind = unicodedata.category(c)[0]
        c = (c.lower() if len(c.lower()) == 1 else c) if kind == "L" else c if kind == "M" else " "
        if c != " " or out[-1] != " ":
            out.append(c)
    if out[-1] != " ":
        out.append(" ")
    found = Counter()
    for n in range(1, 5):
        for i in range(len(out) - n + 1):
            h = 0
            for c in out[i : i + n]:
                h = (h * 0x100000001B3 + (0 if c == " " else ord(c))) % 2**64
            found[((h + n) * 0x9E3779B97F4A7C15 % 2**64 >> 40) % langid.WIDTH] += 1
    return np.array([found[i] for i in range(langid.WIDTH)], dtype=float)


@pytest.mark.parametrize("text", ["a", "Hello, World", " x1y  z", "Ünï ßtraße İI", "नमस्ते दुनिया", "😀 end 😀", "Der Hund. " * 40])
def test_vectors(text):
    x, has = langid.vectors([text])
    want = np.sqrt(runs(text) / runs(text).sum())
    assert has[0] and np.allclose(x[0], want, atol=1e-6) and abs(np.linalg.norm(x[0]) - 1) < 1e-5


def test_a_long_text_in_parts(monkeypatch):
    text = "Ein  Satz, ünd noch 12 einer.\n" * 30
    whole = langid._counts(text)
    for room in (1, 2, 3, 7, 64):
        monkeypatch.setattr(langid, "ROOM", room)
        got = langid._counts(text)
        assert got[1] == whole[1] and (got[0] == whole[0]).all()
    assert (whole[0] == runs(text)).all()


def test_the_machine_separates_and_has_the_least_cost():
    rng = np.random.default_rng(0)
    x = np.concatenate((rng.normal(1, 1, size=(40, 5)), rng.normal(-1, 1, size=(40, 5))))
    y = np.repeat([1.0, -1.0], 40)
    w = langid.svm(x, y, cost=1.0, rounds=2000)
    full = np.concatenate((x, np.ones((80, 1))), axis=1)
    cost = lambda w: w @ w / 2 + (np.maximum(0, 1 - y * (full @ w)) ** 2).sum()
    best = cost(w.astype(float))
    assert all(cost(w + 0.02 * rng.normal(size=6)) > best - 1e-3 for _ in range(200)) and ((full @ w) * y > 0).mean() > 0.95


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id: r for r in langid.report(docs).collect()}
    rows = docs.select("doc_id", "lang", "text").collect()
    assert len(got) == len(rows) and all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= got[r.doc_id].score <= 1 for r in rows)
    held = [r for r in rows if got[r.doc_id].held_out]
    right = sum(got[r.doc_id].lang_pred == r.lang for r in held) / len(held)
    assert len(held) > 200 and right >= 0.98


def test_languages_are_not_seen_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(300).checkpoint()
    wrong = docs.withColumn("lang", F.when(langid.held_out(), F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("other"))
    assert sorted(map(tuple, langid.report(wrong).collect())) == sorted(map(tuple, langid.report(docs).collect()))


def test_families_first(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("der hund und die katze", "de"), ("the dog and the cat", "en"), ("le chien et le chat", "fr"), ("perro gato casa", "qq")] * 6)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.families.names == ["germanic", "qq", "romance"] and model.languages["germanic"].names == ["de", "en"]
    found, score = model.predict(["die katze", "the cat", "le chat", "gato", None, "123", ""])
    assert found == ["de", "en", "fr", "qq", "und", "und", "und"] and (score[:4] > 0.4).all() and (score[4:] == 0).all()


def test_awkward_rows(awkward, nothing, spark):
    got = langid.report(awkward).collect()
    rows = awkward.collect()
    assert len(got) == len(rows) and Counter(r.doc_id for r in got) == Counter(r.doc_id for r in rows)
    text = {r.doc_id: r.text for r in rows if r.doc_id != 3}
    for r in got:
        t = text.get(r.doc_id, "t")
        assert (r.lang_pred == "und") == (t is None or not any(c.isalpha() for c in t)) and (r.lang_pred != "und" or r.score == 0)
    assert {r.held_out for r in got if r.doc_id is None} == {False}
    assert langid.report(nothing).collect() == []
    unknown = langid.report(awkward.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in unknown} == {("und", 0.0)}
    alone = langid.report(awkward.withColumn("lang", F.lit("xx"))).collect()
    assert {r.lang_pred for r in alone} == {"und", "xx"} and {r.score for r in alone} == {0.0, 1.0}

import inspect
import math
import random
import time
from collections import Counter, defaultdict

import pytest
from quarrystone.llm import quality as q
from quarrystone.llm.common import cut


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    common = ["the", "of", "and", "to", "in", "house", "river", "green", "walks", "near"]
    sentence = lambda: " ".join(rng.choice(common) if rng.random() < 0.8 else "".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(60)) + "."
    rows, labels = [], []
    for i in range(300):
        bad = i % 6 == 0
        t = " ".join(w + rng.choice(["$$$", "***"]) for w in sentence().split()) if bad else sentence()
        if i % 12 == 0:
            t = " ".join(w for w in sentence().split()[:6] for _ in range(15))
        rows.append((i, t, "en" if i % 2 else "de", "extra"))
        labels.append((i, 0 if bad else 1, 0))
    rows += [(1000, None, "en", ""), (1001, "", None, ""), (1002, " \n", "fr", ""), (1003, sentence(), "fr", ""), (1004, sentence(), None, ""), rows[1], (None, sentence(), "en", "")]
    labels += [(7777, 1, 0), (1003, None, None), (None, 1, 0)]
    return cut(spark.createDataFrame(rows, "doc_id long, text string, lang string, keep string")), cut(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def brute(train, docs, max_words):
    """The same model in plain Python."""
    count = Counter(w for t in train for w in t.encode().split())
    top = [w for w, n in sorted(((w, n) for w, n in count.items() if n > 1), key=lambda x: (-x[1], x[0]))[:max_words]]
    numbers = {w: 1 + q.REPEAT + i for i, w in enumerate(top)}
    size = 1 + q.REPEAT + len(top)

    def of(t):
        ws = (t or "").encode().split()
        return [0] + [q.REPEAT if i and ws[i - 1] == w else numbers.get(w, 1 + q.shape(w)) for i, w in enumerate(ws)]

    e = defaultdict(float)
    for k, n in Counter(1 + q.shape(w) for w in count if w not in numbers).items():
        e[k] = -math.log(1 + n)
    e[q.REPEAT] = -math.log(1 + len(count))
    pair = Counter((a, b) for t in train for x in [of(t)] for a, b in zip(x, x[1:], strict=False))

    def discounts(counts):
        n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else 0.5
        return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) if n[k - 1] else 0.5 * k for k in (1, 2, 3)]

    d = discounts(pair.values())
    after, total, seen = Counter(b for _, b in pair), Counter(), defaultdict(Counter)
    for (a, _), c in pair.items():
        total[a] += c
        seen[a][min(c, 3)] += 1
    lower = discounts(after.values())
    off = {w: lower[min(c, 3) - 1] for w, c in after.items()}
    p1 = lambda w: (after[w] - off.get(w, 0)) / len(pair) + sum(off.values()) / len(pair) / size
    gamma = lambda a: sum(d[k - 1] * m for k, m in seen[a].items()) / total[a] if total[a] else 1.0

    def logp(a, b):
        c = pair[a, b]
        return math.log((c - d[min(c, 3) - 1] if c else 0) / (total[a] or 1) + gamma(a) * p1(b)) + e[b]

    out = []
    for t in docs:
        x = of(t)
        out.append(math.exp(-sum(logp(a, b) for a, b in zip(x, x[1:], strict=False)) / (len(x) - 1)) if len(x) > 1 else None)
    return out


def test_perplexities(spark, corpus):
    docs, labels = corpus
    known = {r.doc_id: r.h for r in q.trusted(docs, labels, 11).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    train = [t for d, t in rows if d in known and known[d] % 2 == 0]
    sample = cut(spark.createDataFrame([(d,) for d, h in known.items() if h % 2 == 0], "doc_id long"))
    for max_words in (8, 1000):
        got = q.score(docs, q.train(docs, sample, max_words)).collect()
        assert len(got) == len(set(rows))
        want = dict(zip(rows, brute(train, [t for _, t in rows], max_words), strict=True))
        by_id = {d: p for (d, _), p in want.items()}
        for r in got:
            assert r.perplexity == pytest.approx(by_id[r.doc_id], rel=1e-4) if by_id[r.doc_id] else r.perplexity is None


def test_decisions(corpus):
    docs, labels = corpus
    got = q.report(docs, labels).collect()
    assert len(got) == docs.count()
    assert got[0].asDict().keys() == {"doc_id", "lang", "n_words", "perplexity", "threshold", "keep"}
    kept = {r.doc_id: r.keep for r in got}
    good = [kept[i] for i in range(300) if i % 6]
    assert sum(good) / len(good) > 0.97
    assert not any(kept[i] for i in range(0, 300, 6)) and not any(kept[i] for i in (1000, 1001, 1002)) and kept[1003] and kept[1004]
    left = q.keep(docs, labels)
    assert left.columns == docs.columns and left.count() == sum(r.keep for r in got)


def test_empty(corpus):
    docs, labels = corpus
    assert q.report(docs.where("doc_id < 0"), labels).collect() == []
    none = q.report(docs, labels.where("false")).collect()
    assert all(r.keep == (r.n_words > 0) for r in none)


def test_toxic_texts_go(spark):
    rng = random.Random(7)
    common = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(common) for _ in range(rng.randint(40, 120))]
        if i % 5 == 0:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["Vile!", "vile", "nasty,", "foul"]))
        rows.append((i, " ".join(w), "en" if i % 2 else "de"))
        if i < 400:
            labels.append((i, 1, int(i % 5 == 0)))
    docs, marks = cut(spark.createDataFrame(rows, "doc_id long, text string, lang string")), cut(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    kept = {r.doc_id for r in q.keep(docs, marks).collect()}
    assert not kept & set(range(0, 600, 5))
    assert len(kept) >= 0.95 * 480


def test_all_rows_of_the_training_half_count(spark):
    """More rows than the bound there was, the rarest word among them: words' ratios are those of a count over all."""
    from pyspark.sql import functions as F

    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("plain w"), F.col("id") % 4, F.when(F.col("id") % 2 == 1, " bad").otherwise("")).alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic"))
    h = labels.where(F.xxhash64("doc_id", F.lit(11)) % 2 == 0)
    a, b = (h.where(f"toxic = {t}").count() for t in (1, 0))
    assert min(a, b) > 8000
    default = inspect.signature(q.classify).parameters["max_train"].default
    got = q.toxic_words(docs, labels, default, 1000, 11)
    assert abs(got["bad"] - (math.log((a + 0.5) / (a + 1)) - math.log(0.5 / (b + 1)))) < 1e-9


def test_training_is_let_go_of_before_scoring(spark, corpus, monkeypatch):
    """Shuffles that the model was made by are gone when the pairs of all documents are dealt out."""
    docs, labels = corpus
    held = lambda: spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().size()
    q.release(spark)
    time.sleep(2)
    before, seen = held(), []

    def counted(docs, keyed=q.keyed):
        time.sleep(2)
        seen.append(held())
        return keyed(docs)

    model = q.train(docs, cut(q.trusted(docs, labels, 11).where("h % 2 = 0")), 1000)
    monkeypatch.setattr(q, "keyed", counted)
    assert q.score(docs, model).count() and len(seen) == 1
    assert seen[0] <= before

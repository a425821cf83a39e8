import math
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from quarrystone.llm import lm
from quarrystone.llm.common import cut


@pytest.fixture(scope="module")
def language(spark):
    """Words that follow each other in fixed pairs, so that both sides tell a token."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(x for _ in range(n) for i in [rng.randrange(30)] for x in (words[2 * i], words[2 * i + 1]))
    rows = [(i, text(120)) for i in range(300)]
    jumbled = [(1000 + i, " ".join(rng.sample(t.split(), len(t.split())))) for i, (_, t) in enumerate(rows[:20])]
    return cut(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)), cut(spark.createDataFrame([(2000 + i, text(120)) for i in range(20)] + jumbled, "doc_id long, text string"))


def test_gradients():
    rng = np.random.default_rng(0)
    numbers = np.concatenate(([0, 0], rng.integers(1, lm.SIZE, 40), [0, 0])).astype(np.int32)
    at = np.arange(2, 42)
    net = lm.Network.start(np.arange(lm.SIZE), 1)
    net.w = [w.astype(np.float64) for w in net.w]
    touched, *dense = net.gradients(numbers, at)
    g = [np.zeros_like(net.w[0]), *dense]
    for k, (rows, values) in enumerate(touched):
        g[0][k][rows] = values
    x = int(numbers[5])
    for i, where in ((0, (1, x, 3)), (1, (2,)), (2, (4, 7)), (3, (x // 64, 5, x % 64))):
        old = net.w[i][where]
        loss = []
        for e in (1e-3, -1e-3):
            net.w[i][where] = old + e
            loss.append(-net.log_p(numbers, at).mean())
        net.w[i][where] = old
        assert g[i][where] == pytest.approx((loss[0] - loss[1]) / 2e-3, abs=2e-5)


def test_sums_to_one_and_ignores_itself():
    net = lm.Network.start(np.arange(lm.SIZE), 1)
    numbers = np.array([0, 0, 5, 6, 7, 8, 0, 0], np.int32)
    total = 0.0
    for n in range(lm.SIZE):
        numbers[4] = n
        total += math.exp(net.log_p(numbers, np.array([4]))[0])
    assert total == pytest.approx(1, abs=1e-4)


def test_score_by_brute_force(awkward):
    tokens, counts = lm.vocabulary(awkward)
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert counts.sum() == sum(len((t or "").encode().split()) for _, t in rows)
    net = lm.Network.start(counts, 3)
    got = lm.score(awkward, tokens, net).collect()
    assert len(got) == len(rows)
    number = lambda w: tokens.numbers.get(w, 1 + lm.shape(w))
    by_id = {}
    for d, t in rows:
        by_id.setdefault(d, []).append(t)
    for r in got:
        if len(by_id[r.doc_id]) > 1 or r.n_tokens > 200:
            continue
        x = [0, 0, *map(number, (by_id[r.doc_id][0] or "").encode().split()), 0, 0]
        want = 0.0
        for i in range(2, len(x) - 2):
            h = np.append(np.tanh(sum(net.w[0][k][x[i + p]] for k, p in enumerate(lm.PLACES)) + net.w[1]), 1)
            for logits, j in ((h @ net.w[2], x[i] // 64), (h @ net.w[3][x[i] // 64], x[i] % 64)):
                want += logits[j] - math.log(np.exp(logits).sum())
        assert r.score == pytest.approx(want, rel=1e-4, abs=1e-3) and r.n_tokens == len(x) - 4


def test_held_out(language):
    docs, held = language
    tokens, counts = lm.vocabulary(docs)
    start = lm.Network.start(counts, 7)
    buckets = lm.numbers_of(docs, tokens, counts)
    trained = lm.train(buckets, counts, masked=0.9)
    mean = lambda net, part: np.mean([r.score / r.n_tokens for r in lm.score(held.where(part), tokens, net).collect()])
    fresh, jumbled = mean(trained, "doc_id >= 2000"), mean(trained, "doc_id < 2000")
    assert fresh > mean(start, "doc_id >= 2000") + 0.5 and fresh > jumbled + 0.5
    again = lm.train(lm.numbers_of(docs.repartition(7), tokens, counts), counts, masked=0.9)  # another layout, the same model
    assert all(np.array_equal(a, b) for a, b in zip(trained.w, again.w, strict=True))


def test_empty(nothing):
    assert lm.report(nothing).collect() == []


def test_rare_tokens_get_their_share_of_the_class(spark, monkeypatch):
    rng = random.Random(6)
    common, rare = [f"w{i}" for i in range(lm.SIZE)], ["often", "seldom"]
    texts = [" ".join(common)] * 4 + ["w1 often w2 often w3"] + ["w1 often w2"] + ["w1 seldom w2"] + [None, "", "w1 Odd! w2"]
    rng.shuffle(texts)
    df = cut(spark.createDataFrame([*enumerate(texts), (None, "w1 seldom")], "doc_id long, text string").repartition(3))
    words = lm.counted(df)
    tokens, counts = lm.vocabulary(df, words)
    assert not set(tokens.numbers) & {w.encode() for w in rare}
    net = lm.Network.start(counts, 3)
    every = [w for t in [*texts, "w1 seldom"] for w in (t or "").encode().split()]
    plain = {(r.doc_id, r.n_tokens): r.score for r in lm.score(df, tokens, net).collect()}
    blocks = lm.encoded(df, tokens, counts, 5)
    buckets = lm.numbers_of(df, tokens, counts)
    rows = buckets.collect()
    assert sum(len(r.numbers) // 2 for r in rows) == counts.sum()
    buckets = lm.packed(blocks.where(lm.F.col("kind") == lm.NUMBERS).select(lm.F.col("shard").alias("bucket"), "chunk", "row", "key", lm.F.col("a").alias("numbers")))
    got = lm.whole_score(blocks, buckets, words, tokens, counts, net, 5).collect()
    assert len(got) == len(texts) + 1
    by_id = dict([*enumerate(texts), (None, "w1 seldom")])
    for r in got:
        more = sum(math.log(every.count(w) / counts[1 + lm.shape(w)]) for w in (by_id[r.doc_id] or "").encode().split() if w not in tokens.numbers)
        assert r.score == pytest.approx(plain[r.doc_id, r.n_tokens] + more, rel=1e-5, abs=1e-4)
    monkeypatch.setattr(lm, "train", lambda *_: net)
    mean = {by_id[r.doc_id]: r.score for r in lm.report(df).collect()}
    assert mean["w1 often w2"] > mean["w1 seldom w2"] + 0.4


def test_most_frequent(spark):
    rng = random.Random(5)
    rows = [(f"w{i}".encode(), rng.choice([1, 2, 3, 5, 8, 400, 401])) for i in range(500)]
    df = cut(spark.createDataFrame(rows, "w binary, n long").repartition(5))
    for k in (1, 30, 499, 500, 900):
        assert [(bytes(r.w), r.n) for r in lm.most_frequent(df, k)] == sorted(rows, key=lambda r: (-r[1], r[0]))[:k]
    assert lm.most_frequent(df.where("n < 0"), 3) == []


def test_scores_do_not_depend_on_the_layout(spark, awkward, monkeypatch):
    monkeypatch.setattr(lm, "BUCKET", 4000)
    got = [sorted(map(str, lm.report(df).collect())) for df in (awkward, cut(awkward.repartition(9)))]
    assert got[0] == got[1] and len(got[0]) == awkward.count()


def _words(rng, n):
    return ["".join(rng.choice("abzAZ019.,;:!?-+/_éßÉλΣªǅ·🙂\x00\x1c\x85  ") for _ in range(rng.randint(1, 7))) for _ in range(n)] + [*".,;:!?", "!!!!!", "a....", "AB?!.,;:", "Ab.", "x" * 300]


@pytest.mark.parametrize("limit", [8 << 20, 7])
def test_split_and_shapes(monkeypatch, limit):
    rng = random.Random(8)
    words = _words(rng, 400)
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", "\t", "\n\n", "\x0b \x0c\r"]) for _ in range(n))
    texts = [None, "left out", "", "one", "one", " \t", *(rng.choice(["", " "]) + text(rng.randint(0, 60)).removesuffix(" ") for _ in range(80)), None, ""]
    monkeypatch.setattr(lm, "CHUNK_BYTES", limit)
    for column in (pa.array(texts)[2:], pa.array(texts)[:1], pa.array(texts, pa.string())[:0], pa.array(["", ""])):
        codes, sizes, found = lm.split(column)
        found, want = found.to_pylist(), [(t or "").encode().split() for t in column.to_pylist()]
        assert [found[c] for c in codes] == [w for ws in want for w in ws]
        assert sizes.tolist() == [len(ws) for ws in want] and len(set(found)) == len(found)
    told = pa.array([w.encode() for w in words])
    assert lm.shapes(told).tolist() == [lm.shape(w) for w in told.to_pylist()]
    assert lm.shapes(told[5:90]).tolist() == [lm.shape(w) for w in told.to_pylist()[5:90]]


def test_words_are_told_apart_without_a_step_of_python_each():
    rng = random.Random(9)
    words = [f"{rng.choice(['w', 'Very-', 'x.'])}{int(rng.paretovariate(0.4)) % 300_000}" for _ in range(400_000)]
    column = pa.array([" ".join(words[i : i + 400]) for i in range(0, len(words), 400)])
    tokens = lm.Tokens([w.encode() for w, _ in Counter(words).most_common(4000)])

    def one_by_one():
        numbers = dict(tokens.numbers)
        return [numbers.setdefault(w, len(numbers)) for t in column.cast(pa.binary()).to_pylist() for w in t.split()]

    def seconds(f):
        took = []
        for _ in range(5):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    assert seconds(lambda: lm.split(column)) < 0.8 * seconds(one_by_one)


def test_a_task_hands_on_each_word_once(monkeypatch):
    texts = [" ".join(f"w{(i * k) % 5003}" for i in range(1_000_000)) for k in (1, 3)]  # each is more than half a slice
    batches = [pa.record_batch([pa.array(texts)], names=["text"])] * 2
    handed = [r for b in lm.tally(iter(batches)) for r in b.to_pylist()]
    assert {r["w"].decode(): r["n"] for r in handed} == {w: 2 * n for w, n in Counter(w for t in texts for w in t.split()).items()}
    assert len(handed) == 5003 and list(lm.tally(iter([]))) == []
    monkeypatch.setattr(lm, "HELD", 6000)  # more than half of it is handed on at once
    assert sum(r["n"] for b in lm.tally(iter(batches)) for r in b.to_pylist()) == 4_000_000


def test_large_logits():
    net = lm.Network.start(np.arange(lm.SIZE), 1)
    net.w = [w.astype(np.float64) for w in net.w]
    net.w[2] *= 300
    net.w[3][3] *= 300
    numbers = np.array([0, 0, 5, 6, 64 * 3 + 7, 8, 64 * 9, 0, 0])
    at = np.arange(2, 7)
    for i, got in zip(at, net.log_p(numbers, at), strict=True):
        h = net.hidden(numbers, np.array([i]))[0]
        logits = h @ net.w[2], h @ net.w[3][numbers[i] // 64]
        want = sum(x[j] - x.max() - np.log(np.exp(x - x.max()).sum()) for x, j in zip(logits, divmod(int(numbers[i]), 64), strict=True))
        assert got == pytest.approx(want, rel=1e-9)
    assert all(np.isfinite(g).all() for g in net.gradients(numbers, at)[1:])

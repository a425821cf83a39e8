import random
import re

import numpy as np
import xxhash
from quarrystone.llm import simhash


def brute(rows, width=3):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    prints = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
        s = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    f = np.array(prints, dtype=np.uint64)
    comp = list(range(len(f)))
    changed = True
    near = [np.flatnonzero(np.bitwise_count(f ^ x) <= 3) for x in f]
    while changed:
        changed = False
        for i, js in enumerate(near):
            m = min(comp[j] for j in js)
            changed |= comp[i] != m
            comp[i] = m
    low = {}
    for c, (d, _) in zip(comp, rows, strict=True):
        if d is not None:
            low[c] = min(low.get(c, d), d)
    return sorted((d if d is not None else -1, f"{p:016x}", low.get(c)) for (d, _), p, c in zip(rows, prints, comp, strict=True))


def test_report(awkward):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    got = sorted((r[0] if r[0] is not None else -1, r[1], r[2]) for r in simhash.report(awkward).collect())
    assert got == brute(rows)


def test_empty(nothing):
    assert simhash.report(nothing).collect() == []


def test_links_connect_all_within_three_bits(spark):
    rng = random.Random(3)
    fps = set()
    for _ in range(120):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(rng.randint(0, 3)):
            y = x
            for b in rng.sample(range(64), rng.randint(1, 5)):
                y ^= 1 << b
            fps.add(y)
            x = rng.choice([x, y])
    f = np.array(sorted(fps), dtype=np.uint64)
    found = simhash.links(spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fp long")).collect()
    edges = [(int(np.int64(a).view(np.uint64)), int(np.int64(b).view(np.uint64))) for a, b in found]
    assert all(1 <= (a ^ b).bit_count() <= 3 for a, b in edges)
    up = {int(x): int(x) for x in f}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[root(a)] = root(b)
    for i, a in enumerate(f):
        for b in f[i + 1 :]:
            if (int(a) ^ int(b)).bit_count() <= 3:
                assert root(int(a)) == root(int(b))


def shingles(t, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_near_duplicates(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
    rows, n = [], 0
    for _ in range(60):
        w = [rng.choice(words) for _ in range(rng.randint(80, 250))]
        rows.append((n := n + 1, " ".join(w)))
        for edits in rng.sample([0, 1, 2, 3, 30], rng.randint(0, 3)):
            v = list(w)
            for i in rng.sample(range(len(v)), edits):
                v[i] = rng.choice(words)
            rows.append((n := n + 1, " ".join(v)))
    rows += [(n + 1, None), (n + 2, ""), (n + 3, "a b c"), (n + 4, "A  b c"), (n + 5, "a b d"), rows[5], rows[5]]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, fp string, keeper int").repartition(3).checkpoint()
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            either = len(sets[i] | sets[j])
            if (rows[i][1] or "") == (rows[j][1] or "") or (either and both >= 0.8 * either):
                group[root(i)] = root(j)
    want = {min(d for k, (d, _) in enumerate(rows) if root(k) == r) for r in {root(i) for i in range(len(rows))}}
    kept = simhash.dedup(df)
    assert kept.columns == df.columns
    got = [r.doc_id for r in kept.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_dedup_of_awkward_rows(awkward, nothing):
    kept = simhash.dedup(awkward)
    texts = [r.text for r in kept.collect()]
    assert kept.columns == awkward.columns and len(texts) == len({t or "" for t in texts})
    assert simhash.dedup(nothing).collect() == []


def kept_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).checkpoint()
    return {r.doc_id for r in simhash.dedup(df).collect()}


def test_truncated_and_extended_copies(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(20_000)]
    base = [[rng.choice(words) for _ in range(rng.randint(60, 400))] for _ in range(40)]
    passage = [rng.choice(words) for _ in range(12)]
    copies = [w[: -(-len(w) * 83 // 100)] for w in base[:15]]
    copies += [w + [rng.choice(words) for _ in range(len(w) // 6)] for w in base[15:25]]
    copies += [w[: len(w) // 2] + passage + w[len(w) // 2 :] for w in base[25:32] if len(w) > 150]
    apart = [w[: len(w) // 2] + passage for w in base[32:]]
    texts = [" ".join(w) for w in base + copies + apart]
    sets = [shingles(t) for t in texts]
    near = [j for j in range(len(base), len(base) + len(copies)) if any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for i in range(len(base)))]
    assert len(near) >= len(copies) - 2
    assert kept_of(spark, texts) == set(range(len(texts))) - set(near)


def test_copies_among_other_orders_of_the_same_words(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(100)]
    orders = [rng.sample(words, 100) for _ in range(6)]
    texts = [w[:70] + [w[71], w[70]] + w[72:] for w in orders]  # all texts hold the same words
    texts = [" ".join(w) for w in orders + texts]
    assert all(len(shingles(texts[i]) & shingles(texts[i + 6])) >= 0.8 * len(shingles(texts[i]) | shingles(texts[i + 6])) for i in range(6))
    assert kept_of(spark, texts) == set(range(6))


def test_links_of_dense_groups_are_few(spark):
    """All fingerprints within two bits of one: far fewer links than they share variants."""
    rng = random.Random(6)
    centre = rng.getrandbits(64)
    fps = np.array(sorted({centre ^ (1 << a) ^ (1 << b) for a, b in (rng.sample(range(64), 2) for _ in range(300))} | {centre}), dtype=np.uint64)
    found = {tuple(sorted(r)) for r in simhash.links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")).collect()}
    up = {int(x): int(x) for x in fps.view(np.int64)}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in found:
        up[root(a)] = root(b)
    assert len({root(x) for x in up}) == 1 and len(found) < 20 * len(fps)


def test_bitmaps_bound_what_differs():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 63, 20_000).astype(np.uint64)
    sets = sorted((np.unique(rng.choice(pool, n, replace=False)) for n in (0, 1, 9, 200, 256, 257, 500, 900, 3000, 9000, 12_000)), key=len)
    sets += [np.unique(np.concatenate((sets[-1][:-200], pool[:150])))]
    sets.sort(key=len)
    at = simhash.folded([simhash.bitmap(x) for x in sets])
    assert set(at) == {32, 64, 128, 512, 1024}
    for first, rows in at.values():
        for i in range(first, len(sets)):
            for j in range(first, i):
                apart = int(np.bitwise_count(rows[i - first] ^ rows[j - first]).sum())
                assert apart <= len(np.setxor1d(sets[i], sets[j]))
    # of one width, a folded bitmap is the narrower one of the same set
    for x in sets[5:]:
        cells = (simhash.mix(x) & np.uint64(255)).astype(np.int64)
        narrow = np.packbits((np.bincount(cells, minlength=256) & 1).astype(np.uint8))
        rows = simhash.folded([simhash.bitmap(sets[0]), simhash.bitmap(x)])[32][1]
        assert rows[1].tobytes() == narrow.tobytes()
    # long texts that share half of their shingles are told apart
    x, y = np.unique(pool[:1500]), np.unique(pool[500:2000])
    first, rows = simhash.folded([simhash.bitmap(x), simhash.bitmap(y)])[256]
    assert int(np.bitwise_count(rows[0] ^ rows[1]).sum()) > (len(x) + len(y)) / 9


def test_near_misses_of_a_group_are_not_listed(spark):
    """Texts that bitmaps allow and whose similarity is just too low: rows out of every grouped step stay below its texts."""
    from pyspark.sql import functions as F

    rng = random.Random(12)
    base = [f"w{i}" for i in range(400)]
    texts = []
    for n in range(90):
        w = base.copy()
        for i in rng.sample(range(20, 380), 9):  # two such texts share some 0.64 of their shingles
            w[i] = f"x{n}x{i}"
        texts.append(" ".join(w))
    texts += [t + " end" for t in texts[:5]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).checkpoint()
    sets = [shingles(t) for t in texts]
    assert sum(0.55 < len(a & b) / len(a | b) < 0.8 for i, a in enumerate(sets) for b in sets[:i]) > 3000
    th = simhash.keyed(df).select(F.col("_qs_th").alias("th")).distinct()
    groups = th.select(F.lit(1).cast("long").alias("g"), "th", F.lit(396).cast("long").alias("size")).checkpoint()
    wide = spark.createDataFrame([(r.th, bytes(32)) for r in th.collect()], "th long, bits binary").checkpoint()  # bitmaps that rule out nothing
    none = spark.createDataFrame([], "node long, root long")
    own = simhash.keyed(df).toPandas().set_index("doc_id")["_qs_th"]
    got = {tuple(r) for r in simhash.prefix_links(df, groups, none, wide, 5, 0.8).collect()}
    up = simhash.components(spark.createDataFrame(sorted(got), "a long, b long")).collect()
    assert len(got) < len(texts) and {(r.node, r.root) for r in up} == {(max(own[i], own[i + 90]), min(own[i], own[i + 90])) for i in range(5)}
    assert kept_of(spark, texts) == set(range(90))

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from quarrystone.llm import ranged, trie

SCHEMA = "conv_id long, turn int, role string, text string, node string, d int, length int"


def token(role, text):
    role, text = (role or "").encode(), (text or "").encode()
    return hashlib.sha256(b"%d:" % len(role) + role + text).digest()


def sequences(rows):
    """conv_id -> [(role, text)], ordered as the operator says."""
    found = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            found[c].append((turn is not None, turn or 0, token(role, text), (role or "", text or "")))
    return {c: [x[-1] for x in sorted(t)] for c, t in found.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c, s in convs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for k in members:
        if k:
            kids[k[:-1]] += 1
    for k, m in members.items():
        for e in range(len(k) + 1):
            leaves[k[:e]] += not kids[k]
            saved[k[:e]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    ends = lambda k, m: ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(k))
    return sorted(repr((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(ends(k, m).encode()).hexdigest())) for k, m in members.items())


def rows_of(df):
    return sorted(repr(tuple(r)) for r in df.collect())


@pytest.fixture(scope="module")
def talk(spark):
    """Few different turns; nulls, ties, repeated rows, gaps, one conversation with a third of all turns, a very long text."""
    rng = random.Random(3)
    text = lambda: rng.choice(["a", "b", "bb", "", None, "é😀"])
    rows = []
    for c in [*range(0, 60), *range(100, 140), 205, 206, 207, 301, 302, 400, 401, 403]:
        for t in sorted(rng.sample(range(20), rng.randint(1, 9))):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), text(), "x", 1, 2))
    for c in (500, 501, 502, 503, 504, 505, 506):  # copies
        rows += [(c, t, "user", "same", "x", 1, 2) for t in range(5)]
    rows += [(600, t, "user", text(), None, None, None) for t in range(130)] + [(601, t, "user", "w " * 200_000 if t == 2 else "z", None, None, None) for t in range(4)]
    rows += rows[:5] + [(None, 1, "user", "nobody", None, None, None)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3).checkpoint()


def test_report(talk):
    rows, df = talk
    want = brute(rebuilt(sequences(rows)))
    assert rows_of(trie.report(df)) == want and len(want) > 300


def test_conversations_as_they_are(talk):
    rows, df = talk
    own = sequences(rows)
    t = trie.build(*trie.plain(df))
    n = t.nodes.join(trie.ends_hashes(t.members, part_bytes=3), "node", "left")  # lists of ids in tiny parts
    got = n.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", F.coalesce("ends_sha256", F.lit(trie.NOTHING)))
    assert rows_of(got) == brute(own)
    turns = {(r.conv_id, r.depth): (r.role, r.text) for r in trie.with_turns(t, df).collect()}
    assert all(turns[c, d] == (own[c][d - 1] if d else (None, None)) for c, d in turns) and len(turns) == len(brute(own))
    assert t.nodes.agg(F.max("node"), F.count("*")).first()[0] + 1 == len(turns)  # names are dense


def test_turnless_and_nothing(spark):
    few = spark.createDataFrame([(c, 0, "user", "t") for c in range(201, 240)], "conv_id long, turn int, role string, text string")
    own = {c: [("user", "t")] for c in range(201, 240)}
    assert rows_of(trie.report(few)) == brute(rebuilt(own)) and any(not s for s in rebuilt(own).values())
    assert trie.report(few.where("conv_id < 0")).collect() == []


def test_numbers_and_sums_of_a_key_in_many_partitions(spark):
    off = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(off, False)
    try:
        numbers_and_sums(spark)
    finally:
        spark.conf.unset(off)


def numbers_and_sums(spark):
    rng = random.Random(1)
    rows = [(k, rng.randint(-5, 5)) for k in [7] * 900 + [rng.randint(0, 20) for _ in range(300)]]
    df = ranged.arranged(spark.createDataFrame(rows, "k long, v long").withColumn("at", F.monotonically_increasing_id()).repartition(5), "k", "at")
    assert df.groupBy(F.spark_partition_id()).agg(F.bool_or(F.col("k") == 7).alias("hot")).where("hot").count() > 1
    got = ranged.running(ranged.numbered(df, ["k"], "n", 3)[0], ["k"], {"s": "v"}).collect()
    place = {k: 3 + i for i, k in enumerate(sorted({k for k, _ in rows}))}
    sums = defaultdict(int)
    for r in sorted(got, key=lambda r: (r.k, r.at)):
        sums[r.k] += r.v
        assert (r.n, r.s) == (place[r.k], sums[r.k])
    assert len(got) == len(rows)

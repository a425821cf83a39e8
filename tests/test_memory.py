"""Live memory: thread_history after any split into batches, expiry, restarts."""

import random
import time

import pytest
from quarrystone.operators.aggregate import thread_history
from quarrystone.streaming import ingest

TURNS = "conv_id long, turn long, role string, text string"


@pytest.fixture(autouse=True)
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key)
    ingest.use_rocksdb(spark)
    yield
    spark.conf.set(key, was)


def play(spark, tmp_path, name, batches, pause=0.0, **options):
    """The rows of every micro-batch, one for each list of turns; the stream is started anew for each."""
    source, out = str(tmp_path / name), []
    for rows in batches:
        spark.createDataFrame(rows, TURNS).coalesce(1).write.mode("append").parquet(source)
        df = ingest.live_memory(spark.readStream.schema(TURNS).parquet(source), **options)
        got = []
        q = df.writeStream.foreachBatch(lambda b, _, got=got: got.extend(map(tuple, b.collect()))).outputMode("update")
        q.option("checkpointLocation", f"{source}-checkpoint").trigger(once=True).start().awaitTermination()
        out.append(got)
        time.sleep(pause)
    return out


def test_any_split_gives_the_same_histories(spark, tmp_path):
    every = [(c, t, "user" if t % 2 else "system", f"text {c} {t}") for c in range(6) for t in range(c * 2 + 1)]
    every += [(7, None, "user", "first"), (7, 1, None, "no role"), (7, 2, "user", None), (7, 3, "user", "x"), (8, 1, "b", "same"), (8, 1, "a", "same")]
    want = {r["conv_id"]: (r["n_turns"], r["history"]) for r in thread_history(spark.createDataFrame(every, TURNS)).collect()}
    rng = random.Random(5)
    rng.shuffle(every)
    cuts = sorted(rng.sample(range(1, len(every)), 3))
    batches = [every[a:b] for a, b in zip([0, *cuts], [*cuts, len(every)], strict=True)]
    last = {}
    for got, sent in zip(play(spark, tmp_path, "split", batches), batches, strict=True):
        assert sorted(r[0] for r in got) == sorted({r[0] for r in sent})
        last |= {c: (n, h) for c, n, h in got}
    assert last == want


def test_a_batch_alone_when_not_whole(spark, tmp_path):
    got = play(spark, tmp_path, "own", [[(1, 1, "u", "a")], [(1, 2, "u", "b"), (1, 3, "u", "c")]], whole=False)
    assert got == [[(1, 1, "u: a")], [(1, 2, "u: b\nu: c")]]


def test_turns_expire(spark, tmp_path):
    got = play(spark, tmp_path, "ttl", [[(1, 1, "u", "a"), (2, 1, "u", "z")], [(1, 2, "u", "b")]], pause=2.0, ttl_ms=1500)
    assert sorted(got[0]) == [(1, 1, "u: a"), (2, 1, "u: z")]
    assert got[1] == [(1, 1, "u: b")]

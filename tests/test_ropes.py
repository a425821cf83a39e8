"""Ropes against texts joined whole."""

import pytest
from pyspark.sql import functions as F
from quarrystone.operators import aggregate, ropes
from quarrystone.operators.chunking import chunk

ROWS = "source string, seq long, text string, offset string"


@pytest.fixture(scope="module")
def rows(spark):
    words = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    data = [("a", i, words(f"w{i}x", i * 7 % 40), "other") for i in range(60)]
    data += [("b", 1, words("long", 3000), None), ("b", 0, " \n ", None), ("b", 2, None, None), ("c", 5, "", None), (None, 1, "x  y", None), (None, 2, "z\té", None), ("d", 1, "one", None), ("d", 2, "twice here", None), ("d", 2, "twice here", None), ("d", None, "null first", None)]
    return spark.createDataFrame(data, ROWS).repartition(5)


def test_rope_is_the_joined_text(spark, rows):
    got = {}
    for r in ropes.rope(rows, "source", "seq").collect():
        got.setdefault(r["source"], []).append(r)
    want = {r["source"]: r["text"] for r in aggregate.concat_by_source(rows).collect()}
    assert set(got) == set(want)
    for k, pieces in got.items():
        assert all(want[k][p["offset"] :].startswith(p["piece"]) and p["n_chars"] == len(want[k]) for p in pieces)
        assert "\n\n".join(p["piece"] for p in sorted(pieces, key=lambda p: p["offset"])) == want[k]
    heads = {r["source"]: r["head"] for r in ropes.heads(rows, "source", "seq", 100).collect()}
    assert heads == {k: v[:100] for k, v in want.items()}


@pytest.mark.parametrize(("size", "overlap"), [(450, 90), (10, 0), (7, 6), (1, 0), (50, 3)])
def test_chunks_of_ropes(rows, size, overlap):
    whole = chunk(aggregate.concat_by_source(rows), size, overlap).select("source", "chunk_index", "original_text", "n_tokens")
    got = ropes.rope_chunks(rows, "source", "seq", size, overlap)
    assert got.columns == whole.columns
    key = lambda r: (str(r[0]), r[1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, whole.collect()), key=key)


def test_chunks_of_sources_with_their_metadata(rows):
    docs = rows.withColumn("title", F.concat(F.lit("title "), "seq")).withColumn("creation_date", F.lit(""))
    columns = ["source", "chunk_index", "original_text", "n_tokens", "document_id", "first_seq", "title", "creation_date"]
    whole = chunk(aggregate.concat_by_source(docs), 50, 10).select(*columns)
    assert sorted(map(str, ropes.source_chunks(docs, 50, 10).select(*columns).collect())) == sorted(map(str, whole.collect()))


def test_running_over_a_hot_key_and_nothing(spark):
    df = spark.range(5000).select(F.lit("k").alias("key"), "id", F.when(F.col("id") % 3 > 0, F.col("id") % 5).alias("n"))
    got, run = ropes.running(df, "key", ["id"], "n").orderBy("id").collect(), 0
    for i, r in enumerate(got):
        assert r["id"] == i and r["before"] == run
        run += (i % 5) if i % 3 else 0
    assert {r["total"] for r in got} == {run}
    none = df.where("id < 0")
    assert ropes.running(none, "key", ["id"], "n").count() == 0 and ropes.rope_chunks(none, "key", "id", value="n").count() == 0


def test_overlap_has_to_be_below_size(rows):
    with pytest.raises(ValueError):
        ropes.rope_chunks(rows, "source", "seq", 5, 5)

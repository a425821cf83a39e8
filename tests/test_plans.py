import json

import pytest
from pyspark.sql import functions as F
from quarrystone.config import EngineConfig
from quarrystone.functions.checkpoints import cut
from quarrystone.operators.providers import HashedEmbedder, Kept, LeadingWords, complete, embed
from quarrystone.plans.index import index
from quarrystone.plans.retrieve import context, hits, retrieve, status
from quarrystone.sources.collections import POINT, Collections, Conflict
from quarrystone.streaming import ingest


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("sources")
    words = lambda seed, n: " ".join(f"{seed}{i % 97}" for i in range(n))
    (d / "a.txt").write_text(words("river", 4000) + " lighthouse keeper")
    (d / "b.md").write_text("# Title\n\n" + words("green", 900))
    (d / "c.csv").write_text('name,town\n"Ann","Oslo"\n"Bo",\n')
    (d / "d.html").write_text("<title>T</title><body><p>" + words("house", 60) + "<p>short</p></body>")
    (d / "empty.txt").write_text(" \n\t")
    return d


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    return Collections(spark, str(tmp_path_factory.mktemp("collections")))


@pytest.fixture(scope="module")
def indexed(spark, folder, store):
    return index(spark, [str(folder / n) for n in ("a.txt", "b.md", "c.csv", "d.html", "empty.txt")], "first", store)


def test_index(spark, store, indexed):
    assert indexed["collection"] == "first" and len(indexed["sources"]) == 4
    assert indexed["levels"][0] == indexed["chunks"] == 11 + 3 + 1 + 1
    assert indexed["levels"].get(1, 0) >= 1 and indexed["total_nodes"] == sum(indexed["levels"].values())
    points = cut(store.read("first"))
    assert points.count() == indexed["total_nodes"] == store.info("first")["points"]
    ids = {r.text_unit_id for r in points.collect()}
    rows = points.collect()
    assert all(r.parent_id is None or r.parent_id in ids for r in rows)
    for r in rows:
        if r.level > 0:
            assert set(r.children_ids) <= ids and r.title == f"Level-{r.level} Summary"
        assert abs(sum(x * x for x in r.dense) - 1) < 1e-4
        assert r.parent_id != r.text_unit_id
    assert len(ids) == len(rows)
    again = index_again = store.info("first")["points"]
    store.upsert("first", points)
    assert store.info("first")["points"] == again == index_again


def test_retrieve(store, indexed):
    found = hits(store.read("first"), "lighthouse keeper", 5)
    rows = found.collect()
    assert len(rows) == 5 and "lighthouse" in rows[0].original_text and [r["rank"] for r in rows] == [1, 2, 3, 4, 5]
    assert found.columns == ["rank", "context", "document_section", "chunk_role", "entities", "original_text", "raptor_tree_node_level", "n_tokens", "score"]
    one = context(found, 10**6).first()
    assert one.num_passages == 5 and one.total_tokens > sum(len(r.original_text.split()) for r in rows) and one.levels_used
    assert context(found, 1).first().num_passages == 0
    assert all(r.raptor_tree_node_level == 0 for r in hits(store.read("first"), "lighthouse", 20, where=F.col("level") == 0).collect())
    stored = store.postings("first").withColumnRenamed("point_id", "pid")
    assert [tuple(r) for r in hits(store.read("first"), "lighthouse keeper", 5, index=stored).collect()] == [tuple(r) for r in rows]
    assert json.loads(retrieve(store, "lighthouse", "first"))["passages"]["num_passages"] >= 1
    assert "error" in json.loads(retrieve(store, "x", "")) and "error" in json.loads(retrieve(store, "x", "none"))
    assert json.loads(status(store, "first"))[0]["points"] == indexed["total_nodes"]


def test_missing_source(spark, store):
    with pytest.raises(FileNotFoundError):
        index(spark, ["/nowhere/at/all.txt"], "x", store)
    with pytest.raises(ValueError):
        index(spark, [], "", store)
    assert not store.exists("x") and store.info("x") is None


def test_indexing_does_not_depend_on_the_folder(spark, folder, store, indexed, tmp_path):
    """The same texts in folders of other names give as many nodes, and a later reader keeps the version it has read."""
    import shutil

    for name in ("a", "zz"):
        shutil.copytree(folder, tmp_path / name)
        before = store.read("moved") if store.exists("moved") else None
        again = index(spark, [str(tmp_path / name / n) for n in ("a.txt", "b.md", "c.csv", "d.html", "empty.txt")], "moved" if name == "a" else "other", store)
        assert (again["chunks"], again["total_nodes"], again["levels"]) == (indexed["chunks"], indexed["total_nodes"], indexed["levels"])
        assert before is None or before.count() == indexed["total_nodes"]
    held = store.read("moved")
    n = held.count()
    store.rebuild("moved", held.where("level = 0"))
    assert held.count() == n > store.read("moved").count() and store.vacuum("moved") == 0 and store.vacuum("moved", -60) > 0
    assert store.read("moved").where("level <> 0").count() == 0 and store.drop("moved") and store.drop("other")


def test_lifecycle(store, indexed):
    assert store.ensure("second") is None and store.ensure("second")["points"] == 0
    assert store.list() == ["first", "second"] and len(store.status()) == 2
    assert store.drop("second") and store.list() == ["first"] and not store.drop("second")


def point_rows(spark, rows):
    """Points of (id, text, level, seq)."""
    df = spark.createDataFrame(rows, "point_id long, text string, level int, seq int").withColumn("point_id", F.col("point_id").cast("decimal(20,0)"))
    for f in POINT.fields:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    return df.select(*POINT.names, "seq")


def test_upserts_against_a_dictionary(spark, tmp_path):
    """Parts that are merged when read give what the last writes give, with postings, across compactions and repeated runs."""
    import random

    rng, want = random.Random(3), {}
    small = Collections(spark, str(tmp_path / "c"), compact_after=3)
    for batch in range(6):
        rows = [(rng.randint(0, 20), f"w{batch} word{rng.randint(0, 5)}", rng.choice([0, 1, None]), i) for i in range(rng.randint(1, 12))]
        for _ in range(1 + (batch == 2)):
            small.upsert("x", point_rows(spark, rows))
        want |= {int(i): (t, level) for i, t, level, _ in rows}
        assert {int(r.point_id): (r.text, r.level) for r in small.read("x").collect()} == want and small.info("x")["points"] == len(want)
        got = sorted((int(r.point_id), r.token) for r in small.postings("x").collect())
        assert got == sorted((i, w) for i, (t, _) in want.items() for w in t.split())
    assert len(small._parts("x")) <= 3
    assert small.read("x").where("level = 0").count() == sum(level == 0 for _, level in want.values())


def test_an_upsert_writes_what_it_gets(spark, tmp_path):
    c = Collections(spark, str(tmp_path / "c"))
    c.upsert("x", point_rows(spark, [(i, f"t{i}", 0, 0) for i in range(500)]))
    first = set(c._parts("x"))
    c.upsert("x", point_rows(spark, [(7, "seven", 0, 0), (900, "new", 0, 0)]))
    (new,) = set(c._parts("x")) - first
    assert spark.read.parquet(f"{c.root}/x/{new}").count() == 2 and first < set(c._parts("x"))


def test_two_writers(spark, tmp_path):
    """Of two that would replace what they have read one fails and changes nothing; an upsert goes on top; no reader sees half."""
    c = Collections(spark, str(tmp_path / "c"))
    c.upsert("x", point_rows(spark, [(1, "a", 0, 0), (2, "b", 0, 0)]))
    held = c.read("x")
    write = c._write

    def slow(name, rows):  # another writer commits while this one writes
        part = write(name, rows)
        c._write = write
        c.upsert("x", point_rows(spark, [(3, "c", 0, 0)]))
        return part

    for work in (lambda: c.compact("x"), lambda: c.rebuild("x", point_rows(spark, [(9, "z", 0, 0)]))):
        c._write = slow
        with pytest.raises(Conflict):
            work()
        assert sorted(int(r.point_id) for r in c.read("x").collect()) == [1, 2, 3]
    c._write = slow
    c.upsert("x", point_rows(spark, [(2, "bb", 0, 0)]))
    assert {int(r.point_id): r.text for r in c.read("x").collect()} == {1: "a", 2: "bb", 3: "c"}
    assert {int(r.point_id): r.text for r in held.collect()} == {1: "a", 2: "b"}
    with pytest.raises(Conflict):
        c._commit("x", c._version("x"), [])
    (tmp_path / "c" / "x" / "_log" / ".half").write_text("{")
    write("x", point_rows(spark, [(5, "never committed", 0, 0)]))
    assert c.info("x")["points"] == 3
    c.compact("x")
    assert c.vacuum("x") == 0 and c.vacuum("x", -60) > 4 and {int(r.point_id): r.text for r in c.read("x").collect()} == {1: "a", 2: "bb", 3: "c"}
    assert c.ensure("y") is None and c.read("y").count() == 0 and c.postings("y").count() == 0


def counted(path):
    """Providers that note each call in a file."""

    class Counted:
        def _note(self, texts):
            with open(path, "a") as f:
                f.writelines(f"{hash(t)}\n" for t in texts)

        def embed(self, texts):
            self._note(texts)
            return HashedEmbedder(8).embed(texts)

        def complete(self, prompt):
            self._note([prompt])
            if "fail" in prompt:
                raise RuntimeError("busy")
            return LeadingWords(3).complete(prompt)

    return Counted()


def test_answers_are_kept(spark, tmp_path):
    calls = tmp_path / "calls"
    asked = lambda: len(calls.read_text().splitlines()) if calls.exists() else 0
    rows = [(1, "a b c d"), (2, "a b c d"), (2, "a b c d"), (3, None), (4, ""), (5, "fail"), (6, "x y")]
    df = spark.createDataFrame(rows, "id int, t string").repartition(3)
    kept = Kept(spark, counted(str(calls)), "one", str(tmp_path / "kept"))
    want = sorted((i, t, "a b c" if t == "a b c d" else t if t == "x y" else "") for i, t in rows if t is not None)
    for n in (4, 6, 8):  # four different texts; empty answers are asked for again
        got = [tuple(r) for r in complete(df, kept, "Do.", "t", "to").collect()]
        assert sorted(r for r in got if r[1] is not None) == want and (3, None, "") in got and len(got) == 7 and asked() == n
    assert [r.to for r in complete(df.where("id = 6"), Kept(spark, counted(str(calls)), "two", str(tmp_path / "kept")), "Do.", "t", "to").collect()] == ["x y"] and asked() == 9
    for n in (13, 13):
        got = {r.id: r.v for r in embed(df, kept, "t", to="v").collect()}
        assert asked() == n and got[1] == got[2] == HashedEmbedder(8).embed(["a b c d"])[0] and got[3] == [0.0] * 8


def test_a_second_run_makes_no_call(spark, folder, store, indexed, tmp_path):
    calls, names = tmp_path / "calls", ("b.md", "c.csv", "d.html")
    provider = lambda name: Kept(spark, counted(str(calls)), name, str(tmp_path / "kept"))
    runs = []
    for _ in range(2):
        made = index(spark, [str(folder / n) for n in names], "kept", store, EngineConfig(embedding_dimensions=8), provider("vectors"), provider("summaries"))
        runs.append((made["total_nodes"], len(calls.read_text().splitlines())))
    assert runs[0] == runs[1] and runs[0][1] >= runs[0][0] and store.drop("kept")


def test_questions_without_an_answer(store, indexed):
    """An empty question has a zero vector and no terms."""
    for asked in ("", "the of and", "zzzzzz"):
        assert "error" not in json.loads(retrieve(store, asked, "first"))
    assert json.loads(retrieve(store, "", "first"))["passages"]["num_passages"] == 0


def test_stream_upserts_are_idempotent(spark, store, indexed, tmp_path):
    points = store.read("first").limit(6)
    source = str(tmp_path / "in")
    points.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(source)
    for n in range(2):
        q = ingest.upsert_stream(stream, lambda b: b, store, "streamed", str(tmp_path / f"c{n}")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert store.info("streamed")["points"] == 6


def test_streams(spark, tmp_path):
    spark.createDataFrame([("p", "https://x.org/a/"), ("p", "https://x.org/a#b"), ("q", "https://x.org/a")], "project string, url string").write.parquet(str(tmp_path / "v"))
    spark.createDataFrame([(1, 2, "user", "b"), (1, 1, "system", "a"), (2, 1, "user", "c")], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "t"))

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(tuple(r) for r in spark.table(name).collect())

    read = lambda x, s: spark.readStream.schema(s).parquet(str(tmp_path / x))
    assert run(ingest.first_visits(read("v", "project string, url string")), "visits", "append") == [("p", "https://x.org/a"), ("q", "https://x.org/a")]
    assert run(ingest.histories(read("t", "conv_id long, turn long, role string, text string")), "turns", "update") == [(1, 2, "system: a\nuser: b"), (2, 1, "user: c")]
    events = spark.readStream.schema(spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet("/root/testdata/sf0.001/")
    assert run(ingest.event_counts(events), "events", "append")


def test_providers_retry():
    from quarrystone.operators.providers import Retrying, TransientError

    class Flaky:
        def __init__(self, failures, error=TransientError):
            self.left, self.error = failures, error

        def embed(self, texts):
            self.left -= 1
            if self.left >= 0:
                raise self.error("busy")
            return [[1.0]] * len(texts)

    slept = []
    assert Retrying(Flaky(3), 3, slept.append).embed(["a"]) == [[1.0]] and slept == [1, 2, 4]
    with pytest.raises(TransientError):
        Retrying(Flaky(4), 3, slept.append).embed(["a"])
    with pytest.raises(ValueError):
        Retrying(Flaky(1, ValueError), 3, slept.append).embed(["a"])
    assert LeadingWords(2).complete("do\na b c") == "a b" and len(HashedEmbedder(8).embed(["x"])[0]) == 8


def test_config():
    with pytest.raises(ValueError):
        EngineConfig(chunk_size=10, chunk_overlap=10)
    assert EngineConfig().components(1) == 10 and EngineConfig().components(3) == 2

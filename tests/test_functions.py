"""Functions against plain-Python twins, on edge lists."""

import json
import random
from urllib.parse import urljoin, urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F
from quarrystone.functions import html, text, urls
from quarrystone.functions.bpe import RankedBPE, merged
from quarrystone.operators import chunking, graph, lexical_index, retrieval, tree, vector_index
from quarrystone.operators.aggregate import batches
from quarrystone.schema import ENRICHMENT


def loop(n, size, overlap):
    out, at = [], 0
    while at < n:
        out.append((at, min(at + size, n)))
        if at + size >= n:
            break
        at += size - overlap
    return out


@pytest.mark.parametrize("size,overlap", [(450, 90), (5, 0), (5, 4), (1, 0)])
def test_windows(spark, size, overlap):
    ns = [0, 1, 2, 5, 9, 10, 11, 90, 91, 449, 450, 451, 810, 811]
    df = spark.createDataFrame([(n, " ".join(map(str, range(n)))) for n in ns], "n int, text string")
    got = {}
    for r in chunking.chunk(df, size, overlap).collect():
        w = r.original_text.split(" ")
        got.setdefault(r.n, {})[r.chunk_index] = (int(w[0]), int(w[-1]) + 1)
        assert r.n_tokens == len(w)
    for n in ns:
        assert [x for _, x in sorted(got.get(n, {}).items())] == loop(n, size, overlap)
    for bad in ((5, 5), (5, -1)):
        with pytest.raises(ValueError):
            chunking.chunk(df, *bad)


def naive_merge(piece, ranks):
    """Joins the pair of least rank, leftmost first, again and again."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not pairs:
            return [ranks[p] for p in parts]
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_merges_against_a_naive_merger():
    rng = random.Random(6)
    for _ in range(60):
        known = [bytes([i]) for i in range(256)]
        for _ in range(rng.randint(0, 60)):  # tokens made of tokens over a small alphabet, so that merges compete
            joined = rng.choice(known[97:100] + known[256:]) + rng.choice(known[97:100] + known[256:])
            if joined not in known and len(joined) < 12:
                known.append(joined)
        ranks = {b: i for i, b in enumerate(known)}
        for _ in range(20):
            piece = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 40)))
            want = [ranks[piece]] if piece in ranks else naive_merge(piece, ranks)
            assert merged(piece, ranks) == want and b"".join(known[i] for i in want) == piece
    with pytest.raises(ValueError, match="every single byte"):
        RankedBPE({b"a": 0})


def test_bpe(spark):
    """Against a library that reads the same vocabulary: every document and awkward texts; windows and exact round trips."""
    P, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    t = RankedBPE.load(spark, f"file://{P.path('byte_bpe_50k.tiktoken')}")
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=t.ranks, special_tokens={})
    odd = ["", " ", "a  b \n\n c\t", "I'll we've 'S it's", "ünï ß 中文字 नमस्ते 😀\u200d😀", "x\x85y\u2028z\u3000w \u00a0", "12 345٣٤ ½", "<|endoftext|> and", "a" * 30_000, "\n" * 50, " end ", "\x00\x1f", "e\u0301 \ufeff"]
    rows = [(-1 - i, x) for i, x in enumerate(odd)] + [(-99, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text"))
    got = df.select("doc_id", "text", t.tokens("text").alias("n")).select("*", t.texts("n").alias("back")).collect()
    for r in got:
        if r.text is None:
            assert r.n is None and r.back is None
        else:
            assert r.back == r.text and r.n == other.encode_ordinary(r.text), r.text[:50]
    assert len(got) > 200
    s = "Some words <|endoftext|> and more words, again and again. 😀" * 30
    out = sorted(chunking.chunk(spark.createDataFrame([(1, s), (2, " "), (3, None)], "id int, text string"), 50, 10, t).collect(), key=lambda r: r.chunk_index)
    assert spark.createDataFrame([("",), (None,)], "t string").coalesce(1).select(t.texts(t.tokens("t")).alias("b")).collect() == [("",), (None,)]
    ids = other.encode_ordinary(s)
    assert [(r.n_tokens, r.original_text) for r in out] == [(b - a, other.decode(ids[a:b])) for a, b in loop(len(ids), 50, 10)]


def test_blank_and_chars(spark):
    rows = spark.createDataFrame([(t,) for t in ("", " ", "\t\n\x0b", None, " a ", "x" * 25)], "t string")
    got = [(r[0], r[1]) for r in rows.select(text.is_blank("t"), chunking.char_windows("t", 10)).collect()]
    assert [b for b, _ in got] == [True, True, True, True, False, False]
    assert got[0][1] == [] and got[3][1] == [] and [len(x) for x in got[5][1]] == [10, 10, 5]


def test_recursive_split():
    t = "One two three. " * 40 + "\n\n" + "x" * 130
    out = chunking.recursive_split(t, 100, 20)
    assert all(len(p) <= 100 for p in out) and "".join(out).count("x") >= 130
    assert chunking.recursive_split("", 10, 2) == [] and chunking.recursive_split("abc", 10, 2) == ["abc"]


def test_enrichment(spark):
    answers = ['{"context":"c","document_section":"s","chunk_role":"example","entities":["A","B"]}', "not json", '{"context":"only"}', None, ""]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, a string").select("i", text.parse_enrichment("a", ENRICHMENT).alias("e")).orderBy("i")
    got = [tuple(r.e) for r in df.collect()]
    fallback = ("json parsing failed, returning empty context", "parsing failed", "", [])
    assert got == [("c", "s", "example", ["A", "B"]), fallback, ("only", "", "", []), fallback, fallback]
    row = spark.range(1).select(text.enriched_text(F.lit("s"), F.lit("r"), F.array(F.lit("a"), F.lit("b")), F.lit("ctx"), F.lit(" body \n"))).first()[0]
    assert row == "Section: s\nRole: r\nEntities: a, b\n\nctx\n\n body"


def twin_ok(url, base):
    p = urlparse(url)
    return (p.netloc in ("", base)) and not p.path.lower().endswith(tuple(urls.SKIP_EXTENSIONS)) and not any(s in p.path.lower() for s in urls.BAD_SEGMENTS)


def test_urls(spark):
    given = ["https://x.org/a/b/", "https://x.org/a?q=1#f", "https://x.org:8080/a//", "https://x.org/a;p=1", "mailto:a@b.c", "javascript:void(0)", "https://y.org/a", "https://x.org/roundabout", "https://x.org/A.PDF", "/rel/path", "https://x.org", "https://x.org/login?x", ""]
    df = spark.createDataFrame([(u,) for u in given], "u string").select("u", urls.normalize_url("u").alias("n"), urls.netloc("u").alias("h"), urls.is_doc_link("u", F.lit("x.org")).alias("ok"))
    for r in df.collect():
        p = urlparse(r.u)
        assert r.n == p._replace(params="", query="", fragment="", path=p.path.rstrip("/")).geturl()
        assert r.h == p.netloc and r.ok == twin_ok(r.u, "x.org"), r.u
    page = '<a href="/b">x</a><a class="k" href=\'../up\'>y</a><a href="#top">z</a><a href="//x.org/c?d">w</a><A HREF="https://x.org/b/">v</A><a href="/n.pdf">p</a>'
    got = spark.createDataFrame([(page,)], "h string").select(urls.extract_links("h", F.lit("https://x.org/a/"))).first()[0]
    assert got == ["https://x.org/b", "https://x.org/c", "https://x.org/up"]
    assert spark.range(1).select(urls.resolve(F.lit("https://x.org/a/b/"), F.lit("../up"))).first()[0] == "https://x.org/a/up"


LONG = "a paragraph that is certainly longer than forty characters"


def test_clean_text():
    assert html.clean_page(None) is None and html.clean_page("") == "# "
    assert html.clean_page(f"<title> T </title><p>{LONG}") == "# T"
    page = f"<title>T</title><body><nav><p>{LONG} nav</p></nav><p>{LONG} <b>bold</b><p>{LONG} two<p>short<pre><code>{'c' * 21}</code></pre><code>{'d' * 20}</code><script>var p = '<p>{LONG}</p>'</script></body>"
    assert html.clean_page(page) == f"# T\n\n{LONG} bold\n{LONG} two\n\n" + "\n\n".join(["c" * 21] * 2)
    both = f"<body><p>{LONG} out</p><div role=main><p>{LONG} role</p></div><article><p>{LONG} art</p></article>"
    assert html.clean_page(both) == f"# \n\n{LONG} art"
    assert html.clean_page(both + f"<main><p>{LONG} main</p></main>") == f"# \n\n{LONG} main"
    assert html.clean_page(f"<body><p>{'x' * 40}</p><p>{'y' * 41}</p>") == "# \n\n" + "y" * 41
    assert len(html.clean_page("<body>" + f"<p>{LONG} " * 5000)) < 400_000


def test_names_and_passages(spark):
    row = spark.range(1).select(text.safe_name(F.lit("  Ünï/code: a-b  ")), text.transcript_name(F.lit("id"), F.lit("!!")), text.transcript_title(F.lit("Transcript of “A talk”")), text.python_list(F.array(F.lit("a"), F.lit("b'c"))), text.python_list(F.lit(None).cast("array<string>"))).first()
    assert list(row) == ["Ünïcode_a-b", "transcript_id.txt", "A talk", "['a', \"b'c\"]", "None"]
    got = spark.range(1).select(text.passage(F.lit(2), F.lit("t"), F.lit(1), F.lit(None), F.lit("r"), F.array(F.lit("x")), F.lit(0.5))).first()[0]
    assert got == "[Passage 2 \n Original Text: t \n RAPTOR tree level Level-1 Summary \n \n                Document Section: None \n Chunk Role: r \n \n                Entities: ['x'] \n RRF Retrieval Score: 0.5]\n\n    "


def test_point_ids_are_unsigned(spark):
    row = spark.range(1).select(text.point_id(F.lit("f" * 128)), text.unit_id(F.lit("x"))).first()
    assert int(row[0]) == 2**64 - 1 and len(row[1]) == 128


def test_pack(spark):
    rng = random.Random(1)
    for sizes in ([2000], [1650], [1000, 700, 10], [], [rng.randint(1, 500) for _ in range(12)]):
        df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "rank int, passage_tokens int")
        want, used = [], 0
        for i, n in enumerate(sizes):
            if used + n > 1650:
                break
            want.append(i)
            used += n
        assert sorted(r[0] for r in retrieval.pack(df).collect()) == want


def test_fusion(spark):
    a = spark.createDataFrame([(1, 9.0), (2, 5.0), (3, 5.0)], "id int, score double")
    b = spark.createDataFrame([(3, 1.0), (4, 0.5)], "id int, score double")
    want = {1: 1 / 61, 2: 1 / 62, 3: 1 / 63 + 1 / 61, 4: 1 / 62}
    assert {r.id: r.score for r in retrieval.rank_fusion([a, b]).collect()} == pytest.approx(want)
    scaled = a.withColumn("score", F.col("score") * 7 - 3)
    assert {r.id: r.score for r in retrieval.rank_fusion([scaled, b]).collect()} == pytest.approx(want)


def test_batches_and_mode(spark):
    df = spark.range(1003).withColumn("k", F.pmod(F.col("id") * 7919, F.lit(1003)))
    assert all(r.batch == r.k // 100 for r in batches(df, "k", 100).collect())


def test_budget_counts_the_whole_passage(spark):
    hits = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "d e f")], "rank int, t string")
    shown = retrieval.with_passages(hits, F.concat(F.lit("[Head line: "), "t", F.lit("]")))
    assert [r.passage_tokens for r in shown.orderBy("rank").collect()] == [4, 3, 5]
    assert [r[0] for r in retrieval.pack(shown, 7).collect()] == [1, 2] and retrieval.pack(shown, 3).collect() == []


def test_stems_and_terms(spark):
    from quarrystone.functions.stem import OWN, stem

    # published examples of the stemmer's vocabulary
    for words, want in (("consistency consistently consists", "consist"), ("consolatory", "consolatori"), ("knackeries", "knackeri"), ("generously", "generous"), ("hopping", "hop"), ("hoping", "hope"), ("skies", "sky"), ("communication", "communic"), ("proceed", "proceed")):
        assert {stem(w) for w in words.split()} == {want}
    rows = [(1, "The knights' knightly KNIGHT_s, and the consoled!"), (1, "The knights' knightly KNIGHT_s, and the consoled!"), (2, "x" * 41), (3, None), (4, ""), (5, "dying skies, aing a1 ties")]
    df = spark.createDataFrame(rows, "id int, text string")
    got = sorted((r.id, r.token, r.tf) for r in retrieval.postings(df).collect())
    assert got == sorted(2 * [(1, "knight", 2), (1, "knight_", 1), (1, "consol", 1)] + [(5, stem(w), 1) for w in ("dying", "skies", "aing", "a1", "ties")])
    for only in (["knight", "die"], ["sky"], [stem("aing")], ["tie", "nothing"], []):
        assert sorted((r.id, r.token, r.tf) for r in retrieval.postings(df, only=only).collect()) == [x for x in got if x[1] in only]
    rng = random.Random(8)
    ends = ["", "s", "ies", "ied", "ing", "ed", "eed", "ly", "sses", "y", "ization", "e"]
    for _ in range(20_000):  # what spares tokens the way to the stemmer
        w = "".join(rng.choice("aeioybtsld") for _ in range(rng.randint(1, 6))) + rng.choice(ends)
        assert w in OWN or stem(w)[:2] == w[:2] or (len(stem(w)) == 1 and stem(w) == w[:1])


def test_each_text_goes_to_python_once(spark):
    df = spark.createDataFrame([(1, "a text of words")], "id int, text string")
    for frame in (retrieval.postings(df), retrieval.lexical_topk(df, "words", 3)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        final = plan.split("== Initial Plan ==")[-1]
        assert final.count("MapInArrow") == 1 and "EvalPython" not in plan


@pytest.mark.parametrize("most", [0, 5, 24, 25, 26, 40, 10_000])
def test_cluster_inputs_are_cut_before_they_are_joined(spark, most):
    from quarrystone.operators.aggregate import cluster_inputs

    rng = random.Random(most)
    rows = [(c, pos, f"i{pos}", rng.choice(["", "ab", "text" * rng.randint(1, 5), None]), "s", "d") for c in (1, 2) for pos in rng.sample(range(20_000), 12)]
    df = spark.createDataFrame(rows, "cluster_id int, pos long, id string, original_text string, source string, document_id string").checkpoint()
    whole = {r.cluster_id: r for r in cluster_inputs(df).select("*", text.truncate("text", most).alias("shown")).collect()}
    for r in cluster_inputs(df, most).select("*", text.truncate("text", most).alias("shown")).collect():
        assert r.shown == whole[r.cluster_id].shown and r.children_ids == whole[r.cluster_id].children_ids and whole[r.cluster_id].text.startswith(r.text[:most])


def test_mixture_is_one_algorithm_at_every_size(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, [float(c == i % 4) + rng.gauss(0, 0.2) for c in range(5)]) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(3).checkpoint()
    monkeypatch.setattr(tree, "BLOCK", 64)
    got = []
    for most in (50_000, 10):
        monkeypatch.setattr(tree, "LOCAL_ROWS", most)
        got.append(sorted(map(tuple, tree.soft_clusters(df, 3, 5).collect())))
    assert got[0] == got[1] and len(got[0]) > 300


def test_mixture_finds_clusters(spark):
    rng = random.Random(2)
    rows = [(i, [float(c == i % 3) + rng.gauss(0, 0.02) for c in range(6)]) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>").checkpoint()
    got = tree.soft_clusters(df, 3).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.cluster_id, set()).add(r.id % 3)
        assert r.p >= 0.5
    assert len(got) == 90 and len(groups) == 3 and all(len(g) == 1 for g in groups.values())
    assert {r.cluster_id for r in tree.soft_clusters(df.limit(4), 3).collect()} == {0}


def test_graph(spark):
    found = spark.createDataFrame([("A", "t1", "d1", "s", "c1", 1), ("A", "t2", "d2", "s", "c2", 2), ("B", None, "d3", "s", "c1", 3), ("C", "t", "d", "s", "c", 4)], "name string, type string, description string, source string, chunk_id string, seq int")
    e = graph.merge_entities(found)
    assert {r.name: (r.type, r.description) for r in e.collect()}["A"] == ("t2", "d1 | d2")
    rel = spark.createDataFrame([("A", "B", "knows", None, 1), ("A", "B", "knows", 9, 2), ("A", "Z", "x", 1, 3), ("B", "A", "y", None, 4)], "source string, target string, description string, strength int, seq int")
    r = graph.merge_relations(rel, e)
    assert sorted(tuple(x) for x in r.collect()) == [("A", "B", "knows", 9), ("B", "A", "y", 5)]
    near = graph.neighbourhood(graph.search_entities(e, "a"), r)
    assert [x.strength for x in near.collect()] == [9, 5]
    assert graph.format_context(near).first()[0] == "Knowledge graph context:\n**A** (t2): d1 | d2\n  -> knows -> **B** (strength: 9/10)\n  -> y -> **B** (strength: 5/10)"


def test_reach(spark):
    """Against a search node by node: cycles, loops, several parents, repeated links, nulls, bounded levels."""
    rng = random.Random(4)
    links = [(rng.randint(0, 30), rng.randint(0, 30)) for _ in range(40)] + [(1, 1), (2, 3), (3, 2), (2, 3), (None, 5), (5, None)]
    seeds = [0, 2, 5, 5, 99, None]
    for up, most in ((False, None), (True, None), (False, 2), (True, 1), (False, 0)):
        want = set()
        for s in {x for x in seeds if x is not None}:
            seen, now, d = {s: 0}, [s], 0
            while now and (most is None or d < most):
                d += 1
                now = [y for y in {(a if up else b) for a, b in links if a is not None and b is not None and (b if up else a) in now} if y not in seen]
                seen |= dict.fromkeys(now, d)
            want |= {(s, x, k) for x, k in seen.items()}
        got = graph.reach(spark.createDataFrame(links, "parent_id int, id int"), spark.createDataFrame([(x,) for x in seeds], "id int"), up, most).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_extraction(spark):
    """Leaves alone; failures and unreadable answers are errors of their chunk; nested answers become rows."""
    from quarrystone.operators import extract

    class Scripted:
        def complete(self, prompt):
            said = prompt.partition("\n")[2]
            if said == "fail":
                raise RuntimeError("busy")
            return {
                "good": '{"entities": [{"name": " Ann ", "type": "p", "description": "d"}, {"name": "", "type": "x"}, {"type": "y"}, {"name": "Bo"}], "relations": [{"source": "Ann", "target": "Bo", "description": "knows", "strength": 7}, {"source": "Ann"}]}',
                "part": '{"entities": null}', "other": '{"entities": "text"}', "broken": "{not json", "silent": " ", "list": "[]",
            }[said]

    rows = [(t, i, 0, "s", t) for i, t in enumerate(("good", "part", "other", "broken", "silent", "list", "fail"))] + [("up", 9, 1, "s", "good")]
    found = extract.extract(spark.createDataFrame(rows, "id string, seq int, level int, source string, original_text string"), Scripted())
    assert sorted((r.name, r.type, r.description, r.source, r.chunk_id, tuple(r.seq)) for r in found.entities.collect()) == [("Ann", "p", "d", "s", "good", (0, 0)), ("Bo", None, None, "s", "good", (0, 3))]
    assert [(r.source, r.target, r.description, r.strength, r.chunk_id) for r in found.relations.collect()] == [("Ann", "Bo", "knows", 7, "good")]
    assert {r.chunk_id: r.error for r in found.errors.collect()}.items() >= {"broken": "unreadable answer", "silent": "no answer", "fail": "no answer", "other": "unreadable answer"}.items()
    assert not {r.chunk_id for r in found.errors.collect()} & {"good", "part"}


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_names_alike(spark, percent):
    from quarrystone.operators import extract

    rng = random.Random(percent)
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randint(1, 14))) for _ in range(60)]
    names = base + [b[:i] + rng.choice("xyz") + b[i:] for b in base for i in (0, len(b) // 2)] + [b.upper() for b in base[:20]] + [None, "", " "]
    mentions = names + names[70:90] * 2

    def cut3(x):
        x = "\x02\x02" + " ".join(x.split()).lower() + "\x03"
        return {x[i : i + 3] for i in range(len(x) - 2)}

    known = sorted({n for n in names if n is not None})
    sets = {n: cut3(n) for n in known}
    want = {(a, b) for a in known for b in known if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
    df = spark.createDataFrame([(n,) for n in mentions], "name string")
    assert {tuple(r) for r in extract.alike(df, percent).collect()} == want and want
    often = {n: sum(m == n for m in mentions) for n in known}
    near = {n: [n] + [b for a, b in want if a == n] + [a for a, b in want if b == n] for n in known}
    assert {r.name: r.canonical for r in extract.canonical(df, percent).collect()} == {n: min(near[n], key=lambda x: (-often[x], x)) for n in known}


def test_dense_many_agrees_with_one(spark):
    """Blocks with and without queries, zero and null vectors and queries, ties, repeated vectors: both functions, bit for bit."""
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    same = e.where("id = 3").first().embedding
    odd = spark.createDataFrame([(i, same) for i in range(1040, 1000, -1)] + [(2000, [0.0] * 64), (2001, None), (2002, [float("nan")] * 64)], "id long, embedding array<float>")
    e = e.unionByName(odd).repartition(5)
    asked = {7: e.where("id = 7").first().embedding, 8: e.where("id = 8").first().embedding, 9: same, 10: [0.0] * 64, 11: [-x for x in same]}
    q = spark.createDataFrame([*asked.items(), (12, None)], "query_id int, vector array<float>")
    many = {(r.query_id, r["rank"]): (r.id, r.score) for r in retrieval.dense_topk_many(e, q, 5).collect()}
    for block_bytes in (600, 100):
        assert many == {(r.query_id, r["rank"]): (r.id, r.score) for r in retrieval.dense_topk_many(e, q, 5, block_bytes=block_bytes).collect()}
    assert len(many) == 20 and [many[9, k][0] for k in range(1, 6)] == [3, 1001, 1002, 1003, 1004]
    for i, v in asked.items():
        assert [many[i, k + 1] for k in range(5 if i != 10 else 0)] == [tuple(r) for r in retrieval.dense_topk(e, v, 5).collect()]
    assert retrieval.dense_topk_many(e, q.where("query_id < 0"), 5).collect() == retrieval.dense_topk_many(e.where("id < 0"), q, 5).collect() == []


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 30))
    rows = [(i, (centres[rng.integers(40)] + 0.5 * rng.normal(size=30)).astype(np.float32).tolist()) for i in range(3000)]
    rows += [(3000 + i, rows[50][1]) for i in range(700)] + [(4000, [0.0] * 30), (4001, None), (4002, [float("nan")] * 30)]
    return spark.createDataFrame(rows, "id long, embedding array<float>").repartition(4).checkpoint()


def test_vector_index(spark, vectors, tmp_path):
    model = vector_index.fit(vectors, width=5)
    index = vector_index.write(vector_index.place(vectors, model), str(tmp_path / "index"))
    assert index.count() == 3700 and len(model.centres) == 61 and model.probes < 40
    assert len(index.where(F.col("cell") == index.where("id = 50").first().cell).inputFiles()) >= 1
    q = vectors.where("id % 50 = 0 or id > 3999").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    rows = lambda df: {(r.query_id, r["rank"]): (r.id, r.score) for r in df.collect()}
    want = rows(retrieval.dense_topk_many(vectors, q, 10))
    got = rows(vector_index.search(index, model, q, 10))
    near = lambda x, i: {v[0] for k, v in x.items() if k[0] == i}
    asked = {i for i, _ in want if want[i, 10][1] < 0.9999}  # the others have more equal neighbours than ten
    recall = sum(len(near(want, i) & near(got, i)) for i in asked) / (10 * len(asked))
    assert len(asked) > 50 and recall >= 0.9
    assert all(dict(want.values()).get(v[0], v[1]) <= 1.0000001 for v in got.values())
    assert rows(vector_index.search(index, model, q, 10, exact=True)) == want
    assert rows(vector_index.search(index, model, q, 10, exact=True, block_bytes=20_000)) == want
    one = vector_index.search(index, model, q.where("query_id = 100"), 10, probes=3)
    assert {v[0] for v in rows(one).values()} <= {r.id for r in index.collect()} and one.count() == 10


def test_vector_index_bounds(spark, vectors):
    model = vector_index.fit(vectors, cells=7, width=8)
    placed = vector_index.place(vectors, model).collect()
    unit = retrieval.unit_rows(np.array([r.embedding for r in placed]))
    cells = np.array([r.cell for r in placed])
    codes = np.array([list(r.code) for r in placed])
    rests = np.concatenate([model.books[g][codes[:, g]] for g in range(codes.shape[1])], axis=1)[:, :30]
    about = unit[:200] @ (model.centres[cells] + rests).T
    assert (np.abs(unit[:200] @ unit.T - about) <= np.array([r.miss for r in placed])[None]).all()
    assert (cells == ((unit[:, None] - model.centres[None]) ** 2).sum(axis=2).argmin(axis=1)).mean() > 0.999


def test_exact_search_lists_k_rows_a_task(spark):
    """Vectors without structure and many copies of one: the bounds rule out nothing, and still no task lists more than k."""
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=24).astype(np.float32).tolist()) for i in range(4000)]
    rows = spark.createDataFrame(rows + [(4000 + i, rows[50][1]) for i in range(3000)], "id long, embedding array<float>").repartition(3).checkpoint()
    model = vector_index.fit(rows, cells=3, width=24, max_train=300)
    placed = vector_index.place(rows, model).checkpoint()
    q = rows.where("id % 100 = 0 or id = 50").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    asked = [tuple(r) for r in q.collect()]
    found = vector_index._bounded(placed, model, [i for i, _ in asked], np.array([v for _, v in asked]), 7, "id", "embedding", q)
    assert found.count() <= 3 * 7 * len(asked)
    near = lambda df: {(r.query_id, r["rank"]): (r.id, r.score) for r in df.collect()}
    assert near(vector_index.search(placed, model, q, 7, exact=True)) == near(retrieval.dense_topk_many(rows, q, 7))


def test_vector_index_of_nothing(spark, vectors):
    none = vectors.where("id > 3999")
    model = vector_index.fit(none)
    q = vectors.where("id < 3").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    assert vector_index.search(vector_index.place(none, model), model, q, 3).collect() == []
    few = vectors.where("id < 3")
    model = vector_index.fit(few)
    index = vector_index.place(few, model)
    assert vector_index.search(index, model, q, 5, probes=99).count() == vector_index.search(index, model, q, 5, exact=True).count() == 9


def test_lexical_blocks(spark):
    """The rows of a full scan, of fewer blocks; common and rare terms, ties, texts without terms, fewer hits than k."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "the of"), *((-10 - i, "zebra crossing") for i in range(9))], "doc_id long, text string")
    docs = docs.unionByName(odd).checkpoint()
    index = lexical_index.blocks(docs, "doc_id", size=8).checkpoint()
    words = [r.token for r in retrieval.postings(docs, "doc_id").groupBy("token").count().orderBy(F.desc("count"), "token").limit(300).collect()]
    assert index.select(F.sum(F.size("keys"))).first()[0] == retrieval.postings(docs, "doc_id").count()
    near = lambda df: [(r.doc_id, round(r.score, 9)) for r in df.collect()]
    for asked, k in ((" ".join(words[:3]), 10), (" ".join(words[250:256]), 10), (f"zebra {words[5]}", 5), ("zebra", 20), ("nowhere", 3), ("", 3), (f"{words[0]} {words[0]} {words[200]}", 40)):
        report = {}
        got = near(lexical_index.topk(index, asked, k, "doc_id", report=report))
        assert got == near(retrieval.lexical_topk(docs, asked, k, "doc_id")), asked
        assert report["read"] <= report["blocks"]
        if asked == " ".join(words[250:256]):
            assert report["read"] < 0.7 * report["blocks"], report
    assert lexical_index.topk(lexical_index.blocks(docs.where("doc_id > 1e9"), "doc_id").checkpoint(), "zebra", 3, "doc_id").collect() == []


def test_resolved_links(spark):
    rows = [(c, h) for c in ("https://x.org", "https://x.org/", "https://x.org/a/b", "https://x.org/a/b/?q=1#f", "http://x.org:80/a//b/c.html;p") for h in ("b.html", "../c", "./d/", "../../../e", "?q=2", "/r/../s", "/", "f/./g/../h", "..", ".", "i;j", "k?x=/../y", "//x.org/z", "https://x.org/abs", "a/..")]
    pages = spark.createDataFrame([(c, f'<a class="x" href="{h}">t</a>') for c, h in rows], "c string, html string")
    got = [r.l for r in pages.select(urls.extract_links("html", "c").alias("l")).collect()]
    plain = lambda u: urlparse(u)._replace(params="", query="", fragment="").geturl().rstrip("/")
    want = [plain(urljoin(c, h)) for c, h in rows]
    assert got == [[w] if urlparse(w).netloc == urlparse(c).netloc else [] for (c, _), w in zip(rows, want, strict=True)]


@pytest.mark.parametrize("short", [0, 4, 32])
def test_candidates_of_names_are_few(spark, short):
    """None is missed, whether sets count as short or long; short names that share a common gram or two don't meet."""
    from quarrystone.operators import extract

    rng = random.Random(2)
    base = ["".join(rng.choice(("ka", "lo", "mi", "ren", "tu", "sa")) for _ in range(rng.randint(2, 5))) for _ in range(900)]
    names = sorted(set(base) | {b + "s" for b in base[:60]} | {b.upper() for b in base[:60]} | {b * 4 for b in base[:20]} | {b * 4 + "x" for b in base[:20]})
    df = spark.createDataFrame([(n,) for n in names], "name string").checkpoint()
    got = {tuple(r) for r in extract.candidates(df, 80, short=short).collect()}
    of = {r.name: set(r.g) for r in df.select("name", extract.grams("name").alias("g")).collect()}
    want = {(a, b) for a in names for b in names if a < b and 5 * len(of[a] & of[b]) >= 4 * len(of[a] | of[b])}
    assert want and want <= got
    if short == 32:
        assert len(got) < 4 * len(want), (len(got), len(want))


def test_mixtures_take_each_block_once_a_round(spark):
    """A spread fit reads every block once for each start and each round, not again to sort what comes back."""
    import numpy as np
    from quarrystone.operators import tree

    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.2, size=(120, 3)) for c in (-2, 0, 2)])
    rows = [(b, np.arange(b, 360, 3).astype("<i8").tobytes(), x[b::3].tobytes()) for b in range(3)]
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    frame = spark.createDataFrame(rows, "block int, keys binary, x binary").repartition(3).checkpoint()
    spread = tree._fit_spread(tree.Mixtures([2, 3], 1), frame.mapInArrow(counted, frame.schema), 3)
    local = tree._fit_local(tree.Mixtures([2, 3], 1), [(np.arange(b, 360, 3), x[b::3]) for b in range(3)], 3)
    assert spread.likelihood == local.likelihood and spread.turn == local.turn
    assert seen.value == 3 * (3 + spread.turn)
    # the quadratic forms give the densities
    k = 3
    share, mean, chol = spread.models[k]
    z = np.stack([np.linalg.solve(c, (x - m).T) for m, c in zip(mean, chol, strict=True)])
    plain = np.log(share)[:, None] - 0.5 * (3 * np.log(2 * np.pi) + (z**2).sum(axis=1)) - np.stack([np.log(np.diag(c)).sum() for c in chol])[:, None]
    assert np.allclose(tree.squares(x) @ spread.forms(k), plain.T)


def test_translation_keeps_repeated_rows_and_long_texts(spark):
    from quarrystone.operators.providers import LeadingWords, translate

    rows = [(1, "one two", "a"), (1, "one two", "a"), (2, None, "b"), (3, "", "c"), (3, "", "c"), (4, "w " * 50_000, "d")]
    out = translate(spark.createDataFrame(rows, "id int, text string, _i string"), LeadingWords(2), size=1000)
    assert out.columns == ["id", "text", "_i"]
    assert sorted((r.id, r.text, r._i) for r in out.collect() if r.id != 2) == [(1, "one two", "a"), (1, "one two", "a"), (3, "", "c"), (3, "", "c"), (4, "\n".join(["w w"] * 100), "d")]


def test_json(spark):
    assert json.loads(spark.range(1).select(text.to_json_pretty(F.struct(F.lit(1).alias("a")))).first()[0]) == {"a": 1}


def test_words_are_counted_in_parts(spark, monkeypatch):
    """A batch of many long rows is handled in parts, whose rows are those of the whole."""
    import pyarrow as pa
    import pyarrow.compute as pc
    from quarrystone.functions import batches, tokens

    lists = pa.array([["a"] * 5, None, [], ["b"] * 20, ["c"], ["d"] * 3], pa.list_(pa.string()))
    assert list(batches.parts(lists, 8)) == [(0, 3), (3, 4), (4, 6)] and list(batches.parts(lists.slice(3), 30)) == [(0, 3)]
    seen = []
    monkeypatch.setattr(tokens.pc, "list_value_length", lambda x, plain=pc.list_value_length: seen.append(plain(x)) or seen[-1])
    rows = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array([[f"w{i % 7}", "words", "word"] * 4000 for i in range(60)]), pa.array([12_000] * 60, pa.int32())], names=["id", "w", "n"])
    kept = {}
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, run, schema: kept.setdefault("run", run))
    tokens.stem_counts(spark.createDataFrame([], "id long, w array<string>, n int"), "id", "w", "n")
    out = pa.Table.from_batches(kept["run"]([rows])).to_pylist()
    assert sorted((r["id"], r["token"], r["tf"]) for r in out) == sorted([(i, f"w{i % 7}", 4000) for i in range(60)] + [(i, "word", 8000) for i in range(60)])
    assert max(pc.sum(x).as_py() for x in seen[1:]) <= batches.ELEMENTS and len(seen) > 2


def test_pieces_are_encoded_in_parts(monkeypatch):
    """A batch's numbers and texts are those of its parts, rows without any included; what is kept stays bounded."""
    import pyarrow as pa
    from quarrystone.functions import bpe

    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"abc": 257}
    own, texts = RankedBPE(ranks), ["abcab", None, "", "xabc", "ab" * 9, "c"]
    lists = pa.array([None if t is None else [t[i : i + 4] for i in range(0, len(t), 4)] for t in texts], pa.list_(pa.string()))
    asked = []
    monkeypatch.setattr(bpe, "parts", lambda x, _=0, plain=bpe.parts: asked.append(list(plain(x, 2))) or asked[-1])
    numbers = own.of_lists(lists)
    assert numbers.type == pa.list_(pa.int32()) and len(asked[0]) > 2
    assert numbers.to_pylist() == [None if t is None else [n for i in range(0, len(t), 4) for n in merged(t[i : i + 4].encode(), ranks)] for t in texts]
    assert own.of_numbers(numbers).to_pylist() == texts and len(asked[1]) > 2
    assert own.of_lists(lists.slice(0, 0)).to_pylist() == own.of_numbers(numbers.slice(0, 0)).to_pylist() == []


def test_descriptions_move_once(spark):
    """Merged entities are those of resolved mentions, and only mentions of names with a like one are shuffled again."""
    from quarrystone.operators import extract, graph

    names = ["Clockmakersdaughters", "Clockmakersdaughter", "Clockmakersdaughterss", "Miller", "Weaver", "Potter", "Candlestickmakers", "Candlestickmaker"]
    rows = [(names[i % 8], "t" if i % 3 else "u", None if i % 7 == 0 else f"said {i}", f"s{i % 5}", f"c{i // 4}", (i // 4, i % 4)) for i in range(400)]
    df = spark.createDataFrame(rows, "name string, type string, description string, source string, chunk_id string, seq struct<seq:int,pos:int>").checkpoint()
    found = extract.Extracted(df, df.select(F.col("name").alias("source"), F.col("name").alias("target")), df.limit(0))
    want = {tuple(r) for r in graph.merge_entities(extract.resolved(found).entities).collect()}
    got = extract.merged(found)
    assert {tuple(r) for r in got.collect()} == want and len(want) < 8
    ran = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    made = [line for line in ran.splitlines() if " Exchange hashpartitioning" in line and "Reused" not in line]
    assert len(made) == 2 and "ReusedExchange" in ran and "Join" not in ran


def test_lexical_blocks_move_documents_once(spark):
    """Documents are dealt to ranges of length as one row each, and the blocks' rows stay where they are built."""
    docs = spark.createDataFrame([(i, " ".join(f"word{i * j % 17}" for j in range(1 + i % 9))) for i in range(60)], "doc_id long, text string")
    index = lexical_index.blocks(docs, "doc_id", size=4)
    plan = index._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "RepartitionByExpression [_n" in plan
    rows = index.collect()
    terms = {(r.doc_id, r.token): r.weight for r in retrieval.postings(docs, "doc_id").collect()}
    assert {(k, r.token): w for r in rows for k, w in zip(r["keys"], r.weights, strict=True)} == terms
    assert all(r.top == max(r.weights) and len(r["keys"]) <= 4 for r in rows)

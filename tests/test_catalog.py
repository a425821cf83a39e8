"""Every query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest
from quarrystone import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: round(v, 9) if isinstance(v, float) and not math.isnan(v) else v
    return sorted(columns), sorted((tuple(clean(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, db, name):
    df = catalog.queries()[name](spark, DATA)
    rows = [tuple(r) for r in df.collect()]
    assert rows or name == "multi_assigned"
    if name in catalog.oracle_sql():
        cur = db.execute(catalog.oracle_sql()[name])
        want = plain(cur.fetchall(), [d[0] for d in cur.description])
        assert plain(rows, df.columns) == want


def test_queries_without_sql(spark, db):
    """Against plain Python over the whole tables: links, cleaned pages, pieces, one level of clusters, the graph's context."""
    from urllib.parse import urljoin, urlparse

    from quarrystone.functions import html, urls
    from quarrystone.operators.chunking import recursive_split

    run = lambda name: [tuple(r) for r in catalog.queries()[name](spark, DATA).collect()]
    pages = db.execute("SELECT page_id, url, html FROM pages").fetchall()
    assert sorted(run("clean_text")) == sorted((i, html.clean_page(h)) for i, _, h in pages)
    links = set()
    for _, url, h in pages:
        for href in db.execute("SELECT regexp_extract_all(?, '<a [^>]*href=\"([^\"]*)\"', 1)", [h]).fetchone()[0]:
            if href.startswith("#"):
                continue
            p = urlparse(urljoin(url, href.replace("&amp;", "&")))
            path = p.path.lower()
            if p.netloc in ("", urlparse(url).netloc) and not path.endswith(tuple(urls.SKIP_EXTENSIONS)) and not any(x in path for x in urls.BAD_SEGMENTS):
                links.add((url, p._replace(params="", query="", fragment="", path=p.path.rstrip("/")).geturl()))
    assert sorted(run("discovered_links")) == sorted(links)
    docs = db.execute("SELECT doc_id, text FROM documents").fetchall()
    assert sorted(run("recursive_pieces")) == sorted((d, i, p) for d, t in docs for i, p in enumerate(recursive_split(t, 500, 50)))
    hop = run("one_hop")
    assert run("graph_context")[0][0].count("  -> ") == len(hop) and run("graph_context")[0][0].count("**") == 2 * (len({r[0] for r in hop}) + len(hop))
    sizes = run("gmm_tree")
    n = db.execute("SELECT count(*) FROM embeddings").fetchone()[0]
    assert 0.9 * n <= sum(r[1] for r in sizes) <= n and len(sizes) <= 15 and all(0.5 <= r[2] <= 1 for r in sizes)
    levels = {r[0]: r for r in run("summary_tree")}
    assert sorted(levels) == list(range(len(levels))) and levels[0][3] == 0
    for k in range(1, len(levels)):  # every node of a level below with a parent is in one cluster at a threshold of a half
        assert levels[k][3] == levels[k - 1][2]

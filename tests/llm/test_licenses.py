import re

from quarrystone.llm import licenses as lic


def split(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_base(t):
    w, at, labels = split(t), [], set()
    for p, label in {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}.items():
        p = p.split()
        new = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        at += new
        labels |= {label} if new else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def brute_labels(t):
    """The same rule by nested loops."""
    w, out = split(t), set()
    for label, texts in lic.TEMPLATES.items():
        for x in texts:
            v = split(x)
            n = len(v) - lic.K + 1
            votes = {}
            for i in range(len(w) - lic.K + 1):
                for j in range(n):
                    if w[i : i + lic.K] == v[j : j + lic.K]:
                        votes.setdefault(i - j, []).append(i)
            group, last = [], None
            for d in [*sorted(votes), None]:
                if d is None or last is not None and d - last > lic.SLACK:
                    found = [i for g in group for i in votes[g]]
                    if found and len({i - g for g in group for i in votes[g]}) / n >= lic.COVER and max(found) + lic.K - min(found) <= lic.STRETCH * len(v):
                        out.add(label)
                    group = []
                if d is not None:
                    group.append(d)
                last = d
    return out


def test_scan(spark, awkward, nothing):
    mit = lic.TEMPLATES["mit"][2].split()
    texts = [x for ts in lic.TEMPLATES.values() for x in ts]
    texts += ["word " * 30 + x.upper() + " tail" for x in texts]
    texts += [" ".join(mit[:20] + ["INSERTED"] + mit[22:]), " ".join(mit[:15]), "cc by cc by, CC-BY; mit", "MIT\nLicense apache license", "GNU General Public License " * 3, "lİcense mit lİcense", "K by"]
    df = spark.createDataFrame([(1000 + i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    df = df.unionByName(awkward.select("doc_id", "text", "lang").withColumnRenamed("lang", "labels")).checkpoint()
    rows = {}
    for r in df.collect():
        rows.setdefault(r.doc_id, []).append(r.text)
    got = lic.scan(df).collect()
    assert len(got) == df.count()
    for r in got:
        options = [(*brute_base(t), ) for t in rows[r.doc_id]]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) in options
        if len(rows[r.doc_id]) == 1 and r.doc_id is not None and (r.doc_id >= 1000 or r.n_words < 100):
            t = rows[r.doc_id][0]
            assert set(filter(None, r.labels.split(","))) == brute_labels(t) | set(filter(None, r.base_labels.split(","))), t
        assert 0 <= r.score <= 1 and (r.score > 0) == (r.labels != "")
    for i, label in enumerate(k for k, ts in lic.TEMPLATES.items() for _ in ts):
        assert all(label in r.labels.split(",") for r in got if r.doc_id in (1000 + i, 1000 + i + len(texts[: sum(map(len, lic.TEMPLATES.values()))])))
    assert lic.scan(nothing).collect() == []


def test_no_python(awkward):
    each = lic.texts(awkward)
    for df in (each, lic.matches(each), lic.scan(awkward)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan) and "Cartesian" not in plan


def test_short_notices_in_a_row(spark):
    short = [(label, x) for label, texts in lic.TEMPLATES.items() for x in texts if len(split(x)) <= 12]
    rows = [(100 * k + i, " ".join([x] * k)) for i, (_, x) in enumerate(short) for k in (1, 2, 3, 40)]
    rows += [(9000, "Licensed under CC BY 4.0. " * 2 + "word " * 20 + "Licensed under CC BY 4.0.")]
    got = {r.doc_id: r for r in lic.scan(spark.createDataFrame(rows, "doc_id long, text string").checkpoint()).collect()}
    for i, (label, _) in enumerate(short):
        for k in (1, 2, 3, 40):
            assert label in got[100 * k + i].labels.split(",") and got[100 * k + i].score == 1.0, (label, k)
    assert got[9000].labels == "cc-by,cc-by-4.0"


def test_repeated_rows_and_parts(spark):
    """A share of a notice below COVER is no match, however often its row or the part itself is repeated."""
    isc = lic.TEMPLATES["isc"][0].split()
    part = {p: " ".join(isc[: round(p * len(isc))]) for p in (0.4, 0.55, 0.9)}
    rows = [(i, t) for i, t in enumerate(part.values())]
    rows = rows + [(10 + i, t) for i, t in rows for _ in range(5)] + [(20 + i, " ".join([t] * 3)) for i, t in rows[:2]]
    got = lic.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3).checkpoint()).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.labels == ("isc" if r.doc_id % 10 == 2 else "") and (r.doc_id % 10 != 2 or 0.8 < r.score < 1), r
    one = {r.doc_id: r[1:] for r in got}
    assert all(r[1:] == one[r.doc_id % 10] for r in got if r.doc_id < 20)

"""Nearest neighbours, URL filter, components, queries and the pipeline."""

import random

import numpy as np
import pytest

import corpus_pipeline
from mapfold.llm import ann, components, url_filter
from mapfold.llm.queries import ORACLES, QUERIES
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def brute(x, ids, queries, k):
    out = {}
    for i in queries:
        s = x @ x[i]
        order = [j for j in np.lexsort((ids, -s)) if j != i][:k]
        out[ids[i]] = [ids[j] for j in order]
    return out


def test_ann_recall_ties_and_odd_vectors(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((700, 16)) * r.uniform(0.5, 2, (700, 1))
    x[300:420] = x[300]  # equal vectors
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(701, None, 1), (702, [0.0] * 16, 1), (703, [None] + [1.0] * 15, 1), (704, [float("nan")] * 16, 1), (705, [float("inf")] * 16, 1), (706, [1.0], 1), (0, x[0].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    out = ann.nearest(df, F.col("vec_id") % 20 == 0).collect()
    got = {}
    for q in sorted(out, key=lambda q: q["rank"]):
        got.setdefault(q["query_id"], []).append(q)
    want = brute(x, list(range(700)), range(0, 700, 20), 20)
    assert set(got) == set(want)
    assert np.mean([len({n["vec_id"] for n in got[q]} & set(w)) / 20 for q, w in want.items()]) >= 0.9
    for q, found in got.items():
        assert [n["rank"] for n in found] == list(range(1, len(found) + 1)) and q not in [n["vec_id"] for n in found]
        assert all(abs(n["score"] - x[q] @ x[n["vec_id"]]) < 1e-9 for n in found)
        keys = [(-round(n["score"], 9), n["vec_id"]) for n in found]
        assert keys == sorted(keys)
    tied = [n["vec_id"] for n in got[320] if 300 <= n["vec_id"] < 420]
    assert len(tied) > 5 and tied == list(range(300, 300 + len(tied)))
    assert ann.nearest(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(df.where("vec_id < 3"), F.col("vec_id") % 20 == 0).count() == 2


def test_ann_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 50)
    r = np.random.default_rng(5)
    x = r.standard_normal((600, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = ann.nearest(df, F.col("vec_id") % 20 == 0, 5).collect()
    want = brute(x, list(range(600)), range(0, 600, 20), 5)
    assert np.mean([q["vec_id"] in want[q["query_id"]] for q in out]) >= 0.9 and len(out) == 150


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_ann_ids_of_several_vectors_and_vectors_of_any_size(spark, parts):
    """One list an id, of the best score; vectors near the largest and the smallest doubles."""
    r = np.random.default_rng(9)
    rows = [(i, r.standard_normal(8).tolist()) for i in range(30)] + [(0, r.standard_normal(8).tolist()), (5, r.standard_normal(8).tolist()), (5, r.standard_normal(8).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)
    score = lambda q, c: max(float(np.dot(a, b)) for i, a in rows if i == q for j, b in rows if j == c)
    out = ann.nearest(df, F.col("vec_id") % 20 == 0, 5).collect()
    for q in (0, 20):
        got = sorted((x["rank"], x["vec_id"]) for x in out if x["query_id"] == q)
        assert [k for k, _ in got] == [1, 2, 3, 4, 5]
        assert [v for _, v in got] == sorted((c for c in range(30) if c != q), key=lambda c: -score(q, c))[:5]
    assert len(out) == 10
    for size in (1e200, 1e-200, 1e150):
        big = spark.createDataFrame([(i, (np.array(v) * size).tolist()) for i, v in rows[:30]], df.schema).repartition(parts)
        found = ann.nearest(big, F.col("vec_id") == 0, 5).collect()
        assert len({x["vec_id"] for x in found}) == len(found) == 5
        if size == 1e150:  # products of the others overflow or vanish
            assert [x["vec_id"] for x in sorted(found, key=lambda x: x["rank"])] == sorted(range(1, 30), key=lambda c: -float(np.dot(rows[0][1], rows[c][1])))[:5]


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 150)] + [(r.randint(200, 400), r.randint(200, 400)) for _ in range(150)] + [(7, 7), (1, 0)]
    low = {n: n for e in edges for n in e}
    for _ in range(100):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    linked = {n for a, b in edges if a != b for n in (a, b)}
    out = components.components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {x["node"]: x["root"] for x in out} == {n: low[n] for n in linked} and len(out) == len(linked)


def test_url_rules(spark):
    urls = ["http://A.Example.COM/en/1?x", "https://www.example.com/en/", "http://x.net/es/a", "http://x.net/de/a#f", "http://net", "no url", None, "", "http://b.org/", "ftp://q?://r.com/", "http://notexample.com/en/"]
    pages = spark.createDataFrame([(i, u, "<a href='http://c.org/'>", "r", "h") for i, u in enumerate(urls)] * 2, "page_id long, url string, html string, rule string, host string")
    out = {r["page_id"]: r for r in url_filter.judge_urls(pages).collect()}
    get = lambda i: tuple(out[i][c] for c in ("host", "path", "rule", "verdict"))
    assert get(0) == ("a.example.com", "/en/1", "example.com/en/", "block")
    assert get(1) == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert get(2) == ("x.net", "/es/a", "net/es/", "block") and get(3)[2:] == (None, "block")
    assert get(4)[:3] == ("net", "", None) and get(5) == get(6) == get(7) == ("", "", None, "allow")
    assert get(8)[2:] == (None, "allow") and get(9)[:2] == ("q", "") and get(10)[2] == "com/"
    assert url_filter.judge_urls(pages).count() == 22 and url_filter.judge_urls(pages.where("false")).count() == 0


def test_many_rules_join_by_domain(spark, monkeypatch):
    """The join's rules and verdicts are those of the one expression, ties and rules in a table included."""
    rules = [*url_filter.RULES, ("a.example.com", "/en/1", "allow"), ("a.example.com", "/en/1", "block"), ("org", "", "block"), ("x.net", "/", "allow")]
    urls = ["http://A.Example.COM/en/1?x", "https://www.example.com/en/", "http://x.net/es/a", "http://x.net/de/a#f", "http://net", "no url", None, "http://b.org/", "http://b.org", "http://notexample.com/en/", "http://a..net/es/"]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)] * 2, "page_id long, url string, html string")
    rows = lambda given: sorted(map(tuple, url_filter.judge_urls(pages, given).select("page_id", "host", "path", "rule", "verdict").collect()), key=str)
    want = rows(rules)
    monkeypatch.setattr(url_filter, "INLINE_RULES", 0)
    assert rows(rules) == want and len(want) == 22
    apart = [r for i, r in enumerate(rules) if i != 5]
    assert rows(spark.createDataFrame(apart, "host string, path string, verdict string")) == want


def test_distrust_flows_against_links(spark):
    pages = spark.createDataFrame([(1, "http://bad.net/es/", None), (2, "http://fan.org/", '<a href="http://bad.net/x"><A HREF=http://good.com/>'), (3, "http://good.com/", '<a href="http://friend.org/">'), (4, "http://friend.org/", "")], "page_id long, url string, html string")
    s = {r["host"]: r for r in url_filter.host_scores(pages, url_filter.RULES).collect()}
    assert s["fan.org"]["distrust"] > 0 and s["friend.org"]["trust"] > 0 and s["good.com"]["distrust"] == 0
    v = {r["host"]: r["verdict"] for r in url_filter.judge_urls(pages).collect()}
    assert v == {"bad.net": "block", "fan.org": "block", "good.com": "allow", "friend.org": "allow"}


def test_distrust_reaches_the_end_of_a_long_chain(spark):
    """Against PageRank by matrix: a chain of 12 links to a blocked host, and links without a scheme."""
    hosts = ["bad.net", *[f"h{i}.org" for i in range(12)], "a.com", "b.org", "c.org"]
    links = [(i + 1, i) for i in range(12)] + [(13, 14), (14, 15), (14, 3)]
    html = {a: "".join(f'<a href="//{hosts[b]}/x?u=http://other.org/">' for x, b in links if x == a) for a in range(len(hosts))}
    pages = spark.createDataFrame([(i, f"http://{h}/{'es/' * (i == 0)}", html[i]) for i, h in enumerate(hosts)], "page_id long, url string, html string")
    scores = {r["host"]: r for r in url_filter.host_scores(pages, url_filter.RULES).collect()}
    for kind, seed, flow in (("trust", 13, links), ("distrust", 0, [(b, a) for a, b in links])):
        move = np.zeros((len(hosts), len(hosts)))
        for a, b in flow:
            move[b, a] = 1 / sum(x == a for x, _ in flow)
        for b in np.flatnonzero(move.sum(axis=0) == 0):
            move[seed, b] = 1  # a walk that ends starts again
        want = np.linalg.solve(np.eye(len(hosts)) - 0.85 * move, 0.15 * np.eye(len(hosts))[seed])
        got = np.array([scores[h][kind] if h in scores else 0.0 for h in hosts])
        assert want[12 if kind == "distrust" else 15] > 0 and abs(got - want).max() < 1e-7
    assert {r["host"]: r["verdict"] for r in url_filter.judge_urls(pages).collect()}["h11.org"] == "block"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_sql(spark, name):
    import glob
    import os

    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    a, b = QUERIES[name](spark, SF).toPandas(), c.sql(ORACLES[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    key = lambda d: d[cols].astype(str).replace({"None": "nan", "<NA>": "nan"}).sort_values(cols).reset_index(drop=True)
    assert key(a).equals(key(b))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF).collect()
    ids = {r["doc_id"] for r in out}
    from mapfold.llm.toxicity import toxicity

    calm = {r["doc_id"] for r in toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("score < 0.5").select("doc_id").collect()}
    assert ids <= calm and len(ids) > 0.8 * len(calm)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    groups = {}
    for d in calm:
        groups.setdefault(texts[d], set()).add(d)
    assert all(len(g & ids) <= 1 for g in groups.values())
    spots = {}
    for r in out:
        spots.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in spots.values():
        s.sort()
        assert all(a[0] + a[1] == b[0] for a, b in zip(s, s[1:])) and s[0][0] == 0 and s[-1][0] + s[-1][1] <= 2048


def test_stage_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, SF).dtypes == docs.dtypes
        assert stage(spark, docs.where("false"), SF).count() == 0

"""Embedding links, top-k, url rules and components against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from silt.llm import embdedup, oracle, queries, topk, urlfilter
from silt.llm.common import components

SCHEMA = "vec_id long, embedding array<float>, label int, id long"


def near_vectors(seed=1, groups=12, each=9, dims=64):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(groups):
        base = rng.normal(size=dims)
        for _ in range(each):
            out.append((base + rng.normal(size=dims) * rng.choice([0.01, 0.1, 0.2])).astype(np.float32).tolist())
    out += [out[0]] * 5 + [out[3]] * 2 + rng.normal(size=(150, dims)).astype(np.float32).tolist()
    return out


def brute_links(vectors, threshold):
    x = np.array(vectors, np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= threshold
    np.fill_diagonal(linked, False)
    return linked


@pytest.mark.parametrize("block", [256, 4])
def test_embedding_links(spark, monkeypatch, block):
    monkeypatch.setattr(embdedup, "BLOCK", block)
    vectors = near_vectors()
    odd = [None, [], [0.0] * 64, [1.0, None] * 32, [float("nan")] * 64, [float("inf")] + [1.0] * 63, [1.0, 2.0]]
    rows = [(i, v, 0, 7) for i, v in enumerate(vectors + odd)]
    got = {r["vec_id"]: r for r in embdedup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    assert len(got) == len(rows)
    linked = brute_links(vectors, 0.95)
    want = linked.sum(axis=1)
    found = np.array([got[i]["n_links"] for i in range(len(vectors))])
    assert (found <= want).all() and found.sum() >= 0.98 * want.sum()
    for i in range(len(vectors), len(rows)):
        assert got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"]
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    groups = {}
    for i in range(len(vectors)):
        groups.setdefault(got[i]["component_id"], []).append(i)
    for low, members in groups.items():
        assert low == min(members)


def test_embedding_edge_cases(spark):
    assert embdedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    same = spark.createDataFrame([(i, [1.0, 0.0], 0, 0) for i in range(4)] + [(2, [1.0, 0.0], 0, 0)], SCHEMA)
    assert {(r["n_links"], r["component_id"]) for r in embdedup.near_duplicates(same).collect()} == {(4, 0)}


def shapes():
    """Vectors of several shapes, each with pairs around the threshold."""
    rng = np.random.default_rng(11)
    mean = rng.normal(size=64)
    one_way = mean / np.linalg.norm(mean) * 2.6 + rng.normal(size=(900, 64)) / 8  # around a common mean, few pairs apart
    close = one_way[:300] + rng.normal(size=(300, 64)) * rng.choice([0.01, 0.03, 0.06], size=(300, 1))
    centres = rng.normal(size=(20, 64))
    clustered = centres[rng.integers(0, 20, 900)] + rng.normal(size=(900, 64)) * rng.choice([0.1, 0.2, 0.3], size=(900, 1))
    loose = rng.normal(size=(900, 64))
    pairs = loose[:300] + rng.normal(size=(300, 64)) * rng.choice([0.1, 0.2, 0.3], size=(300, 1))
    flat = rng.normal(size=(900, 64)) * np.geomspace(1, 0.05, 64)
    copies = np.repeat(rng.normal(size=(30, 64)), 30, axis=0)
    return {"one way": np.vstack([one_way, close]), "clustered": clustered, "loose": np.vstack([loose, pairs]), "flat": np.vstack([flat, flat[:300] + rng.normal(size=(300, 64)) * 0.03]), "copies": copies}


@pytest.mark.parametrize("shape", ["one way", "clustered", "loose", "flat", "copies"])
def test_embedding_recall(spark, shape):
    vectors = shapes()[shape].astype(np.float32)
    want = brute_links(vectors, 0.95).sum(axis=1)
    got = embdedup.near_duplicates(spark.createDataFrame([(i, v, 0, 0) for i, v in enumerate(vectors.tolist())], SCHEMA)).toPandas().sort_values("vec_id")["n_links"].to_numpy()
    assert want.sum() > 100 and (got <= want).all() and got.sum() >= 0.97 * want.sum(), got.sum() / want.sum()


def test_pivots_of_one_way_vectors():
    """Vectors around a common mean keep many pivots, so no list holds most of them."""
    rng = np.random.default_rng(2)
    mean = rng.normal(size=64)
    units = mean / np.linalg.norm(mean) * 2.6 + rng.normal(size=(500, 64)) / 8
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    index = embdedup.Index(units, 0.95, 64)
    keys = embdedup.pair_keys(index.describe(units).astype(np.int64))
    assert np.median((units @ units.T)[np.triu_indices(500, 1)]) > 0.8 and len(index.pivots) == 64
    assert np.unique(keys.ravel(), return_counts=True)[1].max() < 250


def brute_top(rows, k):
    ok = {i: [math.floor(64 * float(x)) for x in v] for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)}
    out = {}
    for q in ok:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(ok[q], v, strict=True)), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


@pytest.mark.parametrize("sizes", [(1024, 4096, 256), (2, 7, 3)])
def test_top_k(spark, monkeypatch, sizes):
    monkeypatch.setattr(topk, "QUERIES", sizes[0])
    monkeypatch.setattr(topk, "CANDIDATES", sizes[1])
    monkeypatch.setattr(topk, "CELLS", sizes[2])
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(130, 6)).round(1).astype(np.float32).tolist() + [[0.5] * 6] * 40
    vectors += [None, [float("nan")] * 6, [None] * 6, [float("inf")] * 6, [1.0, 2.0], [3.0, 4.0], [1e7] * 6, [-1e7] * 6, []]
    rows = list(enumerate(vectors))
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in rows] + [(None, [0.5] * 6, 0, 1)], SCHEMA).repartition(3)
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    assert got == {q: v for q, v in brute_top(rows, 20).items() if v}
    assert topk.top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_of_repeated_ids(spark):
    """Rows of one id are rows: each query row is answered by itself, and only that row is no candidate of its own."""
    rng = np.random.default_rng(9)
    same, other = [0.5] * 4, [0.25, -0.5, 1.0, 0.0]
    rows = [(20, same), (20, same), (40, same), (40, other), (60, other)] + [(int(i), v) for i, v in zip(rng.integers(1, 20, 60), rng.normal(size=(60, 4)).round(1).tolist())]
    cells = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows]
    want = []
    for at, (q, x) in enumerate(cells):
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, v, strict=True)), i) for place, (i, v) in enumerate(cells) if place != at)
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:10])]
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], SCHEMA).repartition(3)
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 0, 10).collect())) == sorted(want)


def test_bounds_hold():
    """Every score lies between the bounds that the cells give, and they are far closer than the scores' range."""
    rng = np.random.default_rng(8)
    values, queries = rng.integers(-5000, 5000, (300, 16)), rng.integers(-5000, 5000, (9, 16))
    low, width = np.full(16, -5000), np.full(16, 40)
    cells = ((values - low) // width).astype(np.uint8)
    for q, (rows, lower, apart) in enumerate(topk.scan_block(np.full(9, -1), queries, np.arange(300), np.arange(300), cells, low, width, 300)):
        scores = values[rows] @ queries[q]
        assert len(rows) == 300 and (lower <= scores).all() and (scores <= lower + apart).all() and apart < np.ptp(scores) / 5
    few = topk.scan_block(np.full(9, -1), queries, np.arange(300), np.arange(300), cells, low, width, 5)
    assert all(set(np.argsort(-(values @ q), kind="stable")[:5]) <= set(rows) and len(rows) < 40 for q, (rows, *_) in zip(queries, few, strict=True))


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), h + p, v) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_url_rules(spark, sf):
    urls = [None, "", "x", "://", "http://", "http://EXAMPLE.com/en/7?x", "http://a.example.com/en/", "http://notexample.com/en/71", "http://com/en/", "http://x.com.:80/en/", "http://ex.net/de/8#/en/", "http://example.net/de/8", "a://b.org?/es/", "http://b.org/es/x://y.com/en/", "http://" + "a." * 3000 + "com/en/" + "z" * 5000, "http://É.com/en/é"]
    urls += [r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()] + ["http://a.com/en/"] * 30
    df = spark.createDataFrame([(i, u, "h", "p", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, path string, rule string")
    got = {r["page_id"]: tuple(r)[1:] for r in urlfilter.judge(df, urlfilter.rule_table(spark, queries.URL_RULES)).collect()}
    assert got == {i: brute_rule(u) for i, u in enumerate(urls)}
    none = urlfilter.judge(df, urlfilter.rule_table(spark, queries.URL_RULES).filter("false"), default="block").collect()
    assert len(none) == len(urls) and {r["verdict"] for r in none} == {"block"}


def test_url_rules_of_the_contract(spark):
    """Each rule's word as the contract lists it, in the query's rules and in its SQL."""
    import duckdb

    words = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    assert {h + p: v for v, h, p in queries.URL_RULES} == words
    df = spark.createDataFrame([(i, f"http://{rule}") for i, rule in enumerate(words)] + [(9, "http://a.net/de/1")], "page_id long, url string")
    got = sorted(tuple(r) for r in urlfilter.judge(df, urlfilter.rule_table(spark, queries.URL_RULES)).select("page_id", "rule", "verdict").collect())
    assert got == [(i, rule, verdict) for i, (rule, verdict) in enumerate(words.items())] + [(9, "net/de/", "allow")]
    pages = df.toPandas()  # noqa: F841
    assert sorted(duckdb.sql(oracle.ORACLE["op8_urls"]).project("page_id, rule, verdict").fetchall()) == got


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 180)] + [(5, x) for x in range(20, 60)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(1, 1), (None, 2), (3, None)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_dense_cluster_keeps_its_links(spark):
    """A third of all vectors in one tight cluster must not take up the pivots."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=64)
    vectors = [(base + rng.normal(size=64) * 0.03).astype(np.float32).tolist() for _ in range(300)] + rng.normal(size=(600, 64)).astype(np.float32).tolist()
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in enumerate(vectors)], SCHEMA)
    got = embdedup.near_duplicates(df).toPandas().sort_values("vec_id")["n_links"].to_numpy()
    assert (got == brute_links(vectors, 0.95).sum(axis=1)).all()

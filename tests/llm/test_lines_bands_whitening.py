"""Line dedup, the band join and whitening against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from silt.llm import bandjoin, linededup, queries, whitening

DOCS = "doc_id long, text string, hash long, at int, h string"


def brute_lines(rows, least=10):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(linededup.UPPER, linededup.LOWER))

    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and text is not None and len(key(line)) >= least:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def some_documents():
    rng = random.Random(5)
    pool = [f"line number {i} of many" for i in range(40)] + ["short", "", "   ", "Ünïcode 行 line \U0001f600", "ÄÖÜ äöü ÄÖÜ", "\tLINE number 3 of many \r", "exactly 10"]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.5 else f"own {rng.random()}" for _ in range(rng.randrange(0, 12)))) for i in range(300)]
    rows += [(400 + i, "a line that a third of all has\nand its own " + str(i)) for i in range(200)]
    rows += [(7, "again the same id\nLine number 1 of many"), (7, "again the same id\nLine number 1 of many"), (None, "line number 2 of many\nx"), (None, None), (901, None), (902, ""), (903, "\n"), (904, "repeated here only\nrepeated here only"), (-5, "negative id holds it\nexactly 10"), (905, "negative id holds it\nnegative id holds it\nend")]
    return rows + [(950, "\n".join(f"long text {i % 5000}" for i in range(30_000))), (951, "\n".join(f"long text {i}" for i in range(4000, 9000)))]


@pytest.mark.parametrize("keys", [1 << 18, 7])
def test_kept_lines(spark, monkeypatch, keys):
    monkeypatch.setattr(linededup, "SHARD_KEYS", keys)
    rows = some_documents()
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], DOCS).repartition(3)
    got = linededup.kept_lines(df).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_lines(rows), key=str)


def test_kept_lines_edge_cases(spark):
    empty = spark.createDataFrame([], DOCS)
    assert linededup.kept_lines(empty).count() == 0 and linededup.line_index(empty).count() == 0
    nulls = spark.createDataFrame([(1, None, 0, 0, ""), (2, "", 0, 0, "")], DOCS)
    assert sorted(map(tuple, linededup.kept_lines(nulls).collect())) == [(1, "", 1, 0), (2, "", 1, 0)]


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 70_000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    h, g = rng.integers(-(2**63), 2**63, (2, n), np.int64)
    h[: n // 3] = h[:1].repeat(n // 3) if n else h[:0]  # equal first hashes are told apart by the second
    made = linededup.PerfectHash.of(h, g)
    assert np.array_equal(np.sort(made.number(h, g)), np.arange(n))
    assert len(made.bits) * 8 <= 5 * n + 20 * linededup.RANKED
    other = made.number(*rng.integers(-(2**63), 2**63, (2, 500), np.int64))
    assert ((other >= -1) & (other < max(n, 1))).all()


def test_index_arrays(spark):
    df = spark.createDataFrame([(3, "shared between them\nshared between them\nonly here I am"), (2, "SHARED between them ")], "doc_id long, text string")
    rows = [r for r in linededup.line_index(df).collect()]
    assert sum(r["keys"] for r in rows) == 1
    r = next(r for r in rows if r["keys"])
    assert np.frombuffer(r["owners"], np.int64).tolist() == [2] and np.frombuffer(r["counts"], np.int32).tolist() == [3]


def test_without_slices():
    texts = pa.array(["skipped", "a\nb\nc", "", "x", "p\nq"], pa.large_string())
    at = pa.array([[0], [0, 2], None, [0], [1]], pa.list_(pa.int32()))
    out, counts, dropped = linededup.without(texts.slice(1).take(pa.array(range(4))), at.slice(1))
    assert out.to_pylist() == ["b", "", "", "p"] and counts.tolist() == [3, 1, 1, 2] and dropped.tolist() == [2, 0, 1, 1]


ITEMS = "item_id long, price double, rank int, u long"
LINES = "sale_id long, line_no int, item_id long, quantity int, amount double, p long, copies int"


def brute_band(items, lines, k=5):
    def cent(x):
        return int(np.floor(100 * x + 0.5)) if np.isfinite(x) else None

    told = []
    for sale, line, item, q, amount, *_ in lines:
        if None in (sale, item, q, amount) or q <= 0 or cent(amount) is None:
            continue
        told.append(((2 * cent(amount) + q) // (2 * q), sale, line, item, zlib.crc32(f"{sale},{'' if line is None else line},{item}".encode())))
    out = []
    for item, price, *_ in items:
        p = None if price is None or item is None else cent(price)
        found = [] if p is None else [(abs(u - p), u, s, -(10**30) if n is None else n, i, c) for u, s, n, i, c in told if i != item and (abs(u - p) <= 10 or 1000 * abs(u - p) <= 2 * p)]
        sums = (len(found), sum(x[0] for x in found), sum(x[5] for x in found))
        best = [(r + 1, *(None if y == -(10**30) else y for y in x[:5])) for r, x in enumerate(sorted(found)[:k])] or [(0,) + (None,) * 5]
        out += [(item, *b, *sums) for b in best]
    return out


def some_sales(seed=3, scale=1.0):
    rng = random.Random(seed)
    prices = [round(rng.choice([3.0, 5.0, 9.9, 120.0, 4000.0]) * scale * rng.uniform(0.9, 1.1), 2) for _ in range(60)]
    items = [(i, p, 0, 0) for i, p in enumerate(prices)]
    lines = []
    for s in range(1500):
        i = 0 if s % 3 == 0 else rng.randrange(60)
        q = rng.randrange(1, 50)
        lines.append((s // 2, rng.randrange(1, 4), i, q, round(q * prices[i] * (1 if s % 3 == 0 else rng.uniform(0.97, 1.03)), 2), 0, 0))
    lines += lines[:40] + lines[:5] * 3
    return items, lines


@pytest.mark.parametrize("run", [1 << 18, 50])
def test_band_join(spark, monkeypatch, run):
    monkeypatch.setattr(bandjoin, "RUN", run)
    items, lines = some_sales()
    items += [(5, items[5][1], 1, 1), (5, 77.0, 0, 0), (None, 3.0, 0, 0), (900, None, 0, 0), (901, 1e300, 0, 0), (902, float("nan"), 0, 0), (903, -3.0, 0, 0), (904, 0.0, 0, 0), (905, 1e9, 0, 0)]
    lines += [(None, 1, 1, 1, 3.0, 0, 0), (1, 1, None, 1, 3.0, 0, 0), (1, 1, 1, None, 3.0, 0, 0), (1, 1, 1, 1, None, 0, 0), (1, 1, 1, 0, 3.0, 0, 0), (1, None, 1, 1, 3.0, 0, 0), (1, 1, 1, 1, float("inf"), 0, 0), (2, 2, 2, 2, -6.0, 0, 0), (2, 2, 3, 1, 1e9, 0, 0)]
    got = bandjoin.price_neighbours(spark.createDataFrame(items, ITEMS).repartition(3), spark.createDataFrame(lines, LINES).repartition(4))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_band(items, lines), key=str)


def test_band_join_own_lines(spark):
    """All near lines are the item's own: only further ones of others are left."""
    items = [(1, 100.0, 0, 0), (2, 100.0, 0, 0), (3, 55.0, 0, 0)]
    lines = [(s, 1, 1, 1, 100.0 + (s % 7) / 100, 0, 0) for s in range(400)] + [(1000, 1, 2, 1, 100.2, 0, 0)]
    got = bandjoin.price_neighbours(spark.createDataFrame(items, ITEMS), spark.createDataFrame(lines, LINES))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_band(items, lines), key=str)


def test_band_join_empty(spark):
    items, lines = some_sales()
    none_items, none_lines = spark.createDataFrame([], ITEMS), spark.createDataFrame([], LINES)
    assert bandjoin.price_neighbours(none_items, spark.createDataFrame(lines, LINES)).count() == 0
    got = bandjoin.price_neighbours(spark.createDataFrame(items, ITEMS), none_lines).collect()
    assert len(got) == len(items) and {r["rank"] for r in got} == {0}


def test_price_band_query(spark, sf):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/items.parquet").select("item_id", "price").collect()]
    lines = [tuple(r) for r in spark.read.parquet(f"{sf}/sale_lines.parquet").select("sale_id", "line_no", "item_id", "quantity", "amount").collect()]
    got = queries.op12_price_band(spark, sf).select("item_id", "rank", "gap", "u", "sale_id", "line_no", "line_item_id", "n_pairs", "gap_sum", "lines_crc")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_band(items, lines), key=str)


def test_line_dedup_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = [(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, d in brute_lines(docs)]
    got = queries.op11_line_dedup(spark, sf).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def brute_whitening(vectors, most=16):
    x = np.floor(64 * np.array(vectors, np.float32).astype(np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    centred = (n * fit - total) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:most]
    deviation = ((n * x - total) ** 2).sum(axis=1)
    return n, deviation, (n * x - total) / n @ vectors[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def check_whitening(rows, ids, vectors):
    n, deviation, white, explained = brute_whitening(vectors)
    k = white.shape[1]
    got = {}
    for r in rows:
        got.setdefault(r["vec_id"], []).append(r)
    assert set(got) == set(ids)
    signs = np.zeros(k)
    for place, i in enumerate(ids):
        mine = sorted(got[i], key=lambda r: r["component"])[:: sum(j == i for j in ids)]
        assert [r["component"] for r in mine] == list(range(1, k + 1))
        assert all(r["n"] == n and r["deviation"] == deviation[place] and r["identity_error"] <= 1e-9 for r in mine)
        assert np.allclose([r["explained"] for r in mine], explained, rtol=1e-9)
        w = np.array([r["whitened"] for r in mine])
        signs = np.where(signs == 0, np.sign(w) * np.sign(white[place]), signs)
        assert np.allclose(w * signs, white[place], atol=1e-7)


def test_whitening(spark):
    rng = np.random.default_rng(2)
    vectors = (rng.normal(size=(400, 24)) @ rng.normal(size=(24, 24)) * 0.2 + 3).astype(np.float32)
    vectors = np.concatenate([vectors, vectors[:1].repeat(200, axis=0), vectors[5:25]])
    rows = [(i, v.tolist(), 0, 1) for i, v in enumerate(vectors)]
    odd = [(9000, None, 0, 1), (9001, [1.0, None] * 12, 0, 1), (9002, [float("nan")] * 24, 0, 1), (9003, [float("inf")] * 24, 0, 1), (9004, [], 0, 1), (9005, [3e38] * 24, 0, 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, x int, n int").repartition(7)
    check_whitening(whitening.whiten(df, whitening.fit(df)).collect(), list(range(len(vectors))), vectors)


def test_whitening_edge_cases(spark):
    schema = "vec_id long, embedding array<float>"
    empty = spark.createDataFrame([], schema)
    assert whitening.fit(empty) == {} and whitening.whiten(empty, {}).count() == 0
    # one vector, a direction without variance, another length, a null id and a repeated row
    one = spark.createDataFrame([(1, [0.5, 1.0])], schema)
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"]) for r in whitening.whiten(one, whitening.fit(one)).collect()] == [(1, 0, 0.0, 0.0)] * 2
    flat = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (None, [2.0, 1.0]), (3, [1.0, 2.0, 3.0])], schema)
    got = whitening.whiten(flat, whitening.fit(flat))
    assert got.count() == 2 * 4 + 3
    assert [abs(round(r["whitened"], 6)) for r in got.filter("component = 1 and vec_id < 3").orderBy("vec_id").collect()] == [1.224745, 0.0, 0.0]
    assert {r["whitened"] for r in got.filter("component = 2 and (vec_id < 3 or vec_id is null)").collect()} == {0.0}


def test_moments_merge():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 64, (1000, 8)) + 1_000_000
    parts = [whitening.Moments.of(p) for p in np.split(x, [1, 2, 300, 999])]
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.merged(p)
    assert merged.n == 1000 and np.array_equal(merged.sums, x.sum(axis=0))
    assert np.allclose(merged.scatter / 1000, np.cov(x.T - 1_000_000, bias=True), rtol=1e-9, atol=1e-9)


def test_whitening_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    got = queries.op13_whitening(spark, sf)
    assert got.filter(F.col("whitened").isNull()).count() == 0
    check_whitening(got.collect(), [r["vec_id"] for r in rows], [r["embedding"] for r in rows])

"""Documents of similar shingle sets against all pairs of whole sets."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from silt.llm import simhash


def word_sets(rows, size=5):
    out = {}
    for i, t in rows:
        w = re.sub(r"[\x20\x09-\x0D]+", " ", "".join(c.lower() if c.isascii() else c for c in t or "")).strip(" ").split(" ")
        out[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))}
    return out


def brute_roots(sets):
    at = {i: i for i in sets}

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    names = sorted(sets)
    near = [(a, b) for k, a in enumerate(names) for b in names[:k] if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    for a, b in near:
        a, b = sorted((root(a), root(b)))
        at[b] = a
    return near, {i: root(i) for i in sets}


def test_near_copies_go_with_the_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    near, roots = brute_roots(word_sets([(r["doc_id"], r["text"]) for r in docs.collect()]))
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    got = stage(spark, docs, sf)
    assert near and got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == sorted(i for i, r in roots.items() if i == r)


@pytest.mark.parametrize("block", [512, 3])
def test_links_of_chains_and_hot_shingles(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    line = "this very common line stands in every text of the group and says nothing"
    base = [f"w{k}" for k in range(60)]
    rows = [(n, " ".join([*base[:n], "x", *base[n + 1 :]])) for n in range(30)] + [(100, " ".join(base)), (101, "  ".join(base).upper())]
    rows += [(200 + n, f"{line} {n} and then a{n} b{n}") for n in range(12)] + [(300, "two words"), (301, "Two  words"), (302, ""), (303, None)]
    near, roots = brute_roots(word_sets(rows))
    df = spark.createDataFrame(rows + [(None, "two words"), (300, "two words")], "doc_id long, text string").withColumns({"id": F.lit(0), "ref": F.lit("x"), "fp": F.lit(None).cast("int")})
    got = simhash.similar_documents(df).collect()
    assert len(got) == len(rows) + 1 and {r["doc_id"]: r["component_id"] for r in got} == roots and len(near) > 30
    assert all(r["leads"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert simhash.similar_documents(df.filter(F.lit(False))).count() == 0


def test_many_near_copies_without_their_base(spark):
    """A family whose members are alike only in pairs, beside texts that share most of a passage with all of them."""
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for n in range(80):
        words = list(base)
        for at in rng.choice(120, size=rng.integers(0, 4), replace=False):
            words[at] = f"x{n}"
        rows.append((n, " ".join(words)))
    rows += [(1000 + n, " ".join(base[:60] + [f"y{n}z{k}" for k in range(60)])) for n in range(40)]
    _, roots = brute_roots(word_sets(rows))
    got = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == roots


def handed_on(spark, name):
    """Rows that a MapInArrow of this name has made in the session's queries so far."""
    store, out = spark._jsparkSession.sharedState().statusStore(), 0
    runs = store.executionsList()
    for run in (runs.apply(k).executionId() for k in range(runs.size())):
        nodes, values = store.planGraph(run).allNodes(), store.executionMetrics(run)
        for node in (nodes.apply(k) for k in range(nodes.size())):
            metrics = node.metrics()
            for metric in (metrics.apply(k) for k in range(metrics.size())) if node.desc().startswith(f"MapInArrow {name}(") else ():
                if metric.name() == "number of output rows":
                    out += int(values.getOrElse(metric.accumulatorId(), None).replace(",", "")) if values.contains(metric.accumulatorId()) else 0
    return out


def test_a_pair_is_handed_on_once(spark):
    """Texts that share most of their prefixes and still don't link meet at many shingles."""
    rows = [(n, " ".join(f"x{n}y{k}" if 40 * n <= k < 40 * n + 40 else f"w{k}" for k in range(500))) for n in range(12)]
    near, roots = brute_roots(word_sets(rows))
    before = handed_on(spark, "meet")
    got = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == roots
    assert 0 < handed_on(spark, "meet") - before <= 4 * 66


def test_rows_of_one_id(spark, sf):
    rows = [(1, "one two three four five six", "b"), (1, "one two three four five six", "a"), (1, "another text of the same id", "c"), (2, "another  text of the SAME id", "d"), (None, "no id", "e"), (None, "no id", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = corpus_pipeline.near_duplicate_stage(spark, df, sf).collect()
    assert sorted(r["source"] for r in got) == ["a", "c", "e", "e"]


def test_long_and_repeated_texts(spark):
    long = " ".join(f"word{k % 9973}q{k % 7}" for k in range(120_000))
    rows = [(0, long), (1, long + " end"), (2, "same " * 5000), (3, "same " * 4000)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2}


def test_parity_sketches_differ_in_no_more_bits_than_sets_in_members():
    import numpy as np

    from silt.llm.simhash import parity

    rng = np.random.default_rng(3)
    for n, k in [(0, 0), (1, 1), (50, 6), (400, 90), (3000, 100)]:
        one = np.unique(rng.integers(-(2**63), 2**63, n))
        two = np.unique(np.concatenate([one[k:], rng.integers(-(2**63), 2**63, k)]))
        bits = sum(int(x ^ y).bit_count() for x, y in zip(np.array(parity(one)).view(np.uint64).tolist(), np.array(parity(two)).view(np.uint64).tolist(), strict=True))
        assert bits <= len(np.setxor1d(one, two)) and (bits - len(np.setxor1d(one, two))) % 2 == 0


def test_repeated_phrases(spark):
    """Repeats change how often a shingle stands, not the set: similarity is of sets."""
    base = [f"w{k}" for k in range(200)]
    phrase = "all rights are reserved here".split()
    rows = [(0, " ".join(base + phrase * 3)), (1, " ".join(base + phrase * 200 + ["end"])), (2, " ".join(phrase * 50)), (3, " ".join(phrase * 90 + ["so"])), (4, " ".join(base[:150] + phrase * 400))]
    near, roots = brute_roots(word_sets(rows))
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == roots and roots[1] == 0 and near


def test_short_sets(spark):
    """Pairs of 4 and 5 shingles at exactly 0.8, and others just below, are all found or all left."""
    rows = []
    for n in range(400):
        words = [f"{c}{n}" for c in "abcdefghi"]
        rows += [(10 * n, " ".join(words[:8])), (10 * n + 1, " ".join(words)), (10 * n + 2, " ".join(["z", *words[1:7]])), (10 * n + 3, " ".join(words[2:7]))]
    sets = word_sets(rows)
    want = {}
    for n in range(400):
        _, some = brute_roots({i: sets[i] for i in range(10 * n, 10 * n + 4)})
        want |= some
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and sum(i != r for i, r in want.items()) >= 400

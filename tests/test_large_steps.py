import random

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from silt.functions import text
from silt.operators import context, fts, graph, relations, remember
from silt.plans.catalogue import ORACLE, QUERIES
from silt.sources import tables


def shown(df):
    return df._jdf.queryExecution().toString()


def test_coverage_rounds_as_its_sql_does(spark, tmp_path):
    """Quantities between integers are rounded; of equal ranges beyond a gap none counts."""
    rows = pd.DataFrame({"l_orderkey": [1, 1, 2, 2, 3, 4], "l_linenumber": [1, 2, 1, 2, 1, 2], "l_quantity": [8.6, 3.0, 7.5, 2.0, 2.5, 1.0]}).astype({"l_linenumber": "int32"})
    rows.to_parquet(tmp_path / "lineitem.parquet")
    got = sorted(tuple(r) for r in QUERIES["coverage_islands"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.register("lineitem", rows)
    assert got == sorted(con.sql(ORACLE["coverage_islands"]).fetchall()) == [(1, 13), (2, 8), (3, 2), (4, -1)]
    pd.concat([rows] * 2).to_parquet(tmp_path / "lineitem.parquet")
    assert sorted(tuple(r) for r in QUERIES["coverage_islands"](spark, str(tmp_path)).collect()) == got


def laid_out(rows, room, cold):
    """One session's rows (cursor, tokens, stub_tokens, is_tool, protected), row by row."""
    rows = sorted(rows)
    cost, action = [r[1] for r in rows], ["keep"] * len(rows)
    free = [i for i, r in enumerate(rows) if not r[4]]
    if sum(cost) > room * context.STUB_AT:
        for i in sorted((i for i in free if rows[i][3] and rows[i][1] > rows[i][2]), key=lambda i: (-rows[i][1], i)):
            if sum(cost) > room * (context.COLD_TO if cold else context.STUB_AT):
                cost[i], action[i] = rows[i][2], "stub"
    for share, name in ((context.COMPACT_AT, "compact"), (1.0, "drop")):
        for i in free:
            if sum(cost) <= room * share or (name == "compact" and any(r[4] for r in rows[: i + 1])):
                break
            if action[i] in ("keep", "stub"):
                cost[i], action[i] = 0, name
    return [(r[0], a, sum(cost), sum(cost) > room * context.WARN_AT) for r, a in zip(rows, action, strict=True)]


def test_lay_out_by_running_sums(spark):
    rng = random.Random(8)
    rows = [(s, c, rng.choice([0, 10, 40, 200, 900]), 40, rng.random() < 0.6, rng.random() < 0.3) for s in range(60) for c in range(rng.randrange(1, 25))]
    df = spark.createDataFrame(rows, "session long, cursor long, tokens long, stub_tokens long, is_tool boolean, is_user boolean")
    held = {}
    for r in context.protected(df).collect():
        held.setdefault(r["session"], []).append((r["cursor"], r["tokens"], r["stub_tokens"], r["is_tool"], r["protected"]))
    seen = set()
    for room, cold in ((2000, False), (900, True)):
        out = context.lay_out(df, room, cold)
        got = {(r["session"], r["cursor"], r["action"], r["used"], r["warn"]) for r in out.collect()}
        assert got == {(s, *row) for s, mine in held.items() for row in laid_out(mine, room, cold)}
        assert "InPandas" not in shown(out)
        seen |= {r[2] for r in got}
    assert seen == {"keep", "stub", "compact", "drop"}


def test_tool_rows_are_dealt_by_their_number(spark, sf, monkeypatch):
    before = sorted(tables.tool_rows(spark, sf).collect())
    monkeypatch.setattr(tables, "TASK_ROWS", 200)
    dealt = tables.tool_rows(spark, sf)
    n = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert dealt.rdd.getNumPartitions() == -(-n // 200) and sorted(dealt.collect()) == before


def test_cosine_top_by_blocks(spark):
    """Copies, vectors of two lengths, halves of the last place: as by summing every pair."""
    rng = np.random.default_rng(5)
    base = [rng.normal(size=6) for _ in range(20)]
    vectors = base + [base[3]] * 30 + [v + rng.normal(size=6) * 1e-5 for v in base for _ in range(6)] + [rng.normal(size=4) for _ in range(9)] + [-base[3]]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(900, [1.0, None, 2.0, 0.0, 0.0, 1.0]), (901, [])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    from silt.functions import score

    pairs = df.filter("id % 7 = 3").toDF("qid", "qv").join(df, F.col("qid") != F.col("id"))
    scored = pairs.select("qid", "id", F.round(score.cosine01(F.col("qv"), F.col("vector")), 5).alias("cosine")).filter("cosine is not null")
    want = scored.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("cosine").desc(), "id"))).filter("place <= 5")
    out = fts.cosine_top(df, df.filter("id % 7 = 3"), 5)
    assert sorted(tuple(r) for r in out.collect()) == sorted(tuple(r) for r in want.collect())
    assert "CoGroupsInArrow" in shown(out)


def test_containing_discards_as_sets_meet(spark, monkeypatch):
    """Many sets around one word meet there; those that can't hold each other go in that join, whatever order a sample gives."""
    rng = random.Random(4)
    words = [f"word{i}" for i in range(400)]
    sets = [("p", i, sorted({"shared", *rng.sample(words, 30)})) for i in range(200)]
    sets += [("p", 1000 + i, sorted({*s[2], *rng.sample(words, 10)})) for i, s in enumerate(sets[:40])] + [("q", 2000, sets[0][2])]
    df = spark.createDataFrame(sets, "part string, id long, words array<string>")
    want = {(a, b) for p, a, x in sets for q, b, y in sets if a != b and p == q and set(x) <= set(y) and 5 * len(x) >= 3 * len(y)}
    assert len(want) >= 40
    for sample, common in ((20_000, 200_000), (5, 3)):
        monkeypatch.setattr(remember, "SAMPLE", sample)
        monkeypatch.setattr(remember, "COMMON", common)
        out = remember.containing(df)
        assert {(r["a"], r["b"]) for r in out.collect()} == want and "& ~" in shown(out)


def test_alike_counts_in_blocks(spark, monkeypatch):
    """Word sets of all sizes, copies and near copies, in one block or many: as by comparing all, and no row is shuffled for a pair."""
    rng = random.Random(7)
    names = [f"word{i:03d}" for i in range(300)]
    sets = [sorted({"shared", *rng.sample(names, rng.choice([1, 2, 9, 20, 60]))}) for _ in range(90)]
    sets += [sorted({*s[: len(s) * 4 // 5], *rng.sample(names, max(1, len(s) // 6))}) for s in sets[:60]] + [sets[3]] * 5
    rows = [(f"s{i % 2}", i, " ".join(s)) for i, s in enumerate(sets)] + [("s0", 900, ""), ("s0", 901, None), (None, 902, "shared"), (None, 903, "shared")]
    df = spark.createDataFrame(rows, "scope string, id long, text string")
    for jaccard in (False, True):
        want = set()
        for i, x in enumerate(sets):
            for j in range(i + 2, len(sets), 2):
                a, b = set(x), set(sets[j])
                base = len(a | b) if jaccard else min(len(a), len(b))
                if 5 * len(a & b) >= 3 * base:
                    want.add((f"s{i % 2}", i, j, len(a & b), len(a & b) / base))
        assert len(want) > 40
        for words, cells, sample in ((8_000_000, 4_000_000, 5_000), (200, 50, 10)):
            monkeypatch.setattr(relations, "BLOCK_WORDS", words)
            monkeypatch.setattr(relations, "CELLS", cells)
            monkeypatch.setattr(relations, "SAMPLE", sample)
            out = relations.alike(df, text.distinctive(F.col("text")), jaccard)
            got = [tuple(r) for r in out.collect()]
            assert len(got) == len(want) and set(got) == want
            assert "CoGroupsInArrow" in shown(out) and "Aggregate" not in shown(out)


def test_bm25_sums_where_a_texts_matches_are(spark):
    """A text's matches are dealt once, by the text; no row is shuffled for a query and text but a task's first for each query."""
    rng = random.Random(3)
    words = [f"term{i}" for i in range(30)]
    held = spark.createDataFrame([(i, " ".join(rng.choices(words, k=rng.randrange(1, 40)))) for i in range(300)] + [(900, None)], "id long, text string")
    asked = spark.createDataFrame([(q, " ".join(rng.sample(words, 6))) for q in range(12)], "qid long, query string")
    for stemmer in ("crude", "porter"):
        out = fts.bm25(held, asked, 5, stemmer)
        got = [(r["qid"], r["place"]) for r in out.collect()]
        assert sorted(got) == [(q, p) for q in range(12) for p in range(1, 6)]
        plan = shown(out).split("== Physical Plan ==")[1]
        assert "hashpartitioning(qid" in plan and not any("hashpartitioning(qid#" in x and ", id#" in x for x in plan.splitlines())


def test_small_components_share_walks(spark, monkeypatch):
    """Chains, a cycle and a fork, walked together or a few at a time, and the large ones level by level."""
    links = [(c * 100 + i, c * 100 + i + 1) for c in range(20) for i in range(c % 5 + 1)] + [(5000, 5001), (5001, 5002), (5002, 5000), (5000, 5003)]
    nodes = sorted({n for link in links for n in link}) + [9000]
    under = {n: {c for p, c in links if p == n} for n in nodes}
    want = set()
    for n in nodes:
        seen, queue = {n}, [n]
        while queue:
            fresh = under[queue.pop()] - seen
            seen |= fresh
            queue += fresh
        want |= {(n, m) for m in seen}
    df, roots = spark.createDataFrame(links, "parent long, child long"), spark.createDataFrame([(n,) for n in nodes], "root long")
    for local in (2_000_000, 12):
        monkeypatch.setattr(graph, "LOCAL", local)
        out = graph.below(df, roots)
        got = [tuple(r) for r in out.collect()]
        assert len(got) == len(want) and set(got) == want
        assert "FlatMapCoGroupsInPandas [deal" in shown(out)


def test_same_entity_makes_a_pair_once(spark, monkeypatch):
    """Pairs are made in blocks at their rarest entity: none is grouped, and one that meets in two scopes is one edge, as in SQL."""
    monkeypatch.setattr(relations, "MEETING", 3)
    rng = random.Random(4)
    rows = {(f"s{rng.randrange(2)}", rng.choice("abcdefgh"), rng.randrange(40)) for _ in range(260)} | {(s, n, i) for s in ("s0", "s1") for n in "yz" for i in (50, 51)} | {(None, "y", 52), (None, "y", 53)}
    found = pd.DataFrame([*rows, ("s0", "a", 1)], columns=["scope", "name", "id"])
    out = relations.same_entity(spark.createDataFrame([tuple(r) for r in found.itertuples(index=False)], "scope string, name string, id long"))
    got = sorted((r["src"], r["dst"], round(r["weight"], 9)) for r in out.collect())
    con = duckdb.connect()
    con.register("found", found)
    want = con.sql("WITH r AS (SELECT scope, name, 1 / (1 + ln(1.0 + count(*))) AS w FROM found GROUP BY ALL) SELECT a.id, b.id, round(max(w), 9) FROM found a JOIN found b ON a.scope = b.scope AND a.name = b.name AND a.id < b.id JOIN r ON r.scope = a.scope AND r.name = a.name GROUP BY ALL").fetchall()
    assert len(got) > 300 and got == sorted(want)
    assert "Aggregate" not in shown(out)


def test_entities_hand_on_no_more_than_are_kept(spark):
    """Words that no rule can tag are passed over, and a text's first are chosen before anything is shuffled."""
    rng = random.Random(6)
    pool = "the Paris a/b src/x.rs //no snake_case camelCase ALLCAPS Ünder. end. ...odd.md .env x.y.zz (Quoted) naïve ÉCOLE Paris, This `cargo test` `run` _ / . .. -Dash- 3.14 v2.Beta ﬁN Ab Straße. X ßA".split(" ")
    rows = [("s", i, rng.choice([" ", "\n", "\t "]).join(rng.choice(pool) for _ in range(rng.randrange(0, 60)))) for i in range(300)] + [("s", 900, None), ("s", 901, "x" * 300_000 + "Y"), ("s", 902, "." * 300_000), ("t", 1, "Lyon Paris"), ("s", 5, "Rome Paris a/b")]
    held = spark.createDataFrame(rows, "scope string, id long, text string")
    quoted, plain = F.regexp_extract_all("text", F.lit("`([^`]+)`"), F.lit(1)), F.regexp_replace("text", "`[^`]*`", " ")
    words = F.transform(text.split_words(plain), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}/._\-]+|[^\p{L}\p{N}/._\-]+$", ""))
    is_path = lambda w: (F.contains(w, F.lit("/")) & ~w.startswith("//")) | w.rlike(r"^[^.]*\.[A-Za-z]{2,5}$")
    kind = lambda w: F.when(is_path(w), "path").when(F.contains(w, F.lit("_")) | w.rlike(r"\p{Ll}.*\p{Lu}"), "symbol").when(w.rlike(r"^\p{Lu}.*\p{Ll}"), "proper")
    bare = lambda w: F.lower(F.regexp_replace(w, r"^[^\p{L}\p{N}/.]+|[^\p{L}\p{N}/.]+$", ""))
    every = held.select("scope", "id", F.transform(quoted, lambda q: bare(F.trim(q))).alias("q"), F.transform(F.filter(words, lambda w: F.octet_length(w) >= 2), lambda w: F.struct(bare(w).alias("name"), kind(w).alias("kind"))).alias("w"))
    want = {}
    for r in every.collect():
        tagged = [(q, "command") for q in r["q"] or []] + [(w["name"], w["kind"]) for w in r["w"] or [] if w["kind"]]
        for pos, (name, k) in enumerate((n, k) for n, k in tagged if len(n.encode()) >= 2 and n not in relations.NOT_A_NAME):
            want.setdefault((r["scope"], r["id"]), []).append((pos, name, k))
    best = set()
    for (scope, i), seen in want.items():
        first = {}
        for pos, name, k in sorted(seen, key=lambda x: (x[0], x[2])):
            first.setdefault(name, (pos, name, k))
        best |= {(scope, i, name, k) for _, name, k in sorted(first.values())[:7]}
    out = relations.entities(held, 7)
    got = out.collect()
    assert len(got) == len(best) and {tuple(r) for r in got} == best and len(best) > 1000
    assert shown(out).count("Exchange") == shown(out).count("REPARTITION_BY_COL") > 0


def test_alike_parts_no_text_to_filter_its_sample(spark, monkeypatch):
    """Which texts tell the order of words is decided before any is parted."""
    monkeypatch.setattr(relations, "SAMPLE", 20)
    df = spark.createDataFrame([("s", i, f"own{i} word{i % 150} shared") for i in range(300)], "scope string, id long, text string")
    plans, fetch = [], type(df).toPandas
    monkeypatch.setattr(type(df), "toPandas", lambda self: plans.append(shown(self)) or fetch(self))
    out = relations.alike(df, text.distinctive(F.col("text")), False)
    assert {(r["src"], r["dst"]) for r in out.collect()} == {(i, i + 150) for i in range(150)}
    told = plans[0].split("== Optimized Logical Plan ==")[1].splitlines()
    assert any("split(" in x for x in told) and not any("Filter" in x and "split(" in x for x in told)

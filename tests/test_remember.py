"""Landing in order, contents within contents, and walks, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from silt.functions import text
from silt.operators import graph, landing, remember

NEW = "cid string, at long, scope string, tier string, text string, subject string, predicate string, object string, trigger string, steps array<string>, weight double"
HELD = "id string, observed_at long, scope string, tier string, text string, subject string, predicate string, object string, trigger string, steps array<string>, valid_to long"


def claim(cid, at, said, scope="s", tier="fact", weight=1.0):
    return (cid, at, scope, tier, said, None, None, None, None, None, weight)


def fact(cid, at, subject, predicate, value, weight=1.0, scope="s"):
    return (cid, at, scope, "fact", f"{subject} {predicate} {value}", subject, predicate, value, None, None, weight)


def habit(cid, at, failed, worked, scope="s", weight=1.0):
    trigger = f"when `{failed}` is what you would reach for"
    return (cid, at, scope, "habit", trigger, None, None, None, trigger, [worked], weight)


def old(row, closed=None):
    return (*row[:10], closed)


def plain(spark, new, held):
    """One candidate after another against everything open, without groups, keys or runs."""
    marks = {}
    rows = [(r[0], r[4] or "", r[6]) for r in new + held]
    df = spark.createDataFrame(rows, "id string, t string, p string")
    for r in df.select("id", text.content_hash(F.col("t")).alias("hash"), F.array_sort(text.content_words(F.col("t"))).alias("words"), text.negative(F.col("t")).alias("denied"), text.clause(F.col("t")).alias("clause"), text.lead(F.col("t")).alias("lead"), text.single_valued(F.col("p")).alias("single")).collect():
        marks[r["id"]] = r

    def same(a, b, tier):
        x, y = marks[a], marks[b]
        if x["hash"] == y["hash"]:
            return True
        if tier == "habit" or x["denied"] != y["denied"] or remember.revises(x["clause"], y["clause"]):
            return False
        p, q = set(x["words"]), set(y["words"])
        return bool(p and q) and not (p - q and q - p) and 5 * len(p & q) >= 3 * len(p | q)

    live = [r for r in sorted(held, key=lambda r: (r[1], r[0])) if r[10] is None]
    out = {}
    for c in sorted(new, key=lambda r: (r[1], r[0])):
        cid, _, scope, tier, _, subject, predicate, *_, trigger, steps, weight = c
        m = marks[cid]
        newest = sorted(enumerate(live), key=lambda x: (float("-inf") if x[1][1] is None else x[1][1], x[0]), reverse=True)
        peers = [r for _, r in newest if r[2] == scope and r[3] == tier]
        slot = tier == "fact" and bool(m["single"]) and subject is not None
        in_slot = lambda r: r[3] == "fact" and bool(marks[r[0]]["single"]) and r[5] is not None
        if slot:
            met = next((r for r in reversed(live) if r[2] == scope and r[3] == tier and in_slot(r) and r[5:7] == (subject, predicate)), None)
        else:
            peers = [r for r in peers if not in_slot(r)]
            met = next((r for r in peers if marks[r[0]]["hash"] == m["hash"]), None)
            if met is None and tier == "habit":
                met = next((r for r in peers if trigger.split("`")[1] in r[9]), None)
            elif met is None:
                like = [r for r in peers if same(r[0], cid, tier)]
                share = lambda r: min(len(marks[r[0]]["words"]), len(m["words"])) / max(len(marks[r[0]]["words"]), len(m["words"]))
                met = max(like, key=lambda r: (share(r), -like.index(r))) if like else None
                if met is None and tier == "fact" and m["lead"]:
                    met = next((r for r in [r for r in peers if marks[r[0]]["lead"] == m["lead"]][:8] if remember.revises(marks[r[0]]["clause"], m["clause"])), None)
        if met is None:
            out[cid] = ("added", None, cid)
        elif same(met[0], cid, tier):
            out[cid] = ("reinforced", met[0], met[0])
            continue
        elif slot or weight is None or weight >= 0.5:
            live.remove(met)
            out[cid] = ("superseded", met[0], cid)
        else:
            out[cid] = ("disputed", met[0], cid)
        live.append(c)
    return out


def check(spark, new, held):
    got = remember.actions(spark.createDataFrame(new, NEW).repartition(3), spark.createDataFrame(held, HELD))
    got = {r["cid"]: (r["action"], r["mid"], r["landed"]) for r in got.collect()}
    want = plain(spark, new, held)
    assert got == want, [(k, got.get(k), v) for k, v in want.items() if got.get(k) != v][:5]
    return got


def test_one_batch_in_a_slot(spark):
    held = [old(fact("h1", 1, "svc", "deploy_target", "fly"))]
    new = [fact("a", 10, "svc", "deploy_target", "render"), fact("b", 11, "svc", "deploy_target", "aws"), fact("c", 12, "svc", "deploy_target", "AWS"), fact("d", 13, "svc", "deploy_target", "render", weight=0.1)]
    new += [fact("e", 10, "me", "editor", "vim"), fact("f", 11, "me", "editor", "emacs"), fact("g", 20, "me", "likes", "sushi"), fact("i", 21, "me", "likes", "pizza")]
    got = check(spark, new, held)
    assert got["a"] == ("superseded", "h1", "a") and got["b"] == ("superseded", "a", "b") and got["c"] == ("reinforced", "b", "b")
    assert got["d"] == ("superseded", "b", "d") and got["e"][0] == "added" and got["f"] == ("superseded", "e", "f")


def test_claims_meet_in_other_words_and_revise(spark):
    held = [old(claim("h1", 1, "we deploy the api with fly.io")), old(claim("h2", 2, "we deploy the api with heroku"), 5), old(claim("h3", 3, "never push to main"))]
    new = [claim("a", 10, "We deploy the api with fly.io!"), claim("b", 11, "we deploy the api with render", weight=0.3), claim("c", 12, "we deploy the api with render"), claim("d", 13, "we deploy the api with aws"), claim("e", 14, "push to main"), claim("f", 15, "the api deploy fly.io"), claim("g", 16, "we deploy the api with fly.io", scope="other"), claim("i", 17, "we deploy the api with fly.io", tier="episode")]
    got = check(spark, new, held)
    assert got["a"] == ("reinforced", "h1", "h1") and got["b"][0] == "disputed" and got["c"] == ("reinforced", "b", "b") and got["e"][0] == "added"


def test_habits_undo(spark):
    new = [habit("a", 1, "npm run deploy", "make deploy"), habit("b", 2, "make deploy", "just deploy"), habit("c", 3, "cargo test", "make test"), habit("d", 4, "cargo build", "make build"), habit("e", 5, "make deploy", "just deploy"), habit("f", 6, "make test", "just test", scope="t")]
    got = check(spark, new, [])
    assert got["b"] == ("superseded", "a", "b") and got["d"][0] == "added" and got["e"] == ("reinforced", "b", "b") and got["f"][0] == "added"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_batches(spark, seed):
    rng = random.Random(seed)
    openings = ["we deploy the api with", "the port is", "tests run on", "never use", "use"]
    values = ["fly", "render", "aws lambda", "8080", "9090", "main branch", "old staging box", "flies"]
    made = []
    for i in range(400):
        kind = rng.random()
        name, at = f"r{i:03}", rng.choice([None, rng.randrange(60)]) if kind < 0.02 else rng.randrange(60)
        if kind < 0.25:
            made.append(fact(name, at, rng.choice("ab"), rng.choice(["editor", "likes", "deploy_target"]), rng.choice(["vim", "emacs", "Vim", "nano"]), rng.choice([0.2, 1.0, None])))
        elif kind < 0.35:
            made.append(habit(name, at, rng.choice(["x", "y z", "w"]), rng.choice(["x", "y z", "v"]), weight=rng.choice([0.3, 0.6])))
        else:
            said = f"{rng.choice(['', 'no, ', 'Actually '])}{rng.choice(openings)} {rng.choice(values)}{rng.choice(['', ' now', ', since monday', '!'])}"
            made.append(claim(name, at, said, rng.choice("ss t".replace(" ", "")), rng.choice(["fact"] * 5 + ["episode"]), rng.choice([0.2, 0.5, 1.0, None])))
    made = [r if r[1] is not None else (r[0], -1, *r[2:]) for r in made]
    held = [old(r, rng.choice([None] * 3 + [9])) for r in made[:60]]
    check(spark, made[60:], held)


def test_odd_candidates(spark):
    new = [claim("a", 1, None), claim("b", 2, ""), claim("c", 3, "the the"), claim("d", 4, "the"), claim("e", 5, "word " * 20_000), (("f"), None, None, None, None, None, None, None, None, None, None)]
    got = {r["cid"]: r["action"] for r in remember.actions(spark.createDataFrame(new, NEW), spark.createDataFrame([], HELD)).collect()}
    assert set(got) == set("abcdef") and got["a"] == "added" and got["b"] == "reinforced" and got["e"] == "added"
    assert remember.actions(spark.createDataFrame([], NEW), spark.createDataFrame([old(new[2])], HELD)).count() == 0


def test_runs_of_one_text(spark):
    """A hot text is one row of the fold until another comes between."""
    new = [claim(f"a{i:04}", i, "the port is 1") for i in range(900)] + [claim("b", 450, "the port is 2")]
    got = check(spark, new, [])
    assert got["b"][0] == "superseded" and got["a0451"] == ("superseded", "b", "a0451") and got["a0899"] == ("reinforced", "a0451", "a0451")


def test_land_writes_what_the_batch_did(spark):
    held = [old(fact("h1", 1, "svc", "deploy_target", "fly"))]
    new = [fact("a", 10, "svc", "deploy_target", "render"), fact("b", 11, "svc", "deploy_target", "aws"), claim("c", 12, "the port is 1"), claim("d", 13, "the port is 2", weight=0.2)]
    out = landing.land(spark.createDataFrame(new, NEW), spark.createDataFrame(held, HELD), 99)
    got = {r["id"]: r["valid_to"] for r in out["memories"].collect()}
    assert got == {"h1": 10, "a": 11, "b": None, "c": None, "d": None}
    links = {(r["src"], r["rel"], r["dst"]) for r in out["links"].collect()}
    assert links == {("a", "supersedes", "h1"), ("h1", "contradicts", "a"), ("b", "supersedes", "a"), ("a", "contradicts", "b"), ("d", "contradicts", "c"), ("c", "contradicts", "d")}
    assert {(r["memory"], r["witness"]) for r in out["witnesses"].collect()} == {("a", "a"), ("b", "b"), ("c", "c"), ("d", "d")}


def test_containing(spark):
    rng = random.Random(6)
    sets = [(rng.choice("pq"), f"i{i}", sorted(rng.sample("abcdefghij", rng.randrange(0, 7)))) for i in range(150)]
    sets = list({(p, tuple(w)): (p, i, w) for p, i, w in sets}.values())
    got = {(r["a"], r["b"]) for r in remember.containing(spark.createDataFrame(sets, "part string, id string, words array<string>")).collect()}
    assert got == {(a, b) for p, a, x in sets for q, b, y in sets if a != b and p == q and x and set(x) <= set(y) and 5 * len(x) >= 3 * len(y)}


def brute_below(links, roots):
    under = {}
    for p, c in links:
        under.setdefault(p, set()).add(c)
    out = set()
    for r in roots:
        seen, todo = {r}, [r]
        while todo:
            for c in under.get(todo.pop(), ()):
                if c not in seen:
                    seen.add(c)
                    todo.append(c)
        out |= {(r, n) for n in seen}
    return out


@pytest.mark.parametrize("local", [2_000_000, 0])
def test_below(spark, monkeypatch, local):
    monkeypatch.setattr(graph, "LOCAL", local)
    rng = random.Random(8)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(70)] + [(100 + i, 101 + i) for i in range(12)] + [(7, 7), (1 << 60, 3)]
    roots = [3, 5, 100, 500, 1 << 60]
    df, tops = spark.createDataFrame(links, "parent long, child long"), spark.createDataFrame([(r,) for r in roots] + [(3,), (None,)], "root long")
    want = brute_below(links, roots)
    assert sorted(map(tuple, graph.below(df, tops).collect())) == sorted(want)
    assert sorted(r[0] for r in graph.reached(df, tops).collect()) == sorted({n for _, n in want})
    assert graph.below(df.filter("false"), tops).count() == 5 and graph.below(df, tops.filter("false")).count() == 0


def test_below_reads_its_own_tree(spark):
    """A chain of a thousand links under one root, among ten thousand links of others."""
    links = [(i, i + 1) for i in range(1000)] + [(10_000 + 100 * t + i, 10_001 + 100 * t + i) for t in range(100) for i in range(99)]
    df = spark.createDataFrame(links, "parent long, child long")
    root = spark.createDataFrame([(0,)], "root long")
    assert graph.below(df, root).count() == 1001 and graph.reached(df, root).count() == 1001


def test_lead_clusters_as_one_scope_at_a_time(spark):
    """Groups of connected contents give the leaders that a walk over the whole scope gives."""
    from silt.operators import consolidation

    rng = random.Random(12)
    words = "deploy the api with fly staging never box port push main".split()
    said = [(rng.choice("st"), f"h{i:03}", " ".join(rng.choice(words) for _ in range(rng.randrange(0, 6))), rng.randrange(50), rng.randrange(1, 4)) for i in range(250)]
    df = spark.createDataFrame(said, "scope string, content_hash string, text string, first_seen long, n_sessions long")
    got = {r["content_hash"]: r["leader"] for r in consolidation.lead_clusters(df).collect()}
    marks = {r["content_hash"]: r for r in df.select("content_hash", text.content_words(F.col("text")).alias("w"), text.negative(F.col("text")).alias("no"), text.clause(F.col("text")).alias("c")).collect()}
    want, leaders = {}, {}
    for scope, name, *_ in sorted(said, key=lambda r: (-r[4], r[3], r[1])):
        m = marks[name]
        mine = set(m["w"])
        for lead in leaders.setdefault(scope, []):
            o = marks[lead]
            theirs = set(o["w"])
            if mine and theirs and o["no"] == m["no"] and not (mine - theirs and theirs - mine) and 5 * len(mine & theirs) >= 3 * len(mine | theirs) and not remember.revises(o["c"], m["c"]):
                want[name] = lead
                break
        else:
            want[name] = name
            leaders[scope].append(name)
    assert got == want and len(set(want.values())) < len(want) - 10


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 400)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    at = {}

    def root(x):
        while at.setdefault(x, x) != x:
            x = at[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            at[y] = x
    assert got == {x: root(x) for x in at}


def test_a_group_stays_in_one_task(spark):
    """The same text far apart in time meets itself, whatever joins Spark turns into others at run time."""
    new = [claim(f"{c}{i:02}", at + i, f"text{i} of its own", tier="episode") for i in range(40) for c, at in (("a", 0), ("b", 1000))]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = check(spark, new, [])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(action == "reinforced" for action, *_ in got.values()) >= 40


def test_landing_claims_meets_every_tier(spark, tmp_path):
    """Facts land on facts held and habits on habits: openings are looked up, and what is held is met."""
    from silt.plans.catalogue import QUERIES

    said = {16: "we deploy the api with fly", 4: "we deploy the api with render", 1: "run all tests", 5: "run all tests", 6: "quite another thing"}
    spark.createDataFrame([(i, t, "en", "s") for i, t in said.items()], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["cid"]: (r["action"], r["mid"], r["via"]) for r in QUERIES["landing_claims"](spark, str(tmp_path)).collect()}
    assert got == {4: ("superseded", 16, "revised"), 5: ("reinforced", 1, "text"), 6: ("added", None, None)}

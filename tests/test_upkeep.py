"""Write verbs, the ledger, sessions and offered lines on small rows."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from silt.functions import offered
from silt.operators import relations, sessions, usage, writes


def one(spark, column, t):
    return spark.createDataFrame([(t,)], "t string").select(column.alias("x")).first()["x"]


def ids(rows, column="id"):
    return sorted(r[column] for r in rows.collect())


MEMORY = "id string, tier string, session string, scope string, text string, valid_to long, archived_at long, observed_at long, confirmed_at long, last_accessed long, access_count long, strength double, pinned boolean, privacy string"


def memory(name, tier="fact", session="s1", said="x", valid_to=None, archived_at=None):
    return (name, tier, session, "p", said, valid_to, archived_at, 10, None, 10, 1, 0.4, False, "shared")


def test_small_rules(spark):
    t = F.col("t")
    assert one(spark, offered.alike(t), "  We  USE make!; ") == "we use make"
    assert sorted(one(spark, offered.about(t), "The caches use zq_x and tests, tests")) == ["cache", "test", "zq_x"]
    assert [one(spark, offered.acknowledges(t), q) for q in ("ok, go on!", "ok do it please", "fix it", "", "...")] == [True, False, False, False, False]
    assert one(spark, offered.handle(t), "abcdefghijkl") == "efghijkl" and one(spark, offered.handle(t), "ab") == "ab"
    assert one(spark, offered.day(F.lit(951_782_400)), "") == "2000-02-29" and one(spark, offered.day(F.lit(-1)), "") == "1969-12-31"
    assert one(spark, offered.session_name(F.lit("run-XYZ9"), F.lit(951_782_400)), "") == "0229-xyz9"
    assert one(spark, offered.values_in(t), "we deploy to heroku with PostgreSQL on v2, not by us-east.") == ["heroku", "postgresql", "v2", "us-east"]
    assert one(spark, offered.one_edit(t, F.lit("always")), "alwys") and not one(spark, offered.one_edit(t, F.lit("always")), "alws")
    assert one(spark, offered.bounded_presentation(F.lit("asserted"), F.lit("evidence")), "") == "evidence"
    assert one(spark, offered.stub(F.lit("run"), F.lit(7), t, F.lit("h1"), F.lit(None).cast("string")), None) == "`run` result elided (~7 tokens) — `h1` to see it again"
    assert [one(spark, writes.may_show(t, True, False), p) for p in ("shared", "local", "secret")] == [True, False, False]
    assert one(spark, writes.may_show(t, False, True), "secret") is True
    said = 'a "quoted"\nline'
    row = spark.createDataFrame([(3, "user", None, said)], "c long, r string, tool string, t string")
    want = json.dumps([3, "user", "text", None, said], separators=(",", ":"), ensure_ascii=False)
    assert row.select(offered.fingerprint(F.col("c"), F.col("r"), F.lit("text"), F.col("tool"), F.col("t")).alias("x")).first()["x"] == hashlib.sha256(want.encode()).hexdigest()


def test_lines(spark):
    got = one(spark, offered.line(F.lit("m-12345678"), F.col("t"), F.lit("cost"), F.lit(0), F.lit(2), offered.doubt(F.lit(False), F.lit(0), F.lit(0.1))), " use make ")
    assert got == "- [12345678] use make (learned from a failure, 1970-01-01, 2 runs; weakly witnessed)"


def test_chunks_join_back(spark):
    said = ["", "abc", "é" * 10, "a𝄞b" * 5, "x" * 100, None]
    rows = spark.createDataFrame(list(enumerate(said)), "id long, text string")
    for most in (1, 2, 3, 5, 64):
        got = {}
        for r in sorted(sessions.chunks(rows, most, ["id"]).collect(), key=lambda r: r["offset"]):
            assert len(r["text"].encode()) <= max(most, 4) and (len(r["text"].encode()) <= most or len(r["text"]) == 1)
            assert r["offset"] == len(got.get(r["id"], "").encode())
            got[r["id"]] = got.get(r["id"], "") + r["text"]
        assert got == {i: t for i, t in enumerate(said) if t}


def test_covered(spark):
    rows = spark.createDataFrame([(1, 0, 5), (1, 3, 4), (1, 9, 5), (2, 1, 5), (3, 0, 9), (3, 2, 2), (3, 9, 1)], "k long, offset long, length long")
    assert {r["k"]: r["through"] for r in sessions.covered(rows, ["k"]).collect()} == {1: 7, 2: 0, 3: 10}


def test_sessions(spark):
    held = spark.createDataFrame([("run-aa11", "0102-aa11"), ("run-bb22", "0102-bb22"), ("0102", "0303-cc33")], "id string, name string")
    asked = spark.createDataFrame([("0102-AA11",), ("bb22",), ("0102",), ("0303",), ("zz",), ("run",)], "handle string")
    assert {r["handle"]: r["id"] for r in sessions.resolve(held, asked).collect()} == {"0102-AA11": "run-aa11", "bb22": "run-bb22", "0303": "0102"}


def test_withheld(spark):
    held = spark.createDataFrame([(1, "names start with zq_", "fact", "peer", False), (2, "cache tests run nightly", "fact", "peer", False), (3, "cache is warm", "fact", "peer", False), (4, "zq_ names", "fact", "peer", True)], "id long, text string, tier string, through string, assertable boolean")
    gone = spark.createDataFrame([(7, "every name must start with zq_"), (8, "nightly cache tests"), (9, "cache is warm")], "id long, text string")
    standing = spark.createDataFrame([(1, "the cache is warm")], "id long, text string")
    assert ids(sessions.withheld(held, gone, standing)) == [1, 2]


def test_attach_and_promote(spark):
    held = spark.createDataFrame([memory("a"), memory("b", "scratch", archived_at=3)], MEMORY)
    schema = "memory string, id long, session string, at long"
    said = spark.createDataFrame([("a", 1, "s1", 5)], schema)
    new = spark.createDataFrame([("a", 1, "s9", 90), ("a", 2, "s1", 80), ("a", 3, "s2", 40), ("a", 4, "s2", 70), ("b", 5, "s1", 20)], schema)
    after, kept = writes.attach(held, said, new)
    got = {r["id"]: (r["confirmed_at"], r["strength"]) for r in after.collect()}
    assert got == {"a": (40, 1.0), "b": (20, 1.0)} and ids(kept) == [1, 2, 3, 4, 5]
    moved, _ = writes.promote(held, said, spark.createDataFrame([("b",)], "id string"), "habit", new)
    assert [(r["tier"], r["archived_at"]) for r in moved.filter("id = 'b'").collect()] == [("habit", None)]
    with pytest.raises(ValueError):
        writes.promote(held, said, held, "scratch", new)


def test_updates(spark):
    held = spark.createDataFrame([memory("a"), memory("b", valid_to=4), memory("c", archived_at=2)], MEMORY)
    every = held.select("id")
    assert {r["id"]: r["valid_to"] for r in writes.close(held, every, 9).collect()} == {"a": 9, "b": 4, "c": 9}
    assert {r["id"]: (r["archived_at"], r["tier"]) for r in writes.archive(held, every, 9).collect()} == {"a": (9, "archive"), "b": (9, "archive"), "c": (2, "fact")}
    shown = spark.createDataFrame([("a",), ("a",)], "id string")
    assert {r["id"]: (r["access_count"], r["strength"], r["last_accessed"]) for r in writes.touch(held, shown, 50).collect()}["a"] == (3, 1.0, 50)
    assert ids(writes.pin(held, shown).filter("pinned")) == ["a"]
    links = spark.createDataFrame([], "src string, rel string, dst string")
    pairs = spark.createDataFrame([("b", "a")], "keep string, drop string")
    after, drawn = writes.settle(held, links, pairs, 9)
    assert {r["id"]: r["valid_to"] for r in after.collect()} == {"a": 9, "b": None, "c": None} and drawn.count() == 1
    assert writes.settle(held, drawn, pairs, 9)[1].count() == 1
    both = writes.reconcile(links, pairs.toDF("a", "b"))
    assert {(r["src"], r["dst"]) for r in both.collect()} == {("a", "b"), ("b", "a")}


def test_scratch(spark):
    held = spark.createDataFrame([memory("a", "scratch", "s1", "Use make.")], MEMORY)
    new = spark.createDataFrame([memory("n1", "scratch", "s1", "use make"), memory("n2", "scratch", "s2", "use make"), memory("n3", "scratch", "s2", "Use make!")], MEMORY)
    assert ids(writes.keep_scratch(held, new)) == ["a", "n2"]
    with pytest.raises(ValueError):
        writes.keep_scratch(held, spark.createDataFrame([memory("f")], MEMORY))
    out = writes.carry(held, held, "proj", "fact", 9)
    assert {(r["id"], r["scope"], r["tier"], r["archived_at"]) for r in out.collect()} == {("a", "p", "archive", 9), ("proj:a", "proj", "fact", None)}
    assert writes.uncrossed(out).count() == 0 and ids(writes.uncrossed(held)) == ["a"]
    found = sessions.recurring(spark.createDataFrame([memory("a", "scratch", "s1", "Use make."), memory("b", "scratch", "s2", "use make"), memory("c", "scratch", "s3", "use make")], MEMORY), spark.createDataFrame([("s1", 1), ("s2", 2), ("s3", 3)], "session string, opened long"), 0, newest=2)
    assert [(r["n_sessions"], r["text"]) for r in found.collect()] == [(2, "use make")]


def test_purges(spark):
    held = spark.createDataFrame([memory("a"), memory("b"), memory("c", session="s2"), memory("d")], MEMORY)
    said = spark.createDataFrame([("a", 1, "s1", None), ("b", 2, "s1", None), ("b", 3, "s2", "ext"), ("c", 4, "s2", "ext")], "memory string, id long, session string, domain string")
    out = writes.purge_sessions(held, said, spark.createDataFrame([("s1",)], "session string"), {"turns": said})
    assert {r["id"]: r["session"] for r in out["memories"].collect()} == {"b": None, "c": "s2"}
    assert ids(out["gone"]) == ["a", "d"] and ids(out["witnesses"]) == [3, 4] == ids(out["turns"])
    out = writes.purge_domain(held, said, "ext")
    assert ids(out["memories"]) == ["a", "b", "d"] and ids(out["witnesses"]) == [1, 2]


def test_ledger(spark):
    make = spark.createDataFrame
    ledger = {
        "recall": make([(1, 10), (2, 99)], "id long, at long"),
        "candidate": make([(1, "m", True), (2, "m", False)], "recall long, memory string, selected boolean"),
        "injection": make([(5, 1, 11), (6, 2, 99)], "id long, recall long, at long"),
        "shown": make([(5, "m"), (6, "m")], "injection long, memory string"),
        "action": make([], "id long, injection long, tool string, attribution string, at long"),
        "cited": make([], "action long, memory string"),
        "outcome": make([], "id long, action long, kind string"),
    }
    actions = make([(7, 5, "run", "explicit", 12), (8, 77, "run", "explicit", 12), (9, None, "run", "proximal", 99), (7, 5, "run", "explicit", 12)], ledger["action"].schema)
    after, refused = usage.note_use(ledger, actions, make([(7, "m"), (8, "m")], "action long, memory string"))
    assert ids(after["action"]) == [7, 9] and ids(refused) == [8] and ids(after["cited"], "action") == [7]
    after = usage.note(after, outcome=make([(1, 7, "failed")], "id long, action long, kind string"))
    after = usage.note(after, outcome=make([(1, 7, "succeeded")], "id long, action long, kind string"))
    assert [(r["recall"], r["action"], r["outcome"]) for r in usage.trace(after).collect()] == [(1, 7, "succeeded")]
    assert usage.times_retrieved(after["candidate"]).first()["n_selected"] == 1
    kept = usage.forget_before(after, 50)
    assert {name: rows.count() for name, rows in kept.items()} == {"recall": 1, "candidate": 1, "injection": 1, "shown": 1, "action": 1, "cited": 0, "outcome": 0}
    held = make([("m", "run `Make Test` first"), ("o", "`make test`")], "id string, text string")
    done = make([(7, 5, "RUN make test now"), (8, 5, "make")], "id long, injection long, text string")
    assert [(r["action"], r["memory"]) for r in usage.structural(ledger, held, done).collect()] == [(7, "m")]


def test_entity_recall(spark):
    held = spark.createDataFrame([("p", 1, "see `make test`"), ("p", 2, "src/a.rs and `make test`"), ("p", 3, "src/a.rs"), ("q", 4, "src/a.rs")], "scope string, id long, text string")
    asked = spark.createDataFrame([("p", 9, "why does `make test` touch src/a.rs")], "scope string, qid long, text string")
    entity = relations.entities(held)
    got = {r["id"]: r["entity"] for r in relations.by_entity(entity, asked, held.filter("id <> 3")).collect()}
    import math

    rare = 1 / (1 + math.log(3))
    assert set(got) == {1, 2} and math.isclose(got[1], rare / (rare + 1)) and math.isclose(got[2], 2 * rare / (2 * rare + 1))


def test_entity_recall_of_all_that_is_asked(spark):
    """A query's twelfth entity asks too, and of an entity every memory answers, the six hundredth like the first."""
    names = [f"src/f{n}.rs" for n in range(12)]
    rows = [("p", i, f"see {names[0]}") for i in range(1, 601)] + [("p", 700, f"see {names[-1]}")]
    entity = relations.entities(spark.createDataFrame(rows, "scope string, id long, text string"))
    asked = spark.createDataFrame([("p", 9, " ".join(names)), ("p", 10, "nothing")], "scope string, qid long, text string")
    got = relations.by_entity(entity, asked).collect()
    assert sorted((r["qid"], r["id"]) for r in got) == [(9, i) for i in range(1, 601)] + [(9, 700)]
    assert max(got, key=lambda r: r["entity"])["id"] == 700

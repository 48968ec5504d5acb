"""Commit evidence against a replay of the whole log over everything held, and the log's reader."""

import random
import re

import pytest
from pyspark.sql import functions as F

from silt.operators import commits
from silt.sources import journals

LOG = "scope string, hash string, at long, subject string, removed array<string>, added array<string>, swaps array<struct<file:string,removed:string,added:string>>"
HELD = "scope string, id string, observed_at long, text string"


def words(line):
    return [w for w in (w.strip(".-/").lower() for w in re.split(r"[^\w.\-/]+", line)) if len(w.encode()) >= 2]


def plain(log, held, files):
    """All commits in order over all that is held, each word looked up in the files."""
    texts = {}
    for scope, file, said in files:
        for w in set(words(said)):
            texts[scope, w] = texts.get((scope, w), 0) + 1
    open_ = [(s, i, t, commits.values(t or "")) for s, i, _, t in sorted(held, key=lambda h: (-h[2], h[1]))]
    recorded, out = {}, []
    for scope, name, at, subject, removed, added, swaps in sorted(log, key=lambda c: (c[2], c[1])):
        if m := re.fullmatch(r'Revert "([\s\S]+)"', subject):
            for i in recorded.get((scope, m[1]), []):
                if any(h[0] == scope and h[1] == i for h in open_):
                    open_ = [h for h in open_ if (h[0], h[1]) != (scope, i)]
                    out.append((scope, "reverted", i, None, None))
        for place, (file, gone, came) in enumerate(swaps):
            gone_w, came_w = words(gone), words(came)
            lost = [v for v in gone_w if v not in came_w]
            hit = next((h for h in open_ if h[0] == scope and any(v in lost and (commits.name_like(v) or texts.get((scope, v), 0) <= 3) for v in h[3])), None)
            if hit is None:
                continue
            open_.remove(hit)
            new = [v for v in came_w if v not in gone_w]
            old = next(v for v in hit[3] if v in lost and (commits.name_like(v) or texts.get((scope, v), 0) <= 3))
            said = commits.rewritten(hit[2], old, new[0]) if len(new) == 1 else f"{file} now reads: {came.strip()[:160]}"
            ident = f"commit-{name[:8]}-{place}"
            open_.append((scope, ident, said, commits.values(said)))
            recorded.setdefault((scope, subject), []).append(ident)
            out.append((scope, "replaced", hit[1], ident, said))
        off = []
        for v in (v for line in removed for v in words(line)):
            if v not in off and all(v not in words(line) for line in added):
                off.append(v)
        for v in off:
            hit = next((h for h in open_ if h[0] == scope and v in h[3]), None)
            if hit and texts.get((scope, v), 0) == 0:
                open_.remove(hit)
                out.append((scope, "vanished", hit[1], None, None))
    return sorted(out, key=str)


def run(spark, log, held, files):
    tracked = commits.word_files(spark.createDataFrame(files, "scope string, file string, text string"))
    got = commits.evidence(spark.createDataFrame(log, LOG).repartition(3), spark.createDataFrame(held, HELD), tracked)
    return sorted((tuple(r) for r in got.select("scope", "action", "id", "recorded", "text").collect()), key=str)


def swap(scope, name, at, subject, *swaps, removed=(), added=()):
    return (scope, name, at, subject, [s[1] for s in swaps] + list(removed), [s[2] for s in swaps] + list(added), list(swaps))


def test_renames_removals_and_reverts(spark):
    held = [("r", "m1", 10, "we deploy to fly"), ("r", "m2", 11, "the port is app-8080"), ("r", "m3", 12, "tests use pytest"), ("q", "m4", 13, "we deploy to fly")]
    log = [
        swap("r", "aaaaaaaa1", 100, "Move to render", ("deploy.sh", "target = fly", "target = render")),
        swap("r", "bbbbbbbb1", 101, "New port", ("app.py", "PORT = app-8080", "PORT = app-9090, host-b")),
        swap("r", "cccccccc1", 102, "Drop the tests", removed=["pytest -q"]),
        swap("r", "dddddddd1", 103, "To aws", ("deploy.sh", "target = render", "target = aws")),
        swap("r", "eeeeeeee1", 104, 'Revert "To aws"', ("deploy.sh", "target = aws", "target = render")),
        swap("r", "ffffffff1", 105, "Words", ("README", "the and", "the or")),
    ]
    files = [("r", "deploy.sh", "target = render"), ("r", "app.py", "PORT = app-9090, host-b")]
    got = run(spark, log, held, files)
    assert got == plain(log, held, files)
    assert {(a, i) for _, a, i, *_ in got} == {("replaced", "m1"), ("replaced", "m2"), ("vanished", "m3"), ("replaced", "commit-aaaaaaaa-0"), ("reverted", "commit-dddddddd-0")}
    assert ("r", "replaced", "m1", "commit-aaaaaaaa-0", "we deploy to render") in got


def test_vocabulary_is_no_value(spark):
    held = [("r", "m1", 10, "we deploy to make"), ("r", "m2", 9, "use node_modules")]
    log = [swap("r", "aaaaaaaa1", 100, "x", ("f", "run make", "run just")), swap("r", "bbbbbbbb1", 101, "y", ("g", "a node_modules", "a vendor_dir"))]
    files = [("r", f"f{i}", "make node_modules") for i in range(4)]
    got = run(spark, log, held, files)
    assert got == plain(log, held, files) and [i for _, _, i, *_ in got] == ["m2"]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_logs(spark, seed):
    rng = random.Random(seed)
    pool = ["fly", "render", "aws", "app-1", "app-2", "v1.2", "v1.3", "Node", "make", "the", "target", "port", "srv_a", "srv_b", "pytest"]
    line = lambda: " ".join(rng.choice(["use", "to", "=", "with", ""]) + " " + rng.choice(pool) for _ in range(rng.randrange(1, 4)))
    held = [(rng.choice("rq"), f"m{i:02}", i % 7, f"we {line()}") for i in range(25)]
    log = []
    for i in range(60):
        subject = rng.choice(["one", "two", "three", 'Revert "one"', 'Revert "two"', f"n{i}"])
        log.append(swap(rng.choice("rq"), f"{i:08x}z", i // 2, subject, *[(f"f{rng.randrange(3)}.py", line(), line()) for _ in range(rng.randrange(0, 3))], removed=[line() for _ in range(rng.randrange(0, 2))], added=[line() for _ in range(rng.randrange(0, 2))]))
    files = [(rng.choice("rq"), f"f{i}", line()) for i in range(8)]
    assert run(spark, log, held, files) == plain(log, held, files)


def test_nothing_to_read(spark):
    held = [("r", "m1", 10, None), ("r", "m2", 10, "we deploy to fly")]
    assert run(spark, [], held, []) == [] and run(spark, [swap("r", "aaaaaaaa1", 1, None or "", ("f", "to fly", ""))], [], []) == []
    assert run(spark, [swap("r", "aaaaaaaa1", 1, "s", ("f", "to fly", ""))], held, []) == [("r", "replaced", "m2", "commit-aaaaaaaa-0", "f now reads: ")]


def test_values_agree_with_columns(spark):
    said = ["we deploy to fly.io and use Make", "port 8080 on app-1, v2", "a/b.c -x- src/Main.rs", "to a to ab to abc", "Größe mit Ünder-x", ""]
    df = spark.createDataFrame([(s,) for s in said], "t string")
    from silt.functions import offered

    assert [r[0] for r in df.select(offered.values_in(F.col("t"))).collect()] == [commits.values(s) for s in said]


def test_log_reader(spark, tmp_path):
    diff = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1 +1 @@ def f\n-old = 1\n+new = 1\n@@ -5,2 +5 @@\n-a\n-b\n+c\ndiff --git a/y b/y\ndeleted file mode\n--- a/y\n+++ /dev/null\n@@ -1 +0,0 @@\n-gone\ndiff --git a/p b/q\nrename from p\nrename to q\n"
    (tmp_path / "log").write_text(f"\x1eh1\x1f12\x1fSubject one\n\n{diff}\x1eh2\x1f13\x1fRevert \"Subject one\"\n")
    got = {r["hash"]: r for r in journals.commits(spark, str(tmp_path / "log")).collect()}
    assert [tuple(s) for s in got["h1"]["swaps"]] == [("x.py", "old = 1", "new = 1")]
    assert got["h1"]["removed"] == ["old = 1", "a", "b"] and got["h1"]["added"] == ["new = 1", "c"] and got["h2"]["swaps"] == []


def test_commit_evidence_query(spark, sf):
    from silt.plans import distil_queries

    log, held, files = distil_queries.city_log(spark, sf)
    log = [(*r[:6], [tuple(s) for s in r["swaps"]]) for r in log.select("scope", "hash", "at", "subject", "removed", "added", "swaps").collect()]
    want = plain(log, [tuple(r) for r in held.collect()], [tuple(r) for r in files.collect()])
    got = distil_queries.commit_evidence(spark, sf).select("scope", "action", "id", "recorded", "text").collect()
    assert sorted(map(tuple, got), key=str) == want and {r["action"] for r in got} >= {"replaced", "vanished"}


def test_lines_are_parted_once(spark):
    """What follows the parting of lines reads what it found: no step parts them again."""
    held = [("r", "m1", 10, "we deploy to fly"), ("r", "m2", 11, "the port is app-8080")]
    log = [swap("r", "aaaaaaaa1", 100, "Move", ("deploy.sh", "target = fly", "target = render")), swap("r", "bbbbbbbb1", 101, 'Revert "Move"', removed=["app-8080"])]
    tracked = commits.word_files(spark.createDataFrame([("r", "deploy.sh", "target = fly")], "scope string, file string, text string"))
    out = commits.evidence(spark.createDataFrame(log, LOG), spark.createDataFrame(held, HELD), tracked)
    assert {(r["action"], r["id"]) for r in out.collect()} == {("replaced", "m1"), ("reverted", "commit-aaaaaaaa-0"), ("vanished", "m2")}
    assert "lambdafunction" not in out._jdf.queryExecution().toString()

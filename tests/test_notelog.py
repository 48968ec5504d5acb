"""The note log against a replay of each scope's whole log, and evidence that must stand as a whole."""

import hashlib
import json
import random

import pytest

from silt.operators import notelog

LOG = "scope string, n long, kind string, op string, note long, change long, title string, text string, description string, pinned boolean, intact boolean, at long"


def plain(rows, review):
    """Each scope's log as one, over plain dictionaries."""
    notes, changes = {}, {}
    live = lambda k: notes.get(k) and notes[k]["retired"] is None and {f: notes[k][f] for f in notelog.FIELDS} or None

    def put(k, after, at):
        if after is None:
            notes[k].update(retired=at, updated=at)
        else:
            notes[k] = {**after, "retired": None, "updated": at}

    def apply(key, c, at):
        if (live((key[0], c["note"])) if c["note"] is not None else None) != c["before"]:
            c.update(state="rejected", reason="target note changed before application")
            return
        if c["note"] is None:
            c["note"] = key[1]
        put((key[0], c["note"]), c["after"], at)
        c["state"] = "applied"

    for scope, n, kind, op, note, change, title, text, description, pinned, intact, at in sorted(rows, key=lambda r: (r[0], r[1])):
        key = (scope, n)
        if kind != "propose":
            c = changes.get((scope, change))
            if c and kind == "undo" and c["state"] == "applied":
                k = (scope, c["note"])
                changes[key] = {"note": c["note"], "op": "revert", "before": live(k), "after": c["before"], "state": "applied", "reason": None}
                put(k, c["before"], at)
                c["state"] = "undone"
            elif c and c["state"] == "staged" and kind in ("approve", "reject"):
                if kind == "approve":
                    apply((scope, change), c, at)
                else:
                    c["state"] = "rejected"
            continue
        target = note if note is not None and live((scope, note)) else None
        if target is None and title and title.strip():
            target = min((k[1] for k in notes if k[0] == scope and live(k) and notes[k]["title"].lower() == title.strip().lower()), default=None)
        before = live((scope, target)) if target is not None else None
        c = {"note": target, "op": op, "before": before, "after": None, "state": "staged", "reason": None}
        if any(x is not None and not x.strip() for x in (title, text, description)):
            c.update(state="rejected", reason="note fields are empty")
        elif op not in ("add", "update", "retire") or (target is None and op != "add"):
            c.update(state="rejected", reason="note target does not exist")
        elif op != "retire":
            base = before or {}
            t, x = (title or "").strip() or base.get("title"), (text or "").strip() or base.get("text")
            if not t or not x:
                continue
            after = {"title": base["title"] if base and base["title"].lower() == t.lower() else t, "text": x, "description": (description or "").strip() or base.get("description") or x.split("\n")[0][:120], "pinned": pinned if pinned is not None else bool(base.get("pinned"))}
            if after == before:
                continue
            c.update(after=after, op="add" if target is None else "update")
        if c["state"] == "staged" and intact is False:
            c.update(state="rejected", reason="source evidence is missing or changed")
        changes[key] = c
        if c["state"] == "staged" and not review:
            apply(key, c, at)
    return notes, changes


def check(spark, rows, review):
    notes, audit = notelog.replay(spark.createDataFrame(rows, LOG).repartition(3), review)
    want_notes, want_changes = plain(rows, review)
    assert {(r["scope"], r["note"]): {k: r[k] for k in (*notelog.FIELDS, "retired", "updated")} for r in notes.collect()} == want_notes
    got = {(r["scope"], r["change"]): {**{k: r[k] for k in ("note", "op", "state", "reason")}, **{k: r[k] and json.loads(r[k]) for k in ("before", "after")}} for r in audit.collect()}
    assert got == {k: {f: c[f] for f in ("note", "op", "state", "reason", "before", "after")} for k, c in want_changes.items()}
    return want_notes, want_changes, audit


def test_a_note_from_add_to_undo(spark):
    e = lambda n, kind, op=None, note=None, change=None, title=None, text=None, intact=True: ("s", n, kind, op, note, change, title, text, None, None, intact, 100 + n)
    rows = [e(1, "propose", "add", title="Ports", text="The port is 80\nand more"), e(2, "propose", "add", title="ports", text="The port is 81"), e(3, "propose", "retire", note=1), e(4, "undo", change=3), e(5, "undo", change=2), e(6, "propose", "add", title=" ", text="x"), e(7, "propose", "update", title="nobody", text="x"), e(8, "propose", "add", title="Other", text="y", intact=False), e(9, "undo", change=3), e(10, "propose", "add", title="Ports", text="The port is 80\nand more")]
    notes, changes, audit = check(spark, rows, False)
    assert notes["s", 1]["text"] == "The port is 80\nand more" and notes["s", 1]["description"] == "The port is 80" and notes["s", 1]["retired"] is None
    assert {n: c["state"] for (_, n), c in changes.items()} == {1: "applied", 2: "undone", 3: "undone", 4: "applied", 5: "applied", 6: "rejected", 7: "rejected", 8: "rejected"}
    learned = spark.createDataFrame([("m1", "s", 1), ("m2", "s", 2), ("m3", "s", 8), ("m4", "t", 2)], "memory string, scope string, change long")
    assert sorted(r["memory"] for r in notelog.retracted(learned, audit).collect()) == ["m2", "m3"]


@pytest.mark.parametrize("seed, review", [(1, False), (2, False), (3, True), (4, True)])
def test_random_logs(spark, seed, review):
    rng = random.Random(seed)
    rows = []
    for scope in "st":
        for n in range(1, 160):
            kind = rng.choice(["propose"] * 4 + ["undo"] + ["approve", "approve", "reject"] * review)
            pick = lambda *xs: rng.choice(xs)
            rows.append((scope, n, kind, pick("add", "add", "update", "retire", "odd"), rng.choice([None, None, rng.randrange(1, n + 1)]), rng.randrange(1, n + 1) if kind != "propose" else None, pick("Ports", "ports ", "Tests", "Deploy", None, f"own {n}", ""), pick("a", "b\nc", "d", None, " "), pick(None, None, "said", ""), pick(None, True, False), pick(True, None, True, False), n))
    check(spark, rows, review)


def test_no_log(spark):
    notes, audit = notelog.replay(spark.createDataFrame([], LOG))
    assert notes.count() == 0 and audit.count() == 0


def test_evidence_is_all_or_nothing(spark):
    turns = [(1, 0, "user", "text", None, "the port is 80"), (1, 1, "tool", "text", "sh", "ok"), (2, 0, "user", "from", None, "other"), (2, 1, "user", "text", None, None)]
    mark = lambda t: hashlib.sha256(json.dumps([t[1], t[2], t[3], t[4], t[5]], separators=(",", ":")).encode()).hexdigest()
    cited = [("a", *turns[0][:2], mark(turns[0]), "port is"), ("a", *turns[1][:2], mark(turns[1]), None), ("b", *turns[0][:2], mark(turns[0]), None), ("b", 9, 9, "x", None), ("c", *turns[0][:2], "amended", None), ("d", *turns[0][:2], mark(turns[0]), "not there"), ("e", *turns[0][:2], mark(turns[0]), ""), ("f", None, None, None, None), ("g", *turns[2][:2], mark(turns[2]), None), ("h", *turns[3][:2], mark(turns[3]), None)]
    got = {r["note"]: (r["intact"], r["eligible"], r["sources"]) for r in notelog.restored(spark.createDataFrame(cited, "note string, session long, cursor long, fingerprint string, quote string"), spark.createDataFrame(turns, "session long, cursor long, role string, kind string, tool string, text string")).collect()}
    assert got == {"a": (True, 1, 2), "b": (False, 1, 2), "c": (False, 0, 1), "d": (False, 0, 1), "e": (False, 0, 1), "f": (False, 0, 1), "g": (True, 0, 1), "h": (True, 1, 1)}


def test_note_log_query(spark, sf):
    from silt.plans import distil_queries

    rows = [tuple(r) for r in distil_queries.change_log(spark, sf).select("scope", "n", "kind", "op", "note", "change", "title", "text", "description", "pinned", "intact", "at").collect()]
    assert all(r[0] is not None for r in rows)
    notes, _, _ = check(spark, rows, False)
    got = distil_queries.note_log(spark, sf).collect()
    assert {(r["scope"], r["note"]): r["text"] for r in got} == {k: v["text"] for k, v in notes.items()} and len(got) > 50


def test_a_title_is_looked_up_among_its_own(monkeypatch):
    """Notes of a title that were retired, or are called otherwise by now, aren't gone through again at each proposal."""
    looked = [0]
    fields = notelog.Log.fields
    monkeypatch.setattr(notelog.Log, "fields", lambda self, note: looked.__setitem__(0, looked[0] + 1) or fields(self, note))
    held, nothing = notelog.Log(False), {"note": None, "change": None, "text": "x", "description": None, "pinned": None, "intact": True, "at": 1, "kind": "propose"}
    for n in range(3000):
        held.take(nothing | {"n": n, "op": "retire" if n % 2 else "add", "title": "Lyon"})
    assert len(held.notes) == 1500 and looked[0] < 30_000
    # an undone retiring lives again, under the title it has
    held.take(nothing | {"n": 3000, "op": None, "kind": "undo", "change": 1, "title": None})
    assert held.target(nothing | {"title": "LYON "}) == 0
    held.take(nothing | {"n": 3001, "op": "update", "note": 0, "title": "Rome"})
    assert held.target(nothing | {"title": "lyon"}) is None and held.target(nothing | {"title": "rome"}) == 0

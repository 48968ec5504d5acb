"""Notes as a log of changes: proposals, reviews and undoing, folded to the notes as they stand; and the evidence they rest on.

A change meets others only over a note it names, a title, or the change it decides
on. Changes connected that way are one group and are replayed by themselves, in the
order of the log.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silt.functions import offered
from silt.operators.graph import components, cut

#: Characters of a text's first line that describe a note which nobody described.
DESCRIBED = 120
FIELDS = ["title", "text", "description", "pinned"]


def restored(citations: DataFrame, turns: DataFrame) -> DataFrame:
    """Rows (note, intact, eligible, sources): whether all a note cites still stands as it was cited.

    ``citations`` (note, session, cursor, fingerprint, quote) name turns (session,
    cursor, role, kind, tool, text); a quote may be null, but one that is given must
    stand in the turn and not be empty. One citation that is gone, amended or
    misquoted, or lacks a part of its name, makes the note's evidence void: intact
    is all or nothing. ``eligible`` counts turns a person wrote. Turns of one
    session and cursor must not repeat.
    """
    marks = offered.fingerprint(F.col("cursor"), F.col("role"), F.col("kind"), F.col("tool"), F.col("text"))
    wanted = citations.select("session", "cursor").distinct()
    held = turns.join(wanted, ["session", "cursor"], "left_semi").select("session", "cursor", marks.alias("mark"), "text", F.coalesce((F.col("role") == "user") & (F.col("kind") != "from") & F.col("tool").isNull(), F.lit(False)).alias("own"))
    both = citations.join(held, ["session", "cursor"], "left")
    quoted = F.col("quote").isNull() | ((F.col("quote") != "") & F.contains("text", F.col("quote")))
    stands = F.coalesce((F.col("mark") == F.col("fingerprint")) & quoted, F.lit(False))
    return both.groupBy("note").agg(F.bool_and(stands).alias("intact"), F.count_if(F.col("own") & stands).alias("eligible"), F.count("*").alias("sources"))


class Log:
    """One group's notes and changes, replayed change by change."""

    def __init__(self, review: bool):
        self.review = review
        self.notes: dict[int, dict] = {}
        self.changes: dict[int, dict] = {}
        #: heaps of the notes that a title may name; what has died or is called otherwise leaves when it comes up
        self.titled: dict[str, list[int]] = {}

    def fields(self, note: int | None) -> dict | None:
        held = self.notes.get(note)
        return {f: held[f] for f in FIELDS} if held and held["retired"] is None else None

    def target(self, e: dict) -> int | None:
        """The live note that a proposal names, by number or by title."""
        if e["note"] is not None and self.fields(e["note"]):
            return e["note"]
        title = (e["title"] or "").strip().lower()
        held = self.titled.get(title, []) if title else []
        while held and not (self.fields(held[0]) and self.notes[held[0]]["title"].lower() == title):
            heapq.heappop(held)
        return held[0] if held else None

    def merged(self, e: dict, base: dict | None) -> dict | None:
        """A note's fields after a proposal: what it says, else what the note had."""
        pick = lambda name: (e[name] or "").strip() or (base or {}).get(name)
        title, text = pick("title"), pick("text")
        if not title or not text:
            return None
        if base and base["title"].lower() == title.lower():
            title = base["title"]
        described = pick("description") or text.split("\n")[0][:DESCRIBED]
        pinned = e["pinned"] if e["pinned"] is not None else bool(base and base["pinned"])
        return {"title": title, "text": text, "description": described, "pinned": pinned}

    def propose(self, e: dict) -> None:
        target = self.target(e)
        before = self.fields(target)
        change = {"n": e["n"], "note": target, "op": e["op"], "before": before, "after": None, "state": "staged", "reason": None, "at": e["at"]}
        if any(e[f] is not None and not e[f].strip() for f in ("title", "text", "description")):
            change |= {"state": "rejected", "reason": "note fields are empty"}
        elif e["op"] not in ("add", "update", "retire") or (target is None and e["op"] != "add"):
            change |= {"state": "rejected", "reason": "note target does not exist"}
        elif e["op"] != "retire":
            after = self.merged(e, before)
            if after is None or after == before:
                return
            change |= {"after": after, "op": "add" if target is None else "update"}
        if change["state"] == "staged" and not e["intact"]:
            change |= {"state": "rejected", "reason": "source evidence is missing or changed"}
        self.changes[e["n"]] = change
        if change["state"] == "staged" and not self.review:
            self.apply(change, e["at"])

    def put(self, note: int, after: dict | None, at: int) -> None:
        if after is None:
            self.notes[note] |= {"retired": at, "updated": at}
        else:
            self.notes[note] = after | {"retired": None, "updated": at}
            heapq.heappush(self.titled.setdefault(after["title"].lower(), []), note)

    def apply(self, change: dict, at: int) -> None:
        if self.fields(change["note"]) != change["before"]:
            change |= {"state": "rejected", "reason": "target note changed before application"}
            return
        # a note is named by the change that made it
        change["note"] = change["n"] if change["note"] is None else change["note"]
        self.put(change["note"], change["after"], at)
        change["state"] = "applied"

    def undo(self, change: dict, e: dict) -> None:
        self.changes[e["n"]] = {"n": e["n"], "note": change["note"], "op": "revert", "before": self.fields(change["note"]), "after": change["before"], "state": "applied", "reason": None, "at": e["at"]}
        self.put(change["note"], change["before"], e["at"])
        change["state"] = "undone"

    def take(self, e: dict) -> None:
        if e["kind"] == "propose":
            self.propose(e)
            return
        change = self.changes.get(e["change"])
        if change is None:
            return
        if e["kind"] == "undo" and change["state"] == "applied":
            self.undo(change, e)
        elif e["kind"] == "approve" and change["state"] == "staged":
            self.apply(change, e["at"])
        elif e["kind"] == "reject" and change["state"] == "staged":
            change["state"] = "rejected"


def replay(log: DataFrame, review: bool = False) -> tuple[DataFrame, DataFrame]:
    """The notes (scope, note, title, text, description, pinned, retired, updated) and the audit (scope, change, note, op, state, reason, before, after, at) that a log leaves.

    ``log``: (scope, n, kind, op, note, change, title, text, description, pinned,
    intact, at), numbered within a scope. A ``propose`` adds, updates or retires: the
    note it names by number or, failing that, the live one with its title, so an
    add of a title that lives is an update. It is turned down if a field is blank,
    its note isn't there, or its evidence isn't intact (null: it is), and leaves no
    trace if it changes nothing. With ``review`` it waits for ``approve`` or
    ``reject`` of its number; else it applies at once. A change whose note has
    changed since is turned down when it would apply. ``undo`` puts back what an applied
    change found and logs that as a change of its own; a note that was added is
    retired, one that was retired lives again. Notes are named by the number of the change that made
    them. Rows of one scope and n must not repeat; other columns are not read.
    """
    base = cut(log.select("scope", F.col("n").cast("long").alias("n"), "kind", "op", F.col("note").cast("long").alias("note"), F.col("change").cast("long").alias("change"), "title", "text", "description", F.col("pinned").cast("boolean").alias("pinned"), F.coalesce("intact", F.lit(True)).alias("intact"), F.col("at").cast("long").alias("at")))
    key = lambda kind, value: F.sha2(F.to_json(F.array(F.lit(kind), F.col("scope").cast("string"), value.cast("string"))), 256)
    own = key("change", F.col("n"))
    named = F.array_compact(F.array(F.when(F.col("note").isNotNull(), key("change", F.col("note"))), F.when(F.col("change").isNotNull(), key("change", F.col("change"))), F.when((F.col("kind") == "propose") & (F.trim("title") != ""), key("title", F.lower(F.trim("title"))))))
    groups = components(base.select(own.alias("a"), F.explode(named).alias("b")))
    placed = base.withColumn("node", own).join(groups, "node", "left").withColumn("group", F.coalesce("root", "node")).drop("node", "root")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, scope, held = None, None, Log(review)

        def close() -> list[tuple]:
            told = lambda x: None if x is None else json.dumps(x, ensure_ascii=False)
            out = [("note", scope, n, None, None, None, None, None, None, *[m[f] for f in FIELDS], m["retired"], m["updated"], None) for n, m in held.notes.items()]
            return out + [("change", scope, c["note"], c["n"], c["op"], c["state"], c["reason"], told(c["before"]), told(c["after"]), None, None, None, None, None, None, c["at"]) for c in held.changes.values()]

        for batch in batches:
            out = []
            for e in batch.astype(object).where(batch.notna(), None).to_dict("records"):
                if e["group"] != now:
                    out += close() if now is not None else []
                    now, scope, held = e["group"], e["scope"], Log(review)
                held.take({k: int(v) if k in ("n", "note", "change", "at") and v is not None else v for k, v in e.items()})
            yield frame(out)
        if now is not None:
            yield frame(close())

    kind = base.schema["scope"].dataType.simpleString()
    schema = f"what string, scope {kind}, note long, change long, op string, state string, reason string, before string, after string, title string, text string, description string, pinned boolean, retired long, updated long, at long"
    names = [c.split()[0] for c in schema.split(", ")]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        made = pd.DataFrame(rows, columns=names)
        return made.astype({c: "Int64" for c in ("note", "change", "retired", "updated", "at")} | {"pinned": "boolean"})

    # ids go over as longs, nulls and all
    ordered = placed.repartition("group").sortWithinPartitions("group", "n").select("group", "scope", "n", "kind", "op", *[F.col(c).cast("string").alias(c) for c in ("note", "change")], "title", "text", "description", "pinned", "intact", F.col("at").cast("string").alias("at"))
    found = cut(ordered.mapInPandas(run, schema))
    notes = found.filter("what = 'note'").select("scope", "note", *FIELDS, "retired", "updated")
    return notes, found.filter("what = 'change'").select("scope", "change", "note", "op", "state", "reason", "before", "after", "at")


def retracted(learned: DataFrame, audit: DataFrame) -> DataFrame:
    """Rows (memory, change): memories that were learned from changes (memory, scope, change) which were undone or turned down."""
    void = audit.filter(F.col("state").isin("undone", "rejected")).select("scope", "change")
    return learned.join(void, ["scope", "change"]).select("memory", "change").distinct()

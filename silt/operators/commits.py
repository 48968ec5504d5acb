"""What a repository's commits say about what is held.

A changed line that drops a value a memory names closes that memory and records
what the line became; a value that was removed and is in no tracked file any more
closes it with nothing in its place; a revert closes what the reverted commit
recorded. Words in more than a few files are vocabulary, not values, unless they
are spelled like names.

Commits speak to a memory only through values, and what they record brings new
ones. So values that one memory names, or one swapped line replaces by others, are
connected, and each connected group is replayed by itself in order of time, from
the events that touch it alone. A group without a memory is never replayed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silt.functions import offered
from silt.functions import words as W
from silt.operators.graph import components, cut

#: A word in more tracked files than this is vocabulary; a recorded line is cut to so many characters.
VALUE_FILES, CLIPPED = 3, 160


def tokens(line: Column) -> Column:
    """A changed line's words, lower-cased."""
    return F.transform(offered.line_tokens(line), F.lower)


def word_files(files: DataFrame) -> DataFrame:
    """Rows (scope, word, n): in how many of a scope's tracked files (scope, file, text) each word stands."""
    return files.select("scope", "file", F.explode(F.array_distinct(tokens(F.col("text")))).alias("word")).distinct().groupBy("scope", "word").agg(F.count("*").alias("n"))


def values(said: str) -> list[str]:
    """The values a text names (``offered.values_in`` for one text)."""
    held = [w for w in (w.strip(".-/") for w in re.split(r"[^\w.\-/]+", said)) if len(w.encode()) >= 2]
    out: dict[str, None] = {}
    for before, word in zip(["", *held], held, strict=False):
        if name_like(word) or (before.lower() in W.VALUE_TAKING and len(word.encode()) >= 3):
            out[word.lower()] = None
    return list(out)


def name_like(word: str) -> bool:
    """Whether a word is spelled like a name (``offered.name_like`` for one word)."""
    return any(map(str.isupper, word[1:])) or (re.search("[0-9]", word) is not None and any(map(str.isalpha, word))) or re.search("[._-]", word.strip(".-_")) is not None


def rewritten(said: str, old: str, new: str) -> str:
    """A claim with its lost value written as the one that came in."""
    out = []
    for word in said.split(" "):
        bare = re.sub(r"^[^\w.\-]+|[^\w.\-]+$", "", word)
        out.append(word.replace(bare, new, 1) if bare and bare.lower() == old.lower() else word)
    return " ".join(out)


def reverted(subject: Column) -> Column:
    """What a commit reverts, by its subject; null if nothing."""
    return F.nullif(F.regexp_extract(subject, r'^Revert "([\s\S]*)"$', 1), F.lit(""))


class Replay:
    """One group's memories, in the order in which a commit looks through them."""

    def __init__(self):
        self.held: list[dict] = []
        self.by_subject: dict[str, list[str]] = {}

    def swap(self, e: dict) -> list[tuple]:
        lost = set(e["lost"])
        met = next((m for m in self.held if lost & set(m["values"])), None)
        if met is None:
            return []
        self.held.remove(met)
        came = list(e["came"])
        old = next((v for v in met["values"] if v in lost), None)
        said = rewritten(met["text"], old, came[0]) if len(came) == 1 else f"{e['file']} now reads: {e['line']}"
        name = f"commit-{e['hash'][:8]}-{e['place']}"
        self.held.append({"id": name, "text": said, "values": values(said)})
        self.by_subject.setdefault(e["subject"], []).append(name)
        return [("replaced", met["id"], name, said, f"commit {e['hash'][:8]} ({e['subject']}): {e['file']} now reads {e['line']}", e["hash"], e["at"])]

    def close(self, name: str, action: str, e: dict) -> list[tuple]:
        before = len(self.held)
        self.held = [m for m in self.held if m["id"] != name]
        return [(action, name, None, None, None, e["hash"], e["at"])] if len(self.held) < before else []

    def take(self, e: dict) -> list[tuple]:
        """What one event does: rows (action, id, recorded, text, note, hash, at)."""
        if e["kind"] == "held":
            self.held.append({"id": e["id"], "text": e["text"], "values": list(e["lost"])})
            return []
        if e["kind"] == "revert":
            return [row for name in self.by_subject.get(e["subject"], []) for row in self.close(name, "reverted", e)]
        if e["kind"] == "swap":
            return self.swap(e)
        met = next((m for m in self.held if e["lost"][0] in m["values"]), None)
        return self.close(met["id"], "vanished", e) if met else []


def evidence(commits: DataFrame, held: DataFrame, tracked: DataFrame) -> DataFrame:
    """Rows (scope, action, id, recorded, text, note, hash, at): what the commits do to what is held.

    ``commits`` are (scope, hash, at, subject, removed, added, swaps), their lines
    as ``journals.commits`` reads them; ``held`` open, vouched facts (scope, id,
    observed_at, text); ``tracked`` (scope, word, n) from ``word_files``, of the
    files as they are now. Commits are taken in order of (at, hash). In each,
    a revert closes what a commit of that subject recorded before
    (``reverted``); then each swapped line replaces the first memory that names a
    value it lost (``replaced``: closed, and ``recorded`` names the new one, with
    ``text`` and ``note``); then each removed word that the commit added nowhere and
    no file holds closes the first memory naming it (``vanished``). Memories are
    looked through the newest first, recorded ones after them. One new word in a
    swapped line takes the lost one's place in the claim; otherwise the claim is what the line now
    reads. Times are the commits'. Null texts name nothing; rows of one scope and id, or hash, should
    not repeat.
    """
    place = lambda c: F.transform(c, lambda x, i: F.struct(i.alias("place"), x.alias("x")))
    base = cut(commits.select("scope", "hash", "at", F.coalesce("subject", F.lit("")).alias("subject"), "removed", "added", "swaps"))
    swap = base.select("scope", "hash", "at", "subject", F.explode(place("swaps")).alias("s")).select("scope", "hash", "at", "subject", F.col("s.place").alias("place"), "s.x.*")
    gone, came = tokens(F.col("removed")), tokens(F.col("added"))
    swap = swap.withColumns({"gone": gone, "came": came}).withColumns({"lost": F.array_except("gone", "came"), "new": F.filter("came", lambda v: ~F.array_contains("gone", v)), "line": F.substring(F.trim("added"), 1, CLIPPED)})
    # lines are parted here and nowhere else: all that follows reads what was found
    swap = cut(swap.withColumn("brought", F.array_distinct(F.concat("new", offered.values_in(F.concat("file", F.lit(" "), "line"))))).drop("removed", "added", "gone", "came"))
    lines = lambda c: F.flatten(F.transform(c, tokens))
    off = base.select("scope", "hash", "at", "subject", F.array_distinct(F.array_except(lines("removed"), lines("added"))).alias("words"))
    off = cut(off.select("scope", "hash", "at", "subject", F.posexplode("words").alias("place", "word")))
    facts = cut(held.select("scope", F.col("id").cast("string").alias("id"), F.col("observed_at").cast("long").alias("at"), F.coalesce("text", F.lit("")).alias("text")).withColumn("lost", offered.values_in(F.col("text"))).filter("size(lost) > 0"))

    # words that can be a value: spelled like one, or in few files
    named = facts.select("scope", F.explode("lost").alias("word")).union(swap.select("scope", F.explode("lost"))).union(swap.select("scope", F.explode("brought"))).union(off.select("scope", "word")).distinct()
    counted = named.join(tracked, ["scope", "word"], "left").withColumn("n", F.coalesce("n", F.lit(0))).filter(offered.name_like(F.col("word")) | (F.col("n") <= VALUE_FILES))
    nodes = cut(counted.select("scope", "word", F.sha2(F.to_json(F.array("scope", "word")), 256).alias("node"), "n"))

    def valued(rows: DataFrame, key: list[str], words: str) -> DataFrame:
        """(key, word, node) of those words of a row that can be values."""
        return rows.select("scope", *key, F.explode(words).alias("word")).join(nodes, ["scope", "word"])

    losing = cut(valued(swap, ["hash", "place"], "lost").select("scope", "hash", "place", "word", "node"))
    by_swap = cut(losing.groupBy("scope", "hash", "place").agg(F.min("node").alias("group"), F.collect_list("word").alias("kept")))
    bringing = valued(swap, ["hash", "place"], "brought").select("scope", "hash", "place", "node")
    naming = cut(valued(facts, ["id"], "lost").select("scope", "id", "node"))
    by_fact = naming.groupBy("scope", "id").agg(F.min("node").alias("group"))
    # a revert reaches all that its commit may have recorded
    undone = base.withColumn("of", reverted(F.col("subject"))).filter("of is not null")
    undoing = F.sha2(F.to_json(F.array(F.lit("subject"), F.col("scope"), F.col("of"))), 256)
    of_subject = by_swap.join(swap.select("scope", "hash", "place", "subject"), ["scope", "hash", "place"]).join(undone.select("scope", F.col("of").alias("subject")).distinct(), ["scope", "subject"], "left_semi").select(F.col("group").alias("a"), F.sha2(F.to_json(F.array(F.lit("subject"), F.col("scope"), F.col("subject"))), 256).alias("b"))
    edges = losing.join(by_swap, ["scope", "hash", "place"]).select(F.col("group").alias("a"), F.col("node").alias("b"))
    edges = edges.union(bringing.join(by_swap, ["scope", "hash", "place"]).select("group", "node")).union(naming.join(by_fact, ["scope", "id"]).select("group", "node")).union(of_subject)
    roots = components(edges.distinct())

    def grouped(rows: DataFrame) -> DataFrame:
        return rows.join(roots.withColumnRenamed("node", "group"), "group", "left").withColumn("group", F.coalesce("root", "group")).drop("root")

    nothing = {"id": "string", "text": "string", "file": "string", "line": "string", "subject": "string", "hash": "string", "came": "array<string>", "lost": "array<string>", "place": "int"}
    fields = ["scope", "group", "kind", "turn", "at", *nothing]

    def event(rows: DataFrame, kind: str, turn: int) -> DataFrame:
        full = rows.withColumns({"kind": F.lit(kind), "turn": F.lit(turn)} | {c: F.lit(None).cast(t) for c, t in nothing.items() if c not in rows.columns})
        return full.withColumn("place", F.coalesce("place", F.lit(-1))).select(*fields)

    known = event(grouped(facts.join(by_fact, ["scope", "id"])), "held", 0)
    swaps = event(grouped(swap.join(by_swap, ["scope", "hash", "place"]).withColumn("lost", F.col("kept")).withColumn("came", F.col("new"))), "swap", 2)
    reverts = event(grouped(undone.withColumn("group", undoing).withColumn("subject", F.col("of"))), "revert", 1)
    vanished = event(grouped(off.join(nodes.filter("n = 0"), ["scope", "word"]).withColumn("lost", F.array("word")).withColumnRenamed("node", "group")), "vanish", 3)
    spoken_to = known.select("group").distinct()
    events = known.union(swaps.union(reverts).union(vanished).join(spoken_to, "group", "left_semi").select(*fields))
    # memories first, the newest of them first; then commits in order, in each its reverts, swaps, removals
    first = F.when(F.col("turn") == 0, 0).otherwise(1)
    ordered = events.repartition("group").sortWithinPartitions("group", first, F.when(F.col("turn") == 0, -F.col("at")).otherwise(F.col("at")), "hash", "turn", "place", "id")
    return ordered.mapInPandas(_replay, "scope string, action string, id string, recorded string, text string, note string, hash string, at long")


def _replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    now, replay = None, Replay()
    for batch in batches:
        out = []
        for e in batch.to_dict("records"):
            if e["group"] != now:
                now, replay = e["group"], Replay()
            out += [(e["scope"], *row) for row in replay.take(e)]
        yield pd.DataFrame(out, columns=["scope", "action", "id", "recorded", "text", "note", "hash", "at"])

"""What a person laid down: eligible lines, rules, restatements, and states that may replace one another."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Labels of a pasted conversation, and words that ask for text to be produced, with counts.
ROLES = "user assistant system human ai claude gpt model me you".split()
PRODUCE = ["write", "generate", "draft", "list", "compose", "invent", "produce", "make up", "come up with", "give me"]
COUNTS = "a some few several two three five ten".split()
# Words and phrases that oblige.
OBLIGE_WORDS = ["must", "shall", "always", "never"]
OBLIGE_PHRASES = ["from now on", "do not ", "don't ", "standing rule"]
# The order that kinds of background work go out in; how many of a session at once.
JOB_ORDER = ["curate", "extract", "summarise", "working", "contradict", "retitle", "tidy"]
HIGH = 3


def pasted_conversation(text: Column) -> Column:
    """Two lines or more open with a role label and a colon."""
    opens = rf"^(?:{'|'.join(ROLES)})\s*:"
    return F.size(F.filter(F.split(text, "\n"), lambda x: F.lower(F.ltrim(x)).rlike(opens))) >= 2


def asks_for_generation(text: Column) -> Column:
    """Opens with a verb of producing, and one of the first eight words is a count."""
    low = F.regexp_replace(F.lower(F.ltrim(text)), "^please ", "")
    first = F.slice(F.filter(F.split(low, r"\s+"), lambda w: w != ""), 1, 8)
    counted = F.exists(first, lambda w: w.rlike("^[0-9]+$") | F.array_contains(F.array(*[F.lit(c) for c in COUNTS]), w))
    return low.rlike(rf"^(?:{'|'.join(PRODUCE)}) ") & counted


def eligible_lines(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """Rows (key, place, line) said in a person's own words: no fences, quotes, indented code or markup; list markers cut.

    Fences are found by a running state over a message's lines, one message at a
    time in Arrow batches.
    """

    def lines_of(message: str) -> list[str]:
        fence, out = None, []
        for raw in (message or "").split("\n"):
            line, start = raw.strip(), raw.lstrip(" ")
            mark = start[:1]
            run = len(start) - len(start.lstrip(mark)) if mark in ("`", "~") and len(raw) - len(start) <= 3 else 0
            if run >= 3:
                closes = fence and mark == fence[0] and run >= fence[1] and not start[run:].strip()
                fence = None if closes else fence or (mark, run)
                continue
            tagged = any(p[:1].isascii() and (p[:1].isalpha() or p[:1] in "/!?") and p for p in line.split("<")[1:])
            if fence or not line or line.startswith(">") or tagged or raw.startswith(("    ", "\t")):
                continue
            out.append(line.removeprefix("- "))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(i, n, x) for i, t in enumerate(pdf[text]) for n, x in enumerate(lines_of(t))]
            made = pdf[key].iloc[[i for i, _, _ in found]].reset_index(drop=True)
            made["place"] = pd.Series([n for _, n, _ in found], dtype="int32")
            made["line"] = pd.Series([x for _, _, x in found], dtype="object")
            yield made

    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in key)
    return df.select(*key, text).mapInPandas(run, f"{kinds}, place int, line string")


def obliges(line: Column) -> Column:
    """Whether a line that is no question lays something down by an obliging word or phrase."""
    low = F.lower(line)
    words = F.split(low, r"[^\p{L}\p{N}]+")
    said = F.arrays_overlap(words, F.array(*[F.lit(w) for w in OBLIGE_WORDS]))
    for phrase in OBLIGE_PHRASES:
        said = said | F.contains(low, F.lit(phrase))
    return said & ~F.rtrim(line).endswith("?")


def wording(text: Column) -> Column:
    """A rule as it is compared: spaces collapsed, the last full stop gone, the first letter small."""
    flat = F.regexp_replace(F.regexp_replace(F.trim(text), r"\.$", ""), r"\s+", " ")
    return F.concat(F.lower(F.substring(flat, 1, 1)), F.substr(flat, F.lit(2)))


def echoes(new: DataFrame, kept: DataFrame) -> DataFrame:
    """Ids of new notes (session, id, text) that restate a kept one of the session: nearly all of the shorter, in order, in the longer.

    Pairs meet on a shared word among a note's first few distinct ones - of nine
    tenths of the shorter's words none can be missed - and are compared by their
    longest common subsequence.
    """
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    a = new.select("session", "id", words.alias("wa"))
    b = kept.select("session", words.alias("wb"))
    left = a.select("session", "id", "wa", F.explode(F.array_distinct("wa")).alias("w"))
    right = b.select("session", "wb", F.explode(F.array_distinct("wb")).alias("w"))
    close = F.least(F.size("wa"), F.size("wb")) >= 4
    pairs = left.join(right, ["session", "w"]).filter(close).select("session", "id", "wa", "wb").distinct()

    def longest(x: list[str], y: list[str]) -> int:
        row = [0] * (len(y) + 1)
        for p in x:
            before = 0
            for j, q in enumerate(y, 1):
                before, row[j] = row[j], before + 1 if p == q else max(row[j], row[j - 1])
        return row[-1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for x, y in zip(pdf["wa"], pdf["wb"], strict=True):
                short, far, same = min(len(x), len(y)), max(len(x), len(y)), longest(list(x), list(y))
                keep.append(same * 10 >= short * 9 and (same == short or same * 10 >= far * 6))
            yield pdf.loc[keep, ["session", "id"]]

    kinds = ", ".join(f"{k} {new.schema[k].dataType.simpleString()}" for k in ("session", "id"))
    return pairs.mapInPandas(run, kinds).distinct()


def may_replace(now: DataFrame, was: DataFrame) -> DataFrame:
    """Reasons (session, reason, what) why a working state may not replace the last; none where it may.

    States are rows (session, kind, what, stage, evidenced): work, checks and
    corrections. Done work and passed checks need evidence; failed checks, open
    work and corrections may not go missing.
    """
    bare = now.filter("not evidenced and ((kind = 'work' and stage = 'done') or (kind = 'check' and stage = 'passed'))")
    unsupported = bare.select("session", F.when(F.col("kind") == "work", "unevidenced").otherwise("untested").alias("reason"), "what")
    held = was.filter("(kind = 'work' and stage <> 'done') or (kind = 'check' and stage = 'failed') or kind = 'correction'")
    lost = held.join(now.select("session", "kind", "what").distinct(), ["session", "kind", "what"], "left_anti")
    return unsupported.union(lost.select("session", F.concat("kind", F.lit(" dropped")).alias("reason"), "what"))


def schedule(jobs: DataFrame) -> DataFrame:
    """Queued jobs (session, id, kind, state, blocking) to hand out: in a fixed order of kinds, one of a kind, as many as there is room for; blocking ones always."""
    order = F.array_position(F.array(*[F.lit(k) for k in JOB_ORDER]), F.col("kind"))
    rank = F.when(order == 0, len(JOB_ORDER) + 1).otherwise(order)
    running = F.count_if(F.col("state") == "issued").over(Window.partitionBy("session"))
    queued = jobs.withColumns({"running": running, "rank": rank}).filter("state = 'queued'")
    one = queued.withColumn("_nth", F.row_number().over(Window.partitionBy("session", "kind").orderBy("id"))).filter("_nth = 1 or blocking")
    place = F.row_number().over(Window.partitionBy("session").orderBy("rank", "id"))
    return one.withColumn("place", place).filter((F.col("place") + F.col("running") <= HIGH) | F.col("blocking")).select("session", "id", "kind", "place")


def leases(jobs: DataFrame, now: Column, timeout: Column) -> DataFrame:
    """Issued jobs past their timeout and a minute: queued once more, then failed."""
    stale = (F.col("state") == "issued") & (now > F.col("issued_at") + timeout + 60)
    return jobs.withColumn("state", F.when(stale & (F.col("attempt") < 2), "queued").when(stale, "failed").otherwise(F.col("state"))).withColumn("attempt", F.when(stale & (F.col("attempt") < 2), F.col("attempt") + 1).otherwise(F.col("attempt")))


def due(counts: DataFrame, every: int, now: Column) -> DataFrame:
    """Sessions whose progress since a mark is enough, or, without a cadence, a minute after it."""
    if every:
        return counts.filter(F.col("progress") - F.col("marked") >= every)
    return counts.filter(now - F.col("marked_at") >= 60)


def activation(generations: DataFrame, amended: DataFrame) -> DataFrame:
    """Ready generations (session, id, first, last) that may become active: nothing amended inside their span, the newest of a session."""
    inside = generations.join(amended, "session").filter("cursor between first and last").select("id").distinct()
    ready = generations.filter("state = 'ready'").join(inside, "id", "left_anti")
    newest = F.row_number().over(Window.partitionBy("session").orderBy(F.col("last").desc(), F.col("id").desc()))
    return ready.withColumn("_p", newest).filter("_p = 1").drop("_p")

"""The instruction reader over cases of our own and the rules' known turns, and what "this" points at."""

import re

import pytest
from pyspark.sql import functions as F

from silt.functions import words as W
from silt.operators import instructions

# what is said -> the claim (None: nothing asked; "": points backwards), insistent
CASES = [
    ("please remember we ship with make", "we ship with make", False),
    ("remember: the box answers at 10.0.0.7", "the box answers at 10.0.0.7", False),
    ("Please REMEMBER we run `make check` here. Thanks", "we run `make check` here", False),
    ("for fuck's sake stop asking, it's make check", "it's make check", True),
    ("DUUUDE REMEBER THIS SHIT COS YOU ASK ME 100 TIMES", "", True),
    ("remember that", "", False),
    ("REMEMBER THAT!! you asked me again", "", True),
    ("remember this: we use uv", "we use uv", False),
    ("remember this, I have told you 4 times", "", True),
    ("remeber we use uv", "we use uv", False),
    ("rememberr we use uv", "r we use uv", False),
    ("the number is 5", None, None),
    ("I can never remember which flag it was", None, None),
    ("do you remember the port", None, None),
    ("should I remember the port?", None, None),
    ("how many times do I have to say it's make check?", "do I have to say it's make check", True),
    ("never commit to main", "never commit to main", False),
    ("we never push on fridays", "never push on fridays", False),
    ("ok so we always run make verify before a release", "always run make verify before a release", False),
    ("from now on never touch the vendor dir", "never touch the vendor dir", False),
    ("we never got round to it", None, None),
    ("the tests always fail on CI", None, None),
    ("the tests always fail on CI. remember we use uv", "we use uv", False),
    ("never mind, it works now", None, None),
    ("we always wondered why", None, None),
    ("always embed the schema", "always embed the schema", False),
    ("do not forget we use uv", "we use uv", False),
    ("don’t forget we use uv", "we use uv", False),
    ("remember the README lists the JSON schema", "the README lists the JSON schema", False),
    ("REMEMBER WE USE UV NOW", "WE USE UV NOW", False),
    ("REMEMBER THIS PLEASE WE USE MAKE", "PLEASE WE USE MAKE", True),
    ("remember we use uv!", "we use uv", False),
    ("remember we use uv!!", "we use uv", True),
    ("stop asking, it's make check", "it's make check", True),
    ("merk das: we use uv", None, None),
    ("Größe: remember çeda 10.5 übergröß. Ende", "çeda 10.5 übergröß", False),
    ("\U0001f600\U0001f600 remember the 行 is ok", "the 行 is ok", False),
    ("", None, None),
    (None, None, None),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, s, "x") for i, (s, *_) in enumerate(CASES)], "i int, text string, asked_before string")
    got = {r["i"]: r["asked"] for r in instructions.read(df).collect()}
    wrong = []
    for i, (said, claim, loud) in enumerate(CASES):
        a = got[i]
        want = None if claim is None else (claim or None, loud, claim == "")
        if (None if a is None else tuple(a)) != want:
            wrong.append((said, a, want))
    assert not wrong, wrong


def plain(said):
    """The same rules, word by word in Python."""
    low = "".join(c.lower() if c.isalnum() and len(c.lower()) == 1 else " " for c in said)

    def find(markers):
        spots = sorted((low.find(m), i, m) for i, m in enumerate(markers) if m in low)
        if spots:
            return spots[0][0], spots[0][2]
        for m in markers:
            if " " not in m and len(m) >= 6:
                for w in re.finditer(r"[^ ]+", low):
                    s = re.sub(r"(.)\1{2,}", r"\1\1", w.group())
                    edits = {s[:i] + s[i + 1 :] for i in range(len(s))} | {s}
                    if m in edits or s in {m[:i] + m[i + 1 :] for i in range(len(m))} or (len(s) == len(m) and sum(a != b for a, b in zip(s, m)) <= 1):
                        return w.start(), w.group()
        return None

    hit = find(W.KEEP + W.INSIST + W.POLARITY)
    if hit is None:
        return None
    polar = hit[1] in W.POLARITY
    if polar:
        opening = re.split(r"[\n!?;:]|\.(?= )", said[: hit[0]])[-1]
        lead = all(w.lower() in W.LEADING for w in re.split(r"[\W_]+", opening) if w)
        nxt = (low[hit[0] + len(hit[1]) :].split() or [""])[0]
        if not lead or nxt in W.NARRATED or (len(nxt) > 4 and nxt.endswith("ed") and not nxt.endswith("eed") and nxt != "embed"):
            hit, polar = find(W.KEEP + W.INSIST), False
            if hit is None:
                return None
    at, word = hit
    start = max(0, at - 24)
    if any(start + m.start() < at for p in W.REPORTED for m in re.finditer(re.escape(p), low[start : at + len(word)])):
        return None
    if said.rstrip().endswith("?") and not any(m in low for m in W.INSIST):
        return None
    rest = re.split(r"[\n!?]|\.(?=\s|$)", said[at + (0 if polar else len(word)) :].lstrip(",:.! -\t"), maxsplit=1)[0].strip()
    while m := re.match(rf"(?:{'|'.join(W.POINTING + W.SWEARING)})(?!['’\w])[\W_]*", rest, re.I):
        rest = rest[m.end() :]
    back = len(rest.encode()) < 3 or any(rest.lower().startswith(c) for c in W.COMPLAINT)
    return None if back else rest


@pytest.mark.parametrize("seed", [1, 2])
def test_random_turns(spark, seed):
    import random

    rng = random.Random(seed)
    pool = W.KEEP + W.POLARITY + W.INSIST + W.LEADING[:6] + W.REPORTED[:8] + W.POINTING + W.COMPLAINT[:6] + ["remeber", "alway", "we use make", "the box is 10.0.0.7", "failed", "got", "deploy.", "why?", "now!", "x: y", "Ünder"]
    said = [" ".join(rng.choice(pool) for _ in range(rng.randrange(1, 7))) for _ in range(600)]
    said = [s.upper() if rng.random() < 0.1 else s for s in said]
    df = spark.createDataFrame(list(enumerate(said)), "i int, text string")
    got = {r["i"]: r["asked"] for r in instructions.read(df).collect()}
    wrong = [(s, got[i], plain(s)) for i, s in enumerate(said) if (got[i]["claim"] if got[i] else None) != plain(s)]
    assert not wrong, wrong[:5]


def test_what_this_points_at(spark):
    turns = [(1, 0, "user", "set it up"), (1, 1, "assistant", "The port is 8080. More follows"), (1, 2, "tool", "out"), (1, 3, "assistant", "short"), (1, 4, "assistant", "We deploy with fly!"), (1, 5, "user", "REMEMBER THIS!!"), (2, 0, "user", "remember: we use uv"), (2, 1, "user", "Human: x\nAI: y\nremember it"), (3, 0, "user", "```\nremember this\n```\nnever use sudo"), (3, 1, "user", None)]
    df = spark.createDataFrame(turns, "session long, cursor long, role string, text string").withColumns({"command": F.when(F.col("role") == "tool", "make check"), "ok": F.lit(True)})
    got = {tuple(r) for r in instructions.imperatives(df).collect()}
    assert got == {(1, 1, "The port is 8080", "insisted", True), (1, 2, "`make check` is what works here", "insisted", True), (1, 4, "We deploy with fly", "insisted", True), (2, 0, "we use uv", "imperative", False), (3, 0, "never use sudo", "imperative", False)}
    assert instructions.imperatives(df.filter("false")).count() == 0


def test_own_markers_and_edits(spark):
    df = spark.createDataFrame([("merk das: we use uv",)], "text string")
    assert instructions.read(df, extra=("merk das", "never")).first()["asked"]["claim"] == "we use uv"
    assert [instructions.one_edit(a, b) for a, b in [("abc", "abc"), ("abc", "abd"), ("abc", "ab"), ("abc", "bc"), ("abc", "xabc"), ("abc", "acb"), ("abc", "abcde"), ("", "a")]] == [True, True, True, True, True, False, False, True]


def test_only_four_turns_back(spark):
    turns = [(1, i, "assistant", f"sentence number {i}.") for i in range(12)] + [(1, 12, "user", "remember that")]
    df = spark.createDataFrame(turns, "session long, cursor long, role string, text string")
    assert sorted(r["cursor"] for r in instructions.imperatives(df).collect()) == [8, 9, 10, 11]


def test_a_long_turn(spark):
    df = spark.createDataFrame([(1, "word " * 100_000 + "remember we use uv"), (2, "é" * 300_000)], "i int, text string")
    got = {r["i"]: r["asked"] for r in instructions.read(df).collect()}
    assert got[1]["claim"] == "we use uv" and got[2] is None


def test_asked_to_remember_query(spark, sf):
    from silt.plans import distil_queries

    turns = distil_queries.opened_turns(spark, sf).filter("role = 'user'").collect()
    own = {(r["session"], r["cursor"], plain(line)) for r in turns for line in ["\n".join(x.strip().removeprefix("- ") for x in (r["text"] or "").split("\n") if x.strip() and not x.startswith(("    ", "\t")))] if plain(line)}
    got = distil_queries.asked_to_remember(spark, sf).collect()
    carried = {(r["session"], r["cursor"], r["claim"]) for r in got if not r["pinned"] or r["claim"] and (r["session"], r["cursor"], r["claim"]) in own}
    assert own <= {(r["session"], r["cursor"], r["claim"]) for r in got} and len(carried) >= len(own) and any(r["label"] == "insisted" for r in got)

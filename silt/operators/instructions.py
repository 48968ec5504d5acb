"""Being told to remember: whether a turn asks for something to be kept, and what.

A turn is flattened character by character, so a place found in the flat text is a
place in the words as they were said. Which turns are read, what they point back
at and what comes of it is relational; the reading of one turn is a small helper
over the distinct texts of an Arrow batch.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from silt.functions import text
from silt.functions import words as W
from silt.operators import notes

#: A marker is reported if such a phrase begins within so many characters before it; words this short are not forgiven a typo; "this" reaches back over so many turns worth keeping, looked for among twice as many.
WINDOW, FORGIVEN, POINTS_BACK = 24, 6, 4


def _any(items: list[str]) -> str:
    return "|".join(re.escape(x) for x in items)


_INSISTS, _SWEARS = re.compile(_any(W.INSIST)), re.compile(_any(W.SWEARING))
_FIRST = re.compile(r"[\n!?]|\.(?=\s|$)")
# pointing and swearing at the front, unless they are half of a contraction
_POINTS = re.compile(rf"(?:^(?:{_any(W.POINTING + W.SWEARING)})(?!['’]|[^\W_])[\W_]*)(?:(?:{_any(W.POINTING + W.SWEARING)})(?!['’]|[^\W_])[\W_]*)*", re.IGNORECASE)
_COMPLAINS = re.compile(_any(W.COMPLAINT))


class Reader:
    """Reads one turn after another; markers are one expression over the flattened turn."""

    def __init__(self, extra: tuple[str, ...] = ()):
        asks = [*W.KEEP, *[m for m in (squash(e.lower()) for e in extra) if m not in W.POLARITY], *W.INSIST]
        self.asks, self.every = (self._finder(m) for m in (asks, asks + W.POLARITY))

    @staticmethod
    def _finder(markers: list[str]) -> tuple[re.Pattern, list[str]]:
        return re.compile(_any(markers)), [m for m in markers if " " not in m and len(m) >= FORGIVEN]

    def find(self, low: str, finder: tuple[re.Pattern, list[str]]) -> tuple[int, str] | None:
        """Where the earliest marker stands, and what stands there; else the first word that is one edit from a marker."""
        exact, near = finder
        if hit := exact.search(low):
            return hit.start(), hit.group()
        words = [(m.start(), m.group()) for m in re.finditer("[^ ]+", low)]
        return next(((at, w) for marker in near for at, w in words if one_edit(squash(w), marker)), None)

    def read(self, said: str | None) -> tuple[str | None, bool, bool] | None:
        said = said or ""
        low = flat(said)
        hit = self.find(low, self.every)
        polar = hit is not None and hit[1] in W.POLARITY
        if polar and not governs(said, low, *hit):
            hit, polar = self.find(low, self.asks), False
        if hit is None:
            return None
        at, word = hit
        if reported(low, at, word) or (said.rstrip().endswith("?") and not _INSISTS.search(low)):
            return None
        claim = _FIRST.split(said[at + (0 if polar else len(word)) :].lstrip(",:.! -\t"), maxsplit=1)[0].strip()
        rest = _POINTS.sub("", claim).strip()
        back = len(rest.encode()) < 3 or _COMPLAINS.match(squash(rest.lower())) is not None
        return None if back else rest, insistent(said, low), back


def flat(said: str) -> str:
    """Lower-cased, with a space for every character that is no letter or digit: as many characters as before."""
    return "".join(low if c.isalnum() and len(low := c.lower()) == 1 else c if c.isalnum() else " " for c in said)


def squash(word: str) -> str:
    """A third and further repeat of a character dropped."""
    return re.sub(r"(.)\1{2,}", r"\1\1", word)


def one_edit(a: str, b: str) -> bool:
    """Whether two words are at most one insertion, deletion or substitution apart."""
    if abs(len(a) - len(b)) > 1:
        return False
    same = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
    return a[same + (len(a) >= len(b)) :] == b[same + (len(b) >= len(a)) :]


def governs(said: str, low: str, at: int, word: str) -> bool:
    """Whether a polarity word opens a rule: only leading words before it in its sentence, no past form after it."""
    opening = re.split(r"[\n!?;:]|\.(?= )", said[:at])[-1]
    follows = (low[at + len(word) :].split() or [""])[0]
    tells = follows in W.NARRATED or (len(follows.encode()) > 4 and follows.endswith("ed") and not follows.endswith("eed") and follows != "embed")
    return not tells and all(w in W.LEADING for w in flat(opening).split())


def reported(low: str, at: int, word: str) -> bool:
    """Whether a phrase that reports begins shortly before the marker; it may run into the marker."""
    start = max(0, at - WINDOW)
    window = low[start : at + len(word)]
    return any(0 <= window.find(p) < at - start for p in W.REPORTED)


def insistent(said: str, low: str) -> bool:
    """Shouting, stretched words, exclaiming, swearing, or saying that it was asked before."""
    if _INSISTS.search(low) or _SWEARS.search(low) or "!!" in said or ("times" in low and re.search("[0-9]", low)) or re.search(r"([a-z])\1\1", said.lower()):
        return True
    bare = (re.sub(r"^[\W_]+|[\W_]+$", "", w) for w in said.split())
    return sum(sum(map(str.isupper, w)) >= 4 and not any(map(str.islower, w)) and w not in W.ACRONYMS for w in bare) >= 2


def read(turns: DataFrame, text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """``turns`` with a column ``asked``: struct(claim, insistent, referential), or null where nothing is asked to be kept.

    The earliest marker counts: words that ask to keep, ``extra`` ones, words of
    insistence, always and never; without any, the first word that is one edit
    from a marker of six letters or more. Always and never count only where they
    open a rule - nothing but leading words before them in their sentence, no past
    form after - and stay in the claim. A marker that is reported ("can never
    remember") asks nothing, nor does a question, unless it insists. The claim is
    the first sentence after the marker less pointing and swearing; if nothing is
    left but a complaint, the turn points backwards and the claim is null.

    Null and empty texts ask nothing. The columns of ``turns`` stay. Texts go to
    Python in Arrow batches, each distinct one of a batch once.
    """
    kind = "claim string, insistent boolean, referential boolean"

    @F.pandas_udf(kind)
    def asked(said: pd.Series) -> pd.DataFrame:
        reader, known = Reader(extra), {}
        for one in said.unique():
            known[one] = reader.read(one) or (None, None, None)
        return pd.DataFrame([known[one] for one in said], columns=["claim", "insistent", "referential"])

    found = turns.withColumn("asked", asked(F.col(text_col)))
    return found.withColumn("asked", F.when(F.col("asked.referential").isNotNull(), F.col("asked")))


def spoken(turns: DataFrame, key: list[str], text_col: str = "text") -> DataFrame:
    """Rows (key, text): what people said in their own words; turns that paste a conversation or ask for text have none."""
    own = turns.filter(~notes.pasted_conversation(F.col(text_col)) & ~notes.asks_for_generation(F.col(text_col)))
    lines = notes.eligible_lines(own, key, text_col)
    return lines.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("text"))


def recent_substance(turns: DataFrame) -> DataFrame:
    """``turns`` (session, cursor, role, text, and if there are any command, ok) with ``recent``: what "this" would mean there.

    Among the eight rows before, the four newest worth it, oldest first: first
    sentences of an assistant's text, and commands that worked; each of eight
    bytes or more, as structs (cursor, text).
    """
    command, ok = (F.col(c) if c in turns.columns else F.lit(None) for c in ("command", "ok"))
    prose = F.when((F.col("role") == "assistant") & (F.trim("text") != ""), text.first_sentence(F.ltrim("text")))
    worked = F.when((F.col("role") == "tool") & ok.cast("boolean") & command.isNotNull(), F.concat(F.lit("`"), command.cast("string"), F.lit("` is what works here")))
    worth = F.coalesce(prose, worked)
    kept = F.when(F.octet_length(worth) >= 8, F.struct("cursor", worth.alias("text")))
    back = Window.partitionBy("session").orderBy("cursor").rowsBetween(-2 * POINTS_BACK, -1)
    found = F.collect_list("__kept").over(back)  # nulls are left out
    out = turns.withColumn("__kept", kept).withColumn("recent", found).drop("__kept")
    return out.withColumn("recent", F.slice("recent", F.greatest(F.size("recent") - POINTS_BACK + 1, F.lit(1)), POINTS_BACK))


def imperatives(turns: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Rows (session, cursor, claim, label, pinned): what users ask to be remembered in turns (session, cursor, role, text).

    A turn that carries its claim gives one row; one that points backwards gives
    what the exchange before it was about, under the cursors it was said at.
    Insisting pins. Rows of one session and cursor should not repeat.
    """
    key = ["session", "cursor"]
    asked = read(spoken(turns.filter("role = 'user'"), key), extra=extra).filter("asked is not null").select(*key, "asked")
    # only sessions in which someone points backwards need their turns in order
    pointing = asked.filter("asked.referential")
    before = recent_substance(turns.join(pointing.select("session").distinct(), "session", "left_semi")).select(*key, "recent")
    meant = pointing.join(before, key).select("session", "asked", F.explode("recent").alias("r")).select("session", F.col("r.cursor").alias("cursor"), F.col("r.text").alias("claim"), "asked.insistent")
    own = asked.filter("not asked.referential").select(*key, "asked.claim", "asked.insistent")
    return own.union(meant).select(*key, "claim", F.when(F.col("insistent"), "insisted").otherwise("imperative").alias("label"), F.col("insistent").alias("pinned"))

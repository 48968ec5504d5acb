"""How memories are named, worded and weighed when they are offered, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from silt.functions import score, text
from silt.functions import words as W


def alike(said: Column) -> Column:
    """The key under which two lines are one: lower case, single spaces, no closing punctuation."""
    return F.regexp_replace(F.array_join(text.split_words(F.lower(said)), " "), "[.!;,]+$", "")


def about(said: Column) -> Column:
    """What a sentence is about: its distinct uncommon words of three bytes or more, a closing s dropped."""
    kept = F.filter(F.split(F.lower(said), r"[^\p{L}\p{N}_]+"), lambda w: (F.octet_length(w) >= 3) & ~text._in(w, W.COMMON))
    return F.array_distinct(F.transform(kept, lambda w: F.regexp_replace(w, "s$", "")))


def marked(word: Column) -> Column:
    """Whether nobody would write a word by chance."""
    return word.rlike("[_0-9]")


def acknowledges(query: Column) -> Column:
    """Whether a prompt only lets the run go on: one to three words, all of them of that kind."""
    bare = F.transform(text.split_words(query), lambda w: F.lower(F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")))
    held = F.filter(bare, lambda w: w != "")
    return (F.size(held) > 0) & (F.size(held) <= 3) & F.forall(held, lambda w: text._in(w, W.GOING_ON))


def handle(name: Column) -> Column:
    """The last eight characters of an id."""
    return F.right(name, F.lit(8))


def day(at: Column) -> Column:
    """YYYY-MM-DD in UTC, whatever the session's time zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(at / 86_400).cast("int")).cast("string")


def session_name(name: Column, opened: Column) -> Column:
    """MMDD of the opening and the last four characters of the id."""
    date = day(F.greatest(opened, F.lit(0)))
    return F.concat(F.substr(date, F.lit(6), F.lit(2)), F.substr(date, F.lit(9), F.lit(2)), F.lit("-"), F.lower(F.right(name, F.lit(4))))


def origin(kind: Column) -> Column:
    """Where evidence came from, by the kind of its strongest witness."""
    return F.coalesce(score.lookup(W.ORIGIN, kind), F.lit("on record"))


def doubt(stale: Column, confirmed: Column, confidence: Column, floor: float = score.FLOOR["inject"]) -> Column:
    """Why an offered memory is not stated as current."""
    return F.when(stale, F.concat(F.lit("not confirmed since "), day(confirmed))).when(confidence < floor, "weakly witnessed").otherwise("not stated as current")


def line(name: Column, said: Column, kind: Column, valid_from: Column, runs: Column, why: Column) -> Column:
    """One offered line; ``why`` is null for what is stated as current."""
    counted = F.when(runs > 1, F.concat(F.lit(", "), runs.cast("string"), F.lit(" runs"))).otherwise("")
    doubted = F.when(why.isNotNull(), F.concat(F.lit("; "), why)).otherwise("")
    return F.concat(F.lit("- ["), handle(name), F.lit("] "), F.trim(said), F.lit(" ("), origin(kind), F.lit(", "), day(valid_from), counted, doubted, F.lit(")"))


def witness_kind(channel: Column, asked: Column) -> Column:
    """What a witness counts as: only channels that may instruct make an instruction or a correction."""
    return F.when(asked.isin("imperative", "correction") & ~channel.isin(W.IMPERATIVE_CHANNELS), "distillation").otherwise(asked)


def channel_of(kind: Column) -> Column:
    """The channel that a witness of a kind comes through when it is extracted."""
    return score.lookup(W.CHANNEL_OF, kind)


def domain_of_kind(kind: Column) -> Column:
    """The trust domain of an extracted witness, where its kind has one."""
    return score.lookup({"commit": "repo", "inferred": "model"}, kind)


def episode_holds(cost_seconds: Column, corrected: Column, derived: Column) -> Column:
    """Whether an episode is worth keeping: half an hour lost, a correction, or something learned."""
    return (cost_seconds >= 1800) | corrected | (derived > 0)


def line_tokens(said: Column) -> Column:
    """A changed line's words as a commit is read: two bytes or more, edge joints trimmed."""
    trimmed = F.transform(F.split(said, r"[^\p{L}\p{N}.\-_/]+"), lambda w: text.trim_chars(w, ".-/"))
    return F.filter(trimmed, lambda w: F.octet_length(w) >= 2)


def name_like(word: Column) -> Column:
    """Whether a word is spelled like a name: an inner capital, a digit beside letters, or a joint inside."""
    return word.rlike(r"^.+\p{Lu}") | (word.rlike("[0-9]") & word.rlike(r"\p{L}")) | text.trim_chars(word, ".-_").rlike("[._-]")


def values_in(said: Column) -> Column:
    """The distinct value-like words of a claim: names, and words of three bytes after a word that takes a value."""
    held = line_tokens(said)
    before = F.concat(F.array(F.lit("")), F.transform(held, F.lower))
    tagged = F.transform(held, lambda w, i: F.when(name_like(w) | (text._in(F.get(before, i), W.VALUE_TAKING) & (F.octet_length(w) >= 3)), F.lower(w)))
    return F.array_distinct(F.filter(tagged, lambda w: w.isNotNull()))


def one_edit(a: Column, b: Column) -> Column:
    """Whether two words are at most one edit apart; the distance is not computed beyond that."""
    return F.levenshtein(a, b, 1) >= 0


def policy(shape: Column, field: str) -> Column:
    """A field (name, families, hops, candidates, archive) of the retrieval policy that a query's shape asks for."""
    values = {s: p[field] for s, p in W.POLICIES.items()}
    if field == "families":
        out = F.array().cast("array<string>")
        for s, names in values.items():
            out = F.when(shape == s, F.array(*[F.lit(n) for n in names]).cast("array<string>")).otherwise(out)
        return out
    return score.lookup(values, shape, W.POLICIES["plain"][field])


def bounded_presentation(proposed: Column, fixed: Column) -> Column:
    """A learned presentation may only be stricter than the fixed one."""
    order = F.array(*[F.lit(p) for p in score.PRESENTATIONS])
    return F.element_at(order, F.greatest(F.array_position(order, proposed), F.array_position(order, fixed)).cast("int"))


def stub(tool: Column, weight: Column, own: Column, name: Column, described: Column) -> Column:
    """What stands for an elided tool row: the configured words, else its own or general ones with its handle; null for other rows."""
    general = F.concat(F.lit("`"), F.coalesce(tool, F.lit("tool")), F.lit("` result elided (~"), weight.cast("string"), F.lit(" tokens)"))
    said = F.coalesce(own, general)
    named = F.when(name.isNotNull() & ~F.contains(said, name), F.concat(said, F.lit(" — `"), name, F.lit("` to see it again"))).otherwise(said)
    return F.coalesce(described, named)


def fingerprint(cursor: Column, role: Column, kind: Column, tool: Column, said: Column) -> Column:
    """SHA-256 of a turn's identity as a JSON array; a null is a JSON null."""
    quoted = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1), F.lit("null"))
    parts = [F.when(c.isNull(), "null").otherwise(quoted(c)) for c in (cursor, role, kind, tool, said)]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")), 256)

"""Scoring rules as Column expressions.

Times are unix seconds; days are seconds over 86,400. The numbers are fixed
values that results depend on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400.0
# Decay a day by importance; tempo by tier.
DECAY = {"critical": 0.005, "high": 0.01, "normal": 0.05, "low": 0.1}
TEMPO = {"fact": 0.25, "habit": 0.35, "episode": 1.4, "scratch": 2.0, "archive": 1.0}
# What a witness of each kind weighs.
WITNESS_WEIGHT = {
    "imperative": 1.0, "correction": 0.8, "choice": 0.6, "cost": 0.5, "commit": 0.5, "manual": 0.4, "inferred": 0.35,
    "distillation": 0.3, "repetition": 0.25, "consolidation": 0.2,
}
# Confidence floors.
FLOOR = {"live": 0.10, "inject": 0.35, "hold": 0.30, "promote": 0.50, "spent": 0.05}
# What each signal of a recall weighs.
RECALL = {"semantic": 0.26, "lexical": 0.22, "entity": 0.14, "frecency": 0.13, "confidence": 0.13, "strength": 0.08, "near": 0.04}
# Channels in ordinal order of what they may become: 0 asserted, 1 advisory, 2 evidence.
CEILING = {
    "user-instruction": 0, "user-correction": 0, "tool-observation": 0, "peer-assertion": 0, "consolidation": 0, "manual-write": 0,
    "repository": 0, "model-inference": 1, "distiller-summary": 1, "external-content": 2, "imported-history": 2,
}
PRESENTATIONS = ["asserted", "advisory", "evidence", "listed", "quarantined"]


def lookup(values: dict, key: Column, default=None) -> Column:
    """A fixed table as a CASE expression."""
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def days(since: Column, now: Column) -> Column:
    """Whole and part days between two times, never negative."""
    return F.greatest(F.lit(0.0), (now - since) / DAY)


def witness_value(weight: Column, at: Column, now: Column) -> Column:
    """A witness fades to a quarter of its weight over the years."""
    return weight * (0.25 + 0.75 * F.exp(-days(at, now) / 365))


def witness_domain(domain: Column, session: Column) -> Column:
    """The trust domain of a witness: its own, else its session."""
    return F.coalesce(domain, F.concat(F.lit("session:"), session))


def confidence(evidence: Column, sessions: Column, domains: Column, only_repetition: Column, pressure: Column | None = None, superseded: Column | None = None, pinned: Column | None = None) -> Column:
    """Confidence from summed domain evidence and how independent its sources are."""
    current = F.when(superseded, 0.3).otherwise(1.0) if superseded is not None else F.lit(1.0)
    independent = F.least(sessions, domains)
    diversity = F.when(independent <= 1, 0.75).otherwise(1 - 0.25 * F.exp(-(independent - 1.0)))
    pressed = 1 - pressure / (pressure + 1) if pressure is not None else F.lit(1.0)
    value = clamp01(evidence / (evidence + 0.5) * diversity * pressed * current)
    value = F.when(only_repetition, F.least(value, F.lit(0.30))).otherwise(value)
    return F.when(pinned, current).otherwise(value) if pinned is not None else value


def decay_rate(importance: Column, accesses: Column, pinned: Column) -> Column:
    """Decay a day: less the more often a memory is needed, none if pinned."""
    return F.when(pinned, 0.0).otherwise(lookup(DECAY, importance, 0.05) / (1 + F.log(1.0 + accesses)))


def strength(value: Column, rate: Column, since: Column, now: Column, tier: Column | None = None) -> Column:
    """Strength at a time, at the tempo of a tier if given."""
    tempo = lookup(TEMPO, tier, 1.0) if tier is not None else F.lit(1.0)
    return clamp01(value * F.exp(-rate * tempo * days(since, now)))


def frecency(accesses: Column, last: Column, now: Column) -> Column:
    """How often and how recently a memory has been needed."""
    return ((1 - F.exp(-accesses / 8)) + F.exp(-days(last, now) / 7)) / 2


def cosine01(a: Column, b: Column) -> Column:
    """Cosine mapped to 0..1, summed in doubles; null for unequal lengths, empty or zero vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    left, right = dot(a, a), dot(b, b)
    fits = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (left != 0) & (right != 0)
    return F.when(fits, (dot(a, b) / (F.sqrt(left) * F.sqrt(right)) + 1) / 2)


def relative(rank: Column, best: Column) -> Column:
    """A (negative) bm25 rank against the best of its result set."""
    return F.when(best >= 0, 0.5).otherwise(clamp01(rank / best))


def rarity(linked: Column) -> Column:
    """What sharing an entity is worth, by how many memories mention it."""
    return 1 / (1 + F.log(1.0 + linked))


def squashed(total: Column) -> Column:
    return total / (total + 1)


def recall_score(semantic: Column, lexical: Column, entity: Column, frec: Column, conf: Column, strong: Column, near: Column) -> Column:
    """The blend of seven signals; without a vector its weight goes to the lexical one."""
    lexical_weight = F.when(semantic.isNull(), RECALL["lexical"] + RECALL["semantic"]).otherwise(RECALL["lexical"])
    return (
        F.coalesce(semantic, F.lit(0.0)) * RECALL["semantic"] + lexical * lexical_weight + entity * RECALL["entity"] + frec * RECALL["frecency"]
        + conf * RECALL["confidence"] + strong * RECALL["strength"] + F.when(near, RECALL["near"]).otherwise(0.0)
    )


def relevance(semantic: Column, lexical: Column, entity: Column) -> Column:
    """The part of a score that is about the question."""
    return F.greatest(F.coalesce(semantic, lexical), lexical, entity)


def verdict(score: Column) -> Column:
    """Promote, hold or refuse."""
    return F.when(score >= FLOOR["promote"], "promote").when(score >= FLOOR["hold"], "hold").otherwise("refuse")


def corrected_tokens(tokens: Column, factor: Column) -> Column:
    """Tokens by a model's own count, within 32 bits."""
    return F.least(F.ceil(tokens * factor), F.lit(2**32 - 1)).cast("long")


def window_room(cap: Column, share: float, reply: Column, margin: Column) -> Column:
    """Tokens one request may take: a share of the window, the reply reserved; null where nothing is left."""
    room = F.least(F.floor(cap * share), cap - reply) - margin
    return F.when((cap > 0) & (reply < cap) & (room > 0), room)


def over_window(count: Column, limit: Column, reply: Column, margin: Column, cap: Column) -> Column:
    """By how much a request is too large; not positive if it fits."""
    return F.greatest(count - limit, count + reply + margin - cap)


def staleness(now: Column, valid_to: Column, confirmed_at: Column, observed_at: Column) -> Column:
    """Ended, or unconfirmed for a year."""
    confirmed = F.greatest(F.coalesce(confirmed_at, observed_at), observed_at)
    return F.coalesce(now > valid_to, F.lit(False)) | (now - confirmed > 365 * 86_400)


def presentation(channel: Column, suspicious: Column, corroborated: Column, imperative: Column) -> Column:
    """Ordinal of how a memory may be shown on one witness's account."""
    ceiling = lookup(CEILING, channel, 0)
    raised = F.when(corroborated & (ceiling == 2), 1).otherwise(ceiling)
    return F.when(suspicious & ~imperative, 4).otherwise(raised)


def fold_factor(ratios: Column) -> Column:
    """A model's token factor after a run of measured ratios: 0.7 old + 0.3 new, odd ratios ignored."""
    sane = F.filter(ratios, lambda r: (r >= 0.25) & (r <= 3.0))
    return F.aggregate(sane, F.lit(1.0), lambda f, r: F.greatest(F.lit(0.5), F.least(F.lit(8.0), 0.7 * f + 0.3 * r)))

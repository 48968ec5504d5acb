"""Confidence, decay and liveness: what a memory is worth at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silt.functions import score


def confidence_by_memory(witnesses: DataFrame, now: Column, pressure: DataFrame | None = None) -> DataFrame:
    """Confidence of every witnessed memory: evidence within a trust domain saturates, independent domains add up.

    Two partial aggregations; the second reads what the first has made small.
    ``pressure`` (memory, pressure) is the summed confidence of contradictors.
    """
    valued = witnesses.select("memory", "session", "kind", score.witness_domain(F.col("domain"), F.col("session")).alias("domain"), score.witness_value(F.col("weight"), F.col("at"), now).alias("v"))
    domains = valued.groupBy("memory", "domain").agg(
        F.max("v").alias("top"), F.count("*").alias("n"), F.collect_set("session").alias("sessions"), F.bool_and(F.col("kind") == "repetition").alias("repeated")
    )
    per_memory = domains.groupBy("memory").agg(
        F.sum(F.col("top") * (1 + 0.25 * (1 - 1 / F.col("n")))).alias("evidence"),
        F.size(F.array_distinct(F.flatten(F.collect_list("sessions")))).alias("n_sessions"),
        F.count("*").alias("n_domains"),
        F.sum("n").alias("n_witnesses"),
        F.bool_and("repeated").alias("repeated"),
    )
    pressed = F.lit(0.0)
    if pressure is not None:
        per_memory = per_memory.join(pressure, "memory", "left")
        pressed = F.coalesce("pressure", F.lit(0.0))
    value = score.confidence(F.col("evidence"), F.col("n_sessions"), F.col("n_domains"), F.col("repeated"), pressed)
    return per_memory.select("memory", "n_witnesses", "n_sessions", "n_domains", F.col("repeated").alias("only_repetition"), value.alias("confidence"))


def live(memories: DataFrame) -> DataFrame:
    """Open, unarchived memories; the columns that close one are hidden."""
    return memories.filter("valid_to is null and archived_at is null and tier <> 'archive'").drop("valid_to", "archived_at")


def decayed(memories: DataFrame, now: Column) -> DataFrame:
    """Every memory with its strength now, plain and at its tier's tempo."""
    rate = score.decay_rate(F.col("importance"), F.col("access_count"), F.col("pinned"))
    return memories.withColumn("rate", rate).withColumns(
        {"strength": score.strength(F.lit(1.0), F.col("rate"), F.col("observed_at"), now), "tier_strength": score.strength(F.lit(1.0), F.col("rate"), F.col("observed_at"), now, F.col("tier"))}
    )


def sweep(memories: DataFrame, now: Column, sweeping: bool = True) -> DataFrame:
    """Decay as a preview of changes: new strength, and whether the memory would be archived."""
    held = decayed(memories.filter("not pinned and archived_at is null"), now)
    return held.withColumn("archives", F.lit(sweeping) & (F.col("tier_strength") < score.FLOOR["spent"])).filter("tier_strength <> 1.0")


def assertable(memories: DataFrame, now: Column, floor: float = score.FLOOR["live"]) -> DataFrame:
    """Memories that may be asserted: open, confident, not faded, not stale unless pinned."""
    stale = score.staleness(now, F.col("valid_to"), F.lit(None).cast("long"), F.col("observed_at"))
    fresh = F.col("pinned") | ~stale
    return decayed(memories, now).filter(F.col("archived_at").isNull() & F.col("valid_to").isNull() & (F.col("confidence") >= floor) & (F.col("tier_strength") >= score.FLOOR["spent"]) & fresh)


def scratch_clusters(memories: DataFrame, hashed: Column, least_sessions: int = 2) -> DataFrame:
    """Recurring texts: by content hash, the smallest text, first seen and how many sessions said it."""
    return (
        memories.withColumn("content_hash", hashed)
        .groupBy("content_hash")
        .agg(F.min("text").alias("text"), F.min("observed_at").alias("first_seen"), F.countDistinct("session").alias("n_sessions"), F.count("*").alias("n_sources"))
        .filter(F.col("n_sessions") >= least_sessions)
    )


def presentation(witnesses: DataFrame, suspicious: DataFrame) -> DataFrame:
    """How each memory may be shown: the mildest presentation that one of its witnesses allows."""
    joined = witnesses.join(suspicious, "memory", "left")
    domains = F.size(F.collect_set(score.witness_domain(F.col("domain"), F.col("session"))))
    first = joined.groupBy("memory").agg(domains.alias("n_domains"), F.collect_set(F.struct("channel", F.coalesce("suspicious", F.lit(False)).alias("suspicious"))).alias("seen"))
    imperative = lambda c: c.isin("user-instruction", "user-correction")
    modes = F.transform("seen", lambda s: score.presentation(s["channel"], s["suspicious"], F.col("n_domains") > 1, imperative(s["channel"])))
    return first.select("memory", F.element_at(F.array(*[F.lit(p) for p in score.PRESENTATIONS]), F.array_min(modes) + 1).alias("presentation"))


def trust(witnesses: DataFrame) -> DataFrame:
    """Where each memory's evidence comes from."""
    domain = score.witness_domain(F.col("domain"), F.col("session"))
    return witnesses.groupBy("memory").agg(
        F.count("*").alias("n"),
        F.countDistinct("session").alias("n_sessions"),
        F.countDistinct(domain).alias("n_domains"),
        F.bool_or(F.col("channel") == "external-content").alias("external"),
        F.bool_and(F.col("channel").isin("model-inference", "distiller-summary")).alias("inferred_only"),
        F.min(score.lookup(score.CEILING, F.col("channel"), 0)).alias("ceiling"),
    ).withColumn("fewer_domains", F.col("n_domains") < F.col("n_sessions"))

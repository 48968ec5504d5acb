"""Consolidation: recurring claims become facts; and the measures of an evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silt.functions import text
from silt.functions.words import ACKNOWLEDGING
from silt.operators import claims, evidence
from silt.operators.graph import components, cut
from silt.operators.remember import containing, revises


def lead_clusters(clusters: DataFrame) -> DataFrame:
    """Clusters (scope, content_hash, text, first_seen, n_sessions) with the leader each joins, oldest and best established first.

    A cluster joins the first leader that states the same: one's content words hold
    the other's, three fifths and more are shared, both deny or neither does, and
    none only changes the other's value. That is greedy and not transitive, so it
    runs in order - but only among clusters that some chain of such contents
    connects. A text without content words leads itself.
    """
    held = claims.marked(clusters, {"words": "words", "denied": "no", "clause": "clause"})
    held = held.withColumns({"part": F.to_json(F.array(F.col("scope").cast("string"), F.col("no").cast("string"))), "node": F.sha2(F.to_json(F.struct("scope", "no", "words")), 256)})
    held = cut(held.select("scope", "content_hash", "first_seen", "n_sessions", "words", "no", "clause", "part", "node"))
    sets = held.filter("size(words) > 0").select("part", F.col("node").alias("id"), "words").distinct()
    groups = components(containing(sets).select("a", "b"))
    placed = held.filter("size(words) > 0").join(groups, "node", "left").withColumn("group", F.coalesce("root", "node"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, leaders = None, []
        for pdf in batches:
            out = []
            for row in pdf.itertuples():
                if row.group != now:
                    now, leaders = row.group, []
                mine, clause = set(row.words), list(row.clause)
                found = next((name for words, said, name in leaders if (mine <= words or words <= mine) and 5 * len(mine & words) >= 3 * len(mine | words) and not revises(said, clause)), None)
                if found is None:
                    found = row.content_hash
                    leaders.append((mine, clause, found))
                out.append(found)
            yield pdf.assign(leader=out)[["scope", "content_hash", "leader", "first_seen", "n_sessions"]]

    schema = f"scope {clusters.schema['scope'].dataType.simpleString()}, content_hash string, leader string, first_seen long, n_sessions long"
    ordered = placed.repartition("group").sortWithinPartitions("group", F.col("n_sessions").desc(), "first_seen", "content_hash")
    joined = ordered.select("group", "scope", "content_hash", "first_seen", "n_sessions", "words", "clause").mapInPandas(run, schema)
    alone = held.filter("size(words) = 0").select("scope", "content_hash", F.col("content_hash").alias("leader"), "first_seen", "n_sessions")
    return joined.union(alone)


def consolidate(memories: DataFrame, least_sessions: int = 2) -> DataFrame:
    """Facts that recurring scratch texts of a scope become: said in two sessions or more, under any wording, with substance."""
    hashed = claims.marked(memories.select("scope", "session", "observed_at", "text"), {"hash": "content_hash"})
    clusters = hashed.groupBy("scope", "content_hash").agg(F.min("text").alias("text"), F.min("observed_at").alias("first_seen"), F.countDistinct("session").alias("n_sessions"))
    clusters = cut(clusters)  # texts are parted once
    led = cut(lead_clusters(clusters))
    sessions = hashed.select("scope", "content_hash", "session").distinct().join(led.select("scope", "content_hash", "leader"), ["scope", "content_hash"])
    counted = sessions.groupBy("scope", "leader").agg(F.countDistinct("session").alias("n_sessions")).filter(F.col("n_sessions") >= least_sessions)
    first = led.groupBy("scope", "leader").agg(F.min("first_seen").alias("first_seen"), F.count("*").alias("n_wordings"))
    named = counted.join(first, ["scope", "leader"]).join(clusters.select("scope", F.col("content_hash").alias("leader"), "text"), ["scope", "leader"])
    # the words of leaders alone: a filter by text would move below the join, to every text
    told = claims.marked(named, {"words": "words"})
    return told.filter(F.size(F.filter("words", lambda w: ~w.isin(*ACKNOWLEDGING))) >= 2).drop("words")


def measures(encounters: DataFrame, keys: list[str]) -> DataFrame:
    """Hit rate, precision, relevance, accuracy and stale servings of evaluation encounters.

    Rows have known, right, wrong, found, stale, old, tokens: whether the agent
    knew, what was asserted, whether anything relevant was findable.
    """
    s = lambda c: F.sum(F.col(c).cast("long"))
    out = encounters.groupBy(*keys).agg(F.count("*").alias("encounters"), *[s(c).alias(c) for c in ("known", "right", "wrong", "found", "stale", "old", "tokens")])
    asserted = F.col("right") + F.col("wrong")
    share = lambda a, b, none: F.when(b == 0, none).otherwise(F.round(a / b, 6))
    return out.select(
        *keys, "encounters",
        share(F.col("known"), F.col("encounters"), 0.0).alias("hit_rate"),
        share(F.col("right"), asserted, 0.0).alias("precision"),
        share(F.col("found"), F.col("encounters"), 0.0).alias("relevance"),
        share(asserted - F.col("old"), asserted, 1.0).alias("assertion_accuracy"),
        F.col("stale").alias("stale_served"), F.col("tokens").alias("injected_tokens"),
    )


def recurring(memories: DataFrame, least_sessions: int = 2) -> DataFrame:
    """Recurring texts as clusters of their content hash."""
    return evidence.scratch_clusters(memories, text.content_hash(F.col("text")), least_sessions)

"""Changes to memories already held. Every operator returns the next snapshot; nothing is updated in place.

Memories have id, tier, session, scope, text, valid_to, archived_at, observed_at,
confirmed_at, last_accessed, access_count, strength, pinned and privacy; an
operator needs those it names only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silt.functions import text

DURABLE, WITNESSED = ["episode", "fact", "habit"], ["fact", "habit"]


def _where(memories: DataFrame, ids: DataFrame, changes: dict[str, Column]) -> DataFrame:
    """Memories with some columns changed where ``ids`` (id) names them."""
    named = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    hit = F.coalesce("_hit", F.lit(False))
    out = memories.join(named, "id", "left")
    return out.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changes.items()}).select(memories.columns)


def touch(memories: DataFrame, shown: DataFrame, now: int) -> DataFrame:
    """Shown memories (rows of ``id``, one a showing) at full strength, each showing counted."""
    n = shown.groupBy("id").agg(F.count("*").alias("_n"))
    out = memories.join(n, "id", "left")
    hit = F.col("_n").isNotNull()
    return out.withColumns(
        {"strength": F.when(hit, 1.0).otherwise(F.col("strength")), "last_accessed": F.when(hit, F.lit(now)).otherwise(F.col("last_accessed")), "access_count": F.col("access_count") + F.coalesce("_n", F.lit(0))}
    ).select(memories.columns)


def pin(memories: DataFrame, ids: DataFrame, pinned: bool = True) -> DataFrame:
    return _where(memories, ids, {"pinned": F.lit(pinned)})


def set_privacy(memories: DataFrame, ids: DataFrame, privacy: str) -> DataFrame:
    return _where(memories, ids, {"privacy": F.lit(privacy)})


def archive(memories: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    """Memories moved to the archive; those already there keep their time and tier."""
    fresh = F.col("archived_at").isNull()
    return _where(memories, ids, {"tier": F.when(fresh, "archive").otherwise(F.col("tier")), "archived_at": F.coalesce("archived_at", F.lit(now))})


def close(memories: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    """Memories that stop being current; those already closed keep their time."""
    return _where(memories, ids, {"valid_to": F.coalesce("valid_to", F.lit(now))})


def attach(memories: DataFrame, witnesses: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Memories and witnesses after new witnesses (memory, id, session, at, ...) are attached.

    A witness held already under its id is not added again. The first witness of a
    run that had none confirms the memory at its time and brings it back to full
    strength; more of the same run only add evidence.
    """
    fresh = new.dropDuplicates(["memory", "id"]).join(witnesses.select("memory", "id"), ["memory", "id"], "left_anti")
    runs = fresh.groupBy("memory", "session").agg(F.min(F.struct("id", "at")).alias("f")).join(witnesses.select("memory", "session").distinct(), ["memory", "session"], "left_anti")
    said = runs.groupBy(F.col("memory").alias("id")).agg(F.max("f.at").alias("_at"))
    out = memories.join(said, "id", "left")
    hit = F.col("_at").isNotNull()
    changes = {
        "confirmed_at": F.when(hit, F.greatest(F.coalesce("confirmed_at", "observed_at"), "_at")).otherwise(F.col("confirmed_at")),
        "strength": F.when(hit, 1.0).otherwise(F.col("strength")),
        "last_accessed": F.when(hit, F.greatest("last_accessed", "_at")).otherwise(F.col("last_accessed")),
    }
    return out.withColumns(changes).select(memories.columns), witnesses.unionByName(fresh.select(witnesses.columns))


def promote(memories: DataFrame, witnesses: DataFrame, ids: DataFrame, into: str, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Memories moved to a tier that outlives their session, with the witnesses of that decision."""
    if into not in DURABLE:
        raise ValueError(f"{into} does not outlive the session that made it")
    return attach(_where(memories, ids, {"tier": F.lit(into), "archived_at": F.lit(None).cast("long")}), witnesses, new)


def uncrossed(memories: DataFrame) -> DataFrame:
    """What sessions hold that has not crossed into the project's memory."""
    return memories.filter("tier = 'scratch' and archived_at is null and session is not null").select("session", "observed_at", "id", "text")


def keep_scratch(memories: DataFrame, new: DataFrame) -> DataFrame:
    """Unwitnessed memories added once for each scope, session and content; facts and habits need evidence and are refused."""
    if not new.filter(F.col("tier").isin(WITNESSED)).isEmpty():
        raise ValueError("a fact or habit may not be written without evidence")
    key = ["scope", "session", "_hash"]
    hashed = lambda d: d.withColumn("_hash", text.content_hash(F.col("text")))
    held = hashed(memories.filter("tier = 'scratch' and archived_at is null")).select(key).distinct()
    first = hashed(new).groupBy(*key).agg(F.min(F.struct("observed_at", "id")).alias("f")).select(*key, F.col("f.id").alias("id"))
    fresh = hashed(new).join(first, [*key, "id"], "left_semi").join(held, key, "left_anti")
    return memories.unionByName(fresh.dropDuplicates(["id"]).select(memories.columns))


def settle(memories: DataFrame, links: DataFrame, pairs: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """Memories and links after a person chose between claims (keep, drop): the dropped closes, the kept stands again."""
    kept, dropped = pairs.select(F.col("keep").alias("id")), pairs.select(F.col("drop").alias("id"))
    out = _where(close(memories, dropped, now), kept, {"valid_to": F.lit(None).cast("long")})
    return out, linked(links, pairs.select(F.col("keep").alias("src"), F.lit("supersedes").alias("rel"), F.col("drop").alias("dst")))


def reconcile(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links after a person said that claims (a, b) do not disagree: the contradiction stays and is overridden both ways."""
    both = pairs.select("a", "b").union(pairs.select("b", "a"))
    return linked(links, both.select(F.col("a").alias("src"), F.lit("reconciled").alias("rel"), F.col("b").alias("dst")))


def linked(links: DataFrame, new: DataFrame) -> DataFrame:
    """Links with new ones added once."""
    return links.unionByName(new.distinct().join(links, ["src", "rel", "dst"], "left_anti").select(links.columns))


def carry(memories: DataFrame, ids: DataFrame, scope: str, into: str, now: int) -> DataFrame:
    """Scratch memories copied into a project's scope and tier under new ids; the originals go to the archive."""
    if into not in DURABLE:
        raise ValueError(f"{into} does not outlive the session that made it")
    crossing = memories.join(ids.select("id").distinct(), "id", "left_semi").filter("tier = 'scratch' and archived_at is null")
    copies = crossing.withColumns({"id": F.concat(F.lit(f"{scope}:"), F.col("id").cast("string")), "scope": F.lit(scope), "tier": F.lit(into)})
    return archive(memories, crossing.select("id"), now).withColumn("id", F.col("id").cast("string")).unionByName(copies.select(memories.columns))


def purge_sessions(memories: DataFrame, witnesses: DataFrame, sessions: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Everything without some runs: their rows in every table with a session, their witnesses, and memories nothing else witnesses.

    A memory of the run that another run witnesses survives without its session.
    Links and other rows of gone memories are the caller's to purge by ``gone``.
    """
    runs = sessions.select("session").distinct()
    left = witnesses.join(runs, "session", "left_anti").select(witnesses.columns)
    touched = witnesses.join(runs, "session", "left_semi").select(F.col("memory").alias("id")).union(memories.join(runs, "session", "left_semi").select("id")).distinct()
    gone = touched.join(left.select(F.col("memory").alias("id")).distinct(), "id", "left_anti")
    own = runs.withColumn("_own", F.lit(True))
    kept = memories.join(gone, "id", "left_anti").join(own, "session", "left").withColumn("session", F.when(F.col("_own").isNull(), F.col("session"))).select(memories.columns)
    rest = {name: rows.join(runs, "session", "left_anti").select(rows.columns) for name, rows in tables.items()}
    return rest | {"memories": kept, "witnesses": left, "gone": gone}


def purge_domain(memories: DataFrame, witnesses: DataFrame, domain: str) -> dict[str, DataFrame]:
    """Everything without one trust domain's word: its witnesses, and the memories that only it witnessed."""
    left = witnesses.filter(~F.coalesce(F.col("domain") == domain, F.lit(False)))
    said = witnesses.filter(F.col("domain") == domain).select(F.col("memory").alias("id")).distinct()
    gone = said.join(left.select(F.col("memory").alias("id")).distinct(), "id", "left_anti")
    return {"memories": memories.join(gone, "id", "left_anti").select(memories.columns), "witnesses": left, "gone": gone}


def may_show(privacy: Column, remote: bool, history: bool) -> Column:
    """Whether a memory may be shown: secrets in a record only, local ones not to a remote reader."""
    reach = ~privacy.isin("local", "secret") if remote else privacy != "secret"
    return F.coalesce(reach | ((privacy == "secret") & F.lit(history)), F.lit(True))

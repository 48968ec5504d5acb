"""Sources and sinks of transcripts: JSONL journals, commit logs, snapshots of memories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = (
    "record string, session string, cwd string, started long, cursor long, entry struct<type:string,text:string,name:string,"
    "args:struct<command:string,path:string>,result:struct<output:string,is_error:boolean,duration_ms:long>,usage:struct<total:long>,summary:string>"
)


def journal(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Observations of JSONL journals: a meta line and entries, each file one session; unreadable lines are dropped."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", ENTRY).alias("j")).filter("j.record is not null")
    meta = lines.filter("j.record = 'meta'").select("file", "j.session", "j.started")
    entries = lines.filter("j.record = 'entry'").select("file", "j.cursor", "j.entry.*")
    role = F.when(F.col("type") == "user", "user").when(F.col("type").isin("assistant", "thinking"), "assistant").when(F.col("type").isin("tool", "tool_call", "tool_result"), "tool").otherwise("other")
    told = F.coalesce("text", "summary", F.col("result.output"), F.lit(""))
    kept = entries.join(meta, "file").filter("not (type in ('tool', 'tool_call') and result is null)")
    return kept.select("session", "cursor", role.alias("role"), F.col("type").alias("kind"), told.alias("text"), F.col("name").alias("tool"), F.col("args.command").alias("command"), F.col("args.path").alias("path"), (~F.col("result.is_error")).alias("ok"), F.col("result.duration_ms").alias("ms"), F.col("started").alias("at"))


def unread(sessions: DataFrame, stamps: DataFrame, version: int) -> DataFrame:
    """Sessions without a stamp of this version, or with rows beyond the one they have."""
    seen = stamps.filter(F.col("version") >= version).groupBy("session").agg(F.max("through").alias("through"))
    last = sessions.groupBy("session").agg(F.max("cursor").alias("last"))
    return last.join(seen, "session", "left").filter("through is null or last > through").select("session", "last", F.coalesce("through", F.lit(-1)).alias("through"))


def since(turns: DataFrame, stamps: DataFrame) -> DataFrame:
    """Turns beyond their session's watermark."""
    return turns.join(stamps.select("session", "through"), "session", "left").filter(F.col("cursor") > F.coalesce("through", F.lit(-1))).drop("through")


def commits(spark: SparkSession, path: str) -> DataFrame:
    """Commits of a log: records end with 0x1e, a head of hash, time and subject is split by 0x1f, a zero-context diff follows.

    A swap is one line removed and one added in its place; lines of files that
    are deleted or only renamed say nothing.
    """
    raw = spark.read.option("lineSep", "\x1e").text(path).filter(F.trim("value") != "")
    parts = F.split(F.ltrim(F.regexp_replace("value", r"^\s+", "")), "\x1f", 3)
    head = raw.select(parts.alias("p")).filter("size(p) = 3").select(F.col("p")[0].alias("hash"), F.col("p")[1].cast("long").alias("at"), F.split(F.col("p")[2], "\n", 2).alias("rest"))
    body = head.select("hash", "at", F.col("rest")[0].alias("subject"), F.coalesce(F.get("rest", F.lit(1)), F.lit("")).alias("diff"))
    # a file's part of the diff; one that is deleted or only renamed names no file it became
    parts = F.transform(F.slice(F.split("diff", r"(?m)^diff --git ", -1), 2, 1_000_000), lambda x: F.struct(F.regexp_extract(x, r"(?m)^\+\+\+ b/([^\n]*)", 1).alias("file"), F.slice(F.split(x, r"(?m)^@@[^\n]*\n?", -1), 2, 1_000_000).alias("hunks")))
    of = lambda hunk, sign, head: F.transform(F.filter(F.split(hunk, "\n"), lambda x: x.startswith(sign) & ~x.startswith(head)), lambda x: F.substr(x, F.lit(2)))
    each = lambda p: F.transform(p["hunks"], lambda h: F.struct(p["file"].alias("file"), of(h, "-", "---").alias("gone"), of(h, "+", "+++ ").alias("came")))
    hunks = body.withColumn("hunks", F.flatten(F.transform(F.filter(parts, lambda p: p["file"] != ""), each)))
    one = F.filter("hunks", lambda h: (F.size(h["gone"]) == 1) & (F.size(h["came"]) == 1))
    swaps = F.transform(one, lambda h: F.struct(h["file"].alias("file"), h["gone"][0].alias("removed"), h["came"][0].alias("added")))
    lines = lambda name: F.flatten(F.transform("hunks", lambda h: h[name]))
    return hunks.select("hash", "at", "subject", lines("gone").alias("removed"), lines("came").alias("added"), swaps.alias("swaps"))


def export_memories(memories: DataFrame, path: str) -> None:
    """One JSON line per memory."""
    memories.write.mode("overwrite").json(path)


def import_memories(spark: SparkSession, path: str, schema) -> DataFrame:
    """Exported memories; those without a witness are skipped."""
    return spark.read.schema(schema).json(path).filter("n_witnesses > 0")


def spread_entries(rows: DataFrame, column: str) -> DataFrame:
    """One journal line to many turns: its array spread, the place in it kept."""
    return rows.select("*", F.posexplode(column).alias("place", "item")).drop(column)

"""What turns ask to be kept, what commits say about what is held, and notes as a log of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silt.functions import offered
from silt.operators import commits, instructions, notelog
from silt.plans.registry import query
from silt.sources import tables

#: How the turns of a conversation are opened, by their place: as rules, requests, reports, and words that point back.
OPENINGS = ["remember: ", "", "we never ", "I can never remember ", "REMEMBER THIS!! ", "the tests always ", "please remeber ", ""]


def opened_turns(spark, sf_dir) -> DataFrame:
    """Turns whose texts open with one of OPENINGS; of those that only point, nothing else is left."""
    said = F.element_at(F.array(*[F.lit(x) for x in OPENINGS]), (F.pmod(F.col("session") + F.col("cursor"), F.lit(len(OPENINGS))) + 1).cast("int"))
    turns = tables.turns(spark, sf_dir).withColumn("opening", said)
    return turns.withColumn("text", F.when(F.col("opening").startswith("REMEMBER"), F.trim("opening")).otherwise(F.concat("opening", "text"))).drop("opening")


@query()
def asked_to_remember(spark, sf_dir):
    """What users ask to be remembered in their turns, opened in eight ways."""
    return instructions.imperatives(opened_turns(spark, sf_dir))


def city_log(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Client changes as the log of a repository with one file for fifty of them, the claims held about the files, and the files as they are now."""
    once = tables.table(spark, sf_dir, "client_changes").filter("change_id is not null and city is not null")
    once = once.groupBy("change_id").agg(F.min("city").alias("city"), F.min("op").alias("op"), F.min("segment").alias("segment"), F.min(F.unix_timestamp(F.col("valid_at").cast("timestamp"))).alias("at"))
    block = F.floor(F.col("change_id") / 50)
    each = once.select("change_id", block.alias("block"), "op", "segment", F.concat(F.lit("ships to "), F.lower("city"), F.lit("-b"), block.cast("string")).alias("line"))
    before = each.select((F.col("change_id") + 1).alias("change_id"), "block", F.col("line").alias("was"))
    changed = each.join(before, ["change_id", "block"])
    scope = F.concat(F.lit("repo"), (F.col("block") % 7).cast("string"))
    file = F.concat(F.lit("clients/b"), F.col("block").cast("string"))
    gone = F.array("was")
    came = F.when(F.col("op") == "D", F.array().cast("array<string>")).otherwise(F.array("line"))
    swap = F.when(F.col("op") == "D", F.array().cast("array<struct<file:string,removed:string,added:string>>")).otherwise(F.array(F.struct(file.alias("file"), F.col("was").alias("removed"), F.col("line").alias("added"))))
    undo = F.when(F.col("change_id") % 97 == 0, F.concat(F.lit('Revert "change '), (F.col("change_id") - 1).cast("string"), F.lit('"'))).otherwise(F.concat(F.lit("change "), F.col("change_id").cast("string")))
    log = changed.select(scope.alias("scope"), F.lpad(F.hex("change_id"), 8, "0").alias("hash"), F.col("change_id").alias("at"), undo.alias("subject"), gone.alias("removed"), came.alias("added"), swap.alias("swaps"))
    first = each.groupBy("block").agg(F.min_by("line", "change_id").alias("line"), F.max_by("line", "change_id").alias("now"))
    held = first.select(scope.alias("scope"), F.concat(F.lit("m"), F.col("block").cast("string")).alias("id"), F.col("block").alias("observed_at"), F.concat(F.lit("the box "), "line").alias("text"))
    return log, held, first.select(scope.alias("scope"), file.alias("file"), F.col("now").alias("text"))


@query()
def commit_evidence(spark, sf_dir):
    """What a log of changed cities does to the claims about them: closes, replacements, reverts."""
    log, held, files = city_log(spark, sf_dir)
    return commits.evidence(log, held, commits.word_files(files))


@query("""WITH t AS (SELECT conv_id AS session, turn AS cursor, min(role) AS role, min(text) AS text FROM conversations GROUP BY ALL),
 c AS (SELECT session, role, ((session * 7 + cursor) % 23 = 0 AND text IS NOT NULL) OR (session * 5 + cursor) % 29 = 0 AS gone FROM t)
 SELECT session AS note, bool_and(NOT gone) AS intact, count(*) FILTER (role = 'user' AND NOT gone) AS eligible, count(*) AS sources FROM c GROUP BY session""")
def evidence_restored(spark, sf_dir):
    """Whether the turns that a note on each conversation cites still stand, after some were amended and some were deleted."""
    said = tables.turns(spark, sf_dir).groupBy("session", "cursor").agg(F.min("role").alias("role"), F.min("text").alias("text")).withColumns({"kind": F.lit("text"), "tool": F.lit(None).cast("string")})
    marks = offered.fingerprint(F.col("cursor"), F.col("role"), F.col("kind"), F.col("tool"), F.col("text"))
    cited = said.select(F.col("session").alias("note"), "session", "cursor", marks.alias("fingerprint"), F.nullif(F.substring("text", 1, 8), F.lit("")).alias("quote"))
    amended = (F.col("session") * 7 + F.col("cursor")) % 23 == 0
    now = said.filter((F.col("session") * 5 + F.col("cursor")) % 29 != 0).withColumn("text", F.when(amended, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return notelog.restored(cited, now)


def change_log(spark, sf_dir) -> DataFrame:
    """Client changes as proposals about cities, with every fifth an undoing of the one two before and every seventh without evidence."""
    once = tables.table(spark, sf_dir, "client_changes").filter("change_id is not null").groupBy(F.col("change_id").alias("n")).agg(F.min("source").alias("scope"), F.min("city").alias("title"), F.min("segment").alias("text"), F.min("op").alias("op"), F.min(F.unix_timestamp(F.col("valid_at").cast("timestamp"))).alias("at"))
    undo = F.col("n") % 5 == 3
    none = F.lit(None)
    return once.select("scope", "n", F.when(undo, "undo").otherwise("propose").alias("kind"), F.when(F.col("op") == "D", "retire").when(F.col("op") == "I", "add").otherwise(F.when(F.col("n") % 2 == 0, "add").otherwise("update")).alias("op"), none.cast("long").alias("note"), F.when(undo, F.col("n") - 2).alias("change"), F.when(~undo, F.col("title")).alias("title"), "text", none.cast("string").alias("description"), (F.col("n") % 11 == 0).alias("pinned"), (F.col("n") % 7 != 0).alias("intact"), F.coalesce("at", F.lit(0)).alias("at"))


@query()
def note_log(spark, sf_dir):
    """The notes that a log of changes leaves."""
    return notelog.replay(change_log(spark, sf_dir))[0]


@query()
def note_audit(spark, sf_dir):
    """What became of every change of the log."""
    return notelog.replay(change_log(spark, sf_dir))[1]

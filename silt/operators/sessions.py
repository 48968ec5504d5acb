"""Sessions, their layouts and generations, pieces read of long rows, and what recurs across runs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from silt.functions import offered, text

#: How long an applied layout is kept, in seconds.
LAYOUT_KEPT = 30 * 24 * 60 * 60


def listed(sessions: DataFrame, limit: int, archived: bool = False) -> DataFrame:
    """The sessions opened last, with their names."""
    held = sessions.filter(F.col("archived_at").isNotNull() if archived else F.col("archived_at").isNull())
    return held.withColumn("name", offered.session_name(F.col("id").cast("string"), F.col("opened"))).orderBy(F.col("opened").desc(), F.col("id").desc()).limit(limit)


def resolve(sessions: DataFrame, handles: DataFrame) -> DataFrame:
    """Rows (handle, id): the session that each handle names; nothing where several fit.

    A name counts first; else an id, the start of a name or the end of an id. Both
    sides meet by equality: a session stands under every such part of its own.
    """
    held = sessions.select("id", F.lower("name").alias("name"), F.lower(F.col("id").cast("string")).alias("said"))
    parts = F.concat(F.transform(F.sequence(F.lit(1), F.length("name")), lambda k: F.left(F.col("name"), k)), F.transform(F.sequence(F.lit(1), F.length("said")), lambda k: F.right(F.col("said"), k)))
    under = held.filter("length(name) > 0 and length(said) > 0").select("id", "name", F.explode(F.array_distinct(parts)).alias("part"))
    met = handles.select("handle", F.lower("handle").alias("part")).distinct().join(under, "part")
    exact = F.col("name") == F.col("part")
    out = met.groupBy("handle").agg(F.count_if(exact).alias("n_exact"), F.count("*").alias("n"), F.min(F.when(exact, F.col("id"))).alias("by_name"), F.min("id").alias("by_part"))
    return out.select("handle", F.when(F.col("n_exact") == 1, F.col("by_name")).when((F.col("n_exact") == 0) & (F.col("n") == 1), F.col("by_part")).alias("id")).filter("id is not null")


def prune_layouts(layouts: DataFrame, effects: DataFrame, before: int) -> DataFrame:
    """Layouts (session, n, applied) that stay: not applied or applied since, each session's newest, and those with effects (layout, done) still waiting."""
    newest = layouts.groupBy("session").agg(F.max("n").alias("n")).withColumn("_newest", F.lit(True))
    waiting = effects.filter("not done").select(F.col("layout").alias("n")).distinct().withColumn("_waiting", F.lit(True))
    out = layouts.join(newest, ["session", "n"], "left").join(waiting, "n", "left")
    return out.filter(F.col("applied").isNull() | (F.col("applied") >= before) | F.col("_newest").isNotNull() | F.col("_waiting").isNotNull()).select(layouts.columns)


def trim_generations(generations: DataFrame, keep: int) -> DataFrame:
    """Generations (session, id, made_at, state) without all but each session's newest retired ones."""
    place = F.row_number().over(Window.partitionBy("session").orderBy(F.col("made_at").desc(), F.col("id").desc()))
    retired = generations.filter("state = 'retired'").withColumn("_p", place).filter(F.col("_p") <= keep)
    return generations.filter("state <> 'retired' or state is null").unionByName(retired.drop("_p"))


def covered(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, through): how many bytes from the start of a row its pieces (offset, length) cover without a gap."""
    end = F.col("offset") + F.col("length")
    reach = F.max(end).over(Window.partitionBy(*keys).orderBy("offset", end).rowsBetween(Window.unboundedPreceding, -1))
    ends = pieces.withColumn("_end", end).withColumn("_gap", F.col("offset") > F.coalesce(reach, F.lit(0)))
    first = F.min(F.when(F.col("_gap"), F.col("offset")))
    gaps = ends.groupBy(*keys).agg(first.alias("_first"))
    out = ends.join(gaps, keys).groupBy(*keys).agg(F.max(F.when(F.col("_first").isNull() | (F.col("offset") < F.col("_first")), F.col("_end"))).alias("through"))
    return out.select(*keys, F.coalesce("through", F.lit(0).cast("long")).alias("through"))


def chunks(rows: DataFrame, most: int, keys: list[str], text_col: str = "text") -> DataFrame:
    """Rows (keys, offset, text, revision): whole texts cut into pieces of at most ``most`` bytes, never inside a character.

    A character wider than that is a piece of its own. Null and empty texts have
    no piece. Each piece carries the hash of the whole text it was cut from.
    """
    step = max(1, most)

    @F.pandas_udf("array<struct<offset: long, text: string>>")
    def cut(texts: pd.Series) -> pd.Series:
        def pieces(said: str | None) -> list:
            data, out, at = (said or "").encode(), [], 0
            while at < len(data):
                end = min(at + step, len(data))
                while end > at and end < len(data) and data[end] & 0xC0 == 0x80:
                    end -= 1
                if end == at:
                    end = at + 1
                    while end < len(data) and data[end] & 0xC0 == 0x80:
                        end += 1
                out.append({"offset": at, "text": data[at:end].decode()})
                at = end
            return out

        return texts.map(pieces)

    found = rows.select(*keys, F.explode(cut(F.col(text_col))).alias("p"), F.sha2(F.col(text_col), 256).alias("revision"))
    return found.select(*keys, "p.offset", "p.text", "revision")


def recurring(memories: DataFrame, runs: DataFrame, since: int, newest: int = 256, least: int = 2) -> DataFrame:
    """Rows (scope, content_hash, text, n_sessions, first_seen): scratch texts that several of the newest runs hold.

    ``runs`` has (session, opened). A text's first wording is that of its first memory.
    """
    last = runs.orderBy(F.col("opened").desc(), F.col("session").desc()).limit(newest).select("session")
    held = memories.filter((F.col("tier") == "scratch") & F.col("archived_at").isNull() & (F.col("text") != "") & (F.col("observed_at") >= since)).join(F.broadcast(last), "session", "left_semi")
    first = F.min(F.struct("observed_at", "id", "text"))
    found = held.withColumn("content_hash", text.content_hash(F.col("text"))).groupBy("scope", "content_hash").agg(first.alias("f"), F.countDistinct("session").alias("n_sessions"))
    return found.filter(F.col("n_sessions") >= least).select("scope", "content_hash", F.col("f.text").alias("text"), "n_sessions", F.col("f.observed_at").alias("first_seen"))


def withheld(memories: DataFrame, taken_back: DataFrame, standing: DataFrame) -> DataFrame:
    """Ids of weak claims a peer made that are about something taken back: two words in common, or one marked one.

    ``taken_back`` and ``standing`` have (id, text); a rule that still stands word for word is not taken back.
    Memories have assertable, tier and through.
    """
    rules = taken_back.select(F.col("id").alias("rule"), F.array_sort(offered.about(F.col("text"))).alias("words"))
    kept = standing.select(F.array_sort(offered.about(F.col("text"))).alias("words")).distinct()
    asked = rules.join(kept, "words", "left_anti").select("rule", F.explode("words").alias("word"))
    weak = memories.filter("not assertable and tier <> 'scratch' and through = 'peer'").select("id", F.explode(offered.about(F.col("text"))).alias("word"))
    met = weak.join(asked, "word").groupBy("id", "rule").agg(F.count("*").alias("n"), F.bool_or(offered.marked(F.col("word"))).alias("marked"))
    return met.filter("n >= 2 or marked").select("id").distinct()

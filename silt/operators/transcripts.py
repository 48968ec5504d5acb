"""Transcripts: spans under a budget, window plans, coverage, and rules over tool calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silt.functions import text

#: Rows a repair looks back over; reads that make a file central; a slow command in milliseconds.
LOOKBACK, RE_READS, SLOW_MS = 6, 3, 30_000
#: Seconds of quiet after which a session is distilled.
QUIET = 600


def tail(turns: DataFrame, budget: int, most: int) -> DataFrame:
    """The newest turns of each session within a token budget and a number; the newest is always taken, the first that overflows ends it."""
    back = Window.partitionBy("session").orderBy(F.col("cursor").desc())
    held = turns.withColumns({"_place": F.row_number().over(back), "_spent": F.sum("tokens").over(back.rowsBetween(Window.unboundedPreceding, 0))})
    return held.filter((F.col("_place") <= most) & ((F.col("_spent") <= budget) | (F.col("_place") == 1))).drop("_place", "_spent")


def around(turns: DataFrame, centre: Column, budget: int) -> DataFrame:
    """Turns around a session's centre cursor, after and before in turn, until one side overflows.

    The interleaved order is a rank, so the balanced growth is one running sum.
    """
    side = F.when(F.col("cursor") >= centre, 0).otherwise(1)
    sides = turns.withColumns({"_side": side, "_far": F.abs(F.col("cursor") - centre)})
    near = F.row_number().over(Window.partitionBy("session", "_side").orderBy("_far"))
    order = Window.partitionBy("session").orderBy("_rank", "_side").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sides.withColumn("_rank", near).withColumn("_spent", F.sum("tokens").over(order))
    return ranked.filter((F.col("_spent") <= budget) | ((F.col("_rank") == 1) & (F.col("_side") == 0))).drop("_side", "_far", "_rank", "_spent")


def whole_messages(turns: DataFrame) -> DataFrame:
    """Turns without a leading part of a message that began before them; ``entry`` names the message, ``entry_start`` its first cursor."""
    least = F.min("cursor").over(Window.partitionBy("session"))
    return turns.withColumn("_least", least).filter((F.col("entry_start") >= F.col("_least")) | F.col("entry_start").isNull()).drop("_least")


def window_shape(rows: DataFrame) -> DataFrame:
    """What a session's window holds: cost, live rows, tool cost and its share."""
    out = rows.groupBy("session").agg(F.sum("tokens").alias("used"), F.count("*").alias("live"), F.sum(F.when(F.col("is_tool"), F.col("tokens")).otherwise(0)).alias("tools"))
    return out.withColumn("tool_share", F.when(F.col("used") == 0, 0.0).otherwise(F.round(F.col("tools") / F.col("used"), 6)))


def plan(rows: DataFrame, size: int, reserve: int, inject: int, mask_over: int, keep: int, masked_cost: int) -> DataFrame:
    """What to send of each session: rows kept, masked or left out for a summary, and whether that fits.

    Masking takes the oldest large tool rows until the window fits, then a summary
    takes the oldest span; both stop at the first row that suffices, so each is a
    running sum. The newest ``keep`` rows and pinned ones are never touched.
    """
    target, summary = max(0, size - reserve - inject), 4 * masked_cost
    by = Window.partitionBy("session")
    asc = by.orderBy("cursor").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumns({"used": F.sum("tokens").over(by), "_new": F.row_number().over(by.orderBy(F.col("cursor").desc()))})
    out = out.withColumn("fixed", (F.col("_new") <= keep) | F.col("pinned"))
    may = ~F.col("fixed") & F.col("is_tool") & (F.col("tokens") >= mask_over)
    out = out.withColumn("_gain", F.when(may, F.greatest(F.col("tokens") - masked_cost, F.lit(0))).otherwise(0))
    out = out.withColumn("masked", may & (F.col("used") - F.coalesce(F.sum("_gain").over(asc), F.lit(0)) > target))
    out = out.withColumn("cost", F.when(F.col("masked"), F.least(F.col("tokens"), F.lit(masked_cost))).otherwise(F.col("tokens")))
    out = out.withColumn("after_mask", F.sum("cost").over(by))
    out = out.withColumn("needed", F.col("after_mask") - target + summary)
    blocked = F.coalesce(F.max(F.col("fixed").cast("int")).over(by.orderBy("cursor").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    freed_before = F.coalesce(F.sum("cost").over(asc), F.lit(0))
    out = out.withColumn("_span", (F.col("after_mask") > target) & (blocked == 0) & (freed_before < F.col("needed")))
    out = out.withColumn("freed", F.coalesce(F.sum(F.when(F.col("_span"), F.col("cost"))).over(by), F.lit(0)))
    out = out.withColumn("dropped", F.col("_span") & (F.col("freed") > summary))
    spent = F.col("after_mask") - F.when(F.col("freed") > summary, F.col("freed") - summary).otherwise(0)
    return out.select("session", "cursor", F.when(F.col("dropped"), "drop").when(F.col("masked"), "mask").otherwise("keep").alias("action"), F.col("used").alias("was"), spent.alias("used"), F.lit(target).alias("target"), ((spent <= target) & F.lit(target > 0)).alias("fits"))


def coverage(ranges: DataFrame) -> DataFrame:
    """How far each session is covered without a gap, by acknowledged ranges (first, last) from 0 on in any order.

    Nothing counts from the smallest start on that no earlier range reaches. Of
    equal ranges only one can be seen to start there, so that start is looked up,
    not counted along the order, which leaves them open.
    """
    by = Window.partitionBy("session")
    reach = F.coalesce(F.max("last").over(by.orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    gap = ranges.withColumn("_gap", F.when(F.col("first") > reach + 1, F.col("first")))
    broken = gap.withColumn("_broken", F.min("_gap").over(by))
    whole = F.col("_broken").isNull() | (F.col("first") < F.col("_broken"))
    return broken.groupBy("session").agg(F.coalesce(F.max(F.when(whole, F.col("last"))), F.lit(-1)).alias("through"))


def islands(rows: DataFrame, key: str, at: str, quiet: int = QUIET) -> DataFrame:
    """Runs of activity of each key, ended by ``quiet`` seconds without any: first, last and number."""
    along = Window.partitionBy(key).orderBy(at)
    fresh = F.coalesce(F.col(at) - F.lag(at).over(along) > quiet, F.lit(True)).cast("int")
    numbered = rows.withColumn("_fresh", fresh).withColumn("island", F.sum("_fresh").over(along.rangeBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "island").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))


def idle(sources: list[DataFrame], before: int) -> DataFrame:
    """Keys whose last activity over all sources (key, at) is older than a time."""
    union = sources[0]
    for other in sources[1:]:
        union = union.unionByName(other)
    return union.groupBy("key").agg(F.max("at").alias("last_at")).filter(F.col("last_at") < before)


def repairs(calls: DataFrame) -> DataFrame:
    """Habits from calls that failed and then worked: the newest failed call of the tool among the six rows before, if both attempt the same."""
    back = Window.partitionBy("session").orderBy("cursor").rowsBetween(-LOOKBACK, -1)
    failed = F.when(~F.col("ok"), F.struct("cursor", "tool", "command"))
    seen = calls.withColumn("_failed", F.collect_list(failed).over(back)).filter("ok")
    mine = F.filter("_failed", lambda x: x["tool"] == F.col("tool"))
    last = seen.withColumn("_last", F.try_element_at(mine, F.lit(-1))).filter("_last is not null")
    useful = (F.col("_last.command") != F.col("command")) & text.related_commands(F.col("_last.command"), F.col("command"))
    return last.filter(useful).select("session", "cursor", F.col("_last.cursor").alias("failed_cursor"), F.col("_last.command").alias("attempted"), F.col("command").alias("worked"))


def central_files(calls: DataFrame) -> DataFrame:
    """The third successful read of a path in a session, once."""
    nth = F.row_number().over(Window.partitionBy("session", "path").orderBy("cursor"))
    return calls.filter("ok and path is not null").withColumn("_nth", nth).filter(F.col("_nth") == RE_READS).select("session", "path", "cursor")


def slow_commands(calls: DataFrame) -> DataFrame:
    """Successful commands that took half a minute or more."""
    label = F.concat("command", F.lit(" (~"), F.floor(F.col("ms") / 1000).cast("string"), F.lit("s)"))
    return calls.filter((F.col("ms") >= SLOW_MS) & F.col("ok")).select("session", "cursor", label.alias("object"))


def failed_before_end(calls: DataFrame) -> DataFrame:
    """Sessions whose last check-like call did not end well."""
    last = F.max(F.struct("cursor", "ok", "command"))
    return calls.groupBy("session").agg(last.alias("l")).filter("not l.ok").select("session", F.col("l.cursor").alias("cursor"), F.col("l.command").alias("command"))


def titles(turns: DataFrame, limit: int = 72) -> DataFrame:
    """A session's title: its first user text, cut."""
    first = F.min_by("text", "cursor")
    return turns.filter("role = 'user'").groupBy("session").agg(F.substr(F.trim(first), F.lit(1), F.lit(limit)).alias("title"), F.min("cursor").alias("cursor"))


def revisions(rows: DataFrame) -> DataFrame:
    """Every delivery of a turn: the first is kept, equal ones are no news, differing ones are conflicts."""
    first = F.min_by(F.struct("text", "role"), "arrived").over(Window.partitionBy("session", "cursor"))
    nth = F.row_number().over(Window.partitionBy("session", "cursor").orderBy("arrived"))
    same = (F.col("_first.text").eqNullSafe(F.col("text"))) & (F.col("_first.role").eqNullSafe(F.col("role")))
    return rows.withColumns({"_first": first, "_nth": nth}).withColumn("verdict", F.when(F.col("_nth") == 1, "kept").when(same, "repeated").otherwise("refused")).drop("_first", "_nth")


def pages(turns: DataFrame, page_bytes: int) -> DataFrame:
    """Replay in pages: each turn with the page that its running bytes fall on."""
    before = F.sum(F.octet_length("text")).over(Window.partitionBy("session").orderBy("cursor").rowsBetween(Window.unboundedPreceding, -1))
    return turns.withColumn("page", F.floor(F.coalesce(before, F.lit(0)) / page_bytes).cast("long"))


def learned_limit(refusals: DataFrame) -> DataFrame:
    """From a refused request's message: the count it names, the limit below it, and the model's new factor."""
    numbers = F.transform(F.regexp_extract_all("message", F.lit(r"(\d[\d,]*)"), F.lit(1)), lambda n: F.regexp_replace(n, ",", "").try_cast("long"))
    big = F.filter(numbers, lambda n: (n >= 1000) & (n != F.col("window")) & (n != F.col("reply")))
    counted = F.array_max(big)
    named = refusals.withColumns({"_big": big, "counted": counted})
    limit = F.array_max(F.filter(numbers, lambda n: (n >= 1000) & (n < F.col("counted")) & (n < F.col("window"))))
    ratio = F.col("counted") / F.col("estimated")
    factor = F.when(ratio > F.col("factor"), ratio).otherwise(F.col("factor") * 1.25)
    return named.withColumns({"limit": limit, "new_factor": F.greatest(F.lit(0.5), F.least(F.lit(8.0), factor))}).drop("_big")

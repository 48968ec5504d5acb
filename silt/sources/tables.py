"""The standard tables read as the data model's: memories, witnesses, turns, slots, ledger rows.

Every adapter is a projection, so filters and column pruning reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from silt.functions import score, text

#: The time all queries ask at: 2025-01-01.
NOW = 1_735_689_600


#: Rows that a window over sessions is to hold in one task.
TASK_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as memories: scope, session, tier and times follow from the id."""
    tiers = F.array(*[F.lit(t) for t in ("fact", "habit", "episode", "scratch")])
    ranks = F.array(*[F.lit(t) for t in ("critical", "high", "normal", "low")])
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        "text",
        F.col("source").alias("scope"),
        (F.col("doc_id") % 50).alias("session"),
        F.element_at(tiers, (F.col("doc_id") % 4 + 1).cast("int")).alias("tier"),
        F.element_at(ranks, (F.col("doc_id") % 7 % 4 + 1).cast("int")).alias("importance"),
        (F.lit(1_704_067_200) + F.col("doc_id") * 3600).alias("observed_at"),
        (F.col("doc_id") % 11).alias("access_count"),
        (F.col("doc_id") % 97 == 0).alias("pinned"),
        F.when(F.col("doc_id") % 13 == 0, F.lit(1_704_067_200) + F.col("doc_id") * 3600 + 86_400 * 30).alias("valid_to"),
        F.when(F.col("doc_id") % 17 == 0, F.lit(NOW)).alias("archived_at"),
        "lang",
    )


def witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as witnesses of the memory that ``user_id`` names."""
    kinds = {"purchase": "imperative", "signup": "correction", "error": "cost", "view": "repetition", "click": "distillation"}
    channels = {"purchase": "user-instruction", "signup": "user-correction", "error": "tool-observation", "view": "external-content", "click": "distiller-summary"}
    k = F.get_json_object("props", "$.k").cast("long")
    kind = score.lookup(kinds, F.col("event_type"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("memory"),
        kind.alias("kind"),
        score.lookup(channels, F.col("event_type")).alias("channel"),
        score.lookup(score.WITNESS_WEIGHT, kind).alias("weight"),
        (F.col("event_id") % 20).cast("string").alias("session"),
        F.when(k % 7 < 3, F.concat(F.lit("ext:"), (k % 7).cast("string"))).alias("domain"),
        F.unix_timestamp("ts").alias("at"),
        "value",
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as turns; times follow from session and cursor."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session"),
        F.col("turn").alias("cursor"),
        "role",
        "text",
        (F.col("conv_id") * 100_000 + F.col("turn") * 60).alias("at"),
        text.tokens(F.coalesce("text", F.lit(""))).alias("tokens"),
    )


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as facts in slots: customer, priority, status from a date on."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("subject"),
        F.col("o_orderpriority").alias("predicate"),
        F.col("o_orderstatus").alias("object"),
        F.unix_timestamp("o_orderdate").alias("valid_from"),
        F.col("o_totalprice").alias("weight"),
    )


def tool_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as tool calls of a session (the order), numbered in line order.

    A larger table is dealt to more tasks, so what the windows of one hold doesn't grow with it.
    """
    raw = table(spark, sf_dir, "lineitem")
    tasks = -(-raw.count() // TASK_ROWS)
    if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")):
        raw = raw.repartition(tasks, "l_orderkey")
    along = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    return raw.select(
        F.col("l_orderkey").alias("session"),
        F.row_number().over(along).cast("long").alias("cursor"),
        F.col("l_returnflag").alias("tool"),
        (F.col("l_linestatus") == "F").alias("ok"),
        F.concat(F.lit("run "), (F.col("l_partkey") % 50).cast("string")).alias("command"),
        F.concat(F.lit("src/"), (F.col("l_suppkey") % 3).cast("string"), F.lit(".rs")).alias("path"),
        (F.col("l_quantity") * 40).cast("long").alias("tokens"),
        (F.col("l_extendedprice")).cast("long").alias("ms"),
    )


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as actions on memories with outcomes: purchase succeeded, error failed, signup reverted."""
    outcome = score.lookup({"purchase": "succeeded", "error": "failed", "signup": "reverted"}, F.col("event_type"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("memory"),
        outcome.alias("outcome"),
        F.when(F.col("event_id") % 3 == 0, "proximal").when(F.col("event_id") % 3 == 1, "structural").otherwise("explicit").alias("attribution"),
        F.unix_timestamp("ts").alias("at"),
        "value",
    )

"""Writing and reading the ledger of searches, injections, actions and outcomes.

The ledger is a dict of tables: recall (id), candidate (recall, memory), injection
(id), shown (injection, memory), action (id), cited (action, memory), outcome (id).
Every write is a merge by key that returns the next table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silt.functions import text

KEYS = {
    "recall": ["id"], "candidate": ["recall", "memory"], "injection": ["id"], "shown": ["injection", "memory"],
    "action": ["id"], "cited": ["action", "memory"], "outcome": ["id"],
}
#: Tables that follow another: column, table.
PARENTS = {"candidate": ("recall", "recall"), "shown": ("injection", "injection"), "cited": ("action", "action"), "outcome": ("action", "action")}


def merged(held: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those held under their key; writing the same again changes nothing.

    Of several new rows of a key the greatest by all columns stays, so a replay in
    another order gives the same table. Null keys never meet.
    """
    rest = [c for c in held.columns if c not in keys]
    one = new.select(held.columns).groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_r")).select(*keys, "_r.*") if rest else new.select(held.columns).distinct()
    return held.join(one.select(*keys), keys, "left_anti").unionByName(one)


def note(ledger: dict[str, DataFrame], **new: DataFrame) -> dict[str, DataFrame]:
    """The ledger with new rows of the tables named."""
    return ledger | {name: merged(ledger[name], rows, KEYS[name]) for name, rows in new.items()}


def note_use(ledger: dict[str, DataFrame], actions: DataFrame, cited: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The ledger with new actions, and those refused: actions on an injection that was never made."""
    known = ledger["injection"].select(F.col("id").alias("injection")).distinct()
    refused = actions.filter("injection is not null").join(known, "injection", "left_anti").select(actions.columns)
    good = actions.filter("injection is null").unionByName(actions.join(known, "injection", "left_semi").select(actions.columns))
    return note(ledger, action=good, cited=cited.join(good.select(F.col("id").alias("action")), "action", "left_semi").select(cited.columns)), refused


def structural(ledger: dict[str, DataFrame], memories: DataFrame, actions: DataFrame) -> DataFrame:
    """Rows (action, memory): injected memories that quote a command which the action's text holds."""
    quoted = memories.select(F.col("id").alias("memory"), F.explode(F.transform(text.quoted_commands(F.col("text")), F.lower)).alias("command"))
    held = ledger["shown"].select("injection", "memory").join(quoted, "memory")
    said = actions.select(F.col("id").alias("action"), "injection", F.lower("text").alias("said"))
    return said.join(held, "injection").filter(F.contains("said", F.col("command"))).select("action", "memory").distinct()


def trace(ledger: dict[str, DataFrame]) -> DataFrame:
    """Rows (recall, action, tool, attribution, outcome, at): what was done with the context of each search; unknown without an outcome."""
    injection = ledger["injection"].select(F.col("id").alias("injection"), "recall").filter("recall is not null")
    action = ledger["action"].select(F.col("id").alias("action"), "injection", "tool", "attribution", "at")
    outcome = ledger["outcome"].select("action", F.col("kind").alias("outcome"))
    return injection.join(action, "injection").join(outcome, "action", "left").select("recall", "action", "tool", "attribution", F.coalesce("outcome", F.lit("unknown")).alias("outcome"), "at")


def times_retrieved(candidates: DataFrame) -> DataFrame:
    """Rows (memory, n, n_selected): how often a search considered a memory, and chose it."""
    return candidates.groupBy("memory").agg(F.count("*").alias("n"), F.count_if(F.coalesce("selected", F.lit(False))).alias("n_selected"))


def forget_before(ledger: dict[str, DataFrame], before: int) -> dict[str, DataFrame]:
    """The ledger without searches, injections and actions before a time, and without what follows from them; rows without a time stay."""
    old = {name: ledger[name].filter(F.col("at") < before).select(F.col("id").alias("_old")).distinct() for name in ("recall", "injection", "action")}
    out = dict(ledger)
    for name in old:
        out[name] = ledger[name].filter(F.col("at").isNull() | (F.col("at") >= before))
    for name, (column, parent) in PARENTS.items():
        out[name] = ledger[name].join(old[parent], F.col(column) == F.col("_old"), "left_anti")
    return out

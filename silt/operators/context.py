"""Context assembly and window layout: what of a session and its memories goes into a request.

Greedy packing looks at one session's rows in order and is not prefix-closed; it
runs per session on its own bounded rows. A layout is running sums over windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Shares of the room for memory, pinned notes, summary and catalogue.
SHARES = {"memory": 0.05, "pinned": 0.03, "summary": 0.08, "catalog": 0.03}
# The share of the room at which old tool rows are stubbed, the span compacted, a warning given; the cold goal.
STUB_AT, COLD_TO, COMPACT_AT, WARN_AT, TIGHTER = 0.70, 0.50, 0.85, 0.75, 0.85


def budget(room: Column, tightening: Column) -> dict[str, Column]:
    """Tokens for each slot of a layout, less with every refusal."""
    return {name: F.floor(room * share * F.pow(F.lit(TIGHTER), tightening)).cast("long") for name, share in SHARES.items()}


def catalog(memories: DataFrame, floor: float, limit: int = 120, width: int = 72) -> DataFrame:
    """One line for each newest open fact and habit of a scope, at most ``limit`` of them."""
    place = F.row_number().over(Window.partitionBy("scope").orderBy(F.col("observed_at").desc(), F.col("id").desc()))
    rows = memories.filter("valid_to is null and archived_at is null").filter(F.col("tier").isin("fact", "habit") & (F.col("confidence") >= floor))
    line = F.concat(F.lit("- ["), F.lpad(F.col("id").cast("string"), 8, "0"), F.lit("] "), F.substr(F.regexp_replace("text", r"\s+", " "), F.lit(1), F.lit(width)))
    return rows.withColumn("place", place).filter(F.col("place") <= limit).select("scope", "place", "id", line.alias("line"))


def pack(rows: DataFrame, key: str, room: int) -> DataFrame:
    """Rows (key, rank, cost) taken in order of rank while they fit; one that doesn't is skipped and the next tried.

    A group is one session's ranked list, bounded by the recall that made it.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, left, taken = pdf.sort_values("rank"), room, []
        for cost in pdf["cost"]:
            taken.append(cost <= left)
            left -= cost if cost <= left else 0
        return pdf.assign(taken=taken)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", taken boolean"
    return rows.groupBy(key).applyInPandas(run, schema)


def protected(rows: DataFrame) -> DataFrame:
    """Rows that a layout leaves alone: from the last two user turns on, the last three tool results, the last row."""
    back = Window.partitionBy("session").orderBy(F.col("cursor").desc())
    users = F.coalesce(F.sum(F.col("is_user").cast("int")).over(back), F.lit(0))
    tools = F.sum(F.col("is_tool").cast("int")).over(back)
    nth = F.row_number().over(back)
    held = (F.col("is_user") & (users <= 2)) | (F.col("is_tool") & (tools <= 3) & (users <= 2)) | (nth == 1)
    return rows.withColumn("protected", held)


def lay_out(rows: DataFrame, room: int, cold: bool = False) -> DataFrame:
    """An action for each row (session, cursor, tokens, stub_tokens, is_tool, is_user): keep, stub, compact or drop.

    Over STUB_AT of the room, unprotected tool rows are stubbed from the largest
    down until under it (COLD_TO when cold); over COMPACT_AT, the oldest
    unprotected run is compacted; over the room, the oldest unprotected rows are
    dropped. Each stops at the first row that suffices, so each is a running sum
    of what the rows before it freed; token counts are not negative.
    """
    by, goal = Window.partitionBy("session"), room * (COLD_TO if cold else STUB_AT)
    oldest = by.orderBy("cursor").rowsBetween(Window.unboundedPreceding, -1)
    largest = by.orderBy(F.col("tokens").desc(), "cursor").rowsBetween(Window.unboundedPreceding, -1)
    freed = lambda cost, taken, along: F.coalesce(F.sum(F.when(taken, cost)).over(along), F.lit(0))
    out = protected(rows).withColumns({"_free": ~F.col("protected"), "_saves": F.col("tokens") - F.col("stub_tokens"), "_was": F.sum("tokens").over(by)})
    may = F.col("_free") & F.col("is_tool") & (F.col("_saves") > 0)
    out = out.withColumn("_stub", may & (F.col("_was") > room * STUB_AT) & (F.col("_was") - freed(F.col("_saves"), may, largest) > goal))
    out = out.withColumns({"_cost": F.when(F.col("_stub"), F.col("stub_tokens")).otherwise(F.col("tokens")), "_left": F.col("_was") - freed(F.col("_saves"), F.col("_stub"), by)})
    run = F.coalesce(F.max(F.col("protected").cast("int")).over(by.orderBy("cursor").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)) == 0
    out = out.withColumn("_compact", run & (F.col("_left") - freed(F.col("_cost"), F.lit(True), oldest) > room * COMPACT_AT))
    out = out.withColumns({"_rest": F.col("_free") & ~F.col("_compact"), "_left": F.col("_left") - freed(F.col("_cost"), F.col("_compact"), by)})
    out = out.withColumn("_drop", F.col("_rest") & (F.col("_left") - freed(F.col("_cost"), F.col("_rest"), oldest) > room))
    out = out.withColumn("used", F.col("_left") - freed(F.col("_cost"), F.col("_drop"), by))
    action = F.when(F.col("_drop"), "drop").when(F.col("_compact"), "compact").when(F.col("_stub"), "stub").otherwise("keep")
    return out.select("session", F.col("cursor").cast("long").alias("cursor"), action.alias("action"), F.col("used").cast("long").alias("used"), (F.col("used") > room * WARN_AT).alias("warn"))


def sections(scored: DataFrame, weights: dict[str, float], tokens: int) -> DataFrame:
    """Lines (session, section, rank, text) chosen under a shared budget: unspent room rolls to later sections, near-duplicate lines are said once."""
    order, total = list(weights), sum(weights.values())

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        spare, said, out = 0.0, [], []
        for name in order:
            left = tokens * 4 / total * weights[name] + spare
            for row in pdf[pdf["section"] == name].sort_values("rank").itertuples():
                words = set(row.text.lower().split())
                if len(row.text) > left or any(len(words & s) >= 0.8 * min(len(words), len(s)) for s in said if s and words):
                    continue
                said.append(words)
                left -= len(row.text)
                out.append((row.session, name, row.rank, row.text))
            spare = left
        return pd.DataFrame(out, columns=["session", "section", "rank", "text"])

    kind = scored.schema["session"].dataType.simpleString()
    return scored.groupBy("session").applyInPandas(run, f"session {kind}, section string, rank int, text string")


def hashed_embedding(df: DataFrame, id_col: str, text_col: str, dims: int = 256) -> DataFrame:
    """Unit vectors of hashed words and character trigrams, FNV-1a, by Arrow batches."""

    def fnv(data: bytes) -> int:
        h = 0xCBF29CE484222325
        for b in data:
            h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
        return h

    def embed(text: str) -> list[float]:
        out = np.zeros(dims, np.float64)
        for word in "".join(c if c.isalnum() else " " for c in (text or "").lower()).split():
            grams = [(word, 2.0), *((word[i : i + 3], 1.0) for i in range(len(word) - 2) if len(word) > 3)]
            for gram, weight in grams:
                h = fnv(gram.encode())
                out[h % dims] += -weight if h >> 63 else weight
        norm = np.sqrt(out @ out)
        return (out / norm if norm else out).astype(np.float32).tolist()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({id_col: pdf[id_col], "embedding": [embed(t) for t in pdf[text_col]]})

    return df.select(id_col, text_col).mapInPandas(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, embedding array<float>")

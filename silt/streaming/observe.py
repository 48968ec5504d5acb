"""Streams: idempotent observation, quiet sessions, an exactly-once outbox.

``observe_stream`` keeps the first delivery of every (session, cursor) and says
of each later one whether it repeats or contradicts it. State is one small row a
turn and survives in the query's checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

VERDICTS = "session long, cursor long, verdict string, digest string"


def observe_stream(turns: DataFrame) -> DataFrame:
    """Deliveries (session, cursor, role, text) with a verdict: kept, repeated or refused."""
    digest = F.sha2(F.to_json(F.struct("role", "text")), 256)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else None
        for pdf in frames:
            out = []
            for digest in pdf["digest"]:
                out.append("kept" if held is None else "repeated" if digest == held else "refused")
                held = held or digest
            yield pd.DataFrame({"session": key[0], "cursor": key[1], "verdict": out, "digest": pdf["digest"]})
        state.update((held,))

    rows = turns.select("session", "cursor", digest.alias("digest"))
    return rows.groupBy("session", "cursor").applyInPandasWithState(run, VERDICTS, "digest string", "append", GroupStateTimeout.NoTimeout)


def deduplicated(turns: DataFrame) -> DataFrame:
    """Each (session, cursor) once."""
    return turns.dropDuplicates(["session", "cursor"])


def quiet_sessions(turns: DataFrame, gap: str = "600 seconds", late: str = "1 day") -> DataFrame:
    """Sessions ended by a gap in event time, with how many turns they had."""
    timed = turns.withWatermark("ts", late)
    return timed.groupBy("session", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("session", F.col("session_window.start").alias("first"), F.col("session_window.end").alias("quiet_at"), "n")


def outbox(effects: DataFrame, path: str, checkpoint: str, once: Callable[[DataFrame], DataFrame] | None = None):
    """Write each batch's effects under its batch id: a replayed batch overwrites itself, so every effect lands once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        made = once(batch) if once else batch
        made.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return effects.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Sessions over step streams: idle closing, and the keyed state of an agent session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def idle_sessions(events: DataFrame, key: str, ts: str, order: str, idle_seconds: int) -> DataFrame:
    """Batch twin of the idle close: a gap of ``idle_seconds`` or more starts a new session (column ``session`` from 1)."""
    w = Window.partitionBy(key).orderBy(ts, order)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))
    new = F.when(gap < idle_seconds * 1_000_000, 0).otherwise(1)
    return events.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def streamed_sessions(events: DataFrame, key: str, ts: str, idle: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Structured Streaming: session windows per key, events later than ``late`` dropped by the watermark."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, idle), key).agg(F.count("*").alias("events")).select(
        key, F.col("session_window.start").alias("opened"), F.col("session_window.end").alias("closed"), "events"
    )


STATE = "seen long, last_hash string"
STEP = "session_id string, new_messages long, seen long, rewritten boolean"
TTL_MS = 6 * 3600 * 1000


def _fold(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Delta of a session's growing message history.

    A history that is shorter than what was seen, or whose prefix changed, was rewritten: the
    state starts again and everything in it counts as new.
    """
    if state.hasTimedOut:
        state.remove()
        return
    seen, last = state.get if state.exists else (0, None)
    for f in frames:
        for step in f.sort_values("step").itertuples(index=False):
            hashes = list(step.hashes)
            rewritten = bool(seen) and (len(hashes) < seen or hashes[seen - 1] != last)
            fresh = len(hashes) if rewritten else len(hashes) - seen
            seen, last = len(hashes), hashes[-1] if hashes else None
            yield pd.DataFrame({"session_id": [key[0]], "new_messages": [fresh], "seen": [seen], "rewritten": [rewritten]})
    state.update((seen, last))
    state.setTimeoutDuration(TTL_MS)


def session_deltas(steps: DataFrame) -> DataFrame:
    """Stream of (session_id, step, hashes array<string>) to new messages per step; state lives six hours after the last touch."""
    return steps.groupBy("session_id").applyInPandasWithState(_fold, STEP, STATE, "append", "ProcessingTimeTimeout")

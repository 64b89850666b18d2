"""Keyed state of agent sessions over streams: injection anchors, deferred decisions, the status machine, watched memory files, maintenance."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.sources.memory_files import parsed
from mnemospark.streaming.sessions import TTL_MS

STATE = "body string"
INJECTED = "session_id string, step long, new_messages long, rewritten boolean, attached array<string>, blocks long, decision string"
DECISION_TTL_MS = 600_000
REOPENED = ("done", "skipped", "failed")
ATTEMPTS = 3
DAY_MS = 24 * 3600 * 1000


def inject(s: dict, step) -> tuple:
    """One step against a session's state ``s`` (seen, last, anchors, injected, slot), which it changes.

    A rewritten history clears anchors and what was injected. Hits not yet injected in the session are anchored to the step's last message; an anchor is attached again
    while its message is unchanged. The decision made on the previous step applies now, if it is at most ten minutes old; this step's waits for the next.
    """
    hashes = list(step.hashes)
    seen = s["seen"]
    rewritten = bool(seen) and (len(hashes) < seen or hashes[seen - 1] != s["last"])
    if rewritten:
        s |= {"seen": 0, "anchors": [], "injected": []}
    fresh = len(hashes) - s["seen"]
    s |= {"seen": len(hashes), "last": hashes[-1] if hashes else None}
    s["anchors"] = [a for a in s["anchors"] if a[0] < len(hashes) and hashes[a[0]] == a[1]]
    new = [h for h in dict.fromkeys(step.hits if step.hits is not None else []) if h not in s["injected"]]
    if new and hashes:
        s["anchors"].append([len(hashes) - 1, hashes[-1], new])
        s["injected"] += new
    slot = s["slot"]
    decision = slot[1] if slot and step.at - slot[0] <= DECISION_TTL_MS else None
    s["slot"] = [step.at, step.decision] if isinstance(step.decision, str) else None
    return fresh, rewritten, [h for a in s["anchors"] for h in a[2]], len(s["anchors"]), decision


def _injected(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    s = json.loads(state.get[0]) if state.exists else {"seen": 0, "last": None, "anchors": [], "injected": [], "slot": None}
    steps = pd.concat(list(frames))  # the steps of one session in one trigger; their order is not that of the frames
    out = [(key[0], p.step, *inject(s, p)) for p in steps.sort_values("step").itertuples(index=False)]
    state.update((json.dumps(s),))
    state.setTimeoutDuration(TTL_MS)
    yield pd.DataFrame(out, columns=["session_id", "step", "new_messages", "rewritten", "attached", "blocks", "decision"])


def injections(steps: DataFrame) -> DataFrame:
    """Stream of (session_id, step, at (ms), hashes array<string>, hits array<string>, decision) to what each step is given."""
    return steps.groupBy("session_id").applyInPandasWithState(_injected, INJECTED, STATE, "append", "ProcessingTimeTimeout")


def transition(status: str | None, attempts: int, event: str) -> tuple[str, int]:
    """Status and attempts of a session after an event: step, request, done, skipped or failed."""
    if event == "step":
        return ("open" if status is None or status in REOPENED else status), attempts
    if event == "request":
        return ("pending" if status in ("open", *REOPENED) else status or "pending"), attempts
    return event, attempts + 1 if event == "failed" else 0


def _status(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    status, attempts = state.get if state.exists else (None, 0)
    for e in pd.concat(list(frames)).sort_values(["at", "event"]).itertuples(index=False):
        status, attempts = transition(status, attempts, e.event)
    state.update((status, attempts))
    yield pd.DataFrame({"session_id": [key[0]], "status": [status], "attempts": [attempts], "due": [status == "pending" and attempts < ATTEMPTS]})


def statuses(events: DataFrame) -> DataFrame:
    """Stream of (session_id, at, event) to each session's status after a trigger; pending ones with fewer than three attempts are due."""
    return events.groupBy("session_id").applyInPandasWithState(_status, "session_id string, status string, attempts long, due boolean", "status string, attempts long", "update", "NoTimeout")


def watched(spark: SparkSession, path: str) -> DataFrame:
    """Stream of memory files as they are written: (path, memory, version, error)."""
    files = spark.readStream.format("text").option("wholetext", "true").load(path).select(F.col("_metadata.file_path").alias("path"), "value")
    return parsed(files)


def indexed(files: DataFrame, store: str, checkpoint: str, again: Callable[[DataFrame], None] | None = None):
    """Start the incremental index: each trigger's memories (latest of an id) replace those of the table ``store``; ``again`` gets the changed rows.

    The table is written anew beside the old one and a pointer moved, so a reader never sees half of it.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.where("error is null").groupBy("memory.id").agg(F.max_by("memory", F.struct(F.coalesce("memory.updated_at", F.lit("")), "path")).alias("memory"))
        old = current(spark, store)
        rows = new if old is None else new.unionByName(old.join(new.select("id"), "id", "left_anti"))
        rows.write.mode("overwrite").parquet(f"{store}/v{number}")
        spark.createDataFrame([(number,)], "version long").coalesce(1).write.mode("append").parquet(f"{store}/versions")
        if again:
            again(new)

    return files.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def current(spark: SparkSession, store: str) -> DataFrame | None:
    """The rows of the table's latest version, or None before the first."""
    from pyspark.errors import AnalysisException

    try:
        last = spark.read.parquet(f"{store}/versions").agg(F.max("version")).first()[0]
    except AnalysisException:
        return None
    return None if last is None else spark.read.parquet(f"{store}/v{last}")


def maintenance_due(last_ms: int | None, now_ms: int) -> bool:
    """Hourly looks start maintenance at most once in 24 hours; a query's trigger is ``processingTime='60 seconds'``."""
    return last_ms is None or now_ms - last_ms >= DAY_MS

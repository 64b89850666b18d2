"""Versioned memory table with journalled batches.

``versions`` (mem_id, version, batch_id, body, deleted) is append-only; the current state is the
latest version of each id. A batch is one append, so it is there wholly or not at all; a rollback
appends the versions before it and is refused where a later batch changed the same memories.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSIONS = "mem_id string, version bigint, batch_id string, body string, deleted boolean"
REST = ["version", "batch_id", "body", "deleted"]


def _latest(versions: DataFrame) -> DataFrame:
    return versions.groupBy("mem_id").agg(F.max(F.struct(*REST)).alias("x")).select("mem_id", "x.*")


def current(versions: DataFrame) -> DataFrame:
    return _latest(versions).where("not deleted").drop("deleted")


def applied(versions: DataFrame, updates: DataFrame, batch_id: str) -> DataFrame:
    """Rows a batch appends: (mem_id, body, expected_version), body null deletes; rows whose memory changed since are not applied."""
    now = _latest(versions).select("mem_id", F.col("version").alias("now"))
    j = updates.join(now, "mem_id", "left").withColumn("now", F.coalesce("now", F.lit(0)))
    return j.where(F.col("now") == F.coalesce("expected_version", F.lit(0))).select(
        "mem_id", (F.col("now") + 1).alias("version"), F.lit(batch_id).alias("batch_id"), F.col("body"), F.col("body").isNull().alias("deleted")
    )


def conflicts(versions: DataFrame, batch_id: str) -> DataFrame:
    """Memories of the batch that a later batch changed: a rollback would lose that change."""
    mine = versions.where(F.col("batch_id") == batch_id).groupBy("mem_id").agg(F.max("version").alias("mine"))
    return mine.join(_latest(versions).select("mem_id", "version"), "mem_id").where("version > mine").select("mem_id")


def rolled_back(versions: DataFrame, batch_id: str) -> DataFrame:
    """Rows a rollback appends: each memory as it was before the batch (deleted if it wasn't there)."""
    if not conflicts(versions, batch_id).isEmpty():
        raise ValueError(f"batch {batch_id} was changed since")
    first = versions.where(F.col("batch_id") == batch_id).groupBy("mem_id").agg(F.min("version").alias("first"), F.max("version").alias("last"))
    before = versions.join(first, "mem_id").where("version < first").groupBy("mem_id").agg(F.max(F.struct("version", "body", "deleted")).alias("x"))
    return first.join(before, "mem_id", "left").select(
        "mem_id", (F.col("last") + 1).alias("version"), F.lit(f"rollback:{batch_id}").alias("batch_id"), F.col("x.body").alias("body"), F.coalesce("x.deleted", F.lit(True)).alias("deleted")
    )

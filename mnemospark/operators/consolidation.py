"""Consolidation: digests, duplicates, expiry, proposals."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions.lists import DERIVED_TYPES
from mnemospark.functions.text import normalize


def topic_digests(memories: DataFrame, least: int = 3, most: int = 35) -> DataFrame:
    """(scope, topic, members, digest): titles of the newest members, oldest first, of topics with enough members.

    A line has at most clamp(3200 / members, 90, 200) characters, so a digest is bounded.
    """
    m = memories.where(~F.coalesce("mem_type", F.lit("")).isin(DERIVED_TYPES))
    t = m.select(F.lower("mem_scope").alias("scope"), F.explode(F.array_distinct("topics")).alias("topic"), "mem_id", F.coalesce("title", F.lit("")).alias("title"), "created_at")
    w = Window.partitionBy("scope", "topic")
    r = t.withColumn("n", F.row_number().over(w.orderBy(F.desc("created_at"), F.desc("mem_id")))).withColumn("c", F.count("*").over(w))
    r = r.where((F.col("c") >= least) & (F.col("n") <= most))
    line = F.concat(F.lit("- "), F.substring("title", F.lit(1), F.greatest(F.lit(90), F.least(F.lit(200), F.floor(3200 / F.col("c")))).cast("int")))
    lines = F.sort_array(F.collect_list(F.struct("created_at", "mem_id", line.alias("line"))))
    return r.groupBy("scope", "topic").agg(F.max("c").alias("members"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("digest"))


def exact_duplicates(memories: DataFrame) -> DataFrame:
    """(mem_id, first_id) of memories whose scope, type and normalised text an earlier id has: one hash per text is shuffled."""
    n = memories.select("mem_id", F.lower("mem_scope").alias("scope"), F.coalesce("mem_type", F.lit("")).alias("kind"), F.md5(normalize(F.col("content"))).alias("h"))
    first = n.groupBy("scope", "kind", "h").agg(F.min("mem_id").alias("first_id"), F.count("*").alias("c")).where("c > 1")
    return n.join(first, ["scope", "kind", "h"]).where("mem_id <> first_id").select("mem_id", "first_id")


def expired(memories: DataFrame, now) -> DataFrame:
    """Memories with ``expires`` before ``now`` become archived; unparsable dates never expire."""
    due = F.try_to_timestamp("expires") < F.lit(now).cast("timestamp")
    return memories.withColumn("status", F.when(F.coalesce(due, F.lit(False)), "archived").otherwise(F.col("status")))


def apply_proposals(memories: DataFrame, proposals: DataFrame) -> DataFrame:
    """Fold ordered proposals (scope, seq, action, mem_id, content) into memories (mem_id, scope, content, status, mentions).

    create adds; update replaces the text; supersede closes the old memory and adds the new text under ``mem_id`` || '+' || seq;
    contradict marks contested; mention counts. The order within a scope matters, so a scope's proposals (one
    extraction, at most 40) are folded in one place; memories without proposals pass by.
    """
    schema = "mem_id string, scope string, content string, status string, mentions bigint"

    def run(key, state: pd.DataFrame, steps: pd.DataFrame) -> pd.DataFrame:
        rows = {r.mem_id: r._asdict() for r in state.itertuples(index=False)}
        for p in steps.sort_values("seq").itertuples(index=False):
            old = rows.get(p.mem_id)
            if p.action == "create" and old is None:
                rows[p.mem_id] = {"mem_id": p.mem_id, "scope": key[0], "content": p.content, "status": "active", "mentions": 0}
            elif old is None:
                continue
            elif p.action == "update":
                old["content"] = p.content
            elif p.action == "supersede":
                old["status"] = "superseded"
                name = f"{p.mem_id}+{p.seq}"
                rows[name] = {"mem_id": name, "scope": key[0], "content": p.content, "status": "active", "mentions": 0}
            elif p.action == "contradict":
                old["status"] = "contested"
            elif p.action == "mention":
                old["mentions"] += 1
        return pd.DataFrame(list(rows.values()), columns=["mem_id", "scope", "content", "status", "mentions"])

    # only the memories that proposals name meet them
    named = proposals.select("scope", "mem_id").distinct()
    columns = ["mem_id", "scope", "content", "status", "mentions"]
    touched = memories.join(named, ["scope", "mem_id"], "left_semi").select(columns)
    rest = memories.join(named, ["scope", "mem_id"], "left_anti").select(columns)
    steps = proposals.select("scope", "seq", "action", "mem_id", "content").toDF("scope", "seq", "action", "mem_id", "content")  # columns of their own
    return rest.unionByName(touched.toDF(*columns).groupBy("scope").cogroup(steps.groupBy("scope")).applyInPandas(run, schema))

"""Planned search: several queries and a date window per question, merged into one list; and result packing for many questions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions.text import date_end, date_start
from mnemospark.operators.retrieval import pack

IN_WINDOW = 0.15


def in_window(date: Column, after: Column, before: Column) -> Column:
    """Whether the range of a partial date overlaps [after, before]; an open side is no bound, an unreadable date is outside."""
    lo, hi = date_start(date), date_end(date)
    a, b = F.coalesce(date_start(after), F.lit(0)), F.coalesce(date_end(before), F.lit(99999999))
    return F.coalesce((lo <= b) & (hi >= a), F.lit(False))


def planned(hits: DataFrame, plans: DataFrame, limit: int) -> DataFrame:
    """(question_id, mem_id, score, position) from hits (question_id, query_no, mem_id, score, date) and plans (question_id, after, before).

    Hits inside the plan's window gain 0.15. The best of each query comes first, then the rest by score; an id once; at most ``limit``.
    """
    p = F.col("after").isNotNull() | F.col("before").isNotNull()
    lifted = hits.join(plans, "question_id", "left").withColumn(
        "score", F.col("score") + F.when(p & in_window(F.col("date"), F.col("after"), F.col("before")), IN_WINDOW).otherwise(0.0)
    )
    rank = F.row_number().over(Window.partitionBy("question_id", "query_no").orderBy(F.desc("score"), "mem_id"))
    first = lifted.withColumn("best", (rank == 1).cast("int"))
    once = first.groupBy("question_id", "mem_id").agg(F.max("score").alias("score"), F.max("best").alias("best"))
    position = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("best"), F.desc("score"), "mem_id"))
    return once.withColumn("position", position).where(F.col("position") <= limit).select("question_id", "mem_id", "score", "position")


def packed(hits: DataFrame, budget: int) -> DataFrame:
    """(question_id, rank, id, kind, tokens) to the hits that fit each question's budget, in packing order. Lists of many questions are packed in one batch."""
    lists = hits.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "kind", "tokens"))).alias("l"))
    lists = lists.select("question_id", *[F.col(f"l.{c}").alias(c) for c in ("id", "kind", "tokens")])

    def run(frames):
        for f in frames:
            rows = []
            for question, *columns in zip(f["question_id"], f["id"], f["kind"], f["tokens"]):
                kept = pack([{"id": i, "kind": k, "tokens": t} for i, k, t in zip(*columns)], budget)
                rows += [(question, h["id"], n) for n, h in enumerate(kept, 1)]
            yield pd.DataFrame(rows, columns=["question_id", "id", "position"])

    return lists.mapInPandas(run, "question_id string, id string, position int")

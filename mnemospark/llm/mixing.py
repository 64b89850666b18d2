"""Problem 8: a mixture of sources at target weights, by pivotal dependent rounding.

With ``S`` tokens and at most ``r`` copies in a source of share ``w``, the largest mixture that
meets every share has ``T = min(S * r / w)`` tokens. Each document of a source then
needs ``c = T * w / S`` copies: ``floor(c)`` for sure and one more with probability
``c - floor(c)``. Pivotal rounding decides these fractions two documents at a time:
token mass moves at random from one to the other until one of them is
certain, which keeps each document's probability and the source's expected tokens.
A partition leaves at most one undecided document per source; these meet in a
reduction tree of fan-in ``FAN`` until one per source is left, so a source
misses its share by less than one document.

Defined results: null and unlisted sources and documents without tokens are not in
the mixture; a target without documents is left out and the other shares are
scaled to sum to 1 (``shares`` reports it with 0); target rows with null source,
share or repeats, share <= 0 or repeats < 1 are left out; empty tables: empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.llm.tokens import VOCABULARY, sized
from mnemospark.plans.lineage import written
from mnemospark.sources.tables import table

PART = 20_000
FAN = 64
SOURCES = 10_000
SEED = 20240607
ROW = "source string, part bigint, doc_id bigint, tokens bigint, base bigint, p double"


def pivot(p: np.ndarray, w: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Round all but at most one of ``p`` to 0 or 1, keeping sum(p * w); order of the arrays is kept."""
    p = p.astype(np.float64).copy()
    u = rng.random(len(p))
    held = -1
    for i in range(len(p)):
        if not 0 < p[i] < 1:
            continue
        if held < 0:
            held = i
            continue
        a, b = held, i
        up = min((1 - p[a]) * w[a], p[b] * w[b])
        down = min(p[a] * w[a], (1 - p[b]) * w[b])
        move = up if u[i] * (up + down) < down else -down
        p[a] += move / w[a]
        p[b] -= move / w[b]
        for k in (a, b):
            p[k] = 0.0 if p[k] < 1e-9 else 1.0 if p[k] > 1 - 1e-9 else p[k]
        held = a if 0 < p[a] < 1 else b if 0 < p[b] < 1 else -1
    return p


def _rounded(level: int):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["tokens", "doc_id"], ascending=[False, True], ignore_index=True)  # the undecided one ends up small
        seed = [SEED, level, int(f["part"].iloc[0]) & 0x7FFFFFFF, int(f["doc_id"].iloc[0]) & 0x7FFFFFFF]
        f["p"] = pivot(f["p"].to_numpy(), f["tokens"].to_numpy(np.float64), np.random.default_rng(seed))
        return f[[c.split()[0] for c in ROW.split(", ")]]

    return run


def plan(sizes: DataFrame, targets: DataFrame) -> list[dict]:
    """Per target source: share, repeats, tokens available and copies a document needs; bounded by the target table."""
    t = targets.select(F.lower(F.trim("source")).alias("source"), "target_share", "max_repeats").where(
        "source is not null and target_share > 0 and max_repeats >= 1"
    )
    t = t.groupBy("source").agg(F.sum("target_share").alias("share"), F.min("max_repeats").alias("repeats"))
    have = sizes.where("tokens > 0").groupBy("source").agg(F.sum("tokens").alias("available"), F.count("*").alias("n"))
    rows = [r.asDict() for r in t.join(have, "source", "left").na.fill(0, ["available", "n"]).orderBy("source").limit(SOURCES + 1).collect()]
    if len(rows) > SOURCES:
        raise ValueError(f"more than {SOURCES} target sources")
    there = [r for r in rows if r["available"]]
    scale = sum(r["share"] for r in there)
    total = min((r["available"] * r["repeats"] * scale / r["share"] for r in there), default=0)
    for r in rows:
        r["copies"] = total * r["share"] / scale / r["available"] if r["available"] else 0.0
        if abs(r["copies"] - round(r["copies"])) < 1e-12:
            r["copies"] = float(round(r["copies"]))
    return rows


def mixture(sizes: DataFrame, rows: list[dict]) -> DataFrame:
    """(doc_id, source, tokens, copies) with at least one copy."""
    spark = sizes.sparkSession
    plan_rows = [(r["source"], int(math.floor(r["copies"])), float(r["copies"] - math.floor(r["copies"])), max(1, -(-r["n"] // PART))) for r in rows if r["available"]]
    if not plan_rows:
        return spark.createDataFrame([], "doc_id bigint, source string, tokens bigint, copies bigint")
    small = spark.createDataFrame(plan_rows, "source string, base bigint, p double, parts bigint")
    state = sizes.where("tokens > 0").join(F.broadcast(small), "source")
    state = state.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts"))).select("source", "part", F.col("doc_id").cast("bigint").alias("doc_id"), "tokens", "base", "p")
    done, parts = [], max(r[3] for r in plan_rows)
    for level in range(64):
        state = written(state.groupBy("source", "part").applyInPandas(_rounded(level), ROW), "p8-level")
        if parts == 1:
            done.append(state)
            break
        done.append(state.where("p = 0 or p = 1"))
        state = state.where("p > 0 and p < 1").withColumn("part", F.floor(F.col("part") / FAN))
        parts = -(-parts // FAN)
    # the last one of a source: a coin of its probability
    coin = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)
    last = F.when(coin < F.col("p"), 1).otherwise(0)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("doc_id", "source", "tokens", (F.col("base") + last).alias("copies")).where("copies > 0")


def shares(mix: DataFrame, rows: list[dict]) -> DataFrame:
    """Per target source: target_share, max_repeats, tokens available and in the mixture, share reached, documents, most copies."""
    spark = mix.sparkSession
    plan_rows = spark.createDataFrame(
        [(r["source"], float(r["share"]), int(r["repeats"]), int(r["available"])) for r in rows],
        "source string, target_share double, max_repeats bigint, available_tokens bigint",
    )
    per = mix.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    joined = plan_rows.join(per, "source", "left").na.fill(0, ["mixed", "documents", "most_copies"])
    joined = joined.withColumn("total", F.nullif(F.sum("mixed").over(Window.partitionBy()), F.lit(0)))  # one row a target
    return joined.select(
        "source", "target_share", "max_repeats", "available_tokens", F.col("mixed").alias("mixed_tokens"),
        F.round(F.coalesce(F.col("mixed") / F.col("total"), F.lit(0.0)), 6).alias("share"), "documents", "most_copies",
    )


def _inputs(spark, sf_dir, vocabulary):
    sizes = sized(table(spark, sf_dir, "documents"), vocabulary)
    return sizes, plan(sizes, table(spark, sf_dir, "mix_targets"))


def document_mixture(spark, sf_dir, vocabulary: str = VOCABULARY) -> DataFrame:
    return mixture(*_inputs(spark, sf_dir, vocabulary))


def document_shares(spark, sf_dir, vocabulary: str = VOCABULARY) -> DataFrame:
    sizes, rows = _inputs(spark, sf_dir, vocabulary)
    return shares(mixture(sizes, rows), rows)

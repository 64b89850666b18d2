"""Evaluation: retrieval metrics, intervals, rank correlation, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def retrieval_metrics(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """hit@1, recall@3 and MRR per category and over all, from ranked (query_id, mem_id, rank) and gold (query_id, category, expected)."""
    wanted = gold.select("query_id", "category", F.explode("expected").alias("mem_id"))
    best = wanted.join(ranked, ["query_id", "mem_id"]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    m = gold.select("query_id", "category").join(best, "query_id", "left")
    found = F.coalesce(F.col("rank"), F.lit(1 << 30))
    m = m.select("category", (found == 1).cast("double").alias("h"), (found <= 3).cast("double").alias("r3"), F.coalesce(1 / F.col("rank"), F.lit(0.0)).alias("rr"))
    return (
        m.rollup("category")
        .agg(F.count("*").alias("questions"), F.round(F.avg("h"), 6).alias("hit1"), F.round(F.avg("r3"), 6).alias("recall3"), F.round(F.avg("rr") + 1e-9, 6).alias("mrr"))
        .withColumn("category", F.coalesce("category", F.lit("all")))
    )


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p = successes / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return mid - half, mid + half


def kendall_tau_b(rows: DataFrame, group: str, item: str, x: str, y: str) -> DataFrame:
    """tau-b per group from the pairs i < j of the group; groups are rankings of bounded length."""
    b = rows.select(group, F.col(item).alias("j"), F.col(x).alias("x2"), F.col(y).alias("y2"))
    p = rows.join(b, group).where(F.col(item) < F.col("j"))
    sx, sy = F.signum(F.col(x) - F.col("x2")), F.signum(F.col(y) - F.col("y2"))
    per = p.groupBy(group).agg(F.count("*").alias("pairs"), F.sum(sx * sy).alias("s"), F.sum(F.abs(sx)).alias("nx"), F.sum(F.abs(sy)).alias("ny"))
    return per.select(group, "pairs", F.round(F.col("s") / F.nullif(F.sqrt(F.col("nx") * F.col("ny")), F.lit(0.0)), 6).alias("tau"))


def nth_percentile(rows: DataFrame, group: str, value: str, p: float) -> DataFrame:
    """sorted[min(n - 1, floor((n - 1) * p))] per group, by rank: no list of values is built."""
    w = Window.partitionBy(group)
    r = rows.where(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(w.orderBy(value))).withColumn("_n", F.count("*").over(w))
    return r.where(F.col("_r") == F.floor((F.col("_n") - 1) * p) + 1).select(group, F.col(value).alias("percentile"), F.col("_n").alias("n"))


def largest_remainder(counts: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Seats per key in proportion to its count; the largest fractions get what rounding leaves."""
    everything = F.sum(count).over(Window.partitionBy())
    q = counts.withColumn("_exact", F.col(count) * total / everything).withColumn("_seats", F.floor("_exact"))
    left = F.lit(total) - F.sum("_seats").over(Window.partitionBy())
    order = F.row_number().over(Window.partitionBy().orderBy(F.desc(F.round(F.col("_exact") - F.col("_seats"), 9)), key))
    return q.withColumn("_left", left).withColumn("_order", order).select(key, count, (F.col("_seats") + (F.col("_order") <= F.col("_left")).cast("bigint")).alias("seats"))


def aligned(reference: list[str], lines: list[str], same) -> list[str]:
    """Answer lines with each replaced by the first unused reference event that ``same(event, line)`` accepts; blank and unmatched lines stay."""
    left = dict.fromkeys(range(len(reference)))
    out = []
    for line in lines:
        hit = next((i for i in left if same(reference[i], line)), None) if line.strip() else None
        if hit is not None:
            del left[hit]
        out.append(line if hit is None else reference[hit])
    return out


def ordering(reference: list[str], system: list[str]) -> dict[str, float]:
    """Precision, recall and F1 of the events named, Kendall tau-b of both over all events (missing ones tie at the end), and tau normalised to [0, 1]."""
    both = set(reference) & set(system)
    p, r = len(both) / max(len(set(system)), 1), len(both) / max(len(set(reference)), 1)
    union = list(dict.fromkeys([*reference, *system]))
    rank = lambda of: [of.index(x) if x in of else len(of) for x in union]
    a, b = rank(reference), rank(system)
    sign = lambda x: (x > 0) - (x < 0)
    pairs = [(sign(a[i] - a[j]), sign(b[i] - b[j])) for i in range(len(a)) for j in range(i)]
    n1, n2 = sum(x != 0 for x, _ in pairs), sum(y != 0 for _, y in pairs)
    tau = sum(x * y for x, y in pairs) / (n1 * n2) ** 0.5 if n1 and n2 else 0.0
    return {"precision": p, "recall": r, "f1": 2 * p * r / (p + r) if p + r else 0.0, "tau": tau, "normalised": (tau + 1) / 2}

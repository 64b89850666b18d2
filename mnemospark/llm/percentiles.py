"""Problem 3: percentiles per group by merging centroid digests, certified by counting.

A digest is a list of centroids (mean, weight) of sorted values, clustered so
that no centroid spans more than one unit of the size function
``k(q) = DELTA / (2 * pi) * asin(2 * q - 1)``: fine at both tails, coarse in the
middle. Each block of rows is clustered where it is read; centroids of one group
are merged by sorting and clustering again in a reduction tree over partitions,
so a group holding a third of all rows never meets in one task. Digests of
days merge into digests of any period.

A second pass counts, for each estimate, the values below and up to it. The
certified rank error is the distance from the wanted rank to that interval of
ranks, as a share of the count; it is measured over all rows, not estimated.

Defined results: null, NaN, infinite or negative search_ms and null kept_tokens
don't count; repeated rows of a key count once (the latest arrival); a null
group is a group of its own; a group without usable values doesn't appear;
equal values are fine (their centroid has that value); empty table: empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.plans.lineage import written
from mnemospark.sources.tables import latest, table

DELTA = 400
QUANTILES = (0.5, 0.9, 0.95, 0.99)
FAN = 64
ROWS = 300_000
SCHEMA = "grp string, day date, measure string, mean double, weight double, low double, high double"


def cluster(mean: np.ndarray, weight: np.ndarray, low: np.ndarray, high: np.ndarray, delta: int = DELTA):
    """Merge centroids sorted by mean under the size function; minima and maxima stay exact."""
    order = np.lexsort((high, low, mean))
    mean, weight, low, high = mean[order], weight[order], low[order], high[order]
    total = weight.sum()
    right = np.cumsum(weight)
    k_left = delta * (np.arcsin(np.clip(2 * (right - weight) / total - 1, -1, 1)) / np.pi + 0.5)
    k_right = delta * (np.arcsin(np.clip(2 * right / total - 1, -1, 1)) / np.pi + 0.5)
    # an input centroid joins the cluster of the unit of k in which it ends; one that spans units alone stays alone
    unit = np.where(np.floor(k_right - 1e-9) > np.floor(k_left + 1e-9), np.floor(k_left + 1e-9) + 0.5, np.floor(k_left + 1e-9))
    cut = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
    w = np.add.reduceat(weight, cut)
    m = np.add.reduceat(mean * weight, cut) / w
    lo, hi = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
    return np.clip(m, lo, hi), w, lo, hi


def quantile(mean, weight, low, high, q: float) -> float:
    """Value at rank q: linear between centroid centres, exact at the ends."""
    order = np.argsort(mean, kind="stable")
    mean, weight = mean[order], weight[order]
    centre = np.cumsum(weight) - weight / 2
    at = q * weight.sum()
    return float(np.interp(at, np.concatenate([[0], centre, [weight.sum()]]), np.concatenate([[low.min()], mean, [high.max()]])))


def _frames(parts):
    rows = [p for p in parts if len(p[3])]
    if not rows:
        return pd.DataFrame({c.split()[0]: [] for c in SCHEMA.split(", ")})
    n = [len(p[3]) for p in rows]
    return pd.DataFrame(
        {
            "grp": np.repeat(np.array([p[0] for p in rows], object), n),
            "day": np.repeat(np.array([p[1] for p in rows], object), n),
            "measure": np.repeat(np.array([p[2] for p in rows], object), n),
            **{c: np.concatenate([p[3 + i] for p in rows]) for i, c in enumerate(("mean", "weight", "low", "high"))},
        }
    )


def _blocks(frames):
    """Arrow batches joined to blocks of up to ROWS rows: fewer, fuller digests."""
    held, n = [], 0
    for f in frames:
        held.append(f)
        n += len(f)
        if n >= ROWS:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if n:
        yield pd.concat(held, ignore_index=True)


def _digested(frames):
    """Rows (grp, day, measure columns) of a block to the digests of its groups."""
    for f in _blocks(frames):
        out = []
        for measure in ("search_ms", "kept_tokens"):
            v = f[measure].to_numpy(np.float64)
            ok = np.isfinite(v)
            if measure == "search_ms":
                ok &= v >= 0
            sub = pd.DataFrame({"grp": f["grp"], "day": f["day"], "v": v})[ok]
            for (g, d), x in sub.groupby(["grp", "day"], dropna=False, sort=False)["v"]:
                s = x.to_numpy()
                m, w, lo, hi = cluster(s, np.ones(len(s)), s, s)
                out.append((None if pd.isna(g) else g, None if pd.isna(d) else d, measure, m, w, lo, hi))
        yield _frames(out)


def _merged(f: pd.DataFrame) -> pd.DataFrame:
    first = f.iloc[0]
    m, w, lo, hi = cluster(*(f[c].to_numpy(np.float64) for c in ("mean", "weight", "low", "high")))
    return _frames([(first["grp"], first["day"], first["measure"], m, w, lo, hi)])


def digests(rows: DataFrame) -> DataFrame:
    """Rows (grp, day, search_ms, kept_tokens) to mergeable digests per (grp, day, measure), written."""
    return merge(rows.mapInPandas(_digested, SCHEMA), "grp", "day", "measure")


def merge(centroids: DataFrame, *keys: str) -> DataFrame:
    """Merge digests by ``keys``; dropped keys become null.

    A reduction tree over the partitions the digests come from, ``FAN`` at a time: no task merges more than
    FAN partitions' digests of one group, however many there are.
    """
    gone = {c: F.lit(None).cast(t) for c, t in (("grp", "string"), ("day", "date")) if c not in keys}
    flat = written(centroids.withColumns({**gone, "part": F.spark_partition_id().cast("bigint")}), "p3-centroids")
    parts = (flat.agg(F.max("part")).first()[0] or 0) + 1

    def run(key, f: pd.DataFrame) -> pd.DataFrame:
        return _merged(f).assign(part=key[-1])

    while True:
        parts = -(-parts // FAN)
        flat = flat.withColumn("part", F.floor(F.col("part") / FAN)).groupBy(*keys, "part").applyInPandas(run, SCHEMA + ", part bigint")
        if parts == 1:
            return written(flat.drop("part"), "p3-digests")
        flat = written(flat, "p3-level")


def _estimated(quantiles):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        a = [f[c].to_numpy(np.float64) for c in ("mean", "weight", "low", "high")]
        est = np.maximum.accumulate([quantile(*a, q) for q in quantiles])
        return pd.DataFrame(
            {"grp": f["grp"].iloc[0], "measure": f["measure"].iloc[0], "q": list(quantiles), "estimate": est, "centroids": len(f), "total": int(a[1].sum())}
        )

    return run


def certified(rows: DataFrame, digest: DataFrame, quantiles=QUANTILES) -> DataFrame:
    """(question_type, measure, quantile, value, n, centroids, rank_error): rank_error counted over all rows."""
    schema = "grp string, measure string, q double, estimate double, centroids int, total bigint"
    est = written(digest.groupBy("grp", "measure").applyInPandas(_estimated(quantiles), schema), "p3-estimates")
    per = est.groupBy("grp").pivot("measure", ["search_ms", "kept_tokens"]).agg(F.sort_array(F.collect_list("estimate")))
    joined = rows.select(F.col("grp").alias("g"), "search_ms", "kept_tokens").join(
        per.select("grp", F.col("search_ms").alias("e_ms"), F.col("kept_tokens").alias("e_tok")), F.col("g").eqNullSafe(F.col("grp")), "inner"
    )
    ms = F.col("search_ms")
    usable = {"search_ms": (ms >= 0) & ~F.isnan(ms) & (ms < float("inf")), "kept_tokens": F.col("kept_tokens").isNotNull()}
    sums = []
    for measure, e in (("search_ms", "e_ms"), ("kept_tokens", "e_tok")):
        for i in range(len(quantiles)):
            v, x = F.col(measure).cast("double"), F.col(e)[i]
            sums.append(F.sum(F.when(usable[measure] & (v < x), 1).otherwise(0)).alias(f"{measure}_{i}_below"))
            sums.append(F.sum(F.when(usable[measure] & (v <= x), 1).otherwise(0)).alias(f"{measure}_{i}_upto"))
    counted = joined.groupBy("grp").agg(*sums)
    cells = [
        F.struct(F.lit(m).alias("measure"), F.lit(float(q)).alias("q"), F.col(f"{m}_{i}_below").alias("below"), F.col(f"{m}_{i}_upto").alias("upto"))
        for m in ("search_ms", "kept_tokens")
        for i, q in enumerate(quantiles)
    ]
    counted = counted.select(F.col("grp").alias("g"), F.explode(F.array(*cells)).alias("x")).select("g", "x.*")
    rank = F.col("quantile") * F.col("n")
    error = F.greatest(F.lit(0.0), F.col("below") - rank, rank - F.col("upto")) / F.col("n")
    left = est.select("grp", F.col("measure").alias("m"), F.col("q").alias("quantile"), "estimate", "centroids", F.col("total").alias("n"))
    return left.join(
        counted, F.col("grp").eqNullSafe(F.col("g")) & (F.col("m") == F.col("measure")) & (F.col("quantile") == F.col("q"))
    ).select(F.col("grp").alias("question_type"), "measure", "quantile", F.col("estimate").alias("value"), "n", "centroids", error.alias("rank_error"))


def eval_values(spark, sf_dir) -> DataFrame:
    """One row per row_id: question_type, run_day, search_ms, kept_tokens."""
    rows = table(spark, sf_dir, "eval_rows")
    return latest(rows, "row_id", "arrived_at", "row_id", "question_type", "run_day", "search_ms", "kept_tokens").select(
        F.col("question_type").alias("grp"), F.col("run_day").alias("day"), "search_ms", "kept_tokens"
    )


def percentiles(spark, sf_dir) -> DataFrame:
    rows = written(eval_values(spark, sf_dir), "p3-rows")
    return certified(rows, digests(rows.withColumn("day", F.lit(None).cast("date"))))


def daily_digests(spark, sf_dir) -> DataFrame:
    """Mergeable digests per run_day and question_type."""
    d = digests(eval_values(spark, sf_dir))
    return d.select(F.col("day").alias("run_day"), F.col("grp").alias("question_type"), "measure", "mean", "weight", "low", "high")

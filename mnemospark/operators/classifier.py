"""Search gate: hashed-feature logistic classifier, and decisions with their fall-back."""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 256
LEAST_SAMPLES, LEAST_CLASS = 2000, 100
EPOCHS, RATE, L2 = 8, 0.08, 0.001
SAMPLES = 100_000


def feature_words(features: dict[str, str]) -> list[str]:
    """Field-prefixed words and letter pairs, sorted and distinct."""
    out = set()
    for field, text in features.items():
        for w in re.findall(r"\w+", (text or "").lower()):
            out.add(f"{field}:{w}")
            out.update(f"{field}#{w[i : i + 2]}" for i in range(len(w) - 1))
    return sorted(out)


def slots(features: dict[str, str]) -> list[int]:
    """Weights a sample touches; slot 0 is the bias."""
    hashed = {int.from_bytes(hashlib.sha256(w.encode()).digest()[:8], "big") % (SIZE - 1) + 1 for w in feature_words(features)}
    return [0, *sorted(hashed)]


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def probability(weights: np.ndarray, active: list[int]) -> float:
    return sigmoid(float(weights[active].sum()))


def trained(samples: list[tuple[list[int], bool]]) -> dict | None:
    """Stochastic gradient descent in time order over the first 80 %, threshold by precision on the rest; None with too few samples.

    The descent is sequential: samples are (slots, label), at most ``SAMPLES`` of them.
    """
    samples = samples[-SAMPLES:]
    positive = sum(y for _, y in samples)
    if len(samples) < LEAST_SAMPLES or min(positive, len(samples) - positive) < LEAST_CLASS:
        return None
    cut = len(samples) * 4 // 5
    w = np.zeros(SIZE)
    for epoch in range(EPOCHS):
        rate = RATE / (1 + 0.3 * epoch)
        for active, y in samples[:cut]:
            g = probability(w, active) - y
            w[active] -= rate * (g + L2 * w[active])
    held = [(probability(w, a), y) for a, y in samples[cut:]]
    best = (0.0, -1, 0.5)
    for t in (x / 20 for x in range(1, 20)):
        chosen = [y for p, y in held if p >= t]
        if chosen:
            best = max(best, (sum(chosen) / len(chosen), len(chosen), t))
    return {"weights": w.tolist(), "threshold": best[2], "precision": best[0], "count": best[1]}


def scored(samples: DataFrame, weights: DataFrame) -> DataFrame:
    """(sample_id, slots) and (slot, weight) to (sample_id, probability), JVM-side."""
    z = samples.select("sample_id", F.explode("slots").alias("slot")).join(F.broadcast(weights), "slot", "left").groupBy("sample_id").agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("z"))
    z = z.withColumn("z", F.greatest(F.lit(-30.0), F.least(F.lit(30.0), "z")))
    return z.select("sample_id", (1 / (1 + F.exp(-F.col("z")))).alias("probability"))


def decided(steps: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Gate decisions: the verdict where there is one, else a normal search; only decision points (user turn or error) decide."""
    point = (F.col("role") == "user") | F.col("error_sig").isNotNull()
    j = steps.join(verdicts, "step_id", "left")
    return j.select(
        "step_id", F.when(point, F.coalesce("search", F.lit(True))).otherwise(False).alias("search"),
        F.coalesce("query", F.coalesce("user_text", "error_sig")).alias("query"), F.slice(F.coalesce("ids", F.array().cast("array<string>")), 1, 3).alias("ids"), (point & F.col("search").isNull()).alias("fallback"),
    )

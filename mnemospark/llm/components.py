"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.plans.lineage import written

MOST_ROUNDS = 40
NODES = 2_000_000


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("b"), F.col("m").alias("a")).where("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a"))
    least = down.groupBy("b").agg(F.min("a").alias("m"))
    joined = down.join(least, "b")
    return joined.select("b", F.col("m").alias("a")).unionByName(joined.select(F.col("a").alias("b"), F.col("m").alias("a"))).where("a <> b").distinct()


def _contracted(frames):
    """Links of one partition to stars around the smallest node of each local component, ``NODES`` nodes at a time."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def stars():
        rows = [(find(x), x) for x in list(root)]
        return pd.DataFrame([r for r in rows if r[0] != r[1]], columns=["a", "b"]).astype("int64")

    for f in frames:
        for a, b in zip(f["a"].tolist(), f["b"].tolist()):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
        if len(root) > NODES:
            yield stars()
            root.clear()
    yield stars()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the component is its smallest node; nodes without links do not appear.

    Each partition first contracts its own links to stars. Each round is then a pair of aggregations and joins over the links; only a row count
    and a checksum come to the driver. Rounds grow with the logarithm of the longest chain.
    """
    links = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b")
    e = written(links.mapInPandas(_contracted, "a bigint, b bigint"), "cc")
    before = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    for _ in range(MOST_ROUNDS):
        e = written(_small_star(_large_star(e)), "cc")
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not converge")
    return e.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("component"))).distinct()

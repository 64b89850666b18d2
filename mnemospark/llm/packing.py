"""Problem 7: documents into containers of fixed capacity, by bound-certified repacking.

Items are dealt to partitions of about ``PART`` items by a hash. Each partition packs
its items by best-fit decreasing and computes a lower bound of its bin count from
dual-feasible functions. A partition whose bins equal its bound is certified
optimal and never touched again. Partitions with a gap release their bins that
are not full; the released documents are dealt anew across those partitions and
packed again. This ends when all are certified, or when ``STALLED`` rounds in a row save no bin;
every other round saves one at least. Documents larger than a
container are cut into full containers and a rest; nothing else is split.

A global bound from the histogram of all sizes (at most ``capacity`` entries, and no more than there are
sizes) certifies the whole packing in ``summary`` and states the gap that remains. Memory is in proportion to the items of a
partition, not to the capacity.

Defined results: documents without tokens need no container and don't appear;
capacities that are null or below 1 are left out; empty tables: empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.tokens import VOCABULARY, sized
from mnemospark.plans.lineage import written
from mnemospark.sources.tables import table

PART = 10_000
STALLED = 2
PACKS = 100
PLACED = "pack_name string, capacity bigint, container string, doc_id bigint, piece int, tokens bigint, fill bigint, open boolean"


def lower_bound(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """Bins needed at least for ``counts[i]`` items of ``sizes[i]`` (distinct, at most capacity), by two families of dual-feasible functions."""
    order = np.argsort(sizes)
    s, n = sizes[order].astype(np.int64), counts[order].astype(np.float64)
    if not len(s):
        return 0
    best = np.ceil((n * s).sum() / capacity - 1e-9)
    # threshold functions: sizes above capacity - cut count a bin, those below cut nothing; only these cuts can be best
    over = np.append(np.cumsum(n[::-1])[::-1], 0)
    mass = np.concatenate([[0], np.cumsum(n * s)])
    cut = capacity - s + 1
    cut = cut[(cut >= 1) & (2 * cut <= capacity)]
    if len(cut):
        first, last = np.searchsorted(s, cut), np.searchsorted(s, capacity - cut, side="right")
        best = max(best, np.ceil((over[last] + (mass[last] - mass[first]) / capacity).max() - 1e-9))
    # rounding functions u_k
    for k in range(1, 31):
        x = (k + 1) * s
        u = np.where(x % capacity == 0, s / capacity, (x // capacity) / k)
        best = max(best, np.ceil((n * u).sum() - 1e-9))
    return int(best)


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of each item; sizes in decreasing order."""
    rests: list[int] = []  # the distinct spaces left, in order
    bins: dict[int, list[int]] = {}  # the bins of each
    out = np.empty(len(sizes), np.int64)
    used = 0
    for i, s in enumerate(sizes.tolist()):
        at = bisect_left(rests, s)
        if at < len(rests):
            r = rests[at]
            b = bins[r].pop()
            if not bins[r]:
                del bins[r], rests[at]
        else:
            b, r = used, capacity
            used += 1
        out[i] = b
        r -= s
        if r in bins:
            bins[r].append(b)
        elif r:
            bins[r] = [b]
            insort(rests, r)
    return out


def _packed(tag: str):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True], ignore_index=True)
        capacity = int(f["capacity"].iloc[0])
        sizes = f["tokens"].to_numpy(np.int64)
        b = best_fit(sizes, capacity)
        fill = np.bincount(b, weights=sizes).astype(np.int64)
        gap = len(fill) - lower_bound(*np.unique(sizes, return_counts=True), capacity)
        part = int(f["part"].iloc[0])
        f["container"] = [f"{tag}-{part}-{x}" for x in b]
        f["fill"] = fill[b]
        f["open"] = (gap > 0) & (f["fill"] < capacity)
        return f[[c.split()[0] for c in PLACED.split(", ")]]

    return run


def _parts(rows: int) -> int:
    return max(1, -(-rows // PART))


def pieces(sizes: DataFrame, packs: DataFrame) -> DataFrame:
    """(pack_name, capacity, doc_id, piece, tokens): each document, cut only if larger than the container."""
    good = packs.where((F.col("capacity_tokens") >= 1) & F.col("pack_name").isNotNull()).groupBy("pack_name").agg(F.max("capacity_tokens").alias("capacity"))
    rows = good.limit(PACKS + 1).collect()
    if len(rows) > PACKS:
        raise ValueError(f"more than {PACKS} capacities in one call")
    each = F.array(*[F.struct(F.lit(r["pack_name"]).alias("pack_name"), F.lit(r["capacity"]).cast("bigint").alias("capacity")) for r in rows])
    if not rows:
        each = each.cast("array<struct<pack_name:string,capacity:bigint>>")
    cut = F.floor((F.col("tokens") - 1) / F.col("capacity"))
    return (
        sizes.where("tokens > 0")
        .select("doc_id", "tokens", F.explode(each).alias("pack"))
        .select("doc_id", "tokens", "pack.*")
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), cut)))
        .withColumn("tokens", F.least("capacity", F.col("tokens") - F.col("piece") * F.col("capacity")))
        .select("pack_name", "capacity", "doc_id", F.col("piece").cast("int").alias("piece"), "tokens")
    )


def packed(sizes: DataFrame, packs: DataFrame) -> DataFrame:
    """Every piece with its container: pack_name, capacity, container, doc_id, piece, tokens, fill, open."""
    items = pieces(sizes, packs)
    good = packs.where((F.col("capacity_tokens") >= 1) & F.col("pack_name").isNotNull())
    capacities = sorted(r[0] for r in good.select("capacity_tokens").distinct().limit(PACKS).collect())  # pieces() has checked their number
    number = [F.sum(F.ceil(F.col("tokens") / F.lit(c))) for c in capacities]
    dealt = dict(zip(capacities, sizes.where("tokens > 0").agg(*number).first())) if capacities else {}

    def deal(rows: DataFrame, counts: dict[int, int], salt: int) -> DataFrame:
        # full pieces of one document go to many partitions, too
        parts = F.lit(1)
        for c, n in counts.items():
            parts = F.when(F.col("capacity") == c, _parts(n or 0)).otherwise(parts)
        return rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", F.lit(salt)), parts).cast("int"))

    def pack(rows: DataFrame, tag: str) -> DataFrame:
        return written(rows.groupBy("pack_name", "part").applyInPandas(_packed(tag), PLACED), "p7-placed")

    def bins(rows: DataFrame) -> tuple[int, dict[int, int]]:
        """Containers of all packs, and the pieces of each capacity."""
        per = rows.groupBy("capacity").agg(F.count_distinct("pack_name", "container").alias("bins"), F.count("*").alias("n")).collect()
        return sum(r["bins"] for r in per), {r["capacity"]: r["n"] for r in per}

    state = pack(deal(items, dealt, 0), "r0")
    done, loose = state.where("not open"), state.where("open")
    before, rows = bins(loose)
    stalled = i = 0
    while rows and stalled < STALLED:
        i += 1
        again = pack(deal(loose.select(items.columns), rows, i), f"r{i}")
        after = bins(again)[0]
        if after >= before:  # the old placement is as good
            stalled += 1
            continue
        stalled = 0
        done, loose = done.unionByName(again.where("not open")), again.where("open")
        before, rows = bins(loose)
    return done.unionByName(loose)


def summary(placed: DataFrame) -> DataFrame:
    """Per capacity: items, tokens, containers, certified lower bound, excess over it, share of space used."""
    sizes = placed.groupBy("pack_name", "capacity", "tokens").agg(F.count("*").alias("n"))

    def bound(f: pd.DataFrame) -> pd.DataFrame:
        capacity = int(f["capacity"].iloc[0])
        return pd.DataFrame({"pack": [f["pack_name"].iloc[0]], "lower_bound": [lower_bound(f["tokens"].to_numpy(np.int64), f["n"].to_numpy(), capacity)]})

    bounds = sizes.groupBy("pack_name").applyInPandas(bound, "pack string, lower_bound bigint")
    bins = placed.groupBy("pack_name", "capacity", "container").agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"))
    total = bins.groupBy("pack_name", "capacity").agg(F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), F.count("*").alias("containers"))
    return total.join(bounds, F.col("pack_name") == F.col("pack")).select(
        "pack_name", "capacity", "items", "tokens", "containers", "lower_bound",
        (F.col("containers") - F.col("lower_bound")).alias("excess"),
        F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("used"),
    )


def document_packing(spark, sf_dir, vocabulary: str = VOCABULARY) -> DataFrame:
    return packed(sized(table(spark, sf_dir, "documents"), vocabulary), table(spark, sf_dir, "pack_sizes"))

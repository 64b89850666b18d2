"""Problem 5: the most similar vectors of every vector.

Adaptive dimension scan over inverted lists. Usable vectors (64 finite
components, not all zero) are collapsed by exact value, so equal vectors are
compared once and expanded by their smallest ids. Centroids are fitted on a
bounded sample (``SAMPLE`` vectors in hash order), one for about ``LIST`` vectors;
every vector is then put into the list of its nearest centroid and visits each
list whose centroid is at most ``WIDTH`` farther in cosine. Lists longer than ``CHUNK`` get centroids of their own,
fitted on at most ``OWN`` of their vectors, and are routed once more, so lists stay short whatever the number of vectors. Within a list, all
vectors are rotated by one random orthogonal matrix and scanned in column
blocks: after each block every open pair's partial distance is tested against the distance its query has to
beat (the floor, or its k-th best so far); a pair whose distance exceeds it
under the test's bound is abandoned, as are rows and columns without an open pair. What remains gets its cosine in double
precision from the stored components. A pair found from either side counts for both.

Lists that are still longer than ``CHUNK`` (vectors that no centroid tells apart) are split; every chunk sees the visitors of its list. All vectors are indexed and all are queries;
recall against brute force is measured by the tests and given in the README.

Defined results: null key: left out; unusable vectors: no partner; repeated rows
of a key: latest embedded_at; equal cosines (six decimals): smaller id first;
fewer than k at or above the floor: fewer; empty table: empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.plans.lineage import written
from mnemospark.sources.tables import table

DIM = 64
K = 5
FLOOR = 0.8
SAMPLE = 40_000
LIST = 500
WIDTH = 0.1
CHUNK = 4096
OWN = 8192
PART = 50_000
DENSE = 0.08
COLUMNS = 16
EPS0 = 2.1
TIES = 4e-6


def rotation(dim: int = DIM, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def fit(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Unit centroids by spherical k-means on unit vectors."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        at = np.concatenate([np.argmax(sample[i : i + 8192] @ c.T, 1) for i in range(0, len(sample), 8192)])
        order = np.argsort(at, kind="stable")
        ids, starts = np.unique(at[order], return_index=True)
        sums = np.add.reduceat(sample[order], starts, axis=0)
        norm = np.linalg.norm(sums, axis=1)
        c[ids[norm > 0]] = sums[norm > 0] / norm[norm > 0, None]
    return c.astype(np.float32)


def _matrix(column, dim: int = DIM) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)


def _unit(v: np.ndarray) -> np.ndarray:
    d = v.astype(np.float64)
    return (d / np.linalg.norm(d, axis=1, keepdims=True)).astype(np.float32)


def _routed(centroids: np.ndarray, width: float):
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            near = _unit(_matrix(b.column("vector"))) @ centroids.T
            home = near.argmax(1)
            row, cell = np.nonzero(near >= near.max(1, keepdims=True) - width)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell, pa.int32()), pa.array(home[row] == cell), b.column("cid").take(pa.array(row)), b.column("vector").take(pa.array(row))],
                ["cell", "home", "cid", "vector"],
            )

    return run


def scan(q: np.ndarray, m: np.ndarray, same: np.ndarray, k: int = K, floor: float = FLOOR, turn: np.ndarray | None = None, work: list[int] | None = None):
    """Candidate (query row, member row) pairs of one list; ``same``: member row of a query, or -1.

    Rows are unit vectors. Members are taken in blocks, columns in blocks of
    COLUMNS; a pair is abandoned when its partial distance fails the test for its query.
    While many pairs are open, a column block is one product over the open rows and columns;
    afterwards pairs are followed one by one. ``work`` collects the number of pairs tested after each column block.
    """
    turn = rotation(q.shape[1]) if turn is None else turn
    dim = q.shape[1]
    qr, mr = q @ turn, m @ turn
    limit = np.float32(2 - 2 * floor + 1e-5)
    beat_q = np.full(len(q), limit, np.float32)
    best_q = np.full((len(q), k + 1), limit, np.float32)
    out_q, out_m, out_d = [], [], []
    for start in range(0, len(m), 512):
        part = mr[start : start + 512]
        rows, cols = np.arange(len(q)), np.arange(len(part))
        left = part_d = None
        dist = np.zeros((len(rows), len(cols)), np.float32)
        open_ = dist.size
        for d in range(0, dim, COLUMNS):
            block = slice(d, d + COLUMNS)
            seen = min(d + COLUMNS, dim)
            bound = (1 + EPS0 / np.sqrt(seen)) ** 2 * seen / dim if seen < dim else 1.0
            if left is None:
                a, b = qr[rows, block], part[cols, block]
                dist += (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
                keep = dist <= (beat_q[rows] * np.float32(bound) + np.float32(TIES))[:, None]
                if work is not None:
                    work.append(open_)
                open_ = int(np.count_nonzero(keep))
                if seen < dim and open_ > DENSE * keep.size:
                    dist[~keep] = np.inf  # abandoned
                    r, c = keep.any(1), keep.any(0)
                    if not (r.all() and c.all()):
                        rows, cols, dist = rows[r], cols[c], dist[np.ix_(r, c)]
                    continue
                x, y = np.nonzero(keep)
                left, part_d = (rows[x], cols[y]), dist[x, y]
            else:
                x, y = left
                if work is not None:
                    work.append(len(x))
                diff = qr[x, block] - part[y, block]
                part_d = part_d + np.einsum("ij,ij->i", diff, diff)
                keep = part_d <= beat_q[x] * np.float32(bound) + np.float32(TIES)
                left, part_d = (x[keep], y[keep]), part_d[keep]
        x, y = left
        y = y + start
        keep = (part_d <= beat_q[x] + TIES) & (same[x] != y)
        x, y, part_d = x[keep], y[keep], part_d[keep]
        if not len(x):
            continue
        order = np.lexsort((part_d, x))
        x, y, part_d = x[order], y[order], part_d[order]
        first = np.concatenate([[0], np.flatnonzero(np.diff(x)) + 1])
        rank = np.arange(len(x)) - np.repeat(first, np.diff(np.concatenate([first, [len(x)]])))
        rows = np.unique(x)
        new = np.full((len(q), k + 1), np.float32(9), np.float32)
        top = rank <= k
        new[x[top], rank[top]] = part_d[top]
        best_q[rows] = np.sort(np.concatenate([best_q[rows], new[rows]], 1), 1)[:, : k + 1]
        beat_q = np.minimum(limit, best_q[:, k] + np.float32(TIES))
        keep = part_d <= beat_q[x]
        out_q.append(x[keep])
        out_m.append(y[keep])
        out_d.append(part_d[keep])
    if not out_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x, y, d = np.concatenate(out_q), np.concatenate(out_m), np.concatenate(out_d)
    keep = d <= beat_q[x]
    return x[keep], y[keep]


def _searched(k: int, floor: float):
    turn = rotation()

    def run(t: pa.Table) -> pa.Table:
        home = t.column("home").to_numpy()
        cid = t.column("cid").to_numpy()
        stored = _matrix(t.column("vector"))
        unit = _unit(stored)
        members = np.flatnonzero(home)
        same = np.full(len(cid), -1, np.int64)
        same[members] = np.arange(len(members))
        x, y = scan(unit, unit[members], same, k, floor, turn)
        y = members[y]
        a, b = stored[x].astype(np.float64), stored[y].astype(np.float64)
        cos = np.round(np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b)), 6)
        keep = (cos >= floor) & (cid[x] != cid[y])
        x, y, cos = x[keep], y[keep], cos[keep]
        # a pair found by a visitor counts for the member too
        visitor = ~home[x]
        q = np.concatenate([cid[x], cid[y][visitor]])
        m = np.concatenate([cid[y], cid[x][visitor]])
        c = np.concatenate([cos, cos[visitor]])
        order = np.lexsort((m, -c, q))
        q, m, c = q[order], m[order], c[order]
        if len(q):
            first = np.concatenate([[0], np.flatnonzero(np.diff(q)) + 1])
            rank = np.arange(len(q)) - np.repeat(first, np.diff(np.concatenate([first, [len(q)]])))
            q, m, c = q[rank < k], m[rank < k], c[rank < k]
        return pa.table({"q": pa.array(q, pa.int64()), "m": pa.array(m, pa.int64()), "cos": pa.array(c, pa.float64())})

    return run


def usable(df: DataFrame, key: str = "vec_id", vector: str = "vector", version: str = "embedded_at", dim: int = DIM) -> DataFrame:
    """One row per key whose latest vector is usable: id, vector, class hashes."""
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(version).alias("v"), F.col(vector).alias("vector"))
    good = (
        (F.size("vector") == dim)
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vector", lambda x: x != 0)
    )
    return rows.withColumn("good", F.coalesce(good, F.lit(False)))


def _centres(per: int):
    def run(t: pa.Table) -> pa.Table:
        sample = _unit(_matrix(t.column("vector")))
        # rows arrive in any order: the fit must not depend on it
        sample = sample[np.argsort(t.column("cid").to_numpy())][:OWN]
        size = t.column("size")[0].as_py()
        c = fit(sample, max(1, min(size // per, len(sample) // 10)))
        return pa.table({"cell": pa.array([t.column("cell")[0].as_py()], pa.int32()), "centres": pa.array([c.ravel()], pa.list_(pa.float32()))})

    return run


def _second(width: float):
    def run(rows: pa.Table, centres: pa.Table) -> pa.Table:
        """Rows of a part of one list, put into its own lists."""
        names = {"cell": pa.int32(), "sub": pa.int32(), "home": pa.bool_(), "cid": pa.int64(), "vector": pa.list_(pa.float32())}
        if not rows.num_rows or not centres.num_rows:
            return pa.table({n: pa.array([], t) for n, t in names.items()})
        c = np.array(centres.column("centres")[0].as_py(), np.float32).reshape(-1, DIM)
        v = rows.column("vector").combine_chunks()
        near = _unit(_matrix(v)) @ c.T
        at, sub = np.nonzero(near >= near.max(1, keepdims=True) - width)
        home = rows.column("home").to_numpy()[at] & (near.argmax(1)[at] == sub)
        take = pa.array(at)
        out = [pa.array(np.full(len(at), rows.column("cell")[0].as_py()), pa.int32()), pa.array(sub, pa.int32()), pa.array(home), rows.column("cid").take(take), v.take(take)]
        return pa.table(dict(zip(names, out)))

    return run


def rerouted(routed: DataFrame, homes: DataFrame, sizes: dict[int, int], width: float) -> DataFrame:
    """Members and visitors of lists longer than CHUNK by lists of their own: cell, sub, home, cid, vector."""
    spark = routed.sparkSession
    known = spark.createDataFrame([(c, n, -(-n // PART)) for c, n in sorted(sizes.items())], "cell int, size bigint, parts int")
    h = F.pmod(F.xxhash64(F.lit(5), "cid"), F.lit(1 << 40))
    few = homes.join(F.broadcast(known), "cell").where(h < (F.lit((1 << 40) * 1.1 * OWN) / F.col("size")).cast("bigint"))
    centres = few.select("cell", "cid", "size", "vector").groupBy("cell").applyInArrow(_centres(LIST), "cell int, centres array<float>")
    centres = written(centres, "p5-centres").join(F.broadcast(known), "cell")
    centres = centres.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("cell", "part", "centres")
    rows = routed.join(F.broadcast(known), "cell").withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")).select("cell", "part", "home", "cid", "vector")
    got = rows.groupBy("cell", "part").cogroup(centres.groupBy("cell", "part")).applyInArrow(_second(width), "cell int, sub int, home boolean, cid bigint, vector array<float>")
    return written(got, "p5-lists")


def neighbours(df: DataFrame, k: int = K, floor: float = FLOOR, width: float = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(members, nearest): members id, cid; nearest q, m, cos between classes, at most k a query class."""
    spark = df.sparkSession
    rows = usable(df)
    # repeated rows meet by id without their vectors; only the winner's class hash moves
    named = rows.select("id", "v", "good", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(31), "vector").alias("h2"))
    winner = named.groupBy("id").agg(F.max(F.struct("v", "good", "h1", "h2")).alias("x")).where("x.good").select("id", "x.h1", "x.h2")
    winner = written(winner, "p5-usable")
    # aggregated before it is joined back: a class may hold a third of all rows
    smallest = winner.groupBy("h1", "h2").agg(F.min("id").alias("cid"))
    members = written(winner.join(smallest, ["h1", "h2"]).select("id", "cid", "h1", "h2"), "p5-members")
    first = members.where("id = cid").select("cid", "h1", "h2")
    stored = rows.where("good").select(F.col("id").alias("cid"), "vector", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(31), "vector").alias("h2"))
    reps = written(stored.join(first, ["cid", "h1", "h2"], "left_semi").dropDuplicates(["cid"]).select("cid", "vector"), "p5-classes")
    n = reps.count()
    schema = "q bigint, m bigint, cos double"
    if n < 2:
        return members, spark.createDataFrame([], schema)
    # a hash range of about SAMPLE rows first: what reaches the driver doesn't grow with the partitions
    h = F.pmod(F.xxhash64("cid"), F.lit(1 << 40))
    few = reps if n <= SAMPLE else reps.where(h < int((1 << 40) * 1.1 * SAMPLE / n))
    sample = few.orderBy(h, "cid").limit(SAMPLE).select("vector").toPandas()
    centroids = fit(_unit(np.stack(sample["vector"].to_numpy()).astype(np.float32)), max(1, min(n // LIST, len(sample) // 10)))
    row = "cell int, home boolean, cid bigint, vector array<float>"
    routed = reps.mapInArrow(_routed(centroids, width), row)
    homes = reps.mapInArrow(_routed(centroids, -1e-9), row)
    sizes = {r["cell"]: r["count"] for r in homes.groupBy("cell").count().where(F.col("count") > CHUNK).collect()}  # a row a list at most
    lists = routed.withColumn("sub", F.lit(0))
    if sizes:
        large = F.col("cell").isin(list(sizes))
        again = rerouted(routed.where(large), homes.where(large), sizes, width)
        lists = lists.where(~large).select(*again.columns).unionByName(again)
        still = again.groupBy("cell", "sub").agg(F.sum(F.col("home").cast("int")).alias("size")).where(F.col("size") > CHUNK)
        still = still.select("cell", "sub", F.ceil(F.col("size") / CHUNK).cast("int").alias("chunks"))
        lists = lists.join(still, ["cell", "sub"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        own = F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int")
        lists = lists.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("home", F.col("home") & (own == F.col("chunk")))
    else:
        lists = lists.withColumn("chunk", F.lit(0))
    hits = lists.select("cell", "sub", "chunk", "home", "cid", "vector").groupBy("cell", "sub", "chunk").applyInArrow(_searched(k, floor), schema)
    best = Window.partitionBy("q").orderBy(F.desc("cos"), "m")
    nearest = hits.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("q", "m", "cos")
    return members, written(nearest, "p5-nearest")


def top(members: DataFrame, nearest: DataFrame, k: int = K) -> DataFrame:
    """(id, other, cos): the k most similar other records of every record."""
    order = Window.partitionBy("cid").orderBy("id")
    few = members.select("cid", "id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1).select("cid", F.col("id").alias("other"))
    lists = few.select(F.col("cid").alias("q"), "other", F.lit(1.0).alias("cos")).unionByName(
        nearest.join(few, F.col("m") == F.col("cid")).select("q", "other", "cos")
    )
    best = Window.partitionBy("q").orderBy(F.desc("cos"), "other")
    lists = lists.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k + 1)
    per = lists.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("rank", "other", "cos"))).alias("l"))
    others = F.slice(F.filter("l", lambda x: x["other"] != F.col("id")), 1, k)
    return (
        members.select("id", "cid")
        .join(per, F.col("cid") == F.col("q"))
        .select("id", F.explode(others).alias("x"))
        .select("id", F.col("x.other").alias("other"), F.col("x.cos").alias("cos"))
    )


def found(members: DataFrame, nearest: DataFrame) -> DataFrame:
    return top(members, nearest).select(F.least("id", "other").alias("vec_id_a"), F.greatest("id", "other").alias("vec_id_b")).distinct()


def vector_neighbours(spark, sf_dir):
    return neighbours(table(spark, sf_dir, "index_vectors"))

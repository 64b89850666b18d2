"""Problem 6: groups of memories that differ by small edits.

Sequential Bayesian verification of banded candidates:

1. Memories with equal word multisets form one class (overlap 1 with each other,
   equal overlap with everything else); only classes are compared.
2. Bands: a class is filed under each of its rarest elements, as many as an overlap of
   the threshold demands (``prefixes``). Bands of min-hash rows would lose links
   at any size; these lose none. Classes sharing enough bands are candidates.
3. Each candidate's signatures (``HASHES`` min-hash values of eight bits) are compared in
   batches; a candidate is dropped as soon as the posterior probability that its
   Jaccard similarity reaches t / (2 - t), the least that an overlap of t allows,
   is below ``MISS``. Survivors are verified on the whole word multisets.
4. Bands of very many classes are compared in blocks, where rows already connected
   are not compared again, by the same test and verification.
5. Groups: connected components of the verified links (large star / small star).

Defined results: null key: left out; null title or content: empty; memories
without words are alone in their group; repeated rows of a key: latest version;
empty table: empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.components import components
from mnemospark.llm.prefixes import GROUP, banded, candidates, levels
from mnemospark.llm.words import STEP, ElementHasher
from mnemospark.plans.lineage import discard, written

THRESHOLD = 0.75
HASHES = 64
BATCH = 16
BLOCK = 1000
MISS = 1e-8

_rng = np.random.default_rng(20240601)
A = _rng.integers(1, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def _named(batches):
    """Raw rows to (key, version, c, lo, n, short): the class name in two halves, its elements cut to 32 bits."""
    hasher = ElementHasher()
    for b in batches:
        h, ends = hasher.batch(b.column("text").to_pylist())
        low = h.astype("<u8").tobytes()
        short = (h >> np.uint64(32)).astype(np.uint32).tobytes()
        starts = [0, *ends.tolist()]
        names = b"".join(xxhash.xxh128_digest(low[8 * i : 8 * j]) for i, j in zip(starts, starts[1:]))
        hi_lo = np.frombuffer(names, ">i8").reshape(-1, 2).astype(np.int64)
        offsets = pa.py_buffer((np.array(starts, np.int64) * 4).astype(np.int32).tobytes())
        packed = pa.Array.from_buffers(pa.binary(), len(ends), [None, offsets, pa.py_buffer(short)])
        n = pa.array(np.diff(starts), pa.int32())
        yield pa.RecordBatch.from_arrays([b.column("key"), b.column("version"), pa.array(hi_lo[:, 0]), pa.array(hi_lo[:, 1]), n, packed], ["key", "version", "c", "lo", "n", "short"])


EMPTY = np.frombuffer(xxhash.xxh128_digest(b""), ">i8").tolist()  # the class without words


def signatures(flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(rows, HASHES) uint8 min-hash values of rows with at least one element (32 bits) each."""
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    x = flat * np.uint32(STEP & 0xFFFFFFFF)
    x ^= x >> np.uint32(15)
    out = np.empty((len(lengths), HASHES), np.uint8)
    h = np.empty_like(x)
    for k in range(HASHES):
        np.multiply(x, A[k], out=h)
        h += B[k]
        h ^= h >> np.uint32(16)
        out[:, k] = (np.minimum.reduceat(h, starts) * np.uint32(0x9E3779B1)) >> np.uint32(24)
    return out


def _signed(frames):
    """Texts of candidate classes to (c, sig, elements), full 64-bit elements; a text of another class is left out."""
    hasher = ElementHasher()
    for f in frames:
        elements = hasher.rows(f["text"].tolist())
        own = [xxhash.xxh128_digest(r.astype("<i8").tobytes())[:8] == int(c).to_bytes(8, "big", signed=True) for r, c in zip(elements, f["c"])]
        f, elements = f[own], [r for r, k in zip(elements, own) if k]
        lengths = np.fromiter(map(len, elements), np.int64, len(f))
        short = (np.concatenate(elements).view(np.uint64) >> np.uint64(32)).astype(np.uint32) if len(f) else np.zeros(0, np.uint32)
        sig = signatures(short, lengths) if len(f) else []
        yield pd.DataFrame({"c": f["c"].to_numpy(), "sig": [s.tobytes() for s in sig], "elements": [r.tobytes() for r in elements]})


def needed_matches(threshold: float = THRESHOLD) -> np.ndarray:
    """For each batch end n: the least matches m with P(J >= floor | m of n) >= MISS, uniform prior.

    Values of eight bits also agree by chance, which the likelihood includes.
    """
    grid = np.linspace(0.0005, 0.9995, 1000)
    hit = grid + (1 - grid) / 256
    floor = threshold / (2 - threshold)
    need = []
    for n in range(BATCH, HASHES + 1, BATCH):
        for m in range(n + 1):
            log = m * np.log(hit) + (n - m) * np.log1p(-hit)
            p = np.exp(log - log.max())
            if p[grid >= floor].sum() / p.sum() >= MISS:
                need.append(m)
                break
    return np.array(need)


def _likely(threshold):
    """Candidate pairs with both signatures to the pairs that survive every batch."""

    def run(frames):
        need = needed_matches(threshold)
        for f in frames:
            a = np.frombuffer(b"".join(f["sig_a"]), np.uint8).reshape(len(f), HASHES)
            b = np.frombuffer(b"".join(f["sig_b"]), np.uint8).reshape(len(f), HASHES)
            alive = np.arange(len(f))
            matches = np.zeros(len(f), np.int64)
            for i, least in enumerate(need):
                s = slice(i * BATCH, (i + 1) * BATCH)
                matches[alive] += (a[alive, s] == b[alive, s]).sum(1)
                alive = alive[matches[alive] >= least]
            yield f.iloc[alive][["a", "b"]]

    return run


def _verified(threshold):
    def run(frames):
        for f in frames:
            good = [overlap(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)) >= threshold for x, y in zip(f["el_a"], f["el_b"])]
            yield f[np.array(good, bool)][["a", "b"]]

    return run


def overlap(x: np.ndarray, y: np.ndarray) -> float:
    return len(np.intersect1d(x, y, assume_unique=True)) / max(len(x), len(y), 1)


def _block_links(threshold):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        """Links of one block of a large band: likely pairs that no earlier link of the block connects."""
        f = f.drop_duplicates("c", ignore_index=True)
        c, el = f["c"].to_numpy(), [np.frombuffer(e, np.int64) for e in f["elements"]]
        sig = np.frombuffer(b"".join(f["sig"]), np.uint8).reshape(len(f), HASHES)
        n = np.fromiter(map(len, el), np.int64, len(el))
        least = needed_matches(threshold)[-1]
        part = np.arange(len(f))
        out = []
        for k in range(1, len(f)):
            near = (np.minimum(n[:k], n[k]) >= threshold * np.maximum(n[:k], n[k])) & ((sig[:k] == sig[k]).sum(1) >= least)
            for h in np.flatnonzero(near).tolist():
                if part[h] != part[k] and overlap(el[h], el[k]) >= threshold:
                    out.append((c[h], c[k]))
                    part[part == part[k]] = part[h]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def records(df: DataFrame) -> DataFrame:
    """Raw rows with a key: key, version, text; repeated rows are still there."""
    text = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit("")))
    return df.where(F.col("mem_id").isNotNull()).select(F.col("mem_id").cast("string").alias("key"), F.col("ingested_at").alias("version"), text.alias("text"))


def groups(rec: DataFrame, threshold: float = THRESHOLD, group: int = GROUP) -> DataFrame:
    """One row per record: key, group (smallest key of the group).

    Texts move only for candidate classes: class names and cut elements are written where the texts are read.
    """
    kind = dict(rec.dtypes)["version"]
    rows = written(rec.mapInArrow(_named, f"key string, version {kind}, c bigint, lo bigint, n int, short binary"), "p6-rows")
    newest = rows.groupBy("key").agg(F.max(F.struct("version", "c", "lo")).alias("x")).select("key", "x.version", "x.c", "x.lo")
    newest = written(newest, "p6-newest")
    label = components(links(rec, rows, newest, threshold, group))
    alone = F.expr(f"c = {EMPTY[0]} and lo = {EMPTY[1]}")  # records without words
    members = newest.join(label.withColumnRenamed("node", "c"), "c", "left").select(
        "key", F.when(alone, F.concat(F.lit("-"), "key")).otherwise(F.coalesce(F.col("component").cast("string"), F.concat_ws(":", "c", "lo"))).alias("component")
    )
    name = members.groupBy("component").agg(F.min("key").alias("group"), F.count("*").alias("size"))
    return members.join(name, "component").select("key", "group", "size")


def links(rec: DataFrame, rows: DataFrame, newest: DataFrame, threshold: float = THRESHOLD, group: int = GROUP) -> DataFrame:
    """Verified links a < b between classes (the first halves of their names)."""
    bands = rows.select("c", "short").mapInArrow(banded(levels(rows), threshold), "e bigint, salt int, c bigint, n int, pos int")
    hit = written(candidates(bands, threshold, group=group), "p6-candidates")
    discard(rows)  # what follows reads candidates and texts
    pairs = hit.where("not hot").select(F.col("x").alias("a"), F.col("y").alias("b"))
    crowded = not hit.where("hot").isEmpty()
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("c"))
    if crowded:
        wanted = wanted.unionByName(hit.where("hot").select(F.col("y").alias("c")))
    # one record stands for its class; aggregated before it is joined, as a class may hold a third of all rows
    reps = newest.groupBy("c").agg(F.min(F.struct("key", "version")).alias("x")).select("c", "x.key", "x.version")
    reps = reps.join(wanted.distinct(), "c", "left_semi")
    texts = rec.join(reps.withColumnRenamed("version", "v"), "key").where(F.col("version").eqNullSafe(F.col("v"))).select("c", "text")
    sets = written(texts.mapInPandas(_signed, "c bigint, sig binary, elements binary").dropDuplicates(["c"]), "p6-sets")
    side = lambda x, column, name: sets.select(F.col("c").alias(x), F.col(column).alias(f"{name}_{x}"))
    likely = pairs.join(side("a", "sig", "sig"), "a").join(side("b", "sig", "sig"), "b").mapInPandas(_likely(threshold), "a bigint, b bigint")
    likely = likely.join(side("a", "elements", "el"), "a").join(side("b", "elements", "el"), "b")
    verified = likely.mapInPandas(_verified(threshold), "a bigint, b bigint")
    if not crowded:
        return verified
    large = hit.where("hot").select(F.col("x").alias("band"), F.col("y").alias("c"))
    sizes = large.groupBy("band").agg(F.count("*").alias("size"))
    chunked = large.join(sizes, "band").withColumn("chunks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("c"), F.col("chunks")).cast("int"))
    block = (
        chunked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .withColumn("i", F.least("chunk", "other"))
        .withColumn("j", F.greatest("chunk", "other"))
        .join(sets, "c")
        .select("band", "i", "j", "c", "sig", "elements")
        .groupBy("band", "i", "j")
        .applyInPandas(_block_links(threshold), "a bigint, b bigint")
    )
    return verified.unionByName(block.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()


def found(members: DataFrame) -> DataFrame:
    """All pairs of different records of one group, smaller key first; large groups are joined in salted blocks of about BLOCK records."""
    part = members.where("size > 1").withColumn("slots", F.ceil(F.col("size") / BLOCK)).withColumn("slot", F.pmod(F.xxhash64("key"), F.col("slots")))
    left = part.select("group", F.col("slot").alias("i"), F.explode(F.sequence(F.col("slot"), F.col("slots") - 1)).alias("j"), F.col("key").alias("x"))
    right = part.select("group", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slot"))).alias("i"), F.col("slot").alias("j"), F.col("key").alias("y"))
    pairs = left.join(right, ["group", "i", "j"]).where("i < j or x < y")
    return pairs.select(F.least("x", "y").alias("mem_id_a"), F.greatest("x", "y").alias("mem_id_b"))


def memory_groups(spark, sf_dir):
    from mnemospark.sources.tables import table

    return groups(records(table(spark, sf_dir, "memories")))

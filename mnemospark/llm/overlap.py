"""Problem 2: records that stand, exactly or almost, in two splits.

Exact prefix-filter bipartite join on rare shingles (single words, as the measure demands).
A record is the multiset of its words; two records overlap by the number of shared elements over the element count of the
longer one. Elements are ordered from rare to frequent; each record is filed under
its first elements, evaluation records are met by training records under the
length filter and the position filter (``prefixes``), and every pair sharing enough of them
is verified on its whole element sets. No pair is lost. Groups of an element
that very many records share are verified in blocks of an evaluation and a training part.

Records with equal word multisets are one class: the join runs between classes
and its pairs are expanded through the membership table, so a text that makes
up a third of all rows is compared once.

Defined results:
  null key: the row is no record and is left out; null or blank text: the record
  has no words and no partner; null, blank or other splits take no part;
  repeated rows of a key: the one with the latest version counts; empty table:
  empty result; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.prefixes import GROUP, banded, candidates, levels
from mnemospark.llm.words import ElementHasher
from mnemospark.plans.lineage import written
from mnemospark.sources.tables import latest

THRESHOLD = 0.75
TRAIN = ("train",)
EVALUATION = ("dev", "test")
BLOCK = 1000


def _packed(rows: list[np.ndarray], width: int) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(b"".join(r.tobytes() for r in rows))])


def _elements(batches):
    """Records to (key, split, source, side, c, n, short, elements); side 0 is the training side."""
    hasher = ElementHasher()
    for b in batches:
        rows = hasher.rows(b.column("text").to_pylist())
        c = [int.from_bytes(xxhash.xxh128_digest(r.tobytes())[:8], "big", signed=True) for r in rows]
        short = [(r.view(np.uint64) >> np.uint64(32)).astype(np.uint32) for r in rows]
        side = [int(x not in TRAIN) for x in b.column("split").to_pylist()]
        out = pa.RecordBatch.from_arrays(
            [b.column("key"), b.column("split"), b.column("source"), pa.array(side, pa.int32()), pa.array(c, pa.int64()), pa.array([len(r) for r in rows], pa.int32()), _packed(short, 4), _packed(rows, 8)],
            ["key", "split", "source", "side", "c", "n", "short", "elements"],
        )
        yield out.filter(pa.array([len(r) > 0 for r in rows], pa.bool_()))


def records(df: DataFrame, key: str, split: str, text: str, source: str, version: str) -> DataFrame:
    """One row per record of the splits that take part: key, split, source, text."""
    side = F.lower(F.trim(F.col(split)))
    rows = latest(df, key, version, key, split, text, source)
    return rows.select(
        F.col(key).cast("string").alias("key"),
        side.alias("split"),
        F.lower(F.trim(F.col(source))).alias("source"),
        F.col(text).alias("text"),
    ).where(F.col("split").isin(*TRAIN, *EVALUATION))


def _shared(x: np.ndarray, y: np.ndarray) -> float:
    return len(np.intersect1d(x, y, assume_unique=True)) / max(len(x), len(y), 1)


def _verified(threshold: float):
    def run(frames):
        for f in frames:
            share = np.array([_shared(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)) for x, y in zip(f["el_t"], f["el_e"])], float)
            yield f.assign(overlap=share)[share >= threshold][["cls_t", "cls_e", "overlap"]]

    return run


def _block(threshold: float):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        """Verified pairs of one training and one evaluation part of a frequent element."""
        f = f.drop_duplicates(["c", "side"], ignore_index=True)
        el = [np.frombuffer(e, np.int64) for e in f["elements"]]
        n, c = np.fromiter(map(len, el), np.int64, len(el)), f["c"].to_numpy()
        train, other = np.flatnonzero(f["side"] == 0), np.flatnonzero(f["side"] == 1)
        out = []
        for t in train.tolist():
            fits = other[(np.minimum(n[t], n[other]) >= threshold * np.maximum(n[t], n[other])) & (c[other] != c[t])]
            for e in fits.tolist():
                share = _shared(el[t], el[e])
                if share >= threshold:
                    out.append((c[t], c[e], share))
        return pd.DataFrame(out, columns=["cls_t", "cls_e", "overlap"]).astype({"cls_t": "int64", "cls_e": "int64", "overlap": "float64"})

    return run


PAIR = "cls_t bigint, cls_e bigint, overlap double"


def overlaps(rec: DataFrame, threshold: float = THRESHOLD, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """(members, class pairs): members key, split, source, side, c; pairs cls_t, cls_e, overlap."""
    schema = "key string, split string, source string, side int, c bigint, n int, short binary, elements binary"
    members = written(rec.mapInArrow(_elements, schema), "p2-members")
    bands = members.select("c", "short", "side").mapInArrow(banded(levels(members), threshold, ("side",)), "e bigint, salt int, c bigint, n int, pos int, side int")
    hit = written(candidates(bands, threshold, True, group), "p2-candidates")
    both = hit.where("not hot").select(F.col("x").alias("cls_t"), F.col("y").alias("cls_e"))
    hot = hit.where("hot").select(F.col("x").alias("band"), F.col("y").alias("c"))
    crowded = not hot.isEmpty()
    wanted = both.select(F.explode(F.array("cls_t", "cls_e")).alias("c"))
    wanted = (wanted.unionByName(hot.select("c")) if crowded else wanted).distinct()
    # one record stands for its class; aggregated before it is joined, as a class may hold a third of all rows
    classes = members.groupBy("c").agg(F.min("key").alias("key"), F.min("side").alias("least"), F.max("side").alias("most"))
    sets = written(classes.join(wanted, "c", "left_semi").join(members.select("key", "elements"), "key").select("c", "least", "most", "elements"), "p2-sets")
    side = lambda s: sets.select(F.col("c").alias(f"cls_{s}"), F.col("elements").alias(f"el_{s}"))
    pairs = both.join(side("t"), "cls_t").join(side("e"), "cls_e").mapInPandas(_verified(threshold), PAIR)
    same = classes.where("least < most").select(F.col("c").alias("cls_t"), F.col("c").alias("cls_e"), F.lit(1.0).alias("overlap"))
    pairs = pairs.unionByName(same)
    if crowded:
        rows = hot.join(sets, "c").withColumn("side", F.explode(F.array_distinct(F.array("least", "most"))))
        sizes = rows.groupBy("band").agg(*[F.ceil(F.sum((F.col("side") == s).cast("int")) / BLOCK).cast("int").alias(f"parts{s}") for s in (0, 1)])
        cut = rows.join(sizes.where("parts0 > 0 and parts1 > 0"), "band").withColumn("parts", F.when(F.col("side") == 0, F.col("parts0")).otherwise(F.col("parts1")))
        cut = cut.withColumn("own", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int"))
        cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("parts1")).otherwise(F.col("parts0")) - 1)))
        cut = cut.withColumn("i", F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("other"))).withColumn("j", F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("own")))
        blocks = cut.select("band", "i", "j", "c", "side", "elements").groupBy("band", "i", "j").applyInPandas(_block(threshold), PAIR)
        pairs = pairs.unionByName(blocks).distinct()
    return members.select("key", "split", "source", "side", F.col("c").alias("cls")), written(pairs, "p2-pairs")


def found(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """All pairs of a training and an evaluation record, smaller key first; large classes are met in parts of about BLOCK records."""
    sizes = members.groupBy("cls", "side").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    slot = lambda name: F.pmod(F.xxhash64(name), F.col("parts")).cast("int")
    spread = pairs.select("cls_t", "cls_e")
    for s, name in ((0, "t"), (1, "e")):
        mine = sizes.where(F.col("side") == s).select(F.col("cls").alias(f"cls_{name}"), "parts")
        spread = spread.join(mine, f"cls_{name}").withColumn(f"slot_{name}", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    # a large class's part is known to its members: only classes of more than BLOCK records need one
    large = sizes.where("parts > 1")
    placed = members.join(large, ["cls", "side"], "left").withColumn("slot", F.coalesce(slot("key"), F.lit(0)))
    for s, name in ((0, "t"), (1, "e")):
        mine = placed.where(F.col("side") == s).select(F.col("cls").alias(f"cls_{name}"), F.col("slot").alias(f"slot_{name}"), F.col("key").alias(name))
        spread = spread.join(mine, [f"cls_{name}", f"slot_{name}"])
    return spread.select(F.least("t", "e").alias("query_id_a"), F.greatest("t", "e").alias("query_id_b"))


def report(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per evaluation split and source: records, records with a training partner, their share, pairs.

    Training partners are counted per class before they meet the evaluation side,
    so a hot class adds one row, not the product of its members.
    """
    per_class = members.where("side = 0").groupBy(F.col("cls").alias("cls_t")).agg(F.count("*").alias("k"))
    links = pairs.join(per_class, "cls_t").groupBy(F.col("cls_e").alias("cls")).agg(F.sum("k").alias("links"))
    return (
        members.where("side = 1")
        .join(links, "cls", "left")
        .groupBy("split", "source")
        .agg(
            F.count("*").alias("records"),
            F.count("links").alias("overlapping"),
            F.coalesce(F.sum("links"), F.lit(0)).alias("pairs"),
        )
        .withColumn("share", F.round(F.col("overlapping") / F.col("records"), 6))
    )


def query_overlaps(spark, sf_dir):
    from mnemospark.sources.tables import table

    return overlaps(records(table(spark, sf_dir, "queries"), "query_id", "split", "query", "source", "added_at"))

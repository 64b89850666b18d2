"""Exact candidates for word overlap: shared elements among the rarest of each record.

A record is a set of elements (``words``). All elements have one global order, from rare
to frequent; it follows counts in ``slots`` (hash slots), whose number is bounded, so the
order costs one counting pass and a table of at most ``MOST`` bytes in every task. Any
order is right; a better one only makes fewer candidates.

Records of n elements overlapping by t of the longer share at least
``ceil(t * n)`` elements, so ``LEADS`` of these are among the first
``n - ceil(t * n) + LEADS`` of each (as many as there are, in short records). A pair is a
candidate if it shares ``HITS`` of them under the length and position filters:
one fewer than it must, as elements are cut to 32 bits here.

Groups of records sharing an element are read from a sorted stream. Groups of
more than ``GROUP`` yield no pairs but their members, which the caller compares
in blocks; elements known to be frequent are spread over many partitions beforehand.
A qualifying pair either shares a frequent element (and meets in its blocks) or all its
shared elements are in small groups, so no pair is lost.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEADS = 3
HITS = 2
GROUP = 64
SPREAD = 4096
LEAST, MOST = 1 << 14, 1 << 24
LOAD = 48
SEEN = 4
PAIRS = "hot boolean, x bigint, y bigint, need int"


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Elements (uint32) of a binary column end to end, and the counts of its rows."""
    rows = column.to_pylist()
    lengths = np.fromiter((len(r) for r in rows), np.int64, len(rows)) // 4
    return np.frombuffer(b"".join(rows), np.uint32), lengths


def _tallied(bits: int):
    def run(batches):
        total = np.zeros(1 << bits, np.int64)
        for b in batches:
            e, _ = flat(b.column("short"))
            total += np.bincount(e >> np.uint32(32 - bits), minlength=1 << bits)
        slot = np.flatnonzero(total)
        for k in range(0, len(slot), 1 << 16):
            part = slot[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(total[part])], ["slot", "n"])

    return run


def levels(rows: DataFrame) -> np.ndarray:
    """uint8 level of each slot: eight steps to a doubling of its count, 0 below ``SEEN``. ``rows``: n, short."""
    total = rows.agg(F.sum("n")).first()[0] or 0
    bits = int(np.clip(total // LOAD, LEAST, MOST)).bit_length() - 1
    counts = rows.select("short").mapInArrow(_tallied(bits), "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") >= SEEN).toArrow()
    out = np.zeros(1 << bits, np.uint8)
    n = counts.column("n").to_numpy()
    out[counts.column("slot").to_numpy()] = level(n)
    return out


def level(n) -> np.ndarray:
    return np.minimum(8 * np.log2(np.maximum(n, 1)), 255).astype(np.uint8)


def needed(n: np.ndarray, threshold: float) -> np.ndarray:
    """Elements a record of n must share at least with a partner."""
    return np.ceil(threshold * n - 1e-9).astype(np.int64)


def heads(e: np.ndarray, lengths: np.ndarray, table: np.ndarray, threshold: float):
    """(row, element, position from 1, level) of the leading elements of each row."""
    bits = len(table).bit_length() - 1
    lev = table[e >> np.uint32(32 - bits)]
    row = np.repeat(np.arange(len(lengths)), lengths)
    order = np.argsort((row << 40) | (lev.astype(np.int64) << 32) | e, kind="stable")
    start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    pos = np.arange(len(e)) - np.repeat(start, lengths) + 1
    need = needed(lengths, threshold)
    keep = pos <= np.repeat(lengths - need + np.minimum(LEADS, need), lengths)
    order = order[keep]
    return row[keep], e[order], pos[keep], lev[order]


def banded(table: np.ndarray, threshold: float, extra: tuple[str, ...] = ()):
    """Rows (c, short, extra...) to (e, salt, c, n, pos, extra...): a class is filed once a batch under each leading element."""
    spread = level(SPREAD)

    def run(batches):
        for b in batches:
            names = [b.column("c"), *(b.column(x) for x in extra)]
            first = {}
            for i, k in enumerate(zip(*[x.to_pylist() for x in names])):
                first.setdefault(k, i)
            b = b.take(pa.array(list(first.values()), pa.int64()))
            e, lengths = flat(b.column("short"))
            if not len(e):
                continue
            row, head, pos, lev = heads(e, lengths, table, threshold)
            c = b.column("c").to_numpy()[row]
            # elements of very many records: as many parts as they have SPREAD records
            parts = np.where(lev > spread, np.exp2((lev.astype(float) - spread) / 8).astype(np.int64) + 1, 0)
            salt = np.where(parts > 0, 1 + (c.view(np.uint64) >> np.uint64(20)).astype(np.int64) % np.maximum(parts, 1), 0)
            out = [pa.array(head.astype(np.int64)), pa.array(salt, pa.int32()), pa.array(c), pa.array(lengths[row], pa.int32()), pa.array(pos, pa.int32())]
            yield pa.RecordBatch.from_arrays([*out, *(b.column(x).take(pa.array(row)) for x in extra)], ["e", "salt", "c", "n", "pos", *extra])

    return run


def _pairs(g: dict[str, np.ndarray], threshold: float, across: bool) -> list[np.ndarray]:
    """x, y, need of the pairs within runs of equal e; ``across``: one of each side, side 0 as x."""
    out = []
    e, c, n, pos = g["e"], g["c"], g["n"], g["pos"]
    for d in range(1, len(e)):
        i = np.flatnonzero(e[d:] == e[:-d])
        if not len(i):
            break
        j = i + d
        most = np.minimum(pos[i], pos[j]) + np.minimum(n[i] - pos[i], n[j] - pos[j])
        need = needed(np.maximum(n[i], n[j]), threshold)
        ok = (np.minimum(n[i], n[j]) >= need) & (most >= need) & (c[i] != c[j])
        if across:
            ok &= g["side"][i] != g["side"][j]
        i, j = i[ok], j[ok]
        swap = g["side"][i] > g["side"][j] if across else c[i] > c[j]
        short = needed(np.minimum(n[i], n[j]), threshold)
        out.append(np.stack([np.where(swap, c[j], c[i]), np.where(swap, c[i], c[j]), np.clip(np.minimum(short, LEADS) - LEADS + HITS, 1, HITS)]))
    return out


def paired(threshold: float, across: bool = False, group: int = GROUP):
    """A stream sorted by e and c to PAIRS: candidate pairs of small groups, or (hot) element and member of large ones.

    Holds at most ``group`` rows between batches, whatever the size of a group.
    """
    columns = ("e", "salt", "c", "n", "pos", *(["side"] if across else []))

    def run(batches):
        held, hot = None, None
        for b in itertools.chain(batches, [None]):
            if b is not None and not b.num_rows:
                continue
            now = held
            if b is not None:
                now = {x: b.column(x).to_numpy().astype(np.int64) for x in columns}
                if held is not None:
                    now = {x: np.concatenate([held[x], now[x]]) for x in columns}
                same = (now["e"][1:] == now["e"][:-1]) & (now["c"][1:] == now["c"][:-1])
                if across:
                    same &= now["side"][1:] == now["side"][:-1]
                now = {x: v[np.concatenate([[True], ~same])] for x, v in now.items()}
            if now is None:
                continue
            e = now["e"]
            cut = int(np.searchsorted(e, e[-1])) if b is not None else len(e)
            open_ = hot  # a large group goes on in this batch
            if len(e) - cut > group or (len(e) > cut and hot == e[-1]):
                hot, cut = e[-1], len(e)
            held = {x: v[cut:] for x, v in now.items()} if cut < len(e) else None
            if not cut:
                continue
            body = {x: v[:cut] for x, v in now.items()}
            start = np.flatnonzero(np.concatenate([[True], body["e"][1:] != body["e"][:-1]]))
            size = np.diff(np.append(start, cut))
            large = np.repeat(size > group, size) | (body["salt"] > 0)
            for h in (open_, hot):
                if h is not None:
                    large |= body["e"] == h
            out = _pairs({x: v[~large] for x, v in body.items()}, threshold, across)
            x, y, need = np.concatenate(out, 1) if out else np.zeros((3, 0), np.int64)
            m = int(large.sum())
            rows = [np.append(x, body["e"][large]), np.append(y, body["c"][large]), np.append(need, np.zeros(m, np.int64))]
            if len(rows[0]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([False, True], [len(x), m])), pa.array(rows[0]), pa.array(rows[1]), pa.array(rows[2], pa.int32())], ["hot", "x", "y", "need"]
                )

    return run


def candidates(bands: DataFrame, threshold: float, across: bool = False, group: int = GROUP) -> DataFrame:
    """(hot, x, y) of rows by ``banded``: pairs with enough shared leading elements, and members of frequent elements."""
    order = ["e", "c", "side"] if across else ["e", "c"]
    found = bands.repartition("e", "salt").sortWithinPartitions(*order).mapInArrow(paired(threshold, across, group), PAIRS)
    counted = found.groupBy("hot", "x", "y").agg(F.count("*").alias("hits"), F.max("need").alias("need"))
    return counted.where("hot or hits >= need").select("hot", "x", "y")

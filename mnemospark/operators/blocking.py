"""Joins of texts with what they contain, by equality on a piece of it instead of a test of all pairs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 4
HAN = "[⺀-鿿가-힯]"


SLOTS = 1 << 24


def slots(terms: DataFrame, size: int = SLOTS) -> bytes:
    """The set of the slots of hashes (term): a bit each, 2 MB (``size`` bits) however many there are."""
    slot = F.col("term").bitwiseAND(size - 1) + 1
    maps = terms.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m")).collect()
    bits = bytearray(size // 8)
    for b, m in maps:
        bits[(b - 1) * 4096 : b * 4096] = m
    return bytes(bits)


def in_slots(hashes: Column, bits: bytes) -> Column:
    """Whether the slot of a hash is in the set."""
    @F.pandas_udf("boolean")
    def test(values: pd.Series) -> pd.Series:
        import numpy as np

        slot = values.to_numpy() & (SLOTS - 1)
        return pd.Series((np.frombuffer(bits, np.uint8)[slot >> 3] >> (slot & 7)) & 1 == 1)

    return test(hashes)


def asked_only(batches, bits: bytes):
    """The rows with those of their ``terms`` whose slot is in the set; what is only taken for one of the set matches none later."""
    import numpy as np
    import pyarrow as pa

    known = np.frombuffer(bits, np.uint8)
    for batch in batches:
        lists = batch["terms"]
        values, at = lists.flatten().to_numpy(), lists.offsets.to_numpy()
        slot = values & (SLOTS - 1)
        good = (known[slot >> 3] >> (slot & 7)) & 1 == 1
        ends = np.r_[0, np.cumsum(good)][at - at[0]]
        kept = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values[good]))
        yield pa.RecordBatch.from_arrays([kept if n == "terms" else batch[n] for n in batch.schema.names], batch.schema.names)


COMMON = 1 << 16


def common(df: DataFrame) -> tuple[bytes, bytes]:
    """The ``COMMON`` most frequent hashes of (term, df), in order, and how frequent they are: a MB at most."""
    import numpy as np

    got = np.array(sorted(df.orderBy(F.desc("df"), "term").limit(COMMON).select("term", "df").collect()), np.int64).reshape(-1, 2)
    return got[:, 0].tobytes(), got[:, 1].tobytes()


def shortened(batches, most: bytes):
    """The rows with their common ``terms`` as two-byte places in ``most`` in a column ``common``; rarer ones stay as they are."""
    import numpy as np
    import pyarrow as pa

    known = np.frombuffer(most, np.int64)
    for batch in batches:
        lists = batch["terms"]
        values, at = lists.flatten().to_numpy(), lists.offsets.to_numpy()
        place = np.minimum(np.searchsorted(known, values), max(len(known) - 1, 0))
        short = known[place] == values if len(known) else np.zeros(len(values), bool)
        ends = np.r_[0, np.cumsum(short)][at - at[0]]
        codes = pa.BinaryArray.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer((2 * ends).astype(np.int32).tobytes()), pa.py_buffer(place[short].astype(np.uint16).tobytes())])
        rest = pa.ListArray.from_arrays(pa.array((at - at[0] - ends).astype(np.int32)), pa.array(values[~short]))
        names = [n for n in batch.schema.names if n != "common"]
        yield pa.RecordBatch.from_arrays([*(rest if n == "terms" else batch[n] for n in names), codes], [*names, "common"])


def whole(short, rest, most: bytes):
    """(row, term): the terms that ``shortened`` put into a column of codes and one of hashes; those of a term in the order of the rows."""
    import numpy as np

    n = len(rest)
    ends, sizes = np.frombuffer(short.buffers()[1], np.int32)[short.offset : short.offset + n + 1], np.diff(rest.offsets.to_numpy())
    data = short.buffers()[2]
    codes = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(np.uint16) if data is not None and n else np.zeros(0, np.uint16)
    row = np.concatenate([np.repeat(np.arange(n), np.diff(ends) // 2), np.repeat(np.arange(n), sizes)])
    return row, np.concatenate([np.frombuffer(most, np.int64)[codes], rest.flatten().to_numpy()])


def grams(text: Column, n: int) -> Column:
    """Distinct substrings of n characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(n))))


def containing(texts: DataFrame, key: str, text: str, patterns: DataFrame, name: str, pattern: str, on: tuple[str, ...] = (), gram: int = GRAM, kept: bool = False) -> DataFrame:
    """(key, name) of the texts that contain a pattern, with ``kept`` also the columns ``on``, which must be equal. Empty patterns are contained nowhere.

    A text that contains a pattern contains its last ``gram`` characters (all of a shorter one; ends differ more than beginnings): texts meet
    patterns on the hashes of these, and only such candidates are tested. Of a text only the pieces move that some pattern may end with (a set of
    ``SLOTS`` bits that every task gets); equal patterns meet it once, their names come last.
    """
    size = F.least(F.length(pattern), F.lit(gram))
    named = patterns.where(F.length(pattern) > 0).select(name, F.col(pattern).alias("_pattern"), *on).distinct()
    p = named.select("_pattern", *on).distinct().withColumn("_gram", F.xxhash64(F.right("_pattern", F.least(F.length("_pattern"), F.lit(gram)))))
    sizes = sorted(r[0] for r in patterns.where(F.length(pattern) > 0).select(size.alias("n")).distinct().collect())  # gram values at most
    if not sizes:
        return texts.join(named, list(on)).select(key, *(on if kept else ()), name).limit(0) if on else texts.select(key).crossJoin(named.select(name)).limit(0)
    bits = slots(p.select(F.col("_gram").alias("term")))
    pieces = F.concat(*[grams(F.col(text), n) for n in sizes])
    t = texts.where(F.length(text) > 0).select(key, *on, F.array_distinct(F.transform(pieces, lambda g: F.xxhash64(g))).alias("terms"))
    t = t.mapInArrow(lambda batches: asked_only(batches, bits), t.schema).select(key, *on, F.explode("terms").alias("_gram"))
    met = t.join(p, [*on, "_gram"]).select(key, *on, "_pattern").distinct()
    met = met.join(texts.select(key, text).distinct(), key).where(F.contains(F.col(text), F.col("_pattern"))).select(key, *on, "_pattern")
    return met.join(named, ["_pattern", *on]).select(key, *(on if kept else ()), name).distinct()


#: Bytes of text that are hashed at once, slots of a pattern in the set of all, bits of that set for each of its slots and at most (64 MB).
HASHED, PROBES, SPARSE, LARGEST = 1 << 18, 4, 8, 1 << 29


def _sums(data, most: int = HASHED):
    """Of bytes: a function (start, size) -> hashes of the pieces there, each in a few steps whatever its size; the same bytes have the same hash anywhere."""
    import numpy as np

    n, base = max(len(data), most), 0x9E3779B97F4A7C15
    known = getattr(_sums, "powers", ())
    if len(known) != 3 or len(known[0]) < n + 1:
        power = lambda b: np.r_[np.uint64(1), np.cumprod(np.full(n, b, np.uint64))]
        _sums.powers = known = power(base), power(pow(base, -1, 1 << 64)), np.random.default_rng(1).integers(1, 1 << 64, 256, np.uint64, endpoint=False)
    up, down, codes = known
    sums = np.r_[np.uint64(0), np.cumsum(codes[data] * up[: len(data)])]
    return lambda start, size: ((sums[start + size] - sums[start]) * down[start]) ^ (np.uint64(0xD6E8FEB86659FD93) * np.asarray(size).astype(np.uint64))


def _slot(hashes, probe: int, bits: int):
    """The slot of hashes for a probe, in a set of 2^bits."""
    import numpy as np

    factors = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5, 0x2545F4914F6CDD1D)
    return (((hashes ^ (hashes >> np.uint64(32))) * np.uint64(factors[probe])) >> np.uint64(64 - bits)).astype(np.int64)


def _runs(column):
    """(first row, bytes, offsets) of runs of the rows of a text column, each of ``HASHED`` bytes or one longer text."""
    import numpy as np

    kind = np.int64 if column.type in ("large_string", "large_binary") else np.int32
    at = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data, row = np.frombuffer(column.buffers()[2] or b"", np.uint8), 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(at, at[row] + HASHED, "right")) - 1)
        yield row, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def pattern_slots(batches, bits: int):
    """The slots of patterns: ``PROBES`` of the whole and one of its last bytes, as many as the greatest power of two it has."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for _, data, at in _runs(batch["pattern"]):
            hashed, size = _sums(data), np.diff(at)
            last = 1 << (np.frexp(size)[1].astype(np.int64) - 1)
            tail, full = hashed(at[1:] - last, last), hashed(at[:-1], size)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([_slot(tail, 0, bits), *(_slot(full, i + 1, bits) for i in range(PROBES))]))], ["term"])


def pattern_pieces(batches, sizes: list[int], known: bytes, bits: int):
    """(key, piece): the distinct pieces of a text whose slots are in the set. A piece is tried at the sizes of patterns, and only where its last bytes may end one."""
    import numpy as np
    import pyarrow as pa

    seen = np.frombuffer(known, np.uint8)

    def there(hashes, probe):
        s = _slot(hashes, probe, bits)
        return (seen[s >> 3] >> (s & 7)) & 1 == 1

    octaves: dict[int, list[int]] = {}
    for size in sizes:
        if size:
            octaves.setdefault(1 << (size.bit_length() - 1), []).append(size)
    for batch in batches:
        rows, pieces = list(range(len(batch))) * (0 in sizes), [b""] * (len(batch) * (0 in sizes))
        for first, data, at in _runs(batch["text"]):
            hashed = _sums(data)
            row = np.repeat(np.arange(len(at) - 1), np.diff(at))
            room = np.arange(1, len(data) + 1) - at[row]  # bytes of the own text up to and with this one
            found = []
            for last, those in octaves.items():
                end = np.flatnonzero(room >= last) + 1
                end = end[there(hashed(end - last, last), 0)]
                for size in those:
                    start = end[room[end - 1] >= size] - size
                    for i in range(PROBES):
                        if len(start):
                            start = start[there(hashed(start, size), i + 1)]
                    found += zip(row[start].tolist(), start.tolist(), (start + size).tolist())
            raw = data.tobytes() if found else b""
            for r, piece in {(r, raw[a:b]) for r, a, b in found}:
                rows.append(first + r)
                pieces.append(piece)
        yield pa.RecordBatch.from_arrays([batch["key"].take(pa.array(rows, pa.int64())), pa.array(pieces, pa.binary())], ["key", "piece"])


def pieces(texts: DataFrame, key: str, text: str, patterns: DataFrame, pattern: str) -> DataFrame:
    """(key, pattern) of the texts that contain a pattern, and a few pieces of texts that are none: a join on the pattern drops them. Every text contains the empty pattern.

    For joins of many long patterns, of which many end or begin alike: each piece of a text that has a pattern's size is looked up whole, in a
    set of bits that every task gets (as many as the patterns ask for, ``LARGEST`` at most), so only what is contained moves, and no text.
    A key has one text.
    """
    p = patterns.where(F.col(pattern).isNotNull()).select(F.col(pattern).alias("pattern"))
    n, sizes = p.agg(F.count("*"), F.sort_array(F.collect_set(F.octet_length("pattern")))).first()
    bits = min(max(SLOTS, (PROBES + 1) * SPARSE * n), LARGEST)
    bits = (bits - 1).bit_length()
    known = slots(p.where("pattern <> ''").mapInArrow(lambda batches: pattern_slots(batches, bits), "term long"), 1 << bits)
    t = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = t.schema["key"].dataType.simpleString()
    found = t.mapInArrow(lambda batches: pattern_pieces(batches, sizes, known, bits), f"key {kind}, piece binary")
    return found.select(F.col("key").alias(key), F.col("piece").cast("string").alias(pattern))


def naming(texts: DataFrame, key: str, text: str, names: DataFrame, name: str, on: tuple[str, ...] = ()) -> DataFrame:
    """(key, name) of the texts that mention a name as whole words (``triggers.mentions``); columns ``on`` must be equal.

    A mention holds the name's first run of letters and digits as a run of its own (a name with Han or Hangul: its first such
    character), so texts meet names on that. Names without letters and digits are mentioned nowhere.
    """
    from mnemospark.operators.triggers import mentions

    low = F.lower(F.col(text))
    runs = F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    signs = F.regexp_extract_all(low, F.lit(HAN), F.lit(0))
    first = F.when(F.col(name).rlike(HAN), F.regexp_extract(F.lower(name), HAN, 0)).otherwise(F.regexp_extract(F.lower(name), r"[\p{L}\p{N}]+", 0))
    n = names.select(name, *on).distinct().withColumn("_word", first).where("_word <> ''").withColumn("_word", F.xxhash64("_word"))
    bits = slots(n.select(F.col("_word").alias("term")))
    t = texts.select(key, *on, F.array_distinct(F.transform(F.concat(runs, signs), lambda w: F.xxhash64(w))).alias("terms"))
    t = t.mapInArrow(lambda batches: asked_only(batches, bits), t.schema).select(key, *on, F.explode("terms").alias("_word"))
    met = t.join(n, [*on, "_word"]).select(key, name).distinct()
    return met.join(texts.select(key, text).distinct(), key).where(mentions(F.col(text), F.col(name))).select(key, name).distinct()

import itertools
import random
from collections import Counter

import numpy as np
import pytest

from mnemospark.llm import components, near_duplicates, overlap, prefixes
from mnemospark.llm.words import ElementHasher, words


def share(a, b):
    x, y = Counter(words(a)), Counter(words(b))
    return sum((x & y).values()) / max(sum(x.values()), sum(y.values()), 1)


def texts(n, seed, edits=(0, 1, 3, 6)):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}{c}" for a in "kri sel vor tam".split() for b in "da lo mi pe".split() for c in "x n r s".split()]
    out = []
    for _ in range(n):
        base = [rng.choice("the old client reads from our queue and never closes a table".split()) for _ in range(8)] + rng.choices(vocabulary, k=16)
        for e in edits[: rng.randint(1, len(edits))]:
            w = list(base)
            for _ in range(e):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                rng.shuffle(w)
            out.append(" ".join(w))
    return out


def test_words():
    assert words("Ａb12 c_d 数据库!") == ["ab", "12", "c", "d", "数", "据", "库"]
    assert words(None) == words("  ") == []
    h = ElementHasher()
    assert len(h("a a b")) == 3 and len(np.intersect1d(h("a a b"), h("a b b"))) == 2
    assert [len(r) for r in h.rows(["a", None, "", "b b b"])] == [1, 0, 0, 3]


def queries_frame(spark, rows, extra=""):
    schema = "query_id string, split string, query string, source string, added_at timestamp" + extra
    return spark.createDataFrame(rows, schema)


def pairs_of(spark, df):
    members, pairs = overlap.overlaps(overlap.records(df, "query_id", "split", "query", "source", "added_at"))
    return {tuple(r) for r in overlap.found(members, pairs).collect()}, members, pairs


def test_overlap_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(f"q{i:04d}", rng.choice(["train", "Train ", "dev", "TEST", "unassigned", None, " "]), t, "s", None) for i, t in enumerate(texts(120, 5))]
    got, members, pairs = pairs_of(spark, queries_frame(spark, rows))
    side = {r[0]: (r[1] or "").strip().lower() for r in rows}
    text = {r[0]: r[2] for r in rows}
    want = {
        tuple(sorted((a, b)))
        for a, b in itertools.combinations(text, 2)
        if "train" in (side[a], side[b]) and {side[a], side[b]} & {"dev", "test"} and share(text[a], text[b]) >= 0.75
    }
    assert want and got == want
    report = {(r["split"], r["source"]): r for r in overlap.report(members, pairs).collect()}
    assert sum(r["pairs"] for r in report.values()) == len(want)


def test_overlap_edge_cases(spark):
    long = " ".join(f"w{i} x{i}" for i in range(4000))
    rows = [
        ("a", "train", "one two three", "S ", None), ("a", "train", "one two three", "S ", None), ("b", "dev", "three two one", " s", None), ("c", "test", None, None, None),
        ("d", "train", "", "s", None), (None, "dev", "one two three", "s", None), ("e", "dev", "  ", "s", None), ("f", "train", long, "s", None), ("g", "test", long + " y", "s", None),
    ]
    got, members, pairs = pairs_of(spark, queries_frame(spark, rows))
    assert got == {("a", "b"), ("f", "g")}
    clash = queries_frame(spark, [(*r, "x", 1) for r in rows], ", cls string, n int")
    assert pairs_of(spark, clash)[0] == got
    assert pairs_of(spark, queries_frame(spark, []))[0] == set()


def memory_frame(spark, rows, extra=""):
    return spark.createDataFrame(rows, "mem_id string, title string, content string, ingested_at timestamp" + extra)


def brute_groups(text):
    root = {k: k for k in text}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(text, 2):
        if share(text[a], text[b]) >= 0.75:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {k: find(k) for k in text}


def grouped(df):
    return {r["key"]: r["group"] for r in near_duplicates.groups(near_duplicates.records(df)).collect()}


def test_near_duplicates_equal_brute_force(spark):
    rows = [(f"m{i:04d}", None if i % 7 == 0 else "note", t, None) for i, t in enumerate(texts(110, 8))]
    want = brute_groups({r[0]: f"{r[1] or ''}\n{r[2]}" for r in rows})
    df = memory_frame(spark, rows)
    assert grouped(df) == want
    members = near_duplicates.groups(near_duplicates.records(df))
    pairs = {tuple(r) for r in near_duplicates.found(members).collect()}
    assert pairs == {(a, b) for a, b in itertools.combinations(sorted(want), 2) if want[a] == want[b]}


def test_near_duplicate_edge_cases(spark):
    rows = [("a", None, "x y z", None), ("b", "x", "z y", None), ("b", "x", "z y", None), ("c", None, None, None), ("d", "", "", None), (None, "x", "y", None), ("e", "q", "x " * 20000, None)]
    want = {"a": "a", "b": "a", "c": "c", "d": "d", "e": "e"}
    assert grouped(memory_frame(spark, rows)) == want
    assert grouped(memory_frame(spark, [(*r, "k", 2) for r in rows], ", key string, cid int")) == want
    assert grouped(memory_frame(spark, [])) == {}


def test_hot_bands_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 8)
    base = [f"word{i}" for i in range(20)]
    rows = []
    for i in range(40):
        w = list(base)
        w[i % 20] = f"edit{i}"
        rows.append((f"m{i:03d}", None, " ".join(w), None))
    members = near_duplicates.groups(near_duplicates.records(memory_frame(spark, rows)), group=3)
    assert {r["group"] for r in members.collect()} == {"m000"}
    rows = [(f"m{i:04d}", None, t, None) for i, t in enumerate(texts(60, 21))]
    members = near_duplicates.groups(near_duplicates.records(memory_frame(spark, rows)), group=2)
    assert {r["key"]: r["group"] for r in members.collect()} == brute_groups({r[0]: r[2] for r in rows})


def common_texts(n, seed):
    """Texts whose shared words stand in most rows and whose edits are rare."""
    rng = random.Random(seed)
    shared = [f"common{i}" for i in range(60)]
    out = []
    for i in range(n):
        base = rng.sample(shared, 30)
        for e in range(2):
            edited = list(base)
            for k in range(rng.choice((2, 4, 7, 8, 12))):
                edited[k] = f"rare{i}x{e}x{k}"
            rng.shuffle(edited)
            out.append(" ".join(edited))
    return out


def test_no_link_is_lost_where_shared_words_are_common(spark):
    rows = [(f"m{i:04d}", None, t, None) for i, t in enumerate(common_texts(120, 4))]
    want = brute_groups({r[0]: r[2] for r in rows})
    assert len(set(want.values())) < 200
    assert grouped(memory_frame(spark, rows)) == want
    cut = [(f"q{i:04d}", "train" if i % 2 else "dev", r[2], "s", None) for i, r in enumerate(rows)]
    text = {r[0]: r[2] for r in cut}
    expected = {tuple(sorted((a[0], b[0]))) for a, b in itertools.combinations(cut, 2) if a[1] != b[1] and share(text[a[0]], text[b[0]]) >= 0.75}
    assert expected and pairs_of(spark, queries_frame(spark, cut))[0] == expected


def test_overlap_of_hot_elements_and_classes(spark, monkeypatch):
    monkeypatch.setattr(overlap, "BLOCK", 4)
    base = texts(1, 9, (0,))[0].split()
    rows = []
    for i in range(36):
        w = list(base)
        if i > 20:
            w[i % 20] = f"edit{i}"
        rows.append((f"q{i:04d}", ("train", "dev", "test")[i % 3], " ".join(w), "s", None))
    rec = overlap.records(queries_frame(spark, rows), "query_id", "split", "query", "source", "added_at")
    members, pairs = overlap.overlaps(rec, group=2)
    got = [tuple(r) for r in overlap.found(members, pairs).collect()]
    want = {tuple(sorted((a[0], b[0]))) for a, b in itertools.combinations(rows, 2) if (a[1] == "train") != (b[1] == "train") and share(a[2], b[2]) >= 0.75}
    assert len(got) == len(set(got)) and set(got) == want
    assert sum(r["pairs"] for r in overlap.report(members, pairs).collect()) == len(want)


@pytest.mark.parametrize("group", [1, 3, 64])
def test_streamed_pairs_over_any_batches(group):
    import pyarrow as pa

    for seed in range(150):
        rng = random.Random(seed)
        rows = sorted({(rng.randint(0, 5), rng.randint(0, 6), rng.randint(0, 1)) for _ in range(rng.randint(0, 25))})
        across = seed % 2 == 1
        if not across:
            rows = sorted({(e, c, 0) for e, c, _ in rows})
        batches, i = [], 0
        while i < len(rows):
            part = rows[i : i + rng.randint(1, 5)]
            i += len(part)
            e, c, side = zip(*part)
            k = len(part)
            cols = [pa.array(e, pa.int64()), pa.array([0] * k, pa.int32()), pa.array(c, pa.int64()), pa.array([9] * k, pa.int32()), pa.array([1] * k, pa.int32()), pa.array(side, pa.int32())]
            batches.append(pa.RecordBatch.from_arrays(cols, ["e", "salt", "c", "n", "pos", "side"]))
        got = [r for b in prefixes.paired(0.75, across, group)(batches) for r in zip(*[x.to_pylist() for x in b.columns])]
        by = {}
        for e, c, side in rows:
            by.setdefault(e, []).append((c, side))
        want = []
        for e, v in by.items():
            if len(v) > group:
                want += [(True, e, c, 0) for c, _ in v]
                continue
            for (c, s), (d, t) in itertools.combinations(v, 2):
                if c != d and (not across or s != t):
                    x, y = ((c, d) if s < t else (d, c)) if across else (min(c, d), max(c, d))
                    want.append((False, x, y, 2))
        assert sorted(got) == sorted(want)


def test_leading_elements_hold_enough_of_every_overlap():
    rng = np.random.default_rng(1)
    table = np.zeros(1 << prefixes.LEAST.bit_length() - 1, np.uint8)
    table[: len(table) // 2] = 40
    for _ in range(300):
        n = int(rng.integers(1, 30))
        a = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        b = a.copy()
        k = int(rng.integers(0, n // 4 + 1))
        b[:k] = rng.integers(0, 1 << 32, k, dtype=np.uint32)
        row, e, _, _ = prefixes.heads(np.concatenate([a, b]), np.array([n, n]), table, 0.75)
        if len(np.intersect1d(a, b)) >= prefixes.needed(np.array([n]), 0.75)[0]:
            assert len(np.intersect1d(e[row == 0], e[row == 1])) >= min(prefixes.LEADS, prefixes.needed(np.array([n]), 0.75)[0])


def test_bayesian_pruning_bounds():
    need = near_duplicates.needed_matches()
    assert (np.diff(need) >= 0).all() and need[-1] < near_duplicates.HASHES * 0.6
    # a pair at the floor fails a batch with a chance below the chosen one
    from math import comb

    hit = 0.6 + 0.4 / 256
    for n, m in zip(range(near_duplicates.BATCH, near_duplicates.HASHES + 1, near_duplicates.BATCH), need.tolist()):
        assert sum(comb(n, k) * hit**k * (1 - hit) ** (n - k) for k in range(m)) < 10 * near_duplicates.MISS


@pytest.mark.parametrize("chain", [1, 9])
def test_components(spark, chain):
    edges = [(i, i + 1) for i in range(chain)] + [(100, 102), (102, 101), (7000, 7000)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(chain + 1)}, 100: 100, 101: 100, 102: 100}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mnemospark.llm import mixing as M
from mnemospark.llm import packing as K
from mnemospark.llm import tokens


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=120))
def test_best_fit_and_bound(sizes):
    s = np.array(sorted(sizes, reverse=True))
    b = K.best_fit(s, 50)
    fill = np.bincount(b, weights=s)
    assert fill.max() <= 50 and fill.sum() == s.sum() and (fill > 0).all()
    bound = K.lower_bound(*np.unique(s, return_counts=True), 50)
    assert -(-s.sum() // 50) <= bound <= len(fill) <= 11 * bound / 9 + 1


def test_bound_beats_volume():
    assert K.lower_bound(np.array([26]), np.array([10]), 50) == 10
    assert K.lower_bound(np.array([17]), np.array([6]), 50) == 3


def plain_fit(sizes, capacity):
    left = []
    for s in sizes:
        fits = [i for i, r in enumerate(left) if r >= s]
        if fits:
            left[min(fits, key=lambda i: left[i])] -= s
        else:
            left.append(capacity - s)
    return left


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=60))
def test_bound_and_fit_equal_plain_versions(sizes):
    s = np.array(sorted(sizes, reverse=True))
    fill = np.bincount(K.best_fit(s, 40), weights=s)
    assert sorted((40 - fill).tolist()) == sorted(plain_fit(s.tolist(), 40))
    best = -(-int(s.sum()) // 40)
    for cut in range(1, 21):
        best = max(best, int(np.ceil(sum(1 if x > 40 - cut else x / 40 if x >= cut else 0 for x in s) - 1e-9)))
    assert K.lower_bound(*np.unique(s, return_counts=True), 40) >= best


def test_memory_does_not_grow_with_the_capacity():
    s = np.array([10**12 - 1, 10**11, 5, 3])
    assert K.lower_bound(s, np.ones(4), 10**12) == 2 and K.best_fit(s, 10**12).max() == 1


def sizes(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint")


def packs(spark, rows):
    return spark.createDataFrame(rows, "pack_name string, capacity_tokens bigint")


def test_packing_is_whole(spark, monkeypatch):
    monkeypatch.setattr(K, "PART", 150)
    rng = np.random.default_rng(4)
    rows = [(i, "s", int(x)) for i, x in enumerate(rng.integers(1, 260, 900))] + [(5000, "s", 0), (5001, "s", 100)]
    placed = K.packed(sizes(spark, rows), packs(spark, [("p", 100), ("q", 64), (None, 5), ("bad", 0), ("null", None)]))
    f = placed.toPandas()
    want = {d: t for d, _, t in rows if t}
    for name, g in f.groupby("pack_name"):
        cap = int(g["capacity"].iloc[0])
        assert g.groupby("doc_id")["tokens"].sum().to_dict() == want
        assert g.groupby("container")["tokens"].sum().max() <= cap
        cut = g.groupby("doc_id")["piece"].count()
        assert all(n == -(-want[d] // cap) for d, n in cut.items())
    assert set(f["pack_name"]) == {"p", "q"}
    for r in K.summary(placed).collect():
        assert 0 <= r["excess"] <= 0.02 * r["lower_bound"] + 1 and r["used"] > 0.9


def test_packing_edge_cases(spark):
    assert K.packed(sizes(spark, []), packs(spark, [("p", 10)])).count() == 0
    assert K.packed(sizes(spark, [(1, None, 25)]), packs(spark, [])).count() == 0
    one = K.packed(sizes(spark, [(1, None, 25)]), packs(spark, [("p", 10)])).orderBy("piece").collect()
    assert [r["tokens"] for r in one] == [10, 10, 5]


def test_pivot_keeps_mass():
    rng = np.random.default_rng(0)
    w = rng.integers(1, 500, 300).astype(float)
    p = np.full(300, 0.37)
    order = np.argsort(-w)
    out = M.pivot(p[order], w[order], rng)
    assert ((out > 0) & (out < 1)).sum() <= 1
    assert out @ w[order] == pytest.approx(p @ w)
    marginal = np.mean([M.pivot(p[:40], w[:40], np.random.default_rng(i)) for i in range(400)], axis=0)
    assert abs(marginal - 0.37).max() < 0.12


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats bigint")


def test_mixture_meets_shares(spark, monkeypatch):
    monkeypatch.setattr(M, "PART", 100)
    monkeypatch.setattr(M, "FAN", 2)
    rng = np.random.default_rng(5)
    rows = [(i, "big", int(x)) for i, x in enumerate(rng.integers(1, 300, 2000))] + [(9000 + i, "small", int(x)) for i, x in enumerate(rng.integers(1, 300, 60))]
    rows += [(20000, None, 10), (20001, "other", 10), (20002, "big", 0)]
    s = sizes(spark, rows)
    plan = M.plan(s, targets(spark, [("big", 0.7, 1), (" SMALL", 0.2, 3), ("absent", 0.1, 2), (None, 0.1, 1), ("zero", 0.0, 1)]))
    mix = M.mixture(s, plan)
    shares = {r["source"]: r for r in M.shares(mix, plan).collect()}
    assert shares["absent"]["share"] == 0
    assert abs(shares["big"]["share"] - 7 / 9) < 0.01 and abs(shares["small"]["share"] - 2 / 9) < 0.01
    assert shares["small"]["most_copies"] <= 3 and shares["big"]["most_copies"] <= 1
    assert {r["doc_id"] for r in mix.collect()} <= {r[0] for r in rows if r[1] in ("big", "small") and r[2]}
    assert sorted(map(tuple, M.mixture(s, plan).collect())) == sorted(map(tuple, mix.collect()))


def test_mixture_edge_cases(spark):
    t = targets(spark, [("a", 1.0, 2)])
    empty = sizes(spark, [])
    assert M.mixture(empty, M.plan(empty, t)).count() == 0
    one = sizes(spark, [(1, "a", 5)])
    assert [tuple(r) for r in M.mixture(one, M.plan(one, t)).collect()] == [(1, "a", 5, 2)]


def test_sizes(spark):
    rows = [(1, "Hello world", " A ", None), (1, "Hello world", " A ", None), (2, None, None, None), (3, "  ", "b", None), (None, "x", "b", None), (4, "é中文 " * 30000, "b", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, published_at timestamp")
    got = {r["doc_id"]: (r["source"], r["tokens"]) for r in tokens.sized(df).collect()}
    assert got[1] == ("a", 2) and got[2] == (None, 0) and got[3] == ("b", 0) and got[4][1] > 60000 and set(got) == {1, 2, 3, 4}

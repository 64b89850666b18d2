import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mnemospark.llm import percentiles as P


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=400), st.integers(1, 7))
def test_clusters_keep_weight_and_bounds(values, parts):
    v = np.array(values)
    digests = [P.cluster(x, np.ones(len(x)), x, x) for x in np.array_split(v, parts) if len(x)]
    m, w, lo, hi = P.cluster(*(np.concatenate([d[i] for d in digests]) for i in range(4)))
    assert w.sum() == len(v) and lo.min() == v.min() and hi.max() == v.max()
    assert (np.diff(m) >= -1e-6).all() and np.isclose((m * w).sum(), v.sum(), atol=1e-3 * len(v))


def test_merged_digest_is_close_everywhere():
    rng = np.random.default_rng(1)
    v = rng.lognormal(5, 2, 200_000)
    parts = [P.cluster(x, np.ones(len(x)), x, x) for x in np.array_split(v, 40)]
    d = P.cluster(*(np.concatenate([p[i] for p in parts]) for i in range(4)))
    assert len(d[0]) <= 2 * P.DELTA
    for q in (0.001, 0.1, 0.5, 0.9, 0.99, 0.9999):
        rank = (v < P.quantile(*d, q)).mean()
        assert abs(rank - q) < 0.003


def frame(spark, rows):
    return spark.createDataFrame(rows, "grp string, day date, search_ms double, kept_tokens bigint")


def test_certified_error_and_edge_cases(spark):
    rng = np.random.default_rng(2)
    rows = [("hot", None, float(x), int(x)) for x in rng.exponential(100, 4000)]
    rows += [(None, None, 1.0, 1), ("bad", None, float("nan"), None), ("bad", None, -1.0, None), ("bad", None, float("inf"), None), ("bad", None, None, None), ("ties", None, 5.0, 7), ("ties", None, 5.0, 7)]
    df = frame(spark, rows)
    got = {(r["question_type"], r["measure"], r["quantile"]): r for r in P.certified(df, P.digests(df)).collect()}
    assert not [k for k in got if k[0] == "bad"]
    assert got[("ties", "search_ms", 0.5)]["value"] == 5 and got[("ties", "search_ms", 0.5)]["rank_error"] == 0
    assert got[(None, "kept_tokens", 0.99)]["value"] == 1
    v = np.array([r[2] for r in rows[:4000]])
    for q in P.QUANTILES:
        r = got[("hot", "search_ms", q)]
        below, upto = (v < r["value"]).sum(), (v <= r["value"]).sum()
        want = max(0, below - q * 4000, q * 4000 - upto) / 4000
        assert r["rank_error"] == pytest.approx(want) and r["rank_error"] < 0.005 and r["n"] == 4000
    assert P.certified(frame(spark, []), P.digests(frame(spark, []))).count() == 0


def test_days_combine(spark):
    import datetime as dt

    rows = [("g", dt.date(2025, 1, 1 + i % 3), float(i), i) for i in range(900)]
    daily = P.digests(frame(spark, rows))
    assert {r["day"] for r in daily.select("day").distinct().collect()} == {dt.date(2025, 1, d) for d in (1, 2, 3)}
    whole = P.merge(daily, "grp", "measure").where("measure = 'search_ms'").toPandas()
    assert whole["weight"].sum() == 900
    assert abs(P.quantile(*(whole[c].to_numpy() for c in ("mean", "weight", "low", "high")), 0.5) - 450) < 5

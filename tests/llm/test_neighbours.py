import numpy as np

from mnemospark.llm import neighbours as N


def data(seed=3, clusters=40, size=30):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((clusters, 64))
    v = np.concatenate([x + 0.55 * rng.standard_normal((size, 64)) for x in c] + [rng.standard_normal((100, 64))]).astype(np.float32)
    return v * rng.uniform(0.2, 3, (len(v), 1)).astype(np.float32)


def brute(ids, v):
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -9)
    out = set()
    for i in range(len(ids)):
        c = np.flatnonzero(s[i] >= 0.8)
        for j in c[np.lexsort((ids[c], -s[i][c]))][:5]:
            out.add((min(int(ids[i]), int(ids[j])), max(int(ids[i]), int(ids[j]))))
    return out


def frame(spark, rows, extra=""):
    return spark.createDataFrame(rows, "vec_id bigint, vector array<float>, embedded_at timestamp" + extra)


def found(spark, df):
    return {tuple(r) for r in N.found(*N.neighbours(df)).collect()}


def test_recall_against_brute_force(spark):
    v = data()
    v[50:56] = v[49]  # equal vectors under different ids
    v[60] = v[61] * 2
    ids = np.random.default_rng(1).permutation(len(v) * 3)[: len(v)]
    got, want = found(spark, frame(spark, [(int(i), [float(x) for x in r], None) for i, r in zip(ids, v)])), brute(ids, v)
    assert len(got & want) / len(want) >= 0.97
    assert len(got - want) <= 0.03 * len(want)
    same = {tuple(sorted(map(int, p))) for p in [(a, b) for a in ids[49:56] for b in ids[49:56] if a < b]}
    assert len(same & got) == len(same & want)


def test_scan_abandons_but_keeps_the_nearest():
    v = N._unit(data(seed=9))
    same = np.arange(len(v))
    x, y = N.scan(v, v, same)
    s = v @ v.T
    np.fill_diagonal(s, -9)
    top = {(i, int(s[i].argmax())) for i in range(len(v)) if s[i].max() >= 0.81}
    assert len(top & set(zip(x.tolist(), y.tolist()))) >= 0.995 * len(top)
    assert len(x) < 0.05 * len(v) ** 2


def test_edge_cases(spark):
    one = [1.0] + [0.0] * 63
    two = [1.0, 0.1] + [0.0] * 62
    rows = [
        (1, one, None), (1, one, None), (2, two, None), (3, None, None), (4, [], None), (5, one[:63], None), (6, [0.0] * 64, None), (7, [float("nan")] + one[1:], None),
        (8, [float("inf")] + one[1:], None), (None, one, None), (9, [None] + one[1:], None), (10, [-1.0] + [0.0] * 63, None),
    ]
    assert found(spark, frame(spark, rows)) == {(1, 2)}
    assert found(spark, frame(spark, [(*r, 1, 2) for r in rows], ", cid int, id int")) == {(1, 2)}
    assert found(spark, frame(spark, [])) == set()
    assert found(spark, frame(spark, rows[:1])) == set()


def test_long_lists_are_cut_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(N, "CHUNK", 50)
    monkeypatch.setattr(N, "LIST", 10_000)
    v = data(seed=4, clusters=6)
    ids = np.arange(len(v))
    got, want = found(spark, frame(spark, [(int(i), [float(x) for x in r], None) for i, r in zip(ids, v)])), brute(ids, v)
    assert len(got & want) >= 0.97 * len(want)


def test_long_lists_get_lists_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(N, "CHUNK", 120)
    monkeypatch.setattr(N, "LIST", 60)
    monkeypatch.setattr(N, "SAMPLE", 40)  # at most four lists at the first level
    monkeypatch.setattr(N, "PART", 100)
    v = data(seed=6, clusters=20)
    v[200:340] = v[200]  # and one class of copies
    ids = np.random.default_rng(2).permutation(len(v))
    got, want = found(spark, frame(spark, [(int(i), [float(x) for x in r], None) for i, r in zip(ids, v)])), brute(ids, v)
    assert len(got & want) >= 0.97 * len(want)
    assert len(got - want) <= 0.03 * len(want)


def test_dense_lists_are_scanned_by_blocks_too():
    rng = np.random.default_rng(5)
    v = N._unit((rng.standard_normal(64) * 1.2 + rng.standard_normal((900, 64))).astype(np.float32))
    work: list[int] = []
    x, y = N.scan(v, v, np.arange(len(v)), floor=0.75, work=work)
    assert max(work) == 900 * 512 and sum(work) < 0.9 * 4 * 900 * 900  # pairs were abandoned before their last block
    s = v @ v.T
    np.fill_diagonal(s, -9)
    top = {(i, int(s[i].argmax())) for i in range(len(v)) if s[i].max() >= 0.76}
    assert len(top & set(zip(x.tolist(), y.tolist()))) >= 0.99 * len(top)

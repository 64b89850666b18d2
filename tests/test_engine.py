import pytest

from mnemospark.api import Engine


def test_engine_lifecycle(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    assert e.stats()["memories"] == 0
    a = e.remember("Deploy the retry_handler with the canary first", scope="Web")
    b = e.remember("The canary sings at dawn", scope="api")
    r = e.remember("Always run the tests", mem_type="rule", source="agent")
    assert [h["mem_id"] for h in e.recall("how do we deploy the canary", "web")] == [a]
    assert e.recall("canary", "other") == []
    assert e.expand(r)["status"] == "pending_review" and e.review(r, True) and not e.review(r, True)
    assert e.flag(a) and e.expand(a)["confidence"] == pytest.approx(0.65)
    assert e.edit(b, "The canary sings at noon") and e.expand(b)["content"].endswith("noon")
    e.rollback(f"edit:{b}:1")
    assert e.expand(b)["content"].endswith("dawn")
    with pytest.raises(ValueError):
        e.rollback(f"remember:{a}")
    assert e.forget(b) and e.recall("canary dawn", "api") == [] and not e.forget("mem_none")
    for bad in (dict(content=" "), dict(content="x", mem_type="nope")):
        with pytest.raises(ValueError):
            e.remember(**bad)
    assert e.stats()["active"] == 1


def test_foreign_memories_never_crowd_out_the_one_in_scope(spark, tmp_path):
    from mnemospark.operators import index

    rows = [(f"f{i:03d}", "other", "deploy canary release") for i in range(280)] + [("mine", "web", "deploy the canary to production slowly")]
    docs = spark.createDataFrame(rows, "mem_id string, scope string, text string")
    asked = spark.createDataFrame([("q", "Web", "deploy canary"), ("none", "Web", "zebra")], "query_id string, project string, text string")
    scores, ids, names = index.keyword_scores(docs, asked)
    got = index.named(scores, ids, names).collect()
    assert [(r["query_id"], r["mem_id"]) for r in got] == [("q", "mine")] and 0.5 < got[0]["keyword"] <= 1


def test_queries_and_sql_have_the_same_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    import os

    if not os.path.exists("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["query_id", "mem_id", "keyword", "rank"] and df.count() > 0


@pytest.mark.parametrize("name", ["f11_intents", "w9_greedy_budget", "k4_idle_sessions", "a19_retrieval_metrics", "j12_provenance", "e3_cut_sessions"])
def test_query_equals_its_sql(spark, name):
    import os

    if not os.path.exists("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    import duckdb

    import __spark_entry__ as entry

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(d):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{d}/{f}'")
    df = entry.queries()[name](spark, d)
    cols = sorted(df.columns)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == cols
    show = lambda r: tuple(f"{x:.6f}" if isinstance(x, float) else str(x) for x in r)
    assert sorted(map(show, df.select(*cols).collect())) == sorted(map(show, want.select(*[f'"{c}"' for c in cols]).fetchall()))


@pytest.mark.parametrize("docs_at_once", [100_000, 40])
def test_search_takes_from_candidates_where_they_meet(spark, monkeypatch, docs_at_once):
    from mnemospark.operators import index

    words = ["deploy", "canary", "release", "branch_lock", "cache", "表格", "running", "policies"]
    rows = [(f"m{i:03d}", ("global", "web", "api")[i % 3], " ".join(words[(i * k + k) % 8] for k in range(1, 2 + i % 6))) for i in range(150)] + [("n", None, "deploy"), ("o", "web", "")]
    docs = spark.createDataFrame(rows, "mem_id string, scope string, text string")
    asked = spark.createDataFrame([("a", "Web", "deploy the canary 表格"), ("b", None, "locks of a branch_lock policy"), ("c", "api", "zebra"), ("d", "Global", "cache release")], "query_id string, project string, text string")
    scores, ids, names = index.keyword_scores(docs, asked)
    want = {(r["query_id"], r["mem_id"]): r["keyword"] for r in index.named(scores, ids, names).collect()}
    monkeypatch.setattr(index, "DOCS", docs_at_once)
    took = lambda q, number, k, docs, place: [number, k]
    got = index.searched(index.stored(docs), asked, took, "mem_id string, keyword double")
    assert len(want) > 100
    found = {(r["query_id"], r["mem_id"]): r["keyword"] for r in got.collect()}
    assert found.keys() == want.keys() and all(found[x] == pytest.approx(want[x], abs=1e-6) for x in want)
    top = {(q, m) for q in "abd" for m in [m for _, m in sorted((-round(v, 6), m) for (p, m), v in want.items() if p == q)][:3]}
    from mnemospark.plans.retrieval_queries import best_of, first_rows

    best = first_rows(index.searched(index.stored(docs), asked, best_of(3), "mem_id string, keyword double"), 3)
    assert {(r["query_id"], r["mem_id"]) for r in best.collect()} == top


def test_terms_travel_once_and_short(spark, monkeypatch):
    """Documents reach one task for very many questions, and most of their terms as two bytes; before, each 4 096 questions got copies of 8-byte hashes."""
    from mnemospark.operators import index

    docs = spark.range(60).selectExpr("concat('m', id) AS mem_id", "'p' AS scope", "concat('word', id % 7, ' other', id % 5, ' alone', id) AS text")
    asked = spark.range(9000).selectExpr("concat('q', id) AS query_id", "'p' AS project", "concat('word', id % 7, ' alone', id % 60) AS text")
    seen, meet = [], index._meet

    def counting(left, right, *more):
        seen.append(right.selectExpr("count(*)", "sum(size(terms))", "sum(length(common))").first())
        return meet(left, right, *more)

    monkeypatch.setattr(index, "_meet", counting)
    took = lambda q, number, k, docs, place: [number, k]
    assert index.searched(index.stored(docs), asked, took, "mem_id string, keyword double").count() > 9000
    copies, rare, short = seen[0]
    assert copies == 60 and rare == 0 and short == 2 * 60 * 2


def test_shortened_terms_are_the_same():
    import numpy as np
    import pyarrow as pa

    from mnemospark.operators import blocking

    most = np.array([-5, 3, 9], np.int64).tobytes()
    rows = pa.RecordBatch.from_arrays([pa.array(["a", "b", "c", "d"]), pa.array([[9, 7, -5, 9], [], [8], [3]], pa.list_(pa.int64()))], ["id", "terms"])
    for batch in (rows, rows.slice(1), rows.slice(2, 1)):
        for given in (most, b""):
            (out,) = blocking.shortened([batch], given)
            row, term = blocking.whole(out["common"], out["terms"], given)
            assert [sorted(term[row == n].tolist()) for n in range(len(batch))] == [sorted(x) for x in batch["terms"].to_pylist()]
            assert given == b"" or set(out["terms"].flatten().to_pylist()) <= {7, 8}

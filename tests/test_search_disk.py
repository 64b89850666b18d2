"""What the searches move and write: small cases of the findings on disk."""

import pytest
from pyspark.sql import functions as F


def test_only_repeated_keys_move(spark):
    """Texts of keys that occur once stay where they are; before, all texts were shuffled to find the latest row of each key."""
    from mnemospark.sources.tables import latest, latest_texts

    rows = [(f"k{i}", i % 3, f"text {i}", i) for i in range(200)] + [("k7", 9, "later", 1), ("k7", 9, "later still", 0), (None, 1, "no key", 2), ("k8", None, "no version", 3)]
    t = spark.createDataFrame(rows, "id string, at int, text string, n int")
    want, got = latest(t, "id", "at", "id", "text", "n"), latest_texts(t, "id", "at", "id", "text", "n")
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect()) and got.count() == 200
    assert {r["id"] for r in latest_texts(t.where("false"), "id", "at", "id", "text").collect()} == set()


def test_questions_come_with_columns(spark, tmp_path):
    """r6: a column beside the question; before, it was compared with a name, which fails."""
    from mnemospark.plans.retrieval_queries import asked_with

    spark.createDataFrame([("q", "p", "when?", ["m"], 1)], "query_id string, project string, query string, expected array<string>, added_at int").write.parquet(f"{tmp_path}/queries.parquet")
    assert asked_with(spark, str(tmp_path), F.length("query").alias("n"), "expected").collect() == [("q", "p", "when?", 5, ["m"])]


def test_terms_without_documents_stay(spark, monkeypatch):
    """Asked terms that no document has are a number, and frequent ones need no row of their own; before, all were sent with their counts."""
    from mnemospark.operators import index

    docs = spark.createDataFrame([(f"m{i}", "p", f"deploy word{i % 5}") for i in range(20)], "mem_id string, scope string, text string")
    asked = spark.createDataFrame([("a", "p", "deploy word1 unknownone unknowntwo"), ("b", "p", "unknownone unknownthree")], "query_id string, project string, text string")
    scores, ids, names = index.keyword_scores(docs, asked)
    want = {(r["query_id"], r["mem_id"]): r["keyword"] for r in index.named(scores, ids, names).collect()}
    seen, meet = [], index._meet
    monkeypatch.setattr(index, "_meet", lambda left, right, *more: seen.append(left.collect()) or meet(left, right, *more))
    took = lambda q, number, k, docs, place: [number, k]
    got = index.searched(lambda bits: index.stored(docs, bits=bits), asked, took, "mem_id string, keyword double").collect()
    assert {(r["query_id"], r["mem_id"]): pytest.approx(r["keyword"], abs=1e-6) for r in got} == want and len(want) == 20
    left = {r["query_id"]: r for r in seen[0]}
    assert None not in left and (left["a"]["absent"], len(left["a"]["common"]), left["a"]["terms"]) == (2, 4, [])
    assert left["b"]["absent"] == 2


def _small_tables(at, spark):
    import datetime as dt

    day, w = dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc), ["deploy", "canary", "release", "branch", "cache"]
    vector = lambda i: [float((i * (k + 3)) % 11 - 4) for k in range(64)]
    kinds = ("fact", "instruction", "summary", "rule")
    mem = [(f"m{i:02d}", ("global", "web", "api")[i % 3], kinds[i % 4], f"about {w[i % 5]}", f"{w[i % 5]} {w[(i * 3) % 5]} number{i % 7} rare{i}", "active", "2024-12-15", day) for i in range(40)]
    qry = [(f"q{i}", (None, "web", "Global", "api", "other")[i % 5], f"{w[i % 5]} and number{i % 9} {'nothing' * (i % 2)}", [f"m{(i * 7) % 40:02d}"] if i % 4 else [], day) for i in range(20)]
    vec = [(i, f"m{i % 40:02d}", "memory", vector(i), day) for i in range(36)] + [(100 + i, f"m{i:02d}", "memory", vector(i + 50), day) for i in range(3)]
    for name, rows, schema in (
        ("memories", mem, "mem_id string, mem_scope string, mem_type string, title string, content string, status string, created_at string, ingested_at timestamp"),
        ("queries", qry, "query_id string, project string, query string, expected array<string>, added_at timestamp"),
        ("index_vectors", vec, "vec_id long, owner_id string, owner_kind string, vector array<float>, embedded_at timestamp"),
    ):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/{name}.parquet")
    return str(at)


def _same_as_sql(spark, at, name):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in ("memories", "queries", "index_vectors"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet/*.parquet'")
    got = entry.queries()[name](spark, at)
    show = lambda r: tuple(f"{x:.6f}" if isinstance(x, float) else str(x) for x in r)
    cols = sorted(got.columns)
    want = con.sql(entry.oracle_sql()[name]).select(*[f'"{c}"' for c in cols]).fetchall()
    rows = got.select(*cols).collect()
    assert want and sorted(map(show, rows)) == sorted(map(show, want))
    return rows


@pytest.mark.parametrize("docs_at_once", [100_000, 5])
def test_vectors_and_words_meet_in_one_task(spark, tmp_path, monkeypatch, docs_at_once):
    """r2: no table of pairs is written; before, all near pairs and all candidates were."""
    from mnemospark.operators import index
    from mnemospark.plans import retrieval_queries

    at, tables = _small_tables(tmp_path, spark), []
    monkeypatch.setattr(index, "DOCS", docs_at_once)
    monkeypatch.setattr(retrieval_queries, "written", lambda df, tag="t", **x: tables.append(tag) or index.written(df, tag, **x))
    rows = _same_as_sql(spark, at, "r2_hybrid_recall")
    assert len({r["reason"] for r in rows}) == 3 and tables == ["vectors"]


def test_packing_and_planning_read_one_search(spark, tmp_path, monkeypatch):
    """r13, r15: one search gives what is packed or planned; before, r15 had a search by words and one by vectors, r13 moved all texts to the hits."""
    from mnemospark.operators import index, retrieval
    from mnemospark.plans import composite_queries as c

    at, seen, searched = _small_tables(tmp_path, spark), [], index.searched
    monkeypatch.setattr(index, "searched", lambda *x, **y: seen.append(1) or searched(*x, **y))
    monkeypatch.setattr(retrieval, "semantic_scores", None)
    r2 = {(r["query_id"], r["mem_id"]) for r in c.searched_with_vectors(spark, at, c.fused, "mem_id string, score double, reason int").collect()}
    assert {(r["question_id"], r["id"]) for r in c.r13_packed_results(spark, at).collect()} == r2  # all fit
    got = c.r15_planned_search(spark, at).collect()
    assert len(seen) == 3 and max(r["position"] for r in got) == 4


@pytest.mark.parametrize("docs_at_once", [100_000, 5])
def test_channels_are_told_apart_in_the_search(spark, tmp_path, monkeypatch, docs_at_once):
    """u1: an instruction that is expected is marked where it is found; before, both channels were sorted by question and memory."""
    from mnemospark.operators import index, retrieval

    monkeypatch.setattr(index, "DOCS", docs_at_once)
    monkeypatch.setattr(retrieval, "first_writer", None)
    assert {r["channel"] for r in _same_as_sql(spark, _small_tables(tmp_path, spark), "u1_channel_union")} == {"search", "instruction"}


@pytest.mark.parametrize("docs_at_once", [100_000, 5])
def test_cutoff_reads_asked_terms_only(spark, tmp_path, monkeypatch, docs_at_once):
    """f8: the stored index has the asked terms, no others; before, it had every term as text."""
    from mnemospark.operators import index

    tables, written = {}, index.written
    monkeypatch.setattr(index, "DOCS", docs_at_once)
    monkeypatch.setattr(index, "written", lambda df, tag="t", **x: tables.setdefault(tag, written(df, tag, **x)))
    _same_as_sql(spark, _small_tables(tmp_path, spark), "f8_relative_cutoff")
    got = tables["index"].agg(F.sum("len"), F.sum(F.size("terms"))).first()
    assert dict(tables["index"].dtypes)["terms"] == "array<bigint>" and got[1] < got[0] == 40 * 5


@pytest.mark.parametrize("docs_at_once", [100_000, 5])
def test_cutoff_takes_one_row_of_a_question(spark, tmp_path, monkeypatch, docs_at_once):
    """f8: the search gives a row for each question whose scopes are not cut; before, one for each score near the best."""
    from mnemospark.operators import index

    hits, searched = [], index.searched
    monkeypatch.setattr(index, "DOCS", docs_at_once)
    monkeypatch.setattr(index, "searched", lambda *x, **y: hits.append(searched(*x, **y)) or hits[0])
    rows = _same_as_sql(spark, _small_tables(tmp_path, spark), "f8_relative_cutoff")
    n = hits[0].count()
    assert n == len(rows) if docs_at_once > 40 else n > len(rows)


def test_lines_of_a_scope_are_made_once(spark, monkeypatch):
    """w15: questions about the whole record share the lines of their scope; before, each got copies of up to 401 lines."""
    from mnemospark.operators import logs

    tables, written = {}, logs.written
    monkeypatch.setattr(logs, "written", lambda df, tag="t", **x: tables.setdefault(tag, written(df, tag, **x)))
    t = spark.range(600).selectExpr("id AS turn_id", "if(id < 590, 'p', 'r') AS scope", "cast(id + 1 as int) AS number", "'2025' AS said", "repeat('x', cast(id % 9 as int)) AS text", "if(id % 2 = 0, 'yes', null) AS note")
    q = spark.range(30).selectExpr("concat('q', id) AS query_id", "'p' AS scope", "id > 0 AS whole", "id % 2 = 0 AS notes")
    ranked = spark.createDataFrame([("q0", 0, 1, 580), ("q1", 0, 1, 581)], "query_id string, ranking int, place int, turn_id long")
    got = {r["query_id"]: r for r in logs.message_log(q, ranked, t, 4000).collect()}
    assert len(got) == 30 and got["q0"]["text"] == "- #581 [2025] xxxx → Assistant: yes"
    assert got["q1"]["text"].endswith("- #582 [2025] xxxxx") and got["q1"]["kept"] > 150 and len(got["q1"]["text"]) <= 4000
    assert tables["lines"].count() == 402 + 2  # before: 29 times that many rows with texts


def test_turns_keep_asked_terms_only(spark, tmp_path, monkeypatch):
    """r7: texts of turns do not move and their index has the asked terms only; before, both were whole."""
    import datetime as dt

    from mnemospark.operators import index
    from mnemospark.plans import retrieval_queries

    at, day = _small_tables(tmp_path, spark), dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(i, f"s{i % 4}", "web", f"deploy number{i % 9} unasked{i}", day) for i in range(60)] + [(3, "s3", "web", "canary", day + dt.timedelta(1))]
    spark.createDataFrame(rows, "turn_id long, session_id string, project string, text string, ingested_at timestamp").write.parquet(f"{at}/turns.parquet")
    tables, written = {}, index.written
    monkeypatch.setattr(index, "written", lambda df, tag="t", **x: tables.setdefault(tag, written(df, tag, **x)))
    monkeypatch.setattr(retrieval_queries, "turns", None)
    got = retrieval_queries.r7_turn_recall(spark, at).collect()
    assert got and len({(r["query_id"], r["rank"]) for r in got}) == len(got)
    sizes = tables["index"].agg(F.sum("len"), F.sum(F.size("terms"))).first()
    assert sizes[0] == 59 * 3 + 1 and sizes[1] < sizes[0] - 50


@pytest.mark.parametrize("exact", [True, False])
def test_only_large_scopes_are_cut(spark, monkeypatch, exact):
    """r7: questions and documents of small scopes meet once; before, one scope over ``DOCS`` made all meet twice, and all questions once for each block."""
    from mnemospark.operators import index

    docs = spark.createDataFrame([(f"m{i:03d}", ("big", "small", "global")[min(i // 30, 2) if i < 40 else 0], f"deploy word{i % 5} more{i % 7} {'pad ' * (i % 4)}") for i in range(60)], "mem_id string, scope string, text string")
    asked = spark.createDataFrame([(f"q{i}", ("big", "small", "Small", "none")[i % 4], f"deploy word{i % 5} more{i % 7} unknown") for i in range(24)], "query_id string, project string, text string")
    took, schema = lambda q, number, k, docs, place: [number, k], "mem_id string, keyword double"
    run = lambda: sorted(map(tuple, index.searched(lambda bits: index.stored(docs, bits=bits), asked, took, schema, exact=exact).collect()))
    want = run()
    seen, meet = [], index._meet
    monkeypatch.setattr(index, "_meet", lambda left, right, *more: seen.append((left.where("query_id is not null").collect(), right.collect())) or meet(left, right, *more))
    monkeypatch.setattr(index, "DOCS", 20)
    assert run() == want and len({r[0] for r in want}) == 18
    (first, divided), (left, right) = seen
    assert {r["query_id"] for r in first} == {f"q{i}" for i in range(0, 24, 4)} and {r["scope"] for r in divided} == {"big"}
    assert len(left) == 6 * 3 + 18 and len({(r["bucket"], r["part"], r["mem_id"]) for r in right}) == len(right)
    assert {r["part"] for r in right if r["scope"] == "small"} == {0} and {r["part"] for r in right if r["scope"] == "big"} == {0, 1, 2}


def test_only_what_is_cited_moves(spark, tmp_path, monkeypatch):
    """c24: titles that end alike meet only the texts that hold them whole; before, each met all texts with its ending, which got its text, and a title of ellipses alone was cited nowhere."""
    import datetime as dt

    from mnemospark.operators import blocking
    from mnemospark.plans import more_queries

    at, day = _small_tables(tmp_path, spark), dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc)
    ending, tables, written = "writes to the shared queue", {}, more_queries.written
    titles = [f"step {i} {ending}…" for i in range(60)] + ["Просьба учесть…", "ab…………………………", "……………………………………", "short…", None, "Long " + "title " * 60, f"step 7 {ending}"]
    mem = [(f"mem_{i}", x, day) for i, x in enumerate(titles)] + [("mem_3", "later title of this one", day + dt.timedelta(1)), (None, "step 1", day)]
    asked = [f"Who says that STEP {i} {ending}, step {i} {ending}?" for i in range(0, 80, 7)] + ["просьба учесть: 请注意", "", None, "LONG " + "title " * 70, "x" * 300_000 + " step 9 " + ending]
    qry = [(f"q{i}", x, [f"mem_{i}", "mem_none", f"mem_{i * 7}"] if i % 3 else None, day) for i, x in enumerate(asked)]
    spark.createDataFrame(mem, "mem_id string, title string, ingested_at timestamp").coalesce(1).write.mode("overwrite").parquet(f"{at}/memories.parquet")
    spark.createDataFrame(qry, "query_id string, query string, expected array<string>, added_at timestamp").coalesce(1).write.mode("overwrite").parquet(f"{at}/queries.parquet")
    monkeypatch.setattr(more_queries, "written", lambda df, tag="t", **x: tables.setdefault(tag, written(df, tag, **x)))
    monkeypatch.setattr(blocking, "containing", None)
    rows = _same_as_sql(spark, at, "c24_citations")
    cited = {(r["query_id"], r["mem_id"]) for r in rows}
    assert len(cited) == len(rows) and {("q1", "mem_7"), ("q1", "mem_66"), ("q12", "mem_60"), ("q13", "mem_62"), ("q15", "mem_65"), ("q16", "mem_9")} <= cited and ("q2", "mem_0") not in cited
    assert tables["titles"].count() == 67 and tables["pieces"].count() < 40  # before: 13 texts with 60 endings, and all texts

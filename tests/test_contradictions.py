"""The negation branch of the contradiction candidates."""

import datetime

from mnemospark.catalog import QUERIES


def test_statements_that_contradict_by_negation_are_candidates(spark, tmp_path):
    at = datetime.datetime(2026, 1, 1)
    rows = [
        ("m1", "Web", "fact", "active", "We use Redis for sessions", [], at),
        ("m2", "web", "fact", "active", "We have never used Redis for sessions", ["m0"], at),
        ("m3", "web", "fact", "active", "Sessions live in Redis", ["m0"], at),
        ("m4", "web", "rule", "active", "Never use Redis", [], at),
        ("m5", "web", "fact", "archived", "Redis was never used", [], at),
        ("m6", "api", "fact", "active", "Redis was never used", [], at),
    ]
    spark.createDataFrame(
        rows, "mem_id string, mem_scope string, mem_type string, status string, content string, supersedes array<string>, ingested_at timestamp"
    ).write.parquet(f"{tmp_path}/memories.parquet")
    unit = lambda c: [c, (1 - c * c) ** 0.5] + [0.0] * 62
    vectors = [(i, f"m{i}", "memory", unit(c), at) for i, c in ((1, 1.0), (2, 0.2), (3, 0.9), (4, 0.3), (5, 0.25), (6, 0.2))]
    spark.createDataFrame(vectors, "vec_id long, owner_id string, owner_kind string, vector array<float>, embedded_at timestamp").write.parquet(f"{tmp_path}/index_vectors.parquet")
    got = {(r["first_id"], r["second_id"]) for r in QUERIES["j17_contradictions"](spark, str(tmp_path)).collect()}
    # no numbers anywhere, and one pair far under 0.6: only the negation makes these pairs
    assert got == {("m1", "m2"), ("m2", "m3")}
    assert not QUERIES["j17_contradiction_candidates"](spark, str(tmp_path)).collect()

"""Queries of the training-data operators."""

from __future__ import annotations

from mnemospark.llm import languages, mixing, near_duplicates, neighbours, overlap, packing, percentiles, personal, unwanted


def p1_found(spark, sf_dir):
    return languages.found(spark, sf_dir)


def p1_segments(spark, sf_dir):
    return languages.segment_languages(spark, sf_dir)


def p4_found(spark, sf_dir):
    return personal.found(spark, sf_dir)


def p4_redacted(spark, sf_dir):
    return personal.redacted(spark, sf_dir)


def p2_found(spark, sf_dir):
    return overlap.found(*overlap.query_overlaps(spark, sf_dir))


def p2_report(spark, sf_dir):
    return overlap.report(*overlap.query_overlaps(spark, sf_dir))


def p3_percentiles(spark, sf_dir):
    return percentiles.percentiles(spark, sf_dir)


def p3_daily_digests(spark, sf_dir):
    return percentiles.daily_digests(spark, sf_dir)


def p5_found(spark, sf_dir):
    return neighbours.found(*neighbours.vector_neighbours(spark, sf_dir))


def p6_found(spark, sf_dir):
    return near_duplicates.found(near_duplicates.memory_groups(spark, sf_dir))


def p6_groups(spark, sf_dir):
    return near_duplicates.memory_groups(spark, sf_dir).selectExpr("key AS mem_id", "`group` AS group_id")


def p7_packing(spark, sf_dir):
    return packing.document_packing(spark, sf_dir).select("pack_name", "container", "doc_id", "piece", "tokens")


def p7_summary(spark, sf_dir):
    return packing.summary(packing.document_packing(spark, sf_dir))


def p8_mixture(spark, sf_dir):
    return mixing.document_mixture(spark, sf_dir)


def p8_shares(spark, sf_dir):
    return mixing.document_shares(spark, sf_dir)


def p9_found(spark, sf_dir):
    return unwanted.found(unwanted.document_scores(spark, sf_dir))


def p9_scores(spark, sf_dir):
    return unwanted.document_scores(spark, sf_dir)


def p9_rates(spark, sf_dir):
    return unwanted.rates(unwanted.document_scores(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_segments, p2_found, p2_report, p3_percentiles, p3_daily_digests, p4_found, p4_redacted, p5_found, p6_found, p6_groups,
        p7_packing, p7_summary, p8_mixture, p8_shares, p9_found, p9_scores, p9_rates,
    )
}
SQL: dict[str, str] = {}

"""Readers of the engine's base tables (one Parquet directory or file per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as stored; column pruning and filters reach the Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(df: DataFrame, key: str, version: str, *columns: str) -> DataFrame:
    """One row per key: the one with the greatest (version, columns...).

    Rows without a key are dropped. One hash shuffle with map-side combining;
    only the named columns take part, so texts that are not needed never move.
    """
    rest = [c for c in columns if c not in (key, version)]
    best = F.max(F.struct(version, *rest)).alias("_best")
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(best)
        .select(key, *[F.col(f"_best.{c}").alias(c) for c in columns if c != key])
    )


def latest_texts(df: DataFrame, key: str, version: str, *columns: str) -> DataFrame:
    """As ``latest``, for columns that are large: only rows whose key may occur more than once move.

    Keys are counted by their hashes; those of repeated keys are a set of slots of fixed size that every task gets.
    """
    from mnemospark.operators.blocking import in_slots, slots

    hashed = F.xxhash64(key)
    df = df.where(F.col(key).isNotNull()).select(key, *dict.fromkeys([version, *(c for c in columns if c != key)]))
    often = df.select(hashed.alias("term")).groupBy("term").count().where("count > 1")
    flagged = df.withColumn("_often", in_slots(hashed, slots(often)))
    names = [key, *(c for c in columns if c != key)]
    return flagged.where("not _often").select(*names).unionByName(latest(flagged.where("_often"), key, version, *columns).select(*names))

"""Append-only event log with sealed payloads, JSONL readers and the vector codec."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions.text import redact_json

TRACE = "query string, project string, features string, moment string, expected_memory_ids array<string>"
QUESTION = "id string, query string, project string"


def sealed(payload: Column, key: Column) -> Column:
    """AES-256-GCM with a random nonce, in front of the ciphertext."""
    return F.aes_encrypt(payload, key, F.lit("GCM"))


def opened(blob: Column, key: Column) -> Column:
    """The payload, or null where the key or the blob is wrong."""
    return F.try_aes_decrypt(blob, key, F.lit("GCM")).cast("string")


def appended(events: DataFrame, key: bytes) -> DataFrame:
    """Rows for the log: features redacted, payload sealed."""
    k = F.lit(bytearray(key))
    return events.select("id", "ts", "agent", "project", "session_id", "kind", redact_json(F.col("features")).alias("features"), sealed(F.col("payload"), k).alias("payload"))


def session_events(log: DataFrame, session: str, since: str | None = None) -> DataFrame:
    """Events of a session after ``since`` in order; the filters reach the scan."""
    rows = log.where(F.col("session_id") == session)
    return (rows.where(F.col("ts") > since) if since else rows).orderBy("ts", "id")


def read_traces(spark: SparkSession, path: str, schema: str = TRACE) -> DataFrame:
    """JSON lines with a fixed schema; blank lines are skipped, bad lines are null rows in PERMISSIVE mode."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def vector_bytes(vector: Column) -> Column:
    """array<float> to little-endian f32 bytes."""
    return F.unhex(F.array_join(F.transform(vector, lambda x: _f32_hex(x)), ""))


def _f32_hex(x: Column) -> Column:
    """IEEE bits of a float, least significant byte first, built from sign, exponent and mantissa."""
    v = x.cast("double")
    a = F.abs(v)
    e = F.when(a > 0, F.floor(F.log2(a))).otherwise(F.lit(-127))
    e = F.greatest(F.when(a >= F.pow(F.lit(2.0), e + 1), e + 1).when((a > 0) & (a < F.pow(F.lit(2.0), e)), e - 1).otherwise(e), F.lit(-127))
    normal = F.round((a / F.pow(F.lit(2.0), e) - 1) * (1 << 23)).cast("bigint") + ((e + 127) * (1 << 23)).cast("bigint")
    tiny = F.round(a / F.pow(F.lit(2.0), F.lit(-149))).cast("bigint")
    bits = F.when(e <= -127, tiny).otherwise(normal) + F.when(v < 0, F.lit(1 << 31)).otherwise(F.lit(0))
    h = F.lpad(F.hex(bits), 8, "0")
    return F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))

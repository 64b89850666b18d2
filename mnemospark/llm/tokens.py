"""Token counts of texts under a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.plans.lineage import written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the vocabulary's published word pattern
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _counter(path: str):
    def run(frames):
        encode = encoder(path).encode_ordinary
        for f in frames:
            f["tokens"] = [len(encode(t)) if t else 0 for t in f.pop("text")]
            yield f

    return run


def sized(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens), one row per document, written.

    source without case and outer blanks; texts are counted where they are read and
    never shuffled; of repeated rows of a key the latest published counts; rows
    without a key are left out; null and blank texts have the tokens of their blanks.
    """
    rows = documents.where(F.col("doc_id").isNotNull()).select(
        "doc_id", F.lower(F.trim("source")).alias("source"), "published_at", F.when(F.trim("text") != "", F.col("text")).alias("text")
    )
    kinds = dict(rows.dtypes)
    counted = rows.mapInPandas(_counter(vocabulary), f"doc_id {kinds['doc_id']}, source string, published_at {kinds['published_at']}, tokens bigint")
    one = counted.groupBy("doc_id").agg(F.max(F.struct("published_at", "tokens", "source")).alias("x"))
    return written(one.select("doc_id", "x.source", "x.tokens"), "sizes")

"""Shards by a keyed permutation of global row numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.ranks import BUCKET_ROWS, spread_ranks
from helixframe.llm.words import mix
from helixframe.session import cut_lineage

ROUNDS = 4
SEED = 20240607


def _half_bits(n: int) -> int:
    return max(1, (max(1, n - 1).bit_length() + 1) // 2)


def _feistel(x: np.ndarray, half: int, seed: int, order) -> np.ndarray:
    """Balanced Feistel network over 2 * half bits; the reversed order of rounds inverts it."""
    low = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & low
    for i in order:
        key = np.uint64((seed * 0x9E3779B97F4A7C15 + i * 0xD1B54A32D192ED03) & ((1 << 64) - 1))
        left, right = right, left ^ (mix(right + key) & low)
    return (right << np.uint64(half)) | left  # halves swapped back: the same code inverts


def permute(numbers: np.ndarray, n: int, seed: int = SEED, inverse: bool = False) -> np.ndarray:
    """Permutation of 0..n-1. Values that leave the range are walked on along their cycle."""
    half = _half_bits(n)
    order = range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)
    out = _feistel(np.asarray(numbers, dtype=np.uint64), half, seed, order)
    outside = np.flatnonzero(out >= np.uint64(n))
    while outside.size:
        out[outside] = _feistel(out[outside], half, seed, order)
        outside = outside[out[outside] >= np.uint64(n)]
    return out.astype(np.int64)


def shuffle_shards(rows: DataFrame, shards: int, tie: list[str], seed: int = SEED) -> DataFrame:
    """Adds row_number, shard and slot: place p of the permuted order is shard p mod shards, slot
    p div shards, so shard sizes differ by one at most and slots have no gap.

    Row numbers follow the hash of `tie` (ties by its values), so shard and slot depend only on
    the rows and the seed, not on files or partitions, and `row_at` finds the row number of a
    shard's slot without a lookup. Rows equal in all of `tie` are interchangeable.
    """
    n = rows.count()
    buckets = F.lit(max(1, n // BUCKET_ROWS))
    numbered = spread_ranks(rows.withColumn("_all", F.lit(0)), ["_all"], tie, buckets, "row_number").drop("_all")

    @F.pandas_udf("long")
    def place(number: pd.Series) -> pd.Series:
        return pd.Series(permute(number.to_numpy(), n, seed))

    return (numbered.withColumn("_place", place("row_number"))
            .withColumn("shard", (F.col("_place") % shards).cast("int"))
            .withColumn("slot", F.floor(F.col("_place") / shards).cast("long")).drop("_place"))


def row_at(shard: int, slot: int, shards: int, n: int, seed: int = SEED) -> int:
    """Row number that stands at a slot of a shard."""
    return int(permute(np.array([slot * shards + shard]), n, seed, inverse=True)[0])


def text_facts(docs: DataFrame, text: Column, key: str = "doc_id") -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 8) and CRC-32 of each text; a null text has no bytes."""
    body = F.coalesce(text.cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col(key).alias("doc_id"), (F.octet_length(body) + 8).cast("long").alias("size"),
                       F.crc32(body).alias("text_crc32"))


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = SEED) -> DataFrame:
    """Shard table of documents: doc_id, size, text_crc32, row_number, shard, slot.

    Law `rows`: counts of shards differ by one at most. Texts are read once and do not move; the
    narrow table of facts is written, counted and numbered. Null ids, null and repeated texts
    are rows like any other; an empty table gives an empty result.
    """
    return shuffle_shards(cut_lineage(text_facts(docs, F.col("text"))), shards, ["doc_id", "text_crc32", "size"], seed)

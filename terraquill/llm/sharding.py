"""Jump consistent hashing: a stable key and the number of shards decide the shard, with no table of a ring.

Rows keep their shard when shards are appended, but for those (about 1 of n + 1) that the new shard takes. The loop of
the method runs on whole Arrow batches: rows that have not yet jumped past the last shard jump again.

Defined results: a null key is hashed as a value of its own; a null text has no bytes; repeated rows get the same shard
and slots of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraquill.llm.runtime import numbered, with_places

_STEP = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard, 0 to shards - 1, of each 64-bit key."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    key = keys.astype(np.uint64)
    at = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        k = key[live] * _STEP + np.uint64(1)
        key[live] = k
        to = ((at[live] + 1) * (float(1 << 31) / ((k >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
        on = to < shards
        live = live[on]
        at[live] = to[on]
    return at


def shard_of(key: Column, shards: int) -> Column:
    """An int column: the shard of any column that xxhash64 takes."""

    @F.pandas_udf("int")
    def dealt(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in parts:
            yield pd.Series(jump(x.to_numpy(np.int64, na_value=0).view(np.uint64), shards).astype(np.int32))

    return dealt(F.xxhash64(key))


def assign(df: DataFrame, key: str, shards: int) -> DataFrame:
    """df with `shard` (int) and `grown_shard` (int, with one shard more)."""
    return df.withColumn("shard", shard_of(F.col(key), shards)).withColumn("grown_shard", shard_of(F.col(key), shards + 1))


def slots(df: DataFrame, key: str) -> DataFrame:
    """df with `slot`: a long, gapless from 0 in each shard. Blocks of each shard are numbered in parallel."""
    df, rows = with_places(df)
    return numbered(df, ["shard"], [key], "slot", rows)


def write(df: DataFrame, key: str, shards: int, path: str) -> None:
    """Writes df below path, a folder for each shard; rows go straight from the scan to their shard's files."""
    df.withColumn("shard", shard_of(F.col(key), shards)).write.partitionBy("shard").parquet(path)


def shard_digest(documents: DataFrame, shards: int = 16) -> DataFrame:
    """One row per document: where it goes and what it weighs. Only ids, sizes and checksums are shuffled, never texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = slots(assign(rows, "doc_id", shards), "doc_id")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")

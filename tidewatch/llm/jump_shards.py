"""Sharding by jump consistent hashing.

A stable key jumps from shard to shard in growing steps until a step leaves the range;
the last landing is its shard. No ring table exists, a key's shard depends on the key
and the number of shards alone, and with one more shard a key stays or moves into the
new one. Keys are hashed in the JVM and jump as numpy vectors. Slots within a shard come
from hash buckets numbered apart (`gapless`), so a shard is no single task; texts stay
where they are read, only their size and checksum travel.

Defined cases: a null key has the hash of null, so all null keys share a shard; a null
text has size 1 and the checksum of no bytes; repeated rows share a shard and have slots
of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import gapless, stored, table, told_apart

SHARDS = 16


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key."""
    if shards < 1:
        raise ValueError("at least one shard")
    key = keys.astype(np.uint64)
    last, ahead = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    going = np.arange(len(key))
    with np.errstate(over="ignore"):
        while len(going):
            last[going] = ahead[going]
            key[going] = key[going] * np.uint64(2862933555777941757) + np.uint64(1)
            draw = (key[going] >> np.uint64(33)).astype(np.float64) + 1.0
            ahead[going] = ((last[going] + 1) * (float(1 << 31) / draw)).astype(np.int64)
            going = going[ahead[going] < shards]
    return last


def shard_of(key: Column, shards: int) -> Column:
    """Column form: `key` may have any type."""

    @F.pandas_udf("int")
    def jumped(hashes: pd.Series) -> pd.Series:
        return pd.Series(jump(hashes.to_numpy(np.int64).view(np.uint64), shards), dtype="int32")

    return jumped(F.xxhash64(key))


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Shard, slot and, with one more shard, the shard of every row of `docs` (doc_id, text)."""
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       (F.octet_length(raw).cast("long") + 1).alias("size"), F.crc32(raw).alias("text_crc32"))
    placed = stored(told_apart(slim.withColumns({"law": F.lit("key"), "shard": shard_of(F.col("doc_id"), shards),
                                                 "grown_shard": shard_of(F.col("doc_id"), shards + 1)})), "shards")
    return gapless(placed, ["shard"], ["doc_id", "row_no"], "slot").select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op7_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards by their id."""
    return assign(table(spark, sf_dir, "documents"))


QUERIES = {"op7_jump_shards": op7_jump_shards}

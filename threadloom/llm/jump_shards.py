"""Shards by jump consistent hashing (Lamping and Veach, 2014).

A key's shard follows from the key and the number of shards alone, without a ring table; with one
shard more, a row either stays or moves into the new shard, and only the necessary fraction moves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.llm.workdir import Scratch, buckets_for, columns_or_null


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key; all keys jump together until each has jumped past the end."""
    state, shard = keys.astype(np.int64).view(np.uint64).copy(), np.zeros(len(keys), np.int64)
    left, at = np.arange(len(keys)), np.zeros(len(keys), np.int64)
    while len(left):
        shard[left] = at
        state[left] = state[left] * np.uint64(2862933555777941757) + np.uint64(1)
        at = ((at + 1) * (2.0**31 / ((state[left] >> np.uint64(33)) + 1.0))).astype(np.int64)
        inside = at < shards
        left, at = left[inside], at[inside]
    return shard


def shard_of(shards: int):
    """A column function: the shard of a long key; a null key counts as 0."""

    @F.pandas_udf("int")
    def run(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.fillna(0).to_numpy(), shards).astype(np.int32))

    return run


def assign(spark: SparkSession, docs: DataFrame, shards: int = 8, per_bucket: int = 100_000) -> DataFrame:
    """Shard and slot of every row of docs (doc_id, text), under the law `key`.

    Returns doc_id, size (UTF-8 bytes of the text, null: none, plus 1), text_crc32, law, shard, slot
    (gapless from 0 in each shard), grown_shard (with one shard more). A null doc_id counts as key 0;
    rows that repeat have the same shard and slots of their own. Further columns are left behind. Slots
    are counted within hash buckets of about per_bucket rows, which then get their offsets, so that no
    task ever holds a shard.
    """
    scratch = Scratch(spark, "shards")
    docs = columns_or_null(docs, doc_id="long", text="string")
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    rows = rows.select("*", shard_of(shards)("doc_id").alias("shard"), shard_of(shards + 1)("doc_id").alias("grown_shard"), F.monotonically_increasing_id().alias("place"))
    rows = scratch.table(rows)  # from here on a row's place is fixed
    buckets = buckets_for(rows.count() // shards, per_bucket)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "place"), F.lit(buckets)))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "place")) - 1
    slotted = rows.withColumn("slot", within.cast("long")).join(offsets, ["shard", "bucket"])
    return slotted.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("slot") + F.col("ahead")).alias("slot"), "grown_shard")

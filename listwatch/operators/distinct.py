"""Exact distinct counts that merge (A4): bitmaps of integer keys.

A key is one bit; the bits of ``bitmap_bucket_number`` are one bitmap of 4 KB.
Bitmaps are built with partial aggregation before the shuffle, so a run sends
one row per bucket and task however often a key occurs, and bitmaps of several
runs are merged by OR without going back to the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_bitmaps(rows: DataFrame, key: Column, groups: list[Column]) -> DataFrame:
    """(groups..., bucket, bits): the integer keys of each group; a NULL key is none."""
    return (rows.select(*groups, key.alias("_key")).filter(F.col("_key").isNotNull())
            .groupBy(*[F.col(c) for c in rows.select(*groups).columns], F.bitmap_bucket_number("_key").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_key")).alias("bits")))


def count_keys(bitmaps: DataFrame, groups: list[str], out: str) -> DataFrame:
    """(groups..., out): the number of distinct keys, over all the bitmaps of a group."""
    merged = bitmaps.groupBy(*groups, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return merged.groupBy(*groups).agg(F.sum(F.bitmap_count("bits")).cast("bigint").alias(out))

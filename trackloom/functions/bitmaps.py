"""Bitmaps of row numbers, kept as one binary block per 32,768 numbers.

A bitmap is a table ``(keys..., bucket, bitmap)``, so one of any size is spread
over the cluster, and AND / OR are joins of blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _dealt(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows by the key of their block, in as many tasks as the session has shuffle partitions.

    A block of few numbers is small when it is written and 4 KB when it is sorted, so
    partitions must not be joined by the size written.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *on)


def build(df: DataFrame, number: str, keys: Sequence[str] = ()) -> DataFrame:
    """Collect non-negative whole numbers into blocks.

    Distinct positions are shuffled and no blocks: a block is made where its key lies.
    """
    n, on = F.col(number), [*keys, "bucket"]
    positions = df.select(
        *keys, F.bitmap_bucket_number(n).alias("bucket"), F.bitmap_bit_position(n).alias("_position")).distinct()
    return _dealt(positions, on).groupBy(*on).agg(F.bitmap_construct_agg("_position").alias("bitmap"))


def union(a: DataFrame, b: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    on = [*keys, "bucket"]
    return _dealt(a.select(*on, "bitmap").unionByName(b.select(*on, "bitmap")), on).groupBy(*on).agg(
        F.bitmap_or_agg("bitmap").alias("bitmap"))


def intersection(a: DataFrame, b: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Blocks present on both sides, bits set on both sides."""
    on = [*keys, "bucket"]
    both = a.select(*on, F.col("bitmap")).unionByName(b.select(*on, F.col("bitmap")))
    met = _dealt(both, on).groupBy(*on).agg(
        F.count(F.lit(1)).alias("_sides"), F.bitmap_and_agg("bitmap").alias("bitmap"))
    return met.filter(F.col("_sides") == 2).drop("_sides")


def is_empty(bitmap: str = "bitmap"):
    return F.bitmap_count(bitmap) == 0


def cardinality(blocks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return blocks.groupBy(*keys).agg(F.sum(F.bitmap_count("bitmap")).alias("cardinality"))

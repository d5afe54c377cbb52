"""Sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions.hashing import bucket_of, hashable
from trackloom.sources.files import listed_files, table_bytes


def bucket_sample(df: DataFrame, x: int, y: int, *on: Column | str) -> DataFrame:
    """Bucket ``x`` out of ``y`` (counted from 1) by the hash of columns or expressions of any type.

    The same rows come back every time. Without columns the whole row counts.
    """
    if not 1 <= x <= y:
        raise ValueError("the bucket number must lie between 1 and the number of buckets")
    if on:
        return df.filter(bucket_of(df, y, *on) == x - 1)
    return df.filter(F.pmod(F.xxhash64(*hashable(df)), F.lit(y)) == x - 1)


def percent_sample(df: DataFrame, percent: float, seed: int = 0) -> DataFrame:
    return df.sample(fraction=percent / 100.0, seed=seed)


def row_sample(df: DataFrame, rows: int) -> DataFrame:
    """The first ``rows`` rows of every input split."""
    # Numbers from 0 inside a partition: the upper bits are the partition number.
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return df.withColumn("_at", inside).filter(F.col("_at") < rows).drop("_at")


def size_sample(df: DataFrame, size: str, seed: int = 0) -> DataFrame:
    """About ``size`` (such as ``10M``) of a table read from files."""
    units = {"B": 1, "K": 1 << 10, "M": 1 << 20, "G": 1 << 30}
    wanted = int(size[:-1]) * units[size[-1].upper()]
    total = table_bytes(df)
    return df.sample(fraction=min(1.0, wanted / max(total, 1)), seed=seed)


def block_sample(spark: SparkSession, path: str, percent: float, seed: int = 0, format: str = "parquet") -> DataFrame:
    """Whole files of a table, drawn by ``seed`` until they hold ``percent`` of its bytes.

    Files are drawn from the listing, so the others are never opened. The same seed draws
    the same files. At least one file comes unless the table has none or nothing is asked for.
    """
    table = spark.read.format(format).load(path)
    wanted = listed_files(table).agg(F.sum("length")).first()[0] or 0
    wanted *= percent / 100
    chosen, held = [], 0
    drawn = listed_files(table).select("path", "length").orderBy(F.xxhash64("path", F.lit(seed)), "path")
    for file in drawn.toLocalIterator():
        if held >= wanted:
            break
        chosen.append(file["path"])
        held += file["length"]
    if not chosen:
        return table.limit(0)
    return spark.read.format(format).schema(table.schema).option("basePath", path).load(chosen)


def limit_at_least(df: DataFrame, rows: int, least: int) -> DataFrame:
    """The first ``rows`` rows; the query fails when the table has fewer than ``least``.

    The check reads ``least`` rows at most and runs as a scalar subquery before the result does.
    """
    short = F.raise_error(F.lit(f"fewer than {least} rows"))
    enough = df.limit(least).agg(F.when(F.count(F.lit(1)) < least, short).otherwise(F.lit(True)).alias("enough"))
    return df.limit(rows).filter(enough.scalar())

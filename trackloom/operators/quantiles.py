"""Exact percentiles without holding a group in memory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.operators.ordered import BY, running_folds, with_key


def percentiles(
    df: DataFrame, keys: Sequence[str], value: str, fractions: Sequence[float]
) -> DataFrame:
    """``percentiles`` array per key, linearly interpolated between ranks.

    Values of any numeric type are counted map-side, the counts are summed in range
    tiles of the distinct values, and each rank is the smallest value whose running count
    exceeds it. A key whose values are all NULL has a NULL array.
    """
    keys = list(keys)
    keyed = with_key(df, keys)
    counted = keyed.filter(F.col(value).isNotNull()).groupBy(
        BY, F.col(value).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_folds(counted.withColumnRenamed(BY, "_key"), ["_key"], ["_value"],
                           {"_upto": ("sum", F.col("_n"))})
    totals = counted.groupBy(F.col(BY).alias("_key")).agg(F.sum("_n").alias("_total"))
    placed = ranked.join(totals, "_key")

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("_upto") > rank, F.col("_value")))

    spots = [F.lit(float(f)) * (F.col("_total") - 1) for f in fractions]
    picked = placed.groupBy("_key").agg(
        F.max("_total").alias("_total"),
        *[at(F.floor(s)).alias(f"_lo{i}") for i, s in enumerate(spots)],
        *[at(F.ceil(s)).alias(f"_hi{i}") for i, s in enumerate(spots)])
    found = F.when(F.col("_total").isNotNull(), F.array(*[
        F.col(f"_lo{i}") + (s - F.floor(s)) * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))
        for i, s in enumerate(spots)]))
    every = keyed.select(F.col(BY).alias("_key")).distinct()
    return every.join(picked, "_key", "left").select(
        *[F.col(f"_key.{k}").alias(k) for k in keys], found.alias("percentiles"))

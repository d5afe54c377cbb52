"""Statistics as states that can be stored, and merged without reading their rows again.

A state is an ordinary row with a sketch column, so it can be kept per partition of a
table: a new partition costs one read of itself, and statistics of the whole table are a
merge of one row per partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.text_stats import sequences

# Joins the words of a sequence to one item; no word holds it.
JOIN = "\x01"


def stats_state(df: DataFrame, column: str, keys: Sequence[str] = (), precision: int = 12) -> DataFrame:
    """One state per key: rows, nulls, least and largest value, and a sketch of distinct values.

    The sketch has ``2 ** precision`` registers, a standard error of about ``1.04 /
    sqrt(2 ** precision)``. Values of any type that has an order; no rows without keys
    give one state of no rows.
    """
    c = F.col(column)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(c.isNull()).alias("nulls"), F.min(c).alias("least"),
        F.max(c).alias("largest"), F.hll_sketch_agg(
            F.when(c.isNotNull(), F.xxhash64(c)), F.lit(precision)).alias("sketch"))


def merged_stats(states: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Statistics per key of all rows behind the states, with the estimated ``ndv``."""
    merged = states.groupBy(*keys).agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.min("least").alias("least"),
        F.max("largest").alias("largest"), F.hll_union_agg("sketch", F.lit(True)).alias("sketch"))
    return merged.withColumn("ndv", F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0))).drop("sketch")


def ngram_state(df: DataFrame, sentences: str, n: int, keys: Sequence[str] = (), tracked: int = 10_000) -> DataFrame:
    """One state per key: counters of frequent n-grams, ``tracked`` at most, and the number of n-grams."""
    found = sequences(df, sentences, n, keys).select(*keys, F.array_join("ngram", JOIN).alias("_item"))
    return found.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("ngrams"), F.expr(f"approx_top_k_accumulate(_item, {tracked})").alias("counters"))


def merged_ngrams(states: DataFrame, k: int, tracked: int = 10_000) -> DataFrame:
    """The k most frequent n-grams behind the states: ``ngram, estfrequency, least``.

    The true count lies between ``least`` and ``estfrequency``: counters never miss an
    occurrence, and exceed the truth by at most 3.5 / (size of the table of counters) of all
    n-grams. Every n-gram that is more frequent than that is among the counters.
    """
    slots = 1
    while slots * 0.75 < tracked:
        slots *= 2
    error: Column = F.ceil(F.lit(3.5 / slots) * F.col("ngrams"))
    merged = states.agg(
        F.sum("ngrams").alias("ngrams"), F.expr(f"approx_top_k_combine(counters, {tracked})").alias("counters"))
    top = merged.select("ngrams", F.explode(F.expr(f"approx_top_k_estimate(counters, {k})")).alias("top"))
    return top.select(
        F.split("top.item", JOIN).alias("ngram"), F.col("top.count").alias("estfrequency"),
        F.greatest(F.lit(1), F.col("top.count") - error).alias("least"))

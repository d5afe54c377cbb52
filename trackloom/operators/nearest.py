"""Nearest intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators.intervals import CHR, END, BEGIN, distance, literal, side
from trackloom.operators.overlap import _prefixed, overlap_join
from trackloom.operators.scans import running, solid


def closest_to(df: DataFrame, chr: str, start: int, end: int) -> DataFrame:
    """The rows at the smallest distance to one given interval; ties are all kept.

    The smallest distance is an aggregate, so there is no global sort.
    """
    measured = df.filter(F.col(CHR) == chr).withColumn(
        "distance", distance(side(), literal(chr, start, end)))
    smallest = measured.agg(F.min("distance").alias("d")).scalar()
    return measured.filter(F.col("distance") == smallest)


def pair_closest(a: DataFrame, b: DataFrame) -> DataFrame:
    """For every interval of ``a`` the nearest of ``b`` on its chromosome, ties kept.

    Overlapping pairs are at distance 0. An interval that overlaps nothing has
    its neighbours at the last end before it or the first start after it, found
    by one scan each way, and picked up again with an equi-join.
    """
    before = running(
        _events(b, END, a, BEGIN), "_at",
        {"_end": ("max", F.when(F.col("_b") > 0, F.col("_at"))), "_ended": ("sum", F.col("_b"))},
    ).filter(F.col("_a")).select(CHR, F.col("_at").alias("a_" + BEGIN), "_end", "_ended")
    after = running(
        _events(b, BEGIN, a, END), "_at",
        {"_start": ("min", F.when(F.col("_b") > 0, F.col("_at"))), "_open": ("sum", F.col("_b"))},
        backward=True,
    ).filter(F.col("_a")).select(CHR, F.col("_at").alias("a_" + END), "_start", "_open")
    counts = b.groupBy(CHR).agg(F.count(F.lit(1)).alias("_total"))

    left = _prefixed(a, "a_")
    placed = left.join(before, [CHR, "a_" + BEGIN]).join(after, [CHR, "a_" + END]).join(counts, CHR)
    # b's that neither end before the interval nor start after it overlap it.
    alone = placed.filter(F.col("_ended") + F.col("_open") == F.col("_total"))
    back = F.col("a_" + BEGIN) - F.col("_end")
    ahead = F.col("_start") - F.col("a_" + END)
    nearest = alone.withColumn("distance", F.least(back, ahead)).withColumn("_at", F.explode(F.array(
        F.when(back == F.col("distance"), F.struct(F.lit("end").alias("side"), F.col("_end").alias("at"))),
        F.when(ahead == F.col("distance"), F.struct(F.lit("start").alias("side"), F.col("_start").alias("at"))),
    ))).filter(F.col("_at").isNotNull()).select(*left.columns, "distance", "_at")
    right = _prefixed(b, "b_").withColumn("_at", F.explode(F.array(
        F.struct(F.lit("end").alias("side"), F.col("b_" + END).alias("at")),
        F.struct(F.lit("start").alias("side"), F.col("b_" + BEGIN).alias("at")))))
    apart = nearest.join(right, [CHR, "_at"]).drop("_at")
    touching = overlap_join(a, b).withColumn("distance", F.lit(0).cast("bigint"))
    return touching.unionByName(apart)


def _events(b: DataFrame, b_column: str, a: DataFrame, a_column: str) -> DataFrame:
    """One row per position: how many of b are there, and whether an a is."""
    marks = b.select(CHR, F.col(b_column).alias("_at"), F.lit(1).alias("_b"), F.lit(False).alias("_a"))
    asks = a.select(CHR, F.col(a_column).alias("_at"), F.lit(0).alias("_b"), F.lit(True).alias("_a"))
    return solid(marks.unionByName(asks)).groupBy(CHR, "_at").agg(
        F.sum("_b").alias("_b"), F.max("_a").alias("_a"))

"""Interval files: BED, narrow peaks, annotations and chromosome sizes.

BED-like files count from 0 and leave the end out; tracks count from 1 and
include it. So ``chrstart = start + 1`` and ``chrend = end``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.operators.intervals import CHR, KEY, VALUE

_PEAK = ("name string, score int, strand string, signal double, p double, q double, peak int")
_ANNOTATION = ("chr string, source string, feature string, chrstart bigint, chrend bigint, "
               "score string, strand string, frame string, attributes string")


def _lines(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("comment", "#").option("quote", "").csv(path)


def read_bed(spark: SparkSession, path: str | Sequence[str], more: str = "value double") -> DataFrame:
    """Tab-separated ``chr, start, end`` and the columns of ``more``."""
    extra = f", {more}" if more else ""
    raw = _lines(spark, path, f"chr string, _from bigint, chrend bigint{extra}")
    rest = [c for c in raw.columns if c not in ("chr", "_from", "chrend")]
    return raw.select(CHR, (F.col("_from") + 1).alias("chrstart"), "chrend", *rest)


def read_narrow_peaks(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Peaks with their signal as the track value, the other columns as metadata."""
    peaks = read_bed(spark, path, _PEAK)
    return peaks.withColumnRenamed("signal", VALUE)


def read_annotation(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Gene annotation lines, which count from 1 already; ``attributes`` stays text."""
    return _lines(spark, path, _ANNOTATION)


def read_chromosome_sizes(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path, "chr string, len bigint")


def write_bed(df: DataFrame, path: str, mode: str = "error") -> None:
    rest = [c for c in df.columns if c not in KEY]
    df.select(CHR, (F.col("chrstart") - 1).alias("_from"), "chrend", *rest).write.mode(mode).option(
        "sep", "\t").csv(path)

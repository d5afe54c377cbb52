"""The track model: ``(chr, chrstart, chrend[, value, metadata...])``.

Coordinates are 1-based and closed on both ends, so an interval of one base has
``chrstart = chrend`` and length 1.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHR, BEGIN, END, VALUE = "chr", "chrstart", "chrend", "value"
KEY = (CHR, BEGIN, END)

# Chromosome lengths of the hg19 assembly, and two short
# chromosomes for tests.
CHROMOSOME_LENGTHS = {
    "chr1": 249250621, "chr2": 243199373, "chr3": 198022430, "chr4": 191154276,
    "chr5": 180915260, "chr6": 171115067, "chr7": 159138663, "chr8": 146364022,
    "chr9": 141213431, "chr10": 135534747, "chr11": 135006516, "chr12": 133851895,
    "chr13": 115169878, "chr14": 107349540, "chr15": 102531392, "chr16": 90354753,
    "chr17": 81195210, "chr18": 78077248, "chr19": 59128983, "chr20": 63025520,
    "chr21": 48129895, "chr22": 51304566, "chrX": 155270560, "chrY": 59373566,
    "chrM": 16571, "chrS": 355, "chrT": 533,
}


class Interval(NamedTuple):
    """One side of a location predicate, as columns."""

    chr: Column
    start: Column
    end: Column


def track(
    df: DataFrame,
    chr: str | Column = CHR,
    start: str | Column = BEGIN,
    end: str | Column = END,
    value: str | Column | None = None,
    metadata: Sequence[str] = (),
) -> DataFrame:
    """Select the track columns out of any table."""

    def col(c):
        return F.col(c) if isinstance(c, str) else c

    cols = [col(chr).alias(CHR), col(start).cast("bigint").alias(BEGIN),
            col(end).cast("bigint").alias(END)]
    if value is not None:
        cols.append(col(value).cast("double").alias(VALUE))
    return df.select(*cols, *metadata)


def chromosome_sizes(spark: SparkSession, sizes: dict[str, int] | None = None) -> DataFrame:
    """``(chr, len)`` for a genome; hg19 unless told otherwise."""
    rows = sorted((sizes or CHROMOSOME_LENGTHS).items())
    return spark.createDataFrame(rows, f"{CHR} string, len bigint")


def sizes_of(*tracks: DataFrame) -> DataFrame:
    """``(chr, len)`` taken from the data: the largest end on each chromosome."""
    ends = [t.select(CHR, END) for t in tracks]
    both = ends[0]
    for other in ends[1:]:
        both = both.unionByName(other)
    return both.groupBy(CHR).agg(F.max(END).alias("len"))


def side(prefix: str = "") -> Interval:
    """The interval made of columns ``<prefix>chr``, ``<prefix>chrstart``, ..."""
    return Interval(*(F.col(prefix + c) for c in KEY))


def literal(chr: str, start: int, end: int) -> Interval:
    return Interval(F.lit(chr), F.lit(start).cast("bigint"), F.lit(end).cast("bigint"))


def length(a: Interval | None = None) -> Column:
    a = a or side()
    return a.end - a.start + F.lit(1)


def distance(a: Interval, b: Interval) -> Column:
    """0 when the intervals overlap, else the gap; adjacent intervals are at 1."""
    gap = F.greatest(F.lit(0), b.start - a.end, a.start - b.end)
    return F.when(a.chr == b.chr, gap)


def overlap_length(a: Interval, b: Interval) -> Column:
    return F.least(a.end, b.end) - F.greatest(a.start, b.start) + F.lit(1)


# Location predicates on two intervals of the same chromosome.
LOCATION: dict[str, Callable[[Interval, Interval], Column]] = {
    "overlaps": lambda a, b: (a.start <= b.end) & (a.end >= b.start),
    "contains": lambda a, b: (a.start <= b.start) & (a.end >= b.end),
    "within": lambda a, b: (b.start <= a.start) & (b.end >= a.end),
    "coincides": lambda a, b: (a.start == b.start) & (a.end == b.end),
    "adjacent": lambda a, b: (a.end + 1 == b.start) | (a.start - 1 == b.end),
    "precedes": lambda a, b: a.end < b.start,
    "follows": lambda a, b: a.start > b.end,
    "prefix": lambda a, b: (a.start == b.start) & (a.end <= b.end),
    "suffix": lambda a, b: (a.end == b.end) & (a.start >= b.start),
}


def located(name: str, a: Interval, b: Interval) -> Column:
    """``a <name> b`` as a boolean column; FALSE on different chromosomes."""
    return (a.chr == b.chr) & LOCATION[name](a, b)


def filter_location(df: DataFrame, name: str, chr: str, start: int, end: int) -> DataFrame:
    """Rows of a track that stand in a location relation to a constant interval.

    The predicate is plain comparisons, so it is pushed into the scan.
    """
    return df.filter(located(name, side(), literal(chr, start, end)))


def with_interval(df: DataFrame) -> DataFrame:
    """Add the interval as one struct column, ``interval``, with every column of the row."""
    return df.withColumn("interval", F.struct(*df.columns))


# The same predicates as SQL expressions over two interval structs.
_SQL_LOCATION = {
    "overlaps_with": "a.chrstart <= b.chrend AND a.chrend >= b.chrstart",
    "contains_interval": "a.chrstart <= b.chrstart AND a.chrend >= b.chrend",
    "lies_within": "b.chrstart <= a.chrstart AND b.chrend >= a.chrend",
    "coincides_with": "a.chrstart = b.chrstart AND a.chrend = b.chrend",
    "adjacent_to": "a.chrend + 1 = b.chrstart OR a.chrstart - 1 = b.chrend",
    "precedes": "a.chrend < b.chrstart",
    "follows": "a.chrstart > b.chrend",
    "prefix_of": "a.chrstart = b.chrstart AND a.chrend <= b.chrend",
    "suffix_of": "a.chrend = b.chrend AND a.chrstart >= b.chrstart",
}


def register_sql_functions(spark: SparkSession) -> None:
    """Location predicates, length and distance for use in SQL text.

    They take structs ``(chr, chrstart, chrend)`` and are expanded into the
    query, so comparisons with constants reach the scan. To join two large
    tracks use ``overlap.overlap_join``, as SQL would compare all pairs of a
    chromosome.
    """
    kind = "STRUCT<chr: STRING, chrstart: BIGINT, chrend: BIGINT>"
    for name, test in _SQL_LOCATION.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a {kind}, b {kind}) "
                  f"RETURN a.chr = b.chr AND ({test})")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION interval_length(a {kind}) RETURN a.chrend - a.chrstart + 1")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION interval_distance(a {kind}, b {kind}) RETURN "
              "CASE WHEN a.chr = b.chr THEN greatest(0, b.chrstart - a.chrend, a.chrstart - b.chrend) END")

"""Aggregate functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stddev(c: Column | str) -> Column:
    """Population standard deviation, also known as ``std`` and ``stddev_pop``."""
    return F.stddev_pop(_col(c))


def variance(c: Column | str) -> Column:
    """Population variance, also known as ``var_pop``."""
    return F.var_pop(_col(c))


def stddev_samp(c: Column | str) -> Column:
    """Sample standard deviation; 0 for a single value."""
    c = _col(c)
    return F.when(F.count(c) == 1, F.lit(0.0)).otherwise(F.stddev_samp(c))


def var_samp(c: Column | str) -> Column:
    """Sample variance; 0 for a single value."""
    c = _col(c)
    return F.when(F.count(c) == 1, F.lit(0.0)).otherwise(F.var_samp(c))


def percentile(c: Column | str, fraction: float | list[float]) -> Column:
    """Exact percentile with linear interpolation; counts distinct values map-side."""
    return F.percentile(_col(c), fraction)


def collect_set_sorted(c: Column | str) -> Column:
    return F.sort_array(F.collect_set(_col(c)))


def group_concat(c: Column | str, separator: str = ",") -> Column:
    """Values joined in ascending order, so that the result is repeatable."""
    return F.array_join(F.sort_array(F.collect_list(_col(c))), separator)


def top_n(df: DataFrame, keys: list[str], value: str, n: int, largest: bool = True) -> DataFrame:
    """The n largest (or smallest) values per key as a sorted array.

    Ranked before being collected: Spark cuts each group to n rows on the map
    side, so a hot key never becomes a long array.
    """
    from pyspark.sql import Window

    order = F.col(value).desc() if largest else F.col(value).asc()
    ranked = df.filter(F.col(value).isNotNull()).select(
        *keys, value, F.row_number().over(Window.partitionBy(*keys).orderBy(order)).alias("_n"))
    return ranked.filter(F.col("_n") <= n).groupBy(*keys).agg(
        F.sort_array(F.collect_list(value), asc=not largest).alias("top"))


def compute_stats(df: DataFrame, column: str, keys: tuple[str, ...] = (), exact: bool = False) -> DataFrame:
    """Column statistics as one struct ``stats`` whose fields depend on the type.

    The number of distinct values is estimated unless ``exact``.
    """
    kind = df.schema[column].dataType.typeName()
    c = F.col(column)
    nulls = F.count_if(c.isNull()).alias("countnulls")
    distinct = (F.count_distinct(c) if exact else F.approx_count_distinct(c)).alias("numdistinctvalues")
    lengths = F.length(c)
    if kind == "boolean":
        fields = [F.lit("Boolean").alias("columntype"), F.count_if(c).alias("counttrues"),
                  F.count_if(~c).alias("countfalses"), nulls]
    elif kind in ("byte", "short", "integer", "long"):
        fields = [F.lit("Long").alias("columntype"), F.min(c).alias("min"), F.max(c).alias("max"),
                  nulls, distinct]
    elif kind in ("float", "double", "decimal"):
        fields = [F.lit("Double").alias("columntype"), F.min(c).alias("min"), F.max(c).alias("max"),
                  nulls, distinct]
    elif kind == "string":
        fields = [F.lit("String").alias("columntype"), F.max(lengths).alias("maxlength"),
                  F.avg(lengths).alias("avglength"), nulls, distinct]
    elif kind == "binary":
        fields = [F.lit("Binary").alias("columntype"), F.max(lengths).alias("maxlength"),
                  F.avg(lengths).alias("avglength"), nulls]
    else:
        raise ValueError(f"no statistics for {kind} columns")
    return df.groupBy(*keys).agg(F.struct(*fields).alias("stats"))

"""Ordered scans along a chromosome that do not put a chromosome in one task.

There are only about 25 chromosomes, so a window partitioned by chromosome
would be a handful of huge tasks. Instead the line is cut into tiles of
``2 ** TILE_BITS`` positions. Input rows are unique per ``(chr, position)``
(callers aggregate first, with map-side combine), so a tile holds at most that
many rows whatever the skew. A window runs inside each tile, one summary row per
tile is scanned per chromosome (at most 32,768 rows for 31-bit coordinates) and
the carry is joined back on ``(chr, tile)``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.hashing import hashable
from trackloom.operators.intervals import CHR

TILE_BITS = 16
TILE = "_tile"


def tile_of(position: Column) -> Column:
    # Never NULL, so that a join on it adds no filter to one branch only.
    return F.coalesce(F.shiftright(position, TILE_BITS), F.lit(0))


def solid(df: DataFrame) -> DataFrame:
    """Rows with a chromosome, the column being known not to be NULL.

    The scans read their aggregated input twice, row by row and per tile. Spark
    computes it once when both branches have the same plan, which a NULL filter
    pushed into one of them would prevent.
    """
    return df.filter(F.col(CHR).isNotNull()).withColumn(CHR, F.coalesce(F.col(CHR), F.lit("")))


def whole_row(df: DataFrame) -> Column:
    """An aggregate over all columns, to keep them in the per-tile branch (see ``solid``)."""
    return F.max(F.xxhash64(*hashable(df)))


def _combine_sum(inner: Column, carry: Column) -> Column:
    return F.coalesce(inner, F.lit(0)) + F.coalesce(carry, F.lit(0))


FOLDS: dict[str, tuple[Callable, Callable]] = {
    "sum": (F.sum, _combine_sum),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
}


def ordering(name: str, backward: bool = False) -> Column:
    """Order by a column; a name after ``-`` is descending."""
    column = F.col(name.removeprefix("-"))
    return column.desc() if name.startswith("-") != backward else column.asc()


def scan(
    tiled: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    outputs: dict[str, tuple[str, Column]],
    backward: bool = False,
    inclusive: bool = False,
    keep_tile: bool = False,
) -> DataFrame:
    """Running folds over rows that carry a ``_tile`` number rising with the order.

    ``outputs[name] = (fold, input)``. Without ``inclusive`` a row sees the rows
    before it, or after it when ``backward``.
    """
    columns = [c for c in tiled.columns if keep_tile or c != TILE]
    by = list(by)
    marked = tiled.withColumns({f"_v_{n}": value for n, (_, value) in outputs.items()})

    def directed(c: str) -> Column:
        return ordering(c, backward)

    inside = Window.partitionBy(TILE, *by).orderBy(*[directed(c) for c in order]).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    before = Window.partitionBy(*by).orderBy(directed(TILE)).rowsBetween(
        Window.unboundedPreceding, -1)
    rows = marked.withColumns({
        f"_i_{n}": FOLDS[fold][0](F.col(f"_v_{n}")).over(inside)
        for n, (fold, _) in outputs.items()})
    tiles = marked.groupBy(*by, TILE).agg(*[
        FOLDS[fold][0](F.col(f"_v_{n}")).alias(f"_s_{n}") for n, (fold, _) in outputs.items()],
        whole_row(tiled).alias("_seen")).filter(F.col("_seen").isNotNull())
    carries = tiles.select(*by, TILE, *[
        FOLDS[fold][0](F.col(f"_s_{n}")).over(before).alias(f"_c_{n}")
        for n, (fold, _) in outputs.items()])
    return rows.join(carries, [TILE, *by]).select(*columns, *[
        FOLDS[fold][1](F.col(f"_i_{n}"), F.col(f"_c_{n}")).alias(n)
        for n, (fold, _) in outputs.items()])


def running(
    df: DataFrame,
    position: str,
    outputs: dict[str, tuple[str, Column]],
    backward: bool = False,
    inclusive: bool = False,
    by: Sequence[str] = (CHR,),
) -> DataFrame:
    """:func:`scan` over whole-number positions, ``df`` being unique per (by, position)."""
    tiled = df.withColumn(TILE, tile_of(F.col(position)))
    return scan(tiled, by, [position], outputs, backward, inclusive)


def following(df: DataFrame, position: str, output: str) -> DataFrame:
    """Add the next larger position on the same chromosome (NULL on the last row)."""
    tiled = df.withColumn(TILE, tile_of(F.col(position)))
    inside = Window.partitionBy(TILE, CHR).orderBy(position)
    rows = tiled.withColumn("_inner", F.lead(position).over(inside))
    heads = tiled.groupBy(CHR, TILE).agg(F.min(position).alias("_head"))
    carries = heads.select(
        CHR, TILE, F.lead("_head").over(Window.partitionBy(CHR).orderBy(TILE)).alias("_carry"))
    return rows.join(carries, [TILE, CHR]).select(
        *df.columns, F.coalesce("_inner", "_carry").alias(output))

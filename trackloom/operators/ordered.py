"""Window functions for partitions too large for one task.

``Window.partitionBy(k)`` sends every row of a key to one task. Here rows are
range-partitioned by key and order, so a hot key fills several partitions. The
partition number becomes the tile of the two-level scan in ``scans``: work in
each tile, then carry one row per (key, tile). The tiles are cut by sampling,
so the partitioned rows are checkpointed once to the shared folder and every
later read, also after the loss of an executor, sees the same cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators.scans import FOLDS, TILE, ordering, scan
from trackloom.session import checkpoint_folder


# The key columns as one struct. It is never NULL and structs with equal NULL
# fields are equal, so rows with a NULL key form a partition like any other.
BY = "_by"


def with_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumn(BY, F.struct(*keys) if keys else F.struct(F.lit(0)))


def cut_in_tiles(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows with a ``_tile`` number that rises with (keys, order); ``-name`` is descending."""
    spark = df.sparkSession
    checkpoint_folder(spark)
    tiles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(tiles, *keys, *[ordering(c) for c in order])
    return ranged.withColumn(TILE, F.spark_partition_id()).checkpoint()


def _attach(df: DataFrame, other: DataFrame, on: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Columns ``names`` of the row of ``other`` with equal values, NULLs being equal too."""
    renamed = other.select(*[F.col(c).alias(f"_on_{c}") for c in on], *names)
    same = [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on]
    return df.join(renamed, same, "left").select(*df.columns, *names)


def running_folds(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    outputs: dict[str, tuple[str, Column]],
) -> DataFrame:
    """Folds over ``ROWS UNBOUNDED PRECEDING .. CURRENT ROW``; ``order`` must be total."""
    tiled = with_key(cut_in_tiles(df, keys, order), keys)
    return scan(tiled, [BY], order, outputs, inclusive=True).drop(BY)


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "row_number") -> DataFrame:
    return running_folds(df, keys, order, {name: ("sum", F.lit(1))})


def ranks(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Add ``rank``, ``dense_rank``, ``percent_rank`` and ``cume_dist``.

    Ties are counted map-side first, so they never gather in one task; the
    ranked distinct values are joined back on (keys, order).
    """
    keys = list(keys)
    counted = df.groupBy(*keys, order).agg(F.count(F.lit(1)).alias("_n"))
    upto = running_folds(counted, keys, [order], {
        "_upto": ("sum", F.col("_n")), "dense_rank": ("sum", F.lit(1))})
    totals = upto.groupBy(*keys).agg(F.max("_upto").alias("_total"))
    rank = F.col("_upto") - F.col("_n") + 1
    ranked = _attach(upto, totals, keys, ["_total"]).select(
        *keys, order, rank.alias("rank"), "dense_rank",
        F.when(F.col("_total") > 1, (rank - 1) / (F.col("_total") - 1)).otherwise(0.0).alias("percent_rank"),
        (F.col("_upto") / F.col("_total")).alias("cume_dist"))
    return _attach(df, ranked, [*keys, order], ["rank", "dense_rank", "percent_rank", "cume_dist"])


def ntiles(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """Add ``ntile``: n parts whose sizes differ by one at most, larger ones first."""
    keys = list(keys)
    numbered = row_numbers(df, keys, order, "_rn")
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
    at, total = F.col("_rn") - 1, F.col("_total")
    small = F.floor(total / n)
    large_rows = (total % n) * (small + 1)
    part = F.when(at < large_rows, F.floor(at / (small + 1))).otherwise(
        (total % n) + F.floor((at - large_rows) / F.greatest(small, F.lit(1))))
    return _attach(numbered, sizes, keys, ["_total"]).withColumn("ntile", (part + 1).cast("int")).drop("_rn", "_total")


def shifted(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, tuple]
) -> DataFrame:
    """Add ``lag`` (offset > 0) and ``lead`` (offset < 0) columns.

    ``values[name] = (column, offset)`` or ``(column, offset, default)``; the default
    stands where there is no such row, not where its value is NULL. Rows are numbered once and meet their neighbour in an equi-join on
    (keys, number), so the offset may reach across tiles.
    """
    numbered = with_key(row_numbers(df, keys, order, "_rn"), list(keys))
    out = numbered
    for name, (column, offset, *default) in values.items():
        other = numbered.select(BY, (F.col("_rn") + offset).alias("_rn"), F.col(column).alias(name),
                                F.lit(True).alias("_there"))
        out = out.join(other, [BY, "_rn"], "left")
        if default:
            out = out.withColumn(name, F.when(F.col("_there"), F.col(name)).otherwise(F.lit(default[0])))
        out = out.drop("_there")
    return out.select(*df.columns, *values)


def partition_folds(df: DataFrame, keys: Sequence[str], aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates ``OVER (PARTITION BY keys)``: one row per key, joined back.

    The aggregate is combined map-side, and the join has one row per key on one
    side, so a hot key is split by adaptive execution or needs no shuffle at all.
    """
    folded = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return _attach(df, folded, keys, list(aggregates))


def range_folds(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    outputs: dict[str, tuple[str, Column]],
    low: int | None = None,
    high: int = 0,
) -> DataFrame:
    """Folds over ``RANGE BETWEEN low AND high`` around the order value.

    Rows with equal order values share their frame, so they are folded first, map-side.
    The frames run over distinct values in range tiles, whatever the frame. A frame that
    begins at the start of the partition is a running fold read at its end. A bounded
    frame is cut by blocks as wide as itself: it is the end of one block and the beginning
    of the next, so a fold backward and one forward inside the blocks give it.
    """
    keys = list(keys)
    partial = df.groupBy(*keys, order).agg(*[
        FOLDS[fold][0](c).alias(n) for n, (fold, c) in outputs.items()])
    again = {n: (fold, F.col(n)) for n, (fold, _) in outputs.items()}
    if low is None and high == 0:
        framed = running_folds(partial, keys, [order], {f"_r_{n}": spec for n, spec in again.items()})
        return _attach(df, framed.select(*keys, order, *[F.col(f"_r_{n}").alias(n) for n in outputs]),
                       [*keys, order], list(outputs))
    return _attach(df, _bounded(partial, keys, order, again, low, high), [*keys, order], list(outputs))


def _bounded(
    partial: DataFrame, keys: list[str], order: str, outputs: dict[str, tuple[str, Column]],
    low: int | None, high: int,
) -> DataFrame:
    """Frames of distinct values: the folds are read at points between the values, too."""
    here = F.col(order)
    ends = [here + high] if low is None else [here + low, here + high]
    data = partial.select(*keys, here.alias("_at"), *outputs)
    points = partial.select(*keys, F.explode(F.array(*ends)).alias("_at"), *[
        F.lit(None).cast(partial.schema[n].dataType).alias(n) for n in outputs])
    merged = data.unionByName(points).groupBy(*keys, "_at").agg(*[
        FOLDS[fold][0](F.col(n)).alias(n) for n, (fold, _) in outputs.items()])
    if low is None:
        block, width = F.lit(0).cast("bigint"), None
    else:
        whole = partial.schema[order].dataType.typeName() in ("byte", "short", "integer", "long")
        width = high - low + (1 if whole else 0)
        block = F.floor(F.col("_at") / max(width, 1))
    merged = merged.withColumn("_block", block)
    tiled = with_key(cut_in_tiles(merged, [*keys, "_block"], ["_at"]), [*keys, "_block"])
    forward = scan(tiled, [BY], ["_at"], {f"_f_{n}": spec for n, spec in outputs.items()}, inclusive=True)
    forward = forward.select(*keys, F.col("_at").alias("_high"), F.col("_block").alias("_b1"),
                             *[f"_f_{n}" for n in outputs])
    out = _attach(partial.select(*keys, order, (here + high).alias("_high")), forward, [*keys, "_high"],
                  ["_b1", *[f"_f_{n}" for n in outputs]])
    if low is None:
        return out.select(*keys, order, *[F.col(f"_f_{n}").alias(n) for n in outputs])
    backward = scan(tiled, [BY], ["_at"], {f"_g_{n}": spec for n, spec in outputs.items()}, backward=True,
                    inclusive=True)
    backward = backward.select(*keys, F.col("_at").alias("_low"), F.col("_block").alias("_b0"),
                               *[f"_g_{n}" for n in outputs])
    out = _attach(out.withColumn("_low", here + low), backward, [*keys, "_low"],
                  ["_b0", *[f"_g_{n}" for n in outputs]])
    both = F.col("_b0") != F.col("_b1")
    return out.select(*keys, order, *[
        F.when(both, FOLDS[fold][1](F.col(f"_g_{n}"), F.col(f"_f_{n}"))).otherwise(F.col(f"_g_{n}")).alias(n)
        for n, (fold, _) in outputs.items()])

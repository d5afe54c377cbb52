"""Operators on one track: merging and cutting at boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators import values
from trackloom.operators.intervals import CHR, END, KEY, BEGIN, VALUE, length
from trackloom.operators.nodes import NODE, node_join, spread, top_level
from trackloom.operators.scans import TILE, following, solid, tile_of, whole_row


def coalesce_track(
    df: DataFrame,
    vd: str | None = None,
    vm: str = values.EACH,
    merge_adjacent: bool = False,
) -> DataFrame:
    """Merge overlapping intervals into maximal ones.

    A merged interval contains its members whole, so both value models give
    the fold of the plain values. Rows are first folded per start (map-side),
    each start then learns the start of its merged interval from a window over
    its tile and a carry from earlier tiles, and a second map-side fold joins
    the members.
    """
    values.check(vd, vm, values.FOLDED)
    slack = 1 if merge_adjacent else 0
    partial = values.partial_fold(vd, F.col(VALUE)) if vd else {}
    starts = solid(df).groupBy(CHR, BEGIN).agg(
        F.max(END).alias(END), *[c.alias(n) for n, c in partial.items()])

    tiled = starts.withColumn(TILE, tile_of(F.col(BEGIN)))
    inside = Window.partitionBy(TILE, CHR).orderBy(BEGIN)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    up_to_here = inside.rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(END).over(earlier)
    # Starts that no earlier interval of the same tile reaches.
    rows = tiled.withColumn("_reach", reach).withColumn(
        "_free", F.when(F.col("_reach").isNull() | (F.col(BEGIN) > F.col("_reach") + slack),
                        F.col(BEGIN))
    ).withColumn("_free", F.max("_free").over(up_to_here)).drop("_reach")

    # A tile opens a merged interval when its last free start lies beyond
    # everything earlier tiles reach; free starts ascend, so the last decides.
    before = Window.partitionBy(CHR).orderBy(TILE).rowsBetween(Window.unboundedPreceding, -1)
    tiles = rows.groupBy(CHR, TILE).agg(
        F.max(END).alias("_end"), F.max("_free").alias("_last"), whole_row(starts).alias("_seen")
    ).filter(F.col("_seen").isNotNull())
    carries = tiles.withColumn("_reach", F.max("_end").over(before)).withColumn(
        "_opened", F.when(F.col("_reach").isNull() | (F.col("_last") > F.col("_reach") + slack),
                          F.col("_last"))
    ).withColumn("_open", F.max("_opened").over(before)).select(CHR, TILE, "_reach", "_open")

    headed = rows.join(carries, [TILE, CHR]).withColumn(
        "_head", F.when(F.col("_reach").isNull() | (F.col("_free") > F.col("_reach") + slack),
                        F.col("_free")).otherwise(F.col("_open")))
    merged = values.merge_fold(vd) if vd else {}
    out = headed.groupBy(CHR, F.col("_head").alias(BEGIN)).agg(
        F.max(END).alias(END), *[c.alias(n) for n, c in merged.items()])
    if vd is None:
        return out
    return out.select(*KEY, values.finish_fold(vd).alias(VALUE))


def segments(df: DataFrame) -> DataFrame:
    """Elementary stretches between consecutive boundaries, covered or not."""
    cuts = solid(df).select(CHR, F.explode(F.array(F.col(BEGIN) - 1, F.col(END))).alias("_cut")).distinct()
    ordered = following(cuts, "_cut", END)
    return ordered.filter(F.col(END).isNotNull()).select(CHR, (F.col("_cut") + 1).alias(BEGIN), END)


def discretize(df: DataFrame, vd: str | None = None, vm: str = values.EACH) -> DataFrame:
    """Cut overlapping intervals at every boundary and fold the values per segment.

    No boundary lies inside a segment, so the intervals covering it are those
    covering its first base. Values are folded per node of the covers before
    they meet the segments: the cost is the number of intervals and segments
    times the log of the longest interval, not the sum of the depths, and no
    running sum loses digits.
    """
    values.check(vd, vm, values.FOLDED)
    top = top_level(df)
    source = df
    if vd is not None and vm == values.TOTAL:
        source = df.withColumn(VALUE, F.col(VALUE) / length())
    covers = spread(source, top, cover=(F.col(BEGIN), F.col(END)))
    partial = values.partial_fold(vd, F.col(VALUE)) if vd else {"_n": F.count(F.lit(1))}
    nodes = covers.groupBy(NODE, CHR).agg(*[c.alias(n) for n, c in partial.items()])
    cells = spread(segments(df), top, point=F.col(BEGIN))
    found = node_join(cells, nodes)
    merged = values.merge_fold(vd) if vd else {"_n": F.sum("_n")}
    out = found.groupBy(*KEY).agg(*[c.alias(n) for n, c in merged.items()])
    if vd is None:
        return out.select(*KEY)
    scale = length() if vm == values.TOTAL else None
    return out.select(*KEY, values.finish_fold(vd, scale).alias(VALUE))

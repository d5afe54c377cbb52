"""Projection of a signal onto the intervals of another track or onto bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators import values
from trackloom.operators.intervals import CHR, END, KEY, BEGIN, VALUE, length, overlap_length
from trackloom.operators.nodes import NODE, node_join, spread, top_level
from trackloom.operators.overlap import overlap_join, shared

# Bins are generated in blocks of this many, so that no task makes a whole chromosome.
BLOCK = 4096


def project_on(
    source: DataFrame,
    target: DataFrame,
    vd: str = "avg",
    vm: str = values.EACH,
    metadata: bool = False,
) -> DataFrame:
    """The value of ``source`` over every distinct interval of ``target``.

    ``avg`` with ``each`` is the mean per base, uncovered bases counting 0.
    Other folds run over the overlapping intervals, scaled to the part inside
    the target under ``total``. Targets that nothing overlaps get 0. With
    ``metadata`` every target row comes back with its own columns.

    Copies of the same source interval are folded before the join.
    """
    values.check(vd, vm, values.FOLDED)
    weighted = vd == "avg" and vm == values.EACH
    fold = "sum" if weighted else vd
    partial = values.partial_fold(fold, F.col(VALUE))
    distinct_source = source.groupBy(*KEY).agg(*[c.alias(n) for n, c in partial.items()])
    targets = target.select(*KEY).distinct()

    pairs = overlap_join(distinct_source, targets)
    a, b = shared("a_"), shared("b_")
    if weighted:
        share = overlap_length(a, b)
    elif vm == values.TOTAL:
        share = overlap_length(a, b) / length(a)
    else:
        share = None
    folded = []
    for name in partial:
        column = F.col("a_" + name)
        if share is not None and name == "_product":
            column = column * F.pow(share, F.col("a__n"))
        elif share is not None and name != "_n":
            column = column * share
        folded.append(column.alias(name))
    merged = values.merge_fold(fold)
    found = pairs.select(CHR, b.start.alias(BEGIN), b.end.alias(END), *folded).groupBy(*KEY).agg(
        *[c.alias(n) for n, c in merged.items()])
    value = values.finish_fold(fold)
    if weighted:
        value = value / length()
    found = found.select(*KEY, value.alias(VALUE))
    base = target.drop(VALUE) if metadata else targets
    return base.join(found, list(KEY), "left").withColumn(
        VALUE, F.coalesce(F.col(VALUE), F.lit(0.0)))


def bins(sizes: DataFrame, width: int, first: DataFrame | None = None) -> DataFrame:
    """All bins ``(chr, bin, chrstart, chrend)`` of ``width`` bases; the last is clipped.

    ``first`` is an optional ``(chr, first)`` with the first bin to make.
    """
    wanted = sizes.withColumn("first", F.lit(0).cast("bigint")) if first is None \
        else sizes.join(first, CHR)
    last = F.floor((F.col("len") - 1) / width).cast("bigint")
    blocks = wanted.withColumn("_last", last).filter(F.col("first") <= F.col("_last")).withColumn(
        "_block", F.explode(F.sequence(
            F.floor(F.col("first") / BLOCK).cast("bigint"),
            F.floor(F.col("_last") / BLOCK).cast("bigint"))))
    blocks = blocks.repartition(CHR, "_block")
    low = F.greatest(F.col("first"), F.col("_block") * BLOCK)
    high = F.least(F.col("_last"), F.col("_block") * BLOCK + (BLOCK - 1))
    cells = blocks.withColumn("bin", F.explode(F.sequence(low, high)))
    return cells.select(
        CHR, "bin", (F.col("bin") * width + 1).alias(BEGIN),
        F.least((F.col("bin") + 1) * width, F.col("len")).alias(END))


def project_bins(
    source: DataFrame,
    width: int,
    sizes: DataFrame,
    vd: str = "avg",
    vm: str = values.EACH,
    leading_zeros: bool = True,
) -> DataFrame:
    """The value of ``source`` over fixed bins of every chromosome in ``sizes``.

    ``avg`` / ``each`` (mean per base) and ``sum`` / ``total`` take two rows per
    interval for its first and last bin plus a logarithmic cover of the bins it
    spans whole. The other folds project onto the bins as a track. Without
    ``leading_zeros`` the bins before the first covered one are left out, and
    so are chromosomes without any interval.
    """
    values.check(vd, vm, values.FOLDED)
    first_bin = F.floor((F.col(BEGIN) - 1) / width).cast("bigint")
    last_bin = F.floor((F.col(END) - 1) / width).cast("bigint")
    first = None
    if not leading_zeros:
        first = source.groupBy(CHR).agg(F.min(first_bin).alias("first"))
    cells = bins(sizes, width, first)
    if (vd, vm) not in (("avg", values.EACH), ("sum", values.TOTAL)):
        return project_on(source, cells.select(*KEY), vd, vm)

    density = F.col(VALUE) if vm == values.EACH else F.col(VALUE) / length()
    located = source.select(
        CHR, BEGIN, END, density.alias("_d"), first_bin.alias("_f"), last_bin.alias("_l"))
    f, l, d = F.col("_f"), F.col("_l"), F.col("_d")
    edge_first = F.struct(
        f.alias("bin"),
        (d * (F.least(F.col(END), (f + 1) * width) - F.col(BEGIN) + 1)).alias("weight"))
    edge_last = F.when(l > f, F.struct(
        l.alias("bin"), (d * (F.col(END) - l * width)).alias("weight")))
    edges = located.select(CHR, F.explode(F.array(edge_first, edge_last)).alias("_edge")).filter(
        F.col("_edge").isNotNull()).groupBy(CHR, F.col("_edge.bin").alias("bin")).agg(
        F.sum("_edge.weight").alias("_edges"))

    inner = located.filter(l - f > 1).select(
        CHR, (f + 1).alias("_lo"), (l - 1).alias("_hi"), d.alias("_d"))
    top = top_level(inner, start="_lo", end="_hi")
    nodes = spread(inner, top, cover=(F.col("_lo"), F.col("_hi"))).groupBy(NODE, CHR).agg(
        F.sum("_d").alias("_d"))
    spans = node_join(spread(cells.select(CHR, "bin"), top, point=F.col("bin")), nodes).groupBy(CHR, "bin").agg((F.sum("_d") * width).alias("_spans"))

    total = F.coalesce(F.col("_edges"), F.lit(0.0)) + F.coalesce(F.col("_spans"), F.lit(0.0))
    if vm == values.EACH:
        total = total / length()
    return cells.join(edges, [CHR, "bin"], "left").join(spans, [CHR, "bin"], "left").select(
        *KEY, total.alias(VALUE))

"""Joins of two tracks by location."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.operators import values
from trackloom.operators.half_lines import before_pairs
from trackloom.operators.intervals import (
    CHR, END, KEY, LOCATION, BEGIN, VALUE, Interval, distance, length, overlap_length,
)
from trackloom.operators.merge import coalesce_track
from trackloom.operators.nodes import (
    CELL, NODE, cell_join, cell_levels, cut_hot, hot_cells, in_cell, in_cells, known_end, overlap_cells, own_level, top_level,
)
from trackloom.operators.scans import following


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    """Prefix every column but the chromosome, which both sides share."""
    return df.select(CHR, *[F.col(c).alias(prefix + c) for c in df.columns if c != CHR])


def shared(prefix: str) -> Interval:
    """One side of a pair produced by the joins of this module."""
    return Interval(F.col(CHR), F.col(prefix + BEGIN), F.col(prefix + END))


def overlap_join(a: DataFrame, b: DataFrame, reach: int = 0) -> DataFrame:
    """All pairs of overlapping intervals: ``chr``, ``a_*`` and ``b_*`` columns.

    Two intervals overlap when either b starts inside a, or a starts inside b
    after b's first base; exactly one of the two holds. Pairs meet in cells on the
    higher of their two levels, and count in the one where the second of them starts.
    Cells that are full of b are cut up into nodes, which give result pairs only: there
    both questions are answered together by an equi-join on ``(chr, node)``. ``reach``
    widens a on both sides, which finds the pairs at distance ``reach`` or less.
    """
    left, right = _prefixed(a, "a_"), _prefixed(b, "b_")
    lo, hi = F.col("a_" + BEGIN) - reach, F.col("a_" + END) + reach
    b_lo, b_hi = F.col("b_" + BEGIN), F.col("b_" + END)
    # Widening adds 2 * reach to a length: log4 grows by at most that many levels.
    top_a = top_level(a) + (F.lit((2 * reach).bit_length() // 2 + 1) if reach else 0)
    top = F.least(top_a, top_level(b))
    hi, b_hi = known_end(lo, hi, top), known_end(b_lo + 1, b_hi, top)
    used_a, used_b = cell_levels(left, lo, hi), cell_levels(right, b_lo, b_hi)
    left = in_cells(left, lo, hi, *overlap_cells(lo, hi, used_a, used_b)[0])
    right = in_cells(right, b_lo, b_hi, *overlap_cells(b_lo, b_hi, used_a, used_b)[1])
    hot = hot_cells(right)
    left = cut_hot(left, hot, cover=(lo, hi), cover_role=0, point=lo, point_role=1)
    right = cut_hot(right, hot, cover=(b_lo + 1, b_hi), cover_role=1, point=b_lo, point_role=0)
    met = cell_join(left, right).filter(in_cell(F.greatest(lo, b_lo)))
    return met.filter(b_lo.between(lo, hi) | lo.between(b_lo + 1, b_hi)).drop(CELL, NODE)


def containment_join(
    points: DataFrame, at: Column, covers: DataFrame, lo: Column, hi: Column, disjoint: bool = False,
) -> DataFrame:
    """All pairs of a row of ``points`` and one of ``covers`` on its chromosome whose ``[lo, hi]`` holds ``at``.

    Apart from the chromosome the two sides share no column. Of ``disjoint`` covers a cell
    holds few, so none has to be cut up.
    """
    hi = known_end(lo, hi, F.lit(0))
    used = cell_levels(covers, lo, hi)
    covers = in_cells(covers, lo, hi, own_level(lo, hi))
    points = in_cells(points, at, at, used)
    hot = None if disjoint else hot_cells(covers)
    met = cell_join(cut_hot(points, hot, point=at), cut_hot(covers, hot, cover=(lo, hi)))
    return met.filter(at.between(lo, hi)).drop(CELL, NODE)


def location_join(a: DataFrame, b: DataFrame, predicate: str) -> DataFrame:
    """Pairs with ``a <predicate> b``.

    Predicates that pin a coordinate become equi-joins on it; those that imply
    an overlap filter the overlap join. ``precedes`` and ``follows`` join on blocks
    of ranks; their result can be as large as the product of the two sides within a
    chromosome, so ask ``half_lines.precede_counts`` where counts will do.
    """
    left, right = _prefixed(a, "a_"), _prefixed(b, "b_")
    test = LOCATION[predicate](shared("a_"), shared("b_"))

    def keyed(left_key: Column, right_key: Column) -> DataFrame:
        pairs = left.withColumn("_k", left_key).join(
            right.withColumn("_k", right_key), [CHR, "_k"])
        return pairs.filter(test).drop("_k")

    a_start, a_end = F.col("a_" + BEGIN), F.col("a_" + END)
    b_start, b_end = F.col("b_" + BEGIN), F.col("b_" + END)
    if predicate == "overlaps":
        return overlap_join(a, b)
    if predicate in ("contains", "within"):
        # The first base of the inner interval lies in the outer one: one question.
        covers, points = (left, right) if predicate == "contains" else (right, left)
        lo, hi, at = (a_start, a_end, b_start) if predicate == "contains" else (b_start, b_end, a_start)
        pairs = containment_join(points, at, covers, lo, hi)
        return pairs.filter(test).select(CHR, *[c for c in (*left.columns, *right.columns) if c != CHR])
    if predicate == "coincides":
        return keyed(F.struct(a_start.alias("s"), a_end.alias("e")),
                     F.struct(b_start.alias("s"), b_end.alias("e")))
    if predicate == "prefix":
        return keyed(a_start, b_start)
    if predicate == "suffix":
        return keyed(a_end, b_end)
    if predicate == "adjacent":
        # The two cases exclude each other, as an interval has at least one base.
        def ends(name: str, position: Column) -> Column:
            return F.struct(F.lit(name).alias("side"), position.alias("at"))

        return keyed(
            F.explode(F.array(ends("before", a_end + 1), ends("after", a_start - 1))),
            F.explode(F.array(ends("before", b_start), ends("after", b_end))))
    columns = [CHR, *[c for c in (*left.columns, *right.columns) if c != CHR]]
    if predicate == "precedes":
        return before_pairs(left, right, "a_" + END, "b_" + BEGIN).select(*columns)
    return before_pairs(right, left, "b_" + END, "a_" + BEGIN).select(*columns)


def distance_join(a: DataFrame, b: DataFrame, at_most: int) -> DataFrame:
    """Pairs whose distance is ``at_most`` or less, with a ``distance`` column."""
    pairs = overlap_join(a, b, reach=at_most)
    return pairs.withColumn("distance", distance(shared("a_"), shared("b_")))


def _share(value: Column, vm: str, a: Interval, b: Interval, own: Interval) -> Column:
    if vm == values.EACH:
        return value
    return value * overlap_length(a, b) / length(own)


def intersect_join(
    a: DataFrame,
    b: DataFrame,
    vd: str | None = None,
    vm: str = values.EACH,
    metadata: bool = False,
) -> DataFrame:
    """The common part of every overlapping pair, with a derived value.

    ``metadata`` keeps the remaining columns of both tracks under ``a_`` and ``b_``.
    """
    values.check(vd, vm, values.PAIRWISE)
    if vd is None and not metadata:
        a, b = a.select(*KEY), b.select(*KEY)
    elif not metadata:
        a, b = a.select(*KEY, VALUE), b.select(*KEY, VALUE)
    pairs = overlap_join(a, b)
    left, right = shared("a_"), shared("b_")
    out = [F.col(CHR), F.greatest(left.start, right.start).alias(BEGIN),
           F.least(left.end, right.end).alias(END)]
    if vd is not None:
        out.append(values.PAIRWISE[vd](
            _share(F.col("a_" + VALUE), vm, left, right, left),
            _share(F.col("b_" + VALUE), vm, left, right, right)).alias(VALUE))
    if metadata:
        taken = {p + c for p in ("a_", "b_") for c in KEY}
        out += [F.col(c) for c in pairs.columns if c not in taken and c != CHR]
    return pairs.select(*out)


def intersect_many(
    tracks: list[DataFrame],
    vd: str | None = None,
    vm: str = values.EACH,
    metadata: bool = False,
) -> DataFrame:
    """The common part of every tuple of one interval of each track that all overlap.

    A tuple is found at the start of the interval that starts last (of several, the one
    of the first track): that position lies in all others. Positions that some track
    leaves uncovered go first, by joins with the disjoint stretches of a track, at most
    one to a position; what is left has a partner in every track, so no step holds more
    rows than the result. Under ``total`` each value is scaled by its own interval.
    Derivations of two operands (diff, quotient) are folded left to right, ``left`` and
    ``right`` are the first and the last track's. ``metadata`` keeps the remaining columns
    of the n-th track under ``tn_``.
    """
    values.check(vd, vm, values.PAIRWISE)
    if len(tracks) < 2:
        raise ValueError("an intersection has two tracks or more")
    if not metadata:
        tracks = [t.select(*KEY, *([VALUE] if vd else [])) for t in tracks]
    names = [f"t{n}_" for n in range(1, len(tracks) + 1)]
    sides = [_prefixed(t, name) for t, name in zip(tracks, names)]
    stretches = [coalesce_track(t.select(*KEY), merge_adjacent=True) for t in tracks]
    at = F.col("_at")

    def starting(last: int) -> DataFrame:
        found = sides[last].withColumn("_at", F.col(names[last] + BEGIN))
        others = [k for k in range(len(tracks)) if k != last]
        for k in others[1:]:
            found = containment_join(found, at, stretches[k], F.col(BEGIN), F.col(END), disjoint=True).drop(BEGIN, END)
        for k in others:
            found = containment_join(found, at, sides[k], F.col(names[k] + BEGIN), F.col(names[k] + END))
            if k < last:
                found = found.filter(F.col(names[k] + BEGIN) < at)
        return found

    met = reduce(DataFrame.unionByName, map(starting, range(len(tracks))))
    begin, end = at, F.least(*[F.col(n + END) for n in names])
    out = [F.col(CHR), begin.alias(BEGIN), end.alias(END)]
    if vd is not None:
        own = [F.col(n + VALUE) for n in names]
        if vm == values.TOTAL:
            own = [v * (end - begin + 1) / length(shared(n)) for v, n in zip(own, names)]
        value = reduce(values.PAIRWISE["sum" if vd == "avg" else vd], own)
        out.append((value / len(tracks) if vd == "avg" else value).alias(VALUE))
    if metadata:
        out += [F.col(c) for name, side in zip(names, sides) for c in side.columns
                if c not in (CHR, name + BEGIN, name + END)]
    return met.select(*out)


def uncovered(b: DataFrame, around: DataFrame) -> DataFrame:
    """The stretches that ``b`` leaves free on the chromosomes ``around`` uses.

    Sentinels just outside the range of ``around`` close the first and the last
    stretch, so every stretch lies between two consecutive merged intervals.
    """
    bounds = around.groupBy(CHR).agg(F.min(BEGIN).alias("lo"), F.max(END).alias("hi"))
    sentinels = bounds.select(CHR, F.explode(F.array(F.col("lo") - 1, F.col("hi") + 1)).alias(BEGIN))
    walls = b.select(*KEY).unionByName(sentinels.withColumn(END, F.col(BEGIN)))
    merged = coalesce_track(walls, merge_adjacent=True)
    gaps = following(merged, BEGIN, "_next").filter(F.col("_next").isNotNull())
    return gaps.select(CHR, (F.col(END) + 1).alias(BEGIN), (F.col("_next") - 1).alias(END))


def exclusive_join(
    a: DataFrame,
    b: DataFrame,
    vm: str = values.EACH,
    metadata: bool = False,
) -> DataFrame:
    """The parts of ``a`` that no interval of ``b`` covers.

    This is the intersection of ``a`` with the complement of ``b``, so an
    interval of ``a`` that many of ``b`` cut up is not gathered in one group.
    """
    values.check(None, vm, ())
    pairs = overlap_join(a, uncovered(b, a))
    left, right = shared("a_"), shared("b_")
    out = [F.col(CHR), F.greatest(left.start, right.start).alias(BEGIN),
           F.least(left.end, right.end).alias(END)]
    if VALUE in a.columns:
        out.append(_share(F.col("a_" + VALUE), vm, left, right, left).alias(VALUE))
    if metadata:
        out += [F.col("a_" + c) for c in a.columns if c not in (*KEY, VALUE)]
    return pairs.select(*out)

"""Exact equi-join keys for intervals.

The number line is cut into aligned blocks of 1, 4, 16, 64, ... positions. An
interval is the disjoint union of at most six blocks per level (its cover), and
a position lies in exactly one block per level (its ancestors). So a position
is inside an interval if and only if exactly ONE block of the cover is among
the ancestors of the position. Joining covers with ancestors on
``(chr, node)`` therefore yields each containment once and yields nothing else:
no candidate pairs to filter, no duplicates to remove, whatever the
distribution of starts and lengths.

An interval of length L costs O(log L) rows, so a chromosome-long interval is a
few dozen rows and not one row per bin.

Joins that return pairs of rows shuffle far less by cells: aligned blocks at least as
long as the interval, of which it touches two at most. All rows of a cell are compared,
which is little work while one side has few rows there; so only cells with many rows are
cut up into nodes as above, each on its own (:func:`in_cells`, :func:`cut_hot`).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.operators.intervals import CHR, END, BEGIN

NODE, CELL = "_node", "_node_cell"
_LEVEL, _SLOT = "_level", "_slot"


def _shift_right(value: Column, bits: Column) -> Column:
    return F.call_function("shiftright", value, bits)


def _node(index: Column, level: Column, role: int) -> Column:
    """Pack block index, level and join direction in one long."""
    packed = F.shiftleft(index, 7).bitwiseOR(F.shiftleft(level.cast("bigint"), 1))
    return packed.bitwiseOR(F.lit(role).cast("bigint"))


def top_level(*tracks: DataFrame, start: str = BEGIN, end: str = END) -> Column:
    """Highest level any cover can use, as a scalar subquery.

    It is one aggregate row, worked out on the cluster when the query runs.
    """
    levels = [
        t.agg(
            F.floor((F.length(F.bin(F.greatest(
                F.coalesce(F.max(F.col(end) - F.col(start) + 1), F.lit(1)),
                F.lit(1)))) - 1) / 2).cast("int").alias("level")
        ).scalar()
        for t in tracks
    ]
    return levels[0] if len(levels) == 1 else F.greatest(*levels)


def spread(
    df: DataFrame,
    top: Column,
    cover: tuple[Column, Column] | None = None,
    point: Column | None = None,
    cover_role: int = 0,
    point_role: int = 0,
    point_top: Column | None = None,
    only: Column | None = None,
) -> DataFrame:
    """One row per node: the cover of ``[lo, hi]`` and / or the ancestors of a position.

    Next to a cover, ancestors go up to ``point_top``, the highest level of the
    covers they are to meet, where that is lower than ``top``. Rows without ``only``
    stay as they are, under the node -1.

    ``role`` keeps two different containment questions apart in the same join.
    The only generator runs over slot numbers; which node a slot stands for, if
    any, is plain arithmetic on longs, so all of it stays in one code span.
    """
    slots = (1 if point is not None else 0) + (6 if cover is not None else 0)
    if cover is not None and (point is None or point_top is not None):
        # A cover uses no level above that of its own length, however long others are.
        own = F.floor((F.length(F.bin(F.greatest(cover[1] - cover[0] + 1, F.lit(1)))) - 1) / 2).cast("int")
        top = F.least(top, own if point is None else F.greatest(own, point_top))
    numbers = F.sequence(F.lit(0), (top + 1) * slots - 1)
    if only is not None:
        numbers = F.when(only, numbers).otherwise(F.array(F.lit(0)))
    numbered = df.withColumn(_SLOT, F.explode(numbers))
    level = F.call_function("div", F.col(_SLOT), F.lit(slots)).cast("int")
    which = F.col(_SLOT) % slots
    leveled = numbered.withColumns({_LEVEL: level, _SLOT: which})
    level, which = F.col(_LEVEL), F.col(_SLOT)
    bits = level * 2
    node = None
    if cover is not None:
        lo, hi = cover
        size = F.call_function("shiftleft", F.lit(1).cast("bigint"), bits)
        four = F.lit(-4).cast("bigint")
        # Complete blocks of this level inside [lo, hi]: first, first + 1, .., last - 1.
        # The middle of that run, up .. down - 1, is made of blocks of the next level.
        leveled = leveled.withColumns({
            "_first": _shift_right(lo + size - 1, bits),
            "_last": _shift_right(hi + 1, bits),
        })
        first, last = F.col("_first"), F.col("_last")
        up, down = (first + 3).bitwiseAND(four), last.bitwiseAND(four)
        left, right = first + which, down + (which - 3)
        # Slots 0 to 2 lie before the middle, slots 3 to 5 after it.
        node = F.when(which < 3, F.when(left < F.least(up, last), _node(left, level, cover_role)))
        node = node.when(which < 6, F.when(
            (up <= down) & (right < last), _node(right, level, cover_role)))
    if point is not None:
        ancestor = _node(_shift_right(point, bits), level, point_role)
        if node is None:
            node = ancestor
        else:
            reached = ancestor if point_top is None else F.when(level <= point_top, ancestor)
            node = node.otherwise(reached)
    if only is not None:
        node = F.when(only, node).otherwise(F.lit(-1).cast("bigint"))
    out = leveled.withColumn(NODE, node)
    if cover is not None or only is not None:
        out = out.filter(F.col(NODE).isNotNull())
    else:
        # Never NULL: a join on the node then adds no filter to this branch. No node is -1.
        out = out.withColumn(NODE, F.coalesce(F.col(NODE), F.lit(-1).cast("bigint")))
    return out.drop(_LEVEL, _SLOT, "_first", "_last")


# A cell has 2 ** CELL_BITS positions, and 4 times as many from level to level.
CELL_BITS = 7
# Cells with more than HOT rows of the right side are cut up: the HOT_CELLS fullest ones, so that
# their list is bounded. Any other holds at most HOT rows, or a part of 1 / HOT_CELLS of all.
HOT, HOT_CELLS = 1024, 1 << 14


def cell_level(lo: Column, hi: Column) -> Column:
    """The lowest level whose cells are as long as ``[lo, hi]``; its first base alone if it has no end."""
    return F.greatest(F.lit(0), F.floor((F.length(F.bin(F.greatest(lo, hi) - lo)) - CELL_BITS + 1) / 2).cast("int"))


def known_end(lo: Column, hi: Column, top: Column) -> Column:
    """``hi``; without one, the end of the blocks that follow ``lo`` up to level ``top``, as in :func:`spread`."""
    bits = (top + 1) * 2
    up = F.call_function("shiftleft", _shift_right(lo + _bit(bits) - 1, bits), bits)
    return F.coalesce(hi, up - 1)


def _bit(level: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), level)


def own_level(lo: Column, hi: Column) -> Column:
    """The level of ``[lo, hi]`` as the only bit."""
    return _bit(cell_level(lo, hi))


def _below(level: Column) -> Column:
    return _bit(level) - 1


def cell_levels(df: DataFrame, lo: Column, hi: Column) -> Column:
    """The levels that the intervals of a track have, as bits of a scalar subquery."""
    level = F.when(lo.isNotNull(), cell_level(lo, hi))
    return df.agg(F.coalesce(F.bit_or(_bit(level)), F.lit(0).cast("bigint")).alias("levels")).scalar()


def in_cells(df: DataFrame, lo: Column, hi: Column, *levels: Column) -> DataFrame:
    """One row per cell that ``[lo, hi]`` touches on ``levels``, given as bits, one number per role."""
    span = F.greatest(F.length(F.bin(reduce(Column.bitwiseOR, levels))) * len(levels) - 1, F.lit(0))
    slots = df.withColumn(_SLOT, F.explode(F.when(lo.isNotNull(), F.sequence(F.lit(0), span))))
    level = F.call_function("div", F.col(_SLOT), F.lit(len(levels))).cast("int")
    role = (F.col(_SLOT) % len(levels)).cast("bigint")
    asked = levels[0] if len(levels) == 1 else F.when(role == 0, levels[0]).otherwise(levels[1])
    slots = slots.filter(asked.bitwiseAND(_bit(level)) != 0)
    bits = level * 2 + CELL_BITS
    touched = slots.withColumn(CELL, F.explode(F.sequence(
        _shift_right(lo, bits), _shift_right(F.greatest(lo, hi), bits))))
    packed = F.shiftleft(F.col(CELL), 7).bitwiseOR(F.shiftleft(level.cast("bigint"), 1)).bitwiseOR(role)
    return touched.withColumn(CELL, packed).drop(_SLOT)


def overlap_cells(lo: Column, hi: Column, own: Column, other: Column) -> tuple[list[Column], list[Column]]:
    """Levels and roles by which a left and a right interval meet on the higher of their two levels.

    Role 0 has a left interval on its own level and all right ones up to it, role 1 a right one on its
    own level and lower left ones. ``own`` and ``other`` are the levels of the left and the right track.
    """
    level = cell_level(lo, hi)
    upto, none = _below(level + 1), F.lit(0).cast("bigint")
    left = [F.when(other.bitwiseAND(upto) != 0, _bit(level)).otherwise(none), other.bitwiseAND(F.bitwise_not(upto))]
    right = [own.bitwiseAND(F.bitwise_not(_below(level))),
             F.when(own.bitwiseAND(_below(level)) != 0, _bit(level)).otherwise(none)]
    return left, right


def hot_cells(cells: DataFrame) -> DataFrame:
    """``(cell, chr)`` of the fullest cells, a bounded list."""
    counts = cells.filter(F.col(CHR).isNotNull()).groupBy(CELL, CHR).agg(F.count(F.lit(1)).alias("_rows"))
    fullest = counts.filter(F.col("_rows") > HOT).orderBy(F.desc("_rows"), CELL, CHR).limit(HOT_CELLS)
    return fullest.select(CELL, CHR, F.lit(True).alias("_hot"))


def _cell_bits() -> Column:
    return F.shiftright(F.col(CELL), 1).bitwiseAND(F.lit(63).cast("bigint")).cast("int") * 2 + CELL_BITS


def in_cell(position: Column) -> Column:
    """Whether a position lies in the cell of the row, so that a pair counts in one of its cells only."""
    return _shift_right(position, _cell_bits()) == F.shiftright(F.col(CELL), 7)


def cut_hot(
    cells: DataFrame,
    hot: DataFrame | None,
    cover: tuple[Column, Column] | None = None,
    point: Column | None = None,
    cover_role: int = 0,
    point_role: int = 0,
) -> DataFrame:
    """Rows of hot cells by the nodes of their part in the cell (see :func:`spread`), others as they are."""
    if hot is None:
        return cells.withColumn(NODE, F.lit(-1).cast("bigint"))
    marked = cells.join(F.broadcast(hot), [CELL, CHR], "left")
    low = F.call_function("shiftleft", F.shiftright(F.col(CELL), 7), _cell_bits())
    high = low + _bit(_cell_bits()) - 1
    top = F.call_function("div", _cell_bits(), F.lit(2)).cast("int")
    if cover is not None:
        cover = F.greatest(cover[0], low), F.least(cover[1], high)
    if point is not None:
        point = F.when(in_cell(point), point)
    return spread(marked, top, cover, point, cover_role, point_role, top, F.col("_hot").isNotNull()).drop("_hot")


def cell_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Join two tables of cells; rows that share a cell are candidates. Shuffled as in :func:`node_join`."""
    return left.join(right.hint("merge"), [CELL, CHR, NODE])


# Half lines of ranks are cut in runs of 4 ** RUN_LEVEL ranks and the blocks of what is left.
RUN_LEVEL = 5


def spread_prefix(df: DataFrame, count: Column) -> DataFrame:
    """One row per node of the ranks ``0 .. count - 1``, to meet :func:`spread_rank`.

    Every whole run of 1024 ranks is one node, the rest is the cover of its blocks. A
    row stands for up to 1024 ranks, so the runs are few next to the pairs they give,
    and no key has more than 1024 ranks on the other side.
    """
    runs = _shift_right(count, F.lit(2 * RUN_LEVEL))
    whole = df.filter(runs > 0).withColumn(_SLOT, F.explode(F.sequence(F.lit(0).cast("bigint"), runs - 1)))
    whole = whole.withColumn(NODE, _node(F.col(_SLOT), F.lit(RUN_LEVEL), 0)).drop(_SLOT)
    rest = spread(df, F.lit(RUN_LEVEL), cover=(F.shiftleft(runs, 2 * RUN_LEVEL), count - 1))
    return whole.unionByName(rest)


def spread_rank(df: DataFrame, rank: Column) -> DataFrame:
    """One row per node that holds a rank: its own block and those around it up to a run."""
    return spread(df, F.lit(RUN_LEVEL), point=rank)


def node_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Join two spread tables on ``(chr, node)``.

    Size estimates do not see the rows :func:`spread` adds, so a broadcast
    planned from them would be unchecked: ask for a shuffled join, which the
    adaptive planner can split where a node is hot. The node comes first
    because rows are sorted by it, and chromosome names share their first bytes.
    """
    return left.join(right.hint("merge"), [NODE, CHR])

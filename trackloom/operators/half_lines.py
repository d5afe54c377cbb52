"""Intervals that lie wholly before or after others.

``a`` precedes every interval that begins behind its end: a half line. The distinct
beginnings of a chromosome are ranked from the last one, so that a half line is the ranks
``0 .. count - 1``, whatever the positions. Ranks meet their half lines in an equi-join on
blocks of ranks, which gives result pairs only, each once, on keys that hold 1024 ranks at
most. Counts need no pairs: two running sums over positions give them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.operators.intervals import BEGIN, CHR, END
from trackloom.operators.nodes import NODE, node_join, spread_prefix, spread_rank
from trackloom.operators.scans import running, solid

AT = "_at"


def _marked(df: DataFrame, at: Column, **marks: Column) -> DataFrame:
    named = [c.cast("bigint").alias(n) for n, c in marks.items()]
    return df.select(CHR, at.cast("bigint").alias(AT), *named).filter(F.col(AT).isNotNull())


def before_pairs(left: DataFrame, right: DataFrame, end: str, begin: str) -> DataFrame:
    """Pairs of one chromosome with ``left.end < right.begin``.

    Apart from the chromosome the two sides share no column. Rows without a chromosome
    or a position are in no pair.
    """
    behind = F.col(end) + 1
    marks = _marked(left, behind, _point=F.lit(0)).unionByName(_marked(right, F.col(begin), _point=F.lit(1)))
    once = solid(marks.groupBy(CHR, AT).agg(F.max("_point").alias("_point")))
    # How many distinct beginnings lie at a position or behind it.
    ranked = running(once, AT, {"_upto": ("sum", F.col("_point"))}, backward=True, inclusive=True)
    ranked = ranked.select(CHR, AT, "_upto")
    asking = left.withColumn(AT, behind.cast("bigint")).join(ranked, [CHR, AT]).filter("_upto > 0")
    asked = right.withColumn(AT, F.col(begin).cast("bigint")).join(ranked, [CHR, AT])
    covers = spread_prefix(asking, F.col("_upto")).drop(AT, "_upto")
    points = spread_rank(asked, F.col("_upto") - 1).drop(AT, "_upto")
    return node_join(covers, points).drop(NODE)


def precede_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` with ``n_precedes`` and ``n_follows``: intervals of ``b`` behind and before each.

    Rows and copies count on both sides. A row of ``a`` without a chromosome or a position
    has 0; such rows of ``b`` count nowhere. Nothing grows with the number of pairs.
    """
    none, one = F.lit(0), F.lit(1)
    first, last = F.col(BEGIN) - 1, F.col(END) + 1
    marks = _marked(b, F.col(BEGIN), _begins=one, _ends=none).unionByName(
        _marked(b, F.col(END), _begins=none, _ends=one)).unionByName(
        _marked(a, first, _begins=none, _ends=none)).unionByName(
        _marked(a, last, _begins=none, _ends=none))
    folded = solid(marks.groupBy(CHR, AT).agg(F.sum("_begins").alias("_begins"), F.sum("_ends").alias("_ends")))

    def counted(source: str, name: str, at: str, backward: bool) -> DataFrame:
        sums = running(folded, AT, {name: ("sum", F.col(source))}, backward=backward, inclusive=True)
        return sums.select(CHR, F.col(AT).alias(at), name)

    keyed = a.withColumns({"_behind": last.cast("bigint"), "_before": first.cast("bigint")})
    out = keyed.join(counted("_begins", "n_precedes", "_behind", True), [CHR, "_behind"], "left")
    out = out.join(counted("_ends", "n_follows", "_before", False), [CHR, "_before"], "left")
    return out.select(*a.columns, *[F.coalesce(n, F.lit(0)).alias(n) for n in ("n_precedes", "n_follows")])

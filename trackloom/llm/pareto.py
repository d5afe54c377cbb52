"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.components import saved

WORD = r"[^\x20\x09-\x0D]+"
# A draw has 52 bits of a digest and a rank has as many; each level of the search for
# the last rank taken looks at 2 ** LEVEL_BITS ranges of ranks.
DRAW_BITS = 52
LEVEL_BITS = 13


def word_count(text: Column) -> Column:
    """Runs of characters other than white space (space, \\t to \\r); null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(*columns: Column) -> Column:
    """A uniform number in (0, 1) that depends on the columns only."""
    text = F.concat_ws("|", *[c.cast("string") for c in columns])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + 0.5) / float(2**DRAW_BITS)


def water_filled(sizes: DataFrame, share: float, weights: tuple[float, ...], cap: float) -> DataFrame:
    """Targets (source, source_size, target) of a table (source, source_size).

    Sources in code point order, null last, take the weights in turn and share
    ``share`` of the whole size. No target is above ``cap`` times its source's size; the
    excess goes to the others by weight until none is above, which is the level at which
    ``sum(min(cap * size, level * weight))`` is the whole. One row per source is all that
    the windows here see.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    rows = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1))
    # In ascending order of the level at which it fills up, a source is capped if the
    # level that the sources from it on would share lies above its own.
    filling = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    whole = F.sum("source_size").over(Window.partitionBy())
    left = share * whole - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    level = left / F.sum("weight").over(after)
    rows = rows.withColumns({"level": level, "free": level * F.col("weight") <= cap * F.col("source_size")})
    common = F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(
        filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.coalesce(F.least(common * F.col("weight"), cap * F.col("source_size")), cap * F.col("source_size"))
    return rows.select("source", "source_size", target.cast("double").alias("target"))


def pareto_mix(
    docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (3, 1, 2), cap: int = 2,
    seed: int = 7, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text",
    weight_column: str | None = None,
) -> DataFrame:
    """``docs`` with columns size, source_size, target, copies and taken added.

    A document of a source with target ``t`` and size ``s`` (in words) is to be taken
    ``t / s`` times on average, times its weight over the source's mean weight if
    ``weight_column`` is given, and ``cap`` times at most. It gets the whole copies for
    certain; the fraction is its inclusion probability ``p``. Documents are ranked by
    ``u / (1 - u) * (1 - p) / p`` with a uniform ``u`` of their own, and taken in this
    order until the source's words come nearest to its target. ``u`` is a digest of id
    and seed, so reruns agree and a lost task gives the same rows again.

    The last rank taken is found in a histogram of ranks, refined level by level, so no
    source is ever in one task. Rows of one rank (only rows that share an id can be) are
    taken or left together. Null text has size 0; a null source is a source; a null id
    draws as the empty text. An empty table gives an empty result. Columns of ``docs``
    that clash with the added ones are overwritten.
    """
    base = docs.drop("size", "source_size", "target", "copies", "taken")
    size = word_count(F.col(text_column))
    u = draw(F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.lit(seed))
    given = F.coalesce(F.col(weight_column).cast("double"), F.lit(0.0)) if weight_column else F.lit(1.0)
    keyed = saved(docs.select(
        F.col(source_column).alias("s_source"), size.alias("s_size"), u.alias("u"), given.alias("w")))
    sums = keyed.groupBy(F.col("s_source").alias("source")).agg(
        F.sum("s_size").alias("source_size"), F.sum(F.col("s_size") * F.col("w")).alias("weighted"))
    weighted = sums.select(F.col("source").alias("same"), "weighted")
    targets = water_filled(sums.select("source", "source_size"), share, weights, cap)
    targets = saved(targets.join(weighted, F.col("source").eqNullSafe(F.col("same"))).drop("same"))

    def planned(w: Column, u: Column) -> tuple[Column, Column]:
        """Whole copies, and the rank as an integer; null where no copy can be added."""
        mean = F.col("target") / F.col("source_size")
        if weight_column:
            mean = mean * w * F.col("source_size") / F.col("weighted")
        times = F.coalesce(F.least(mean, F.lit(float(cap))), F.lit(0.0))
        whole = F.floor(times)
        p = times - whole
        odds = u / (1 - u) * (1 - p) / p
        rank = F.floor(odds / (1 + odds) * float(2**DRAW_BITS)).cast("long")
        rank = F.coalesce(rank, F.lit(2**DRAW_BITS - 1))
        return whole, F.when(whole < cap, rank)

    whole, rank = planned(F.col("w"), F.col("u"))
    ranked = keyed.join(targets, F.col("s_source").eqNullSafe(F.col("source"))).select(
        "source", F.col("s_size").alias("size"), "target", whole.alias("whole"), rank.alias("rank"))
    ranked = saved(ranked)
    cut = ranked.groupBy("source").agg(
        (F.first("target") - F.sum(F.col("whole") * F.col("size"))).alias("remain")).withColumn(
        "prefix", F.lit(0).cast("long"))
    for shift in range(DRAW_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        state = cut.withColumnRenamed("source", "same")
        inside = ranked.filter("rank IS NOT NULL").join(state, F.col("source").eqNullSafe(F.col("same"))).filter(
            F.shiftright("rank", shift + LEVEL_BITS) == F.col("prefix"))
        bins = inside.groupBy("source", F.shiftright("rank", shift).alias("bin")).agg(
            F.sum("size").alias("size"), F.first("remain").alias("remain"))
        order = Window.partitionBy("source").orderBy("bin")
        bins = bins.withColumn("before", F.sum("size").over(order) - F.col("size"))
        if shift:
            # The range in which the remaining words run out, or else the last one.
            reached = F.when(F.col("before") + F.col("size") >= F.col("remain"), F.struct("bin", "before"))
            chosen = bins.groupBy("source").agg(
                F.coalesce(F.min(reached), F.max(F.struct("bin", "before"))).alias("at"),
                F.first("remain").alias("remain"))
            cut = saved(chosen.select("source", (F.col("remain") - F.col("at.before")).alias("remain"),
                                      F.col("at.bin").alias("prefix")))
        else:
            near = F.when(F.col("before") + F.col("size") / 2 <= F.col("remain"), F.col("bin"))
            last = bins.groupBy("source").agg(F.max(near).alias("last"), F.min("bin").alias("low"))
            cut = last.select(F.col("source").alias("same"), F.coalesce(
                "last", F.shiftleft(F.shiftright("low", LEVEL_BITS), LEVEL_BITS) - 1).alias("cut"))
    plan = saved(targets.join(cut, F.col("source").eqNullSafe(F.col("same")), "left").select(
        F.col("source").alias("t_source"), "source_size", "target", "weighted", "cut"))
    out = base.withColumns({"size": size, "t_u": u, "t_w": given})
    whole, rank = planned(F.col("t_w"), F.col("t_u"))
    out = out.join(plan, F.col(source_column).eqNullSafe(F.col("t_source")), "left")
    out = out.withColumn("copies", (whole + F.coalesce((rank <= F.col("cut")).cast("long"), F.lit(0))).cast("long"))
    out = out.withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(*base.columns, "size", "source_size", "target", "copies", "taken")


# The same rows on another engine: one running sum over all ranks of a source.
PARETO_SQL = r"""
WITH d AS (
  SELECT doc_id, source, COALESCE(LEN(REGEXP_EXTRACT_ALL(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || SUBSTR(MD5(CONCAT_WS('|', COALESCE(doc_id::VARCHAR, ''), '7')), 1, 13))::BIGINT + 0.5::DOUBLE)
           / 4503599627370496.0::DOUBLE AS u
  FROM documents),
s AS (SELECT source, SUM(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, [3, 1, 2][1 + (ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s),
f AS (
  SELECT *, (1.5::DOUBLE * SUM(source_size) OVER ()
      - 2 * COALESCE(SUM(source_size) OVER (filling ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / (SUM(weight) OVER (filling ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM w WINDOW filling AS (ORDER BY source_size::DOUBLE / weight::DOUBLE, source NULLS LAST)),
c AS (
  SELECT (SELECT ARG_MIN(level, (source_size::DOUBLE / weight::DOUBLE, source)) FROM f
          WHERE level * weight <= 2 * source_size) AS common),
t AS (
  SELECT source, source_size,
         COALESCE(LEAST(common * weight, (2 * source_size)::DOUBLE), (2 * source_size)::DOUBLE) AS target
  FROM f, c),
m AS (
  SELECT d.*, source_size, target,
         COALESCE(LEAST(CASE WHEN source_size > 0 THEN target / source_size::DOUBLE END, 2.0::DOUBLE), 0) AS times
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, FLOOR(times)::BIGINT AS whole, times - FLOOR(times) AS p FROM m),
o AS (SELECT *, CASE WHEN p > 0 THEN u / (1 - u) * (1 - p) / p END AS odds FROM p),
r AS (
  SELECT *, CASE WHEN whole < 2 THEN COALESCE(
      FLOOR(odds / (1 + odds) * 4503599627370496.0::DOUBLE)::BIGINT, 4503599627370495) END AS rank
  FROM o),
g AS (
  SELECT source, rank, SUM(size) AS here FROM r WHERE rank IS NOT NULL GROUP BY source, rank),
h AS (
  SELECT source, rank, here,
         SUM(here) OVER (PARTITION BY source ORDER BY rank) - here AS before FROM g),
b AS (SELECT source, ANY_VALUE(target) - SUM(whole * size) AS remain FROM r GROUP BY source),
k AS (
  SELECT h.source, MAX(h.rank) AS cut FROM h JOIN b ON h.source IS NOT DISTINCT FROM b.source
  WHERE h.before + h.here / 2.0::DOUBLE <= b.remain GROUP BY h.source)
SELECT r.doc_id, r.size, r.source_size, r.target,
       (r.size * (r.whole + CASE WHEN r.rank <= k.cut THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r LEFT JOIN k ON r.source IS NOT DISTINCT FROM k.source
"""

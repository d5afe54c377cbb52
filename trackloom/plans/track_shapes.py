"""Whole analyses on tracks: bins, genes, peaks, merged signal, shifted strands."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.operators import intervals as iv
from trackloom.operators import merge, overlap, project
from trackloom.plans.registry import Query, Tables, query, single
from trackloom.plans.tracks import (
    OVERLAP, WITH_A, WITH_AB, a_track, b_track, line_track_sql, merged_sql, single_sql,
)

QUERIES: dict[str, Query] = {}


def flagship(t: Tables):
    """Intersect two signals, multiply their values and merge what overlaps."""
    both = overlap.intersect_join(a_track(t), b_track(t), "product")
    return merge.coalesce_track(both, "max").withColumn("value", single("value"))


QUERIES["shape_intersect_then_merge"] = query(
    flagship,
    f"{WITH_AB}, j AS (SELECT a.chr, greatest(a.chrstart, b.chrstart) AS chrstart, "
    f"least(a.chrend, b.chrend) AS chrend, a.value * b.value AS value FROM a JOIN b ON {OVERLAP}), "
    f"{merged_sql('j', 0, f', {single_sql('max(value)')} AS value')} "
    "SELECT chr, chrstart, chrend, value FROM m",
)


def _genes(t: Tables):
    """Annotation intervals: orders, with the priority as feature and status as attribute."""
    return iv.track(
        t.orders,
        chr=F.concat(F.lit("chr"), (F.col("o_custkey") % 5 + 1).cast("string")),
        start=F.col("o_orderkey") * 10 + 1,
        end=F.col("o_orderkey") * 10 + 1 + F.floor(F.col("o_totalprice") / 1000).cast("bigint"),
        metadata=("o_orderpriority", "o_orderstatus"),
    )


_GENES = (
    "genes AS (SELECT 'chr' || (o_custkey % 5 + 1) AS chr, o_orderkey * 10 + 1 AS chrstart, "
    "o_orderkey * 10 + 1 + CAST(floor(o_totalprice / 1000) AS BIGINT) AS chrend, "
    "o_orderpriority, o_orderstatus FROM orders)"
)
_TARGET_LEN = "(b.chrend - b.chrstart + 1)"
_OVL = "(least(a.chrend, b.chrend) - greatest(a.chrstart, b.chrstart) + 1)"

QUERIES["shape_project_on_genes"] = query(
    lambda t: project.project_on(
        a_track(t), _genes(t).filter(F.col("o_orderpriority") == "1-URGENT")
    ).withColumn("value", single("value")),
    f"{WITH_A}, {_GENES}, b AS (SELECT DISTINCT chr, chrstart, chrend FROM genes "
    "WHERE o_orderpriority = '1-URGENT') SELECT b.chr, b.chrstart, b.chrend, "
    f"{single_sql(f'coalesce(sum(a.value * {_OVL}) / {_TARGET_LEN}, 0)')} AS value "
    f"FROM b LEFT JOIN a ON {OVERLAP} GROUP BY b.chr, b.chrstart, b.chrend",
)
QUERIES["shape_signal_outside_genes"] = query(
    lambda t: overlap.exclusive_join(a_track(t), _genes(t).filter(
        (F.col("o_orderpriority") == "1-URGENT")
        & (F.col("o_orderstatus").like("%F%") | F.col("o_orderstatus").like("%O%")))),
    f"{WITH_A}, {_GENES}, p AS (SELECT chr, chrstart, chrend FROM genes WHERE o_orderpriority = '1-URGENT' "
    "AND (o_orderstatus LIKE '%F%' OR o_orderstatus LIKE '%O%')), "
    f"{merged_sql('p')}, r AS (SELECT row_number() OVER () AS id, * FROM a), "
    "k AS (SELECT r.*, m.chrstart AS ms, m.chrend AS me FROM r LEFT JOIN m "
    "ON r.chr = m.chr AND m.chrstart <= r.chrend AND m.chrend >= r.chrstart), "
    "w AS (SELECT *, lag(me) OVER (PARTITION BY id ORDER BY ms) AS pe FROM k), "
    "f AS (SELECT chr, value, coalesce(pe + 1, chrstart) AS s, coalesce(ms - 1, chrend) AS e FROM w "
    "UNION ALL SELECT any_value(chr), any_value(value), max(me) + 1, any_value(chrend) FROM k "
    "WHERE me IS NOT NULL GROUP BY id) "
    "SELECT chr, s AS chrstart, e AS chrend, value FROM f WHERE s <= e",
)
QUERIES["shape_merge_strong_signal"] = query(
    lambda t: merge.coalesce_track(a_track(t).filter(F.col("value") > 30), "avg").withColumn(
        "value", single("value")),
    f"{WITH_A}, n AS (SELECT * FROM a WHERE value > 30), "
    f"{merged_sql('n', 0, f', {single_sql('avg(value)')} AS value')} "
    "SELECT chr, chrstart, chrend, value FROM m",
)
QUERIES["shape_long_genes"] = query(
    lambda t: _genes(t).filter((F.col("o_orderpriority") == "1-URGENT") & (iv.length() > 100)),
    f"WITH {_GENES} SELECT * FROM genes WHERE o_orderpriority = '1-URGENT' AND chrend - chrstart + 1 > 100",
)
QUERIES["shape_count_genes"] = query(
    lambda t: _genes(t).filter(
        (F.col("o_orderpriority") == "1-URGENT") & ~F.col("o_orderstatus").like("%F%")
    ).agg(F.count(F.lit(1)).alias("n")),
    f"WITH {_GENES} SELECT count(*) AS n FROM genes WHERE o_orderpriority = '1-URGENT' "
    "AND o_orderstatus NOT LIKE '%F%'",
)


def _consensus(t: Tables):
    """Bins in which at least three peak sets have signal, and their mean of a second signal."""
    width = 2000
    peaks = t.lineitem.select(
        F.concat(F.lit("chr"), (F.col("l_suppkey") % 5 + 1).cast("string")).alias("chr"),
        F.expr("l_orderkey * 10 + l_linenumber").alias("chrstart"),
        F.expr("l_orderkey * 10 + l_linenumber + CAST(l_quantity AS BIGINT)").alias("chrend"),
        F.col("l_returnflag").alias("source"))
    # Every peak set projected onto the same bins: one pass, the set is one more key.
    first, last = ((F.floor((F.col(c) - 1) / width)).cast("bigint") for c in ("chrstart", "chrend"))
    hit = peaks.select("chr", "source", F.explode(F.sequence(first, last)).alias("bin")).distinct()
    kept = hit.groupBy("chr", "bin").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 2)
    target = kept.select("chr", (F.col("bin") * width + 1).alias("chrstart"),
                         ((F.col("bin") + 1) * width).alias("chrend"))
    return project.project_on(a_track(t), target).filter(F.col("value") > 3).withColumn(
        "value", single("value"))


QUERIES["shape_consensus_bins"] = query(
    _consensus,
    f"{WITH_A}, p AS (SELECT 'chr' || (l_suppkey % 5 + 1) AS chr, l_returnflag AS source, "
    "unnest(range((l_orderkey * 10 + l_linenumber - 1) // 2000, "
    "(l_orderkey * 10 + l_linenumber + CAST(l_quantity AS BIGINT) - 1) // 2000 + 1)) AS bin FROM lineitem), "
    "h AS (SELECT chr, bin, count(DISTINCT source) AS n FROM p GROUP BY chr, bin), "
    "b AS (SELECT chr, bin * 2000 + 1 AS chrstart, (bin + 1) * 2000 AS chrend FROM h WHERE n > 2), "
    f"v AS (SELECT b.chr, b.chrstart, b.chrend, {single_sql(f'coalesce(sum(a.value * {_OVL}) / {_TARGET_LEN}, 0)')} "
    f"AS value FROM b LEFT JOIN a ON {OVERLAP} GROUP BY b.chr, b.chrstart, b.chrend) "
    "SELECT * FROM v WHERE value > 3",
)
QUERIES["shape_shifted_strands"] = query(
    lambda t: overlap.intersect_join(
        a_track(t).filter((F.col("value") > 30) & (F.col("chrstart") > 200)).select(
            "chr", (F.col("chrstart") - 200).alias("chrstart"), (F.col("chrend") - 200).alias("chrend")),
        b_track(t).filter(F.col("value") > 30).select(
            "chr", (F.col("chrstart") + 200).alias("chrstart"), (F.col("chrend") + 200).alias("chrend"))),
    f"WITH a AS (SELECT chr, chrstart - 200 AS chrstart, chrend - 200 AS chrend FROM ({line_track_sql('O')}) "
    "WHERE value > 30 AND chrstart > 200), "
    f"b AS (SELECT chr, chrstart + 200 AS chrstart, chrend + 200 AS chrend FROM ({line_track_sql('F')}) "
    "WHERE value > 30) SELECT a.chr, greatest(a.chrstart, b.chrstart) AS chrstart, "
    f"least(a.chrend, b.chrend) AS chrend FROM a JOIN b ON {OVERLAP}",
)

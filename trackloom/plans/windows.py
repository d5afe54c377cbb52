"""Window functions, plain and for partitions too large for one task."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackloom.operators import ordered
from trackloom.plans.registry import Query, as_long, query, same_sql, single

# A total order within a customer, so that every function is determined.
_W = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
_PLACED = "FROM {orders} "


def _named_inherited(t):
    """A named window is a value that other windows extend."""
    named = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select(
        "o_custkey", "o_orderkey", F.count(F.lit(1)).over(named.rowsBetween(-1, 0)).alias("c"),
        F.min("o_orderkey").over(named).alias("m"))



def _single(text: str) -> str:
    return f"CAST(CAST({text} AS FLOAT) AS DOUBLE)"


QUERIES: dict[str, Query] = {
    "window_row_number": same_sql(
        f"SELECT o_custkey, o_orderkey, row_number() OVER ({_W}) AS rn {_PLACED}"),
    "window_distribute_sort": Query(
        same_sql("SELECT o_custkey, o_orderkey, row_number() OVER (DISTRIBUTE BY o_custkey SORT BY o_orderdate, o_orderkey) AS rn, "
                 "sum(o_orderkey) OVER (PARTITION BY o_custkey SORT BY o_orderkey) AS upto FROM {orders}").run,
        "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn, "
        "CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS upto FROM orders"),
    "window_ranks": same_sql(
        "SELECT p_brand, p_partkey, rank() OVER w AS r, dense_rank() OVER w AS dr, "
        "percent_rank() OVER w AS pr, cume_dist() OVER w AS cd FROM {part} "
        "WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)"),
    "window_ntile": same_sql(
        f"SELECT o_custkey, o_orderkey, ntile(4) OVER ({_W}) AS part {_PLACED}"),
    "window_lead_lag": same_sql(
        f"SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER ({_W}) AS prev, "
        f"lead(o_orderkey, 2) OVER ({_W}) AS next2, lag(o_orderkey, 1, CAST(-1 AS BIGINT)) OVER ({_W}) AS prev_or "
        f"{_PLACED}"),
    "window_first_last": same_sql(
        f"SELECT o_custkey, o_orderkey, first_value(o_orderkey) OVER ({_W}) AS f, "
        f"last_value(o_orderkey) OVER ({_W}) AS l {_PLACED}"),
    "window_first_last_skip_nulls": query(
        lambda t: t.sql(
            "SELECT o_custkey, o_orderkey, first_value(k, true) OVER w AS f, last_value(k, true) OVER w AS l FROM "
            "(SELECT *, CASE WHEN o_orderstatus = 'F' THEN o_orderkey END AS k FROM {orders}) "
            f"WINDOW w AS ({_W})"),
        "SELECT o_custkey, o_orderkey, first_value(k IGNORE NULLS) OVER w AS f, "
        "last_value(k IGNORE NULLS) OVER w AS l FROM "
        "(SELECT *, CASE WHEN o_orderstatus = 'F' THEN o_orderkey END AS k FROM orders) "
        f"WINDOW w AS ({_W})"),
    "window_rows_frames": same_sql(
        f"SELECT o_custkey, o_orderkey, CAST(sum(o_orderkey) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS run, "
        f"count(*) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS c, "
        f"max(o_orderkey) OVER ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS m {_PLACED}"),
    "window_range_frame": same_sql(
        "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near, "
        "min(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lo "
        "FROM {part}"),
    "window_default_frame": same_sql(
        "SELECT p_partkey, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS s FROM {part}"),
    "window_whole_partition": same_sql(
        "SELECT s_suppkey, count(*) OVER (PARTITION BY s_nationkey) AS n, "
        "max(s_acctbal) OVER (PARTITION BY s_nationkey) AS m FROM {supplier}"),
    "window_several_partitionings": same_sql(
        "SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS by_nation, "
        "rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS by_segment FROM {customer}"),
    "window_named_inherited": query(
        _named_inherited,
        f"SELECT o_custkey, o_orderkey, count(*) OVER (w ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS c, "
        f"min(o_orderkey) OVER w AS m FROM orders WINDOW w AS ({_W})"),
    "window_aggregates_of_lag": same_sql(
        "SELECT o_custkey, o_orderkey, CAST(sum(step) OVER (PARTITION BY o_custkey ORDER BY o_orderkey "
        "ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS BIGINT) AS s FROM (SELECT *, o_orderkey - "
        "lag(o_orderkey, 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS step FROM {orders})"),
    "window_over_expression": same_sql(
        "SELECT s_suppkey, rank() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) "
        "+ dense_rank() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r FROM {supplier}"),
    "window_statistics": same_sql(
        f"SELECT p_partkey, {_single('avg(p_retailprice) OVER (PARTITION BY p_brand)')} AS a, "
        f"{_single('stddev_pop(p_retailprice) OVER (PARTITION BY p_brand)')} AS s FROM " "{part}"),
    "window_over_aggregate": same_sql(
        "SELECT c_nationkey, c_mktsegment, n, rank() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) AS r "
        "FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM {customer} GROUP BY c_nationkey, c_mktsegment)"),
    "window_top_per_group": same_sql(
        "SELECT * FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey "
        "ORDER BY c_acctbal DESC, c_custkey) AS rn FROM {customer}) WHERE rn <= 3"),
    "window_chained_table_functions": same_sql(
        "SELECT p_brand, p_partkey, r, CAST(sum(r) OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) AS BIGINT) AS s FROM ("
        "SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) AS r FROM {part})"),
    # Partitions of a fifth of the table or more: a few keys, cut in range tiles.
    "window_large_row_number": query(
        lambda t: ordered.row_numbers(
            t.events.select("event_type", "user_id", "event_id"), ["event_type"], ["user_id", "event_id"]),
        "SELECT event_type, user_id, event_id, row_number() OVER (PARTITION BY event_type "
        "ORDER BY user_id, event_id) AS row_number FROM events"),
    "window_large_ranks": query(
        lambda t: ordered.ranks(t.events.select("event_type", "user_id", "event_id"), ["event_type"], "user_id"),
        "SELECT event_type, user_id, event_id, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank, "
        "percent_rank() OVER w AS percent_rank, cume_dist() OVER w AS cume_dist FROM events "
        "WINDOW w AS (PARTITION BY event_type ORDER BY user_id)"),
    "window_large_ntile": query(
        lambda t: ordered.ntiles(t.events.select("event_type", "event_id"), ["event_type"], ["event_id"], 7),
        "SELECT event_type, event_id, ntile(7) OVER (PARTITION BY event_type ORDER BY event_id) AS ntile FROM events"),
    "window_large_lead_lag": query(
        lambda t: ordered.shifted(
            t.events.select("event_type", "event_id", "user_id"), ["event_type"], ["event_id"],
            {"before": ("user_id", 1), "after": ("user_id", -2)}),
        "SELECT event_type, event_id, user_id, lag(user_id) OVER w AS before, lead(user_id, 2) OVER w AS after "
        "FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)"),
    "window_large_lag_default": query(
        lambda t: ordered.shifted(
            t.events.select("event_type", "event_id", F.nullif("user_id", F.lit(7)).alias("u")), ["event_type"], ["event_id"],
            {"before": ("u", 2, -1), "after": ("u", -1, 0)}),
        "SELECT event_type, event_id, u, lag(u, 2, -1) OVER w AS before, lead(u, 1, 0) OVER w AS after FROM "
        "(SELECT event_type, event_id, nullif(user_id, 7) AS u FROM events) "
        "WINDOW w AS (PARTITION BY event_type ORDER BY event_id)"),
    "window_large_descending": query(
        lambda t: ordered.row_numbers(
            t.customer.select("c_mktsegment", "c_name", "c_custkey"), ["c_mktsegment"], ["-c_name", "c_custkey"]),
        "SELECT c_mktsegment, c_name, c_custkey, row_number() OVER (PARTITION BY c_mktsegment "
        "ORDER BY c_name DESC, c_custkey) AS row_number FROM customer"),
    "window_range_bounded_large": query(
        lambda t: ordered.range_folds(
            ordered.range_folds(
                t.lineitem.select("l_returnflag", "l_partkey", "l_suppkey", "l_orderkey"), ["l_returnflag"], "l_partkey",
                {"near": ("sum", F.lit(1)), "top": ("max", F.col("l_orderkey")), "low": ("min", F.col("l_suppkey"))}, -7, 12),
            ["l_returnflag"], "l_partkey", {"upto": ("sum", F.lit(1))}, None, 3),
        "SELECT l_returnflag, l_partkey, l_suppkey, l_orderkey, count(*) OVER w AS near, max(l_orderkey) OVER w AS top, "
        "min(l_suppkey) OVER w AS low, count(*) OVER (PARTITION BY l_returnflag ORDER BY l_partkey "
        "RANGE BETWEEN UNBOUNDED PRECEDING AND 3 FOLLOWING) AS upto FROM lineitem WINDOW w AS "
        "(PARTITION BY l_returnflag ORDER BY l_partkey RANGE BETWEEN 7 PRECEDING AND 12 FOLLOWING)"),
    "window_large_running": query(
        lambda t: ordered.running_folds(
            t.lineitem.select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                              "l_extendedprice"),
            ["l_returnflag"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"],
            {"total": ("sum", F.col("l_partkey")), "top": ("max", F.col("l_extendedprice")),
             "low": ("min", F.col("l_suppkey"))}),
        "SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, "
        "CAST(sum(l_partkey) OVER w AS BIGINT) AS total, max(l_extendedprice) OVER w AS top, "
        "min(l_suppkey) OVER w AS low FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY "
        "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING)"),
}


def _by_brand(t):
    return t.part.select("p_brand", "p_partkey", "p_size", "p_name", "p_retailprice")


# Few keys, so each partition is a large share of the table: these run as folds
# and tiled scans, which do not bring a partition into one task.
_LARGE = {
    "window_ranks": lambda t: ordered.ranks(
        _by_brand(t).select("p_brand", "p_partkey", "p_size"), ["p_brand"], "p_size").select(
        "p_brand", "p_partkey", F.col("rank").alias("r"), F.col("dense_rank").alias("dr"),
        F.col("percent_rank").alias("pr"), F.col("cume_dist").alias("cd")),
    "window_range_frame": lambda t: ordered.range_folds(
        ordered.range_folds(_by_brand(t).select("p_brand", "p_partkey", "p_size"), ["p_brand"], "p_size",
                            {"near": ("sum", F.lit(1))}, -5, 5),
        ["p_brand"], "p_size", {"lo": ("min", F.col("p_partkey"))}).select("p_partkey", "near", "lo"),
    "window_default_frame": lambda t: ordered.range_folds(
        _by_brand(t).select("p_brand", "p_partkey", "p_size"), ["p_brand"], "p_size",
        {"s": ("sum", F.col("p_size"))}).select("p_partkey", "s"),
    "window_over_expression": lambda t: ordered.ranks(
        t.supplier.select("s_nationkey", "s_suppkey"), ["s_nationkey"], "s_suppkey").select(
        "s_suppkey", (F.col("rank") + F.col("dense_rank")).alias("r")),
    "window_whole_partition": lambda t: ordered.partition_folds(
        t.supplier.select("s_suppkey", "s_nationkey", "s_acctbal"), ["s_nationkey"],
        {"n": F.count(F.lit(1)), "m": F.max("s_acctbal")}).select("s_suppkey", "n", "m"),
    "window_statistics": lambda t: ordered.partition_folds(
        _by_brand(t).select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"],
        {"a": single(F.avg("p_retailprice")), "s": single(F.stddev_pop("p_retailprice"))}).select("p_partkey", "a", "s"),
    "window_several_partitionings": lambda t: ordered.row_numbers(
        ordered.row_numbers(
            t.customer.select("c_custkey", "c_nationkey", "c_mktsegment", (-F.col("c_acctbal")).alias("_order")),
            ["c_nationkey"], ["_order", "c_custkey"], "by_nation"),
        ["c_mktsegment"], ["_order", "c_custkey"], "by_segment").select("c_custkey", "by_nation", "by_segment"),
    "window_chained_table_functions": lambda t: ordered.running_folds(
        ordered.row_numbers(_by_brand(t).select("p_brand", "p_partkey", "p_name"), ["p_brand"],
                            ["p_name", "p_partkey"], "r"),
        ["p_brand"], ["p_name", "p_partkey"], {"s": ("sum", F.col("r"))}).select("p_brand", "p_partkey", "r", "s"),
}
for _name, _build in _LARGE.items():
    QUERIES[_name] = query(_build, QUERIES[_name].sql)

for _name, _columns in {
    "window_row_number": ("rn",), "window_ranks": ("r", "dr"), "window_ntile": ("part",),
    "window_several_partitionings": ("by_nation", "by_segment"), "window_over_expression": ("r",),
    "window_over_aggregate": ("r",), "window_top_per_group": ("rn",),
    "window_chained_table_functions": ("r",), "window_large_ntile": ("ntile",),
}.items():
    QUERIES[_name] = as_long(QUERIES[_name], *_columns)

"""Joins of every kind."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.operators.joins import UniqueSource, salted_join, skew_join, unique_join
from trackloom.plans.registry import Query, query, same_sql

QUERIES: dict[str, Query] = {
    "join_inner": same_sql(
        "SELECT o.o_orderkey, c.c_name, o.o_totalprice FROM {orders} o JOIN {customer} c "
        "ON o.o_custkey = c.c_custkey"),
    "join_three_way": same_sql(
        "SELECT n.n_name, r.r_name, count(*) AS customers FROM {customer} c "
        "JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey "
        "GROUP BY n.n_name, r.r_name"),
    "join_left": same_sql(
        "SELECT c.c_custkey, o.o_orderkey FROM {customer} c LEFT OUTER JOIN {orders} o "
        "ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'P' AND c.c_acctbal > 5000"),
    "join_right": same_sql(
        "SELECT o.o_orderkey, c.c_custkey FROM {orders} o RIGHT OUTER JOIN {customer} c "
        "ON c.c_custkey = o.o_custkey AND o.o_totalprice > 400000"),
    "join_full": same_sql(
        "SELECT d.doc_id AS d_id, l.doc_id AS l_id, l.quality FROM {documents} d FULL OUTER JOIN {labels} l "
        "ON d.doc_id = l.doc_id AND l.quality = 1"),
    "join_full_filters_both_sides": same_sql(
        "SELECT c.c_custkey, s.s_suppkey FROM {customer} c FULL OUTER JOIN {supplier} s "
        "ON c.c_custkey = s.s_suppkey AND c.c_acctbal > 1000 AND s.s_acctbal > 1000"),
    "join_left_semi": Query(
        same_sql("SELECT c.c_custkey, c.c_name FROM {customer} c LEFT SEMI JOIN {orders} o "
                 "ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000").run,
        "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN "
        "(SELECT o_custkey FROM orders WHERE o_totalprice > 300000)"),
    "join_cross": same_sql(
        "SELECT r.r_name, n.n_name FROM {region} r CROSS JOIN {nation} n"),
    "join_comma": same_sql(
        "SELECT s.s_name, n.n_name FROM {supplier} s, {nation} n WHERE s.s_nationkey = n.n_nationkey"),
    "join_null_safe": Query(
        # A key of many values; one benchmark row and the labels of that id have none.
        same_sql("SELECT l.doc_id, b.item_id FROM (SELECT doc_id, nullif(doc_id % 40, 0) AS k FROM {labels}) l "
                 "JOIN (SELECT item_id, nullif(item_id, 0) AS k FROM {benchmark}) b ON l.k <=> b.k").run,
        "SELECT l.doc_id, b.item_id FROM (SELECT doc_id, nullif(doc_id % 40, 0) AS k FROM labels) l "
        "JOIN (SELECT item_id, nullif(item_id, 0) AS k FROM benchmark) b ON l.k IS NOT DISTINCT FROM b.k"),
    "join_broadcast_hint": Query(
        same_sql("SELECT /*+ MAPJOIN(n) */ c.c_custkey, n.n_name FROM {customer} c JOIN {nation} n "
                 "ON c.c_nationkey = n.n_nationkey").run,
        "SELECT c.c_custkey, n.n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey"),
    "join_theta": same_sql(
        "SELECT s.s_suppkey, n.n_nationkey FROM {supplier} s JOIN {nation} n "
        "ON s.s_nationkey < n.n_nationkey"),
    "join_self": same_sql(
        "SELECT a.n_name AS left_name, b.n_name AS right_name FROM {nation} a JOIN {nation} b "
        "ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"),
    "join_subquery": same_sql(
        "SELECT t.c_nationkey, t.orders FROM (SELECT c.c_nationkey, count(*) AS orders FROM {orders} o "
        "JOIN {customer} c ON o.o_custkey = c.c_custkey GROUP BY c.c_nationkey) t"),
    "join_salted": query(
        lambda t: salted_join(
            t.events.select("event_id", F.col("user_id").alias("c_custkey")),
            t.customer.select("c_custkey", "c_mktsegment"), ["c_custkey"], 8,
        ).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")),
        "SELECT c_mktsegment, count(*) AS n FROM events JOIN customer ON user_id = c_custkey "
        "GROUP BY c_mktsegment"),
    # A third of all events have one key, and every tenth has none.
    "join_skew_detected": query(
        lambda t: skew_join(
            t.events.selectExpr("event_id", "value", "CASE WHEN event_id % 10 = 0 THEN NULL "
                                "WHEN event_id % 3 = 0 THEN 7 ELSE user_id END AS c_custkey"),
            t.customer.select("c_custkey", "c_mktsegment"), ["c_custkey"], "left", share=0.05,
        ).select("event_id", "value", "c_custkey", "c_mktsegment"),
        "SELECT event_id, value, k AS c_custkey, c_mktsegment FROM (SELECT *, CASE WHEN event_id % 10 = 0 THEN NULL "
        "WHEN event_id % 3 = 0 THEN 7 ELSE user_id END AS k FROM events) LEFT JOIN customer ON k = c_custkey"),
}


def _unique(preserve: tuple[bool, bool, bool]):
    def build(t):
        a = t.customer.select((F.col("c_custkey") % 150).alias("key"), F.col("c_custkey").alias("id"))
        b = t.supplier.select((F.col("s_suppkey") * 2).alias("key"), F.col("s_suppkey").alias("id"))
        c = t.benchmark.select((F.col("item_id") * 3).alias("key"), F.col("item_id").alias("id"))
        return unique_join(
            [UniqueSource(d, ["key"], p) for d, p in zip((a, b, c), preserve)], ("a_", "b_", "c_"))

    return build


def _unique_sql(preserve: tuple[bool, bool, bool]) -> str:
    here = ["a.key IS NOT NULL", "b.key IS NOT NULL", "c.key IS NOT NULL"]
    keep = [h for h, p in zip(here, preserve) if p] + ["(" + " AND ".join(here) + ")"]
    return (
        "WITH a AS (SELECT c_custkey % 150 AS key, c_custkey AS id FROM customer), "
        "b AS (SELECT s_suppkey * 2 AS key, s_suppkey AS id FROM supplier), "
        "c AS (SELECT item_id * 3 AS key, item_id AS id FROM benchmark) "
        "SELECT a.key AS a_key, a.id AS a_id, b.key AS b_key, b.id AS b_id, c.key AS c_key, c.id AS c_id "
        "FROM a FULL JOIN b ON a.key = b.key FULL JOIN c ON coalesce(a.key, b.key) = c.key "
        f"WHERE {' OR '.join(keep)}"
    )


for _name, _preserve in {
    "none": (False, False, False), "all": (True, True, True),
    "outer_two": (True, False, True), "one": (True, False, False),
}.items():
    QUERIES[f"join_unique_preserve_{_name}"] = query(_unique(_preserve), _unique_sql(_preserve))


def _unique_two_keys(t):
    """Customers and suppliers by nation and rest of their number; unmatched customers stay."""
    a = t.customer.selectExpr("c_nationkey AS n", "nullif(c_custkey % 10, 3) AS r", "c_custkey AS id")
    b = t.supplier.selectExpr("s_nationkey AS n", "s_suppkey % 10 AS r", "s_suppkey AS id")
    return unique_join([UniqueSource(a, ["n", "r"], True), UniqueSource(b, ["n", "r"], True)], ("a_", "b_"))


QUERIES["join_unique_two_keys"] = query(
    _unique_two_keys,
    "WITH a AS (SELECT c_nationkey AS n, nullif(c_custkey % 10, 3) AS r, c_custkey AS id FROM customer), "
    "b AS (SELECT s_nationkey AS n, s_suppkey % 10 AS r, s_suppkey AS id FROM supplier) "
    "SELECT a.n AS a_n, a.r AS a_r, a.id AS a_id, b.n AS b_n, b.r AS b_r, b.id AS b_id "
    "FROM a FULL JOIN b ON a.n = b.n AND a.r = b.r")

"""Filters, projections, sorting, limits, sampling and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import hashing
from trackloom.operators import sampling
from trackloom.plans.registry import Query, query, same_sql
from trackloom.sources.files import table_bytes

_HASHED = {
    "h_double": "o_totalprice", "h_float": "cast(o_totalprice AS float)", "h_decimal": "cast(o_totalprice AS decimal(15, 2))",
    "h_date": "cast(o_orderdate AS date)", "h_timestamp": "cast(o_orderdate AS timestamp)",
    "h_binary": "cast(o_orderpriority AS binary)", "h_array": "array(o_orderpriority, o_orderpriority)",
    "h_map": "map(o_orderpriority, o_custkey, 'x', 1L)",
    "h_struct": "struct(o_custkey AS k, o_orderpriority AS s, o_totalprice AS d)"}


def _int32(value: str) -> str:
    """The low 32 bits of a whole number, signed."""
    return f"(((({value}) % 4294967296 + 4294967296 + 2147483648) % 4294967296) - 2147483648)::INT"


def _folded_sql(code: str, begin: int) -> str:
    return (f"list_reduce(list_prepend({begin}::BIGINT, list_transform(string_split(o_orderpriority, ''), "
            f"lambda x: {code}::BIGINT)), lambda h, x: (h * 31 + x) & 4294967295)")


QUERIES: dict[str, Query] = {
    "filter_three_valued": same_sql(
        "SELECT doc_id, k FROM (SELECT doc_id, nullif(quality, 0) AS k, toxic FROM {labels}) "
        "WHERE NOT (k = 1 AND toxic = 1)"),
    "filter_between_in_like": same_sql(
        "SELECT p_partkey, p_name FROM {part} WHERE p_size BETWEEN 5 AND 45 AND p_type IN ('SMALL', 'PROMO', 'STANDARD') "
        "AND p_name LIKE '%a%'"),
    "filter_in_with_null": same_sql(
        "SELECT n_nationkey, n_regionkey IN (1, 2, NULL) AS i FROM {nation}"),
    "filter_pushdown": same_sql(
        "SELECT l_orderkey, l_extendedprice FROM {lineitem} WHERE l_shipdate >= TIMESTAMP '1999-01-01 00:00:00' "
        "AND l_shipdate < TIMESTAMP '2000-01-01 00:00:00' AND l_discount >= 0.05 AND l_quantity < 24"),
    "project_expressions": same_sql(
        "SELECT o_orderkey, o_orderkey * 2 + 1 AS e, o_totalprice / 2 AS h, -o_custkey AS m FROM {orders}"),
    "project_regex_columns": query(
        lambda t: t.customer.select(t.customer.colRegex("`c_(name|acct.*)`")),
        "SELECT c_name, c_acctbal FROM customer"),
    "project_star": same_sql("SELECT * FROM {nation}"),
    "subquery_in_from": same_sql(
        "SELECT s.s_suppkey FROM (SELECT s_suppkey, s_acctbal FROM {supplier} WHERE s_acctbal < 9000) s "
        "WHERE s.s_suppkey > 2"),
    "sort_total_order_top": same_sql(
        "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 100"),
    "sort_nulls_first": Query(
        same_sql("SELECT doc_id, k FROM (SELECT doc_id, nullif(quality, 0) AS k FROM {labels}) "
                 "ORDER BY k, doc_id LIMIT 40").run,
        "SELECT doc_id, k FROM (SELECT doc_id, nullif(quality, 0) AS k FROM labels) "
        "ORDER BY k NULLS FIRST, doc_id LIMIT 40"),
    "sort_whole_table": same_sql("SELECT c_custkey, c_acctbal FROM {customer} ORDER BY c_acctbal, c_custkey"),
    "sort_within_partitions": Query(
        same_sql("SELECT c_custkey, c_nationkey FROM {customer} SORT BY c_nationkey DESC").run,
        "SELECT c_custkey, c_nationkey FROM customer"),
    "distribute_by": Query(
        same_sql("SELECT c_custkey, c_nationkey FROM {customer} DISTRIBUTE BY c_nationkey SORT BY c_custkey").run,
        "SELECT c_custkey, c_nationkey FROM customer"),
    "cluster_by": Query(
        same_sql("SELECT l_orderkey, l_partkey FROM {lineitem} CLUSTER BY l_partkey").run,
        "SELECT l_orderkey, l_partkey FROM lineitem"),
    "limit_no_shuffle": Query(
        # Which rows come is open, but they are 25 different rows of the table.
        same_sql("SELECT count(*) AS n, count(DISTINCT l.o_orderkey) AS d, count(o.o_orderkey) AS known FROM "
                 "(SELECT o_orderkey FROM {orders} LIMIT 25) l LEFT JOIN {orders} o ON l.o_orderkey = o.o_orderkey").run,
        "SELECT least(count(*), 25) AS n, least(count(*), 25) AS d, least(count(*), 25) AS known FROM orders"),
    "limit_minimum_rows": query(
        # The first 40 customers, of whom there must be ten.
        lambda t: sampling.limit_at_least(t.customer.select("c_custkey", "c_name").orderBy("c_custkey"), 40, 10),
        "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 40"),
    "union_all": same_sql(
        "SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM {customer} UNION ALL "
        "SELECT s_nationkey AS k FROM {supplier}) GROUP BY k"),
    "union_all_mixed_types": same_sql(
        "SELECT k FROM (SELECT CAST(n_nationkey AS BIGINT) AS k FROM {nation} UNION ALL SELECT s_suppkey AS k FROM {supplier})"),
    "union_distinct": same_sql(
        "SELECT c_nationkey AS k FROM {customer} UNION SELECT n_regionkey AS k FROM {nation}"),
    "sample_bucket_int": query(
        lambda t: sampling.bucket_sample(t.nation, 2, 4, "n_nationkey").select("n_nationkey"),
        "SELECT n_nationkey FROM nation WHERE (n_nationkey & 2147483647) % 4 = 1"),
    "sample_bucket_bigint": query(
        lambda t: sampling.bucket_sample(t.lineitem, 3, 16, "l_orderkey").select("l_orderkey", "l_partkey"),
        "SELECT l_orderkey, l_partkey FROM lineitem WHERE (((l_orderkey ^ (l_orderkey >> 32)) & 4294967295) "
        "& 2147483647) % 16 = 2".replace("l_orderkey ^ (l_orderkey >> 32)", "xor(l_orderkey, l_orderkey >> 32)")),
    "sample_bucket_string": query(
        lambda t: sampling.bucket_sample(t.customer, 1, 8, "c_name").select("c_custkey"),
        # All names are Latin letters, so a byte is a code point.
        "SELECT c_custkey FROM customer WHERE (list_reduce(list_prepend(0::BIGINT, list_transform(string_split(c_name, ''), "
        "lambda x: ord(x)::BIGINT)), lambda h, x: (h * 31 + x) & 4294967295) & 2147483647) % 8 = 0"),
    "hash_fold": query(
        lambda t: t.nation.select(
            "n_nationkey", hashing.fold_hash(t.nation, "n_nationkey", "n_regionkey").alias("h")),
        "SELECT n_nationkey, CAST(n_nationkey * 31 + n_regionkey AS INT) AS h FROM nation"),
    "hash_all_types": query(
        lambda t: t.orders.select("o_orderkey", *[
            hashing.fold_hash(t.orders, F.expr(e)).alias(n) for n, e in _HASHED.items()]),
        f"""WITH v AS (SELECT *, o_totalprice::BIT::BIGINT AS d, o_totalprice::FLOAT::BIT::BIGINT AS f,
            o_totalprice::DECIMAL(15, 2) AS m, epoch_us(o_orderdate) AS us, {_folded_sql('ord(x)', 0)} AS s,
            {_folded_sql('ord(x)', 1)} AS b FROM orders),
        w AS (SELECT *, CASE WHEN m * 10 % 10 <> m * 100 % 10 OR m * 100 % 10 <> 0 THEN
            CASE WHEN m * 100 % 10 = 0 THEN 1 ELSE 2 END ELSE CASE WHEN m % 1 = 0 THEN 0 ELSE 1 END END AS scale,
            (us // 1000000 << 30) | (us % 1000000 * 1000) AS ts FROM v),
        x AS (SELECT *, (m * 10 ** scale)::HUGEINT AS u, xor(o_custkey, o_custkey >> 32) AS k FROM w),
        h AS (SELECT o_orderkey, {_int32('xor(d, d >> 32)')} AS h_double, {_int32('f')} AS h_float,
            {_int32('31 * (u // 4294967296 * 31 + u % 4294967296)::HUGEINT + scale')} AS h_decimal,
            date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::INT AS h_date, {_int32('xor(ts, ts >> 32)')} AS h_timestamp,
            {_int32('b')} AS h_binary, {_int32('s')} AS s, k, {_int32('xor(d, d >> 32)')} AS d FROM x)
        SELECT o_orderkey, h_double, h_float, h_decimal, h_date, h_timestamp, h_binary,
            {_int32('s::BIGINT * 31 + s')} AS h_array, {_int32('xor(s::BIGINT, k) + xor(120, 1)')} AS h_map,
            {_int32('(k * 31 + s) * 31 + d')} AS h_struct FROM h"""),
    "sample_bucket_expression": query(
        lambda t: sampling.bucket_sample(t.orders, 2, 5, F.expr("cast(o_orderdate AS date)"), F.expr("o_custkey % 7")).select(
            "o_orderkey"),
        "SELECT o_orderkey FROM orders WHERE ((date_diff('day', DATE '1970-01-01', o_orderdate::DATE) * 31 + o_custkey % 7) "
        "& 2147483647) % 5 = 1"),
    "sample_percent": query(
        # Within five deviations of a tenth, and every row is one of the table.
        lambda t: sampling.percent_sample(t.lineitem, 10, seed=3).agg(
            F.count(F.lit(1)).alias("n"), F.min("l_orderkey").alias("k")).crossJoin(
            t.lineitem.agg(F.count(F.lit(1)).alias("rows"), F.min("l_orderkey").alias("least"))).select(
            "rows", (F.abs(F.col("n") - F.col("rows") / 10) < 1.5 * F.sqrt("rows")).alias("near"),
            (F.col("k") >= F.col("least")).alias("inside")),
        "SELECT count(*) AS rows, TRUE AS near, TRUE AS inside FROM lineitem"),
    "sample_rows_per_split": query(
        # Rows of each split: some, ten of each at most, all of them rows of the table.
        lambda t: sampling.row_sample(t.orders.withColumn("split", F.spark_partition_id()), 10).groupBy("split").agg(
            F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("d")).agg(
            (F.max("n") <= 10).alias("few"), (F.min("n") > 0).alias("some"), (F.sum("n") == F.sum("d")).alias("differ")),
        "SELECT TRUE AS few, TRUE AS some, TRUE AS differ"),
    "sample_size": query(
        # A quarter of the table's bytes: within five deviations of a quarter of its rows, each a row of it.
        lambda t: sampling.size_sample(t.lineitem, f"{table_bytes(t.lineitem) // 4}B", seed=1).agg(
            F.count(F.lit(1)).alias("n"), F.min("l_orderkey").alias("k")).crossJoin(
            t.lineitem.agg(F.count(F.lit(1)).alias("rows"), F.min("l_orderkey").alias("least"))).select(
            "rows", (F.abs(F.col("n") - F.col("rows") / 4) < 2.2 * F.sqrt("rows")).alias("near"),
            (F.col("k") >= F.col("least")).alias("inside")),
        "SELECT count(*) AS rows, TRUE AS near, TRUE AS inside FROM lineitem"),
}

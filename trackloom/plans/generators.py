"""Table functions, lateral views, macros and scripts."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from trackloom.functions import scalar as fn
from trackloom.functions import tables
from trackloom.operators import ordered
from trackloom.plans.registry import Query, Tables, query, same_sql, single
from trackloom.session import checkpoint_folder


def both(spark_text: str, sql: str) -> Query:
    return Query(same_sql(spark_text).run, sql)


def _macro(t: Tables):
    tables.create_macro(t.spark, "net_price", "price DOUBLE, discount DOUBLE", "price * (1 - discount)")
    return t.sql("SELECT l_returnflag, net_price(l_extendedprice, l_discount) AS net FROM {lineitem}").select(
        "l_returnflag", single("net").alias("net"))


def _second_largest(t: Tables):
    # Inside a function, so that it travels to the tasks by value.
    def two_largest(*values):
        """The two largest distinct values, None where there is none."""
        top = sorted({v for v in values if v is not None}, reverse=True)[:2]
        return tuple(top + [None] * (2 - len(top)))

    return tables.user_aggregate(
        t.lineitem, ["l_returnflag", "l_linestatus"], "l_partkey", lambda: (None, None),
        lambda s, v: two_largest(*s, v), lambda s, o: two_largest(*s, *o), lambda s: s[1], "second bigint")


def _sessions(t: Tables):
    """Number the visits of each user: a new one begins after half an hour without an event."""
    def visits(key, batches):
        last, visit = None, 1
        for batch in batches:
            at = batch["at"].to_numpy()
            late = np.diff(at, prepend=at[0] if last is None else last) > 1_800_000_000
            visit, numbers = visit + int(late.sum()), visit + np.cumsum(late)
            last = at[-1]
            yield pa.RecordBatch.from_arrays([batch["event_id"], pa.array(numbers, pa.int64())], ["event_id", "visit"])

    events = t.events.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return tables.partition_stream(events, ["user_id"], ["at", "event_id"], visits, "event_id bigint, visit bigint")


def _in_file(t: Tables):
    path = f"{checkpoint_folder(t.spark)}/lines-{uuid.uuid4().hex}"
    t.customer.filter("c_nationkey = 3").select("c_name").write.text(path)
    return tables.in_file(t.customer, "c_name", path).select("c_custkey", "in_file")


QUERIES: dict[str, Query] = {
    "generate_explode": both(
        "SELECT vec_id, CAST(x AS DOUBLE) AS x FROM {embeddings} LATERAL VIEW explode(embedding) e AS x",
        "SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings"),
    "generate_explode_words": both(
        "SELECT word, count(*) AS n FROM (SELECT explode(split(text, ' ')) AS word FROM {documents}) GROUP BY word",
        "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY word"),
    "generate_explode_outer": both(
        "SELECT doc_id, x FROM {labels} LATERAL VIEW OUTER explode(CASE WHEN quality = 1 THEN array(1, 2) END) e AS x",
        "SELECT doc_id, unnest(CASE WHEN quality = 1 THEN [1, 2] ELSE [CAST(NULL AS INT)] END) AS x FROM labels"),
    "generate_posexplode": both(
        "SELECT vec_id, p, CAST(x AS DOUBLE) AS x FROM {embeddings} LATERAL VIEW posexplode(embedding) e AS p, x",
        "SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS p, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings"),
    "generate_explode_map": both(
        "SELECT n_nationkey, k, v FROM {nation} LATERAL VIEW explode(map('key', n_nationkey, 'region', n_regionkey)) e AS k, v",
        "SELECT n_nationkey, 'key' AS k, n_nationkey AS v FROM nation UNION ALL SELECT n_nationkey, 'region', n_regionkey FROM nation"),
    "generate_inline": both(
        "SELECT n_nationkey, a, b FROM {nation} LATERAL VIEW inline(array(named_struct('s', n_name, 'i', 1), named_struct('s', 'x', 'i', n_regionkey))) e AS a, b",
        "SELECT n_nationkey, n_name AS a, 1 AS b FROM nation UNION ALL SELECT n_nationkey, 'x', n_regionkey FROM nation"),
    "generate_stack": both(
        "SELECT s_suppkey, k, v FROM {supplier} LATERAL VIEW stack(2, 'name', s_name, 'nation', CAST(s_nationkey AS STRING)) e AS k, v",
        "SELECT s_suppkey, 'name' AS k, s_name AS v FROM supplier UNION ALL SELECT s_suppkey, 'nation', CAST(s_nationkey AS VARCHAR) FROM supplier"),
    "generate_json_tuple": both(
        "SELECT event_id, k, z FROM {events} LATERAL VIEW json_tuple(props, 'k', 'z') j AS k, z",
        "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.z') AS z FROM events"),
    "generate_parse_url_tuple": query(
        lambda t: t.pages.select("page_id", fn.parse_url_tuple("url", "HOST", "PROTOCOL", "QUERY:ref").alias("u")).select(
            "page_id", "u.*"),
        "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS c0, regexp_extract(url, '^([a-z]+):', 1) AS c1, "
        "nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') AS c2 FROM pages"),
    "generate_two_lateral_views": both(
        "SELECT n_nationkey, x, y FROM {nation} LATERAL VIEW explode(array(1, 2, 3)) a AS x LATERAL VIEW explode(array(x, x * n_regionkey)) b AS y",
        "SELECT n_nationkey, x, unnest([x, x * n_regionkey]) AS y FROM (SELECT n_nationkey, n_regionkey, unnest([1, 2, 3]) AS x FROM nation)"),
    "generate_column_list_alias": both(
        "SELECT stack(2, n_nationkey, n_name, n_regionkey, 'region') AS (a, b) FROM {nation}",
        "SELECT n_nationkey AS a, n_name AS b FROM nation UNION ALL SELECT n_regionkey, 'region' FROM nation"),
    "function_macro": query(
        _macro, "SELECT l_returnflag, CAST(CAST(l_extendedprice * (1 - l_discount) AS FLOAT) AS DOUBLE) AS net FROM lineitem"),
    "function_transform_script": both(
        "SELECT TRANSFORM(n_nationkey, n_name) USING 'cat' AS (k STRING, name STRING) FROM {nation}",
        "SELECT CAST(n_nationkey AS VARCHAR) AS k, n_name AS name FROM nation"),
    # Words are cut by one script, sorted by Spark and counted by another as they stream by.
    "function_reduce_script": both(
        "SELECT CAST(regexp_extract(line, '^ *([0-9]+) ', 1) AS BIGINT) AS n, regexp_extract(line, '^ *[0-9]+ (.*)$', 1) AS word FROM "
        "(FROM (FROM (FROM {part} MAP p_name USING 'tr \" \" \"\\n\"' AS (word STRING)) SELECT word CLUSTER BY word) "
        "REDUCE word USING 'uniq -c' AS (line STRING))",
        "SELECT count(*) AS n, word FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word"),
    # Separators of the caller's own on both sides of the script.
    "function_script_formats": both(
        "SELECT k, name FROM (FROM (SELECT c_custkey, c_name FROM {customer} DISTRIBUTE BY c_nationkey SORT BY c_custkey) "
        "REDUCE c_custkey, c_name ROW FORMAT DELIMITED FIELDS TERMINATED BY '|' USING 'tr \"|\" \",\"' AS (k BIGINT, name STRING) "
        "ROW FORMAT DELIMITED FIELDS TERMINATED BY ',')",
        "SELECT c_custkey AS k, c_name AS name FROM customer"),
    "function_partition_stream": query(
        _sessions,
        "SELECT event_id, CAST(1 + sum(late) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS visit FROM "
        "(SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1800000000 "
        "THEN 1 ELSE 0 END AS late FROM events)"),
    "function_in_file": query(
        _in_file, "SELECT c_custkey, c_nationkey = 3 AS in_file FROM customer"),
    "function_user_aggregate": query(
        _second_largest,
        "SELECT l_returnflag, l_linestatus, (list_sort(list(DISTINCT l_partkey), 'DESC'))[2] AS second FROM lineitem "
        "GROUP BY l_returnflag, l_linestatus"),
    "function_pandas_scalar": query(
        lambda t: t.events.select("event_id", F.pandas_udf(lambda v: v.clip(upper=50.0), "double")("value").alias("v")),
        "SELECT event_id, least(value, 50.0) AS v FROM events"),
    "function_map_batches": query(
        lambda t: tables.map_batches(
            t.events.select("event_id", "value"),
            lambda batch: batch.assign(value=batch["value"].clip(upper=50.0)), "event_id bigint, value double"),
        "SELECT event_id, least(value, 50.0) AS value FROM events"),
    "function_table_explode": query(
        lambda t: (t.spark.udtf.register("pair_up", tables.Explode2), t.sql(
            "SELECT n_nationkey, p.a, p.b FROM {nation}, LATERAL pair_up(array(n_nationkey, n_regionkey)) p"))[1],
        "SELECT n_nationkey, n_nationkey AS a, n_nationkey AS b FROM nation UNION ALL "
        "SELECT n_nationkey, n_regionkey, n_regionkey FROM nation"),
    "function_table_count": query(
        lambda t: (t.spark.udtf.register("count_twice", tables.Count2), t.sql(
            "SELECT c.count FROM count_twice(TABLE(SELECT n_regionkey, n_nationkey FROM {nation}) PARTITION BY n_regionkey) c"
            .replace("SELECT n_regionkey, n_nationkey", "SELECT n_nationkey AS value, n_regionkey")))[1],
        "SELECT CAST(unnest([n, n]) AS INT) AS count FROM (SELECT count(*) AS n FROM nation GROUP BY n_regionkey)"),
    "function_row_sequence": query(
        # Consecutive numbers over a whole table, which no single task holds.
        lambda t: ordered.row_numbers(
            t.orders.select("o_orderkey", "o_custkey"), [], ["o_orderkey"], "row_sequence").select(
            "o_orderkey", F.col("row_sequence").cast("bigint").alias("row_sequence")),
        "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS row_sequence FROM orders"),
    "function_array_sum": query(
        lambda t: t.embeddings.select("vec_id", F.aggregate(
            F.transform("embedding", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x).cast("float").cast("double").alias("s")),
        "SELECT vec_id, CAST(CAST(list_sum(CAST(embedding AS DOUBLE[])) AS FLOAT) AS DOUBLE) AS s FROM embeddings"),
    "function_map_concat": query(
        lambda t: t.nation.select("n_nationkey", F.map_concat(
            F.create_map(F.lit("a"), F.col("n_nationkey")), F.create_map(F.lit("a"), F.col("n_regionkey"))).alias("m")).select(
            "n_nationkey", F.col("m")["a"].alias("a")),
        "SELECT n_nationkey, n_regionkey AS a FROM nation"),
    "function_struct_print": query(
        lambda t: t.nation.select("n_nationkey", F.to_json(F.struct("n_name", "n_regionkey")).alias("j")),
        "SELECT n_nationkey, '{\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}' AS j FROM nation"),
}

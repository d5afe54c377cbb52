"""Grouping, multi-dimensional grouping and aggregate functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import aggregates as ag
from trackloom.functions import sketches, text_stats
from trackloom.operators.grouping import grouping_id
from trackloom.operators.quantiles import percentiles
from trackloom.plans.registry import Query, query, same_sql, single

_MONEY = "CAST(sum(CAST({c} AS DECIMAL(12,2))) AS DOUBLE)"


def money(column: str) -> str:
    """A sum of cents that does not depend on the order of the rows."""
    return _MONEY.format(c=column)


def _single(name: str) -> str:
    return f"CAST(CAST({name} AS FLOAT) AS DOUBLE)"


QUERIES: dict[str, Query] = {
    "agg_pricing_summary": same_sql(
        "SELECT l_returnflag, l_linestatus, "
        f"{money('l_quantity')} AS sum_qty, {money('l_extendedprice')} AS sum_price, "
        f"{_single('sum(l_extendedprice * (1 - l_discount))')} AS sum_disc_price, "
        f"{_single('avg(l_quantity)')} AS avg_qty, {_single('avg(l_discount)')} AS avg_disc, count(*) AS n "
        "FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '2000-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus"),
    "agg_distinct_rows": same_sql("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM {lineitem}"),
    "agg_count_distinct": same_sql(
        "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, "
        "count(*) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi FROM {lineitem} GROUP BY l_returnflag"),
    "agg_sum_distinct": same_sql(
        "SELECT l_linestatus, sum(DISTINCT l_quantity) AS s, count(DISTINCT l_quantity) AS c FROM {lineitem} "
        "GROUP BY l_linestatus"),
    "agg_having": same_sql(
        "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 15"),
    "agg_expression_key": same_sql(
        "SELECT o_custkey % 7 AS k, CAST(year(o_orderdate) AS BIGINT) AS y, count(*) AS n FROM {orders} "
        "GROUP BY o_custkey % 7, year(o_orderdate)"),
    "agg_by_position": same_sql(
        "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY 1, 2"),
    "agg_global": same_sql(
        f"SELECT count(*) AS n, count(c_mktsegment) AS m, {money('c_acctbal')} AS total, "
        "min(c_name) AS lo, max(c_name) AS hi FROM {customer}"),
    "agg_filtered_case": same_sql(
        "SELECT o_orderpriority, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS f, "
        "CAST(sum(CASE WHEN o_orderstatus = 'O' THEN o_custkey END) AS BIGINT) AS o FROM {orders} "
        "GROUP BY o_orderpriority"),
    "agg_cube": same_sql(
        "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)"),
    "agg_rollup": same_sql(
        "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM {lineitem} "
        "GROUP BY ROLLUP (l_returnflag, l_linestatus, l_linenumber)"),
    "agg_cube_distinct": same_sql(
        "SELECT l_returnflag, l_linestatus, count(DISTINCT l_suppkey) AS n FROM {lineitem} "
        "GROUP BY CUBE (l_returnflag, l_linestatus)"),
    "agg_grouping_sets": same_sql(
        "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} "
        "GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())"),
    "agg_grouping_sets_expression": same_sql(
        "SELECT o_custkey % 3 + o_orderkey % 2 AS k, count(*) AS n FROM {orders} "
        "GROUP BY GROUPING SETS ((o_custkey % 3 + o_orderkey % 2), ())"),
    "agg_grouping_id_present_bits": query(
        lambda t: t.lineitem.cube("l_returnflag", "l_linestatus", "l_linenumber").agg(
            grouping_id(["l_returnflag", "l_linestatus", "l_linenumber"]).alias("present"),
            F.count(F.lit(1)).alias("n")),
        "SELECT l_returnflag, l_linestatus, l_linenumber, CAST((1 - grouping(l_returnflag)) "
        "+ 2 * (1 - grouping(l_linestatus)) + 4 * (1 - grouping(l_linenumber)) AS INT) AS present, "
        "count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus, l_linenumber)"),
    "agg_moments": query(
        lambda t: t.lineitem.groupBy("l_returnflag").agg(
            single(ag.stddev("l_quantity")).alias("std"),
            single(ag.variance("l_quantity")).alias("variance"),
            single(ag.stddev_samp("l_quantity")).alias("stddev_samp"),
            single(ag.var_samp("l_extendedprice")).alias("var_samp")),
        f"SELECT l_returnflag, {_single('stddev_pop(l_quantity)')} AS std, "
        f"{_single('var_pop(l_quantity)')} AS variance, {_single('stddev_samp(l_quantity)')} AS stddev_samp, "
        f"{_single('var_samp(l_extendedprice)')} AS var_samp FROM lineitem GROUP BY l_returnflag"),
    "agg_sample_moments_single_row": query(
        lambda t: t.lineitem.groupBy("l_partkey", "l_suppkey").agg(
            single(ag.stddev_samp("l_quantity")).alias("s"), single(ag.var_samp("l_quantity")).alias("v")),
        f"SELECT l_partkey, l_suppkey, {_single('coalesce(stddev_samp(l_quantity), 0)')} AS s, "
        f"{_single('coalesce(var_samp(l_quantity), 0)')} AS v FROM lineitem GROUP BY l_partkey, l_suppkey"),
    "agg_covariance": same_sql(
        f"SELECT l_linestatus, {_single('covar_pop(l_quantity, l_extendedprice)')} AS cp, "
        f"{_single('covar_samp(l_quantity, l_extendedprice)')} AS cs, "
        f"{_single('corr(l_quantity, l_extendedprice)')} AS r FROM "
        "{lineitem} GROUP BY l_linestatus"),
    "agg_percentile": query(
        lambda t: percentiles(t.lineitem, ["l_returnflag"], "l_partkey", [0.5, 0.9]).join(
            percentiles(t.lineitem, ["l_returnflag"], "l_linenumber", [0.25]).select(
                "l_returnflag", F.col("percentiles")[0].alias("p25")), "l_returnflag").select(
            "l_returnflag", single(F.col("percentiles")[0]).alias("p50"),
            single(F.col("percentiles")[1]).alias("p90"), single("p25").alias("p25")),
        f"SELECT l_returnflag, {_single('quantile_cont(l_partkey, 0.5)')} AS p50, "
        f"{_single('quantile_cont(l_partkey, 0.9)')} AS p90, "
        f"{_single('quantile_cont(l_linenumber, 0.25)')} AS p25 FROM lineitem GROUP BY l_returnflag"),
    "agg_percentile_large_groups": query(
        lambda t: percentiles(t.lineitem, ["l_returnflag"], "l_partkey", [0.05, 0.5, 0.9]).select(
            "l_returnflag", *[single(F.col("percentiles")[i]).alias(f"p{i}") for i in range(3)]),
        f"SELECT l_returnflag, {_single('quantile_cont(l_partkey, 0.05)')} AS p0, "
        f"{_single('quantile_cont(l_partkey, 0.5)')} AS p1, {_single('quantile_cont(l_partkey, 0.9)')} AS p2 "
        "FROM lineitem GROUP BY l_returnflag"),
    "agg_percentile_null_groups": query(
        lambda t: percentiles(
            t.lineitem.select("l_linenumber", F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice")).alias("v")),
            ["l_linenumber"], "v", [0.3]).select("l_linenumber", single(F.col("percentiles")[0]).alias("p")),
        f"SELECT l_linenumber, {_single('quantile_cont(CASE WHEN l_linenumber <> 3 THEN l_extendedprice END, 0.3)')} AS p "
        "FROM lineitem GROUP BY l_linenumber"),
    # Sketches: the answer is an estimate, so the values have no SQL counterpart.
    "agg_percentile_approx": query(
        # The rank of each answer is within a thousandth of the fraction asked for.
        lambda t: t.lineitem.join(t.lineitem.groupBy("l_returnflag").agg(
            F.percentile_approx("l_extendedprice", [0.1, 0.5, 0.9], 10000).alias("p")), "l_returnflag").groupBy(
            "l_returnflag").agg(F.count(F.lit(1)).alias("n"), *[
                (F.abs(F.avg((F.col("l_extendedprice") <= F.col("p")[i]).cast("int")) - f) <= 0.001
                 + 1 / F.count(F.lit(1))).alias(f"near{i}") for i, f in enumerate((0.1, 0.5, 0.9))]),
        "SELECT l_returnflag, count(*) AS n, TRUE AS near0, TRUE AS near1, TRUE AS near2 FROM lineitem GROUP BY l_returnflag"),
    "agg_histogram_numeric": query(
        # Ten bins at most, in order, that hold every row.
        lambda t: t.lineitem.groupBy("l_returnflag").agg(
            F.histogram_numeric("l_quantity", F.lit(10)).alias("h")).select(
            "l_returnflag", (F.size("h") <= 10).alias("few"),
            F.aggregate("h", F.lit(0.0), lambda n, b: n + b["y"]).cast("bigint").alias("n"),
            (F.array_sort("h") == F.col("h")).alias("sorted")),
        "SELECT l_returnflag, TRUE AS few, count(*) AS n, TRUE AS sorted FROM lineitem GROUP BY l_returnflag"),
    "agg_approx_distinct": query(
        # Three deviations of 2 % around the exact number.
        # Beside an exact count in one aggregate, each key would carry registers of its own.
        lambda t: t.lineitem.agg(F.approx_count_distinct("l_partkey", 0.02).alias("about")).crossJoin(
            t.lineitem.agg(F.count_distinct("l_partkey").alias("n"))).select(
            (F.abs(F.col("about") / F.col("n") - 1) < 0.06).alias("near"), "n"),
        "SELECT TRUE AS near, count(DISTINCT l_partkey) AS n FROM lineitem"),
    "agg_collect_set": query(
        lambda t: t.lineitem.groupBy("l_returnflag").agg(
            F.array_join(ag.collect_set_sorted("l_linenumber"), ",").alias("numbers")),
        "SELECT l_returnflag, array_to_string(list_sort(list(DISTINCT l_linenumber)), ',') AS numbers "
        "FROM lineitem GROUP BY l_returnflag"),
    "agg_group_concat": query(
        lambda t: t.nation.groupBy("n_regionkey").agg(ag.group_concat("n_name").alias("names")),
        "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "agg_max_n": query(
        lambda t: ag.top_n(t.orders.select("o_orderpriority", "o_orderkey"), ["o_orderpriority"],
                           "o_orderkey", 5).select(
            "o_orderpriority", F.array_join("top", ",").alias("top")),
        "SELECT o_orderpriority, array_to_string((list(o_orderkey ORDER BY o_orderkey DESC))[1:5], ',') AS top "
        "FROM orders GROUP BY o_orderpriority"),
    "agg_min_n": query(
        lambda t: ag.top_n(t.orders.select("o_orderpriority", "o_orderkey"), ["o_orderpriority"],
                           "o_orderkey", 5, largest=False).select(
            "o_orderpriority", F.array_join("top", ",").alias("top")),
        "SELECT o_orderpriority, array_to_string((list(o_orderkey ORDER BY o_orderkey))[1:5], ',') AS top "
        "FROM orders GROUP BY o_orderpriority"),
    "agg_compute_stats_long": query(
        lambda t: ag.compute_stats(t.lineitem, "l_partkey", exact=True).select("stats.*"),
        "SELECT 'Long' AS columntype, min(l_partkey) AS min, max(l_partkey) AS max, "
        "count(*) FILTER (l_partkey IS NULL) AS countnulls, count(DISTINCT l_partkey) AS numdistinctvalues "
        "FROM lineitem"),
    "agg_compute_stats_double": query(
        lambda t: ag.compute_stats(t.lineitem, "l_quantity", exact=True).select("stats.*"),
        "SELECT 'Double' AS columntype, min(l_quantity) AS min, max(l_quantity) AS max, "
        "count(*) FILTER (l_quantity IS NULL) AS countnulls, count(DISTINCT l_quantity) AS numdistinctvalues "
        "FROM lineitem"),
    "agg_compute_stats_string": query(
        lambda t: ag.compute_stats(t.part, "p_name", exact=True).select("stats.*"),
        "SELECT 'String' AS columntype, CAST(max(length(p_name)) AS INT) AS maxlength, "
        "avg(length(p_name)) AS avglength, count(*) FILTER (p_name IS NULL) AS countnulls, "
        "count(DISTINCT p_name) AS numdistinctvalues FROM part"),
    "agg_compute_stats_boolean": query(
        lambda t: ag.compute_stats(t.labels.select((F.col("toxic") == 1).alias("b")), "b").select("stats.*"),
        "SELECT 'Boolean' AS columntype, count(*) FILTER (toxic = 1) AS counttrues, "
        "count(*) FILTER (toxic <> 1) AS countfalses, count(*) FILTER (toxic IS NULL) AS countnulls FROM labels"),
    "agg_compute_stats_binary": query(
        lambda t: ag.compute_stats(t.documents.select(F.encode("text", "utf-8").alias("b")), "b").select("stats.*"),
        "SELECT 'Binary' AS columntype, CAST(max(octet_length(encode(text))) AS INT) AS maxlength, "
        "avg(octet_length(encode(text))) AS avglength, count(*) FILTER (text IS NULL) AS countnulls FROM documents"),
    "agg_compute_stats_estimated": query(
        lambda t: ag.compute_stats(t.lineitem, "l_partkey").select("stats.*").crossJoin(
            t.lineitem.agg(F.count_distinct("l_partkey").alias("exact"))).select(
            "columntype", "min", "max", "countnulls",
            (F.abs(F.col("numdistinctvalues") / F.col("exact") - 1) < 0.2).alias("near")),
        "SELECT 'Long' AS columntype, min(l_partkey) AS min, max(l_partkey) AS max, "
        "count(*) FILTER (l_partkey IS NULL) AS countnulls, TRUE AS near FROM lineitem"),
}

_WORDS_SQL = (
    "w AS (SELECT regexp_extract_all(lower({column}), '[a-z]+') AS words FROM {table})"
)


def _words(t, table: str, column: str, *keep: str):
    """Whole texts as one word list each; words are runs of Latin letters."""
    return getattr(t, table).select(*keep, F.array(F.expr(
        f"filter(split(lower({column}), '[^a-z]+'), x -> x <> '')")).alias("sentences"))


for _n in (1, 2, 3):
    QUERIES[f"agg_ngrams_{_n}"] = query(
        lambda t, n=_n: text_stats.ngrams(_words(t, "documents", "text"), "sentences", n, 20).select(
            F.array_join("ngram", " ").alias("ngram"), "estfrequency"),
        f"WITH {_WORDS_SQL.format(column='text', table='documents')}, "
        f"p AS (SELECT words, unnest(range(1, len(words) - {_n} + 2)) AS i FROM w), "
        f"g AS (SELECT words[i:i + {_n - 1}] AS ngram, count(*) AS c FROM p GROUP BY ALL), "
        "r AS (SELECT ngram, c FROM g ORDER BY c DESC, ngram LIMIT 20) "
        "SELECT array_to_string(ngram, ' ') AS ngram, CAST(c AS DOUBLE) AS estfrequency FROM r")
QUERIES["agg_context_ngrams"] = query(
    lambda t: text_stats.context_ngrams(
        _words(t, "documents", "text"), "sentences", ["the", None, None], 20).select(
        F.array_join("ngram", " ").alias("ngram"), "estfrequency"),
    f"WITH {_WORDS_SQL.format(column='text', table='documents')}, "
    "p AS (SELECT words, unnest(range(1, len(words) - 1)) AS i FROM w), "
    "g AS (SELECT words[i + 1:i + 2] AS ngram, count(*) AS c FROM p WHERE words[i] = 'the' GROUP BY ALL), "
    "r AS (SELECT ngram, c FROM g ORDER BY c DESC, ngram LIMIT 20) "
    "SELECT array_to_string(ngram, ' ') AS ngram, CAST(c AS DOUBLE) AS estfrequency FROM r")
# Spark's own sentence and word boundaries have no SQL counterpart; how often one word
# occurs after another is at most how often it occurs.
QUERIES["agg_ngrams_of_sentences"] = query(
    lambda t: text_stats.ngrams(
        t.documents.select(F.sentences(F.lower("text"), F.lit("en"), F.lit("US")).alias("s")), "s", 2, 20).crossJoin(
        text_stats.ngrams(_words(t, "documents", "text"), "sentences", 1, 1).select(F.col("estfrequency").alias("most"))).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.size("ngram") == 2).alias("pairs"),
        F.min(F.col("estfrequency") <= F.col("most")).alias("bounded"), F.max("most").alias("most")),
    f"WITH {_WORDS_SQL.format(column='text', table='documents')}, u AS (SELECT unnest(words) AS word FROM w), "
    "c AS (SELECT count(*) AS n FROM u GROUP BY word) "
    "SELECT 20 AS n, TRUE AS pairs, TRUE AS bounded, CAST(max(n) AS DOUBLE) AS most FROM c")
# States per priority, merged: the estimate is within four standard errors of the exact number.
QUERIES["agg_ndv_merged"] = query(
    lambda t: sketches.merged_stats(sketches.stats_state(t.orders, "o_custkey", ["o_orderpriority"])).crossJoin(
        t.orders.agg(F.count_distinct("o_custkey").alias("exact"))).select(
        "rows", "nulls", "least", "largest", (F.abs(F.col("ndv") / F.col("exact") - 1) < 0.065).alias("near")),
    "SELECT count(*) AS rows, count(*) FILTER (o_custkey IS NULL) AS nulls, min(o_custkey) AS least, "
    "max(o_custkey) AS largest, TRUE AS near FROM orders")
# States per language, merged: each of the most frequent bigrams is found, its count inside the bounds.
QUERIES["agg_ngrams_estimated"] = query(
    lambda t: text_stats.ngrams(_words(t, "documents", "text"), "sentences", 2, 20).join(
        sketches.merged_ngrams(sketches.ngram_state(
            _words(t, "documents", "text", "lang"), "sentences", 2, ["lang"]), 1000).select(
            "ngram", F.col("estfrequency").alias("most"), "least"), "ngram", "left").select(
        F.array_join("ngram", " ").alias("ngram"), "estfrequency",
        F.coalesce(F.col("estfrequency").between(F.col("least"), F.col("most")), F.lit(False)).alias("inside")),
    QUERIES["agg_ngrams_2"].sql.replace("AS estfrequency FROM r", "AS estfrequency, TRUE AS inside FROM r"))

"""Scalar functions, one query per family, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import bitmaps
from trackloom.functions import scalar as fn
from trackloom.plans.registry import Query, query, same_sql, single


def both(spark_text: str, sql: str) -> Query:
    return Query(same_sql(spark_text).run, sql)


def _single(text: str) -> str:
    return f"CAST(CAST({text} AS FLOAT) AS DOUBLE)"


_S = _single

QUERIES: dict[str, Query] = {
    "scalar_arithmetic": both(
        "SELECT o_orderkey, o_custkey + o_orderkey AS a, o_custkey - o_orderkey AS s, o_custkey * 3 AS m, "
        "o_custkey / 7 AS d, o_custkey % 7 AS r, o_custkey div 7 AS q, negative(o_custkey) AS n, positive(o_custkey) AS p, "
        "o_custkey & 12 AS ba, o_custkey | 3 AS bo, o_custkey ^ 5 AS bx, ~o_custkey AS bn FROM {orders}",
        "SELECT o_orderkey, o_custkey + o_orderkey AS a, o_custkey - o_orderkey AS s, o_custkey * 3 AS m, "
        "o_custkey / 7 AS d, o_custkey % 7 AS r, o_custkey // 7 AS q, -o_custkey AS n, +o_custkey AS p, "
        "o_custkey & 12 AS ba, o_custkey | 3 AS bo, xor(o_custkey, 5) AS bx, ~o_custkey AS bn FROM orders"),
    "scalar_divide_by_zero": query(
        lambda t: t.labels.select(
            "doc_id", fn.divide("quality", "toxic").cast("string").alias("d"),
            fn.long_divide("doc_id", "toxic").alias("q")),
        "SELECT doc_id, CASE WHEN toxic <> 0 THEN CAST(quality / toxic AS VARCHAR) WHEN quality > 0 THEN 'Infinity' "
        "ELSE 'NaN' END AS d, CASE WHEN toxic <> 0 THEN doc_id // toxic END AS q FROM labels"),
    "scalar_comparisons": both(
        "SELECT doc_id, k = 1 AS e, k == 1 AS e2, k <=> NULL AS ns, k <> 0 AS ne, k != 0 AS ne2, k < 1 AS lt, k <= 1 AS le, "
        "k > 0 AS gt, k >= 1 AS ge, k = 1 AND toxic = 1 AS a, k = 1 OR toxic = 1 AS o, NOT (k = 1) AS n, !(k = 1) AS n2, "
        "isnull(k) AS isn, isnotnull(k) AS inn, k BETWEEN 0 AND 1 AS b, k NOT BETWEEN 1 AND 2 AS nb "
        "FROM (SELECT doc_id, nullif(quality, 0) AS k, toxic FROM {labels})",
        "SELECT doc_id, k = 1 AS e, k = 1 AS e2, k IS NOT DISTINCT FROM NULL AS ns, k <> 0 AS ne, k != 0 AS ne2, k < 1 AS lt, "
        "k <= 1 AS le, k > 0 AS gt, k >= 1 AS ge, k = 1 AND toxic = 1 AS a, k = 1 OR toxic = 1 AS o, NOT (k = 1) AS n, "
        "NOT (k = 1) AS n2, k IS NULL AS isn, k IS NOT NULL AS inn, k BETWEEN 0 AND 1 AS b, k NOT BETWEEN 1 AND 2 AS nb "
        "FROM (SELECT doc_id, nullif(quality, 0) AS k, toxic FROM labels)"),
    "scalar_mixed_type_comparison": both(
        "SELECT c_custkey, substr(c_name, 10) = c_custkey AS e, substr(c_name, 10) > 500 AS g FROM {customer}",
        "SELECT c_custkey, CAST(substr(c_name, 10) AS BIGINT) = c_custkey AS e, "
        "CAST(substr(c_name, 10) AS BIGINT) > 500 AS g FROM customer"),
    "scalar_pattern_predicates": both(
        "SELECT p_partkey, p_name LIKE '%ring' AS l, p_name NOT LIKE 's%' AS nl, p_name RLIKE '^s.*g$' AS r, "
        "p_name REGEXP 'w[ie]' AS x FROM {part}",
        "SELECT p_partkey, p_name LIKE '%ring' AS l, p_name NOT LIKE 's%' AS nl, regexp_matches(p_name, '^s.*g$') AS r, "
        "regexp_matches(p_name, 'w[ie]') AS x FROM part"),
    "scalar_conditionals": both(
        "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS c, "
        "CASE WHEN o_totalprice > 100000 THEN 'big' WHEN o_totalprice > 50000 THEN 'mid' END AS w, "
        "if(o_orderstatus = 'F', o_custkey, 0) AS i, coalesce(nullif(o_orderstatus, 'F'), 'none') AS co, "
        "nvl(nullif(o_orderstatus, 'O'), 'x') AS nv, assert_true(o_orderkey >= 0) IS NULL AS at FROM {orders}",
        "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS c, "
        "CASE WHEN o_totalprice > 100000 THEN 'big' WHEN o_totalprice > 50000 THEN 'mid' END AS w, "
        "if(o_orderstatus = 'F', o_custkey, 0) AS i, coalesce(nullif(o_orderstatus, 'F'), 'none') AS co, "
        "coalesce(nullif(o_orderstatus, 'O'), 'x') AS nv, o_orderkey >= 0 AS \"at\" FROM orders"),
    "scalar_rounding": both(
        "SELECT event_id, abs(value - 50) AS a, CAST(ceil(value) AS BIGINT) AS c, CAST(ceiling(value) AS BIGINT) AS c2, "
        "CAST(floor(value) AS BIGINT) AS f, "
        "round(CAST(value AS DECIMAL(12, 2)), 1) AS r, round(CAST(value AS DECIMAL(12, 2))) AS r0, "
        "sign(value - 50) AS s FROM {events}",
        "SELECT event_id, abs(value - 50) AS a, CAST(ceil(value) AS BIGINT) AS c, CAST(ceil(value) AS BIGINT) AS c2, "
        "CAST(floor(value) AS BIGINT) AS f, CAST(round(CAST(value AS DECIMAL(12, 2)), 1) AS DECIMAL(12, 1)) AS r, "
        "CAST(round(CAST(value AS DECIMAL(12, 2))) AS DECIMAL(11, 0)) AS r0, CAST(sign(value - 50) AS DOUBLE) AS s FROM events"),
    "scalar_powers": same_sql(
        f"SELECT event_id, {_S('exp(value / 100)')} AS e, {_S('ln(value + 1)')} AS l, {_S('log2(value + 1)')} AS l2, "
        f"{_S('log10(value + 1)')} AS l10, {_S('power(value, 2)')} AS p, {_S('pow(value, 0.5)')} AS p2 "
        "FROM {events}"),
    "scalar_guarded_roots": query(
        lambda t: t.events.select(
            "event_id", single(fn.sqrt(F.col("value") - 50)).alias("r"),
            single(fn.log(3, F.col("value") - 10)).alias("l"), fn.log(0.5, F.col("value")).alias("n")),
        f"SELECT event_id, CASE WHEN value >= 50 THEN {_S('sqrt(greatest(value - 50, 0))')} END AS r, "
        f"CASE WHEN value > 10 THEN {_S('ln(CASE WHEN value > 10 THEN value - 10 END) / ln(3)')} END AS l, "
        "CAST(NULL AS DOUBLE) AS n FROM events"),
    "scalar_trigonometry": same_sql(
        f"SELECT event_id, {_S('sin(value)')} AS s, {_S('cos(value)')} AS c, {_S('tan(value / 1000)')} AS t, "
        f"{_S('asin(event_id / 100000000)')} AS si, {_S('acos(event_id / 100000000)')} AS ci, {_S('atan(value)')} AS ti, "
        f"{_S('degrees(value)')} AS d, {_S('radians(value)')} AS r, {_S('pi()')} AS p FROM " "{events}"),
    "scalar_constants": both(
        f"SELECT n_nationkey, {_S('e()')} AS e, {_S('pi()')} AS p FROM " "{nation}",
        f"SELECT n_nationkey, {_S('exp(1)')} AS e, {_S('pi()')} AS p FROM nation"),
    "scalar_modulo": both(
        "SELECT o_orderkey, pmod(o_custkey - 500, 7) AS p, pmod(-o_orderkey, 5) AS q FROM {orders}",
        "SELECT o_orderkey, ((o_custkey - 500) % 7 + 7) % 7 AS p, ((-o_orderkey) % 5 + 5) % 5 AS q FROM orders"),
    "scalar_number_bases": query(
        lambda t: t.customer.select(
            "c_custkey", F.bin("c_custkey").alias("b"), F.hex("c_custkey").alias("h"),
            F.hex("c_mktsegment").alias("hs"), fn.unhex(F.hex("c_mktsegment")).alias("u"),
            F.conv(F.col("c_custkey").cast("string"), 10, 16).alias("c")),
        "SELECT c_custkey, bin(c_custkey) AS b, hex(c_custkey) AS h, hex(c_mktsegment) AS hs, "
        "c_mktsegment AS u, hex(c_custkey) AS c FROM customer"),
    "scalar_format_number": both(
        "SELECT o_orderkey, format_number(o_custkey * 1234, 0) AS f, printf('%s-%05d', o_orderstatus, o_custkey) AS p FROM {orders}",
        "SELECT o_orderkey, format('{:,}', o_custkey * 1234) AS f, printf('%s-%05d', o_orderstatus, o_custkey) AS p FROM orders"),
    "scalar_random": same_sql("SELECT count(*) AS n FROM (SELECT rand(7) AS r FROM {orders}) WHERE r >= 0 AND r < 1")._replace(
        sql="SELECT count(*) AS n FROM orders"),
    "scalar_text_basic": same_sql(
        "SELECT c_custkey, ascii(c_mktsegment) AS a, concat(c_name, '/', c_mktsegment) AS c, concat_ws('-', c_name, c_mktsegment) AS cw, "
        "lower(c_mktsegment) AS l, upper(c_name) AS u, lcase(c_name) AS l2, ucase(c_name) AS u2, "
        "CAST(length(c_name) AS BIGINT) AS n, reverse(c_name) AS r, repeat(c_mktsegment, 2) AS rp, "
        "lpad(c_mktsegment, 12, '*') AS lp, rpad(c_mktsegment, 12, '*') AS rpd, trim(concat('  ', c_name, ' ')) AS t, "
        "ltrim(concat('  ', c_name)) AS lt, rtrim(concat(c_name, '  ')) AS rt, translate(c_name, 'uso', 'xyz') AS tr "
        "FROM {customer}")._replace(sql=(
        "SELECT c_custkey, ascii(c_mktsegment) AS a, concat(c_name, '/', c_mktsegment) AS c, concat_ws('-', c_name, c_mktsegment) AS cw, "
        "lower(c_mktsegment) AS l, upper(c_name) AS u, lcase(c_name) AS l2, ucase(c_name) AS u2, "
        "length(c_name) AS n, reverse(c_name) AS r, repeat(c_mktsegment, 2) AS rp, "
        "lpad(c_mktsegment, 12, '*') AS lp, rpad(c_mktsegment, 12, '*') AS rpd, trim(concat('  ', c_name, ' ')) AS t, "
        "ltrim(concat('  ', c_name)) AS lt, rtrim(concat(c_name, '  ')) AS rt, translate(c_name, 'uso', 'xyz') AS tr "
        "FROM customer")),
    "scalar_text_search": query(
        lambda t: t.part.select(
            "p_partkey", F.instr("p_name", "ing").alias("i"), F.locate("i", F.col("p_name"), 5).alias("l"),
            F.find_in_set(F.col("p_type"), F.lit("SMALL,PROMO,LARGE")).alias("fs"),
            fn.field("p_type", F.lit("SMALL"), F.lit("PROMO"), F.lit("LARGE")).alias("f"),
            F.elt(F.lit(2), F.col("p_name"), F.col("p_type")).alias("e"),
            F.concat(F.col("p_name"), F.call_function("space", F.lit(3)), F.col("p_type")).alias("s")),
        "SELECT p_partkey, CAST(instr(p_name, 'ing') AS INT) AS i, "
        "CAST(CASE WHEN instr(substr(p_name, 5), 'i') = 0 THEN 0 ELSE instr(substr(p_name, 5), 'i') + 4 END AS INT) AS l, "
        "CASE p_type WHEN 'SMALL' THEN 1 WHEN 'PROMO' THEN 2 WHEN 'LARGE' THEN 3 ELSE 0 END AS fs, "
        "CASE p_type WHEN 'SMALL' THEN 1 WHEN 'PROMO' THEN 2 WHEN 'LARGE' THEN 3 ELSE 0 END AS f, "
        "p_type AS e, p_name || '   ' || p_type AS s FROM part"),
    "scalar_substr": query(
        lambda t: t.part.select(
            "p_partkey", fn.substr("p_name", 3, 4).alias("a"), fn.substr("p_name", -4).alias("b"),
            fn.substr("p_type", 6).alias("c"), fn.substr("p_type", -6, 2).alias("d"),
            fn.substr("p_type", 0, 3).alias("e")),
        "SELECT p_partkey, substr(p_name, 3, 4) AS a, right(p_name, 4) AS b, "
        "CASE WHEN length(p_type) < 6 THEN '' ELSE substr(p_type, 6) END AS c, "
        "CASE WHEN length(p_type) < 6 THEN '' ELSE substr(p_type, length(p_type) - 5, 2) END AS d, "
        "substr(p_type, 1, 3) AS e FROM part"),
    "scalar_split": query(
        lambda t: t.documents.select(
            "doc_id", F.size(fn.split("text", "\n")).alias("lines"),
            F.array_join(fn.split(F.concat(F.col("source"), F.lit(",,b,,")), ","), "|").alias("s"),
            F.size(fn.split(F.lit(",,"), ",")).alias("none"), F.size(fn.split(F.lit(""), ",")).alias("one")),
        "SELECT doc_id, CAST(len(string_split(regexp_replace(text, '\\n+$', ''), chr(10))) AS INT) AS lines, "
        "source || '||b' AS s, 0 AS \"none\", 1 AS one FROM documents"),
    "scalar_regexp": both(
        "SELECT page_id, regexp_extract(url, '^([a-z]+)://([^/]+)/', 2) AS h, regexp_replace(url, '[0-9]+', '#') AS r FROM {pages}",
        "SELECT page_id, regexp_extract(url, '^([a-z]+)://([^/]+)/', 2) AS h, regexp_replace(url, '[0-9]+', '#', 'g') AS r FROM pages"),
    "scalar_parse_url": query(
        lambda t: t.pages.select(
            "page_id", F.parse_url("url", F.lit("HOST")).alias("h"), F.parse_url("url", F.lit("PATH")).alias("p"),
            F.parse_url("url", F.lit("PROTOCOL")).alias("pr"), F.parse_url("url", F.lit("QUERY")).alias("q"),
            F.parse_url("url", F.lit("REF")).alias("rf"), F.parse_url("url", F.lit("QUERY"), F.lit("page")).alias("k")),
        "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS h, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS p, "
        "regexp_extract(url, '^([a-z]+):', 1) AS pr, nullif(regexp_extract(url, '\\?([^#]*)', 1), '') AS q, "
        "nullif(regexp_extract(url, '#(.*)$', 1), '') AS rf, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS k FROM pages"),
    "scalar_sentences": query(
        lambda t: t.documents.select(
            "doc_id", F.sentences("text", F.lit("en"), F.lit("US")).alias("s")).select(
            "doc_id", (F.size("s") > 0).alias("some"),
            # Where sentences and words end is Spark's own rule; their Latin letters are the text's.
            F.md5(F.regexp_replace(F.array_join(F.flatten("s"), ""), "[^A-Za-z]", "")).alias("letters")),
        "SELECT doc_id, TRUE AS some, md5(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters FROM documents"),
    "scalar_concat_ws_arrays": query(
        lambda t: t.labels.select("doc_id", fn.concat_ws_array(
            "+", F.array(F.col("doc_id").cast("string"), F.nullif(F.col("quality"), F.lit(0)).cast("string"))).alias("c")),
        "SELECT doc_id, CAST(doc_id AS VARCHAR) || '+' || CASE WHEN quality = 0 THEN 'null' ELSE CAST(quality AS VARCHAR) END AS c FROM labels"),
    "scalar_reflect": query(
        lambda t: t.customer.select(
            "c_custkey", F.call_function("reflect", F.lit("java.lang.Math"), F.lit("max"), F.col("c_nationkey"), F.lit(7)).alias("m"),
            F.java_method(F.lit("java.lang.Integer"), F.lit("toHexString"), F.col("c_nationkey")).alias("j"),
            fn.reflect2("c_name", "length").alias("l"), fn.reflect2("c_name", "endsWith", F.lit("7")).alias("e"),
            fn.reflect2("c_name", "indexOf", F.lit("#")).alias("i")),
        "SELECT c_custkey, CAST(greatest(c_nationkey, 7) AS VARCHAR) AS m, lower(hex(c_nationkey)) AS j, "
        "CAST(length(c_name) AS INT) AS l, c_name LIKE '%7' AS e, CAST(instr(c_name, '#') - 1 AS INT) AS i FROM customer"),
    "scalar_date_parts": same_sql(
        "SELECT event_id, CAST(year(ts) AS BIGINT) AS y, CAST(month(ts) AS BIGINT) AS m, CAST(day(ts) AS BIGINT) AS d, "
        "CAST(dayofmonth(ts) AS BIGINT) AS dm, CAST(hour(ts) AS BIGINT) AS h, CAST(minute(ts) AS BIGINT) AS mi, "
        "CAST(second(ts) AS BIGINT) AS s, CAST(weekofyear(ts) AS BIGINT) AS w FROM {events}"),
    "scalar_lenient_date_parts": query(
        lambda t: t.orders.select("o_orderkey", F.format_string(
            "2008-%d-%d", F.col("o_orderkey") % 15 + 1, F.col("o_orderkey") % 40 + 1).alias("d")).select(
            "o_orderkey", fn.year("d").alias("y"), fn.month("d").alias("m"), fn.day("d").alias("day"),
            fn.weekofyear("d").alias("w")),
        "SELECT o_orderkey, CAST(year(d) AS INT) AS y, CAST(month(d) AS INT) AS m, CAST(day(d) AS INT) AS day, "
        "CAST(weekofyear(d) AS INT) AS w FROM (SELECT o_orderkey, CAST(DATE '2008-01-01' + to_months(CAST(o_orderkey % 15 AS INT)) "
        "AS DATE) + CAST(o_orderkey % 40 AS INT) AS d FROM orders)"),
    "scalar_date_arithmetic": query(
        lambda t: t.orders.select(
            "o_orderkey", fn.to_date("o_orderdate").alias("d"), fn.date_add("o_orderdate", 40).alias("a"),
            fn.date_sub("o_orderdate", 40).alias("s"), fn.datediff("o_orderdate", F.lit("1995-01-01")).alias("n"),
            fn.date_add(F.date_format("o_orderdate", "yyyy-02-30"), 0).alias("lenient")),
        "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate + INTERVAL 40 DAY, '%Y-%m-%d') AS a, "
        "strftime(o_orderdate - INTERVAL 40 DAY, '%Y-%m-%d') AS s, "
        "CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INT) AS n, "
        "strftime(make_date(year(o_orderdate), 2, 1) + INTERVAL 29 DAY, '%Y-%m-%d') AS lenient FROM orders"),
    "scalar_unix_time": query(
        lambda t: t.events.select(
            "event_id", F.unix_timestamp(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("u"),
            F.to_unix_timestamp(F.date_format("ts", "yyyy-MM-dd"), F.lit("yyyy-MM-dd")).alias("d"),
            fn.from_unixtime(F.unix_timestamp(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))).alias("f"),
            F.date_format(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Asia/Tokyo"), "yyyy-MM-dd HH:mm:ss").alias("jp"),
            F.date_format(F.to_utc_timestamp(F.col("ts").cast("timestamp"), "Asia/Tokyo"), "yyyy-MM-dd HH:mm:ss").alias("utc")),
        "SELECT event_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS u, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS d, "
        "strftime(ts, '%Y-%m-%d %H:%M:%S') AS f, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS jp, "
        "strftime(ts - INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS utc FROM events"),
    "scalar_casts": query(
        lambda t: t.customer.select(
            "c_custkey", F.substring("c_name", 10, 20).try_cast("int").alias("i"), F.col("c_name").try_cast("int").alias("bad"),
            F.col("c_nationkey").cast("tinyint").cast("int").alias("t"), F.col("c_nationkey").cast("smallint").cast("int").alias("sm"),
            F.substring("c_name", 10, 20).try_cast("bigint").alias("b"), F.col("c_custkey").cast("string").alias("s"),
            F.col("c_acctbal").cast("float").cast("double").alias("f"), F.col("c_custkey").cast("double").alias("d"),
            fn.to_decimal("c_custkey", 2).cast("string").alias("dec"),
            F.lit("1998-02-03").cast("date").cast("string").alias("dt"),
            F.date_format(F.lit("1998-02-03 04:05:06").cast("timestamp"), "yyyyMMddHHmmss").alias("ts"),
            F.hex(F.col("c_mktsegment").cast("binary")).alias("bin")),
        "SELECT c_custkey, CAST(substr(c_name, 10) AS INT) AS i, TRY_CAST(c_name AS INT) AS bad, c_nationkey AS t, c_nationkey AS sm, "
        "CAST(substr(c_name, 10) AS BIGINT) AS b, CAST(c_custkey AS VARCHAR) AS s, CAST(CAST(c_acctbal AS FLOAT) AS DOUBLE) AS f, "
        "CAST(c_custkey AS DOUBLE) AS d, CAST(c_custkey AS VARCHAR) || '.00' AS dec, '1998-02-03' AS dt, '19980203040506' AS ts, "
        "hex(c_mktsegment) AS bin FROM customer"),
    "scalar_cast_boolean": query(
        lambda t: t.documents.select(
            "doc_id", fn.string_to_boolean(F.lit("false")).alias("f"), fn.string_to_boolean(F.nullif("lang", F.lit("en"))).alias("l"),
            fn.string_to_boolean(F.regexp_replace("lang", "^de$", "")).alias("e"), F.col("n_chars").cast("boolean").alias("n")),
        "SELECT doc_id, true AS f, length(nullif(lang, 'en')) > 0 AS l, lang <> 'de' AS e, n_chars <> 0 AS n FROM documents"),
    "scalar_collections": query(
        lambda t: t.embeddings.select(
            "vec_id", F.size("embedding").alias("n"), fn.index("embedding", F.lit(3)).cast("double").alias("i"),
            fn.index("embedding", F.lit(9999)).cast("double").alias("out"),
            fn.array_contains("embedding", F.col("embedding")[0]).alias("c"),
            F.sort_array("embedding")[0].cast("double").alias("lo"),
            fn.size(F.when(F.col("vec_id") < 0, F.col("embedding"))).alias("none")),
        "SELECT vec_id, CAST(len(embedding) AS INT) AS n, CAST(embedding[4] AS DOUBLE) AS i, CAST(embedding[10000] AS DOUBLE) AS \"out\", "
        "true AS c, CAST(list_min(embedding) AS DOUBLE) AS lo, -1 AS \"none\" FROM embeddings"),
    "scalar_index_of_map": query(
        lambda t: t.customer.select("c_custkey", F.create_map(
            F.col("c_mktsegment"), F.col("c_nationkey"), F.lit("key"), F.col("c_nationkey") + 100).alias("m")).select(
            "c_custkey", fn.index("m", F.lit("MACHINERY"), of_map=True).alias("segment"),
            fn.index("m", F.lit("key"), of_map=True).alias("k")),
        "SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN c_nationkey END AS segment, c_nationkey + 100 AS k FROM customer"),
    "scalar_format_number_decimals": both(
        "SELECT o_orderkey, format_number(o_totalprice, 2) AS two, format_number(-o_totalprice, 4) AS four FROM {orders}",
        "SELECT o_orderkey, format('{:,.2f}', o_totalprice) AS two, format('{:,.4f}', -o_totalprice) AS four FROM orders"),
    "scalar_bitmap_empty_groups": query(
        # Parts a supplier sold singly against parts sold in fifties: some blocks meet in no bit.
        lambda t: bitmaps.intersection(
            bitmaps.build(t.lineitem.filter("l_quantity = 1"), "l_partkey", ["l_suppkey"]),
            bitmaps.build(t.lineitem.filter("l_quantity = 50"), "l_partkey", ["l_suppkey"]), ["l_suppkey"]).select(
            "l_suppkey", "bucket", bitmaps.is_empty().alias("empty")),
        "WITH x AS (SELECT DISTINCT l_suppkey, l_partkey, l_quantity, CASE WHEN l_partkey > 0 THEN (l_partkey - 1) // 32768 + 1 "
        "ELSE 0 END AS bucket FROM lineitem WHERE l_quantity IN (1, 50)), k AS (SELECT l_suppkey, bucket FROM x "
        "GROUP BY ALL HAVING count(DISTINCT l_quantity) = 2), m AS (SELECT DISTINCT l_suppkey, bucket FROM (SELECT l_suppkey, "
        "bucket, l_partkey FROM x GROUP BY ALL HAVING count(*) = 2)) "
        "SELECT k.l_suppkey, k.bucket, m.bucket IS NULL AS empty FROM k LEFT JOIN m USING (l_suppkey, bucket)"),
    "scalar_maps_and_structs": query(
        lambda t: t.nation.select(
            "n_nationkey",
            F.create_map(F.lit("k"), F.col("n_nationkey"), F.lit("r"), F.col("n_regionkey")).alias("m"),
            F.str_to_map(F.concat(F.lit("a:1,b:"), F.col("n_name"), F.lit(",a:9")), F.lit(","), F.lit(":")).alias("s"),
            F.named_struct(F.lit("x"), F.col("n_name"), F.lit("y"), F.col("n_regionkey")).alias("st"),
            fn.create_union(F.col("n_nationkey") % 2, F.col("n_name"), F.col("n_regionkey")).alias("u"),
        ).select(
            "n_nationkey", F.col("m")["r"].alias("r"), F.array_join(F.map_keys("m"), ",").alias("ks"),
            F.array_join(F.map_values("m"), ",").alias("vs"), F.col("s")["b"].alias("b"), F.col("s")["a"].alias("a"),
            F.col("st.x").alias("x"), F.col("u.tag").alias("tag"), F.col("u.f0").alias("f0"), F.col("u.f1").alias("f1"),
            F.size("m").alias("n")),
        "SELECT n_nationkey, n_regionkey AS r, 'k,r' AS ks, n_nationkey || ',' || n_regionkey AS vs, n_name AS b, '9' AS a, n_name AS x, "
        "n_nationkey % 2 AS tag, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS f0, CASE WHEN n_nationkey % 2 = 1 THEN n_regionkey END AS f1, "
        "2 AS n FROM nation"),
    "scalar_json": both(
        "SELECT event_id, get_json_object(props, '$.k') AS k, get_json_object(props, '$.missing') AS m FROM {events}",
        "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.missing') AS m FROM events"),
    "scalar_xpath": both(
        "SELECT c_custkey, xpath_string(x, 'a/n') AS s, xpath_int(x, 'a/k') AS i, xpath_long(x, 'a/k') AS l, CAST(xpath_short(x, 'a/t') AS INT) AS sh, "
        "xpath_double(x, 'a/k') AS d, xpath_number(x, 'a/k') AS nu, CAST(xpath_float(x, 'a/t') AS DOUBLE) AS f, "
        "xpath_boolean(x, 'a/k > 100') AS b, array_join(xpath(x, 'a/*/text()'), ',') AS p FROM (SELECT c_custkey, "
        "concat('<a><n>', c_name, '</n><k>', c_custkey, '</k><t>', c_nationkey, '</t></a>') AS x FROM {customer})",
        "SELECT c_custkey, c_name AS s, CAST(c_custkey AS INT) AS i, c_custkey AS l, c_nationkey AS sh, CAST(c_custkey AS DOUBLE) AS d, "
        "CAST(c_custkey AS DOUBLE) AS nu, CAST(c_nationkey AS DOUBLE) AS f, c_custkey > 100 AS b, "
        "c_name || ',' || c_custkey || ',' || c_nationkey AS p FROM customer"),
    "scalar_bitmaps": query(
        lambda t: bitmaps.cardinality(bitmaps.intersection(
            bitmaps.build(t.lineitem.filter("l_returnflag = 'A'"), "l_partkey"),
            bitmaps.build(t.lineitem.filter("l_returnflag = 'R'"), "l_partkey"))),
        "SELECT count(*) AS cardinality FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'A' "
        "INTERSECT SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R')"),
    "scalar_bitmap_union": query(
        lambda t: bitmaps.cardinality(bitmaps.union(
            bitmaps.build(t.lineitem.filter("l_returnflag = 'A'"), "l_suppkey", ["l_linestatus"]),
            bitmaps.build(t.lineitem.filter("l_returnflag = 'R'"), "l_suppkey", ["l_linestatus"]),
            ["l_linestatus"]), ["l_linestatus"]),
        "SELECT l_linestatus, count(DISTINCT l_suppkey) AS cardinality FROM lineitem WHERE l_returnflag IN ('A', 'R') "
        "GROUP BY l_linestatus"),
    "scalar_bitmap_empty": query(
        lambda t: bitmaps.build(t.lineitem, "l_partkey").select("bucket", bitmaps.is_empty().alias("empty")),
        "SELECT DISTINCT CASE WHEN l_partkey > 0 THEN (l_partkey - 1) // 32768 + 1 ELSE 0 END AS bucket, false AS empty FROM lineitem"),
}

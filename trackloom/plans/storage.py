"""Sources and sinks: whole tables written in a format and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trackloom.operators import sampling
from trackloom.plans.registry import Query, Tables, query
from trackloom.session import checkpoint_folder
from trackloom.sources import files, tables, text, tracks


def scratch(t: Tables) -> str:
    """A new folder that all executors share."""
    return f"{checkpoint_folder(t.spark)}/storage-{uuid.uuid4().hex}"


def _written(t: Tables, frame, write) -> str:
    path = scratch(t)
    write(frame, path)
    return path


def _blocks(t: Tables):
    """A quarter of a table of 16 files: whole files, as few as hold a quarter of the bytes."""
    path = scratch(t)
    t.lineitem.select("l_orderkey", "l_quantity").repartition(16).write.parquet(path)
    of_file = [F.col("_metadata.file_path").alias("file")]
    rows = t.spark.read.parquet(path).groupBy(*of_file).agg(F.count(F.lit(1)).alias("n"))
    drawn = sampling.block_sample(t.spark, path, 25, seed=3).groupBy(*of_file).agg(F.count(F.lit(1)).alias("m"))
    return rows.join(drawn, "file", "left").agg(
        F.sum("n").alias("rows"), F.count_if(F.col("m") > 0).between(1, 5).alias("few"),
        F.min(F.coalesce(F.col("m") == F.col("n"), F.lit(True))).alias("whole"))


_NESTED = ("n_nationkey int, n_name string, tags array<string>, codes map<string,int>, "
           "place struct<region:int,name:string>, missing double")


def _nested(t: Tables):
    return t.nation.select(
        "n_nationkey", "n_name", F.array(F.col("n_name"), F.lit("x")).alias("tags"),
        F.create_map(F.lit("k"), F.col("n_nationkey")).alias("codes"),
        F.struct(F.col("n_regionkey").alias("region"), F.col("n_name").alias("name")).alias("place"),
        F.lit(None).cast("double").alias("missing"))


def _flat(df):
    return df.select(
        "n_nationkey", "n_name", F.array_join("tags", "|").alias("tags"), F.col("codes")["k"].alias("k"),
        F.col("place.region").alias("region"), F.col("place.name").alias("name"),
        F.col("missing").isNull().alias("missing"))


_FLAT_SQL = ("SELECT n_nationkey, n_name, n_name || '|x' AS tags, n_nationkey AS k, n_regionkey AS region, "
             "n_name AS name, true AS missing FROM nation")


def _delimited(t: Tables):
    path = _written(t, _nested(t), lambda d, p: text.write_delimited(d, p, compression="gzip"))
    return _flat(text.read_delimited(t.spark, path, _NESTED))


_DEEP = "k bigint, maps array<map<string,int>>, lists map<string,array<string>>"


def _delimited_deep(t: Tables):
    """An array of maps and a map of arrays, each level with a separator of its own."""
    source = t.nation.select(
        F.col("n_nationkey").cast("bigint").alias("k"),
        F.array(F.create_map(F.lit("x"), "n_nationkey", F.lit("y"), "n_regionkey"), F.create_map(F.lit("z"), F.lit(7))).alias("maps"),
        F.create_map("n_name", F.array("n_name", F.lit("b")), F.lit("c"), F.array(F.lit("d"))).alias("lists"))
    path = _written(t, source, lambda d, p: text.write_delimited(d, p))
    back = text.read_delimited(t.spark, path, _DEEP)
    return back.select(
        "k", F.col("maps")[0]["x"].alias("x"), F.col("maps")[0]["y"].alias("y"), F.col("maps")[1]["z"].alias("z"),
        F.array_join(F.element_at("lists", F.map_keys("lists")[0]), "|").alias("first"), F.col("lists")["c"][0].alias("c"))


def _delimited_escaped(t: Tables):
    """Tabs, line breaks, backslashes and separators inside texts."""
    odd = F.concat("c_name", F.lit("\t1\n2\\3\r4\\N5\\\\n6,7:8"), "c_mktsegment")
    source = t.customer.select("c_custkey", odd.alias("odd"), F.array(odd, F.lit(None).cast("string")).alias("list"))
    path = _written(t, source, lambda d, p: text.write_delimited(
        d, p, fields="\t", items=",", keys=":", escape="\\"))
    back = text.read_delimited(t.spark, path, source.schema, fields="\t", items=",", keys=":", escape="\\")
    return back.select("c_custkey", "odd", F.col("list")[0].alias("first"), F.col("list")[1].alias("second"))


def _orc(t: Tables):
    path = _written(t, t.lineitem, lambda d, p: d.write.option("compression", "zlib").option(
        "orc.bloom.filter.columns", "l_orderkey").orc(p))
    return t.spark.read.schema(t.lineitem.schema).orc(path).filter("l_quantity > 45").select(
        "l_orderkey", "l_partkey", "l_extendedprice")


def _json(t: Tables):
    path = _written(t, t.events.select("event_id", "event_type", "value"), lambda d, p: d.write.json(p))
    return t.spark.read.schema("event_id bigint, event_type string, value double").json(path)


def _csv(t: Tables):
    path = _written(t, t.customer, lambda d, p: d.write.option("sep", "|").csv(p))
    return t.spark.read.schema(t.customer.schema).option("sep", "|").csv(path)


def _sequence(t: Tables):
    path = _written(t, t.customer, lambda d, p: files.write_sequence(d, "c_custkey", "c_name", p))
    return files.read_sequence(t.spark, path)


def _regex(t: Tables):
    line = F.concat_ws(" ", F.col("page_id").cast("string"), F.lit("-"), F.concat(F.lit("["), "url", F.lit("]")))
    path = _written(t, t.pages.select(line.alias("value")), lambda d, p: d.write.text(p))
    return text.read_regex(t.spark, path, r"^(\d+) (\S+) \[([a-z]+)://([^/]*)(.*)\]$",
                           ["id", "dash", "scheme", "host", "rest"])


def _base64(t: Tables):
    path = _written(t, t.documents.select(F.encode("text", "utf-8").alias("b")),
                    lambda d, p: text.write_base64(d, "b", p))
    return text.read_base64(t.spark, path).select(F.md5("value").alias("m"))


def _symlinks(t: Tables):
    one = _written(t, t.customer.filter("c_custkey % 2 = 0"), lambda d, p: d.write.parquet(p))
    two = _written(t, t.customer.filter("c_custkey % 2 = 1"), lambda d, p: d.write.parquet(p))
    links = _written(t, t.spark.createDataFrame([(one,), (two,)], "value string"), lambda d, p: d.write.text(p))
    return files.read_symlinks(t.spark, links, "parquet")


def _export(t: Tables):
    path = _written(t, t.orders, lambda d, p: tables.export_table(d, p, ["o_orderstatus"]))
    return tables.import_table(t.spark, path).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


def _multi_insert(t: Tables):
    columns = [F.col("o_orderkey"), F.col("o_totalprice")]
    out = tables.multi_insert(t.orders, scratch(t), {
        "large": (F.col("o_totalprice") > 100000, columns),
        "open": (F.col("o_orderstatus") == "O", columns),
        "never": (F.col("o_orderkey") < 0, columns)})
    labelled = [d.withColumn("branch", F.lit(n)) for n, d in out.items()]
    return labelled[0].unionByName(labelled[1]).unionByName(labelled[2])


def _dynamic_partitions(t: Tables):
    path = scratch(t)
    base = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    tables.insert_overwrite_partitions(base, path, ["o_orderstatus"])
    changed = base.filter("o_orderstatus = 'P'").withColumn("o_totalprice", F.lit(0.0))
    tables.insert_overwrite_partitions(changed, path, ["o_orderstatus"])
    return t.spark.read.parquet(path)


def _bucketed(t: Tables):
    name = uuid.uuid4().hex
    left = tables.save_bucketed(t.lineitem.select("l_orderkey", "l_quantity"), f"l_{name}", 8, ["l_orderkey"], scratch(t))
    right = tables.save_bucketed(t.orders.select("o_orderkey", "o_orderstatus"), f"o_{name}", 8, ["o_orderkey"], scratch(t))
    joined = left.join(right.hint("merge"), left.l_orderkey == right.o_orderkey)
    return joined.groupBy("o_orderstatus").agg(F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("n"))


def _ctas_view(t: Tables):
    name = uuid.uuid4().hex
    t.orders.createOrReplaceTempView(f"src_{name}")
    t.spark.sql(f"CREATE TABLE t_{name} USING parquet LOCATION '{scratch(t)}' AS "
                f"SELECT o_custkey, count(*) AS n FROM src_{name} GROUP BY o_custkey")
    t.spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW v_{name} AS SELECT o_custkey, n FROM t_{name} WHERE n > 5")
    return t.spark.sql(f"SELECT o_custkey, n FROM v_{name}")


def _insert_directory(t: Tables):
    path = scratch(t)
    t.part.createOrReplaceTempView("part_to_write")
    t.spark.sql(f"INSERT OVERWRITE DIRECTORY '{path}' USING parquet SELECT p_partkey, p_size FROM part_to_write WHERE p_size > 25")
    return t.spark.read.parquet(path)


def _load(t: Tables):
    files_path = _written(t, t.supplier, lambda d, p: d.write.orc(p))
    target = scratch(t)
    for overwrite in (False, True, False):
        tables.load_data(t.spark, files_path, target, "orc", t.supplier.schema, overwrite)
    return t.spark.read.parquet(target)


def _compact(t: Tables):
    small = _written(t, t.part.repartition(16), lambda d, p: d.write.parquet(p))
    target = scratch(t)
    files.compact(t.spark, small, target)
    return t.spark.read.parquet(target)


def _virtual_columns(t: Tables):
    return files.with_virtual_columns(t.lineitem.select("l_orderkey", "_metadata")).groupBy(
        F.regexp_extract("INPUT__FILE__NAME", "([^/]+)$", 1).alias("file")).agg(F.count(F.lit(1)).alias("n"))


def _table_statistics(t: Tables):
    name = f"stats_{uuid.uuid4().hex}"
    t.customer.write.option("path", scratch(t)).saveAsTable(name)
    t.spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR COLUMNS c_custkey, c_nationkey")
    described = t.spark.sql(f"DESCRIBE EXTENDED {name} c_nationkey")
    return described.filter(F.col("info_name").isin("min", "max", "num_nulls"))


def _partition_commands(t: Tables):
    name = f"parts_{uuid.uuid4().hex}"
    t.nation.write.partitionBy("n_regionkey").option("path", scratch(t)).saveAsTable(name)
    t.spark.sql(f"ALTER TABLE {name} DROP PARTITION (n_regionkey = 0)")
    return t.spark.sql(f"SHOW PARTITIONS {name}")


def _partitions_changed(t: Tables):
    """Partitions that appear in the folder are found; others are added, renamed and dropped."""
    name, path, aside = f"parts_{uuid.uuid4().hex}", scratch(t), scratch(t)
    rows = t.nation.select("n_nationkey", "n_regionkey")
    rows.filter("n_regionkey < 2").write.partitionBy("n_regionkey").option("path", path).saveAsTable(name)
    rows.filter("n_regionkey = 2").drop("n_regionkey").write.parquet(f"{path}/n_regionkey=2")
    rows.filter("n_regionkey = 3").drop("n_regionkey").write.parquet(aside)
    t.spark.sql(f"MSCK REPAIR TABLE {name}")
    t.spark.sql(f"ALTER TABLE {name} ADD PARTITION (n_regionkey = 3) LOCATION '{aside}'")
    t.spark.sql(f"ALTER TABLE {name} PARTITION (n_regionkey = 0) RENAME TO PARTITION (n_regionkey = 10)")
    t.spark.sql(f"ALTER TABLE {name} DROP PARTITION (n_regionkey = 1)")
    return t.spark.table(name)


def _access_log(t: Tables):
    """A line per page: its number as the request, sizes that are missing now and then."""
    line = F.format_string(
        'owner pages [01/Jan/2024:00:00:00 +0000] 10.0.0.1 - r%d REST.GET.OBJECT p/%d "GET %s HTTP/1.1" %d - %s %d 7 3 "-" "agent, one"',
        "page_id", "page_id", "url", F.col("page_id") % 5 * 100 + 100,
        F.when(F.col("page_id") % 4 == 0, F.lit("-")).otherwise(F.length("html").cast("string")), F.length("html"))
    path = _written(t, t.pages.select(line.alias("value")), lambda d, p: d.write.text(p))
    return text.read_access_log(t.spark, path, typed=True).select(
        "requestid", "operation", "rkey", "requesturi", "httpstatus", "bytessent", "objsize", "totaltime", "useragent")


def _json_values(t: Tables):
    source = t.nation.select(
        "n_nationkey", F.array("n_name", F.lit('q"x')).alias("names"),
        F.struct(F.col("n_regionkey").alias("region")).alias("place"), F.lit(None).cast("string").alias("none"))
    return t.spark.read.text(_written(t, source, lambda d, p: text.write_json_values(d, p, "|")))


def _binary(t: Tables):
    """Whole files: as many bytes as the texts and their line ends have."""
    path = _written(t, t.customer.select("c_name").repartition(4), lambda d, p: d.write.text(p))
    return files.read_binary(t.spark, path).agg(
        F.sum("length").alias("bytes"), F.sum(F.length("content")).cast("bigint").alias("content"))


def _sequence_nulls(t: Tables):
    source = t.customer.selectExpr("nullif(c_custkey % 7, 0) AS k", "IF(c_custkey % 5 = 0, NULL, c_name) AS v")
    return files.read_sequence(t.spark, _written(t, source, lambda d, p: files.write_sequence(d, "k", "v", p)))


def _peaks(t: Tables):
    from trackloom.plans.tracks import a_track

    source = a_track(t).select(
        "chr", "chrstart", "chrend", F.lit("peak").alias("name"), F.lit(5).alias("score"), F.lit("+").alias("strand"),
        "value", F.lit(-1.0).alias("p"), F.lit(0.5).alias("q"), F.lit(3).alias("peak"))
    return tracks.read_narrow_peaks(t.spark, _written(t, source, tracks.write_bed))


def _annotation(t: Tables):
    from trackloom.plans.tracks import a_track

    source = a_track(t).select(
        F.concat_ws("\t", "chr", F.lit("made"), F.lit("exon"), "chrstart", "chrend", F.lit("."), F.lit("-"), F.lit("."), F.concat(
            F.lit('gene_id "g'), F.col("chrstart"), F.lit('"; name "a b";'))).alias("value"))
    path = _written(t, source, lambda d, p: d.write.text(p))
    return tracks.read_annotation(t.spark, path).select("chr", "feature", "chrstart", "chrend", "strand", "attributes")


def _bed(t: Tables):
    from trackloom.plans.tracks import a_track

    path = _written(t, a_track(t), tracks.write_bed)
    return tracks.read_bed(t.spark, path)


QUERIES: dict[str, Query] = {
    "storage_bed": query(
        _bed, "SELECT 'chr' || (l_suppkey % 5 + 1) AS chr, l_orderkey * 10 + l_linenumber AS chrstart, "
        "l_orderkey * 10 + l_linenumber + CAST(l_quantity AS BIGINT) AS chrend, l_extendedprice / 1000 AS value "
        "FROM lineitem WHERE l_linestatus = 'O'"),
    "storage_peaks": query(
        _peaks, "SELECT 'chr' || (l_suppkey % 5 + 1) AS chr, l_orderkey * 10 + l_linenumber AS chrstart, "
        "l_orderkey * 10 + l_linenumber + CAST(l_quantity AS BIGINT) AS chrend, 'peak' AS name, 5 AS score, '+' AS strand, "
        "l_extendedprice / 1000 AS value, -1.0::DOUBLE AS p, 0.5::DOUBLE AS q, 3 AS peak FROM lineitem WHERE l_linestatus = 'O'"),
    "storage_annotation": query(
        _annotation, "SELECT 'chr' || (l_suppkey % 5 + 1) AS chr, 'exon' AS feature, l_orderkey * 10 + l_linenumber AS chrstart, "
        "l_orderkey * 10 + l_linenumber + CAST(l_quantity AS BIGINT) AS chrend, '-' AS strand, "
        "'gene_id \"g' || (l_orderkey * 10 + l_linenumber) || '\"; name \"a b\";' AS attributes FROM lineitem WHERE l_linestatus = 'O'"),
    "storage_access_log": query(
        _access_log, "SELECT 'r' || page_id AS requestid, 'REST.GET.OBJECT' AS operation, 'p/' || page_id AS rkey, "
        "'GET ' || url || ' HTTP/1.1' AS requesturi, page_id % 5 * 100 + 100 AS httpstatus, "
        "CASE WHEN page_id % 4 <> 0 THEN length(html) END AS bytessent, length(html) AS objsize, "
        "7::BIGINT AS totaltime, 'agent, one' AS useragent FROM pages"),
    "storage_json_values": query(
        _json_values, "SELECT n_nationkey || '|[\"' || n_name || '\",\"q\\\"x\"]|{\"region\":' || n_regionkey || '}|\\N' AS value FROM nation"),
    "storage_binary_files": query(
        _binary, "SELECT CAST(sum(length(c_name) + 1) AS BIGINT) AS bytes, CAST(sum(length(c_name) + 1) AS BIGINT) AS content FROM customer"),
    "storage_sequence_nulls": query(
        _sequence_nulls, "SELECT CAST(nullif(c_custkey % 7, 0) AS VARCHAR) AS key, CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS value "
        "FROM customer"),
    "storage_partitions_changed": query(
        _partitions_changed, "SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN 10 ELSE n_regionkey END AS n_regionkey FROM nation "
        "WHERE n_regionkey IN (0, 2, 3)"),
    "storage_delimited_nested": query(_delimited, _FLAT_SQL),
    "storage_delimited_deep": query(
        _delimited_deep,
        "SELECT CAST(n_nationkey AS BIGINT) AS k, n_nationkey AS x, n_regionkey AS y, 7 AS z, n_name || '|b' AS first, 'd' AS c "
        "FROM nation"),
    "storage_delimited_escaped": query(
        _delimited_escaped,
        "SELECT c_custkey, o AS odd, o AS first, CAST(NULL AS VARCHAR) AS second FROM (SELECT c_custkey, c_name || chr(9) || '1' "
        "|| chr(10) || '2\\3' || chr(13) || '4\\N5\\\\n6,7:8' || c_mktsegment AS o FROM customer)"),
    "storage_orc": query(_orc, "SELECT l_orderkey, l_partkey, l_extendedprice FROM lineitem WHERE l_quantity > 45"),
    "storage_json": query(_json, "SELECT event_id, event_type, value FROM events"),
    "storage_csv": query(_csv, "SELECT * FROM customer"),
    "storage_sequence_file": query(_sequence, "SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS value FROM customer"),
    "storage_regex_text": query(
        _regex, "SELECT CAST(page_id AS VARCHAR) AS id, '-' AS dash, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, "
        "regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]*(.*)$', 1) AS rest FROM pages"),
    "storage_base64_text": query(_base64, "SELECT md5(text) AS m FROM documents"),
    "storage_symlinks": query(_symlinks, "SELECT * FROM customer"),
    "storage_export_import": query(_export, "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"),
    "storage_multi_insert": query(
        _multi_insert, "SELECT o_orderkey, o_totalprice, 'large' AS branch FROM orders WHERE o_totalprice > 100000 "
        "UNION ALL SELECT o_orderkey, o_totalprice, 'open' FROM orders WHERE o_orderstatus = 'O'"),
    "storage_dynamic_partitions": query(
        _dynamic_partitions, "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 0.0 ELSE o_totalprice END AS o_totalprice, "
        "o_orderstatus FROM orders"),
    "storage_bucketed_join": query(
        _bucketed, "SELECT o_orderstatus, sum(l_quantity) AS q, count(*) AS n FROM lineitem JOIN orders "
        "ON l_orderkey = o_orderkey GROUP BY o_orderstatus"),
    "storage_ctas_and_view": query(
        _ctas_view, "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 5"),
    "storage_insert_directory": query(_insert_directory, "SELECT p_partkey, p_size FROM part WHERE p_size > 25"),
    "storage_load_data": query(_load, "SELECT * FROM supplier UNION ALL SELECT * FROM supplier"),
    "storage_compact": query(_compact, "SELECT * FROM part"),
    "storage_virtual_columns": query(_virtual_columns, "SELECT 'lineitem.parquet' AS file, count(*) AS n FROM lineitem"),
    "storage_table_statistics": query(
        _table_statistics, "SELECT 'min' AS info_name, CAST(min(c_nationkey) AS VARCHAR) AS info_value FROM customer UNION ALL "
        "SELECT 'max', CAST(max(c_nationkey) AS VARCHAR) FROM customer UNION ALL SELECT 'num_nulls', '0'"),
    "sample_percent_blocks": query(
        _blocks, "SELECT count(*) AS rows, TRUE AS few, TRUE AS whole FROM lineitem"),
    "storage_partition_commands": query(
        _partition_commands, "SELECT DISTINCT 'n_regionkey=' || n_regionkey AS partition FROM nation WHERE n_regionkey <> 0"),
}

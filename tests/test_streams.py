"""Functions over sorted partitions that pass as streams."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trackloom.functions.tables import partition_stream


def _numbered():
    """Rows numbered from 1 in the order they come, with the size of their batch."""
    def number(key, batches):
        seen = 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(np.arange(seen + 1, seen + n + 1)), pa.array([n] * n, pa.int64())],
                ["id", "at", "size"])
            seen += n

    return number


SCHEMA = "id bigint, at bigint, size bigint"


def test_one_key_with_a_million_rows_streams(spark):
    rows = spark.range(1_050_000).withColumn("k", F.when(F.col("id") >= 1_000_000, F.col("id") % 7).otherwise(-1))
    got = partition_stream(rows, ["k"], ["-id"], _numbered(), SCHEMA)
    hot = got.filter("id < 1000000").agg(
        F.count(F.lit(1)).alias("n"), F.max("at").alias("top"), F.max("size").alias("size"),
        F.count_if(F.col("at") != 1_000_000 - F.col("id")).alias("wrong")).first()
    assert (hot["n"], hot["top"], hot["wrong"]) == (1_000_000, 1_000_000, 0)
    assert hot["size"] <= int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))


def test_keys_with_nulls_nans_and_several_columns(spark):
    rows = spark.sql("SELECT id, IF(id % 5 = 0, NULL, id % 3) AS a, IF(id % 4 = 0, double('NaN'), 1D) AS b FROM range(10000)")
    got = partition_stream(rows, ["a", "b"], ["id"], _numbered(), SCHEMA).select("id", "at")
    want = rows.selectExpr("id", "row_number() OVER (PARTITION BY a, b ORDER BY id) AS at")
    assert got.exceptAll(want).count() == 0 and got.count() == 10000


def test_a_function_may_stop_early_and_sees_its_key(spark):
    def first_only(key, batches):
        head = next(batches)
        yield pa.RecordBatch.from_arrays([pa.array([key[0]]), head["id"].slice(0, 1)], ["k", "id"])

    rows = spark.range(50000).withColumn("k", F.concat(F.lit("k"), F.col("id") % 6))
    got = partition_stream(rows, ["k"], ["-id"], first_only, "k string, id bigint").collect()
    assert {tuple(r) for r in got} == {(f"k{n}", max(i for i in range(49990, 50000) if i % 6 == n)) for n in range(6)}


def test_empty_table_and_no_key(spark):
    empty = spark.range(0).withColumn("k", F.lit(1))
    assert partition_stream(empty, ["k"], ["id"], _numbered(), SCHEMA).count() == 0
    with pytest.raises(ValueError):
        partition_stream(empty, [], ["id"], _numbered(), SCHEMA)

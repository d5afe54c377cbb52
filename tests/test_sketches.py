"""Stored states and samples of whole files."""

import os
from collections import Counter

from pyspark.sql import functions as F

from trackloom.functions.sketches import merged_ngrams, merged_stats, ngram_state, stats_state
from trackloom.operators.sampling import block_sample


def test_a_new_partition_is_merged_into_stored_states(spark, tmp_path):
    rows = spark.range(40_000).select(
        F.when(F.col("id") % 100 != 0, F.col("id") % 9000).alias("v"), (F.col("id") % 4).alias("p"))
    path = str(tmp_path / "states")
    stats_state(rows.filter("p < 3"), "v", ["p"]).write.parquet(path)
    stats_state(rows.filter("p = 3"), "v", ["p"]).write.mode("append").parquet(path)
    got = merged_stats(spark.read.parquet(path)).first()
    assert (got.rows, got.nulls, got.least, got.largest) == (40_000, 400, 1, 8999)
    exact = rows.select("v").dropna().distinct().count()
    assert abs(got.ndv / exact - 1) < 0.065
    by_p = {r.p: r.rows for r in merged_stats(spark.read.parquet(path), ["p"]).collect()}
    assert by_p == {p: 10_000 for p in range(4)}


def test_states_of_other_types_and_of_no_rows(spark):
    frame = spark.sql("SELECT DATE '2020-01-01' AS d, 1.5D AS f, 'x' AS s, CAST(NULL AS INT) AS n")
    for column, ndv in (("d", 1), ("f", 1), ("s", 1), ("n", 0)):
        assert merged_stats(stats_state(frame, column)).first().ndv == ndv
    assert merged_stats(stats_state(frame.limit(0), "s")).first().ndv == 0


def test_counters_bound_the_true_counts(spark):
    # One n-gram in three is the same; the others are far more than there are counters.
    rows = spark.range(30_000).select(
        (F.col("id") % 5).alias("p"), F.array(F.when(F.col("id") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).when(
            F.col("id") % 3 == 1, F.array(F.lit("c"), (F.col("id") % 50).cast("string"))).otherwise(
            F.array(F.lit("d"), F.col("id").cast("string")))).alias("s"))
    true = Counter(tuple(r.s[0]) for r in rows.collect())
    got = merged_ngrams(ngram_state(rows, "s", 2, ["p"], tracked=300), 20, tracked=300).collect()
    assert len(got) == 20 and tuple(got[0].ngram) == ("a", "b")
    assert all(r.least <= true[tuple(r.ngram)] <= r.estfrequency for r in got)
    assert got[0].least > 9000


def test_only_drawn_files_are_opened(spark, tmp_path):
    path = str(tmp_path / "table")
    spark.range(8000).withColumn("p", F.col("id") % 2).repartition(8, F.col("id") % 8).write.partitionBy("p").parquet(path)
    total = len(spark.read.parquet(path).inputFiles())
    drawn = block_sample(spark, path, 30, seed=5)
    names = drawn.inputFiles()
    assert 1 <= len(names) < total and drawn.columns == ["id", "p"]
    # Files that were not drawn may even be unreadable.
    kept = {n.rsplit("/", 1)[1] for n in names}
    for folder, _, files in os.walk(path):
        for name in files:
            if name.endswith(".parquet") and name not in kept:
                with open(os.path.join(folder, name), "wb") as f:
                    f.write(b"x")
    assert 0 < drawn.count() < 8000 and drawn.filter("id % 2 != p").isEmpty()
    assert block_sample(spark, path, 0).count() == 0

"""Intervals before and behind others: pairs, counts, hot places and plans."""

import re

import pytest
from pyspark.sql import functions as F

from tests import brute
from trackloom.operators import half_lines, nodes, overlap

SCHEMA = "chr string, chrstart bigint, chrend bigint, value double"


@pytest.mark.parametrize("seed", [1, 2])
def test_counts_against_the_definition(spark, seed):
    a = brute.random_track(seed, 70, 300, 40, ["c1", "c2", "c3"]) + [(None, 4, 5, 1.0), ("c1", None, 9, 1.0)]
    b = brute.random_track(seed + 50, 60, 300, 90, ["c1", "c2", "c4"]) + [(None, 1, 2, 1.0), ("c1", 7, None, 1.0)]
    got = half_lines.precede_counts(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)).collect()

    def count(x, name):
        return sum(brute.LOCATION[name](x, y) for y in b if None not in x[:3] + y[:3] and x[0] == y[0])

    # An interval of b without an end still begins somewhere.
    open_ = [y for y in b if y[2] is None]
    want = []
    for x in a:
        known = None not in x[:3]
        more = sum(known and x[0] == y[0] and x[2] < y[1] for y in open_)
        if x[1] is None:
            more = sum(x[0] == y[0] and x[2] < y[1] for y in b if y[0] is not None and y[1] is not None)
        want.append((*x, count(x, "precedes") + more, count(x, "follows")))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


@pytest.mark.parametrize("name", ["precedes", "follows"])
def test_pairs_beyond_one_run_of_ranks(spark, name):
    """3000 beginnings, so that half lines are runs and a rest; every pair once."""
    many = spark.range(3000).select(
        F.lit("c").alias("chr"), (F.col("id") * 3 + 1).alias("chrstart"), (F.col("id") * 3 + 2).alias("chrend"))
    few = spark.createDataFrame([("c", p, p + 4) for p in (1, 2, 50, 3071, 3072, 3073, 6140, 8999, 9500)],
                                "chr string, chrstart bigint, chrend bigint")
    for a, b in ((few, many), (many, few)):
        pairs = overlap.location_join(a, b, name).select("a_chrstart", "a_chrend", "b_chrstart", "b_chrend").collect()
        x, y = ([tuple(r)[1:] for r in d.collect()] for d in (a, b))
        want = [(*p, *q) for p in x for q in y if brute.LOCATION[name]((0, *p), (0, *q))]
        assert sorted(map(tuple, pairs)) == sorted(want)


def test_every_rank_meets_its_half_line_once(spark):
    counts = spark.createDataFrame([(n,) for n in (1, 3, 4, 1023, 1024, 1025, 2048, 2600)], "n bigint")
    left = nodes.spread_prefix(counts.withColumn("chr", F.lit("c")), F.col("n"))
    right = nodes.spread_rank(spark.range(2700).withColumn("chr", F.lit("c")), F.col("id"))
    met = nodes.node_join(left, right).groupBy("n").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("ids"), F.max("id").alias("top"))
    assert {tuple(r) for r in met.collect()} == {(n, n, n, n - 1) for (n,) in counts.collect()}


def test_hot_place_and_empty_tracks(spark):
    """A third of both sides at one place: counts need one row for it, and no join is on the chromosome alone."""
    i = F.col("id")
    start = F.when(i % 3 == 0, F.lit(90000)).otherwise(i + 1)
    track = spark.range(60000).select(F.lit("c").alias("chr"), start.alias("chrstart"), (start + 2).alias("chrend"))
    total = half_lines.precede_counts(track, track).agg(F.sum("n_precedes").alias("p"), F.sum("n_follows").alias("f")).first()
    assert total["p"] == total["f"] > 20000 * 39000
    empty = track.limit(0)
    assert half_lines.precede_counts(track, empty).agg(F.sum("n_precedes")).first()[0] == 0
    assert half_lines.precede_counts(empty, track).count() == 0
    assert overlap.location_join(track, empty, "precedes").count() == 0
    named = track.withColumn("chr", F.concat(F.lit("c"), F.col("chrstart") % 3))
    plan = overlap.location_join(named, named, "precedes")._jdf.queryExecution().optimizedPlan().toString()
    joins = re.findall(r"Join Inner, (.*)", plan)
    assert joins and all("AND" in j for j in joins)

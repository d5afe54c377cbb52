"""Joins of tracks by cells: few rows are shuffled, and full cells are cut up."""

import random

import pytest
from pyspark.sql import functions as F

from trackloom.operators import nodes, overlap

SCHEMA = "chr string, chrstart bigint, chrend bigint, own bigint"


def track_rows(seed, n):
    draw = random.Random(seed)
    lengths = (0, 0, 1, 3, 20, 127, 128, 700, 5000)
    starts = [draw.choice((draw.randint(-400, 400), draw.randint(-9000, 9000), 5, 128)) for _ in range(n)]
    rows = [("c1" if draw.random() < .8 else "c2", s, s + draw.choice(lengths)) for s in starts]
    rows += [("c1", 100, 103)] * 5 + [("c1", 104, 106)] * 5 + [(None, 5, 9), ("c1", None, 9)]
    return [(*r, k) for k, r in enumerate(rows)]


def inside(x, lo, hi):
    return None not in (x, lo, hi) and lo <= x <= hi


@pytest.mark.parametrize("hot", [0, 2, 1024])
def test_pairs_are_those_of_brute_force(spark, monkeypatch, hot):
    """Every pair once, on all levels and in cells that are cut up or not."""
    monkeypatch.setattr(nodes, "HOT", hot)
    left, right = track_rows(1, 120), track_rows(2, 120)
    a, b = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)
    for reach in (0, 60):
        met = overlap.overlap_join(a, b, reach).select("a_own", "b_own").collect()
        wanted = [(x[3], y[3]) for x in left for y in right if x[0] == y[0] is not None and x[1] is not None is not y[1] and (
            inside(y[1], x[1] - reach, x[2] + reach) or inside(x[1] - reach, y[1] + 1, y[2]))]
        assert sorted(map(tuple, met)) == sorted(wanted) and len(wanted) > 300
    held = overlap.location_join(a, b, "contains").select("a_own", "b_own").collect()
    wanted = [(x[3], y[3]) for x in left for y in right
              if x[0] == y[0] is not None and inside(y[1], x[1], x[2]) and inside(y[2], x[1], x[2])]
    assert sorted(map(tuple, held)) == sorted(wanted) and wanted


def test_few_rows_are_shuffled(spark):
    """About one row per short interval on each side, where covers and ancestors had nine."""
    a = spark.range(4000).select(F.lit("c").alias("chr"), (F.col("id") * 5).alias("chrstart"),
                                 (F.col("id") * 5 + F.col("id") % 50).alias("chrend"), "id")
    lo, hi = F.col("chrstart"), F.col("chrend")
    used = nodes.cell_levels(a, lo, hi)
    for levels in nodes.overlap_cells(lo, hi, used, used):
        assert nodes.in_cells(a, lo, hi, *levels).count() < 1.3 * 4000


def test_intervals_without_an_end(spark):
    """They reach to the end of blocks as long as the longest interval of either track allows."""
    a = spark.createDataFrame([("c1", 3, None, 1), ("c1", 90, 93, 2)], SCHEMA)
    b = spark.createDataFrame([("c1", k, k + 3, k) for k in (5, 14, 16)], SCHEMA)
    assert sorted(r.b_own for r in overlap.overlap_join(a, b).collect()) == [5, 14]

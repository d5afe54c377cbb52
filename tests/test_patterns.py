"""Row patterns and their results against the definition, and joins with hot keys."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from trackloom.operators import patterns
from trackloom.operators.joins import hot_keys, skew_join, split_hot_keys

FOLDS = {"begun": "first", "ended": "last", "whole": "list", "total": "sum", "mean": "avg", "low": "min",
         "high": "max", "known": "count"}


def matches(rows):
    """UP+.DOWN*.UP on v of (k, at, v)."""
    for key in {r[0] for r in rows}:
        own = sorted(r[1:] for r in rows if r[0] == key)
        up = [v is not None and v > 3 for _, v in own]
        for i in range(len(own)):
            j = i
            while j < len(own) and up[j]:
                j += 1
            if j == i:
                continue
            while j < len(own) and own[j][1] is not None and own[j][1] <= 3:
                j += 1
            if j < len(own) and up[j]:
                yield key, i + 1, [v for _, v in own[i:j + 1]]


@pytest.mark.parametrize("seed", [1, 2])
def test_results_of_paths(spark, seed):
    generator = random.Random(seed)
    rows = [(generator.choice(("a", None)), k, generator.choice((None, 9, 9, 9, 1))) for k in range(150)]
    rows += [("long", k, 5 if k % 301 else 2) for k in range(600)]
    frame = spark.createDataFrame(rows, "k string, at long, v long").repartition(4)
    symbols = {"UP": F.col("v") > 3, "DOWN": F.col("v") <= 3}
    results = {n: (fold, F.col("v") * (10 if n == "begun" else 1)) for n, fold in FOLDS.items()}
    got = patterns.npath(frame, ["k"], ["at"], "UP+.DOWN*.UP", symbols, results).collect()
    expected = {}
    for key, place, values in matches(rows):
        known = [v for v in values if v is not None]
        expected[key, place] = (10 * values[0], values[-1], values, sum(known), sum(known) / len(known), min(known),
                                max(known), len(known))
    assert len(expected) > 300 and len(got) == len(expected)
    assert {(r.k, r.path_start): tuple(r[n] for n in FOLDS) for r in got} == expected
    assert all(r.path_size == len(r.whole) for r in got)


def test_unknown_result(spark):
    with pytest.raises(ValueError):
        patterns.npath(spark.range(3), ["id"], ["id"], "A", {"A": F.lit(True)}, {"x": ("median", F.col("id"))})


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_with_a_third_on_one_key(spark, how):
    generator = random.Random(8)
    key = lambda n: 5 if n % 3 == 0 else None if n % 7 == 0 else generator.randint(6, 900)
    left = spark.createDataFrame([(key(n), "x", n) for n in range(3000)], "k int, s string, l int")
    right = spark.createDataFrame([(key(n), "x", n) for n in range(300)], "k int, s string, r int")
    if how in ("inner", "left"):
        plain = left.join(right, ["k", "s"], how).select("k", "s", "l", "r")
        got = skew_join(left, right, ["k", "s"], how, share=0.05).select("k", "s", "l", "r")
    else:
        plain, got = left.join(right, ["k", "s"], how), skew_join(left, right, ["k", "s"], how, share=0.05)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)


def test_only_rows_of_hot_keys_are_copied(spark):
    left = spark.range(9000).selectExpr("CASE WHEN id % 3 = 0 THEN -1 ELSE id END AS k")
    right = spark.range(600).selectExpr("CASE WHEN id % 3 = 0 THEN -1 ELSE id END AS k")
    (hot,) = hot_keys(left, ["k"], 0.02).collect()
    dealt, repeated = split_hot_keys(left, right, ["k"], 0.02)
    # A third of the rows is 17 parts of a fiftieth.
    assert hot._splits in (17, 18) and dealt.count() == 9000
    assert repeated.count() == 400 + 200 * hot._splits
    sizes = collections.Counter(r["_salt"] for r in dealt.filter("k = -1").collect())
    assert len(sizes) == hot._splits and max(sizes.values()) < 3 * 3000 / hot._splits
    assert split_hot_keys(left.filter("k >= 0"), right, ["k"], 0.02)[1].count() == 600

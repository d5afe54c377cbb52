"""One place holding a third of all rows, and plans that must not gather it."""

import time

import pytest
from pyspark.sql import functions as F

from trackloom.operators import merge, nearest, overlap, project
from trackloom.operators.ordered import ranks, row_numbers
from trackloom.operators.quantiles import percentiles
from trackloom.plans import all_queries

N = 60000


def hot_track(spark, at, width):
    """A third of the rows are copies of one interval; the rest are spread out."""
    i = F.col("id")
    start = F.when(i % 3 == 0, F.lit(at)).otherwise(i * 7 + 1)
    return spark.range(N).select(
        F.lit("chr1").alias("chr"), start.alias("chrstart"),
        (start + F.when(i % 3 == 0, F.lit(width)).otherwise(i % 5)).alias("chrend"),
        F.lit(1.0).alias("value"))


def test_copies_next_to_each_other_make_no_candidates(spark):
    """20,000 copies of one interval beside 20,000 copies of another: no pair at all among them.

    A join on bins would compare 400 million pairs here.
    """
    a, b = hot_track(spark, 700001, 20), hot_track(spark, 700022, 20)
    begin = time.time()
    pairs = overlap.overlap_join(a, b)
    hot = pairs.filter((F.col("a_chrstart") == 700001) & (F.col("b_chrstart") == 700022)).count()
    assert hot == 0
    assert time.time() - begin < 60


def test_folds_over_copies(spark):
    a = hot_track(spark, 700001, 20)
    merged = merge.coalesce_track(a, "sum")
    assert merged.agg(F.sum("value")).first()[0] == N
    cut = merge.discretize(a, "sum")
    deepest = cut.agg(F.max("value")).first()[0]
    assert deepest == N / 3
    target = hot_track(spark, 700010, 5)
    value = project.project_on(a, target, "sum").filter("chrstart = 700010").first()["value"]
    assert value == N / 3
    assert overlap.exclusive_join(a, a).count() == 0


def test_nearest_with_copies(spark):
    a = hot_track(spark, 700001, 20).filter("chrstart < 600000")
    b = spark.createDataFrame([("chr1", 700100, 700110, 1.0)], a.schema)
    near = nearest.pair_closest(a, b)
    assert near.count() == a.count()
    assert near.agg(F.min("distance")).first()[0] == 700100 - a.agg(F.max("chrend")).first()[0]


def test_ranks_of_one_hot_key(spark):
    df = spark.range(N).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
        (F.col("id") % 1000).alias("v"), "id")
    from pyspark.sql import Window

    w = Window.partitionBy("k").orderBy("v")
    expected = df.select("k", "v", "id", F.rank().over(w).alias("rank"), F.dense_rank().over(w).alias("dense_rank"))
    got = ranks(df, ["k"], "v").select("k", "v", "id", "rank", "dense_rank")
    assert got.exceptAll(expected).count() == 0 and got.count() == N
    numbered = row_numbers(df, ["k"], ["v", "id"])
    same = df.select("k", "v", "id", F.row_number().over(Window.partitionBy("k").orderBy("v", "id")).alias("row_number"))
    assert numbered.exceptAll(same).count() == 0 and numbered.count() == N


def test_percentiles_of_one_hot_key(spark):
    df = spark.range(N).select((F.col("id") % 2 == 0).alias("k"), (F.col("id") * 37 % 100003).alias("v"))
    expected = {r["k"]: r["p"] for r in df.groupBy("k").agg(F.percentile("v", [0.1, 0.5, 0.99]).alias("p")).collect()}
    got = {r["k"]: r["percentiles"] for r in percentiles(df, ["k"], "v", [0.1, 0.5, 0.99]).collect()}
    for key, values in expected.items():
        assert got[key] == pytest.approx(values)


def test_null_keys_are_a_partition_of_their_own(spark):
    from pyspark.sql import Window

    from trackloom.operators.ordered import ntiles, partition_folds, range_folds, shifted
    from trackloom.operators.patterns import npath

    df = spark.range(200).select(F.when(F.col("id") % 4 > 0, F.col("id") % 4).alias("k"),
                                 (F.col("id") % 10).cast("int").alias("v"), "id")
    w = Window.partitionBy("k").orderBy("id")
    byv = Window.partitionBy("k").orderBy("v")

    def same(got, *expected):
        want = df.select("k", "v", "id", *expected)
        assert got.select(want.columns).exceptAll(want).count() == 0 and got.count() == 200

    same(row_numbers(df, ["k"], ["id"]), F.row_number().over(w).cast("bigint").alias("row_number"))
    same(ranks(df, ["k"], "v"), F.rank().over(byv).cast("bigint").alias("rank"), F.cume_dist().over(byv).alias("cume_dist"))
    same(ntiles(df, ["k"], ["id"], 7), F.ntile(7).over(w).alias("ntile"))
    same(shifted(df, ["k"], ["id"], {"b": ("v", 1), "a": ("v", -3)}), F.lag("v").over(w).alias("b"), F.lead("v", 3).over(w).alias("a"))
    same(partition_folds(df, ["k"], {"n": F.count(F.lit(1))}), F.count(F.lit(1)).over(Window.partitionBy("k")).alias("n"))
    same(range_folds(df, ["k"], "v", {"s": ("sum", F.col("id"))}, -2, 1), F.sum("id").over(byv.rangeBetween(-2, 1)).alias("s"))
    same(range_folds(df, ["k"], "v", {"s": ("sum", F.col("id"))}), F.sum("id").over(byv).alias("s"))
    assert percentiles(df, ["k"], "v", [0.5]).count() == 4
    assert npath(df, ["k"], ["id"], "A.B*", {"A": F.col("v") >= 0, "B": F.col("v") >= 0}).count() == 200


def explained(frame):
    return frame._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", [
    "track_intersect_product_each", "track_discretize_avg_each", "track_exclusive",
    "track_project_avg_each", "track_pair_closest", "shape_intersect_then_merge"])
def test_interval_plans(spark, folder, name):
    """Node joins are shuffled equi-joins; nothing is a nested loop or a window without keys."""
    plan = explained(all_queries()[name].run(spark, folder))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "SortMergeJoin [chr" in plan or "SortMergeJoin [_node" in plan


def test_filters_and_columns_reach_the_scan(spark, folder):
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    plan = all_queries()["filter_pushdown"].run(spark, folder)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_discount" in text and "LessThan(l_quantity" in text
    assert "l_suppkey" not in text.split("ReadSchema")[1]


def test_bucketed_join_has_no_shuffle(spark, folder):
    plan = all_queries()["storage_bucketed_join"].run(spark, folder)
    text = plan._jdf.queryExecution().sparkPlan().toString()
    executed = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text
    assert "hashpartitioning(l_orderkey" not in executed and "hashpartitioning(o_orderkey" not in executed


def test_percentiles_of_wide_numbers_and_null_groups(spark):
    from trackloom.operators.quantiles import percentiles

    rows = [("a", (k * 2654435761 % 1000) << 40) for k in range(1000)] + [("b", None), ("b", None), (None, 5)]
    got = {r.k: r.percentiles for r in percentiles(
        spark.createDataFrame(rows, "k string, v long"), ["k"], "v", [0.0, 0.5, 1.0]).collect()}
    values = sorted(v for k, v in rows if k == "a")
    assert got["a"] == [values[0], (values[499] + values[500]) / 2, values[-1]]
    assert got["b"] is None and got[None] == [5.0, 5.0, 5.0]
    halves = spark.createDataFrame([("a", 0.25), ("a", 0.75)], "k string, v double")
    assert percentiles(halves, ["k"], "v", [0.5]).first().percentiles == [0.5]


def test_bounded_frames_against_brute_force(spark):
    import random

    from trackloom.operators.ordered import range_folds

    dice = random.Random(2)
    rows = [(dice.choice("ab"), dice.randrange(-60, 60), dice.randrange(1000)) for _ in range(300)] + [(None, 3, 7)]
    frame = spark.createDataFrame(rows, "k string, o long, v long").repartition(5)
    from pyspark.sql import functions as F

    for low, high in ((-5, 5), (0, 0), (-100, 3), (2, 9), (-9, -2), (None, 4), (None, -3)):
        got = range_folds(frame, ["k"], "o", {
            "s": ("sum", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v"))}, low, high).collect()
        assert len(got) == len(rows)
        for r in got:
            inside = [v for k, o, v in rows if k == r.k and (low is None or o >= r.o + low) and o <= r.o + high]
            assert (r.s or 0, r.lo, r.hi) == (sum(inside), min(inside, default=None), max(inside, default=None))


def test_copies_of_one_row_are_salted_apart(spark):
    from pyspark.sql import functions as F

    from trackloom.operators.joins import salted_join

    big = spark.range(4000).select(F.lit(1).alias("k"), F.create_map(F.lit("a"), F.lit(1)).alias("m"))
    small = spark.createDataFrame([(1, "x")], "k int, v string")
    assert salted_join(big, small, ["k"], 8).count() == 4000


def test_map_columns_are_no_obstacle(spark):
    from pyspark.sql import functions as F

    from trackloom.functions import scalar
    from trackloom.operators.ordered import row_numbers
    from trackloom.operators.sampling import bucket_sample

    frame = spark.range(100).select(
        "id", (F.col("id") % 3).alias("k"), F.create_map(F.lit("a"), "id").alias("m"),
        F.array(F.create_map(F.lit("b"), "id")).alias("d"))
    got = row_numbers(frame, ["k"], ["id"]).collect()
    assert all(r.row_number == r.id // 3 + 1 and r.m == {"a": r.id} for r in got) and len(got) == 100
    assert sum(bucket_sample(frame, x, 4).count() for x in range(1, 5)) == 100
    assert [r[0] for r in frame.limit(2).select(scalar.index("m", F.lit("a"), of_map=True)).collect()] == [0, 1]
    assert frame.select(scalar.index("m", F.lit("z"), of_map=True)).first()[0] is None


def test_unique_join_with_hot_and_null_keys(spark):
    from trackloom.operators.joins import UniqueSource, unique_join

    a = [(1, k) for k in range(300)] + [(2, 5), (None, 6), (3, 7)]
    b = [(1, 10), (4, 11), (None, 12)]
    c = [(1, 20), (1, 21), (3, 22), (5, 23)]
    frames = [spark.createDataFrame(rows, "k int, v int") for rows in (a, b, c)]
    for preserve in ((True, False, True), (True, True, True), (False, True, True)):
        got = unique_join([UniqueSource(d, ["k"], p) for d, p in zip(frames, preserve)], ("a_", "b_", "c_"))
        wanted = []
        for key in {k for rows in (a, b, c) for k, _ in rows if k is not None}:
            parts = [[r for r in rows if r[0] == key] for rows in (a, b, c)]
            if all(parts) or any(p and keep for p, keep in zip(parts, preserve)):
                x, y, z = [p or [(None, None)] for p in parts]
                wanted += [(*i, *j, *m) for i in x for j in y for m in z]
        for place, (rows, keep) in enumerate(zip((a, b, c), preserve)):
            wanted += [(*[None] * 2 * place, *r, *[None] * (4 - 2 * place)) for r in rows if r[0] is None and keep]
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, wanted))


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_approximate_count_keeps_no_registers_per_key(spark, folder):
    plan = plan_of(all_queries()["agg_approx_distinct"].run(spark, folder))
    counting = [line for line in plan.splitlines() if "approx_count_distinct" in line]
    assert counting and all("keys=[]" in line for line in counting)


def test_salted_copies_are_not_broadcast(spark):
    from trackloom.operators.joins import salted_join

    big, small = spark.range(1000).withColumnRenamed("id", "k"), spark.range(10).withColumnRenamed("id", "k")
    plan = plan_of(salted_join(big, small, ["k"], 8))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_blocks_of_bits_are_made_after_the_shuffle(spark):
    from trackloom.functions import bitmaps

    rows = spark.range(4000).selectExpr("id % 50 AS k", "id * 977 AS n")
    odd = spark.createDataFrame([(None, 5), (None, 5), (3, None), (3, None), (None, None)], "k long, n long")
    a, b = (bitmaps.build(d.unionByName(odd), "n", ["k"]) for d in (rows, rows.filter("n % 3 = 0")))
    met = bitmaps.intersection(a, b, ["k"])
    lines = plan_of(met).splitlines()
    made = max(i for i, line in enumerate(lines) if "bitmap_construct_agg" in line)
    shuffles = [i for i, line in enumerate(lines) if "Exchange" in line]
    # No block passes a shuffle, and partitions are not joined by the bytes their rows take before they are blocks.
    first = min(i for i, line in enumerate(lines) if "bitmap_construct_agg" in line)
    assert not [i for i in shuffles if i < first] and "REPARTITION_BY_NUM" in "".join(lines[first:made + 4])
    want = {}
    for k, n in [(i % 50, i * 977) for i in range(4000) if i * 977 % 3 == 0] + [tuple(r) for r in odd.collect()]:
        want.setdefault((k, None if n is None else (n - 1) // 32768 + 1 if n > 0 else 0), set()).add(n)
    got = {(r.k, r.bucket): r.n for r in met.selectExpr("k", "bucket", "bitmap_count(bitmap) AS n").collect()}
    assert got == {key: len(found - {None}) for key, found in want.items()}


def test_unique_join_splits_a_key_by_its_result(spark, monkeypatch):
    from trackloom.operators import joins

    monkeypatch.setattr(joins, "PART_ROWS", 1000, raising=False)
    a = spark.range(500).selectExpr("1 AS k", "id")
    b = spark.range(40).selectExpr("1 AS k", "id")
    got = joins.unique_join(
        [joins.UniqueSource(a, ["k"], True), joins.UniqueSource(b, ["k"], True)], ("a_", "b_"))
    rows = got.select("a_id", "b_id", F.spark_partition_id().alias("task")).collect()
    assert len(rows) == len({(r.a_id, r.b_id) for r in rows}) == 20000
    assert len({r.task for r in rows}) >= 4

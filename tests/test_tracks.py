"""The interval operators against their definitions on random and hand-made tracks."""

import itertools

import pytest
from pyspark.sql import functions as F

from tests import brute
from trackloom.operators import intervals as iv
from trackloom.operators import merge, nearest, overlap, project, scans

SCHEMA = "chr string, chrstart bigint, chrend bigint, value double"
PAIR = ("chr", "a_chrstart", "a_chrend", "a_value", "b_chrstart", "b_chrend", "b_value")
SIZES = {"c1": 455, "c2": 533, "c3": 400, "c4": 420, "c5": 77}

# Disjoint, adjacent, touching on one base, nested, identical, equal starts, one base long,
# negative and zero values, a chromosome on one side only, unsorted.
CASES_A = [
    ("chrS", 30, 40, 1.0), ("chrS", 1, 10, -2.0), ("chrS", 11, 20, 3.0), ("chrS", 20, 25, -4.0),
    ("chrS", 30, 40, 5.0), ("chrS", 32, 35, 6.0), ("chrS", 30, 33, 0.0), ("chrS", 50, 50, -7.0),
    ("chrS", 100, 355, 2.0), ("chrT", 5, 533, 1.5), ("chrA", 7, 9, 1.0),
]
CASES_B = [
    ("chrS", 10, 11, 2.0), ("chrS", 41, 49, 0.0), ("chrS", 32, 35, -1.0), ("chrS", 50, 50, 3.0),
    ("chrS", 60, 70, 1.0), ("chrS", 80, 85, 1.0), ("chrT", 5, 5, 4.0), ("chrT", 200, 300, 1.0),
    ("chrB", 1, 2, 1.0),
]


def pairs_of(seed):
    if seed is None:
        return CASES_A, CASES_B
    return (brute.random_track(seed, 60, 300, 40, ["c1", "c2", "c3"]),
            brute.random_track(seed + 100, 40, 300, 120, ["c1", "c2", "c4"]))


@pytest.fixture(scope="module", params=[None, 1], ids=["cases", "random"])
def tracks(request, spark):
    a, b = pairs_of(request.param)
    return a, b, spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)


@pytest.fixture(autouse=True)
def small_tiles(monkeypatch):
    """Tiles of 8 positions, so that carries between tiles matter."""
    monkeypatch.setattr(scans, "TILE_BITS", 3)


def plain(rows):
    def value(v):
        return round(v, 9) + 0.0 if isinstance(v, float) else v

    return sorted((tuple(value(v) for v in r) for r in rows), key=repr)


def check(frame, expected):
    assert plain(frame.collect()) == plain(expected)


@pytest.mark.parametrize("vm", ["each", "total"])
@pytest.mark.parametrize("vd", sorted(brute.PAIRS))
def test_intersect(tracks, vd, vm):
    a, b, da, db = tracks
    check(overlap.intersect_join(da, db, vd, vm), brute.intersect(a, b, vd, vm))


@pytest.mark.parametrize("name", sorted(brute.LOCATION))
def test_location(tracks, name):
    a, b, da, db = tracks
    check(overlap.location_join(da, db, name).select(*PAIR),
          [(*x, *y[1:]) for x in a for y in b if x[0] == y[0] and brute.LOCATION[name](x, y)])


@pytest.mark.parametrize("most", [1, 5, 40])
def test_distance_join(tracks, most):
    a, b, da, db = tracks
    check(overlap.distance_join(da, db, most).select(*PAIR, "distance"),
          [(*x, *y[1:], brute.distance(x, y)) for x in a for y in b
           if x[0] == y[0] and brute.distance(x, y) <= most])


@pytest.mark.parametrize("slack", [0, 1])
def test_coalesce(tracks, slack):
    a, _, da, _ = tracks
    check(merge.coalesce_track(da, merge_adjacent=bool(slack)), [r[:3] for r in brute.coalesce(a, slack)])


@pytest.mark.parametrize("vd", sorted(brute.FOLDS))
def test_coalesce_values(tracks, vd):
    a, _, da, _ = tracks
    check(merge.coalesce_track(da, vd), [(*r[:3], brute.FOLDS[vd](r[3])) for r in brute.coalesce(a)])


@pytest.mark.parametrize("vm", ["each", "total"])
@pytest.mark.parametrize("vd", sorted(brute.FOLDS))
def test_discretize(tracks, vd, vm):
    _, b, _, db = tracks
    check(merge.discretize(db, vd, vm), brute.discretize(b, vd, vm))


def test_discretize_without_values(tracks):
    a, _, da, _ = tracks
    check(merge.discretize(da), [r[:3] for r in brute.discretize(a, "sum", "each")])


@pytest.mark.parametrize("vm", ["each", "total"])
def test_exclusive(tracks, vm):
    a, b, da, db = tracks
    check(overlap.exclusive_join(da, db, vm), brute.exclusive(a, b, vm))


def test_exclusive_with_nothing(tracks, spark):
    a, _, da, _ = tracks
    check(overlap.exclusive_join(da, spark.createDataFrame([], SCHEMA)), a)


@pytest.mark.parametrize("vm", ["each", "total"])
@pytest.mark.parametrize("vd", sorted(brute.FOLDS))
def test_project(tracks, vd, vm):
    a, b, da, db = tracks
    check(project.project_on(da, db, vd, vm), brute.project(a, b, vd, vm))


@pytest.mark.parametrize("leading", [True, False])
@pytest.mark.parametrize("width", [1, 7, 10, 100])
def test_bins(tracks, spark, width, leading):
    _, b, _, db = tracks
    sizes = {"chrS": 355, "chrT": 533} if b is CASES_B else SIZES
    frame = project.project_bins(db, width, iv.chromosome_sizes(spark, sizes), leading_zeros=leading)
    check(frame, brute.bins(b, sizes, width, leading))


def test_pair_closest(tracks):
    a, b, da, db = tracks
    check(nearest.pair_closest(da, db).select(*PAIR, "distance"), brute.pair_closest(a, b))


def test_closest_to(tracks):
    a, _, da, _ = tracks
    for given in (("c1", 150, 151), ("chrS", 45, 46), ("none", 1, 1)):
        near = [(brute.distance(x, given), x) for x in a if x[0] == given[0]]
        least = min((d for d, _ in near), default=None)
        check(nearest.closest_to(da, *given), [(*x, d) for d, x in near if d == least])


def test_three_tracks(tracks):
    a, b, da, db = tracks
    both = brute.intersect(a, b, "sum", "each")
    expected = [(*r[:3], r[3] / 3) for r in brute.intersect(both, a, "sum", "each")]
    check(overlap.intersect_many([da, db, da], "avg"), expected)


def test_metadata_columns(spark):
    a = spark.createDataFrame([("c", 1, 10, 1.0, "x")], SCHEMA + ", tag string")
    b = spark.createDataFrame([("c", 5, 20, 2.0, "y")], SCHEMA + ", tag string")
    row = overlap.intersect_join(a, b, "sum", metadata=True).first()
    assert (row["value"], row["a_tag"], row["b_tag"]) == (3.0, "x", "y")


def test_unknown_derivation(spark):
    a = spark.createDataFrame(CASES_A, SCHEMA)
    with pytest.raises(ValueError):
        merge.discretize(a, "diff")
    with pytest.raises(ValueError):
        overlap.intersect_join(a, a, "sum", "half")


def test_long_intervals_stay_few_rows(spark):
    """A chromosome-long interval is a few dozen nodes, not one row per bin."""
    from trackloom.operators.nodes import spread, top_level

    one = spark.createDataFrame([("chr1", 2, 249250621, 1.0)], SCHEMA)
    nodes = spread(one, top_level(one), cover=(F.col("chrstart"), F.col("chrend")))
    assert nodes.count() < 100


@pytest.mark.parametrize("vd, vm", [("sum", "total"), ("avg", "total"), ("diff", "each"), ("quotient", "each"), ("right", "total")])
def test_intersect_of_four_tracks(spark, vd, vm):
    """Every tuple once, also where several intervals of a tuple start together."""
    given = [CASES_A + brute.random_track(3, 16, 60, 40, ["c1"]), CASES_B + brute.random_track(4, 16, 60, 40, ["c1"]),
             CASES_A[:6] + brute.random_track(5, 16, 60, 40, ["c1"]), brute.random_track(6, 16, 60, 40, ["c1", "chrS"])]
    expected = []
    for found in itertools.product(*given):
        low, high = max(x[1] for x in found), min(x[2] for x in found)
        if len({x[0] for x in found}) == 1 and low <= high:
            own = [brute.part(x, high - low + 1, vm) for x in found]
            value = sum(own) / 4 if vd == "avg" else own[0]
            for v in own[1:] if vd != "avg" else ():
                value = None if value is None else brute.PAIRS[vd](value, v)
            expected.append((found[0][0], low, high, value, *(x[1] for x in found)))
    frames = [spark.createDataFrame([(*r, r[1]) for r in rows], SCHEMA + ", own bigint") for rows in given]
    got = overlap.intersect_many(frames, vd, vm, metadata=True)
    check(got.select(*iv.KEY, "value", *[f"t{k}_own" for k in range(1, 5)]), expected)
    assert len(expected) > 100

"""Functions and relational operators whose results are easy to get wrong."""

import datetime
import decimal
import functools
import math
import random
import struct

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from trackloom.functions import aggregates as ag
from trackloom.functions import bitmaps, hashing, tables, text_stats
from trackloom.functions import scalar as fn
from trackloom.operators import grouping, patterns, sampling
from trackloom.operators.joins import UniqueSource, salted_join, unique_join


@pytest.fixture(scope="module")
def one(spark):
    return spark.range(1)


def value(one, column):
    return one.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text, pattern, expected", [
    ("a,b,,", ",", ["a", "b"]), (",a", ",", ["", "a"]), ("", ",", [""]), (",,", ",", []),
    ("abc", ",", ["abc"]), ("oneAtwoBthree", "[AB]", ["one", "two", "three"]),
])
def test_split(one, text, pattern, expected):
    assert value(one, fn.split(F.lit(text), pattern)) == expected


def test_split_null(one):
    assert value(one, fn.split(F.lit(None).cast("string"), ",")) is None


@pytest.mark.parametrize("text, position, length, expected", [
    ("Facebook", 5, None, "book"), ("Facebook", -5, None, "ebook"), ("Facebook", 5, 1, "b"),
    ("abc", -5, None, ""), ("abc", 4, None, ""), ("abc", 0, 2, "ab"), ("abc", 2, 0, ""), ("", 1, None, ""),
])
def test_substr(one, text, position, length, expected):
    assert value(one, fn.substr(F.lit(text), position, length)) == expected


def test_division(one):
    assert value(one, fn.divide(F.lit(1), F.lit(0))) == math.inf
    assert value(one, fn.divide(F.lit(-1), F.lit(0))) == -math.inf
    assert math.isnan(value(one, fn.divide(F.lit(0), F.lit(0))))
    assert value(one, fn.divide(F.lit(7), F.lit(2))) == 3.5
    assert value(one, fn.long_divide(F.lit(7), F.lit(2))) == 3
    assert value(one, fn.long_divide(F.lit(7), F.lit(0))) is None


def test_guarded_math(one):
    assert value(one, fn.sqrt(F.lit(-1.0))) is None
    assert value(one, fn.log(0.5, F.lit(8))) is None
    assert value(one, fn.log(1, F.lit(8))) is None
    assert value(one, fn.log(2, F.lit(8))) == pytest.approx(3)
    assert value(one, fn.log(2, F.lit(0))) is None
    assert value(one, fn.unhex(F.lit("4D7953514C"))) == "MySQL"
    assert value(one, fn.unhex(F.lit("MySQL"))) is None


def test_dates(one):
    assert value(one, fn.to_date(F.lit("2009-07-30 04:17:52"))) == "2009-07-30"
    assert value(one, fn.date_add(F.lit("2009-07-30"), 1)) == "2009-07-31"
    assert value(one, fn.date_add(F.lit("2008-02-30"), 0)) == "2008-03-01"
    assert value(one, fn.date_sub(F.lit("2009-01-01"), 1)) == "2008-12-31"
    assert value(one, fn.datediff(F.lit("2009-07-30"), F.lit("2009-07-31"))) == -1
    assert value(one, fn.to_date(F.lit("nonsense"))) is None


def test_boolean_cast(one):
    for text, expected in (("false", True), ("no", True), ("", False), (None, None)):
        assert value(one, fn.string_to_boolean(F.lit(text).cast("string"))) is expected


def test_collections(one):
    holed = F.array(F.lit(1), F.lit(None).cast("int"))
    assert value(one, fn.array_contains(holed, F.lit(2))) is False
    assert value(one, fn.array_contains(holed, F.lit(1))) is True
    assert value(one, fn.size(F.lit(None).cast("array<int>"))) == -1
    assert value(one, fn.index(F.array(F.lit(5)), F.lit(3))) is None
    assert value(one, fn.create_union(1, F.lit("x"), F.lit(4))) == Row(tag=1, f0=None, f1=4)
    assert value(one, fn.concat_ws_array("-", F.array(F.lit("a"), F.lit(None).cast("string")))) == "a-null"
    assert value(one, fn.field(F.lit("b"), F.lit("a"), F.lit("b"))) == 2
    assert value(one, fn.field(F.lit(None).cast("string"), F.lit("a"))) == 0


def test_url_tuple(one):
    url = F.lit("https://maps.example.org/tiles/7/9.png?layer=roads&zoom=12#north")
    got = value(one, fn.parse_url_tuple(url, "HOST", "PATH", "QUERY", "REF", "QUERY:zoom", "QUERY:none"))
    assert tuple(got) == ("maps.example.org", "/tiles/7/9.png", "layer=roads&zoom=12", "north", "12", None)


def test_moments(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "k string, v double")
    got = {r["k"]: tuple(r)[1:] for r in df.groupBy("k").agg(
        ag.stddev("v"), ag.variance("v"), ag.stddev_samp("v"), ag.var_samp("v")).collect()}
    assert got["a"] == pytest.approx((1.0, 1.0, math.sqrt(2), 2.0))
    assert got["b"] == (0.0, 0.0, 0.0, 0.0)


def test_compute_stats(spark):
    df = spark.createDataFrame([(1, True, "ab"), (344, False, "c"), (None, None, None)], "a int, b boolean, s string")
    assert ag.compute_stats(df, "a").first()["stats"].asDict() == {
        "columntype": "Long", "min": 1, "max": 344, "countnulls": 1, "numdistinctvalues": 2}
    assert ag.compute_stats(df, "b").first()["stats"].asDict() == {
        "columntype": "Boolean", "counttrues": 1, "countfalses": 1, "countnulls": 1}
    assert ag.compute_stats(df, "s").first()["stats"].asDict() == {
        "columntype": "String", "maxlength": 2, "avglength": 1.5, "countnulls": 1, "numdistinctvalues": 2}


def test_ngrams(spark):
    df = spark.createDataFrame([([["i", "think", "so"], ["i", "think"]],), ([["what", "i", "think"]],)],
                               "s array<array<string>>")
    assert [tuple(r) for r in text_stats.ngrams(df, "s", 2, 2).collect()] == [
        (["i", "think"], 3.0), (["think", "so"], 1.0)]
    assert [tuple(r) for r in text_stats.context_ngrams(df, "s", ["what", "i", None], 5).collect()] == [(["think"], 1.0)]


def test_hash_by_java_rules(spark):
    df = spark.createDataFrame([("abc", 7, 1 << 33, True), ("é", -1, -5, False)], "s string, i int, l bigint, b boolean")
    got = df.select(*[hashing.fold_hash(df, c).alias(c) for c in df.columns]).collect()
    assert tuple(got[0]) == (96354, 7, 2, 1)
    # é is the bytes C3 A9, that is -61 and -87; a negative long folds its two halves.
    assert tuple(got[1]) == (-61 * 31 - 87, -1, 4, 0)
    assert df.select(hashing.fold_hash(df, "i", "b").alias("h")).first()["h"] == 7 * 31 + 1


def test_bucket_samples_partition_the_table(spark):
    df = spark.range(1000)
    parts = [sampling.bucket_sample(df, x, 4, "id") for x in (1, 2, 3, 4)]
    assert sum(p.count() for p in parts) == 1000
    assert parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).distinct().count() == 1000
    with pytest.raises(ValueError):
        sampling.bucket_sample(df, 5, 4, "id")


def test_row_sample_is_per_split(spark):
    assert sampling.row_sample(spark.range(0, 1000, 1, 4), 3).count() == 12


def test_grouping_id_bits(spark):
    df = spark.createDataFrame([(1, 2)], "key int, val int")
    got = {(r["key"], r["val"]): r["g"] for r in df.cube("key", "val").agg(
        grouping.grouping_id(["key", "val"]).alias("g")).collect()}
    assert got == {(1, 2): 3, (1, None): 1, (None, 2): 2, (None, None): 0}


def test_unique_join_preserve(spark):
    def keyed(*keys):
        return spark.createDataFrame([(k,) for k in keys], "key int")

    t1, t2, t3 = keyed(1, 2, 3, 7, 8, 8), keyed(2, 3, 4, 5, 8, 8), keyed(2, 4, 6, 7)

    def run(p1, p2, p3):
        out = unique_join([UniqueSource(t1, ["key"], p1), UniqueSource(t2, ["key"], p2),
                           UniqueSource(t3, ["key"], p3)], ("a_", "b_", "c_"))
        return sorted((tuple(r) for r in out.collect()), key=repr)

    assert run(False, False, False) == [(2, 2, 2)]
    assert run(True, False, True) == sorted([
        (1, None, None), (2, 2, 2), (3, 3, None), (None, 4, 4), (None, None, 6), (7, None, 7),
        *[(8, 8, None)] * 4], key=repr)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join(spark, how):
    big = spark.range(300).select((F.col("id") % 7).alias("k"), "id")
    small = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c")], "k bigint, v string")
    assert salted_join(big, small, ["k"], 4, how).exceptAll(big.join(small, ["k"], how)).count() == 0
    assert salted_join(big, small, ["k"], 4, how).count() == big.join(small, ["k"], how).count()


def test_npath_golden(spark):
    late = [True, True, True, False, True, True, False, True]
    df = spark.createDataFrame([("f", i, d) for i, d in enumerate(late)], "fl string, day int, late boolean")
    got = patterns.npath(df, ["fl"], ["day"], "LATE.LATE+", {"LATE": F.col("late")})
    assert sorted((r["day"], r["path_size"]) for r in got.collect()) == [(0, 3), (1, 2), (4, 2)]
    star = patterns.npath(df, ["fl"], ["day"], "OK*.LATE", {"LATE": F.col("late"), "OK": ~F.col("late")})
    assert sorted((r["day"], r["path_size"]) for r in star.collect()) == [
        (0, 1), (1, 1), (2, 1), (3, 2), (4, 1), (5, 1), (6, 2), (7, 1)]


def test_bitmaps(spark):
    a, b = bitmaps.build(spark.range(0, 100000), "id"), bitmaps.build(spark.range(50000, 150000), "id")
    assert bitmaps.cardinality(bitmaps.intersection(a, b)).first()[0] == 50000
    assert bitmaps.cardinality(bitmaps.union(a, b)).first()[0] == 150000


def test_in_file(spark, tmp_path):
    (tmp_path / "names.txt").write_text("x\ny\n")
    df = spark.createDataFrame([("x",), ("z",), (None,)], "s string")
    got = {r["s"]: r["in_file"] for r in tables.in_file(df, "s", str(tmp_path / "names.txt")).collect()}
    assert got == {"x": True, "z": False, None: None}


def test_macro(spark):
    tables.create_macro(spark, "share", "part DOUBLE, whole DOUBLE", "100 * part / whole")
    assert spark.sql("SELECT share(3, 8) AS s").first()["s"] == pytest.approx(37.5)
    tables.drop_macro(spark, "share")


def _java(kind, v):
    """Hashes of single values by the rules of the JVM, with struct for the bits."""
    wrap = lambda x: (x + (1 << 31)) % (1 << 32) - (1 << 31)
    fold = lambda xs: functools.reduce(lambda h, x: wrap(31 * h + x), xs, 0)
    if v is None:
        return 0
    if kind == "double":
        bits = struct.unpack(">Q", struct.pack(">d", v))[0] if v == v else 0x7FF8 << 48
        return wrap(bits ^ bits >> 32)
    if kind == "float":
        return struct.unpack(">i", struct.pack(">f", v))[0] if v == v else 0x7FC00000
    if kind == "decimal":
        sign, digits, exponent = v.normalize(decimal.Context(prec=50)).as_tuple()
        exponent = exponent if v else 0
        whole = int("".join(map(str, digits))) * 10 ** max(exponent, 0)
        words = [whole >> 32 * k & 0xFFFFFFFF for k in (3, 2, 1, 0)]
        return wrap(31 * (fold(words) * (-1 if sign else 1)) + max(-exponent, 0))
    if kind == "binary":
        return wrap(functools.reduce(lambda h, x: 31 * h + (x + 128) % 256 - 128, v, 1))
    if kind == "date":
        return (v - datetime.date(1970, 1, 1)).days
    if kind == "timestamp":
        micros = (v - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1)
        x = (micros // 10**6 << 30 | micros % 10**6 * 1000) & (1 << 64) - 1
        return wrap(x ^ x >> 32)
    if kind == "bigint":
        return wrap((v ^ v >> 32) & 0xFFFFFFFF)
    if kind == "array<double>":
        return fold(_java("double", x) for x in v)
    if kind == "map<bigint,float>":
        return wrap(sum(_java("bigint", k) ^ _java("float", x) for k, x in v.items()))
    return fold((_java("bigint", v[0]), _java("array<double>", v[1])))


@pytest.mark.parametrize("kind, values", [
    ("double", [0.0, -0.0, 1.0, -2.5, 0.1, 1e308, -1e308, 5e-324, -3e-310, 2.2250738585072014e-308, 2.0 ** 1023, 1 - 2.0 ** -53,
                2.0 - 2.0 ** -52, float("inf"), float("-inf"), float("nan"), 123456789.123, None]),
    ("float", [0.0, -0.0, 1.5, -0.10000000149011612, 1.401298464324817e-45, 3.4028234663852886e38, float("inf"), float("nan"), None]),
    ("decimal", [decimal.Decimal(x) for x in ("0.000000000000000000", "1", "-1.10", "100.000", "99999999999999999999.123456789012345678",
                                              "-4294967296", "18446744073709551616.5", "0.000000000000000001")] + [None]),
    ("binary", [b"", b"\x00", b"abc\xff\x80", None]),
    ("date", [datetime.date(1970, 1, 1), datetime.date(1969, 12, 31), datetime.date(2024, 2, 29), None]),
    ("timestamp", [datetime.datetime(1970, 1, 1), datetime.datetime(1969, 12, 31, 23, 59, 59, 999999),
                   datetime.datetime(2024, 2, 29, 12, 30, 5, 250000), None]),
    ("array<double>", [[], [1.5, None, -0.0], None]),
    ("map<bigint,float>", [{}, {1: 2.5, -7: None, 1 << 40: -1.0}, None]),
    ("struct<a:bigint,b:array<double>>", [(5, [0.5]), (None, None), (-1, []), None]),
])
def test_hash_of_every_type(spark, kind, values):
    declared = {"decimal": "decimal(38,18)"}.get(kind, kind)
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {declared}")
    got = [r.h for r in df.select("k", hashing.fold_hash(df, "v").alias("h")).orderBy("k").collect()]
    assert got == [_java(kind, v) for v in values]


def test_random_doubles_hash_by_their_bits(spark):
    generator = random.Random(1)
    values = [struct.unpack(">d", generator.randbytes(8))[0] for _ in range(3000)]
    values = [v for v in values if v == v] + [2.0 ** k for k in range(-1074, 1024, 7)] + [2.0 ** k * (1 - 2.0 ** -53) for k in range(-1020, 1024, 9)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [tuple(r) for r in df.select("v", hashing.fold_hash(df, "v").alias("h")).collect()]
    assert all(h == _java("double", v) for v, h in got)

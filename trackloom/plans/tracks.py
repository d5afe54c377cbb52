"""The interval operators on tracks derived from ``lineitem``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators import intervals as iv
from trackloom.operators import half_lines, merge, nearest, overlap, project
from trackloom.plans.registry import Query, Tables, query, single

_START = "l_orderkey * 10 + l_linenumber"
_SQL_TRACK = (
    "SELECT 'chr' || (l_suppkey % 5 + 1) AS chr, {start} AS chrstart, "
    "{start} + CAST(l_quantity AS BIGINT) AS chrend, l_extendedprice / 1000 AS value{more} "
    "FROM lineitem WHERE l_linestatus = '{status}'"
)


def line_track(t: Tables, status: str, start: str = _START, metadata=()) -> DataFrame:
    """Intervals on five chromosomes, mean depth about 2.6, values up to 100."""
    lines = t.lineitem.filter(F.col("l_linestatus") == status)
    first = F.expr(start)
    return iv.track(
        lines,
        chr=F.concat(F.lit("chr"), (F.col("l_suppkey") % 5 + 1).cast("string")),
        start=first,
        end=first + F.col("l_quantity").cast("bigint"),
        value=F.col("l_extendedprice") / 1000,
        metadata=metadata,
    )


def line_track_sql(status: str, start: str = _START, more: str = "") -> str:
    return _SQL_TRACK.format(start=start, status=status, more=more)


def a_track(t: Tables) -> DataFrame:
    return line_track(t, "O")


def b_track(t: Tables) -> DataFrame:
    return line_track(t, "F")


WITH_A = f"WITH a AS ({line_track_sql('O')})"
WITH_AB = f"{WITH_A}, b AS ({line_track_sql('F')})"
OVERLAP = "a.chr = b.chr AND a.chrstart <= b.chrend AND a.chrend >= b.chrstart"
OVL = "(least(a.chrend, b.chrend) - greatest(a.chrstart, b.chrstart) + 1)"
A_LEN = "(a.chrend - a.chrstart + 1)"
B_LEN = "(b.chrend - b.chrstart + 1)"


def single_sql(expression: str) -> str:
    return f"CAST(CAST({expression} AS FLOAT) AS DOUBLE)"


QUERIES: dict[str, Query] = {}

# Cutting at boundaries -------------------------------------------------------

_SEGMENTS = (
    "cuts AS (SELECT DISTINCT chr, p FROM (SELECT chr, chrstart - 1 AS p FROM a "
    "UNION ALL SELECT chr, chrend AS p FROM a)), "
    "s AS (SELECT chr, p + 1 AS s, lead(p) OVER (PARTITION BY chr ORDER BY p) AS e FROM cuts)"
)
_COVERED = ("FROM s JOIN a ON a.chr = s.chr AND a.chrstart <= s.s AND a.chrend >= s.e "
            "WHERE s.e IS NOT NULL GROUP BY s.chr, s.s, s.e")
_DENSE = "l_partkey * 10"


def _discretize(vd: str, vm: str, start: str = _START) -> Query:
    operand = "a.value" if vm == "each" else f"a.value * (s.e - s.s + 1) / {A_LEN}"
    with_a = f"WITH a AS ({line_track_sql('O', start)})"
    return query(
        lambda t: merge.discretize(line_track(t, "O", start), vd, vm).withColumn(
            "value", single("value")),
        f"{with_a}, {_SEGMENTS} SELECT s.chr, s.s AS chrstart, s.e AS chrend, "
        f"{single_sql(f'{vd}({operand})')} AS value {_COVERED}",
    )


for _vd in ("sum", "avg", "product", "max", "min"):
    for _vm in ("each", "total"):
        QUERIES[f"track_discretize_{_vd}_{_vm}"] = _discretize(_vd, _vm)
QUERIES["track_discretize_dense_avg_each"] = _discretize("avg", "each", _DENSE)
QUERIES["track_discretize"] = query(
    lambda t: merge.discretize(a_track(t)),
    f"{WITH_A}, {_SEGMENTS} SELECT s.chr, s.s AS chrstart, s.e AS chrend {_COVERED}",
)

# Merging ---------------------------------------------------------------------


def merged_sql(source: str, slack: int = 0, columns: str = "") -> str:
    """Gaps and islands over ``source``, as CTE bodies ``o`` and ``g``."""
    order = "ORDER BY chrstart, chrend"
    return (
        f"o AS (SELECT *, CASE WHEN chrstart <= {slack} + max(chrend) OVER (PARTITION BY chr {order} "
        f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM {source}), "
        f"g AS (SELECT *, sum(n) OVER (PARTITION BY chr {order}, n DESC "
        f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM o), "
        f"m AS (SELECT chr, min(chrstart) AS chrstart, max(chrend) AS chrend{columns} "
        f"FROM g GROUP BY chr, g)"
    )


QUERIES["track_coalesce"] = query(
    lambda t: merge.coalesce_track(a_track(t)),
    f"{WITH_A}, {merged_sql('a')} SELECT chr, chrstart, chrend FROM m",
)
QUERIES["track_coalesce_adjacent"] = query(
    lambda t: merge.coalesce_track(a_track(t), merge_adjacent=True),
    f"{WITH_A}, {merged_sql('a', 1)} SELECT chr, chrstart, chrend FROM m",
)
for _vd in ("sum", "avg", "max", "min"):
    QUERIES[f"track_coalesce_{_vd}"] = query(
        lambda t, vd=_vd: merge.coalesce_track(a_track(t), vd).withColumn("value", single("value")),
        f"{WITH_A}, {merged_sql('a', 0, f', {single_sql(f'{_vd}(value)')} AS value')} "
        "SELECT chr, chrstart, chrend, value FROM m",
    )
# Merged runs can have hundreds of members: keep the product of values near 1 in range.
QUERIES["track_coalesce_product"] = query(
    lambda t: merge.coalesce_track(
        a_track(t).withColumn("value", 1 + F.col("value") / 10000), "product"
    ).withColumn("value", single("value")),
    f"{WITH_A}, v AS (SELECT chr, chrstart, chrend, 1 + value / 10000 AS value FROM a), "
    f"{merged_sql('v', 0, f', {single_sql('product(value)')} AS value')} "
    "SELECT chr, chrstart, chrend, value FROM m",
)

# Joins by location -----------------------------------------------------------

_PAIR_SQL = {
    "sum": "{a} + {b}", "avg": "({a} + {b}) / 2", "diff": "{a} - {b}", "product": "{a} * {b}",
    "quotient": "{a} / nullif({b}, 0)", "max": "greatest({a}, {b})", "min": "least({a}, {b})",
    "left": "{a}", "right": "{b}",
}
_OPERANDS = {
    "each": ("a.value", "b.value"),
    "total": (f"(a.value * {OVL} / {A_LEN})", f"(b.value * {OVL} / {B_LEN})"),
}
for _vd, _text in _PAIR_SQL.items():
    for _vm, (_left, _right) in _OPERANDS.items():
        QUERIES[f"track_intersect_{_vd}_{_vm}"] = query(
            lambda t, vd=_vd, vm=_vm: overlap.intersect_join(
                a_track(t), b_track(t), vd, vm).withColumn("value", single("value")),
            f"{WITH_AB} SELECT a.chr, greatest(a.chrstart, b.chrstart) AS chrstart, "
            f"least(a.chrend, b.chrend) AS chrend, "
            f"{single_sql(_text.format(a=_left, b=_right))} AS value FROM a JOIN b ON {OVERLAP}",
        )
QUERIES["track_intersect"] = query(
    lambda t: overlap.intersect_join(a_track(t), b_track(t)),
    f"{WITH_AB} SELECT a.chr, greatest(a.chrstart, b.chrstart) AS chrstart, "
    f"least(a.chrend, b.chrend) AS chrend FROM a JOIN b ON {OVERLAP}",
)
QUERIES["track_intersect_metadata"] = query(
    lambda t: overlap.intersect_join(
        line_track(t, "O", metadata=("l_returnflag", "l_partkey")),
        line_track(t, "F", metadata=("l_returnflag",)), "left", metadata=True,
    ).drop("a_value", "b_value"),
    f"WITH a AS ({line_track_sql('O', more=', l_returnflag, l_partkey')}), "
    f"b AS ({line_track_sql('F', more=', l_returnflag')}) "
    "SELECT a.chr, greatest(a.chrstart, b.chrstart) AS chrstart, "
    "least(a.chrend, b.chrend) AS chrend, a.value, a.l_returnflag AS a_l_returnflag, "
    f"a.l_partkey AS a_l_partkey, b.l_returnflag AS b_l_returnflag FROM a JOIN b ON {OVERLAP}",
)


def _c_track(t: Tables) -> DataFrame:
    """Order-level intervals: the third source of the three-way intersection."""
    return iv.track(
        t.orders,
        chr=F.concat(F.lit("chr"), (F.col("o_custkey") % 5 + 1).cast("string")),
        start=F.col("o_orderkey") * 10,
        end=F.col("o_orderkey") * 10 + 9,
        value=F.col("o_totalprice") / 1000,
    )


_SQL_C = ("SELECT 'chr' || (o_custkey % 5 + 1) AS chr, o_orderkey * 10 AS chrstart, "
          "o_orderkey * 10 + 9 AS chrend, o_totalprice / 1000 AS value FROM orders")
QUERIES["track_intersect_three"] = query(
    lambda t: overlap.intersect_many([a_track(t), b_track(t), _c_track(t)], "avg").withColumn(
        "value", single("value")),
    f"{WITH_AB}, c AS ({_SQL_C}), ab AS (SELECT a.chr, greatest(a.chrstart, b.chrstart) AS chrstart, "
    f"least(a.chrend, b.chrend) AS chrend, a.value + b.value AS value FROM a JOIN b ON {OVERLAP}) "
    "SELECT ab.chr, greatest(ab.chrstart, c.chrstart) AS chrstart, least(ab.chrend, c.chrend) AS chrend, "
    f"{single_sql('(ab.value + c.value) / 3')} AS value FROM ab JOIN c ON ab.chr = c.chr "
    "AND ab.chrstart <= c.chrend AND ab.chrend >= c.chrstart",
)

# Rows of both tracks as structs beside what they have in common.
_AB = ("ab AS MATERIALIZED (SELECT a.chr, greatest(a.chrstart, b.chrstart) AS s, least(a.chrend, b.chrend) AS e, "
       f"a, b FROM a JOIN b ON {OVERLAP})")
_WITH_ABC = f"{WITH_AB}, c AS ({_SQL_C}), {_AB}"
_THREE = "FROM ab JOIN c ON ab.chr = c.chr AND ab.s <= c.chrend AND ab.e >= c.chrstart"
_THREE_PLACE = "ab.chr, greatest(ab.s, c.chrstart) AS chrstart, least(ab.e, c.chrend) AS chrend"
_THREE_LENGTH = "(least(ab.e, c.chrend) - greatest(ab.s, c.chrstart) + 1)"
QUERIES["track_intersect_three_total"] = query(
    lambda t: overlap.intersect_many([a_track(t), b_track(t), _c_track(t)], "sum", "total").withColumn(
        "value", single("value")),
    f"{_WITH_ABC} SELECT {_THREE_PLACE}, " + single_sql(" + ".join(
        f"{x}.value * {_THREE_LENGTH} / ({x}.chrend - {x}.chrstart + 1)" for x in "abc")) + f" AS value {_THREE}",
)
QUERIES["track_intersect_three_metadata"] = query(
    lambda t: overlap.intersect_many([
        line_track(t, "O", metadata=("l_returnflag", "l_partkey")), line_track(t, "F", metadata=("l_returnflag",)),
        _c_track(t).withColumn("band", F.floor(F.col("value") / 50))], "max", metadata=True,
    ).drop("t1_value", "t2_value", "t3_value"),
    f"WITH a AS ({line_track_sql('O', more=', l_returnflag, l_partkey')}), "
    f"b AS ({line_track_sql('F', more=', l_returnflag')}), c AS ({_SQL_C}), {_AB} SELECT {_THREE_PLACE}, "
    "greatest(a.value, b.value, c.value) AS value, a.l_returnflag AS t1_l_returnflag, a.l_partkey AS t1_l_partkey, "
    f"b.l_returnflag AS t2_l_returnflag, CAST(floor(c.value / 50) AS BIGINT) AS t3_band {_THREE}",
)

_GAPS = (
    "r AS (SELECT DISTINCT chr, chrstart, chrend FROM a), "
    "k AS (SELECT r.chr, r.chrstart, r.chrend, m.chrstart AS ms, m.chrend AS me FROM r LEFT JOIN m "
    "ON r.chr = m.chr AND m.chrstart <= r.chrend AND m.chrend >= r.chrstart), "
    "w AS (SELECT *, lag(me) OVER (PARTITION BY chr, chrstart, chrend ORDER BY ms) AS pe FROM k), "
    "f AS (SELECT chr, chrstart, chrend, coalesce(pe + 1, chrstart) AS s, coalesce(ms - 1, chrend) AS e FROM w "
    "UNION ALL SELECT chr, chrstart, chrend, max(me) + 1 AS s, chrend AS e FROM k "
    "WHERE me IS NOT NULL GROUP BY chr, chrstart, chrend) "
)


def _exclusive(vm: str) -> Query:
    value = "a.value" if vm == "each" else f"a.value * (f.e - f.s + 1) / {A_LEN}"
    return query(
        lambda t: overlap.exclusive_join(a_track(t), b_track(t), vm).withColumn("value", single("value")),
        f"{WITH_AB}, {merged_sql('b')}, {_GAPS} SELECT f.chr, f.s AS chrstart, f.e AS chrend, "
        f"{single_sql(value)} AS value FROM f JOIN a "
        "ON a.chr = f.chr AND a.chrstart = f.chrstart AND a.chrend = f.chrend WHERE f.s <= f.e",
    )


QUERIES["track_exclusive"] = _exclusive("each")
QUERIES["track_exclusive_total"] = _exclusive("total")

QUERIES["track_exclusive_metadata"] = query(
    lambda t: overlap.exclusive_join(
        line_track(t, "O", metadata=("l_returnflag", "l_partkey")), b_track(t), "each", metadata=True),
    f"WITH a AS ({line_track_sql('O', more=', l_returnflag, l_partkey')}), b AS ({line_track_sql('F')}), {merged_sql('b')}, {_GAPS} "
    "SELECT f.chr, f.s AS chrstart, f.e AS chrend, a.value, a.l_returnflag AS a_l_returnflag, a.l_partkey AS a_l_partkey FROM f JOIN a "
    "ON a.chr = f.chr AND a.chrstart = f.chrstart AND a.chrend = f.chrend WHERE f.s <= f.e",
)

_LOCATION_SQL = {
    "overlaps": "a.chrstart <= b.chrend AND a.chrend >= b.chrstart",
    "contains": "a.chrstart <= b.chrstart AND a.chrend >= b.chrend",
    "within": "b.chrstart <= a.chrstart AND b.chrend >= a.chrend",
    "coincides": "a.chrstart = b.chrstart AND a.chrend = b.chrend",
    "adjacent": "(a.chrend + 1 = b.chrstart OR a.chrstart - 1 = b.chrend)",
    "prefix": "a.chrstart = b.chrstart AND a.chrend <= b.chrend",
    "suffix": "a.chrend = b.chrend AND a.chrstart >= b.chrstart",
    "precedes": "a.chrend < b.chrstart",
    "follows": "a.chrstart > b.chrend",
}
_PAIR_COLUMNS = ("a.chr, a.chrstart AS a_chrstart, a.chrend AS a_chrend, a.value AS a_value, "
                 "b.chrstart AS b_chrstart, b.chrend AS b_chrend, b.value AS b_value")


def _landmarks(t: Tables) -> DataFrame:
    """One interval per nation: where the orders of its customers lie."""
    placed = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return placed.groupBy("c_nationkey").agg(
        F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"),
        F.count(F.lit(1)).alias("orders"),
    ).select(
        F.concat(F.lit("chr"), (F.col("c_nationkey") % 5 + 1).cast("string")).alias("chr"),
        (F.col("lo") * 10 + 40 * F.col("orders")).alias("chrstart"),
        (F.col("lo") * 10 + 40 * F.col("orders") + F.col("c_nationkey") * 100).alias("chrend"),
        F.col("orders").cast("double").alias("value"))


_LANDMARKS_SQL = (
    "SELECT 'chr' || (c_nationkey % 5 + 1) AS chr, min(o_orderkey) * 10 + 40 * count(*) AS chrstart, "
    "min(o_orderkey) * 10 + 40 * count(*) + c_nationkey * 100 AS chrend, CAST(count(*) AS DOUBLE) AS value "
    "FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey"
)
# Begin and end of a constant that an interval from chrstart to chrend is related to.
_BESIDE = {
    "contains": ("chrstart + 1", "chrend - 1"), "within": ("chrstart - 1", "chrend + 1"),
    "prefix": ("chrstart", "chrend + 5"), "suffix": ("chrstart - 5", "chrend"),
    "adjacent": ("chrend + 1", "chrend + 9"), "precedes": ("chrstart + 500", "chrend + 500"),
    "follows": ("chrstart - 300", "chrend - 300")}


def _filtered(t: Tables, name: str, low: str, high: str) -> DataFrame:
    a = a_track(t)
    chosen = F.min(F.struct("chr", "chrstart", "chrend")).alias("at")
    place = a.filter("chrend - chrstart > 4").agg(chosen).select("at.*").selectExpr("chr", low, high).first()
    return iv.filter_location(a, name, *place)


for _name, _text in _LOCATION_SQL.items():
    # precedes / follows return nearly every pair of a chromosome, so they relate
    # the whole track to the landmarks.
    _far = _name in ("precedes", "follows")
    QUERIES[f"track_loc_{_name}"] = query(
        lambda t, name=_name, far=_far: overlap.location_join(
            a_track(t), _landmarks(t) if far else b_track(t), name),
        (f"{WITH_A}, b AS ({_LANDMARKS_SQL})" if _far else WITH_AB)
        + f" SELECT {_PAIR_COLUMNS} FROM a JOIN b ON a.chr = b.chr AND {_text}",
    )
    # The constant lies beside the first longer interval, so that it has that one at least.
    _low, _high = _BESIDE.get(_name, ("chrstart", "chrend"))
    QUERIES[f"track_filter_{_name}"] = query(
        lambda t, name=_name, low=_low, high=_high: _filtered(t, name, low, high),
        f"{WITH_A}, b AS (SELECT chr, {_low} AS chrstart, {_high} AS chrend FROM a "
        f"WHERE chrend - chrstart > 4 ORDER BY a.chr, a.chrstart, a.chrend LIMIT 1) "
        f"SELECT a.* FROM a JOIN b ON a.chr = b.chr AND {_text}",
    )
# Counts by running sums over the positions of both tracks.
QUERIES["track_precede_counts"] = query(
    lambda t: half_lines.precede_counts(a_track(t), b_track(t)),
    f"{WITH_AB}, p AS (SELECT chr, chrstart AS pos, 1 AS begins, 0 AS ends FROM b UNION ALL SELECT chr, chrend, 0, 1 FROM b "
    "UNION ALL SELECT chr, chrend, 0, 0 FROM a UNION ALL SELECT chr, chrstart - 1, 0, 0 FROM a), "
    "g AS (SELECT chr, pos, sum(begins) AS begins, sum(ends) AS ends FROM p GROUP BY chr, pos), "
    "c AS (SELECT chr, pos, sum(begins) OVER w AS begun, sum(ends) OVER w AS ended, "
    "sum(begins) OVER (PARTITION BY chr) AS n FROM g WINDOW w AS (PARTITION BY chr ORDER BY pos)) "
    "SELECT a.*, CAST(x.n - x.begun AS BIGINT) AS n_precedes, CAST(y.ended AS BIGINT) AS n_follows FROM a "
    "JOIN c x ON x.chr = a.chr AND x.pos = a.chrend JOIN c y ON y.chr = a.chr AND y.pos = a.chrstart - 1",
)
QUERIES["track_distance_join"] = query(
    lambda t: overlap.distance_join(a_track(t), b_track(t), 15),
    f"{WITH_AB} SELECT {_PAIR_COLUMNS}, greatest(0, b.chrstart - a.chrend, a.chrstart - b.chrend) AS distance "
    "FROM a JOIN b ON a.chr = b.chr AND b.chrstart - a.chrend <= 15 AND a.chrstart - b.chrend <= 15",
)
QUERIES["track_length"] = query(
    lambda t: a_track(t).select("chr", "chrstart", "chrend", iv.length().alias("length")).filter(
        F.col("length") > 30),
    f"{WITH_A} SELECT chr, chrstart, chrend, {A_LEN} AS length FROM a WHERE {A_LEN} > 30",
)

# Projection ------------------------------------------------------------------

_FIRST_BIN = "(chrstart - 1) // 100"


def _bins_sql(first: str, numerator: str, divisor: str) -> str:
    return (
        f"{WITH_A}, x AS (SELECT *, unnest(range((chrstart - 1) // 100, (chrend - 1) // 100 + 1)) AS bin FROM a), "
        f"g AS (SELECT chr, bin, sum({numerator}) AS w FROM x GROUP BY chr, bin), "
        f"c AS (SELECT chr, max(chrend) AS len, {first} AS b0 FROM a GROUP BY chr), "
        "k AS (SELECT chr, len, unnest(range(b0, (len - 1) // 100 + 1)) AS bin FROM c) "
        "SELECT k.chr, k.bin * 100 + 1 AS chrstart, least((k.bin + 1) * 100, k.len) AS chrend, "
        + single_sql(f"coalesce(g.w, 0.0) {divisor}")
        + " AS value FROM k LEFT JOIN g ON k.chr = g.chr AND k.bin = g.bin"
    )


_IN_BIN = "(least(chrend, (bin + 1) * 100) - greatest(chrstart, bin * 100 + 1) + 1)"
_BIN_LEN = "/ (least((k.bin + 1) * 100, k.len) - k.bin * 100)"


def _bins(t: Tables, vd: str = "avg", vm: str = "each", leading: bool = True) -> DataFrame:
    a = a_track(t)
    return project.project_bins(a, 100, iv.sizes_of(a), vd, vm, leading).withColumn(
        "value", single("value"))


QUERIES["track_bins"] = query(_bins, _bins_sql("0", f"value * {_IN_BIN}", _BIN_LEN))
QUERIES["track_bins_from_first"] = query(
    lambda t: _bins(t, leading=False),
    _bins_sql(f"min({_FIRST_BIN})", f"value * {_IN_BIN}", _BIN_LEN))
QUERIES["track_bins_total"] = query(
    lambda t: _bins(t, "sum", "total"),
    _bins_sql("0", f"value * {_IN_BIN} / (chrend - chrstart + 1)", ""))
QUERIES["track_bins_max"] = query(
    lambda t: _bins(t, "max", "each"), _bins_sql("0", "NULL", "").replace(
        "sum(NULL)", "max(value)"))

_FOLD_SQL = {
    ("avg", "each"): f"sum(a.value * {OVL}) / {B_LEN}",
    ("avg", "total"): f"avg(a.value * {OVL} / {A_LEN})",
    **{(vd, "each"): f"{vd}(a.value)" for vd in ("sum", "product", "max", "min")},
    **{(vd, "total"): f"{vd}(a.value * {OVL} / {A_LEN})" for vd in ("sum", "product", "max", "min")},
}
for (_vd, _vm), _text in _FOLD_SQL.items():
    QUERIES[f"track_project_{_vd}_{_vm}"] = query(
        lambda t, vd=_vd, vm=_vm: project.project_on(
            a_track(t), b_track(t), vd, vm).withColumn("value", single("value")),
        f"{WITH_A}, b AS (SELECT DISTINCT chr, chrstart, chrend FROM ({line_track_sql('F')})) "
        f"SELECT b.chr, b.chrstart, b.chrend, {single_sql(f'coalesce({_text}, 0)')} AS value "
        f"FROM b LEFT JOIN a ON {OVERLAP} GROUP BY b.chr, b.chrstart, b.chrend",
    )
QUERIES["track_project_metadata"] = query(
    lambda t: project.project_on(
        a_track(t), line_track(t, "F", metadata=("l_returnflag",)), metadata=True,
    ).withColumn("value", single("value")),
    f"{WITH_A}, r AS ({line_track_sql('F', more=', l_returnflag')}), "
    "b AS (SELECT DISTINCT chr, chrstart, chrend FROM r), p AS ("
    f"SELECT b.chr, b.chrstart, b.chrend, {single_sql(f'coalesce(sum(a.value * {OVL}) / {B_LEN}, 0)')} AS value "
    f"FROM b LEFT JOIN a ON {OVERLAP} GROUP BY b.chr, b.chrstart, b.chrend) "
    "SELECT p.chr, p.chrstart, p.chrend, r.l_returnflag, p.value FROM r JOIN p "
    "ON r.chr = p.chr AND r.chrstart = p.chrstart AND r.chrend = p.chrend",
)

# Nearest ---------------------------------------------------------------------

_DISTANCE = "greatest(0, b.chrstart - a.chrend, a.chrstart - b.chrend)"
QUERIES["track_closest_to"] = query(
    lambda t: nearest.closest_to(a_track(t), "chr2", 20010, 20012),
    f"{WITH_A}, d AS (SELECT *, greatest(0, 20010 - chrend, chrstart - 20012) AS distance FROM a "
    "WHERE chr = 'chr2') SELECT * FROM d WHERE distance = (SELECT min(distance) FROM d)",
)
QUERIES["track_pair_closest"] = query(
    lambda t: nearest.pair_closest(a_track(t), b_track(t)),
    f"{WITH_AB}, d AS (SELECT a.chr, a.chrstart, a.chrend, min({_DISTANCE}) AS distance "
    "FROM (SELECT DISTINCT chr, chrstart, chrend FROM a) a JOIN b ON a.chr = b.chr "
    "GROUP BY a.chr, a.chrstart, a.chrend) "
    f"SELECT {_PAIR_COLUMNS}, d.distance FROM a JOIN d ON a.chr = d.chr AND a.chrstart = d.chrstart "
    f"AND a.chrend = d.chrend JOIN b ON a.chr = b.chr AND {_DISTANCE} = d.distance",
)

# SQL functions and files ------------------------------------------------------


def _sql_functions(t: Tables) -> DataFrame:
    iv.register_sql_functions(t.spark)
    spot = "named_struct('chr', 'chr2', 'chrstart', 2010L, 'chrend', 2012L)"
    whole = "named_struct('chr', chr, 'chrstart', chrstart, 'chrend', chrend)"
    return t.spark.sql(
        f"SELECT chr, chrstart, chrend, interval_length({whole}) AS length, "
        f"interval_distance({whole}, {spot}) AS distance FROM {{a}} "
        f"WHERE follows({whole}, {spot}) AND interval_length({whole}) > 20", a=a_track(t))


def _sql_prefix_suffix(t: Tables) -> DataFrame:
    iv.register_sql_functions(t.spark)
    whole = "named_struct('chr', chr, 'chrstart', chrstart, 'chrend', chrend)"
    longer = "named_struct('chr', chr, 'chrstart', chrstart, 'chrend', chrstart + 20)"
    later = "named_struct('chr', chr, 'chrstart', chrend - 20, 'chrend', chrend)"
    return t.spark.sql(
        f"SELECT chr, chrstart, chrend, prefix_of({whole}, {longer}) AS p, suffix_of({whole}, {later}) AS s FROM {{a}}",
        a=a_track(t))


QUERIES["track_sql_prefix_suffix"] = query(
    _sql_prefix_suffix,
    f"{WITH_A} SELECT chr, chrstart, chrend, chrend - chrstart <= 20 AS p, chrend - chrstart <= 20 AS s FROM a",
)
QUERIES["track_sql_functions"] = query(
    _sql_functions,
    f"{WITH_A} SELECT chr, chrstart, chrend, {A_LEN} AS length, chrstart - 2012 AS distance FROM a "
    f"WHERE chr = 'chr2' AND chrstart > 2012 AND {A_LEN} > 20",
)

"""Scalar functions whose results differ from the builtin of the same name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Arithmetic ------------------------------------------------------------------


def divide(a: Column | str, b: Column | str) -> Column:
    """Floating division: x / 0 is an infinity, 0 / 0 is NaN."""
    a, b = _col(a).cast("double"), _col(b).cast("double")
    by_zero = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).when(
        a == 0, F.lit(float("nan"))).otherwise(F.lit(None).cast("double"))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def long_divide(a: Column | str, b: Column | str) -> Column:
    """Whole-number division; NULL for a zero divisor."""
    return F.call_function("div", _col(a).cast("bigint"), F.nullif(_col(b).cast("bigint"), F.lit(0)))


def sqrt(c: Column | str) -> Column:
    """NULL below zero."""
    c = _col(c).cast("double")
    return F.when(c >= 0, F.sqrt(c))


def log(base: Column | float, c: Column | str) -> Column:
    """NULL unless the base exceeds 1 and the argument exceeds 0."""
    base = base if isinstance(base, Column) else F.lit(float(base))
    c = _col(c).cast("double")
    return F.when((base > 1) & (c > 0), F.ln(c) / F.ln(base))


def unhex(c: Column | str) -> Column:
    """The bytes as a string."""
    return F.unhex(_col(c)).cast("string")


# Text ------------------------------------------------------------------------


def split(c: Column | str, pattern: str) -> Column:
    """Split by a regular expression; empty strings at the end are dropped."""
    parts = F.split(_col(c), pattern, -1)
    kept = F.size(parts) - F.coalesce(
        F.array_position(F.transform(F.reverse(parts), lambda p: p != ""), F.lit(True)),
        F.lit(0)).cast("int") + 1
    any_text = F.exists(parts, lambda p: p != "")
    trimmed = F.when(any_text, F.slice(parts, F.lit(1), kept)).otherwise(F.slice(parts, 1, 0))
    # A text without any separator is returned whole, even when empty.
    return F.when(F.size(parts) == 1, parts).when(F.size(parts) > 1, trimmed)


def substr(c: Column | str, position: int, length: int | None = None) -> Column:
    """Substring; '' when the position lies outside the text."""
    c = _col(c)
    taken = F.substring(c, position, 2147483647 if length is None else length)
    outside = F.abs(F.lit(position)) > F.length(c)
    return F.when(outside, F.lit("")).otherwise(taken)


def concat_ws(separator: str, *columns: Column | str) -> Column:
    """NULL arguments are skipped, NULLs inside array arguments read ``null``."""
    return F.concat_ws(separator, *[_col(c) for c in columns])


def concat_ws_array(separator: str, c: Column | str) -> Column:
    return F.coalesce(F.array_join(_col(c), separator, "null"), F.lit(""))


def field(c: Column | str, *candidates: Column) -> Column:
    """1-based position among the candidates, 0 when absent or NULL."""
    return F.coalesce(F.array_position(F.array(*candidates), _col(c)), F.lit(0)).cast("int")


def parse_url_tuple(url: Column | str, *parts: str) -> Column:
    """Struct ``c0, c1, ...`` of URL parts; ``QUERY:key`` reads one parameter."""
    url = _col(url)
    out = []
    for i, part in enumerate(parts):
        name, _, key = part.partition(":")
        value = F.try_parse_url(url, F.lit(name), F.lit(key)) if key else F.try_parse_url(url, F.lit(name))
        out.append(value.alias(f"c{i}"))
    return F.struct(*out)


def reflect2(target: Column | str, method: str, *arguments: Column) -> Column:
    """Call a method of a string by name."""
    c = _col(target)
    methods = {
        "length": lambda: F.length(c),
        "isEmpty": lambda: F.length(c) == 0,
        "toUpperCase": lambda: F.upper(c),
        "toLowerCase": lambda: F.lower(c),
        "trim": lambda: F.trim(c),
        "concat": lambda s: F.concat(c, s),
        "startsWith": lambda s: F.startswith(c, s),
        "endsWith": lambda s: F.endswith(c, s),
        "contains": lambda s: F.contains(c, s),
        "indexOf": lambda s: F.call_function("instr", c, s) - 1,
        "substring": lambda start: F.substring(c, start + 1, F.length(c)),
    }
    if method not in methods:
        raise ValueError(f"no method {method!r}; use one of {sorted(methods)}")
    return methods[method](*arguments)


# Dates -----------------------------------------------------------------------


def _lenient_date(c: Column) -> Column:
    """Read ``yyyy-M-d`` where month and day may overflow into the next unit."""
    text = c.cast("string")
    shape = r"^(\d+)-(\d+)-(\d+)"
    year, month, day = (F.regexp_extract(text, shape, i).try_cast("int") for i in (1, 2, 3))
    return F.date_add(F.add_months(F.make_date(year, F.lit(1), F.lit(1)), month - 1), day - 1)


def to_date(c: Column | str) -> Column:
    """The date part as ``yyyy-MM-dd`` text."""
    return F.date_format(_lenient_date(_col(c)), "yyyy-MM-dd")


def date_add(c: Column | str, days: Column | int) -> Column:
    """``yyyy-MM-dd`` text; 2008-02-30 reads as 2008-03-01."""
    return F.date_format(F.date_add(_lenient_date(_col(c)), days), "yyyy-MM-dd")


def year(c: Column | str) -> Column:
    """Parts of dates are read from text with overflow, as the dates above are."""
    return F.year(_lenient_date(_col(c)))


def month(c: Column | str) -> Column:
    return F.month(_lenient_date(_col(c)))


def day(c: Column | str) -> Column:
    return F.dayofmonth(_lenient_date(_col(c)))


def weekofyear(c: Column | str) -> Column:
    return F.weekofyear(_lenient_date(_col(c)))


def date_sub(c: Column | str, days: Column | int) -> Column:
    return F.date_format(F.date_sub(_lenient_date(_col(c)), days), "yyyy-MM-dd")


def datediff(a: Column | str, b: Column | str) -> Column:
    return F.datediff(_lenient_date(_col(a)), _lenient_date(_col(b)))


# Casts -----------------------------------------------------------------------


def string_to_boolean(c: Column | str) -> Column:
    """Any text but the empty one is TRUE, ``'false'`` included."""
    return F.length(_col(c)) > 0


def to_decimal(c: Column | str, scale: int = 18) -> Column:
    return _col(c).try_cast(f"decimal(38,{scale})")


# Collections -----------------------------------------------------------------


def array_contains(c: Column | str, value: Column) -> Column:
    """TRUE or FALSE, never NULL."""
    return F.coalesce(F.array_contains(_col(c), value), F.lit(False))


def index(c: Column | str, key: Column, of_map: bool = False) -> Column:
    """``a[n]`` from 0, or ``m[k]`` with ``of_map``; NULL when absent."""
    return F.try_element_at(_col(c), key) if of_map else F.get(_col(c), key)


def size(c: Column | str) -> Column:
    """Number of elements, -1 for NULL."""
    return F.coalesce(F.cardinality(_col(c)), F.lit(-1))


def create_union(tag: Column | int, *alternatives: Column) -> Column:
    """A tagged union: the tag, and the value in the field the tag names."""
    tag = tag if isinstance(tag, Column) else F.lit(tag)
    fields = [F.when(tag == i, a).alias(f"f{i}") for i, a in enumerate(alternatives)]
    return F.struct(tag.cast("int").alias("tag"), *fields)


def from_unixtime(c: Column | str, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.from_unixtime(_col(c), pattern)

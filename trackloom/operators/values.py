"""Value derivations (how values combine) and value models (what a value means).

* ``each``: every position of the interval carries the value.
* ``total``: the value is spread evenly over the interval, so a part of it
  carries ``value * part / length``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EACH, TOTAL = "each", "total"

# Two-operand derivations, for joins of two tracks.
PAIRWISE: dict[str, Callable[[Column, Column], Column]] = {
    "sum": lambda a, b: a + b,
    "avg": lambda a, b: (a + b) / 2,
    "diff": lambda a, b: a - b,
    "product": lambda a, b: a * b,
    "quotient": lambda a, b: F.try_divide(a, b),
    "max": lambda a, b: F.greatest(a, b),
    "min": lambda a, b: F.least(a, b),
    "left": lambda a, b: a,
    "right": lambda a, b: b,
}

# Many-operand derivations, for operators that fold any number of intervals.
FOLDED = ("sum", "avg", "product", "max", "min")


def check(vd: str | None, vm: str, allowed) -> None:
    if vd is not None and vd not in allowed:
        raise ValueError(f"unknown value derivation {vd!r}; use one of {sorted(allowed)}")
    if vm not in (EACH, TOTAL):
        raise ValueError(f"unknown value model {vm!r}; use 'each' or 'total'")


def partial_fold(vd: str, value: Column) -> dict[str, Column]:
    """Aggregates over rows that are enough to derive ``vd`` later."""
    aggregates = {
        "sum": lambda: {"_sum": F.sum(value)},
        "avg": lambda: {"_sum": F.sum(value), "_n": F.count(value)},
        "product": lambda: {"_product": F.product(value), "_n": F.count(value)},
        "max": lambda: {"_max": F.max(value)},
        "min": lambda: {"_min": F.min(value)},
    }
    return aggregates[vd]()


def merge_fold(vd: str) -> dict[str, Column]:
    """Aggregates that merge the partial results of :func:`partial_fold`."""
    merges = {
        "sum": {"_sum": F.sum("_sum")},
        "avg": {"_sum": F.sum("_sum"), "_n": F.sum("_n")},
        "product": {"_product": F.product("_product"), "_n": F.sum("_n")},
        "max": {"_max": F.max("_max")},
        "min": {"_min": F.min("_min")},
    }
    return merges[vd]


def finish_fold(vd: str, scale: Column | None = None) -> Column:
    """The derived value; every operand was left to be multiplied by ``scale`` > 0."""
    if vd == "avg":
        value = F.col("_sum") / F.col("_n")
    else:
        value = F.col(f"_{vd}")
    if scale is None:
        return value
    return value * (F.pow(scale, F.col("_n")) if vd == "product" else scale)

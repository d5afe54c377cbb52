"""Grouping helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def grouping_id(columns: Sequence[str]) -> Column:
    """Bit mask of the grouping columns that ARE present, first column lowest.

    Spark's own ``grouping_id`` has the opposite bits in the opposite order.
    """
    mask = None
    for position, name in enumerate(columns):
        bit = (F.lit(1) - F.grouping(name).cast("int")) * F.lit(1 << position)
        mask = bit if mask is None else mask + bit
    return mask.cast("int")

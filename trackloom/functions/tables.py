"""Table functions, macros and scripts."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.operators.scans import ordering


def in_file(df: DataFrame, column: Column | str, path: str, name: str = "in_file") -> DataFrame:
    """Flag the rows whose text is a line of the file. NULL stays NULL.

    A left join with the distinct lines; Spark broadcasts them only when they
    are few by its own measure.
    """
    c = F.col(column) if isinstance(column, str) else column
    lines = df.sparkSession.read.text(path).select(F.col("value").alias("_line")).distinct().withColumn(
        "_found", F.lit(True))
    joined = df.withColumn("_text", c).join(lines, F.col("_text") == F.col("_line"), "left")
    flag = F.when(F.col("_text").isNotNull(), F.coalesce(F.col("_found"), F.lit(False)))
    return joined.withColumn(name, flag).drop("_text", "_line", "_found")


def create_macro(spark: SparkSession, name: str, parameters: str, body: str) -> None:
    """A named expression, expanded into every query that uses it.

    ``create_macro(spark, "share", "part DOUBLE, whole DOUBLE", "100 * part / whole")``
    """
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURN {body}")


def drop_macro(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")


# States that a task holds before it passes them on to be merged.
HELD_STATES = 100_000


def user_aggregate(df: DataFrame, keys: list[str], value: str, initial, iterate, merge, terminate, result: str) -> DataFrame:
    """A user's aggregate in two stages, as one row per key with the keys and ``result``.

    ``initial()`` gives a state, ``iterate(state, value)`` and ``merge(state, state)`` the
    next one, ``terminate(state)`` the value of the column that ``result`` declares, such
    as ``"mean double"``. Every task folds its own rows to one state per key, so a hot key
    leaves it as one row; only states are shuffled. States must pickle.
    """
    name = result.split()[0]
    fields = ", ".join(f"`{n}` {kind}" for n, kind in df.select(*keys).dtypes)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict = {}

        def passed() -> pd.DataFrame:
            rows = [(*key, pickle.dumps(state)) for key, state in states.items()]
            return pd.DataFrame(rows, columns=[*keys, "_state"], dtype=object)

        for batch in batches:
            plain = batch.astype(object).where(batch.notna(), None)
            for *key, v in zip(*(plain[c] for c in (*keys, value))):
                key = tuple(key)
                states[key] = iterate(states[key] if key in states else initial(), v)
            if len(states) > HELD_STATES:
                yield passed()
                states.clear()
        if states:
            yield passed()

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        state = None
        for k, other in enumerate(group["_state"]):
            other = pickle.loads(other)
            state = merge(state, other) if k else other
        return group[keys].head(1).assign(**{name: [terminate(state)]})

    states = df.select(*keys, value).mapInPandas(partial, f"{fields}, _state binary")
    return states.groupBy(*keys).applyInPandas(merged, f"{fields}, {result}")


def map_batches(df: DataFrame, function, schema: str) -> DataFrame:
    """Run a function over pandas batches of rows, the vectorised script."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield function(batch)

    return df.mapInPandas(run, schema)


def _pieces(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, tuple, pa.RecordBatch]]:
    """(number of the partition, key, rows) of sorted batches cut where one of the first columns changes."""
    number, last = -1, None
    for batch in batches:
        if not batch.num_rows:
            continue
        changes = np.zeros(batch.num_rows - 1, bool)
        for column in batch.columns[:width]:
            # Codes of values are equal for NULLs, and for NaNs, too.
            changes |= np.diff(column.dictionary_encode(null_encoding="encode").indices.to_numpy()) != 0
        bounds = [0, *(np.flatnonzero(changes) + 1), batch.num_rows]
        for low, high in zip(bounds, bounds[1:]):
            key = tuple(column[low].as_py() for column in batch.columns[:width])
            if last is None or repr(key) != repr(last):
                number, last = number + 1, key
            yield number, key, batch.slice(low, high - low)


def partition_stream(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    function: Callable[[tuple, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str,
) -> DataFrame:
    """A user's function over sorted partitions of rows, each as a stream of Arrow batches.

    ``function(key, batches)`` gets the values of ``keys`` and an iterator over the rows of
    one partition by ``order`` (``-name`` is descending), keys first, then the other columns,
    and yields batches of ``schema``. It keeps its own state across batches, may keep, drop
    or add rows, and need not read to the end. Spark sorts and spills; a task holds one
    batch, so a partition may be of any length, though its rows pass one after the other.

    Keys are plain columns; NULL is a key like any other. An empty table calls nothing.
    """
    keys = list(keys)
    if not keys:
        raise ValueError("a stream needs a column to partition by")
    rows = df.select(*keys, *[c for c in df.columns if c not in keys])
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, *[ordering(c) for c in order])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, pieces in groupby(_pieces(batches, len(keys)), key=lambda piece: piece[0]):
            _, key, first = next(pieces)
            yield from function(key, _rows(first, pieces))

    return rows.mapInArrow(run, schema)


def _rows(first: pa.RecordBatch, pieces: Iterator) -> Iterator[pa.RecordBatch]:
    yield first
    for _, _, batch in pieces:
        yield batch


@F.udtf(returnType="a int, b int")
class Explode2:
    """Every number twice over, in two columns."""

    def eval(self, values: list):
        for v in values or ():
            yield v, v


@F.udtf(returnType="count int")
class Count2:
    """Counts its input and returns the count twice when the input ends."""

    def __init__(self):
        self.n = 0

    def eval(self, value):
        self.n += 1

    def terminate(self):
        yield (self.n,)
        yield (self.n,)

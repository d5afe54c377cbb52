"""Joins that Spark has no keyword for."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Result rows of one key that one task makes, about.
PART_ROWS = 1_000_000


class UniqueSource(NamedTuple):
    """One input of :func:`unique_join`."""

    df: DataFrame
    keys: Sequence[Column | str]
    preserve: bool = False


def unique_join(sources: Sequence[UniqueSource], prefixes: Sequence[str]) -> DataFrame:
    """Align any number of inputs on equal keys.

    A key is kept when every input has it, or when an input marked
    ``preserve`` has it; absent inputs are then NULL. Rows of one key are
    combined across the inputs that have it. NULL keys match nothing, and
    survive only from preserved inputs.

    Keys that cannot survive are filtered out first. With one preserved input
    or none the plans are inner or left joins; with more, inputs get a row of
    NULLs for kept keys they lack and are joined by inner joins, of which
    adaptive execution can split a hot key on either side.
    """
    width = len(sources[0].keys)
    keys = [f"_key{i}" for i in range(width)]
    staged = []
    for source, prefix in zip(sources, prefixes):
        named = [F.col(k) if isinstance(k, str) else k for k in source.keys]
        staged.append(source.df.select(
            *[k.alias(n) for k, n in zip(named, keys)], F.lit(True).alias(prefix + "_here"),
            *[F.col(c).alias(prefix + c) for c in source.df.columns]))
    preserved = [i for i, s in enumerate(sources) if s.preserve]
    if not preserved:
        joined = reduce(lambda a, b: a.join(b, keys), staged)
    elif len(preserved) == 1:
        first = preserved[0]
        rest = [d for i, d in enumerate(staged) if i != first]
        joined = reduce(lambda a, b: a.join(b, keys, "left"), rest, staged[first])
    else:
        joined = _aligned(staged, prefixes, keys, preserved)
    return joined.select(*[p + c for s, p in zip(sources, prefixes) for c in s.df.columns])


def _aligned(staged: list[DataFrame], prefixes: Sequence[str], keys: list[str], preserved: list[int]) -> DataFrame:
    """Every kept key is dealt over parts of ``PART_ROWS`` result rows or so: the rows of the input that
    has most of them go to one part each, those of the others to every part."""
    no_null = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    flags = [F.lit(i).alias("_source") for i in range(len(staged))]
    seen = reduce(DataFrame.unionByName, [d.filter(no_null).select(*keys, flag) for d, flag in zip(staged, flags)])
    counts = [F.count_if(F.col("_source") == i) for i in range(len(staged))]
    there = seen.groupBy(*keys).agg(*[c.alias(f"_n{i}") for i, c in enumerate(counts)])
    anyone = reduce(lambda a, b: a | b, [F.col(f"_n{i}") > 0 for i in preserved])
    everyone = reduce(lambda a, b: a & b, [F.col(f"_n{i}") > 0 for i in range(len(staged))])
    numbers = [F.col(f"_n{i}") for i in range(len(staged))]
    most = F.greatest(*numbers)
    # In double precision, as the product of many counts may exceed a long.
    rows = reduce(lambda a, b: a * b, [F.greatest(n, F.lit(1)).cast("double") for n in numbers])
    kept = there.filter(anyone | everyone).withColumns({
        "_parts": F.least(F.ceil(rows / PART_ROWS), most).cast("int"),
        "_dealt": F.array_position(F.array(*numbers), most) - 1})
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_parts")).cast("int")
    tasks = int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    padded = []
    for i, d in enumerate(staged):
        lacking = kept.filter(F.col(f"_n{i}") == 0).select(*keys, "_parts", "_dealt")
        rows = d.join(kept.select(*keys, "_parts", "_dealt"), keys).unionByName(lacking, allowMissingColumns=True)
        chosen = F.when(F.col("_dealt") == i, F.array(part)).otherwise(F.sequence(F.lit(0), F.col("_parts") - 1))
        # A number of partitions that is given: joined by their size, few would hold all of the result.
        padded.append(rows.withColumn("_part", F.explode(chosen)).drop("_parts", "_dealt").repartition(
            tasks, *keys, "_part"))
    joined = reduce(lambda a, b: a.join(b.hint("merge"), [*keys, "_part"]), padded).drop("_part")
    # A NULL key matches nothing, so those rows need no join.
    for i in preserved:
        joined = joined.unionByName(staged[i].filter(~no_null), allowMissingColumns=True)
    return joined


def salted_join(
    big: DataFrame, small: DataFrame, keys: Sequence[str], salts: int, how: str = "inner"
) -> DataFrame:
    """Equi-join with every key of ``big`` spread over ``salts`` tasks.

    For keys known to be hot where run-time splitting does not apply, such as a
    join followed by an aggregate on the same key. ``small`` is repeated
    ``salts`` times. Inner, left, left_semi and left_anti joins keep their
    meaning, as each row of ``big`` meets each row of ``small`` at most once.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a {how} join cannot repeat its right side")
    # Copies of a row get salts of their own. The salt of a row has no influence on the
    # result, as every row of ``small`` is there under each salt.
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int")
    spread = big.withColumn("_salt", salt)
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # Size estimates do not see the copies, so a broadcast planned from them would be unchecked.
    return spread.join(copies.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def hot_keys(df: DataFrame, keys: Sequence[str], share: float = 0.01, tracked: int = 4096) -> DataFrame:
    """Keys that hold more than ``share`` of the rows: (_hot, _splits), hash and number of parts.

    A frequent-items sketch per task is merged to one; it keeps every key above
    rows / ``tracked``, so none above ``share`` is missed. The result has 1 / ``share``
    rows at most. A part is as large as the smallest hot key; NULL keys count as one.
    """
    if not 1 / tracked < share <= 1:
        raise ValueError("share has to lie above 1 / tracked, and not above 1")
    most = F.lit(min(tracked, int(1 / share) + 1))
    found = df.agg(F.call_function("approx_top_k", F.xxhash64(*keys), most, F.lit(tracked)).alias("top"),
                   F.count(F.lit(1)).alias("rows")).select("rows", F.explode("top").alias("top"))
    part = F.col("rows") * share
    return found.filter(F.col("top.count") > part).select(
        F.col("top.item").alias("_hot"), F.ceil(F.col("top.count") / part).cast("int").alias("_splits"))


def split_hot_keys(
    left: DataFrame, right: DataFrame, keys: Sequence[str], share: float = 0.01, tracked: int = 4096,
) -> tuple[DataFrame, DataFrame]:
    """Both sides with a ``_salt``: rows of ``left`` with a hot key are dealt over its parts, rows of
    ``right`` with that key are repeated for each; all other rows have salt 0 and are there once."""
    # A fixed number of rows at most, whatever the inputs.
    hot = F.broadcast(hot_keys(left, keys, share, tracked))
    here = F.xxhash64(*keys)
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_splits")).cast("int")
    dealt = left.withColumn("_key", here).join(hot, F.col("_key") == F.col("_hot"), "left").withColumn(
        "_salt", F.when(F.col("_splits").isNotNull(), part).otherwise(0))
    copies = F.when(F.col("_splits").isNotNull(), F.sequence(F.lit(0), F.col("_splits") - 1)).otherwise(F.array(F.lit(0)))
    repeated = right.withColumn("_key", here).join(hot, F.col("_key") == F.col("_hot"), "left").withColumn(
        "_salt", F.explode(copies))
    extra = ("_key", "_hot", "_splits")
    return dealt.drop(*extra), repeated.drop(*extra)


def skew_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", share: float = 0.01, tracked: int = 4096,
) -> DataFrame:
    """Equi-join whose hot keys are found when it runs: see :func:`split_hot_keys`.

    Unlike the splitting of adaptive execution this holds for what follows on the same
    key and salt as well, and for the rows with NULL keys of a left join. Inner, left,
    left_semi and left_anti joins keep their meaning.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a {how} join cannot repeat its right side")
    dealt, repeated = split_hot_keys(left, right, keys, share, tracked)
    return dealt.join(repeated, [*keys, "_salt"], how).drop("_salt")

"""Row patterns: runs of rows, in order, that match a sequence of symbols.

A pattern is written ``A.B+.C*``: symbols joined by dots, each a named
condition, with ``+`` for one or more and ``*`` for none or more. Repetition
takes as many rows as it can. A match may begin at every row.

Results are folds over the rows of a match. Row numbers are cut into aligned blocks as
positions are for intervals (see ``nodes``): every row is folded into the blocks it
lies in, a match is the disjoint union of a few blocks, and an equi-join brings them
together. So matches that begin at every row of a long run cost a logarithm each, and
no fold takes differences that lose digits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.operators.nodes import NODE, spread, top_level
from trackloom.operators.ordered import BY, cut_in_tiles, with_key
from trackloom.operators.scans import scan

_START = "path_start"
# Folds of the values of the rows of a match: over rows, and over folds of blocks.
_FOLDS = {"sum": (F.sum, F.sum), "min": (F.min, F.min), "max": (F.max, F.max), "count": (F.count, F.sum)}
RESULTS = ("first", "last", "list", "avg", *_FOLDS)


def _elements(pattern: str, symbols: dict[str, Column]) -> list[tuple[str, str]]:
    out = []
    for word in pattern.split("."):
        name, repeat = (word[:-1], word[-1]) if word[-1:] in ("+", "*") else (word, "")
        if name not in symbols:
            raise ValueError(f"symbol {name!r} has no condition")
        out.append((name, repeat))
    return out


def numbered_runs(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], symbols: dict[str, Column]
) -> DataFrame:
    """Rows with their key as a struct, ``_at`` (their number within the key) and, per symbol, ``_until_<symbol>``:
    the number of the first row from here on that does not match."""
    tiled = with_key(cut_in_tiles(df, keys, order), keys)
    numbered = scan(tiled, [BY], order, {"_at": ("sum", F.lit(1))}, inclusive=True, keep_tile=True)
    fails = {
        f"_until_{name}": ("min", F.when(~F.coalesce(test, F.lit(False)), F.col("_at")))
        for name, test in symbols.items()}
    runs = scan(numbered, [BY], ["_at"], fails, backward=True, inclusive=True)
    sizes = tiled.groupBy(BY).agg(F.count(F.lit(1)).alias("_rows"))
    runs = runs.join(sizes, BY)
    return runs.withColumns({
        n: F.coalesce(F.col(n), F.col("_rows") + 1) for n in fails}).drop("_rows")


def npath(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    pattern: str,
    symbols: dict[str, Column],
    results: dict[str, tuple[str, Column]] | None = None,
) -> DataFrame:
    """The first row of every match with ``path_start``, ``path_end`` and ``path_size``.

    ``results`` names further columns, each a fold of an expression over the rows of the
    match: first, last, sum, avg, min, max, count (of values that are not null) or
    ``list`` (of all values in order, as large as the matches together).

    Row numbers and run ends come from two tiled scans. Each further symbol of
    the pattern moves a cursor, by an equi-join on (key, row number), so no
    task holds the rows of a key. ``order`` must be total within a key.
    """
    results = results or {}
    for name, (fold, _) in results.items():
        if fold not in RESULTS:
            raise ValueError(f"unknown result {fold!r} of {name!r}; use one of {RESULTS}")
    runs = numbered_runs(df, keys, order, symbols)
    used = {name for name, _ in _elements(pattern, symbols)}
    stops = runs.select(BY, F.col("_at").alias("_cursor"), *[f"_until_{n}" for n in used])
    firsts = [e.alias(name) for name, (fold, e) in results.items() if fold == "first"]
    found = runs.select(BY, *df.columns, F.col("_at").alias(_START),
                        F.col("_at").alias("_cursor"), *[f"_until_{n}" for n in used], *firsts)
    ends = [f"_until_{n}" for n in used]
    for step, (name, repeat) in enumerate(_elements(pattern, symbols)):
        if step:
            # A cursor past the last row finds nothing: only ``*`` can match there.
            found = found.drop(*ends).join(stops, [BY, "_cursor"], "left")
        until, cursor = F.col(f"_until_{name}"), F.col("_cursor")
        if repeat == "*":
            found = found.withColumn("_cursor", F.coalesce(until, cursor))
        else:
            found = found.filter(until > cursor).withColumn(
                "_cursor", until if repeat == "+" else cursor + 1)
    size = F.col("_cursor") - F.col(_START)
    found = found.filter(size > 0).withColumns({"path_end": F.col("_cursor") - 1, "path_size": size})
    found = _with_results(found, runs, {n: r for n, r in results.items() if r[0] != "first"})
    return found.select(*df.columns, _START, "path_end", "path_size", *results)


def _with_results(paths: DataFrame, runs: DataFrame, results: dict[str, tuple[str, Column]]) -> DataFrame:
    lasts = [e.alias(name) for name, (fold, e) in results.items() if fold == "last"]
    if lasts:
        paths = paths.join(runs.select(BY, F.col("_at").alias("path_end"), *lasts), [BY, "path_end"])
    folded = {n: r for n, r in results.items() if r[0] in _FOLDS or r[0] == "avg"}
    listed = {n: r for n, r in results.items() if r[0] == "list"}
    if not folded and not listed:
        return paths
    top = top_level(paths, start=_START, end="path_end")
    covers = spread(paths.select(BY, _START, "path_end"), top, cover=(F.col(_START), F.col("path_end"))).drop("path_end")
    for part, whole in ((folded, _folds), (listed, _lists)):
        if part:
            values = runs.select(BY, "_at", *[e.alias(n) for n, (_, e) in part.items()])
            paths = paths.join(whole(covers, spread(values, top, point=F.col("_at")), part), [BY, _START])
    return paths


def _folds(covers: DataFrame, rows: DataFrame, results: dict[str, tuple[str, Column]]) -> DataFrame:
    """Rows are folded in blocks first, then blocks in matches."""
    inner, outer, shown = [], [], []
    for name, (fold, _) in results.items():
        for part in ("sum", "count") if fold == "avg" else (fold,):
            column = f"_{part}_{name}"
            inner.append(_FOLDS[part][0](name).alias(column))
            outer.append(_FOLDS[part][1](column).alias(column))
        value = F.try_divide(f"_sum_{name}", f"_count_{name}") if fold == "avg" else F.col(f"_{fold}_{name}")
        shown.append(value.alias(name))
    blocks = rows.groupBy(BY, NODE).agg(*inner)
    return covers.join(blocks, [BY, NODE]).groupBy(BY, _START).agg(*outer).select(BY, _START, *shown)


def _lists(covers: DataFrame, rows: DataFrame, results: dict[str, tuple[str, Column]]) -> DataFrame:
    gathered = covers.join(rows, [BY, NODE]).groupBy(BY, _START).agg(
        F.array_sort(F.collect_list(F.struct("_at", *results))).alias("_rows"))
    return gathered.select(BY, _START, *[F.col("_rows")[name].alias(name) for name in results])


def noop(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The identity over a partitioned, sorted input."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)

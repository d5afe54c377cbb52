"""Frequent word sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sequences(df: DataFrame, sentences: str, n: int, keep: Sequence[str] = ()) -> DataFrame:
    """Every run of n words in every sentence of an array<array<string>> column, as ``ngram``."""
    one = df.select(*keep, F.explode(sentences).alias("_words")).filter(F.size("_words") >= n)
    starts = one.select(*keep, "_words", F.explode(F.sequence(F.lit(1), F.size("_words") - (n - 1))).alias("_at"))
    return starts.select(*keep, F.slice("_words", F.col("_at"), n).alias("ngram"))


def _top(counted: DataFrame, k: int) -> DataFrame:
    # Ties are broken by the words, which makes the report repeatable.
    return counted.orderBy(F.col("estfrequency").desc(), F.col("ngram").asc()).limit(k)


def ngrams(df: DataFrame, sentences: str, n: int, k: int) -> DataFrame:
    """The k most frequent n-grams with exact counts: ``ngram, estfrequency``.

    Counting is map-side combined; the top k is kept per task before it is merged.
    """
    counted = sequences(df, sentences, n).groupBy("ngram").agg(
        F.count(F.lit(1)).cast("double").alias("estfrequency"))
    return _top(counted, k)


def context_ngrams(df: DataFrame, sentences: str, context: Sequence[str | None], k: int) -> DataFrame:
    """The k most frequent fillers of the NULL places of ``context``."""
    found = sequences(df, sentences, len(context))
    for place, word in enumerate(context):
        if word is not None:
            found = found.filter(F.element_at("ngram", place + 1) == word)
    blanks = [F.element_at("ngram", p + 1) for p, w in enumerate(context) if w is None]
    counted = found.select(F.array(*blanks).alias("ngram")).groupBy("ngram").agg(
        F.count(F.lit(1)).cast("double").alias("estfrequency"))
    return _top(counted, k)

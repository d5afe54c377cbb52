"""Bounded samples of a corpus for fitting small models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.words import SEED


def sample_texts(docs: DataFrame, id_column: str, text_column: str, rows: int, chars: int) -> list[str]:
    """The first ``chars`` characters of about ``rows`` texts, the same in every run.

    Rows whose digest of the id lies below rows / count are taken: one count and one
    filtered read, no sort. Null texts count as rows and are left out.
    """
    total = docs.count()
    digest = F.pmod(F.xxhash64(id_column, F.lit(SEED)), F.lit(1 << 40))
    bound = int((1 << 40) * min(1.0, rows / max(total, 1)))
    picked = docs.filter(F.col(text_column).isNotNull() & (digest < bound))
    got = picked.select(digest.alias("d"), F.substring(F.col(text_column), 1, chars).alias("t")).collect()
    return [r["t"] for r in sorted(got, key=lambda r: (r["d"], r["t"]))]

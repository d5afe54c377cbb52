"""How a named query is declared, and the collection of all of them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.session import configure

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

MODULES = (
    "tracks", "track_shapes", "joins", "aggregates", "windows", "ordering",
    "generators", "scalars", "patterns", "storage",
)


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


class Tables:
    """The tables of one folder, read on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        frame = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        setattr(self, name, frame)
        return frame

    def sql(self, text: str) -> DataFrame:
        """Run SQL in which tables are written ``{lineitem}``."""
        used = {t: getattr(self, t) for t in TABLES if "{" + t + "}" in text}
        return self.spark.sql(text, **used)


def query(build: Callable[[Tables], DataFrame], sql: str | None = None) -> Query:
    return Query(lambda spark, folder: build(Tables(spark, folder)), sql)


def same_sql(text: str) -> Query:
    """A query whose text is the same for Spark and for the check."""
    plain = text
    for name in TABLES:
        plain = plain.replace("{" + name + "}", name)
    return query(lambda t: t.sql(text), plain)


def as_long(declared: Query, *columns: str) -> Query:
    """The same query with the named columns as bigint, which ranks are elsewhere."""
    return Query(
        lambda spark, folder: declared.run(spark, folder).withColumns(
            {c: F.col(c).cast("bigint") for c in columns}),
        declared.sql)


def single(column: Column | str) -> Column:
    """Round to single precision, where sums taken in another order agree."""
    column = F.col(column) if isinstance(column, str) else column
    return column.cast("float").cast("double")


def all_queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for module in MODULES:
        for name, declared in import_module(f"trackloom.plans.{module}").QUERIES.items():
            if name in found:
                raise ValueError(f"query {name} is declared twice")
            found[name] = declared
    return found

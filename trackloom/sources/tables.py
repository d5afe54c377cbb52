"""Tables: partitions, buckets, several targets from one scan, export and import."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def insert_overwrite_partitions(df: DataFrame, path: str, partitions: Sequence[str], format: str = "parquet") -> None:
    """Replace just the partitions that occur in ``df``.

    Rows are first gathered by partition with room to split large ones, so
    that tasks do not each write a small file into every partition.
    """
    df.hint("rebalance", *partitions).write.format(format).mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(*partitions).save(path)


def multi_insert(df: DataFrame, path: str, branches: dict[str, tuple[Column, Sequence[Column]]]) -> dict[str, DataFrame]:
    """Write several filtered projections of one input in a single pass.

    A row is tagged with the branches whose condition holds and written once
    per branch into ``path/_branch=<name>``. Branch projections must agree in
    their column names. Returns each branch as a table read back.
    """
    wanted = F.array(*[
        F.when(condition, F.struct(F.lit(name).alias("_branch"), *columns))
        for name, (condition, columns) in branches.items()])
    tagged = df.select(F.explode(F.filter(wanted, lambda w: w.isNotNull())).alias("_w")).select("_w.*")
    tagged.write.partitionBy("_branch").parquet(path)
    spark = df.sparkSession
    schema = T.StructType([f for f in tagged.schema.fields if f.name != "_branch"])
    written = spark.read.schema(T.StructType([*schema.fields, T.StructField("_branch", T.StringType())])).parquet(path)
    # The branch is a partition column: each read prunes to its own folder.
    return {name: written.filter(F.col("_branch") == name).drop("_branch") for name in branches}


def save_bucketed(df: DataFrame, table: str, buckets: int, keys: Sequence[str], path: str | None = None,
                  sort: bool = True, mode: str = "overwrite") -> DataFrame:
    """A table bucketed (and sorted) by its join keys; such tables join without a shuffle."""
    writer = df.repartition(buckets, *keys).write.mode(mode).format("parquet").bucketBy(buckets, *keys)
    if sort:
        writer = writer.sortBy(*keys)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    return df.sparkSession.table(table)


def load_data(spark: SparkSession, source: str, target: str, format: str, schema, overwrite: bool = False) -> None:
    """Add the rows of files to a table folder, or replace it with them."""
    spark.read.format(format).schema(schema).load(source).write.mode(
        "overwrite" if overwrite else "append").parquet(target)


def export_table(df: DataFrame, path: str, partitions: Sequence[str] = ()) -> None:
    """Data as Parquet next to the schema as JSON, to be read by :func:`import_table`."""
    df.write.partitionBy(*partitions).parquet(f"{path}/data") if partitions else df.write.parquet(f"{path}/data")
    spark = df.sparkSession
    spark.createDataFrame([(df.schema.json(),)], "value string").coalesce(1).write.text(f"{path}/schema")


def import_table(spark: SparkSession, path: str) -> DataFrame:
    import json

    schema = T.StructType.fromJson(json.loads(spark.read.text(f"{path}/schema").first()["value"]))
    return spark.read.schema(schema).parquet(f"{path}/data")


def write_jdbc(df: DataFrame, url: str, table: str, partitions: int = 8, mode: str = "append", **properties: str) -> None:
    """Rows to a database over a bounded number of connections."""
    df.coalesce(partitions).write.jdbc(url, table, mode=mode, properties=properties)


def read_avro(spark: SparkSession, path: str, schema_literal: str | None = None) -> DataFrame:
    """Avro files, read with a newer schema when given. Needs Spark's Avro module."""
    reader = spark.read.format("avro")
    if schema_literal:
        reader = reader.option("avroSchema", schema_literal)
    return reader.load(path)

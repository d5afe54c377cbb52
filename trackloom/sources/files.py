"""Files: lists of paths, sequence files, whole binary files, compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.sources.text import NULL_MARK


def read_symlinks(spark: SparkSession, link_files: str | list[str], format: str = "text", **options) -> DataFrame:
    """Read the files named, one per line, in text files.

    Only the list of paths passes through the driver, as with any file source.
    """
    paths = [r["value"] for r in spark.read.text(link_files).filter(F.trim("value") != "").toLocalIterator()]
    return spark.read.format(format).options(**options).load(paths)


def write_sequence(df: DataFrame, key: str, value: str, path: str) -> None:
    """Key / value pairs of text as a sequence file.

    All records of a file are of one class, so NULL is written as the mark of NULL.
    """
    pairs = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit(NULL_MARK)) for c in (key, value)])
    pairs.rdd.map(lambda row: (row[0], row[1])).saveAsSequenceFile(path)


def read_sequence(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of text; records without a key or value, and the mark of NULL, give NULL."""
    pairs = spark.createDataFrame(spark.sparkContext.sequenceFile(path), "key string, value string")
    return pairs.select(*[F.nullif(F.col(c), F.lit(NULL_MARK)).alias(c) for c in pairs.columns])


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def with_virtual_columns(df: DataFrame) -> DataFrame:
    """Add where in the input each row of a file table comes from."""
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("INPUT__FILE__NAME"),
        F.col("_metadata.file_block_start").alias("BLOCK__OFFSET__INSIDE__FILE"),
        F.col("_metadata.file_size").alias("FILE__SIZE"),
    )


def listed_files(df: DataFrame) -> DataFrame:
    """``path, length`` of the files behind a table, from their listing; no file is opened."""
    files = df.inputFiles()
    if not files:
        return df.sparkSession.createDataFrame([], "path string, length long")
    return df.sparkSession.read.format("binaryFile").load(files).select("path", "length")


def table_bytes(df: DataFrame) -> int:
    """Bytes of the files behind a table, from their listing."""
    return listed_files(df).agg(F.sum("length").alias("bytes")).first()["bytes"] or 0


def compact(spark: SparkSession, source: str, target: str, format: str = "parquet",
            file_bytes: int = 256 << 20) -> None:
    """Rewrite a folder of small files as files of about ``file_bytes``.

    The new folder is complete before anybody reads it; the old one stays.
    """
    df = spark.read.format(format).load(source)
    total = table_bytes(df)
    df.repartition(max(1, -(-total // file_bytes))).write.format(format).save(target)

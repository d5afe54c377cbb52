"""Connected components of a graph of links, as joins and partial aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.session import checkpoint_folder


# A session that has it on removes the shuffle files of an action when the action ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(frame: DataFrame) -> DataFrame:
    """Cut the lineage: the rows go to the shared checkpoint folder of the session.

    Nothing reads the shuffle files behind them again, so those are removed at once and
    not when the driver happens to collect its garbage: a chain of steps holds the disk
    of one. ``frame`` itself keeps the session's setting and can be used again.
    """
    spark = frame.sparkSession
    checkpoint_folder(spark)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        # The setting is read when a frame is made.
        return frame.select("*").checkpoint(eager=True)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def _flat(parents: DataFrame) -> DataFrame:
    """Parents replaced by roots. Every parent is smaller than its child, so halving ends."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        parents = saved(parents.join(up, "parent", "left").select(
            "node", F.coalesce("above", "parent").alias("parent"),
            F.col("above").isNotNull().alias("moved")))
        if parents.filter("moved").isEmpty():
            return parents.select("node", "parent")


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row (node, component) for each node that has a link to another node.

    ``component`` is the smallest node reachable. Rounds of hooking every node to its
    smallest neighbour and contracting the trees; each round is joins and partial
    aggregates on (node) keys, so a hub of any degree is combined before it is shuffled
    and its join partition is split at run time. Rows with a null end and links of a
    node to itself are ignored; no links give an empty result.
    """
    pair = links.select(F.col(a).alias("u"), F.col(b).alias("v"))
    pair = saved(pair.filter(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    labels = None
    while not pair.isEmpty():
        # u > v always: each u hooks to its smallest neighbour, which is below it.
        parents = _flat(pair.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("parent")))
        if labels is None:
            low = pair.select(F.col("v").alias("node")).distinct().join(
                parents, "node", "left_anti").select("node", F.col("node").alias("parent"))
            labels = parents.unionByName(low)
        else:
            step = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            labels = labels.join(step, "parent", "left").select(
                "node", F.coalesce("above", "parent").alias("parent"))
        labels = saved(labels)
        for end in ("u", "v"):
            step = parents.select(F.col("node").alias(end), F.col("parent").alias("root"))
            pair = pair.join(step, end, "left").withColumn(
                end, F.coalesce("root", end)).drop("root")
        pair = saved(pair.filter(F.col("u") != F.col("v")).select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if labels is None:
        return pair.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return labels.withColumnRenamed("parent", "component")

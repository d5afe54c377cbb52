"""Session factory and the runtime settings every operator relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that can be changed on a running session.
RUNTIME_SETTINGS = {
    # Bad casts give NULL, x / 0 gives NULL, overflow wraps.
    "spark.sql.ansi.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.legacy.sizeOfNull": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Interval joins key on (chromosome, node); a hot key is split at run time.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A task holds a batch as Arrow and again as objects, so batches are bounded in bytes.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that somebody else created."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(
    master: str | None = None, app: str = "trackloom", **settings: str
) -> SparkSession:
    """Create a session. On a cluster leave ``master`` to spark-submit."""
    # Checkpoints that nothing refers to any more are removed.
    settings = {"spark.cleaner.referenceTracking.cleanCheckpoints": "true", **settings}
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for checkpoints, as named by the cluster.

    Only when ``spark.checkpoint.dir`` is unset and the master is local, which
    is the case in tests, is a folder of our own made.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = os.path.join(tempfile.mkdtemp(prefix="trackloom-"), "checkpoints")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder

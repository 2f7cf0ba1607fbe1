"""Spark session helpers.

The cluster owns its configuration; these helpers only fill in what is
unset, so a job submitted to a real cluster keeps the cluster's shuffle
sizing, checkpoint folder and event-log settings.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings every job wants regardless of scale: adaptive execution re-plans
# joins from runtime sizes (broadcast only when the measured side is small),
# splits skewed shuffle partitions and coalesces tiny ones.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    # checkpoints written by `materialize` are removed once nothing references them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "chalkline",
                  extra: dict | None = None) -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", os.environ.get("CHALKLINE_DRIVER_MEMORY", "8g")))
    for key, value in {**_DEFAULTS, **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    A single-process local session (tests) without the setting gets a private
    scratch folder; on a cluster the folder must be one that all executors
    share, so there the missing setting is an error.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current                      # already registered (each registration adds a new sub-folder)
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="chalkline-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def materialize(df):
    """Cut the lineage of an intermediate that several branches of a plan
    read: a reliable checkpoint into the cluster's checkpoint folder (never
    a local checkpoint), so each branch reads stored rows and a lost
    executor does not force recomputing the whole upstream."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)

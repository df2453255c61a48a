"""Spark session helpers.

The library never creates a session behind the caller's back; these helpers only apply the
settings the operators are written for (AQE on, ANSI on, UTC, UI off, checkpoints removed when no
longer referenced) and set the checkpoint directory that the cluster names.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.scheduler.mode": "FAIR",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, app_name: str = "innsight",
                  shuffle_partitions: int | None = None, conf: dict | None = None) -> SparkSession:
    """Session with the library's defaults; explicit ``conf`` wins."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    merged = dict(DEFAULT_CONF)
    if shuffle_partitions:
        merged["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    merged.update(conf or {})
    for key, value in merged.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    named_checkpoint_dir(spark)
    return spark


def named_checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder that the deployment names in ``spark.checkpoint.dir``, set on the context; None where it
    names none: no folder is invented on one machine, small intermediate tables are persisted instead."""
    named = spark.conf.get("spark.checkpoint.dir", None) or \
        spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named

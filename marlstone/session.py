"""Session settings the operators are written for."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def session(master: str | None = None, name: str = "marlstone", **more: str) -> SparkSession:
    """A session with ``SETTINGS``; ``more`` has dots as double underscores."""
    builder = SparkSession.builder.appName(name).config(map=SETTINGS | {k.replace("__", "."): v for k, v in more.items()})
    return (builder.master(master) if master else builder).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only if unset.

    ``spark.checkpoint.dir`` is read from the session.  Without it a folder
    under the machine's temporary directory is set if driver and executors are
    one machine (local masters, as in tests); on a cluster that is an error.
    """
    named, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if context.getCheckpointDir() is None:
        alone = context.master == "local" or context.master.startswith("local[")
        if named is None and not alone:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="marlstone-"))
    return named or context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the shared checkpoint folder.

    Spark's cleaner deletes it when nothing refers to it any more.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)

"""Streams, an extension: new files as they come, late and repeated events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def new_rows(spark: SparkSession, path: str, like: DataFrame, per_trigger: int = 100) -> DataFrame:
    """Rows of Parquet files that appear in a folder."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def once(events: DataFrame, keys: list[str], at: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Each key once, as long as its repeats come within ``late``."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def windowed(events: DataFrame, by: str, at: str = "ts", width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per tumbling window; late rows are dropped."""
    stamped = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return stamped.groupBy(F.window(at, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def into(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """All that is there, batch by batch, then stop."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

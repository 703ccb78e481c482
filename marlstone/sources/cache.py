"""A keyed response cache as snapshots: look up, store, delete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.dedup import keep_first


def cache_key(*parts: Column) -> Column:
    """SHA-256 of a canonical JSON of the named parts."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def look_up(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests with their responses; ``hit`` says whether there is one."""
    found = cache.select("cache_key", "response_text")
    return requests.join(found, "cache_key", "left").withColumn("hit", F.col("response_text").isNotNull())


def store(cache: DataFrame, rows: DataFrame) -> DataFrame:
    """The latest response of each key; empty ones aren't stored."""
    kept = rows.filter(F.trim("response_text") != "").withColumn("__new", F.lit(1))
    union = cache.withColumn("__new", F.lit(0)).unionByName(kept)
    return keep_first(union, ["cache_key"], [F.desc("created_at"), F.desc("__new"), F.desc("response_text")]).drop("__new")


def delete(cache: DataFrame, keys: DataFrame) -> DataFrame:
    return cache.join(keys.select("cache_key"), "cache_key", "left_anti")

"""What the query modules share."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fixed day on which overdue days are counted.
DAY = "1998-08-02"


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


class Catalogue(dict):
    """Queries by name; ``sql`` registers a function with its DuckDB SQL."""

    def sql(self, text: str | None) -> Callable:
        def register(f: Callable) -> Callable:
            self[f.__name__] = Query(lambda spark, sf_dir: f(Tables(spark, sf_dir)), text)
            return f

        return register


class Tables:
    """``t.orders`` reads the orders of one directory."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def cents(x) -> Column:
    return F.round(x, 2)

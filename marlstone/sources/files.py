"""Files in: code of any encoding, knowledge texts, manifests, templates."""

from __future__ import annotations

import codecs
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.splitting import chunked

_MARKS = [(codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")]


def decoded(raw: bytes) -> str:
    """By mark; else UTF-16 if a tenth of the bytes are zero, on one side; else UTF-8."""
    for mark, encoding in _MARKS:
        if raw.startswith(mark):
            return raw.decode(encoding, "replace")
    even, odd = raw[::2].count(0), raw[1::2].count(0)
    if raw and (even + odd) / len(raw) > 0.1:
        return raw.decode("utf-16-le" if odd >= even else "utf-16-be", "replace")
    return raw.decode("utf-8", "replace")


def read_objects(spark: SparkSession, path: str | list[str], glob: str = "*.sql") -> DataFrame:
    """path, object_id (the name without its ending) and code of each file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)

    @F.pandas_udf("string")
    def text(contents: pd.Series) -> pd.Series:
        return contents.map(lambda b: decoded(bytes(b)))

    name = F.regexp_extract("path", r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)
    return files.select("path", name.alias("object_id"), text("content").alias("code"))


def read_knowledge(spark: SparkSession, path: str, most: int = 800, overlap: int = 100) -> DataFrame:
    """id, source and text of the chunks of .md and .txt files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{md,txt}").option("recursiveFileLookup", "true").load(path)
    stem = F.regexp_extract("path", r"([^/\\]+?)\.[^./\\]*$", 1)
    chunks = files.select(stem.alias("source"), F.posexplode(chunked(F.decode("content", "UTF-8"), most, overlap)).alias("n", "text"))
    return chunks.select(F.concat_ws("_", "source", "n").alias("id"), "source", "text")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The cases of a manifest: an array, or an object with one."""
    cases = spark.read.option("multiLine", "true").json(path)
    return cases.select(F.explode("cases").alias("case")).select("case.*") if "cases" in cases.columns else cases


def rendered(template: str, **values) -> Column:
    """A template with {name} places taken by columns; null counts as ''."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(F.lit(p) if k % 2 == 0 else F.coalesce(values[p].cast("string"), F.lit("")) for k, p in enumerate(parts)))

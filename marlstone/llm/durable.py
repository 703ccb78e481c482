"""Cutting lineage so that a lost executor costs a re-read, never a re-run."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from marlstone.session import checkpointed, shared_dir

#: Rows that a worker holds as Python objects at once.
ROWS = 512


durable = checkpointed


def drop(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """``name``, longer if ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


@contextmanager
def tables(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Keeps what is large as Parquet in the shared folder, a checkpoint being
    uncompressed; the tables are deleted in the end, so what is made of them
    must be durable by then."""
    folder = f"{shared_dir(spark).rstrip('/')}/marlstone-{uuid.uuid4().hex}"
    made: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        made.append(f"{folder}/{len(made)}")
        df.write.option("compression", "zstd").parquet(made[-1])
        return spark.read.schema(df.schema).parquet(made[-1])

    try:
        yield keep
    finally:
        drop(spark, folder)


def trim() -> None:
    """Gives memory that is free back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:
        # not glibc
        pass


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches`` in slices of ``ROWS``; at the end of the task the worker,
    which waits for its next one, gives back the memory that it has freed."""
    for batch in batches:
        for at in range(0, max(batch.num_rows, 1), ROWS):
            yield batch.slice(at, ROWS)
    trim()

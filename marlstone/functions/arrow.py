"""Python functions over columns, without pandas in between."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string


def parts(f: Callable, of: pa.DataType, arrays: tuple, rows: int) -> Iterator[pa.Array]:
    """Results of a batch, of so many rows at a time."""
    for at in range(0, len(arrays[0]), rows):
        yield pa.array([f(*row) for row in zip(*(a.slice(at, rows).to_pylist() for a in arrays))], of)


def mapped(f: Callable, kind: str, *columns: Column, rows: int = 128, once: bool = False) -> Column:
    """``f`` of the values of each row, as ``kind``.

    ``rows`` at a time are Python objects; the rest of a batch is Arrow, which
    holds nested results in a fraction of the memory and makes them in one call.
    With ``once``, filters on the result stay above it: Spark would else run the
    function a second time for them, below the exchange that deals the rows out.
    """
    of = to_arrow_type(_parse_datatype_string(kind))

    @F.arrow_udf(kind)
    def run(*arrays: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array([], of), *parts(f, of, arrays, rows)])

    return (run.asNondeterministic() if once else run)(*columns)


def streamed(f: Callable, kind: str, *columns: Column, rows: int = 64) -> Column:
    """``mapped`` for long results: they leave the worker ``rows`` at a time, so
    that it holds what it reads and no whole batch of results.  Spark runs such
    a function in a worker of its own."""
    of = to_arrow_type(_parse_datatype_string(kind))

    def run(batches: Iterator) -> Iterator[pa.Array]:
        for batch in batches:
            yield from parts(f, of, batch if isinstance(batch, tuple) else (batch,), rows)

    return F.arrow_udf(run, kind, ArrowUDFType.SCALAR_ITER)(*columns)

"""Python functions over columns whose memory doesn't grow with the table."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

#: Rows whose values are Python objects at one time.
ROWS = 128
BATCH_BYTES = 8 << 20


def in_slices(one: Callable, kind: pa.DataType) -> Callable:
    """Arrays to the array of ``one`` of each row."""

    def run(*arrays: pa.Array) -> pa.Array:
        parts = [pa.array([one(*row) for row in zip(*(a.slice(at, ROWS).to_pylist() for a in arrays), strict=True)], kind) for at in range(0, len(arrays[0]), ROWS)]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return run


def mapped(one: Callable, kind: pa.DataType, returns: DataType, *columns: Column, once: bool = False) -> Column:
    """``one`` of each row's values, nulls included; ``once``: also where the result is exploded.

    Spark sends up to 10,000 rows at once, whatever their texts hold; batches are cut by bytes instead,
    and only a few rows of one are Python objects at a time.
    """

    spark = SparkSession.getActiveSession()
    if spark is not None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    made = F.arrow_udf(_of(in_slices(one, kind), len(columns)), returns)
    return (made.asNondeterministic() if once else made)(*columns)


def _of(run: Callable, n: int) -> Callable:
    """The function with as many named parameters, as Spark reads annotations off them."""

    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return run(a, b)

    def single(a: pa.Array) -> pa.Array:
        return run(a)

    return {1: single, 2: two}[n]

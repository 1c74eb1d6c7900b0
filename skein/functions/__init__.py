"""Functions as values: Python closures where no expression will do, over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType


def scalar(func: Callable[[pa.Array], pa.Array], kind: DataType | str) -> Callable[..., Column]:
    """A function of whole Arrow columns as a column expression."""
    return F.arrow_udf(func, kind)


def flat_map_rows(func: Callable[[dict], Iterator[dict]], schema: pa.Schema, batch: int = 1024) -> Callable:
    """For ``Flow.map_arrow``: a function from a row to any number of rows, even without end, given out ``batch`` at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for b in batches:
            for row in b.to_pylist():
                for out in func(row):
                    held.append(out)
                    if len(held) == batch:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    return run


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def dot(a: Column, b: Column) -> Column:
    """Of two arrays of numbers."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def either(flow_column: str = "either") -> tuple[Column, Column, Column]:
    """tag, a, b of a tagged union."""
    c = F.col(flow_column)
    return c["tag"], c["a"], c["b"]

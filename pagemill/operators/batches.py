"""Rewriting one text column in Python, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def rewrite(df: DataFrame, column: str, inputs: list[str], fn: Callable) -> DataFrame:
    """``df`` with ``column`` replaced by ``fn`` of the ``inputs`` of each row; a NULL first input stays NULL.

    This is a node of the plan, not an expression: the optimiser neither repeats it nor moves it into other expressions.
    """
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(b.schema.get_field_index(c)).to_pylist() for c in inputs]
            new = pa.array([None if r[0] is None else fn(*r) for r in zip(*cols)], type=pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:at], new, *b.columns[at + 1 :]], names=b.schema.names)

    return df.mapInArrow(run, df.schema)

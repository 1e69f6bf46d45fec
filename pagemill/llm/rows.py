"""Arrow-batched row mapping shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


#: Rows of a batch that are Python objects at once.
ROWS = 1000


def map_batches(df: DataFrame, make: Callable[[], Callable[[list[list]], list[list]]], schema: str | StructType, rows: int | None = ROWS) -> DataFrame:
    """Apply a column-list function to the Arrow batches of ``df``, ``rows`` at a time (None: a whole batch, for functions that sum up).

    ``make`` is called once per task and returns a function from columns (lists) to the result's columns (lists, or arrays
    of the result's type where those are costly to make of Python objects).
    """
    struct = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows or max(1, batch.num_rows)):
                part = batch.slice(at, rows) if rows else batch
                cols = fn([c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return df.mapInArrow(run, struct)

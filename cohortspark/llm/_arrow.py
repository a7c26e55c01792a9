"""Small helpers to run a batch function over the rows of a DataFrame through Arrow."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from cohortspark.llm._words import slices

#: Rows that a batch function sees at once; bounds the Python strings alive in a task.
SLICE_ROWS = 2000


def map_batches(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str) -> DataFrame:
    """Apply ``make()`` (called once per task) to slices of columns given as Python lists.

    The batch function gets {column: values} and returns {column: values} of the output schema; the number of
    rows may differ. Batches without output rows are skipped.
    """
    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = to_arrow_schema(kind)
        work = make()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                out = work({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                arrays = [x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for f in fields for x in (out[f.name],)]
                if len(arrays[0]):
                    yield pa.RecordBatch.from_arrays(arrays, schema=fields)

    return df.mapInArrow(run, kind)


def map_arrow(df: DataFrame, work: Callable[[pa.RecordBatch], dict], schema: str, by_text: str, first: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None) -> DataFrame:
    """Apply ``work`` to slices of record batches that hold a bounded number of bytes of the text column.

    ``first`` may filter a batch before it is cut. The function returns {column: array or values} of the output schema.
    """
    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = to_arrow_schema(kind)
        for batch in batches:
            if first is not None:
                batch = first(batch)
            for part in slices(batch.column(by_text)):
                out = work(batch.slice(part.start, part.stop - part.start))
                arrays = [x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for f in fields for x in (out[f.name],)]
                if len(arrays[0]):
                    yield pa.RecordBatch.from_arrays(arrays, schema=fields)

    return df.mapInArrow(run, kind)

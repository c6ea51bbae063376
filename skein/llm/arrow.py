"""Small helpers around mapInArrow."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Rows that a function gets at once, and that Spark sends to a Python worker at once: both bound what a worker holds.
SLICE = 256
BATCH = 1024


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list] | None]], schema: str, arrays: bool = False) -> DataFrame:
    """``make()`` is called once a task and gives a function from columns (lists) to columns (lists of any other
    length, or None). If that function has a method ``finish``, it gives last rows. With ``arrays``, columns come as
    NumPy arrays, a whole batch at once."""
    from pyspark.sql.pandas.types import to_arrow_schema

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    first = arrow.names[0]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()

        def pack(columns: dict[str, list] | None) -> Iterator[pa.RecordBatch]:
            if columns and len(columns[first]):
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in arrow], schema=arrow)

        for part in batches if arrays else slices(batches):
            columns = enumerate(part.schema.names)
            yield from pack(function({name: part.column(i).to_numpy(zero_copy_only=False) if arrays else part.column(i).to_pylist() for i, name in columns}))
        if hasattr(function, "finish"):
            yield from pack(function.finish())

    return df.mapInArrow(run, schema)

"""Appending computed columns in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def append_columns(
    df: DataFrame,
    added: T.StructType,
    make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]],
) -> DataFrame:
    """``df`` with the columns ``added``, computed batch by batch.

    ``make`` runs once in each task and returns the function that computes the
    new arrays of a batch. A column of ``df`` that bears an added name is
    replaced; names are compared as they stand.
    """
    fresh = {f.name for f in added}
    kept = [f for f in df.schema if f.name not in fresh]
    schema = T.StructType(kept + list(added))
    arrow = to_arrow_schema(schema)
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            if batch.num_rows == 0:
                continue
            old = [batch.column(batch.schema.get_field_index(n)) for n in names]
            new = compute(batch)
            cols = [a if a.type == f.type else a.cast(f.type) for a, f in zip(old + new, arrow)]
            yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return df.mapInArrow(run, schema)

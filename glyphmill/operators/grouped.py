"""Streaming small groups through Python: one shuffle by key, then one pass per partition."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from glyphmill.lineage import python_partitions

_FLUSH = 4000


def map_groups(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[list[dict]], Iterable[dict]], schema: str) -> DataFrame:
    """``fn`` of the rows of each group, in order; yields rows of ``schema``.

    A group (a line, a page) has to fit in the memory of a task; groups are handled
    one after the other, without a call into the JVM for each.
    """
    out = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(out)
    rows = df.repartition(python_partitions(df), *keys).sortWithinPartitions(*keys, *order)

    def run(batches):
        group: list[dict] = []
        at: tuple | None = None
        done: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != at and group:
                    done += fn(group)
                    group = []
                    if len(done) >= _FLUSH:
                        yield pa.RecordBatch.from_pylist(done, schema=arrow)
                        done = []
                at = key
                group.append(row)
        if group:
            done += fn(group)
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=arrow)

    return rows.mapInArrow(run, out)

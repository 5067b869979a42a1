"""Filling containers of fixed capacity with texts (problem 7).

Bounded-space online packing: each task keeps at most ``windows`` open
containers. An item goes to the open container with the least free space that
still holds it; if none does, the fullest is emitted and a new one opened. What
is open at the end of a task is merged with the leftovers of other tasks, in a
tree whose groups hold at most ``fan_in * windows`` rows, so no step gathers
more than that in one place however large the corpus is.

A text of more tokens than the capacity is cut into full containers and one
remainder. Null and empty texts have no tokens and still get a container, where
they take no space. Each input row gives at least one output row, repeats too.
"""

from __future__ import annotations

import os
from bisect import bisect_left, insort

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.lineage import cut
from glyphmill.llm.byte_bpe import BYTE_BPE_50K, TOKENIZERS, encoder_source

CAPACITY = 2048
#: Open containers of a task.
WINDOWS = 128
#: Tasks (or groups of them) whose leftovers are merged at once.
FAN_IN = 32

_PLACED = T.StructType(
    [T.StructField("piece", T.IntegerType())]
    + [T.StructField(n, T.LongType()) for n in ("start_token", "n_tokens")]
    + [T.StructField("part", T.LongType()), T.StructField("win", T.LongType()), T.StructField("at", T.LongType()), T.StructField("pending", T.BooleanType())]
)


class Packer:
    """Best-fit into at most ``windows`` open containers; holds their items until they close."""

    def __init__(self, capacity: int, windows: int):
        self.capacity, self.windows = capacity, windows
        self._open: list[tuple[int, int]] = []  # (free space, container), sorted
        self._items: dict[int, list[tuple]] = {}
        self._next = 0
        self.closed: list[tuple[int, list[tuple]]] = []

    def add(self, size: int, item) -> None:
        i = bisect_left(self._open, (size, -1))
        if i == len(self._open):
            if len(self._open) >= self.windows:
                self._close(0)
            free, win = self.capacity, self._next
            self._next += 1
            self._items[win] = []
        else:
            free, win = self._open.pop(i)
        self._items[win].append((item, self.capacity - free))
        insort(self._open, (free - size, win))
        if free == size:
            self._close(0)

    def _close(self, i: int) -> None:
        _, win = self._open.pop(i)
        self.closed.append((win, self._items.pop(win)))

    def whole(self, item) -> None:
        """A full container of its own."""
        self.closed.append((self._next, [(item, 0)]))
        self._next += 1

    def host(self) -> tuple[int, int]:
        """The fullest open container and its fill, for an item without size; opens one if there is none."""
        if not self._open:
            self._items[self._next] = []
            self._open.append((self.capacity, self._next))
            self._next += 1
        free, win = self._open[0]
        return win, self.capacity - free

    def rest(self) -> list[tuple[int, int, list[tuple]]]:
        """(container, fill, items) of what is open."""
        return [(win, self.capacity - free, self._items[win]) for free, win in self._open]


def _merge_leftovers(capacity: int, keep: int):
    """Best-fit decreasing over leftover containers; the ``keep`` emptiest results stay open for the next level."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        boxes = pdf.groupby("cont", sort=True).agg(fill=("top", "max")).reset_index()
        boxes = boxes.sort_values(["fill", "cont"], ascending=[False, True])
        bins: list[list] = []  # [free, name]
        order: list[tuple[int, int]] = []
        moved: dict[int, tuple[int, int]] = {}
        for cont, fill in zip(boxes["cont"].tolist(), boxes["fill"].tolist()):
            i = bisect_left(order, (fill, -1))
            if i < len(order):
                free, b = order.pop(i)
            else:
                free, b = capacity, len(bins)
                bins.append([capacity, cont])
            moved[cont] = (bins[b][1], capacity - free)
            insort(order, (free - fill, b))
            bins[b][0] = free - fill
        stay = {bins[b][1] for _, b in order[::-1][:keep]} if keep else set()
        out = pdf.copy()
        new = out["cont"].map(moved)
        out["base"] = out["base"] + [m[1] for m in new]
        out["top"] = out["top"] + [m[1] for m in new]
        out["cont"] = [m[0] for m in new]
        out["open"] = out["cont"].isin(stay)
        return out

    return merge


def pack(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    windows: int = WINDOWS,
    fan_in: int = FAN_IN,
    path: str | None = None,
) -> DataFrame:
    """Rows (key, piece, start_token, n_tokens, container_id, at).

    ``at`` is where the piece begins within its container. A container never
    holds more than ``capacity`` tokens. Ids of containers are unique but not
    dense; which container a text gets depends on how the input is split. Null keys
    are kept, repeated rows are packed each, columns other than key and text are left
    out; of containers that fit equally well the older one is taken.
    """
    source = encoder_source(df.sparkSession, path or os.path.join(TOKENIZERS, BYTE_BPE_50K))
    key_type = df.schema[key]
    schema = T.StructType([T.StructField("key", key_type.dataType), *_PLACED])
    names = schema.names

    def run(batches):
        encode = source().encode
        part = TaskContext.get().partitionId()
        packer = Packer(capacity, windows)
        key_arrow = pa.null()

        def emit(rows):
            cols = list(zip(*rows)) if rows else [[]] * len(names)
            arrays = [pa.array(cols[0], key_arrow), pa.array(cols[1], pa.int32())]
            arrays += [pa.array(c, pa.int64()) for c in cols[2:7]] + [pa.array(cols[7], pa.bool_())]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            key_column = batch.column(batch.schema.get_field_index(key))
            key_arrow = key_column.type
            rows = []
            for k, t in zip(key_column.to_pylist(), batch.column(batch.schema.get_field_index(text)).to_pylist()):
                n = len(encode(t)) if t else 0
                if not n:
                    win, at = packer.host()
                    rows.append((k, 0, 0, 0, part, win, at, True))
                    continue
                full, left = divmod(n, capacity)
                for p in range(full):
                    packer.whole((k, p, p * capacity, capacity))
                if left:
                    packer.add(left, (k, full, full * capacity, left))
            for win, items in packer.closed:
                rows += [(*item, part, win, at, False) for item, at in items]
            packer.closed.clear()
            if rows:
                yield emit(rows)
        rows = []
        for win, fill, items in packer.rest():
            rows += [(*item, part, win, at, True) for item, at in items]
            rows.append((None, -1, 0, fill, part, win, 0, True))  # the container itself
        for win, items in packer.closed:
            rows += [(*item, part, win, at, False) for item, at in items]
        if rows:
            yield emit(rows)

    placed = cut(df.select(F.col(key), F.col(text)).mapInArrow(run, schema))
    own = F.col("part") * F.lit(1 << 32) + F.col("win")
    left = placed.filter("piece = -1").select("part", "win", own.alias("cont"), F.lit(0).cast("long").alias("base"), F.col("n_tokens").alias("top"), F.lit(True).alias("open"))
    parts = (left.agg(F.max("part")).first()[0] or 0) + 1
    done = None
    width = 1
    while True:
        width *= fan_in
        last = width >= parts
        left = left.groupBy((F.col("part") / width).cast("long").alias("grp")).applyInPandas(_merge_leftovers(capacity, 0 if last else windows), left.schema)
        if not last:
            left = cut(left)
        closed = left.filter("NOT open")
        done = closed if done is None else done.unionByName(closed)
        if last:
            break
        left = left.filter("open")
    moved = done.select(F.col("part").alias("_part"), F.col("win").alias("_win"), "cont", "base")
    items = placed.filter("piece >= 0").withColumn("own", own)
    settled = items.filter("NOT pending").select("key", "piece", "start_token", "n_tokens", F.col("own").alias("container_id"), "at")
    waiting = items.filter("pending").join(moved, (F.col("part") == F.col("_part")) & (F.col("win") == F.col("_win")), "left")
    waiting = waiting.select(
        "key", "piece", "start_token", "n_tokens", F.coalesce("cont", "own").alias("container_id"), (F.col("at") + F.coalesce("base", F.lit(0))).alias("at")
    )
    return settled.unionByName(waiting).withColumnRenamed("key", key)

"""Encoding a corpus with a public byte-level BPE vocabulary (problem 6).

The merges of a pre-token are chosen from a hierarchical-bitmap rank queue:
there is a bucket for each merge rank, holding positions in a linked list of
parts; a bitmap with three levels says which buckets hold anything, and the next
rank is found by find-first-set from the top level down. Positions whose pair
has changed since are stale and skipped when they come up. Every merge is thus
O(1) apart from sorting buckets, so a pre-token of n bytes takes O(n log n),
where scanning for the best pair would take O(n^2).
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Where the public vocabularies lie, and the one that the queries use.
TOKENIZERS = os.environ.get("GLYPHMILL_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"

#: Fixed value: the published pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A task keeps the ids of this many distinct pre-tokens of at most CACHED_BYTES bytes.
CACHE_SIZE = 200_000
CACHED_BYTES = 64

#: A vocabulary file is sent to the executors; larger ones are refused.
MAX_VOCABULARY_BYTES = 64 << 20


class RankQueue:
    """A set of ranks below ``size`` with the least one found by three find-first-set steps."""

    __slots__ = ("_low", "_mid", "_top", "buckets")

    def __init__(self, size: int):
        self._low = [0] * ((size >> 6) + 1)
        self._mid = [0] * ((size >> 12) + 1)
        self._top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        word = rank >> 6
        self._low[word] |= 1 << (rank & 63)
        self._mid[word >> 6] |= 1 << (word & 63)
        self._top |= 1 << (word >> 6)

    def least(self) -> int:
        """The least rank present, or -1."""
        top = self._top
        if not top:
            return -1
        block = (top & -top).bit_length() - 1
        mid = self._mid[block]
        word = (block << 6) + (mid & -mid).bit_length() - 1
        low = self._low[word]
        return (word << 6) + (low & -low).bit_length() - 1

    def take(self, rank: int) -> list[int]:
        """The positions of ``rank``, which leaves the queue."""
        word = rank >> 6
        self._low[word] &= ~(1 << (rank & 63))
        if not self._low[word]:
            self._mid[word >> 6] &= ~(1 << (word & 63))
            if not self._mid[word >> 6]:
                self._top &= ~(1 << (word >> 6))
        return self.buckets.pop(rank)


class ByteBpe:
    """An encoder for the content of a rank file (base64 token and rank in each line)."""

    def __init__(self, content: bytes, pattern: str = PATTERN):
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}
        self._split = regex.compile(pattern).findall
        self._queue = RankQueue(max(self.ranks.values()) + 1)
        self._cache: dict[str, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        queue = self._queue
        # part i spans piece[i:nxt[i]]; a dead part has nxt 0; due[i] is the rank of parts i and nxt[i]
        nxt = list(range(1, n + 1))
        prv = list(range(-1, n - 1))
        due = [-1] * n
        for i in range(n - 1):
            rank = ranks.get(piece[i : i + 2])
            if rank is not None:
                due[i] = rank
                queue.push(rank, i)
        while (rank := queue.least()) >= 0:
            positions = sorted(queue.take(rank))
            for k, i in enumerate(positions):
                if due[i] != rank:
                    continue  # stale
                due[i] = -1
                j = nxt[i]
                end = nxt[j]
                nxt[j] = 0
                due[j] = -1
                nxt[i] = end
                lower = False
                if end < n:
                    prv[end] = i
                    r = ranks.get(piece[i : nxt[end]])
                    due[i] = -1 if r is None else r
                    if r is not None:
                        queue.push(r, i)
                        lower = r < rank
                h = prv[i]
                if h >= 0:
                    r = ranks.get(piece[h:end])
                    due[h] = -1 if r is None else r
                    if r is not None:
                        queue.push(r, h)
                        lower |= r < rank
                if lower:  # a lower rank goes first; what is left of this bucket waits
                    for rest in positions[k + 1 :]:
                        queue.push(rank, rest)
                    break
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : nxt[i]]])
            i = nxt[i]
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a text; strings of special tokens are ordinary text."""
        cache = self._cache
        out: list[int] = []
        for piece in self._split(text):
            ids = cache.get(piece)
            if ids is None:
                raw = piece.encode("utf-8", "surrogatepass")
                ids = self.merge(raw)
                if len(raw) <= CACHED_BYTES:
                    if len(cache) >= CACHE_SIZE:
                        cache.clear()
                    cache[piece] = ids
            out += ids
        return out


def read_vocabulary(path: str) -> bytes:
    """Content of a rank file, read once by the driver; its size is checked."""
    if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    with open(path, "rb") as f:
        return f.read()


_ENCODERS: dict[int, ByteBpe] = {}


def encoder_source(spark: SparkSession, path: str) -> Callable[[], ByteBpe]:
    """What gives the encoder within a task; each Python worker builds it once."""
    content = read_vocabulary(path)
    shared = spark.sparkContext.broadcast(content)
    mark = hash(content)

    def get() -> ByteBpe:
        if mark not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[mark] = ByteBpe(shared.value)
        return _ENCODERS[mark]

    return get


def list_array(lists: Iterator[list[int]]) -> pa.Array:
    """A list<int32> array, built from one flat buffer."""
    offsets, flat = [0], []
    for ids in lists:
        flat += ids
        offsets.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(np.array(offsets, np.int32)), pa.array(np.array(flat, np.int32)))


def encode_texts(df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None) -> DataFrame:
    """``df`` without ``text`` and with ``ids``, the ids of each text.

    Null and empty texts get an empty list. Other columns stay as they are; one
    named ``ids`` is replaced. A narrow operation: no shuffle, whole texts, and
    repeated rows give repeated results.
    """
    source = encoder_source(df.sparkSession, path or os.path.join(TOKENIZERS, BYTE_BPE_50K))
    kept = [f for f in df.schema if f.name not in (text, ids)]
    schema = T.StructType([*kept, T.StructField(ids, T.ArrayType(T.IntegerType()))])
    names = [f.name for f in kept]

    def run(batches):
        encode = source().encode
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            # slices bound the memory of the flat ids where texts are long
            step = max(1, min(batch.num_rows, 4_000_000 // max(1, sum(len(t or "") for t in texts) // max(1, batch.num_rows))))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                column = list_array(encode(t) if t else [] for t in texts[at : at + step])
                old = [part.column(part.schema.get_field_index(n)) for n in names]
                yield pa.RecordBatch.from_arrays([*old, column], names=[*names, ids])

    return df.mapInArrow(run, schema)

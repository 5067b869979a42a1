"""How often, and in how many records, every distinct term occurs (problem 3).

Last-seen counters. Rows are hash-partitioned by term and sorted by record, and each
task keeps for every term it meets its occurrences, its records and the last record
it was seen in; a record counts when it differs from the last one. No set of records
is kept for any term.

Skew does no harm. Copies of a row are made one before, by an aggregate with a
map-side part. The hash is over the term and a salt of the record, so a term with a
third of all rows is spread over all tasks, and as a record has one salt, no record
of a term is in two tasks and the counts of tasks are plain sums. A record with a
third of all rows is spread by its terms.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.lineage import cut, python_partitions

#: A task hands on its counters when it holds this many terms; only those of the open record stay.
MAX_TERMS = 1_000_000
RARE_RECORDS = 2
COMMON_SHARE = 0.4

_SCHEMA = "term string, occurrences long, records long"


class LastSeen:
    """Counters of one task: occurrences, records and the number of the last record of each term."""

    def __init__(self, max_terms: int):
        self._max = max_terms
        self._index: dict[str, int] = {}
        self._terms: list[str] = []
        self._occ = np.zeros(1024, np.int64)
        self._rec = np.zeros(1024, np.int64)
        self._last = np.full(1024, -1, np.int64)

    def _code(self, term: str) -> int:
        i = self._index.get(term)
        if i is None:
            i = self._index[term] = len(self._terms)
            self._terms.append(term)
            if i == len(self._occ):
                more = len(self._occ)
                self._occ = np.concatenate([self._occ, np.zeros(more, np.int64)])
                self._rec = np.concatenate([self._rec, np.zeros(more, np.int64)])
                self._last = np.concatenate([self._last, np.full(more, -1, np.int64)])
        return i

    def add(self, terms: pa.Array, record: np.ndarray) -> None:
        """Terms of consecutive rows and the numbers of their records, which never fall."""
        coded = terms.dictionary_encode()
        to_global = np.array([self._code(t) for t in coded.dictionary.to_pylist()], np.int64)
        codes = to_global[coded.indices.to_numpy(zero_copy_only=False)]
        n = len(self._terms)
        self._occ[:n] += np.bincount(codes, minlength=n)
        order = np.argsort(codes, kind="stable")
        c, r = codes[order], record[order]
        head = np.ones(len(c), bool)
        head[1:] = c[1:] != c[:-1]
        new = head.copy()
        new[1:] |= r[1:] != r[:-1]
        new[head] = self._last[c[head]] != r[head]
        self._rec[:n] += np.bincount(c[new], minlength=n)
        tail = np.ones(len(c), bool)
        tail[:-1] = head[1:]
        self._last[c[tail]] = r[tail]

    def full(self) -> bool:
        return len(self._terms) > self._max

    def drain(self, current: int = -1) -> pa.RecordBatch:
        """Rows of all counters so far; forgets them, but for what was seen in the ``current`` record."""
        n = len(self._terms)
        columns = [pa.array(self._terms, pa.string()), pa.array(self._occ[:n]), pa.array(self._rec[:n])]
        keep = [t for t, last in zip(self._terms, self._last) if last == current]
        self.__init__(self._max)
        for term in keep:
            self._last[self._code(term)] = current
        return pa.RecordBatch.from_arrays(columns, names=["term", "occurrences", "records"])


_START = object()


def term_counts(df: DataFrame, record: str, term: str, keys: list[str], max_terms: int = MAX_TERMS) -> DataFrame:
    """Rows (term, occurrences, records); the row whose term is null counts the rows and records of all.

    ``keys`` are the columns that, with ``record``, identify a row: repeats count
    once, nulls being equal to each other. Null and empty terms give no row but
    their records count in the total. A null record is a record of its own.
    """
    keys = [k for k in keys if k not in (record, term)]
    rows = df.select(F.col(record).cast("string").alias("record"), F.col(term).cast("string").alias("term"), *[F.col(k).alias(f"key{i}") for i, k in enumerate(keys)])
    once = rows.distinct().select("record", "term")
    parts = python_partitions(rows)
    salted = once.repartition(parts, F.coalesce("term", F.lit("")), F.pmod(F.xxhash64("record"), F.lit(parts))).sortWithinPartitions("record")

    def run(batches):
        counters = LastSeen(max_terms)
        above: object = _START
        number, n_rows = -1, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column(0).dictionary_encode(null_encoding="encode")
            codes = coded.indices.to_numpy(zero_copy_only=False)
            starts = np.ones(len(codes), bool)
            starts[1:] = codes[1:] != codes[:-1]
            starts[0] = batch.column(0)[0].as_py() != above
            above = batch.column(0)[-1].as_py()
            numbers = number + np.cumsum(starts)
            number = int(numbers[-1])
            n_rows += batch.num_rows
            terms = batch.column(1)
            real = pc.fill_null(pc.not_equal(terms, ""), False)
            at = np.flatnonzero(real.to_numpy(zero_copy_only=False))
            if len(at):
                counters.add(terms.filter(real), numbers[at])
            if counters.full():
                yield counters.drain(number)
        yield counters.drain()
        if n_rows:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([n_rows]), pa.array([0])], names=["term", "occurrences", "records"])

    # all records, from a scan of that column alone
    records = df.groupBy(F.col(record).cast("string")).agg(F.lit(1)).groupBy().count().filter("count > 0")
    total = records.select(F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("occurrences"), F.col("count").alias("records"))
    partial = salted.mapInArrow(run, _SCHEMA).unionByName(total)
    return partial.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def mark_terms(counts: DataFrame, rare: int = RARE_RECORDS, common: float = COMMON_SHARE) -> DataFrame:
    """Terms with ``mark``: rare (at most ``rare`` records), else common (more than a share of all records), else null.

    ``counts`` has the columns of :func:`term_counts` and any grouping column
    ``src``. It is written once, since totals and terms both read it.
    """
    counts = cut(counts)
    totals = counts.filter("term IS NULL").select("src", F.col("records").alias("all_records"))  # one row for each src
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > F.lit(common) * F.col("all_records"), "common")
    return counts.filter("term IS NOT NULL").join(F.broadcast(totals), "src").withColumn("mark", mark).drop("all_records")

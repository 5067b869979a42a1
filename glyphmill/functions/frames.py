"""Array functions on per-frame label scores: greedy decoding of recognisers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def frames(matrix: Column, labels: int) -> Column:
    """A flat row-major matrix as an array of frames of ``labels`` scores; null for a null matrix."""
    count = (F.size(matrix) / labels).cast("int")
    at = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(matrix.isNotNull(), F.transform(at, lambda t: F.slice(matrix, t * labels + 1, labels)))


def arg_max(scores: Column) -> Column:
    """Position of the greatest score from 0; of equals the first."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def best_labels(matrix: Column, labels: int) -> Column:
    return F.transform(frames(matrix, labels), arg_max)


def collapse(path: Column, blank: int) -> Column:
    """The labels of a frame path: blanks and repeats of the frame before are dropped."""
    return F.filter(path, lambda x, i: (x != blank) & ((i == 0) | (F.element_at(path, F.greatest(i, F.lit(1))) != x)))


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    powers = F.transform(scores, lambda x: F.exp(x.cast("double") - top.cast("double")))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def top_k(scores: Column, k: int) -> Column:
    """Positions of the k greatest scores, greatest first; of equals the later position goes first."""
    pairs = F.transform(scores, lambda x, i: F.struct(-x, -i, i.alias("at")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: p["at"])


def least_best(matrix: Column, labels: int) -> Column:
    """The least of the frames' best scores."""
    return F.array_min(F.transform(frames(matrix, labels), F.array_max))


def log_add(a: Column, b: Column) -> Column:
    """log(exp a + exp b), with everything at or below -87 standing for log 0."""
    high, low = F.greatest(a, b), F.least(a, b)
    return F.when(high <= -87.0, F.lit(-87.0)).when(low <= -87.0, high).otherwise(high + F.log1p(F.exp(low - high)))


def span_from_peak(weights: Column, least: float) -> Column:
    """struct(first, last): the greatest weight and the positions right of it that stay at or above ``least``."""
    at = arg_max(weights)
    after = F.slice(weights, at + 2, F.greatest(F.size(weights) - at - 1, F.lit(0)))
    low = F.filter(F.transform(after, lambda x, i: F.when(x < least, i)), lambda i: i.isNotNull())
    return F.struct(at.alias("first"), (at + F.coalesce(F.try_element_at(low, F.lit(1)), F.size(after))).cast("int").alias("last"))


def first_of_beams(labels: Column, beam: int) -> Column:
    """The best label of each frame where every frame has ``beam`` of them in a row."""
    return F.filter(labels, lambda x, i: i % beam == 0)


def likeliest_case(lower: Column, capital: Column, upper: Column) -> Column:
    """0, 1 or 2 by the greatest sum of log probabilities over a word's letters; of equals the first, -1 without letters."""
    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + F.when(x > 0, F.log(x.cast("double"))).otherwise(-87.0))

    sums = F.array(total(lower), total(capital), total(upper))
    return F.when(F.size(lower) == 0, -1).otherwise(F.array_position(sums, F.array_max(sums)) - 1).cast("int")

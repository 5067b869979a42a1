"""Pixel operators on small grey images (numpy), row by row of a DataFrame.

An image is its height, its width and its grey values, one byte each, row by row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from glyphmill.operators.arrow_map import append_columns


def components(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(left, top, right, bottom, pixels) of the 8-connected components of a mask, by union of row runs."""
    parent: list[int] = []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    boxes: list[list[int]] = []
    above: list[tuple[int, int, int]] = []
    for y in range(mask.shape[0]):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mask[y].astype(np.int8), [0]])))
        runs = []
        k = 0
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            i = len(parent)
            parent.append(i)
            boxes.append([a, y, b - 1, y, b - a])
            while k < len(above) and above[k][1] < a:
                k += 1
            m = k
            while m < len(above) and above[m][0] <= b:
                p, q = find(above[m][2]), find(i)
                if p != q:
                    parent[q] = p
                    x, z = boxes[p], boxes[q]
                    boxes[p] = [min(x[0], z[0]), min(x[1], z[1]), max(x[2], z[2]), max(x[3], z[3]), x[4] + z[4]]
                m += 1
            runs.append((a, b, i))
        above = runs
    return sorted(tuple(boxes[i]) for i in range(len(parent)) if find(i) == i)


def niblack(grey: np.ndarray, size: int = 15, k: float = 0.43) -> np.ndarray:
    """Dark pixels by a local threshold, mean - k x deviation, with sums over integral images."""
    g = grey.astype(np.float64)
    pad = size // 2
    first = np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    second = np.pad((g * g).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    h, w = g.shape
    y0, y1 = np.clip(np.arange(h) - pad, 0, h), np.clip(np.arange(h) + pad + 1, 0, h)
    x0, x1 = np.clip(np.arange(w) - pad, 0, w), np.clip(np.arange(w) + pad + 1, 0, w)

    def box(s: np.ndarray) -> np.ndarray:
        return s[y1][:, x1] - s[y0][:, x1] - s[y1][:, x0] + s[y0][:, x0]

    n = (y1 - y0)[:, None] * (x1 - x0)[None, :]
    mean = box(first) / n
    deviation = np.sqrt(np.maximum(box(second) / n - mean * mean, 0))
    return g < mean - k * deviation


def otsu(grey: np.ndarray) -> int:
    """The grey value that parts an image into two classes best; pixels at or below it are the dark one."""
    hist = np.bincount(grey.ravel().astype(np.int64), minlength=256).astype(float)
    weight = hist.cumsum()
    total = (hist * np.arange(256)).cumsum()
    rest = weight[-1] - weight
    with np.errstate(divide="ignore", invalid="ignore"):
        between = weight * rest * (total / weight - (total[-1] - total) / rest) ** 2
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1))) if grey.size else 0


def projection(mask: np.ndarray) -> np.ndarray:
    """Set pixels of each column."""
    return mask.sum(axis=0)


def smoothed(hist: np.ndarray, sigma: float) -> np.ndarray:
    """A histogram under a Gaussian, edges repeated."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(hist.astype(float), reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def cut_column(mask: np.ndarray, sigma: float = 1.5) -> int:
    """The column at which two touching letters are best cut: few pixels, near the middle."""
    w = mask.shape[1]
    hist = smoothed(projection(mask), sigma)
    cost = hist / max(1, w) + np.abs(np.arange(w) - w / 2) / max(1, w)
    return int(cost.argmin()) if w else 0


def stroke_width(mask: np.ndarray) -> float:
    """Twice the dark pixels over those at an edge; 0 for an empty mask."""
    inner = np.pad(mask, 1)
    whole = inner[1:-1, 1:-1] & inner[:-2, 1:-1] & inner[2:, 1:-1] & inner[1:-1, :-2] & inner[1:-1, 2:]
    edge = int((mask & ~whole).sum())
    return 2.0 * int(mask.sum()) / edge if edge else 0.0


def two_colours(grey: np.ndarray) -> tuple[float, float]:
    """Mean grey of the dark and of the light class."""
    dark = grey <= otsu(grey)
    return float(grey[dark].mean()) if dark.any() else 0.0, float(grey[~dark].mean()) if (~dark).any() else 0.0


_OUT = T.StructType(
    [
        T.StructField("n_components", T.IntegerType()),
        T.StructField("stroke_width", T.DoubleType()),
        T.StructField("cut_at", T.IntegerType()),
        T.StructField("dark", T.DoubleType()),
        T.StructField("light", T.DoubleType()),
        T.StructField("projection", T.ArrayType(T.IntegerType())),
    ]
)


def measure(df: DataFrame, height: str = "height", width: str = "width", pixels: str = "pixels") -> DataFrame:
    """``df`` with components, stroke width, best cut, mean colours and column sums of each image; null for an image that is not whole."""

    def make():
        def compute(batch):
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (height, width, pixels)]
            out = []
            for h, w, data in zip(*columns):
                if not h or not w or data is None or len(data) != h * w:
                    out.append((None,) * 6)
                    continue
                grey = np.frombuffer(data, np.uint8).reshape(h, w)
                mask = grey <= otsu(grey) if grey.min() != grey.max() else np.zeros_like(grey, bool)
                dark, light = two_colours(grey)
                out.append((len(components(mask)), round(stroke_width(mask), 6), cut_column(mask), round(dark, 6), round(light, 6), projection(mask).tolist()))
            types = [pa.int32(), pa.float64(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.int32())]
            return [pa.array(list(c), t) for c, t in zip(zip(*out), types)]

        return compute

    return append_columns(df, _OUT, make)

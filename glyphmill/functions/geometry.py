"""Column functions on boxes, given as left, top, width, height unless stated otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def intersection(al, aw, bl, bw) -> Column:
    """Length that two spans (start, extent) share; negative where they lie apart."""
    return aw + bw - (F.greatest(al + aw, bl + bw) - F.least(al, bl))


def overlap_score(al, at, aw, ah, bl, bt, bw, bh) -> Column:
    """Shared area over the sum of both areas (not over their union): 0.5 for equal boxes."""
    w, h = intersection(al, aw, bl, bw), intersection(at, ah, bt, bh)
    return F.when((w < 0) | (h < 0) | (bw <= 0) | (bh <= 0), F.lit(0.0)).otherwise((w * h).cast("double") / (aw * ah + bw * bh))


def polygon_height(poly: Column) -> Column:
    """Distance between the first and the fourth corner of x1, y1, ... x4, y4, cut to whole pixels; null without eight numbers."""
    x = F.try_element_at(poly, F.lit(1)) - F.try_element_at(poly, F.lit(7))
    y = F.try_element_at(poly, F.lit(2)) - F.try_element_at(poly, F.lit(8))
    return F.when(F.size(poly) >= 8, F.sqrt((x * x + y * y).cast("double")).cast("int"))


def turned(left, top, wid, hei, img_w, img_h, direction: Column) -> Column:
    """struct(left, top, wid, hei) of a box on a page lying in direction 0, 1, 2 or 3 (quarter turns).

    As in the reference, a half turn (2) takes the height for the extent along x
    and the width for that along y.
    """

    def box(x0, y0, x1, y1):
        return F.struct(
            F.least(x0, x1).alias("left"),
            F.least(y0, y1).alias("top"),
            (F.abs(x1 - x0) + 1).alias("wid"),
            (F.abs(y1 - y0) + 1).alias("hei"),
        )

    return (
        F.when(direction == 1, box(img_w - top, left, img_w - top - hei + 1, left + wid - 1))
        .when(direction == 2, box(img_w - left, img_h - top, img_w - left - hei + 1, img_h - top - wid + 1))
        .when(direction == 3, box(top, img_h - left, top + hei - 1, img_h - left - wid + 1))
        .otherwise(box(left, top, left + wid - 1, top + hei - 1))
    )


def rescaled(left, top, wid, hei, ratio: float) -> Column:
    """A box of an image that had been resized by ``ratio``: start and extent divided and cut to whole pixels."""
    if ratio <= 0:
        raise ValueError("ratio must be above 0")
    parts = [(v / F.lit(float(ratio))).cast("int").alias(n) for v, n in ((left, "left"), (top, "top"), (wid, "wid"), (hei, "hei"))]
    return F.struct(*parts)


def warped(left, top, wid, hei, matrix: list[list[float]]) -> Column:
    """The box around the four corners after a perspective transform with a 3 x 3 matrix."""
    (a, b, c), (d, e, f), (g, h, i) = matrix
    xs, ys = [], []
    for x, y in ((left, top), (left + wid, top), (left, top + hei), (left + wid, top + hei)):
        z = x * F.lit(g) + y * F.lit(h) + F.lit(i)
        xs.append(F.floor((x * F.lit(a) + y * F.lit(b) + F.lit(c)) / z).cast("int"))
        ys.append(F.floor((x * F.lit(d) + y * F.lit(e) + F.lit(f)) / z).cast("int"))
    return F.struct(
        F.least(*xs).alias("left"), F.least(*ys).alias("top"), (F.greatest(*xs) - F.least(*xs)).alias("wid"), (F.greatest(*ys) - F.least(*ys)).alias("hei")
    )


def tiles(width: Column, size: int, overlap: int) -> Column:
    """Tiles (left, wid) of a long line: ``size`` wide, overlapping, the last one taking a short tail in."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((width - size - overlap) / F.lit(step)).cast("int"))
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct((i * step).cast("int").alias("left"), F.when(i == last, width - i * step).otherwise(F.lit(size)).cast("int").alias("wid")),
    )


def small_area(wid, hei, page_w, page_h, scale: int = 1000, side: int = 3) -> Column:
    """Whether a picture is too small to matter: under a part of the page, or a side under ``side``."""
    return (wid * hei < page_w * page_h / F.lit(float(scale))) | (wid < side) | (hei < side)


def from_column(left, top, wid, hei, image_h) -> Column:
    """A box found on a column that was turned to be read, turned back: sides swapped, a quarter of the height up, not above 0."""
    return F.struct(
        F.greatest(F.lit(0), image_h - top - hei).alias("left"), F.greatest(F.lit(0), (left - 0.25 * wid).cast("int")).alias("top"), hei.alias("wid"), wid.alias("hei")
    )


def to_height(left, top, wid, hei, image_h, height: int = 48) -> Column:
    """A box of an image that was resized to ``height``, scaled back to the image and cut to it."""
    ratio = image_h / F.lit(float(height))
    y = F.least((top * ratio).cast("int"), image_h - 1)
    return F.struct((left * ratio).cast("int").alias("left"), y.alias("top"), (wid * ratio).cast("int").alias("wid"), F.least((hei * ratio).cast("int"), image_h - y).alias("hei"))


def page_crop(left, top, wid, hei, page_w: float = 595.0, page_h: float = 842.0) -> Column:
    """The scale at which a text area fits a page: that of the tighter side."""
    return F.least(F.lit(page_w) / wid, F.lit(page_h) / hei)

"""Planning of synthetic samples: fonts, backgrounds, augmentation, and the boxes of glyphs under it."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def font_weights(usage: DataFrame) -> DataFrame:
    """``usage`` (font_id, uses) with the weight of each font: the sum of uses + 1 over its own uses + 1, cut to a whole number."""
    total = usage.agg(F.sum(F.col("uses") + 1)).first()[0]  # one number
    return usage.select("font_id", "uses", F.floor(F.lit(total) / (F.col("uses") + 1)).alias("weight"))


def choose_fonts(fonts: list[int], count: int, seed: int = 0) -> list[int]:
    """``count`` fonts one after the other, rarely used ones being likelier; each choice changes the weights of the next."""
    rng = random.Random(seed)
    uses = dict.fromkeys(fonts, 0)
    out = []
    for _ in range(count):
        total = sum(u + 1 for u in uses.values())
        weights = [total // (uses[f] + 1) for f in fonts]
        pick = rng.choices(fonts, weights)[0]
        uses[pick] += 1
        out.append(pick)
    return out


def background(ticket: Column, bands: list[tuple[str, float]]) -> Column:
    """The kind of background whose probability band a ticket in [0, 1) falls into."""
    out, edge = None, 0.0
    for name, share in bands:
        edge += share
        out = F.when(ticket < edge, name) if out is None else out.when(ticket < edge, name)
    return out.otherwise(bands[-1][0])


def augmentation_plan(df: DataFrame, key: str, steps: list[str], seed: int = 0) -> DataFrame:
    """The steps of each sample in an order of its own, the same in every run."""
    order = F.array_sort(F.array(*[F.struct(F.xxhash64(F.col(key), F.lit(s), F.lit(seed)).alias("h"), F.lit(s).alias("s")) for s in steps]))
    return df.withColumn("steps", F.transform(order, lambda x: x["s"]))


def scaled_boxes(df: DataFrame, ratio: float) -> DataFrame:
    """Glyph boxes of a sample resized by ``ratio``."""
    return df.select(*[F.floor(F.col(c) * F.lit(ratio)).cast("int").alias(c) if c in ("box_left", "box_top", "wid", "hei") else F.col(c) for c in df.columns])


def shifted_boxes(df: DataFrame, dx: int, dy: int) -> DataFrame:
    return df.withColumn("box_left", F.col("box_left") + dx).withColumn("box_top", F.col("box_top") + dy)


def rotated_boxes(df: DataFrame, degrees: float, cx: float, cy: float) -> DataFrame:
    """The corners of glyph boxes after turning a sample about (cx, cy): x1, y1 ... x4, y4."""
    a = F.radians(F.lit(float(degrees)))
    cos, sin = F.cos(a), F.sin(a)
    out = df
    for i, (x, y) in enumerate(
        [
            (F.col("box_left"), F.col("box_top")),
            (F.col("box_left") + F.col("wid"), F.col("box_top")),
            (F.col("box_left") + F.col("wid"), F.col("box_top") + F.col("hei")),
            (F.col("box_left"), F.col("box_top") + F.col("hei")),
        ],
        1,
    ):
        out = out.withColumn(f"x{i}", F.round((x - cx) * cos - (y - cy) * sin + cx).cast("int")).withColumn(f"y{i}", F.round((x - cx) * sin + (y - cy) * cos + cy).cast("int"))
    return out


def sample_rows(letters: DataFrame, height: int = 48) -> DataFrame:
    """(sample_id, row): ``w h path text quad,quad...`` of each sample, boxes scaled to ``height``; letters that are not drawn are left out."""
    rows = letters.filter("box_left >= 0 AND letter IS NOT NULL AND letter <> ''")
    size = rows.groupBy("sample_id").agg(F.max(F.col("box_left") + F.col("wid")).alias("w"), F.max(F.col("box_top") + F.col("hei")).alias("h"))
    rows = rows.join(size, "sample_id").withColumn("k", F.lit(float(height)) / F.col("h"))

    def s(c: Column) -> Column:
        return F.floor(c * F.col("k")).cast("int").cast("string")

    quad = F.concat_ws(",", s(F.col("box_left")), s(F.col("box_top")), s(F.col("box_left") + F.col("wid")), s(F.col("box_top") + F.col("hei")))
    cells = F.array_sort(F.collect_list(F.struct("letter_no", "letter", quad.alias("q"))))
    out = rows.groupBy("sample_id").agg(F.first("w").alias("w"), F.first("k").alias("k"), cells.alias("c"))
    return out.select(
        "sample_id",
        F.concat_ws(
            " ", F.floor(F.col("w") * F.col("k")).cast("string"), F.lit(str(height)), F.concat(F.col("sample_id").cast("string"), F.lit(".jpg")),
            F.array_join(F.transform("c", lambda x: x["letter"]), ""), F.array_join(F.transform("c", lambda x: x["q"]), ","),
        ).alias("row"),
    )

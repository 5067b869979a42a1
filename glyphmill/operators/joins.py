"""Interval and nearest joins on boxes. Each carries an equality on the page, and where a page may be large a band."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def band_join(left: DataFrame, right: DataFrame, keys: list[str], low: str, high: str, band: int, condition: Column) -> DataFrame:
    """Pairs of rows with equal ``keys`` whose spans [low, high] (right: r_low, r_high) may meet, under ``condition``.

    Both spans are cut into bands of ``band`` units, so the join is an equality on
    keys and band rather than a nested loop over a group; a pair is taken only in
    the first band that both touch, so it comes once.
    """

    def banded(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
        first, last = F.floor(F.col(a) / band), F.floor(F.col(b) / band)
        return df.withColumn(f"{name}_first", first).withColumn(name, F.explode(F.sequence(first, F.greatest(first, last))))

    a = banded(left, low, high, "_band")
    b = banded(right, f"r_{low}", f"r_{high}", "_rband")
    on = [F.col(k) == F.col(f"r_{k}") for k in keys] + [F.col("_band") == F.col("_rband"), F.col("_band") == F.greatest("_band_first", "_rband_first")]
    joined = a.join(b, on).filter(condition)
    return joined.drop("_band", "_rband", "_band_first", "_rband_first")


def renamed(df: DataFrame, prefix: str = "r_") -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def last_above(rows: DataFrame, probes: DataFrame, key: str, at: str, value: str, out: str) -> DataFrame:
    """As-of join: each probe with the value of the last row strictly above it on its page; 0 if there is none.

    Rows and probes are merged and sorted once, so no pair of them is ever built.
    Of rows at the same place the one with the greater value counts.
    """
    a = rows.select(F.col(key), F.col(at), F.lit(1).alias("_kind"), F.col(value).cast("double").alias("_value"))
    b = probes.select(F.col(key), F.col(at), F.lit(0).alias("_kind"), F.lit(None).cast("double").alias("_value"), F.struct(*probes.columns).alias("_row"))
    both = a.withColumn("_row", F.lit(None).cast(b.schema["_row"].dataType)).unionByName(b)
    w = Window.partitionBy(key).orderBy(at, "_kind", "_value").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_seen", F.last("_value", ignorenulls=True).over(w)).filter("_kind = 0")
    return seen.select(*[F.col(f"_row.{c}").alias(c) for c in probes.columns], F.coalesce("_seen", F.lit(0.0)).alias(out))


def nearest_points(rows: DataFrame, points: DataFrame, cell: float) -> DataFrame:
    """``rows`` (id, x, y) with the nearest of ``points`` (point_id, px, py); null where none lies within ``cell``.

    Points are met by an equality on grid cells, a row looking into the nine around
    it. With ``cell`` at least the distance between neighbouring points this is
    exact; of equally near points the one with the lower id is taken.
    """
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    left = rows.withColumn("_n", F.explode(around))
    left = left.withColumn("_cx", F.floor(F.col("x") / cell) + F.col("_n.a")).withColumn("_cy", F.floor(F.col("y") / cell) + F.col("_n.b")).drop("_n")
    right = points.withColumn("_cx", F.floor(F.col("px") / cell)).withColumn("_cy", F.floor(F.col("py") / cell))
    d = (F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2
    met = left.join(right, ["_cx", "_cy"]).withColumn("_d", d).filter(F.col("_d") <= cell * cell)
    best = met.groupBy("id").agg(F.min(F.struct("_d", "point_id")).alias("b")).select("id", F.col("b.point_id").alias("point_id"), F.sqrt("b._d").alias("distance"))
    return rows.join(best, "id", "left")


def next_in_line(spans: DataFrame, keys: list[str], item: str, start: str, end: str, band: int = 256) -> DataFrame:
    """Pairs (item, r_item) of a group where the second starts at or behind the end of the first and no third lies between.

    How far each span reaches is the least end of all spans that start behind it:
    one sort of ends and starts together gives it. The pairs then come from a band
    join on that reach, so spans further on are never met.
    """
    probes = spans.select(*keys, item, start, end, F.col(end).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("int").alias("_end"))
    marks = spans.select(*keys, item, start, end, F.col(start).alias("_at"), F.lit(0).alias("_kind"), F.col(end).cast("int").alias("_end"))
    w = Window.partitionBy(*keys).orderBy(F.desc("_at"), "_kind").rowsBetween(Window.unboundedPreceding, 0)
    reach = probes.unionByName(marks).withColumn("_reach", F.min("_end").over(w)).filter("_kind = 1 AND _reach IS NOT NULL")
    a = reach.select(*keys, item, start, end, F.col(end).alias("x"), (F.col("_reach") - 1).alias("x_end"))
    b = renamed(spans).withColumn("r_x", F.col(f"r_{start}")).withColumn("r_x_end", F.col(f"r_{start}"))
    return band_join(a, b, keys, "x", "x_end", band, F.col("r_x").between(F.col("x"), F.col("x_end")))

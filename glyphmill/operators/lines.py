"""Operators on the words and boxes of lines, all of them plain DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINE = ["page_id", "line_id"]
BOX = ["box_left", "box_top", "wid", "hei"]


def ordered_words(by: str = "box_left"):
    """Window over the words of a line from left to right; ties by word number."""
    return Window.partitionBy(*LINE).orderBy(by, "word_id")


def line_text(words: DataFrame, spacing: str = "none", out: str = "line_text") -> DataFrame:
    """The text of each line, its words in order.

    ``spacing``: none; leading (a space before a word that asks for one, but not
    before the first); trailing (a space behind such a word). Null words count as empty.
    """
    word = F.coalesce("word_str", F.lit(""))
    wants = F.coalesce("left_add_space", F.lit(False)) if spacing != "none" else F.lit(False)
    cells = F.array_sort(F.collect_list(F.struct("word_id", word.alias("text"), wants.alias("space"))))

    def shown(x: Column, i: Column) -> Column:
        if spacing == "leading":
            return F.concat(F.when(x["space"] & (i > 0), " ").otherwise(""), x["text"])
        if spacing == "trailing":
            return F.concat(x["text"], F.when(x["space"], " ").otherwise(""))
        return x["text"]

    return words.groupBy(*LINE).agg(F.array_join(F.transform(cells, shown), "").alias(out))


def bounds(df: DataFrame, *keys: str) -> DataFrame:
    """The box around all boxes of a group."""
    left, top = F.min("box_left"), F.min("box_top")
    return df.groupBy(*keys).agg(
        left.alias("box_left"), top.alias("box_top"), (F.max(F.col("box_left") + F.col("wid")) - left).alias("wid"), (F.max(F.col("box_top") + F.col("hei")) - top).alias("hei")
    )


def confident_words(words: DataFrame, least: float = 0.35, edge: float = 0.9) -> DataFrame:
    """Words of probability ``least`` or more; punctuation at either end of a line needs ``edge``.

    Words without a probability are kept.
    """
    w = Window.partitionBy(*LINE)
    at_edge = (F.col("word_id") == F.min("word_id").over(w)) | (F.col("word_id") == F.max("word_id").over(w))
    weak = (F.col("prob") < least) | (at_edge & (F.col("lc_type") == 3) & (F.col("prob") < edge))
    return words.withColumn("_weak", F.coalesce(weak, F.lit(False))).filter("NOT _weak").drop("_weak")


def trimmed_words(words: DataFrame, least: float = -0.1) -> DataFrame:
    """From the first to the last word that is Chinese or whose log probability is above ``least``; a log probability of 1 is unset."""
    sure = F.ascii("word_str").between(0x4E00, 0x9FBB) | ((F.col("log_prob") > least) & (F.col("log_prob") < 1.0))
    w = Window.partitionBy(*LINE)
    at = F.when(sure, F.col("word_id"))
    return words.withColumn("_a", F.min(at).over(w)).withColumn("_b", F.max(at).over(w)).filter("word_id BETWEEN _a AND _b").drop("_a", "_b")


def valid_lines(words: DataFrame, good: float = 0.65, share: float = 0.3, single: float = 0.7) -> DataFrame:
    """Lines (page_id, line_id) with enough good words; a line of one word needs ``single``. Lines without words are not valid."""
    counted = words.groupBy(*LINE).agg(
        F.count("*").alias("n"), F.avg(F.when(F.col("prob") >= good, F.lit(1.0)).otherwise(F.lit(0.0))).alias("ratio"), F.max("prob").alias("top")
    )
    return counted.filter(((F.col("n") > 1) & (F.col("ratio") >= share)) | ((F.col("n") == 1) & (F.col("top") >= single))).select(*LINE)


def gaps(words: DataFrame) -> DataFrame:
    """``gap_left`` and ``gap_right`` of each word; at the ends of a line three times the mean gap of the line."""
    w = ordered_words()
    right = F.col("box_left") + F.col("wid")
    rows = words.withColumn("_prev", F.lag(right).over(w)).withColumn("_next", F.lead("box_left").over(w))
    rows = rows.withColumn("_l", F.col("box_left") - F.col("_prev")).withColumn("_r", F.col("_next") - right)
    mean = F.coalesce(F.avg("_l").over(Window.partitionBy(*LINE)), F.lit(0.0))
    return rows.withColumn("gap_left", F.coalesce(F.col("_l").cast("double"), 3 * mean)).withColumn("gap_right", F.coalesce(F.col("_r").cast("double"), 3 * mean)).drop("_prev", "_next", "_l", "_r")


def block_statistics(words: DataFrame) -> DataFrame:
    """For each line: number of words, mean width, height (whole numbers) and gap (at least 1), and the spacing thresholds."""
    right = F.col("box_left") + F.col("wid")
    rows = words.withColumn("_gap", F.lead("box_left").over(ordered_words()) - right)
    out = rows.groupBy(*LINE).agg(
        F.count("*").alias("n"),
        F.expr("sum(wid) div count(*)").alias("mean_wid"),
        F.expr("sum(hei) div count(*)").alias("mean_hei"),
        F.greatest(F.lit(1.0), F.coalesce(F.avg("_gap"), F.lit(1.0))).alias("mean_gap"),
    )
    by_size = F.least(F.lit(0.65) * F.col("mean_hei"), F.lit(0.95) * F.col("mean_wid"))
    by_gap = F.lit(1.9) * F.col("mean_gap")
    return out.select("*", by_size.alias("by_size"), by_gap.alias("by_gap"), F.least(by_size, by_gap).alias("space"))


def upper_medians(words: DataFrame, heights: DataFrame) -> DataFrame:
    """Median width and height of plausible boxes of a line: the upper of the two middle ones.

    ``heights`` has ``line_hei`` of each line. A box is plausible if it is higher
    than a fifth of the line and wider than a tenth of it and than 2.
    """
    rows = words.join(heights, LINE).filter((F.col("hei") > F.col("line_hei") / 5) & (F.col("wid") > F.greatest(F.lit(2.0), F.col("line_hei") / 10)))

    def middle(column: str) -> Column:
        values = F.array_sort(F.collect_list(column))
        return F.element_at(values, F.floor(F.size(values) / 2).cast("int") + 1)

    return rows.groupBy(*LINE).agg(middle("wid").alias("median_wid"), middle("hei").alias("median_hei"), F.avg("hei").alias("mean_hei"))


def latin_share(chars: DataFrame) -> DataFrame:
    """Share of Latin letters among the chars of a line; 0 if digits and punctuation make 0.6 or more."""
    latin = F.col("char_str").rlike("^[A-Za-z]")
    other = F.col("char_str").rlike("^[0-9]") | F.col("char_str").rlike("^[!-/:-@\\[-`{-~]")
    out = chars.filter("char_str IS NOT NULL").groupBy(*LINE).agg(
        F.avg(latin.cast("double")).alias("latin"), F.avg(other.cast("double")).alias("other")
    )
    return out.select(*LINE, F.when(F.col("other") >= 0.6, F.lit(0.0)).otherwise(F.col("latin")).alias("latin_share"))


def runs(df: DataFrame, keys: list[str], order: list[str], same: Column, least: int, columns: list[str]) -> DataFrame:
    """Maximal runs of rows for which ``same`` holds, at least ``least`` long: ``run`` (from 0), ``n`` and the bounds of ``columns``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("_same", F.coalesce(same, F.lit(False)))
    starts = F.col("_same") & ~F.coalesce(F.lag("_same").over(w), F.lit(False))
    rows = rows.withColumn("_run", F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("_same")
    out = rows.groupBy(*keys, "_run").agg(F.count("*").alias("n"), *[f(c).alias(f"{name}_{c}") for c in columns for name, f in (("first", F.min), ("last", F.max))])
    return out.filter(F.col("n") >= least).withColumn("run", (F.row_number().over(Window.partitionBy(*keys).orderBy("_run")) - 1)).drop("_run")


def merged_spans(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Spans (inclusive ends) that share a pixel become one: ``span``, ``start``, ``end`` and ``n``."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    seen = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumn("_new", F.coalesce(F.col(start) > seen, F.lit(True)).cast("int"))
    rows = rows.withColumn("span", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "span").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n"))

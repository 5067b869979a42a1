"""Queries on lines: aggregates, filters, windows, interval joins, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.functions import geometry, text
from glyphmill.lineage import cut
from glyphmill.operators import joins
from glyphmill.operators import lines as ops
from glyphmill.plans.base import CHARS, KEY, LINES, WORDS, chars, letters, lines, words
from glyphmill.sources.tables import table

LINE = ops.LINE


def a1_line_text(spark: SparkSession, folder: str) -> DataFrame:
    w = words(spark, folder, "word_str", "left_add_space")
    return ops.line_text(w).join(ops.line_text(w, "leading", "leading"), LINE).join(ops.line_text(w, "trailing", "trailing"), LINE)


def a3_bounds(spark: SparkSession, folder: str) -> DataFrame:
    return ops.bounds(words(spark, folder, *ops.BOX), *LINE)


def a4_page_extent(spark: SparkSession, folder: str) -> DataFrame:
    return ops.bounds(lines(spark, folder, *ops.BOX), "page_id")


def a6_latin_share(spark: SparkSession, folder: str) -> DataFrame:
    return ops.latin_share(chars(spark, folder, "char_str")).select(*LINE, F.round("latin_share", 6).alias("latin_share"))


def a7_block_statistics(spark: SparkSession, folder: str) -> DataFrame:
    out = ops.block_statistics(words(spark, folder, *ops.BOX))
    return out.select(*LINE, "n", "mean_wid", "mean_hei", *[F.round(c, 6).alias(c) for c in ("mean_gap", "by_size", "by_gap", "space")])


def a9_medians(spark: SparkSession, folder: str) -> DataFrame:
    heights = lines(spark, folder, "hei").select(*LINE, F.col("hei").alias("line_hei"))
    out = ops.upper_medians(words(spark, folder, "wid", "hei"), heights)
    return out.select(*LINE, "median_wid", "median_hei", F.round("mean_hei", 6).alias("mean_hei"))


def a12_line_heights(spark: SparkSession, folder: str) -> DataFrame:
    """For each page: mean real height of its lines (whole pixels), most bytes in a line, and lines without a polygon."""
    rows = lines(spark, folder, "poly", "line_str").withColumn("real", geometry.polygon_height(F.col("poly")))
    return rows.groupBy("page_id").agg(
        F.expr("sum(real) div count(real)").alias("mean_height"), F.max(F.octet_length("line_str")).alias("most_bytes"), F.count_if(F.col("poly").isNull()).alias("no_poly")
    )


def a14_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """Share of the lines whose words, joined, equal the line as recognised, by language."""
    read = ops.line_text(words(spark, folder, "word_str"), out="read")
    truth = lines(spark, folder, "book_id", "line_str").select(*LINE, "book_id", F.replace(F.coalesce("line_str", F.lit("")), F.lit(" "), F.lit("")).alias("truth"))
    same = (F.replace("read", F.lit(" "), F.lit("")) == F.col("truth")).cast("double")
    books = table(spark, folder, "books").select("book_id", "lang")
    return truth.join(read, LINE).join(books, "book_id").groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(same), 6).alias("accuracy"))


def a15_font_usage(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "letters").select("sample_id", "letter_no", "font_id").distinct()
    return rows.groupBy("font_id").agg(F.count("*").alias("uses"), F.countDistinct("sample_id").alias("samples"))


def a16_page_text(spark: SparkSession, folder: str) -> DataFrame:
    cells = F.array_sort(F.collect_list(F.struct("line_id", F.coalesce("line_str", F.lit("")).alias("t"))))
    return lines(spark, folder, "line_str").groupBy("page_id").agg(F.array_join(F.transform(cells, lambda x: x["t"]), "\n").alias("page_text"))


def f1_width_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Training rows: lines 50 to 1000 wide, the label being all words but the last."""
    rows = lines(spark, folder, "wid", "hei", "line_str").filter("wid BETWEEN 50 AND 1000 AND line_str IS NOT NULL")
    parts = F.filter(F.split("line_str", " "), lambda x: x != "")
    return rows.select(*LINE, "wid", "hei", F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), " ").alias("label"))


def f2_encodable(spark: SparkSession, folder: str) -> DataFrame:
    """Words all of whose chars have a class in the label table, with their classes; others are dropped whole."""
    labels = spark.range(33, 127).select(F.col("id").cast("int").alias("code"), (F.col("id") - 33).cast("int").alias("idx"))
    rows = chars(spark, folder, "char_str").filter("char_str IS NOT NULL").withColumn("code", F.ascii("char_str"))
    rows = rows.join(F.broadcast(labels), "code", "left")  # 94 rows, made here
    out = rows.groupBy(*KEY).agg(F.bool_and(F.col("idx").isNotNull()).alias("all"), F.array_sort(F.collect_list(F.struct("char_id", "idx"))).alias("cells"))
    return out.filter("all").select(*KEY, F.transform("cells", lambda x: x["idx"]).alias("path"))


def f5_row_or_column(spark: SparkSession, folder: str) -> DataFrame:
    return words(spark, folder, "wid", "hei").select(*KEY, (F.col("hei") > 2.0 * F.col("wid")).alias("is_column"))


def f7_detected_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes cut to the image, without those under 5 pixels or standing upright; extents from inclusive corners."""
    left, top = F.greatest("box_left", F.lit(0)), F.greatest("box_top", F.lit(0))
    right, low = F.least(F.col("box_left") + F.col("wid") - 1, F.col("img_w") - 1), F.least(F.col("box_top") + F.col("hei") - 1, F.col("img_h") - 1)
    out = lines(spark, folder).select(*LINE, left.alias("left"), top.alias("top"), (right - left + 1).alias("width"), (low - top + 1).alias("height"))
    return out.filter("width >= 5 AND height >= 5 AND height <= 2 * width")


def f8_confident_words(spark: SparkSession, folder: str) -> DataFrame:
    return ops.confident_words(words(spark, folder, "word_str", "prob", "lc_type")).select(*KEY, "word_str", "prob")


def f9_trimmed(spark: SparkSession, folder: str) -> DataFrame:
    return ops.trimmed_words(words(spark, folder, "word_str", "log_prob")).select(*KEY, "word_str")


def f10_valid_lines(spark: SparkSession, folder: str) -> DataFrame:
    return ops.valid_lines(ops.confident_words(words(spark, folder, "prob", "lc_type")))


def f11_digits_only(spark: SparkSession, folder: str) -> DataFrame:
    """Words that begin with a digit, and with them only lines that have any."""
    return words(spark, folder, "word_str").filter("word_str RLIKE '^[0-9]'").select(*KEY, "word_str")


def f15_small_components(spark: SparkSession, folder: str) -> DataFrame:
    """Letters as components of their sample: those at most a tenth of its smaller side are noise."""
    rows = table(spark, folder, "letters").distinct().filter("box_left >= 0")
    w = Window.partitionBy("sample_id")
    side = F.least(F.max(F.col("box_left") + F.col("wid")).over(w), F.max(F.col("box_top") + F.col("hei")).over(w))
    rows = rows.withColumn("side", side)
    return rows.filter("wid > 0.1D * side AND hei > 0.1D * side").select("sample_id", "letter_no", "wid", "hei")


def f16_rows_of_page(spark: SparkSession, folder: str) -> DataFrame:
    """Rows lower than a quarter of the largest one are dropped; the others merged where they overlap."""
    rows = lines(spark, folder)
    w = Window.partitionBy("page_id")
    rows = rows.withColumn("h", F.max_by("hei", F.struct(F.col("wid") * F.col("hei"), -F.col("line_id"))).over(w)).filter("hei >= 0.25D * h")
    rows = rows.select("page_id", "box_top", (F.col("box_top") + F.col("hei") - 1).alias("box_low"))
    return ops.merged_spans(rows, ["page_id"], "box_top", "box_low").select("page_id", F.col("start"), F.col("end"), "n")


def f18_lexicon_words(spark: SparkSession, folder: str) -> DataFrame:
    """Lines by what the lexicon knows of their words: valid, noisy and long valid ones; noisy lines lose the words it does not know."""
    books = table(spark, folder, "books").select("book_id", "lang")
    known = table(spark, folder, "lexicon").select(F.lower("word").alias("known"), "lang").distinct().withColumn("hit", F.lit(True))
    bare = F.lower(F.regexp_replace("word_str", "^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$", ""))
    rows = words(spark, folder).join(books, "book_id").withColumn("known", bare).join(known, ["known", "lang"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    w = Window.partitionBy(*LINE)
    longer = F.col("hit") & (F.length("known") >= 5)
    rows = rows.withColumn("long_valid", F.count_if(longer).over(w)).withColumn("noisy", F.sum(F.when(~F.col("hit"), F.length("known")).otherwise(0)).over(w))
    return rows.filter("hit OR NOT (long_valid <= noisy OR noisy > 2)").select(*KEY, "word_str")


def w1_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return ops.gaps(words(spark, folder, "box_left", "wid")).select(*KEY, F.round("gap_left", 6).alias("gap_left"), F.round("gap_right", 6).alias("gap_right"))


def w2_word_groups(spark: SparkSession, folder: str) -> DataFrame:
    """From each word on, the boxes around 1 to 3 words."""
    w = ops.ordered_words()
    right = F.col("box_left") + F.col("wid")
    rows = words(spark, folder, "box_left", "wid").withColumn("pos", F.row_number().over(w))
    out = None
    for n in (1, 2, 3):
        f = w.rowsBetween(0, n - 1)
        part = rows.withColumn("n", F.count("*").over(f)).withColumn("l", F.min("box_left").over(f)).withColumn("r", F.max(right).over(f))
        part = part.filter(F.col("n") == n).select(*KEY, F.lit(n).alias("n"), F.col("l").alias("group_left"), (F.col("r") - F.col("l")).alias("group_wid"))
        out = part if out is None else out.unionByName(part)
    return out


def w3_gap_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    """The gaps of a line at one and two thirds of their order."""
    rows = words(spark, folder, "box_left", "wid").withColumn("gap", F.lead("box_left").over(ops.ordered_words()) - F.col("box_left") - F.col("wid")).filter("gap IS NOT NULL")
    gaps = rows.groupBy(*LINE).agg(F.array_sort(F.collect_list("gap")).alias("g"))
    n = F.size("g")
    return gaps.select(*LINE, F.element_at("g", F.floor(n / 3).cast("int") + 1).alias("third"), F.element_at("g", F.floor(2 * n / 3).cast("int") + 1).alias("two_thirds"))


def w5_latin_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Maximal runs of five or more Latin letters among the chars of a line."""
    rows = chars(spark, folder, "char_str", "box_left", "wid").withColumn("right", F.col("box_left") + F.col("wid"))
    out = ops.runs(rows, LINE, ["word_id", "char_id"], F.col("char_str").rlike("^[A-Za-z]"), 5, ["box_left", "right"])
    return out.select(*LINE, F.col("n"), F.col("first_box_left").alias("left"), F.col("last_right").alias("right"))


def w7_room_to_right(spark: SparkSession, folder: str) -> DataFrame:
    """Room to the next line box that stands in the same row, else to the edge of the image."""
    w = Window.partitionBy("page_id").orderBy("line_id")
    rows = lines(spark, folder).withColumn("nl", F.lead("box_left").over(w)).withColumn("nt", F.lead("box_top").over(w)).withColumn("nh", F.lead("hei").over(w))
    share = geometry.intersection(F.col("box_top"), F.col("hei"), F.col("nt"), F.col("nh"))
    same = (share > 0.8 * (F.col("hei") + F.col("nh")) / 2) & (F.col("nl") > F.col("box_left"))
    return rows.select(*LINE, F.when(same, F.col("nl") - F.col("box_left")).otherwise(F.col("img_w") - F.col("box_left")).alias("room"))


def w8_same_source(spark: SparkSession, folder: str) -> DataFrame:
    """Consecutive words of the same kind become one."""
    w = ops.ordered_words("word_id")
    rows = words(spark, folder)
    change = F.coalesce((F.lag("lc_type").over(w) != F.col("lc_type")).cast("int"), F.lit(1))
    rows = rows.withColumn("c", change)
    rows = rows.withColumn("grp", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    cells = F.array_sort(F.collect_list(F.struct("word_id", "word_str")))
    return rows.groupBy(*LINE, "grp").agg(F.first("lc_type").alias("lc_type"), F.count("*").alias("n"), F.array_join(F.transform(cells, lambda x: x["word_str"]), "").alias("joined"))


def j2_shared_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Characters of Chinese pages that English pages use, too (semi join)."""
    books = table(spark, folder, "books").select("book_id", "lang")
    rows = chars(spark, folder, "char_str", "book_id").filter("char_str IS NOT NULL").join(books, "book_id")
    zh, en = rows.filter("lang = 'zh'").select("char_str").distinct(), rows.filter("lang = 'en'").select("char_str").distinct()
    return zh.join(en, "char_str", "left_semi")


def j3_votes(spark: SparkSession, folder: str) -> DataFrame:
    """Words with the votes of two other readings of their page that hold the same text: its lines, cut at blanks, and its chars, put together."""
    m1 = words(spark, folder, "word_str", "prob").filter("word_str IS NOT NULL").select(*KEY, "word_str", "prob")
    m2 = lines(spark, folder, "line_str").select("page_id", F.explode(F.split("line_str", " ")).alias("word_str")).distinct().withColumn("v2", F.lit(True))
    spelled = chars(spark, folder, "char_str").filter("char_str IS NOT NULL").groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("char_id", "char_str"))).alias("cells"))
    m3 = spelled.select("page_id", F.array_join(F.transform("cells", lambda x: x["char_str"]), "").alias("word_str")).distinct().withColumn("v3", F.lit(True))
    out = m1.join(m2, ["page_id", "word_str"], "left").join(m3, ["page_id", "word_str"], "left")
    v2, v3 = F.coalesce("v2", F.lit(False)), F.coalesce("v3", F.lit(False))
    vote = F.when(v2 & v3, 0.3).when(v2 | v3, 0.1).otherwise(-0.3)
    return out.select(*KEY, "word_str", F.round(F.col("prob") + vote, 6).alias("score"))


def j5_overlapping_words(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of chars of a line whose boxes overlap by more than a quarter of both widths (band join); they are drawn twice as wide here, so that neighbours do."""
    rows = chars(spark, folder, "box_left", "wid").withColumn("wid", F.col("wid") * 2).select("page_id", "line_id", "word_id", "char_id", "box_left", "wid", (F.col("box_left") + F.col("wid") - 1).alias("box_right"))
    right = joins.renamed(rows)
    overlap = geometry.intersection(F.col("box_left"), F.col("wid"), F.col("r_box_left"), F.col("r_wid"))
    before = (F.col("word_id") < F.col("r_word_id")) | ((F.col("word_id") == F.col("r_word_id")) & (F.col("char_id") < F.col("r_char_id")))
    rows = rows.withColumnRenamed("box_left", "x").withColumnRenamed("box_right", "x_end").withColumn("box_left", F.col("x"))
    right = right.withColumnRenamed("r_box_right", "r_x_end").withColumn("r_x", F.col("r_box_left"))
    met = joins.band_join(rows, right, LINE, "x", "x_end", 64, before & (overlap > (F.col("wid") + F.col("r_wid")) / 4))
    return met.select("page_id", "line_id", "word_id", "char_id", F.col("r_word_id").alias("other_word"), F.col("r_char_id").alias("other_char"), overlap.alias("overlap"))


def j8_word_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Words against the detected line boxes of their page: overlap score above 0.1, and how many boxes a word lies on."""
    a = words(spark, folder).select(*KEY, F.col("box_left").alias("l"), F.col("box_top").alias("t"), F.col("wid").alias("w"), F.col("hei").alias("h"), F.col("box_top").alias("y"), (F.col("box_top") + F.col("hei")).alias("y_end"))
    b = lines(spark, folder).select("page_id", F.col("line_id").alias("box"), F.col("box_left").alias("l"), F.col("box_top").alias("t"), F.col("wid").alias("w"), F.col("hei").alias("h"), F.col("box_top").alias("y"), (F.col("box_top") + F.col("hei")).alias("y_end"))
    score = geometry.overlap_score(*[F.col(c) for c in ("l", "t", "w", "h", "r_l", "r_t", "r_w", "r_h")])
    met = joins.band_join(a, joins.renamed(b), ["page_id"], "y", "y_end", 128, score > 0.01)
    return met.groupBy(*KEY).agg(F.count("*").alias("boxes"), F.round(F.max(score), 6).alias("best"))


def j9_free_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Letters whose box touches no other letter of the sample (anti join on intersecting rectangles)."""
    rows = letters(spark, folder, "letter", "box_left", "box_top", "wid", "hei").filter("box_left >= 0")
    a = rows.withColumn("x", F.col("box_left")).withColumn("x_end", F.col("box_left") + F.col("wid"))
    meet = (
        (F.col("letter_no") != F.col("r_letter_no"))
        & (geometry.intersection(F.col("box_left"), F.col("wid"), F.col("r_box_left"), F.col("r_wid")) > 0)
        & (geometry.intersection(F.col("box_top"), F.col("hei"), F.col("r_box_top"), F.col("r_hei")) > 0)
    )
    taken = joins.band_join(a, joins.renamed(a), ["sample_id"], "x", "x_end", 64, meet).select("sample_id", "letter_no").distinct()
    return rows.join(taken, ["sample_id", "letter_no"], "left_anti").select("sample_id", "letter_no", "letter")


def j10_offset_above(spark: SparkSession, folder: str) -> DataFrame:
    """As-of join: every fifth of a page with the left edge of the last line strictly above it."""
    rows = lines(spark, folder).select("page_id", F.col("box_top").alias("y"), F.col("box_left"))
    pages = table(spark, folder, "scan_pages").select("page_id", "img_h").distinct()
    probes = pages.select("page_id", F.explode(F.array(*[F.lit(i) for i in range(1, 6)])).alias("fifth"), "img_h")
    probes = probes.select("page_id", "fifth", F.expr("img_h * fifth div 6").cast("int").alias("y"))
    return joins.last_above(rows, probes, "page_id", "y", "box_left", "offset")


def j12_replaced_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Chars of a line outside its Latin runs, together with the runs: an anti join on spans, then a union."""
    rows = chars(spark, folder, "char_str", "box_left", "wid").filter("char_str IS NOT NULL").withColumn("right", F.col("box_left") + F.col("wid"))
    found = cut(ops.runs(rows, LINE, ["word_id", "char_id"], F.col("char_str").rlike("^[A-Za-z]"), 5, ["box_left", "right"]))  # read twice
    spans = found.select(*LINE, F.col("first_box_left").alias("a"), F.col("last_right").alias("b"), "n")
    inside = [rows[c] == spans[c] for c in LINE] + [rows["box_left"].between(spans["a"], spans["b"])]
    rest = rows.join(spans, inside, "left_anti").select(*LINE, F.col("box_left").alias("left"), F.lit(1).cast("long").alias("n"), F.lit("char").alias("kind"))
    return rest.unionByName(spans.select(*LINE, F.col("a").alias("left"), "n", F.lit("run").alias("kind"))).groupBy(*LINE, "kind").agg(F.count("*").alias("pieces"), F.sum("n").alias("n"), F.min("left").alias("left"))


def j14_reachable(spark: SparkSession, folder: str) -> DataFrame:
    """For each word the words to its right with no other word strictly between."""
    a = words(spark, folder, "box_left", "wid").select(*KEY, F.col("box_left").alias("l"), (F.col("box_left") + F.col("wid")).alias("r"))
    return joins.next_in_line(a, LINE, "word_id", "l", "r").select(*KEY, F.col("r_word_id").alias("next_word"))


def g7_row_bands(spark: SparkSession, folder: str) -> DataFrame:
    """Words of a page merged into bands of rows that overlap by a pixel or more."""
    rows = words(spark, folder, "box_top", "hei").select("page_id", "box_top", (F.col("box_top") + F.col("hei") - 1).alias("box_low"))
    return ops.merged_spans(rows, ["page_id"], "box_top", "box_low").select("page_id", "start", "end", "n")


def g11_warped(spark: SparkSession, folder: str) -> DataFrame:
    box = geometry.warped(F.col("box_left"), F.col("box_top"), F.col("wid"), F.col("hei"), [[1.0, 0.25, 8.0], [0.125, 1.0, 4.0], [0.0, 0.0, 2.0]])
    return words(spark, folder, *ops.BOX).select(*KEY, box.alias("b")).select(*KEY, "b.*")


def g12_rescaled(spark: SparkSession, folder: str) -> DataFrame:
    box = geometry.rescaled(F.col("box_left"), F.col("box_top"), F.col("wid"), F.col("hei"), 1.25)
    return words(spark, folder, *ops.BOX).select(*KEY, box.alias("b")).select(*KEY, "b.*")


def g13_turned(spark: SparkSession, folder: str) -> DataFrame:
    rows = lines(spark, folder)
    box = geometry.turned(*[F.col(c) for c in ("box_left", "box_top", "wid", "hei", "img_w", "img_h")], F.col("line_id") % 4)
    return rows.select(*LINE, box.alias("b")).select(*LINE, "b.*")


def g15_real_height(spark: SparkSession, folder: str) -> DataFrame:
    return lines(spark, folder, "poly").select(*LINE, geometry.polygon_height(F.col("poly")).alias("real_height"))


def d27_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """Lines at four times their size, cut into overlapping tiles."""
    rows = lines(spark, folder, "wid").select(*LINE, F.posexplode(geometry.tiles(F.col("wid") * 4, 900, 200)).alias("tile", "t"))
    return rows.select(*LINE, "tile", "t.left", "t.wid")


def b1_union(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and columns of text, told apart and put together again, from left to right."""
    rows = words(spark, folder, "box_left", "wid", "hei").withColumn("is_column", F.col("hei") > F.col("wid"))
    both = rows.filter("NOT is_column").unionByName(rows.filter("is_column"))
    return both.groupBy(*LINE).agg(F.count_if("is_column").alias("columns"), F.count("*").alias("n"), F.min(F.struct("box_left", "word_id"))["word_id"].alias("first_word"))


def b3_distinct_words(spark: SparkSession, folder: str) -> DataFrame:
    return words(spark, folder).filter("word_str IS NOT NULL").select("book_id", F.lower("word_str").alias("word")).distinct().groupBy("book_id").agg(F.count("*").alias("distinct_words"))


def o2_presorted(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of a page in the order of their box written as text (100 before 20)."""
    key = F.concat_ws("_", *[c.cast("string") for c in (F.col("box_left"), F.col("box_top"), F.col("box_left") + F.col("wid") - 1, F.col("box_top") + F.col("hei") - 1)])
    w = Window.partitionBy("page_id").orderBy("key", "line_id")
    return lines(spark, folder).withColumn("key", key).select(*LINE, F.row_number().over(w).alias("place"))


def o7_best_words(spark: SparkSession, folder: str) -> DataFrame:
    """The three surest words of each line."""
    w = Window.partitionBy(*LINE).orderBy(F.col("prob").desc_nulls_last(), F.col("word_id").desc())
    return words(spark, folder, "prob").withColumn("place", F.row_number().over(w)).filter("place <= 3").select(*KEY, "place", "prob")


def flagship_top_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The surest lines: weak words dropped, valid lines kept, text joined, the ten with most words."""
    good = ops.confident_words(words(spark, folder, "word_str", "prob", "lc_type", "left_add_space"))
    kept = good.join(ops.valid_lines(good), LINE, "left_semi")
    shown = ops.line_text(kept).join(kept.groupBy(*LINE).agg(F.count("*").alias("n"), F.round(F.avg("prob"), 6).alias("mean_prob")), LINE)
    return shown.orderBy(F.desc("n"), F.desc("mean_prob"), "page_id", "line_id").limit(10)


QUERIES = {
    f.__name__: f
    for f in (
        a1_line_text, a3_bounds, a4_page_extent, a6_latin_share, a7_block_statistics, a9_medians, a12_line_heights, a14_accuracy, a15_font_usage, a16_page_text,
        f1_width_filter, f2_encodable, f5_row_or_column, f7_detected_rows, f8_confident_words, f9_trimmed, f10_valid_lines, f11_digits_only, f15_small_components,
        f16_rows_of_page, f18_lexicon_words, w1_gaps, w2_word_groups, w3_gap_quantiles, w5_latin_runs, w7_room_to_right, w8_same_source, j2_shared_labels, j3_votes,
        j5_overlapping_words, j8_word_boxes, j9_free_boxes, j10_offset_above, j12_replaced_spans, j14_reachable, g7_row_bands, g11_warped, g12_rescaled, g13_turned,
        g15_real_height, d27_tiles, b1_union, b3_distinct_words, o2_presorted, o7_best_words, flagship_top_lines,
    )
}

_RIGHT = "box_left + wid"
_KEEP = "k AS (SELECT * FROM (SELECT *, min(word_id) OVER l AS lo, max(word_id) OVER l AS hi FROM w WINDOW l AS (PARTITION BY page_id, line_id)) WHERE NOT coalesce(prob < 0.35 OR ((word_id = lo OR word_id = hi) AND lc_type = 3 AND prob < 0.9), false))"
_VALID = "v AS (SELECT page_id, line_id FROM k GROUP BY ALL HAVING (count(*) > 1 AND avg(CASE WHEN prob >= 0.65 THEN 1.0 ELSE 0.0 END) >= 0.3) OR (count(*) = 1 AND max(prob) >= 0.7))"


def _runs(source: str) -> str:
    return f"""s AS (SELECT *, coalesce(regexp_matches(char_str, '^[A-Za-z]'), false) AS same, box_left + wid AS "right" FROM {source}),
      b AS (SELECT *, CASE WHEN same AND NOT coalesce(lag(same) OVER o, false) THEN 1 ELSE 0 END AS st FROM s WINDOW o AS (PARTITION BY page_id, line_id ORDER BY word_id, char_id)),
      g AS (SELECT *, sum(st) OVER (PARTITION BY page_id, line_id ORDER BY word_id, char_id ROWS UNBOUNDED PRECEDING) AS grp FROM b),
      r AS (SELECT page_id, line_id, grp, count(*) AS n, min(box_left) AS a, max("right") AS b FROM g WHERE same GROUP BY ALL HAVING count(*) >= 5)"""


def _spans(select: str) -> str:
    return f"""x AS ({select}), y AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY page_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NOT FALSE THEN 1 ELSE 0 END AS nw FROM x),
      z AS (SELECT *, sum(nw) OVER (PARTITION BY page_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS span FROM y)
      SELECT page_id, min(a) AS "start", max(b) AS "end", count(*) AS n FROM z GROUP BY page_id, span"""


ORACLE = {
    "a1_line_text": f"""WITH {WORDS} SELECT page_id, line_id, string_agg(coalesce(word_str, ''), '' ORDER BY word_id) AS line_text,
      string_agg(CASE WHEN left_add_space AND rn > 1 THEN ' ' ELSE '' END || coalesce(word_str, ''), '' ORDER BY word_id) AS leading,
      string_agg(coalesce(word_str, '') || CASE WHEN left_add_space THEN ' ' ELSE '' END, '' ORDER BY word_id) AS trailing
      FROM (SELECT *, row_number() OVER (PARTITION BY page_id, line_id ORDER BY word_id) AS rn FROM w) GROUP BY page_id, line_id""",
    "a3_bounds": f"WITH {WORDS} SELECT page_id, line_id, min(box_left) AS box_left, min(box_top) AS box_top, max({_RIGHT}) - min(box_left) AS wid, max(box_top + hei) - min(box_top) AS hei FROM w GROUP BY ALL",
    "a4_page_extent": f"WITH {LINES} SELECT page_id, min(box_left) AS box_left, min(box_top) AS box_top, max({_RIGHT}) - min(box_left) AS wid, max(box_top + hei) - min(box_top) AS hei FROM ln GROUP BY ALL",
    "a6_latin_share": f"""WITH {CHARS} SELECT page_id, line_id, round(CASE WHEN avg(CASE WHEN regexp_matches(char_str, '^[0-9]') OR regexp_matches(char_str, '^[!-/:-@\\[-`{{-~]') THEN 1.0 ELSE 0.0 END) >= 0.6 THEN 0.0
      ELSE avg(CASE WHEN regexp_matches(char_str, '^[A-Za-z]') THEN 1.0 ELSE 0.0 END) END, 6) AS latin_share FROM ch WHERE char_str IS NOT NULL GROUP BY ALL""",
    "a7_block_statistics": f"""WITH {WORDS}, g AS (SELECT *, lead(box_left) OVER (PARTITION BY page_id, line_id ORDER BY box_left, word_id) - {_RIGHT.replace(' + wid', '')} - wid AS gap FROM w),
      s AS (SELECT page_id, line_id, count(*) AS n, CAST(sum(wid) // count(*) AS BIGINT) AS mean_wid, CAST(sum(hei) // count(*) AS BIGINT) AS mean_hei, greatest(1.0::DOUBLE, coalesce(avg(gap), 1.0)) AS mean_gap FROM g GROUP BY ALL)
      SELECT page_id, line_id, n, mean_wid, mean_hei, round(mean_gap, 6) AS mean_gap, round(least(0.65::DOUBLE * mean_hei, 0.95::DOUBLE * mean_wid), 6) AS by_size, round(1.9::DOUBLE * mean_gap, 6) AS by_gap,
      round(least(0.65::DOUBLE * mean_hei, 0.95::DOUBLE * mean_wid, 1.9::DOUBLE * mean_gap), 6) AS space FROM s""",
    "a9_medians": f"""WITH {WORDS}, {LINES}, p AS (SELECT w.page_id, w.line_id, w.wid, w.hei FROM w JOIN ln ON w.page_id = ln.page_id AND w.line_id = ln.line_id WHERE w.hei > ln.hei / 5.0 AND w.wid > greatest(2.0, ln.hei / 10.0))
      SELECT page_id, line_id, list_sort(list(wid))[count(*) // 2 + 1] AS median_wid, list_sort(list(hei))[count(*) // 2 + 1] AS median_hei, round(avg(hei), 6) AS mean_hei FROM p GROUP BY ALL""",
    "a12_line_heights": f"""WITH {LINES}, r AS (SELECT *, CASE WHEN len(poly) >= 8 THEN CAST(trunc(sqrt(CAST((poly[1]-poly[7])*(poly[1]-poly[7]) + (poly[2]-poly[8])*(poly[2]-poly[8]) AS DOUBLE))) AS INTEGER) END AS real FROM ln)
      SELECT page_id, CAST(sum(real) // nullif(count(real), 0) AS BIGINT) AS mean_height, CAST(max(octet_length(encode(line_str))) AS INTEGER) AS most_bytes, count(*) FILTER (poly IS NULL) AS no_poly FROM r GROUP BY ALL""",
    "a14_accuracy": f"""WITH {WORDS}, {LINES}, r AS (SELECT page_id, line_id, replace(string_agg(coalesce(word_str, ''), '' ORDER BY word_id), ' ', '') AS rd FROM w GROUP BY ALL)
      SELECT b.lang, count(*) AS n, round(avg(CASE WHEN r.rd = replace(coalesce(ln.line_str, ''), ' ', '') THEN 1.0 ELSE 0.0 END), 6) AS accuracy
      FROM ln JOIN r ON ln.page_id = r.page_id AND ln.line_id = r.line_id JOIN books b ON b.book_id = ln.book_id GROUP BY b.lang""",
    "a15_font_usage": "WITH l AS (SELECT DISTINCT sample_id, letter_no, font_id FROM letters) SELECT font_id, count(*) AS uses, count(DISTINCT sample_id) AS samples FROM l GROUP BY font_id",
    "a16_page_text": f"WITH {LINES} SELECT page_id, string_agg(coalesce(line_str, ''), chr(10) ORDER BY line_id) AS page_text FROM ln GROUP BY page_id",
    "f1_width_filter": f"""WITH {LINES}, p AS (SELECT *, list_filter(string_split(line_str, ' '), lambda x: x <> '') AS parts FROM ln WHERE wid BETWEEN 50 AND 1000 AND line_str IS NOT NULL)
      SELECT page_id, line_id, wid, hei, coalesce(array_to_string(parts[1:greatest(len(parts) - 1, 0)], ' '), '') AS label FROM p""",
    "f2_encodable": f"""WITH {CHARS}, c AS (SELECT *, CASE WHEN unicode(char_str) BETWEEN 33 AND 126 THEN unicode(char_str) - 33 END AS idx FROM ch WHERE char_str IS NOT NULL)
      SELECT page_id, line_id, word_id, list(idx ORDER BY char_id) AS path FROM c GROUP BY ALL HAVING bool_and(idx IS NOT NULL)""",
    "f5_row_or_column": f"WITH {WORDS} SELECT page_id, line_id, word_id, hei > 2.0 * wid AS is_column FROM w",
    "f7_detected_rows": f"""WITH {LINES}, c AS (SELECT page_id, line_id, greatest(box_left, 0) AS "left", greatest(box_top, 0) AS top, least(box_left + wid - 1, img_w - 1) AS r, least(box_top + hei - 1, img_h - 1) AS b FROM ln),
      d AS (SELECT page_id, line_id, "left", top, r - "left" + 1 AS width, b - top + 1 AS height FROM c) SELECT * FROM d WHERE width >= 5 AND height >= 5 AND height <= 2 * width""",
    "f8_confident_words": f"WITH {WORDS}, {_KEEP} SELECT page_id, line_id, word_id, word_str, prob FROM k",
    "f9_trimmed": f"""WITH {WORDS}, s AS (SELECT *, CASE WHEN unicode(word_str) BETWEEN 19968 AND 40891 OR (log_prob > -0.1 AND log_prob < 1.0) THEN word_id END AS spot FROM w),
      t AS (SELECT *, min(spot) OVER l AS a, max(spot) OVER l AS b FROM s WINDOW l AS (PARTITION BY page_id, line_id)) SELECT page_id, line_id, word_id, word_str FROM t WHERE word_id BETWEEN a AND b""",
    "f10_valid_lines": f"WITH {WORDS}, {_KEEP}, {_VALID} SELECT * FROM v",
    "f11_digits_only": f"WITH {WORDS} SELECT page_id, line_id, word_id, word_str FROM w WHERE regexp_matches(word_str, '^[0-9]')",
    "f15_small_components": """WITH l AS (SELECT DISTINCT * FROM letters WHERE box_left >= 0), s AS (SELECT *, least(max(box_left + wid) OVER p, max(box_top + hei) OVER p) AS side FROM l WINDOW p AS (PARTITION BY sample_id))
      SELECT sample_id, letter_no, wid, hei FROM s WHERE wid > 0.1::DOUBLE * side AND hei > 0.1::DOUBLE * side""",
    "f16_rows_of_page": f"WITH {LINES}, q AS (SELECT *, first_value(hei) OVER (PARTITION BY page_id ORDER BY wid * hei DESC, line_id) AS h FROM ln), " + _spans("SELECT page_id, box_top AS a, box_top + hei - 1 AS b FROM q WHERE hei >= 0.25::DOUBLE * h"),
    "f18_lexicon_words": f"""WITH {WORDS}, k AS (SELECT DISTINCT lower(word) AS known, lang FROM lexicon),
      b AS (SELECT w.*, b.lang, lower(regexp_replace(w.word_str, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')) AS bare FROM w JOIN books b ON b.book_id = w.book_id),
      h AS (SELECT b.*, k.known IS NOT NULL AS hit FROM b LEFT JOIN k ON k.known = b.bare AND k.lang = b.lang),
      c AS (SELECT *, count(*) FILTER (hit AND length(bare) >= 5) OVER l AS long_valid, sum(CASE WHEN hit THEN 0 ELSE length(bare) END) OVER l AS noisy FROM h WINDOW l AS (PARTITION BY page_id, line_id))
      SELECT page_id, line_id, word_id, word_str FROM c WHERE hit OR NOT (long_valid <= noisy OR noisy > 2)""",
    "w1_gaps": f"""WITH {WORDS}, g AS (SELECT *, box_left - lag({_RIGHT}) OVER o AS l, lead(box_left) OVER o - ({_RIGHT}) AS r FROM w WINDOW o AS (PARTITION BY page_id, line_id ORDER BY box_left, word_id)),
      m AS (SELECT *, coalesce(avg(l) OVER (PARTITION BY page_id, line_id), 0.0) AS mean FROM g) SELECT page_id, line_id, word_id, round(coalesce(CAST(l AS DOUBLE), 3 * mean), 6) AS gap_left, round(coalesce(CAST(r AS DOUBLE), 3 * mean), 6) AS gap_right FROM m""",
    "w2_word_groups": f"WITH {WORDS} "
    + " UNION ALL ".join(
        f"SELECT page_id, line_id, word_id, {n} AS n, l AS group_left, r - l AS group_wid FROM (SELECT *, count(*) OVER o AS c, min(box_left) OVER o AS l, max({_RIGHT}) OVER o AS r FROM w WINDOW o AS (PARTITION BY page_id, line_id ORDER BY box_left, word_id ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)) WHERE c = {n}"
        for n in (1, 2, 3)
    ),
    "w3_gap_quantiles": f"""WITH {WORDS}, g AS (SELECT *, lead(box_left) OVER (PARTITION BY page_id, line_id ORDER BY box_left, word_id) - box_left - wid AS gap FROM w),
      l AS (SELECT page_id, line_id, list_sort(list(gap)) AS g FROM g WHERE gap IS NOT NULL GROUP BY ALL) SELECT page_id, line_id, g[len(g) // 3 + 1] AS third, g[2 * len(g) // 3 + 1] AS two_thirds FROM l""",
    "w5_latin_runs": f'WITH {CHARS}, {_runs("ch")} SELECT page_id, line_id, n, a AS "left", b AS "right" FROM r',
    "w7_room_to_right": f"""WITH {LINES}, n AS (SELECT *, lead(box_left) OVER o AS nl, lead(box_top) OVER o AS nt, lead(hei) OVER o AS nh FROM ln WINDOW o AS (PARTITION BY page_id ORDER BY line_id))
      SELECT page_id, line_id, CASE WHEN hei + nh - (greatest(box_top + hei, nt + nh) - least(box_top, nt)) > 0.8::DOUBLE * (hei + nh) / 2 AND nl > box_left THEN nl - box_left ELSE img_w - box_left END AS room FROM n""",
    "w8_same_source": f"""WITH {WORDS}, c AS (SELECT *, coalesce(CAST(lag(lc_type) OVER o <> lc_type AS INTEGER), 1) AS ch FROM w WINDOW o AS (PARTITION BY page_id, line_id ORDER BY word_id)),
      g AS (SELECT *, CAST(sum(ch) OVER (PARTITION BY page_id, line_id ORDER BY word_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS grp FROM c)
      SELECT page_id, line_id, grp, first(lc_type) AS lc_type, count(*) AS n, coalesce(string_agg(word_str, '' ORDER BY word_id), '') AS joined FROM g GROUP BY page_id, line_id, grp""",
    "j2_shared_labels": f"""WITH {CHARS}, c AS (SELECT DISTINCT char_str, lang FROM ch JOIN books b ON b.book_id = ch.book_id WHERE char_str IS NOT NULL)
      SELECT char_str FROM c WHERE lang = 'zh' AND char_str IN (SELECT char_str FROM c WHERE lang = 'en')""",
    "j3_votes": f"""WITH {WORDS}, {LINES}, {CHARS}, m2 AS (SELECT DISTINCT page_id, unnest(string_split(line_str, ' ')) AS s FROM ln WHERE line_str IS NOT NULL),
      m3 AS (SELECT DISTINCT page_id, s FROM (SELECT page_id, line_id, word_id, string_agg(char_str, '' ORDER BY char_id) AS s FROM ch WHERE char_str IS NOT NULL GROUP BY ALL)),
      v AS (SELECT *, (page_id, word_str) IN (SELECT (page_id, s) FROM m2) AS v2, (page_id, word_str) IN (SELECT (page_id, s) FROM m3) AS v3 FROM w WHERE word_str IS NOT NULL)
      SELECT page_id, line_id, word_id, word_str, round(prob + CASE WHEN v2 AND v3 THEN 0.3::DOUBLE WHEN v2 OR v3 THEN 0.1::DOUBLE ELSE -0.3::DOUBLE END, 6) AS score FROM v""",
    "j5_overlapping_words": f"""WITH {CHARS}, c AS (SELECT page_id, line_id, word_id, char_id, box_left, wid * 2 AS wid FROM ch), s AS (SELECT *, unnest(range(box_left // 256, (box_left + wid) // 256 + 1)) AS band FROM c)
      SELECT DISTINCT a.page_id, a.line_id, a.word_id, a.char_id, b.word_id AS other_word, b.char_id AS other_char, a.wid + b.wid - (greatest(a.box_left + a.wid, b.box_left + b.wid) - least(a.box_left, b.box_left)) AS overlap
      FROM s a JOIN s b ON a.page_id = b.page_id AND a.line_id = b.line_id AND a.band = b.band WHERE (a.word_id < b.word_id OR (a.word_id = b.word_id AND a.char_id < b.char_id))
        AND a.wid + b.wid - (greatest(a.box_left + a.wid, b.box_left + b.wid) - least(a.box_left, b.box_left)) > (a.wid + b.wid) / 4.0""",
    "j8_word_boxes": f"""WITH {WORDS}, {LINES}, p AS (SELECT w.page_id, w.line_id, w.word_id, w.wid + b.wid - (greatest(w.box_left + w.wid, b.box_left + b.wid) - least(w.box_left, b.box_left)) AS ow,
      w.hei + b.hei - (greatest(w.box_top + w.hei, b.box_top + b.hei) - least(w.box_top, b.box_top)) AS oh, w.wid * w.hei + b.wid * b.hei AS area FROM w JOIN ln b ON w.page_id = b.page_id),
      s AS (SELECT *, CASE WHEN ow < 0 OR oh < 0 THEN 0.0 ELSE CAST(ow * oh AS DOUBLE) / area END AS score FROM p) SELECT page_id, line_id, word_id, count(*) AS boxes, round(max(score), 6) AS best FROM s WHERE score > 0.01 GROUP BY ALL""",
    "j9_free_boxes": """WITH l AS (SELECT DISTINCT * FROM letters WHERE box_left >= 0) SELECT sample_id, letter_no, letter FROM l a WHERE NOT EXISTS (SELECT 1 FROM l b WHERE a.sample_id = b.sample_id AND a.letter_no <> b.letter_no
      AND a.wid + b.wid - (greatest(a.box_left + a.wid, b.box_left + b.wid) - least(a.box_left, b.box_left)) > 0 AND a.hei + b.hei - (greatest(a.box_top + a.hei, b.box_top + b.hei) - least(a.box_top, b.box_top)) > 0)""",
    "j10_offset_above": f"""WITH {LINES}, p AS (SELECT DISTINCT page_id, img_h FROM scan_pages), q AS (SELECT page_id, f.fifth, CAST(img_h * f.fifth // 6 AS INTEGER) AS y FROM p, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS fifth) f)
      SELECT page_id, fifth, y, coalesce((SELECT CAST(arg_max(box_left, (box_top, box_left)) AS DOUBLE) FROM ln WHERE ln.page_id = q.page_id AND ln.box_top < q.y), 0.0) AS "offset" FROM q""",
    "j12_replaced_spans": f"""WITH c0 AS (SELECT DISTINCT * FROM chars WHERE char_str IS NOT NULL), {_runs("c0")},
      u AS (SELECT page_id, line_id, box_left AS "left", 1 AS n, 'char' AS kind FROM c0 WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.page_id = c0.page_id AND r.line_id = c0.line_id AND c0.box_left BETWEEN r.a AND r.b)
      UNION ALL SELECT page_id, line_id, a, n, 'run' FROM r) SELECT page_id, line_id, kind, count(*) AS pieces, CAST(sum(n) AS BIGINT) AS n, min("left") AS "left" FROM u GROUP BY ALL""",
    "j14_reachable": f"""WITH {WORDS} SELECT a.page_id, a.line_id, a.word_id, b.word_id AS next_word FROM w a JOIN w b ON a.page_id = b.page_id AND a.line_id = b.line_id AND b.box_left >= a.box_left + a.wid
      WHERE NOT EXISTS (SELECT 1 FROM w c WHERE c.page_id = a.page_id AND c.line_id = a.line_id AND c.box_left >= a.box_left + a.wid AND c.box_left + c.wid <= b.box_left)""",
    "g7_row_bands": f"WITH {WORDS}, " + _spans("SELECT page_id, box_top AS a, box_top + hei - 1 AS b FROM w"),
    "g11_warped": f"""WITH {WORDS}, c AS (SELECT page_id, line_id, word_id, list_transform([[0, 0], [wid, 0], [0, hei], [wid, hei]], lambda d: CAST(floor((box_left + d[1] + (box_top + d[2]) * 0.25::DOUBLE + 8) / 2) AS INTEGER)) AS xs,
      list_transform([[0, 0], [wid, 0], [0, hei], [wid, hei]], lambda d: CAST(floor(((box_left + d[1]) * 0.125::DOUBLE + box_top + d[2] + 4) / 2) AS INTEGER)) AS ys FROM w)
      SELECT page_id, line_id, word_id, list_min(xs) AS "left", list_min(ys) AS top, list_max(xs) - list_min(xs) AS wid, list_max(ys) - list_min(ys) AS hei FROM c""",
    "g12_rescaled": f"""WITH {WORDS} SELECT page_id, line_id, word_id, CAST(trunc(box_left / 1.25::DOUBLE) AS INTEGER) AS "left", CAST(trunc(box_top / 1.25::DOUBLE) AS INTEGER) AS top, CAST(trunc(wid / 1.25::DOUBLE) AS INTEGER) AS wid, CAST(trunc(hei / 1.25::DOUBLE) AS INTEGER) AS hei FROM w""",
    "g13_turned": f"""WITH {LINES}, c AS (SELECT page_id, line_id, CASE line_id % 4 WHEN 1 THEN [img_w - box_top, box_left, img_w - box_top - hei + 1, box_left + wid - 1] WHEN 2 THEN [img_w - box_left, img_h - box_top, img_w - box_left - hei + 1, img_h - box_top - wid + 1]
      WHEN 3 THEN [box_top, img_h - box_left, box_top + hei - 1, img_h - box_left - wid + 1] ELSE [box_left, box_top, box_left + wid - 1, box_top + hei - 1] END AS c FROM ln)
      SELECT page_id, line_id, least(c[1], c[3]) AS "left", least(c[2], c[4]) AS top, abs(c[3] - c[1]) + 1 AS wid, abs(c[4] - c[2]) + 1 AS hei FROM c""",
    "g15_real_height": f"""WITH {LINES} SELECT page_id, line_id, CASE WHEN len(poly) >= 8 THEN CAST(trunc(sqrt(CAST((poly[1]-poly[7])*(poly[1]-poly[7]) + (poly[2]-poly[8])*(poly[2]-poly[8]) AS DOUBLE))) AS INTEGER) END AS real_height FROM ln""",
    "d27_tiles": f"""WITH {LINES}, k AS (SELECT page_id, line_id, wid * 4 AS width, CAST(greatest(0, ceil((wid * 4 - 1100) / 700.0)) AS INTEGER) AS last FROM ln), t AS (SELECT *, unnest(range(0, last + 1)) AS i FROM k)
      SELECT page_id, line_id, CAST(i AS INTEGER) AS tile, CAST(i * 700 AS INTEGER) AS "left", CAST(CASE WHEN i = last THEN width - i * 700 ELSE 900 END AS INTEGER) AS wid FROM t""",
    "b1_union": f"WITH {WORDS} SELECT page_id, line_id, count(*) FILTER (hei > wid) AS columns, count(*) AS n, arg_min(word_id, (box_left, word_id)) AS first_word FROM w GROUP BY ALL",
    "b3_distinct_words": f"WITH {WORDS} SELECT book_id, count(DISTINCT lower(word_str)) AS distinct_words FROM w WHERE word_str IS NOT NULL GROUP BY book_id",
    "o2_presorted": f"""WITH {LINES} SELECT page_id, line_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY concat_ws('_', box_left, box_top, box_left + wid - 1, box_top + hei - 1), line_id) AS INTEGER) AS place FROM ln""",
    "o7_best_words": f"WITH {WORDS} SELECT page_id, line_id, word_id, CAST(place AS INTEGER) AS place, prob FROM (SELECT *, row_number() OVER (PARTITION BY page_id, line_id ORDER BY prob DESC NULLS LAST, word_id DESC) AS place FROM w) WHERE place <= 3",
    "flagship_top_lines": f"""WITH {WORDS}, {_KEEP}, {_VALID} SELECT k.page_id, k.line_id, string_agg(coalesce(word_str, ''), '' ORDER BY word_id) AS line_text, count(*) AS n, round(avg(prob), 6) AS mean_prob
      FROM k JOIN v ON k.page_id = v.page_id AND k.line_id = v.line_id GROUP BY k.page_id, k.line_id ORDER BY n DESC, mean_prob DESC, k.page_id, k.line_id LIMIT 10""",
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)

"""Queries on what the other modules leave: output forms, frame readings, regions, and SQL for queries defined elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.functions import frames, geometry
from glyphmill.operators import greedy, joins, repair, result_json, segment
from glyphmill.operators import lines as ops
from glyphmill.operators.grouped import map_groups
from glyphmill.plans import records_sql
from glyphmill.plans.base import CHARS, KEY, LINES, WORDS, chars, letters, lines, words
from glyphmill.plans.operator_queries import BLANK, CLASSES, LINE, _matrices, _widened
from glyphmill.plans.text_queries import _account
from glyphmill.sources.tables import table

#: Labels that stand for punctuation in readings of embeddings.
PUNCTUATION = (1, 2)


# --- output forms ----------------------------------------------------------------------------


def k9_spaced_chars(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of a delivery menu: each character of a line's spaced words with its even part of the word's box."""
    rows = words(spark, folder, "word_str", "left_add_space", "box_left", "box_top", "wid", "hei").filter("word_str <> ''")
    spaced = F.concat(F.when(F.col("left_add_space") & (F.col("word_id") > 0), " ").otherwise(""), F.col("word_str"))
    n = F.length("shown")
    rows = rows.withColumn("shown", spaced).withColumn("n", n)
    rows = rows.select("*", F.posexplode(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.substr("shown", i, F.lit(1)))).alias("at", "ch"))
    left = F.expr("box_left + wid * at div n")
    value = F.concat_ws("\t", "ch", left.cast("string"), F.col("box_top").cast("string"), F.expr("wid div n").cast("string"), F.col("hei").cast("string"))
    return rows.select(*KEY, "at", value.alias("value"))


def k17_boxes_and_words(spark: SparkSession, folder: str) -> DataFrame:
    """Answers whose rects are one string."""
    return result_json.envelope(result_json.page_results(lines(spark, folder, "line_str", "box_left", "box_top", "wid", "hei"), rect_text=True))


def k19_multi_characters(spark: SparkSession, folder: str) -> DataFrame:
    """Single characters of all regions of a page: an array of arrays."""
    rows = words(spark, folder, "word_str", "prob").filter("word_str IS NOT NULL")
    cells = F.array_sort(F.collect_list(F.struct("word_id", F.col("word_str").alias("word"), F.format_string("%.4f", F.coalesce("prob", F.lit(0.0))).alias("prob"))))
    regions = rows.groupBy(*LINE).agg(F.transform(cells, lambda c: F.struct(c["word"].alias("word"), c["prob"].alias("prob"))).alias("cells"))
    both = F.array_sort(F.collect_list(F.struct("line_id", F.to_json("cells").alias("j"))))
    return regions.groupBy("page_id").agg(F.concat(F.lit('{"ret":['), F.array_join(F.transform(both, lambda x: x["j"]), ","), F.lit("]}")).alias("result"))


def k22_sidecar(spark: SparkSession, folder: str) -> DataFrame:
    """The text that goes beside a page's file: its lines from top to bottom."""
    cells = F.array_sort(F.collect_list(F.struct("box_top", "box_left", "line_id", "line_str")))
    rows = lines(spark, folder, "line_str", "box_top", "box_left").filter("line_str <> ''")
    return rows.groupBy("page_id").agg(F.array_join(F.transform(cells, lambda x: x["line_str"]), "\n").alias("text"))


def k23_layout_request(spark: SparkSession, folder: str) -> DataFrame:
    """The request for a page's layout: its image path in front, boxes scaled so that the longer side has 1500."""
    pages = table(spark, folder, "scan_pages").select("page_id", "img_name", "img_w", "img_h").distinct()
    rows = lines(spark, folder, "line_str", "box_left", "box_top", "wid", "hei").join(pages, "page_id")
    scale = F.lit(1500.0) / F.greatest("img_w", "img_h")
    for c in ops.BOX:
        rows = rows.withColumn(c, F.floor(F.col(c) * scale).cast("int"))
    results = result_json.page_results(rows).join(pages.select("page_id", "img_name"), "page_id")
    head = F.to_json(F.struct(F.col("img_name").alias("file")))
    request = F.concat(F.expr("substring(h, 1, length(h) - 1)"), F.lit(',"ret":['), F.array_join("ret", ","), F.lit("]}"))
    return results.withColumn("h", head).select("page_id", request.alias("request"))


def e7_listing(spark: SparkSession, folder: str) -> DataFrame:
    """All words of a page in order, as one list."""
    cells = F.array_sort(F.collect_list(F.struct("line_id", "word_id", "word_str")))
    rows = words(spark, folder, "word_str").filter("word_str IS NOT NULL")
    return rows.groupBy("page_id").agg(F.transform(cells, lambda x: x["word_str"]).alias("words"))


# --- regions ---------------------------------------------------------------------------------


def b4_merged_regions(spark: SparkSession, folder: str) -> DataFrame:
    """Formula regions and text regions of a page in one order; words with an operator sign between figures are formulas here."""
    formulas = words(spark, folder, "word_str", "box_left", "box_top", "wid", "hei").filter("word_str RLIKE '[0-9][-+=*/.,][0-9]'")
    formulas = formulas.select("page_id", "box_left", "box_top", "wid", "hei", F.lit("formula").alias("kind"))
    both = lines(spark, folder, "box_left", "box_top", "wid", "hei").select("page_id", "box_left", "box_top", "wid", "hei", F.lit("text").alias("kind")).unionByName(formulas)
    w = Window.partitionBy("page_id").orderBy("box_top", "box_left", "kind", "wid", "hei")
    return both.withColumn("place", F.row_number().over(w))


def f20_parsed_regions(spark: SparkSession, folder: str) -> DataFrame:
    """Regions whose text still holds something after it was parsed to letters and figures."""
    parsed = F.regexp_replace(F.col("line_str"), "[^0-9A-Za-z\\u4E00-\\u9FA5]", "")
    return lines(spark, folder, "line_str").select(*LINE, parsed.alias("parsed")).filter("parsed <> ''")


def f21_kept_rects(spark: SparkSession, folder: str) -> DataFrame:
    """Words left after the rects are removed whose height is less than half of their position score."""
    a = words(spark, folder, "box_left", "wid", "hei").select(*KEY, (F.col("box_left") + F.col("wid") / 2).alias("c"), "hei")
    b = joins.renamed(a)
    near = 1.0 / (1.0 + F.abs(F.col("c") - F.col("r_c")))
    met = a.join(b, (F.col("page_id") == F.col("r_page_id")) & (F.col("line_id") == F.col("r_line_id")) & (F.col("word_id") != F.col("r_word_id")))
    score = met.groupBy(*KEY).agg((F.sum(near * F.col("r_hei")) / F.sum(near)).alias("score"))
    noise = score.join(a.select(*KEY, "hei"), KEY).filter("hei < 0.5 * score").select(*KEY)
    return a.select(*KEY).join(noise, KEY, "left_anti")


def j9_text_beside_pictures(spark: SparkSession, folder: str) -> DataFrame:
    """Words that lie on no picture of their page; lines without recognised text are its pictures (anti join on rectangles, in bands)."""
    boxes = ("box_left", "box_top", "wid", "hei")
    text = words(spark, folder, *boxes).withColumn("y", F.col("box_top")).withColumn("y_end", F.col("box_top") + F.col("hei"))
    pictures = lines(spark, folder, "line_str", *boxes).filter("line_str IS NULL OR line_str = ''").select("page_id", *boxes)
    # shown a little larger, as pictures reach around what is detected of them
    pictures = pictures.withColumn("box_top", F.col("box_top") - F.col("hei")).withColumn("hei", F.col("hei") * 3)
    pictures = joins.renamed(pictures.withColumn("y", F.col("box_top")).withColumn("y_end", F.col("box_top") + F.col("hei")))
    meet = (geometry.intersection(F.col("box_left"), F.col("wid"), F.col("r_box_left"), F.col("r_wid")) > 0) & (geometry.intersection(F.col("box_top"), F.col("hei"), F.col("r_box_top"), F.col("r_hei")) > 0)
    on = joins.band_join(text, pictures, ["page_id"], "y", "y_end", 128, meet).select(*KEY).distinct()
    return text.select(*KEY).join(on, KEY, "left_anti")


def j19_answered_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages and the number of their answers, met by the stem of the image and of the answer."""
    stem = F.regexp_extract("img_name", "([^/]+)\\.[^.]*$", 1)
    pages = table(spark, folder, "scan_pages").select("page_id", stem.alias("stem")).distinct()
    answers = table(spark, folder, "responses").select("response_id", "page_id").distinct()
    found = answers.join(pages, "page_id").groupBy("stem").agg(F.count("*").alias("answers"))
    return pages.join(found, "stem").select("page_id", "stem", "answers")


def g14_unwarped(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes of chars back on a bent page: each lies on map points of its line, and takes their extent.

    A line's map has a point every 16 pixels; here it rises by a pixel each 64.
    """
    line = lines(spark, folder, "box_left", "box_top", "wid", "hei").filter("wid > 0")
    at = F.sequence(F.lit(0), F.floor(F.col("wid") / 16).cast("int"))
    points = line.select(*LINE, F.explode(at).alias("cell"), F.col("box_left").alias("x0"), F.col("box_top").alias("y0"), F.col("hei").alias("h"))
    points = points.select(*LINE, "cell", (F.col("x0") + F.col("cell") * 16).alias("px"), (F.col("y0") - F.floor(F.col("cell") / 4)).cast("int").alias("py"), "h")
    rows = chars(spark, folder, "box_left", "wid").join(line.select(*LINE, F.col("box_left").alias("x0")), LINE).filter("box_left >= x0 AND wid >= 0")
    first, last = F.floor((F.col("box_left") - F.col("x0")) / 16), F.floor((F.col("box_left") + F.col("wid") - F.col("x0")) / 16)
    rows = rows.select(*KEY, "char_id", F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("cell"))
    met = rows.join(points, [*LINE, "cell"]).groupBy(*KEY, "char_id")
    return met.agg(F.min("px").alias("left"), F.max("px").alias("right"), F.min("py").alias("top"), (F.max("py") + F.max("h")).alias("low"))


def f23_row_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """The boxes of a sample's row without noise, those that share their width joined."""
    rows = letters(spark, folder).filter("box_left >= 0").select("sample_id", "letter_no", "box_left", "box_top", "wid", "hei")
    return map_groups(rows, ["sample_id"], ["letter_no"], repair.row_noise_removed, "sample_id long, letter_no int, box_left int, box_top int, wid int, hei int")


def o3_turned_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The reading order of pages turned by each of the three other directions."""
    counts = words(spark, folder).groupBy(*LINE).agg(F.count("*").cast("int").alias("n_words"))
    rows = lines(spark, folder).join(counts, LINE, "left").fillna(0, ["n_words"])
    out = None
    for direction in (1, 2, 3):
        part = greedy.reading_order(rows.withColumn("direction", F.lit(direction))).withColumn("direction", F.lit(direction))
        out = part if out is None else out.unionByName(part)
    return out


def j6_suppressed_equal_text(spark: SparkSession, folder: str) -> DataFrame:
    """Words left after suppression in which punctuation gives way to the same text alone."""
    return greedy.suppress_overlaps(_widened(spark, folder), punctuation_needs_same_text=True).select(*KEY)


# --- words -----------------------------------------------------------------------------------


def w8_equal_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Consecutive words of a line that come from the same string become one (gaps and islands on the string)."""
    w = ops.ordered_words("word_id")
    rows = words(spark, folder, "word_str", "box_left", "wid").withColumn("src", F.lower(F.regexp_replace(F.coalesce("word_str", F.lit("")), "[^A-Za-z]", "")))
    rows = rows.withColumn("c", F.coalesce((F.lag("src").over(w) != F.col("src")).cast("int"), F.lit(1)))
    rows = rows.withColumn("grp", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    left = F.min("box_left")
    return rows.groupBy(*LINE, "grp", "src").agg(F.count("*").alias("n"), left.alias("left"), (F.max(F.col("box_left") + F.col("wid")) - left).alias("wid"))


def w10_whole_rows(spark: SparkSession, folder: str) -> DataFrame:
    """A line as one group of words."""
    return segment.word_groups(words(spark, folder, *ops.BOX), whole=True)


def d8_check_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Suggestions of the lexicon with the older check score, 1 - d / (length + 5); an apostrophe and the mark at the end are put back."""
    text = F.lower("word_str")
    rows = words(spark, folder, "word_str").filter("word_str <> ''").select(text.alias("seen")).distinct()
    core = F.regexp_replace("seen", "[.,;:!?]+$", "")
    rows = rows.withColumn("core", core).withColumn("tail", F.substring("seen", F.length(core) + 1, F.length("seen")))
    rows = rows.withColumn("at", F.when(F.length("core") - F.length(F.replace("core", F.lit("'"), F.lit(""))) == 1, F.instr("core", "'")).otherwise(0))
    rows = rows.withColumn("bare", F.when(F.col("at") > 0, F.replace("core", F.lit("'"), F.lit(""))).otherwise(F.col("core")))
    lexicon = table(spark, folder, "lexicon").filter("lang = 'en'").select(F.lower("word").alias("word")).distinct()
    met = _one_edit(rows, "bare").join(_one_edit(lexicon, "word"), "rest").select("seen", "bare", "tail", "at", "word").distinct()
    met = met.withColumn("d", F.levenshtein("bare", "word")).filter("d <= 1")
    back = F.when((F.col("at") > 1) & (F.col("at") - 1 <= F.length("word")), F.concat(F.expr("left(word, at - 1)"), F.lit("'"), F.expr("substring(word, at)"))).otherwise(F.col("word"))
    return met.select("seen", F.concat(back, "tail").alias("text"), F.round(1 - F.col("d") / (F.length("bare") + 5), 6).alias("score"))


def _one_edit(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``rest``: the column and all it becomes by one deletion; words one edit apart share one."""
    shorter = F.transform(F.sequence(F.lit(1), F.greatest(F.length(column), F.lit(1))), lambda i: F.concat(F.substring(F.col(column), F.lit(1), i - 1), F.substring(F.col(column), i + 1, F.length(column))))
    return df.withColumn("rest", F.explode(F.array_distinct(F.concat(F.array(column), shorter))))


def d38_whole_results(spark: SparkSession, folder: str) -> DataFrame:
    """Readings by attention are kept whole: a line's text as one word, over all of its frames."""
    rows = words(spark, folder, "word_str", "t_start", "t_end").filter("word_str IS NOT NULL")
    cells = F.array_sort(F.collect_list(F.struct("word_id", "word_str")))
    return rows.groupBy(*LINE).agg(F.array_join(F.transform(cells, lambda x: x["word_str"]), "").alias("word"), F.min("t_start").alias("first"), F.max("t_end").alias("last"))


def d23_words_of_range(spark: SparkSession, folder: str) -> DataFrame:
    """Words of the left half of a line, found by the window of frames that its geometry gives."""
    rows = words(spark, folder, "t_start", "t_end").filter("t_start IS NOT NULL AND t_end >= t_start")
    size = rows.groupBy(*LINE).agg((F.max("t_end") + 1).alias("frames"))
    return rows.join(size, LINE).filter("t_end < frames div 2").select(*KEY, "t_start", "t_end")


# --- frames ----------------------------------------------------------------------------------


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    """(vec_id, t, label): the best label of each frame."""
    return _matrices(spark, folder).select("vec_id", F.posexplode(frames.best_labels(F.col("m"), CLASSES)).alias("t", "label"))


def _spans(spark: SparkSession, folder: str) -> DataFrame:
    """(vec_id, first, last, label): the characters of a frame path, blanks left out."""
    w = Window.partitionBy("vec_id").orderBy("t")
    rows = _labels(spark, folder).withColumn("c", F.coalesce((F.lag("label").over(w) != F.col("label")).cast("int"), F.lit(1)))
    rows = rows.withColumn("run", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("label") != BLANK)
    return rows.groupBy("vec_id", "run", "label").agg(F.min("t").alias("first"), F.max("t").alias("last")).drop("run")


def x20_shrunk(spark: SparkSession, folder: str) -> DataFrame:
    """Characters of a frame string without blanks and repeats, each with its first and last frame.

    As in the reference's rule a character lasts to the frame before the next one begins.
    """
    w = Window.partitionBy("vec_id").orderBy("first")
    rows = _spans(spark, folder).select("vec_id", "first", "label")
    last = F.coalesce(F.lead("first").over(w) - 1, F.lit(7))
    return rows.select("vec_id", F.chr(F.col("label") + 97).alias("ch"), "first", last.alias("last"))


def d15_sub_words(spark: SparkSession, folder: str) -> DataFrame:
    """Sub-words of a frame path: each punctuation label stands alone, a path of punctuation alone stays whole."""
    w = Window.partitionBy("vec_id").orderBy("first")
    rows = _spans(spark, folder).withColumn("punct", F.col("label").isin(*PUNCTUATION))
    rows = rows.withColumn("all", F.min("punct").over(Window.partitionBy("vec_id")))
    cut_here = F.when(F.col("all"), F.lag("label").over(w).isNull()).otherwise(F.col("punct") | F.coalesce(F.lag("punct").over(w), F.lit(True)))
    rows = rows.withColumn("part", F.sum(cut_here.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    path = F.array_sort(F.collect_list(F.struct("first", "label")))
    return rows.groupBy("vec_id", "part").agg(F.transform(path, lambda x: x["label"]).alias("path"), F.min("first").alias("first"), F.max("last").alias("last"))


def d17_label_streams(spark: SparkSession, folder: str) -> DataFrame:
    """Label paths from one stream for each embedding: the blank parts results, 1 ends one, labels below 2 are marks."""
    w = Window.partitionBy("vec_id").orderBy("t")
    rows = _labels(spark, folder).withColumn("result", F.sum((F.col("label") == BLANK).cast("int")).over(w).cast("int")).filter(F.col("label") != BLANK)
    before = Window.partitionBy("vec_id", "result").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("ended", F.max((F.col("label") == 1).cast("int")).over(before)).filter("ended = 0 AND label >= 2")
    path = F.array_sort(F.collect_list(F.struct("t", "label")))
    return rows.groupBy("vec_id", "result").agg(F.transform(path, lambda x: x["label"] - 2).alias("path"))


def d19_char_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes of the characters of a frame path, on a word of 400 pixels: from frame to frame, the last as wide as the mean of the others."""
    w = Window.partitionBy("vec_id").orderBy("first")
    rows = _spans(spark, folder).select("vec_id", "first", "label").withColumn("char_no", F.row_number().over(w) - 1).withColumn("left", F.expr("400 * first div 8"))
    rows = rows.withColumn("wid", F.lead("left").over(w) - F.col("left"))
    whole = Window.partitionBy("vec_id")
    rows = rows.withColumn("mean", F.expr("cast(sum(wid) OVER (PARTITION BY vec_id) div nullif(count(wid) OVER (PARTITION BY vec_id), 0) as bigint)"))
    last = F.least(400 - F.col("left"), F.coalesce("mean", 400 - F.col("left")))
    return rows.withColumn("n", F.count("*").over(whole)).select("vec_id", "char_no", "label", "left", F.greatest(F.lit(1), F.coalesce("wid", last)).alias("width"))


def d21_post_processed(spark: SparkSession, folder: str) -> DataFrame:
    """Results of a batch after decoding: each character with its frames and its three best labels at its first one."""
    rows = _matrices(spark, folder).select("vec_id", F.posexplode(frames.frames(F.col("m"), CLASSES)).alias("first", "scores"))
    best = rows.select("vec_id", "first", F.slice(F.filter(frames.top_k(F.col("scores"), CLASSES), lambda k: k != BLANK), 1, 3).alias("best"))
    w = Window.partitionBy("vec_id").orderBy("first")
    return _spans(spark, folder).join(best, ["vec_id", "first"]).withColumn("char_no", F.row_number().over(w) - 1).select("vec_id", "char_no", "first", "last", "label", "best")


def d32_second_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Frames in doubt (below 0.8) with the next best label above 0.1, and what a reading gains or loses by it."""
    rows = _matrices(spark, folder).select("vec_id", F.posexplode(frames.frames(F.col("m"), CLASSES)).alias("t", "scores"))
    rows = rows.select("vec_id", "t", F.posexplode("scores").alias("label", "p"))
    w = Window.partitionBy("vec_id", "t").orderBy(F.desc("p"), "label")
    rows = rows.withColumn("place", F.row_number().over(w)).withColumn("top", F.max("p").over(Window.partitionBy("vec_id", "t")))
    rows = rows.filter("place = 2 AND top < 0.8 AND p > 0.1")
    return rows.select("vec_id", "t", "label", F.round(F.log(F.col("p").cast("double")) - F.log(F.col("top").cast("double")), 5).alias("change"))


QUERIES = {
    f.__name__: f
    for f in (
        k9_spaced_chars, k17_boxes_and_words, k19_multi_characters, k22_sidecar, k23_layout_request, e7_listing, b4_merged_regions, f20_parsed_regions, f21_kept_rects,
        j9_text_beside_pictures, j19_answered_pages, g14_unwarped, f23_row_boxes, o3_turned_pages, j6_suppressed_equal_text, w8_equal_sources, w10_whole_rows, d8_check_scores,
        d38_whole_results, d23_words_of_range, x20_shrunk, d15_sub_words, d17_label_streams, d19_char_boxes, d21_post_processed, d32_second_labels,
    )
}

_RECT = "{'left': CAST(box_left AS VARCHAR), 'top': CAST(box_top AS VARCHAR), 'width': CAST(wid AS VARCHAR), 'height': CAST(hei AS VARCHAR)}"
_OPEN = '{"errno":"0","errmas":"","querysign":"","ret":['
_B = """f AS (SELECT vec_id, t, embedding[t * 8 + 1 : t * 8 + 8] AS s FROM embeddings, (SELECT CAST(unnest(range(0, 8)) AS INTEGER) AS t)),
  b AS (SELECT vec_id, t, CAST(list_position(s, list_max(s)) - 1 AS INTEGER) AS label FROM f)"""
_SPANS = f"""{_B}, p AS (SELECT *, CASE WHEN label IS DISTINCT FROM lag(label) OVER (PARTITION BY vec_id ORDER BY t) THEN 1 ELSE 0 END AS c FROM b),
  r AS (SELECT *, sum(c) OVER (PARTITION BY vec_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM p),
  sp AS (SELECT vec_id, label, min(t) AS "first", max(t) AS "last" FROM r WHERE label <> 7 GROUP BY vec_id, run, label)"""
_ITEM = f"CAST(to_json({{'rect': {_RECT}, 'word': coalesce(line_str, '')}}) AS VARCHAR)"
_SETS = f"""cs AS (SELECT page_id, line_id, '[' || string_agg(CAST(to_json({{'rect': {_RECT}, 'word': coalesce(char_str, '')}}) AS VARCHAR), ',' ORDER BY word_id, char_id) || ']' AS s FROM ch GROUP BY ALL),
  it AS (SELECT ln.page_id, ln.line_id, left({_ITEM}, length({_ITEM}) - 1) || ',"charset":' || coalesce(cs.s, '[]') || '}}' AS item FROM ln LEFT JOIN cs ON cs.page_id = ln.page_id AND cs.line_id = ln.line_id),
  full_answers AS (SELECT page_id, '{_OPEN}' || string_agg(item, ',' ORDER BY line_id) || ']}}' AS result FROM it GROUP BY page_id)"""
_POINTS = "list_transform(range(0, CAST(len(poly) / 2 AS BIGINT)), lambda i: {'x': CAST(poly[i * 2 + 1] AS VARCHAR), 'y': CAST(poly[i * 2 + 2] AS VARCHAR)})"
_FULL_ITEM = f"CAST(CASE WHEN len(poly) >= 8 AND len(poly) % 2 = 0 THEN to_json({{'rect': {_RECT}, 'word': coalesce(line_str, ''), 'poly_location': {{'points': {_POINTS}}}}}) ELSE to_json({{'rect': {_RECT}, 'word': coalesce(line_str, '')}}) END AS VARCHAR)"
_BOX_ITEM = f"CAST(to_json({{'rect': {_RECT}}}) AS VARCHAR)"
_LOCATED = "a.page_id = b.page_id AND a.line_id = b.line_id AND a.word_id <> b.word_id"
# DuckDB counts bytes; English lexicon words are ASCII, so any other letter is one that differs
_DISTANCE = "levenshtein(regexp_replace({}, '[^ -~]', '~', 'g'), word)"
_SUGGESTED = f"""sg AS (SELECT seen, word, CAST({_DISTANCE.format("seen")} AS INTEGER) AS d FROM (SELECT DISTINCT lower(word_str) AS seen FROM w WHERE length(lower(word_str)) >= 3) s
    JOIN (SELECT DISTINCT lower(word) AS word FROM lexicon WHERE lang = 'en') l ON abs(length(seen) - length(word)) <= 2 WHERE {_DISTANCE.format("seen")} <= 2),
  rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY seen ORDER BY d, word) - 1 AS INTEGER) AS rank FROM sg), near AS (SELECT * FROM rk WHERE rank < 5),
  cd AS (SELECT w.page_id, w.line_id, w.word_id, near.word AS text, near.rank + 1 AS cand_id FROM w JOIN near ON near.seen = lower(w.word_str) WHERE near.d > 0)"""
_BOX = "concat_ws(chr(9), CAST(w.box_left AS VARCHAR), CAST(w.box_top AS VARCHAR), CAST(w.wid AS VARCHAR), CAST(w.hei AS VARCHAR), w.word_str"
_CANDIDATES = "cs AS (SELECT page_id, line_id, word_id, string_agg(text, chr(9) ORDER BY cand_id) AS tabbed, string_agg(text, '' ORDER BY cand_id) AS joined FROM cd GROUP BY ALL)"


def _candidate_lines(shown: str, more: str) -> str:
    return f"""WITH {WORDS}, {_SUGGESTED}, {_CANDIDATES} SELECT w.page_id, w.line_id, string_agg({shown}, '' ORDER BY w.word_id) || chr(9) || string_agg({_BOX}{more}) || chr(9) || coalesce(cs.tabbed, ''), chr(9) ORDER BY w.word_id) || chr(9) AS value
      FROM w LEFT JOIN cs ON cs.page_id = w.page_id AND cs.line_id = w.line_id AND cs.word_id = w.word_id GROUP BY w.page_id, w.line_id"""


ORACLE = {
    "k9_spaced_chars": f"""WITH {WORDS}, s AS (SELECT *, CASE WHEN left_add_space AND word_id > 0 THEN ' ' ELSE '' END || word_str AS shown FROM w WHERE word_str <> ''),
      u AS (SELECT *, CAST(unnest(range(0, length(shown))) AS INTEGER) AS pos FROM s)
      SELECT page_id, line_id, word_id, pos AS "at", concat_ws(chr(9), substring(shown, pos + 1, 1), CAST(box_left + wid * pos // length(shown) AS VARCHAR), CAST(box_top AS VARCHAR), CAST(wid // length(shown) AS VARCHAR), CAST(hei AS VARCHAR)) AS value FROM u""",
    "k17_boxes_and_words": f"""WITH {LINES} SELECT page_id, '{_OPEN}' || string_agg(CAST(to_json({{'rect': concat_ws(' ', box_left, box_top, wid, hei), 'word': coalesce(line_str, '')}}) AS VARCHAR), ',' ORDER BY line_id) || ']}}' AS result FROM ln GROUP BY page_id""",
    "k19_multi_characters": f"""WITH {WORDS}, r AS (SELECT page_id, line_id, '[' || string_agg(CAST(to_json({{'word': word_str, 'prob': printf('%.4f', coalesce(prob, 0.0))}}) AS VARCHAR), ',' ORDER BY word_id) || ']' AS j FROM w WHERE word_str IS NOT NULL GROUP BY ALL)
      SELECT page_id, '{{"ret":[' || string_agg(j, ',' ORDER BY line_id) || ']}}' AS result FROM r GROUP BY page_id""",
    "k22_sidecar": f"WITH {LINES} SELECT page_id, string_agg(line_str, chr(10) ORDER BY box_top, box_left, line_id) AS text FROM ln WHERE line_str <> '' GROUP BY page_id",
    "k23_layout_request": f"""WITH {LINES}, pg AS (SELECT DISTINCT page_id, img_name, img_w AS pw, img_h AS ph FROM scan_pages),
      s AS (SELECT ln.page_id, ln.line_id, line_str, img_name, {", ".join(f"CAST(floor({c} * (CAST(1500 AS DOUBLE) / greatest(pw, ph))) AS INTEGER) AS {c}" for c in ops.BOX)} FROM ln JOIN pg ON pg.page_id = ln.page_id)
      SELECT page_id, '{{"file":' || CAST(to_json(any_value(img_name)) AS VARCHAR) || ',"ret":[' || string_agg({_ITEM}, ',' ORDER BY line_id) || ']}}' AS request FROM s GROUP BY page_id""",
    "e7_listing": f"WITH {WORDS} SELECT page_id, list(word_str ORDER BY line_id, word_id) AS words FROM w WHERE word_str IS NOT NULL GROUP BY page_id",
    "b4_merged_regions": f"""WITH {WORDS}, {LINES}, u AS (SELECT page_id, box_left, box_top, wid, hei, 'text' AS kind FROM ln UNION ALL SELECT page_id, box_left, box_top, wid, hei, 'formula' FROM w WHERE regexp_matches(word_str, '[0-9][-+=*/.,][0-9]'))
      SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY box_top, box_left, kind, wid, hei) AS INTEGER) AS place FROM u""",
    "f20_parsed_regions": f"WITH {LINES}, p AS (SELECT page_id, line_id, regexp_replace(line_str, '[^0-9A-Za-z\\x{{4E00}}-\\x{{9FA5}}]', '', 'g') AS parsed FROM ln) SELECT * FROM p WHERE parsed <> ''",
    "f21_kept_rects": f"""WITH {WORDS}, c AS (SELECT page_id, line_id, word_id, hei, box_left + wid / 2.0::DOUBLE AS c FROM w), s AS (SELECT a.page_id, a.line_id, a.word_id, any_value(a.hei) AS hei, sum(b.hei / (1.0::DOUBLE + abs(a.c - b.c))) / sum(1.0::DOUBLE / (1.0::DOUBLE + abs(a.c - b.c))) AS score
      FROM c a JOIN c b ON {_LOCATED} GROUP BY ALL) SELECT page_id, line_id, word_id FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.page_id = c.page_id AND s.line_id = c.line_id AND s.word_id = c.word_id AND s.hei < 0.5 * s.score)""",
    "j9_text_beside_pictures": f"""WITH {WORDS}, {LINES}, q AS (SELECT page_id, box_left, box_top - hei AS box_top, wid, hei * 3 AS hei FROM ln WHERE line_str IS NULL OR line_str = '')
      SELECT page_id, line_id, word_id FROM w WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.page_id = w.page_id AND w.wid + q.wid > greatest(w.box_left + w.wid, q.box_left + q.wid) - least(w.box_left, q.box_left) AND w.hei + q.hei > greatest(w.box_top + w.hei, q.box_top + q.hei) - least(w.box_top, q.box_top))""",
    "j19_answered_pages": """WITH p AS (SELECT DISTINCT page_id, regexp_extract(img_name, '([^/]+)\\.[^.]*$', 1) AS stem FROM scan_pages), n AS (SELECT stem, count(*) AS answers FROM (SELECT DISTINCT response_id, page_id FROM responses) r JOIN p ON p.page_id = r.page_id GROUP BY stem)
      SELECT p.page_id, p.stem, answers FROM p JOIN n ON n.stem = p.stem""",
    "g14_unwarped": f"""WITH {CHARS}, {LINES}, m AS (SELECT page_id, line_id, box_left + k * 16 AS px, box_top - k // 4 AS py, hei AS h, k FROM (SELECT *, CAST(unnest(range(0, wid // 16 + 1)) AS INTEGER) AS k FROM ln WHERE wid > 0))
      SELECT c.page_id, c.line_id, c.word_id, c.char_id, min(px) AS "left", max(px) AS "right", min(py) AS top, max(py) + max(h) AS low FROM ch c JOIN ln l ON l.page_id = c.page_id AND l.line_id = c.line_id AND l.wid > 0 AND c.box_left >= l.box_left AND c.wid >= 0
      JOIN m ON m.page_id = c.page_id AND m.line_id = c.line_id AND m.k BETWEEN (c.box_left - l.box_left) // 16 AND (c.box_left + c.wid - l.box_left) // 16 GROUP BY ALL""",
    "w8_equal_sources": f"""WITH {WORDS}, s AS (SELECT *, lower(regexp_replace(coalesce(word_str, ''), '[^A-Za-z]', '', 'g')) AS src FROM w), c AS (SELECT *, CASE WHEN src IS DISTINCT FROM lag(src) OVER o THEN 1 ELSE 0 END AS c FROM s WINDOW o AS (PARTITION BY page_id, line_id ORDER BY word_id)),
      g AS (SELECT *, CAST(sum(c) OVER (PARTITION BY page_id, line_id ORDER BY word_id ROWS UNBOUNDED PRECEDING) AS INTEGER) AS grp FROM c) SELECT page_id, line_id, grp, src, count(*) AS n, min(box_left) AS "left", max(box_left + wid) - min(box_left) AS wid FROM g GROUP BY ALL""",
    "w10_whole_rows": f"""WITH {WORDS} SELECT page_id, line_id, 0 AS grp, arg_min(word_id, (box_left, word_id)) AS first_word, arg_max(word_id, (box_left, word_id)) AS last_word FROM w GROUP BY ALL""",
    "d8_check_scores": f"""WITH {WORDS}, s AS (SELECT DISTINCT lower(word_str) AS seen FROM w WHERE word_str <> ''), c AS (SELECT *, regexp_replace(seen, '[.,;:!?]+$', '') AS core FROM s), t AS (SELECT *, substring(seen, length(core) + 1) AS tail, CASE WHEN length(core) - length(replace(core, '''', '')) = 1 THEN instr(core, '''') ELSE 0 END AS pos FROM c),
      b AS (SELECT *, CASE WHEN pos > 0 THEN replace(core, '''', '') ELSE core END AS bare FROM t), l AS (SELECT DISTINCT lower(word) AS word FROM lexicon WHERE lang = 'en')
      SELECT seen, CASE WHEN pos > 1 AND pos - 1 <= length(word) THEN left(word, pos - 1) || '''' || substring(word, pos) ELSE word END || tail AS text, round(1 - CAST({_DISTANCE.format("bare")} AS DOUBLE) / (length(bare) + 5), 6) AS score
      FROM b JOIN l ON abs(length(bare) - length(word)) <= 1 WHERE {_DISTANCE.format("bare")} <= 1""",
    "d38_whole_results": f"WITH {WORDS} SELECT page_id, line_id, string_agg(word_str, '' ORDER BY word_id) AS word, min(t_start) AS \"first\", max(t_end) AS \"last\" FROM w WHERE word_str IS NOT NULL GROUP BY ALL",
    "d23_words_of_range": f"WITH {WORDS}, r AS (SELECT *, max(t_end) OVER (PARTITION BY page_id, line_id) + 1 AS frames FROM w WHERE t_start IS NOT NULL AND t_end >= t_start) SELECT page_id, line_id, word_id, t_start, t_end FROM r WHERE t_end < frames // 2",
    "x20_shrunk": f'WITH {_SPANS} SELECT vec_id, chr(label + 97) AS ch, "first", coalesce(lead("first") OVER (PARTITION BY vec_id ORDER BY "first") - 1, 7) AS "last" FROM sp',
    "d15_sub_words": f"""WITH {_SPANS}, q AS (SELECT *, label IN (1, 2) AS punct, bool_and(label IN (1, 2)) OVER (PARTITION BY vec_id) AS every, lag(label IN (1, 2)) OVER (PARTITION BY vec_id ORDER BY "first") AS prev FROM sp),
      k AS (SELECT *, CAST(sum(CASE WHEN (every AND prev IS NULL) OR (NOT every AND (punct OR coalesce(prev, true))) THEN 1 ELSE 0 END) OVER (PARTITION BY vec_id ORDER BY "first" ROWS UNBOUNDED PRECEDING) AS INTEGER) AS part FROM q)
      SELECT vec_id, part, list(label ORDER BY "first") AS path, min("first") AS "first", max("last") AS "last" FROM k GROUP BY vec_id, part""",
    "d17_label_streams": f"""WITH {_B}, g AS (SELECT *, CAST(sum(CASE WHEN label = 7 THEN 1 ELSE 0 END) OVER (PARTITION BY vec_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS INTEGER) AS result FROM b),
      e AS (SELECT *, max(CASE WHEN label = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY vec_id, result ORDER BY t ROWS UNBOUNDED PRECEDING) AS ended FROM g WHERE label <> 7) SELECT vec_id, result, list(label - 2 ORDER BY t) AS path FROM e WHERE ended = 0 AND label >= 2 GROUP BY vec_id, result""",
    "d19_char_boxes": f"""WITH {_SPANS}, n AS (SELECT vec_id, label, CAST(row_number() OVER o - 1 AS INTEGER) AS char_no, 400 * "first" // 8 AS "left", lead(400 * "first" // 8) OVER o - 400 * "first" // 8 AS wid FROM sp WINDOW o AS (PARTITION BY vec_id ORDER BY "first")),
      m AS (SELECT *, sum(wid) OVER (PARTITION BY vec_id) // nullif(count(wid) OVER (PARTITION BY vec_id), 0) AS mean FROM n)
      SELECT vec_id, char_no, label, "left", CAST(greatest(1, coalesce(wid, least(400 - "left", coalesce(mean, 400 - "left")))) AS BIGINT) AS width FROM m""",
    "d21_post_processed": f"""WITH {_SPANS}, k AS (SELECT vec_id, t, k AS label, embedding[t * 8 + k + 1] AS x FROM embeddings, (SELECT CAST(unnest(range(0, 8)) AS INTEGER) AS t) a, (SELECT CAST(unnest(range(0, 7)) AS INTEGER) AS k) c),
      o AS (SELECT *, row_number() OVER (PARTITION BY vec_id, t ORDER BY x DESC, label DESC) AS place FROM k), best AS (SELECT vec_id, t, list(label ORDER BY place) AS best FROM o WHERE place <= 3 GROUP BY vec_id, t)
      SELECT sp.vec_id, CAST(row_number() OVER (PARTITION BY sp.vec_id ORDER BY "first") - 1 AS INTEGER) AS char_no, "first", "last", sp.label, best FROM sp JOIN best ON best.vec_id = sp.vec_id AND best.t = "first" """,
    "d32_second_labels": """WITH k AS (SELECT vec_id, t, k AS label, embedding[t * 8 + k + 1] AS p FROM embeddings, (SELECT CAST(unnest(range(0, 8)) AS INTEGER) AS t) a, (SELECT CAST(unnest(range(0, 8)) AS INTEGER) AS k) c),
      o AS (SELECT *, row_number() OVER (PARTITION BY vec_id, t ORDER BY p DESC, label) AS place, max(p) OVER (PARTITION BY vec_id, t) AS top FROM k)
      SELECT vec_id, t, label, round(ln(CAST(p AS DOUBLE)) - ln(CAST(top AS DOUBLE)), 5) AS change FROM o WHERE place = 2 AND top < 0.8 AND p > 0.1""",
    # queries of other modules
    "s17_parsed_lines": f"""WITH {records_sql.JUDGED}, b AS (SELECT response_id, CAST(ret_no AS INTEGER) AS item, item->>'$.word' AS word, CASE json_type(item, '$.rect') WHEN 'OBJECT' THEN [item->>'$.rect.left', item->>'$.rect.top', item->>'$.rect.width', item->>'$.rect.height'] WHEN 'VARCHAR' THEN string_split(item->>'$.rect', ' ') END AS m
      FROM items SEMI JOIN good USING (k) WHERE json_type(item) = 'OBJECT') SELECT response_id, item, word, try_cast(m[1] AS INTEGER) AS box_left, try_cast(m[2] AS INTEGER) AS box_top, try_cast(m[3] AS INTEGER) AS wid, try_cast(m[4] AS INTEGER) AS hei FROM b WHERE word IS NOT NULL AND m IS NOT NULL""",
    "k14_json_chars": f"WITH {CHARS}, {LINES}, {_SETS} SELECT page_id, base64(encode(result)) AS result FROM full_answers",
    "k18_report": f"""WITH {LINES}, t AS (SELECT page_id, coalesce(line_str, '') || ' 13912345678' AS text FROM ln), ac AS (SELECT page_id, {_account("text")} FROM t),
      a AS (SELECT page_id, '"accounts":[' || string_agg(CAST(to_json({{'kind': kind, 'value': value}}) AS VARCHAR), ',' ORDER BY kind, value) || ']' AS j FROM ac WHERE kind IS NOT NULL GROUP BY page_id),
      tk AS (SELECT page_id, unnest(regexp_split_to_array(lower(line_str), '[^a-zà-ÿа-яё]+')) AS token FROM ln WHERE line_str IS NOT NULL), kw AS (SELECT DISTINCT tk.page_id, x.lang AS category, tk.token AS keyword FROM tk JOIN lexicon x ON lower(x.word) = tk.token AND length(x.word) >= 6),
      k AS (SELECT page_id, '"vocabulary":[' || string_agg(CAST(to_json({{'category': category, 'keyword': keyword}}) AS VARCHAR), ',' ORDER BY category, keyword) || ']' AS j FROM kw GROUP BY page_id)
      SELECT coalesce(a.page_id, k.page_id) AS page_id, '{{' || concat_ws(',', a.j, k.j) || '}}' AS result FROM a FULL JOIN k ON k.page_id = a.page_id""",
    "r1_answers": f"""WITH {CHARS}, {LINES}, {_SETS}, bx AS (SELECT page_id, length('{_OPEN}' || string_agg({_BOX_ITEM}, ',' ORDER BY line_id) || ']}}') AS size FROM ln GROUP BY page_id)
      SELECT 'Locate/st_ocrapi' AS request, page_id, size FROM bx UNION ALL SELECT 'LocateRecognize/st_ocrapi', page_id, length('{_OPEN}' || string_agg({_FULL_ITEM}, ',' ORDER BY line_id) || ']}}') FROM ln GROUP BY page_id
      UNION ALL SELECT 'Recognize/st_ocrapi_all', page_id, length(result) FROM full_answers""",
    "d7_candidates": f"""WITH {WORDS}, {_SUGGESTED}, v AS (SELECT * FROM w WHERE word_str IS NOT NULL AND word_str <> '')
      SELECT page_id, line_id, word_id, lower(word_str) AS text, CASE WHEN n.rank IS NOT NULL THEN 0.5 - 0.1 * n.rank ELSE 0.0 END::DOUBLE AS "check", 0.0::DOUBLE AS edit FROM v LEFT JOIN near n ON n.seen = lower(word_str) AND n.d = 0
      UNION ALL SELECT page_id, line_id, word_id, n.word, round(-0.1 * n.rank, 6)::DOUBLE, round(-CAST(n.d AS DOUBLE) / length(n.seen), 6) FROM v JOIN near n ON n.seen = lower(word_str) AND n.d > 0""",
    "k3_candidate_text": _candidate_lines("coalesce(w.word_str, '')", ""),
    "k4_menu_text": _candidate_lines("coalesce(w.word_str, '') || coalesce(cs.joined, '')", ", printf('%.3f', CAST(round(CAST(coalesce(w.prob, 0.0) AS DECIMAL(18, 6)), 3) AS DOUBLE))"),
    "d31_variations": f"""WITH {_B}, p AS (SELECT vec_id, list(label ORDER BY t) AS best FROM b GROUP BY vec_id), k AS (SELECT vec_id, t, k AS label, embedding[t * 8 + k + 1] AS x FROM embeddings, (SELECT CAST(unnest(range(0, 8)) AS INTEGER) AS t) a, (SELECT CAST(unnest(range(0, 8)) AS INTEGER) AS k) c),
      o AS (SELECT *, row_number() OVER (PARTITION BY vec_id, t ORDER BY x DESC, label DESC) AS place, max(x) OVER (PARTITION BY vec_id, t) AS top FROM k),
      c AS (SELECT p.vec_id, best, list_transform(range(0, 8), lambda i: CASE WHEN i = o.t THEN o.label ELSE best[i + 1] END) AS other FROM p JOIN o ON o.vec_id = p.vec_id WHERE place = 2 AND top <= 0.7),
      z AS (SELECT vec_id, list_transform(list_filter(range(1, 9), lambda i: other[i] <> 7 AND (i = 1 OR other[i] <> other[i - 1])), lambda i: CAST(other[i] AS INTEGER)) AS path, list_transform(list_filter(range(1, 9), lambda i: best[i] <> 7 AND (i = 1 OR best[i] <> best[i - 1])), lambda i: CAST(best[i] AS INTEGER)) AS own FROM c)
      SELECT vec_id, list_sort(list_distinct(list(path))) AS variants FROM z WHERE len(path) > 0 AND path <> own GROUP BY vec_id""",
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)

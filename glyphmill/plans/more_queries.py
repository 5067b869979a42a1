"""Queries on segmentation, remaining geometry, frames, and pixel measures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.functions import frames, geometry, text
from glyphmill.operators import decode, generate, greedy, images, joins, repair, result_json, segment
from glyphmill.operators import lines as ops
from glyphmill.operators.grouped import map_groups
from glyphmill.plans.base import CHARS, KEY, LETTERS, LINES, WORDS, chars, letters, lines, words
from glyphmill.sources import result_files
from glyphmill.sources.tables import table

LINE = ["page_id", "line_id"]
CLASSES, BLANK, SPACE = 8, 7, 4


def _matrices(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", F.slice("embedding", 1, CLASSES * CLASSES).alias("m"))


def f12_nonempty_lines(spark: SparkSession, folder: str) -> DataFrame:
    return lines(spark, folder).filter("line_str IS NOT NULL AND line_str <> ''").select(*LINE, "line_str")


def f13_weak_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """For each line the boxes of its words with a probability of 0.75 or more, as an array."""
    box = F.struct("word_id", "box_left", "wid", F.coalesce("prob", F.lit(0.0)).alias("prob"))
    rows = words(spark, folder).groupBy(*LINE).agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    return rows.select(*LINE, F.transform(F.filter("boxes", lambda b: b["prob"] >= 0.75), lambda b: b["box_left"]).alias("lefts"))


def f17_small_lines(spark: SparkSession, folder: str) -> DataFrame:
    small = geometry.small_area(F.col("wid"), F.col("hei"), F.col("img_w"), F.col("img_h"), 2000)
    return lines(spark, folder).filter(small).select(*LINE, "wid", "hei")


def f21_position_score(spark: SparkSession, folder: str) -> DataFrame:
    """Mean height of the other words of a line, the nearer ones counting more."""
    a = words(spark, folder).select(*KEY, (F.col("box_left") + F.col("wid") / 2).alias("c"), "hei")
    b = joins.renamed(a)
    near = 1.0 / (1.0 + F.abs(F.col("c") - F.col("r_c")))
    met = a.join(b, (F.col("page_id") == F.col("r_page_id")) & (F.col("line_id") == F.col("r_line_id")) & (F.col("word_id") != F.col("r_word_id")))
    return met.groupBy(*KEY).agg(F.round(F.sum(near * F.col("r_hei")) / F.sum(near), 6).alias("score"))


def f22_dots(spark: SparkSession, folder: str) -> DataFrame:
    """Small boxes of a sample that stand above another one, as the dot of an i does."""
    rows = table(spark, folder, "letters").distinct().filter("box_left >= 0").select("sample_id", "letter_no", "box_left", "box_top", "wid", "hei")
    # the middle of a dot lies in the span of the box below it, so the two meet in a band
    a = rows.withColumn("x", F.floor(F.col("box_left") + F.col("wid") / 2)).withColumn("x_end", F.col("x") + 1)
    big = joins.renamed(rows.withColumn("x", F.col("box_left")).withColumn("x_end", F.col("box_left") + F.col("wid")))
    centre = F.col("box_left") + F.col("wid") / 2
    small = (F.col("wid") * F.col("hei") * 2 < F.col("r_wid") * F.col("r_hei")) & centre.between(F.col("r_box_left"), F.col("r_box_left") + F.col("r_wid"))
    above = F.col("box_top") + F.col("hei") <= F.col("r_box_top") + F.col("r_hei") / 2
    met = joins.band_join(a, big, ["sample_id"], "x", "x_end", 64, (F.col("letter_no") != F.col("r_letter_no")) & small & above)
    return met.select("sample_id", F.col("letter_no").alias("dot"), F.col("r_letter_no").alias("below"))


def j11_extend_limits(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a line has another one close above and close below it, over a part of its width (band join)."""
    a = lines(spark, folder).select(*LINE, "box_left", "box_top", "wid", "hei", (F.col("box_top") - F.col("hei")).alias("y"), (F.col("box_top") + 2 * F.col("hei")).alias("y_end"))
    wide = geometry.intersection(F.col("box_left"), F.col("wid"), F.col("r_box_left"), F.col("r_wid")) > 0
    met = joins.band_join(a, joins.renamed(a), ["page_id"], "y", "y_end", 128, wide & (F.col("line_id") != F.col("r_line_id")))
    low, high = F.col("box_top") + F.col("hei"), F.col("r_box_top") + F.col("r_hei")
    above = (high <= F.col("box_top")) & (F.col("box_top") - high < F.col("hei") / 2)
    below = (F.col("r_box_top") >= low) & (F.col("r_box_top") - low < F.col("hei") / 2)
    flags = met.groupBy(*LINE).agg(F.bool_or(above).alias("above"), F.bool_or(below).alias("below"))
    return a.select(*LINE).join(flags, LINE, "left").select(*LINE, F.coalesce("above", F.lit(False)).alias("above"), F.coalesce("below", F.lit(False)).alias("below"))


def j13_batch_scatter(spark: SparkSession, folder: str) -> DataFrame:
    """Results of a batch put back to the rows they came from, by the index that was kept."""
    rows = lines(spark, folder).withColumn("slot", F.row_number().over(Window.partitionBy("page_id").orderBy("line_id")) - 1)
    results = words(spark, folder).groupBy(*LINE).agg(F.count("*").alias("n_words")).join(rows.select(*LINE, "slot"), LINE).select("page_id", "slot", "n_words")
    return rows.join(results, ["page_id", "slot"], "left").select(*LINE, "slot", F.coalesce("n_words", F.lit(0)).alias("n_words"))


def j15_nearest_grid(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest point of an uneven grid for the corner of each letter."""
    rows = letters(spark, folder).filter("box_left >= 0").select((F.col("sample_id") * 1000 + F.col("letter_no")).alias("id"), F.col("box_left").cast("double").alias("x"), F.col("box_top").cast("double").alias("y"))
    grid = spark.range(0, 4000).select("id", (F.col("id") % 100).alias("i"), F.floor(F.col("id") / 100).alias("j"))
    points = grid.select(F.col("id").alias("point_id"), (F.col("i") * 13 + F.col("j") % 5).cast("double").alias("px"), (F.col("j") * 9 + F.col("i") % 3).cast("double").alias("py"))
    out = joins.nearest_points(rows, points, 32.0)
    return out.select("id", "point_id", F.round("distance", 6).alias("distance"))


def j18_stems(spark: SparkSession, folder: str) -> DataFrame:
    """Pages and their answers, joined by the stem of the image name."""
    pages = table(spark, folder, "scan_pages").select("page_id", "img_name", "img_w", "img_h").distinct()
    stem = F.regexp_extract("img_name", "([^/]+)\\.[^.]*$", 1)
    pages = pages.select("page_id", F.regexp_replace("img_name", "/[^/]*$", "").alias("folder"), stem.alias("stem"), "img_w", "img_h")
    counts = lines(spark, folder).groupBy("page_id").agg(F.count("*").alias("n_lines"))
    return pages.join(counts, "page_id").select("page_id", "folder", "stem", "img_w", "img_h", "n_lines")


def o10_by_width(spark: SparkSession, folder: str) -> DataFrame:
    """Lines in batches of eight of like width within their page."""
    w = Window.partitionBy("page_id").orderBy("wid", "line_id")
    return lines(spark, folder).select(*LINE, "wid", F.floor((F.row_number().over(w) - 1) / 8).cast("int").alias("batch"))


def o11_widest(spark: SparkSession, folder: str) -> DataFrame:
    rows = letters(spark, folder).filter("box_left >= 0")
    return rows.groupBy("sample_id").agg(F.max_by("letter_no", F.struct("wid", -F.col("letter_no"))).alias("widest"))


def g10_from_columns(spark: SparkSession, folder: str) -> DataFrame:
    box = geometry.from_column(F.col("box_left"), F.col("box_top"), F.col("wid"), F.col("hei"), F.col("img_h"))
    return lines(spark, folder).select(*LINE, box.alias("b")).select(*LINE, "b.*")


def d28_to_height(spark: SparkSession, folder: str) -> DataFrame:
    rows = letters(spark, folder).filter("box_left >= 0")
    size = rows.groupBy("sample_id").agg(F.max(F.col("box_top") + F.col("hei")).alias("h"))
    box = geometry.to_height(F.col("box_left"), F.col("box_top"), F.col("wid"), F.col("hei"), F.col("h"))
    return rows.join(size, "sample_id").select("sample_id", "letter_no", box.alias("b")).select("sample_id", "letter_no", "b.*")


def p7_page_crop_scale(spark: SparkSession, folder: str) -> DataFrame:
    """The scale at which the text of a page fits a sheet."""
    rows = ops.bounds(lines(spark, folder), "page_id")
    return rows.select("page_id", F.round(geometry.page_crop(*[F.col(c) for c in ("box_left", "box_top", "wid", "hei")]), 6).alias("scale"))


def d11_likeliest_case(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", *[F.slice("embedding", a, 4).alias(n) for a, n in ((1, "a"), (5, "b"), (9, "c"))])
    return rows.select("vec_id", frames.likeliest_case(F.col("a"), F.col("b"), F.col("c")).alias("kind"))


def d13_words_of_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Words of a frame path, parted by the space class: first and last frame and labels (gaps and islands)."""
    rows = _matrices(spark, folder).select("vec_id", F.posexplode(frames.best_labels(F.col("m"), CLASSES)).alias("t", "label"))
    w = Window.partitionBy("vec_id").orderBy("t")
    rows = rows.withColumn("word", F.sum((F.col("label") == SPACE).cast("int")).over(w)).withColumn("fresh", F.coalesce(F.lag("label").over(w) != F.col("label"), F.lit(True)))
    rows = rows.filter(~F.col("label").isin(SPACE, BLANK))
    path = F.array_sort(F.collect_list(F.when(F.col("fresh"), F.struct("t", "label"))))
    return rows.groupBy("vec_id", "word").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.transform(path, lambda x: x["label"]).alias("path")).drop("word")


def d14_frame_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Words placed in their line by their frames instead of their boxes."""
    rows = words(spark, folder).filter("t_start IS NOT NULL AND t_end >= t_start")
    size = rows.groupBy(*LINE).agg((F.max("t_end") + 1).alias("frames"))
    bounds = lines(spark, folder).select(*LINE, F.col("box_left").alias("x"), F.col("wid").alias("w"))
    rows = rows.join(size, LINE).join(bounds, LINE)
    return rows.select(*KEY, F.expr("x + w * t_start div frames").alias("left"), F.expr("greatest(1, w * (t_end - t_start + 1) div frames)").alias("wid"))


def d18_attention_spans(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", frames.span_from_peak(F.col("embedding"), 0.001).alias("s"))
    return rows.select("vec_id", "s.first", "s.last")


def d30_even_chars(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes of a word's characters where only the word has one: even parts of it."""
    rows = words(spark, folder, "word_str", "box_left", "wid").filter("word_str RLIKE '^[!-~]+$'")
    rows = rows.select(*KEY, "box_left", "wid", F.length("word_str").alias("n"), F.posexplode(text.characters(F.col("word_str"))).alias("char_id", "ch"))
    return rows.select(*KEY, "char_id", "ch", F.expr("box_left + wid * char_id div n").alias("left"), F.expr("wid div n").alias("width"))


def d37_first_of_beams(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", frames.top_k(F.col("embedding"), 16).alias("labels"))
    return rows.select("vec_id", frames.first_of_beams(F.col("labels"), 4).alias("best"))


def d22_finished_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The whole clean-up of a line: suppression, weak words, both ends, valid lines, text, box."""
    rows = words(spark, folder)
    kept = rows.join(greedy.suppress_overlaps(rows).select(*KEY), KEY, "left_semi")
    kept = ops.trimmed_words(ops.confident_words(kept))
    kept = kept.join(ops.valid_lines(kept), LINE, "left_semi")
    return ops.line_text(kept, "leading").join(ops.bounds(kept, *LINE), LINE)


def d26_english_share_router(spark: SparkSession, folder: str) -> DataFrame:
    """How each line is read a second time: whole, in pieces, or not at all."""
    share = ops.latin_share(chars(spark, folder, "char_str"))
    found = w5_counts(spark, folder)
    route = F.when(F.col("latin_share") >= 0.95, "whole").when(F.col("pieces") > 0, "pieces").otherwise("none")
    return share.join(found, LINE, "left").select(*LINE, route.alias("route"))


def w5_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = chars(spark, folder, "char_str", "box_left", "wid").withColumn("right", F.col("box_left") + F.col("wid"))
    found = ops.runs(rows, LINE, ["word_id", "char_id"], F.col("char_str").rlike("^[A-Za-z]"), 5, ["box_left", "right"])
    return found.groupBy(*LINE).agg(F.count("*").alias("pieces"))


def w9_word_groups(spark: SparkSession, folder: str) -> DataFrame:
    return segment.word_groups(words(spark, folder, *ops.BOX))


def g6_component_rows(spark: SparkSession, folder: str) -> DataFrame:
    return segment.sample_rows_of_components(letters(spark, folder))


def g1_pixel_measures(spark: SparkSession, folder: str) -> DataFrame:
    """Samples drawn as small images, one dark box for each letter, and measured pixel by pixel."""
    rows = letters(spark, folder).filter("box_left >= 0").select("sample_id", "letter_no", "box_left", "box_top", "wid", "hei")

    def draw(g: list[dict]) -> list[dict]:
        w, h = max(r["box_left"] + r["wid"] for r in g) + 2, max(r["box_top"] + r["hei"] for r in g) + 2
        grey = np.full((h, w), 230, np.uint8)
        for r in g:
            grey[r["box_top"] : r["box_top"] + r["hei"], r["box_left"] : r["box_left"] + r["wid"]] = 40
        return [{"sample_id": g[0]["sample_id"], "height": h, "width": w, "pixels": grey.tobytes()}]

    drawn = map_groups(rows, ["sample_id"], ["letter_no"], draw, "sample_id long, height int, width int, pixels binary")
    return images.measure(drawn).select("sample_id", "n_components", "stroke_width", "cut_at", "dark", "light", F.aggregate("projection", F.lit(0), lambda a, x: a + x).alias("dark_pixels"))


def x2_encoded_again(spark: SparkSession, folder: str) -> DataFrame:
    """Code points back to text."""
    rows = letters(spark, folder).filter("letter IS NOT NULL").select("sample_id", "letter_no", text.code_points(F.col("letter")).alias("points"))

    def run(batches):
        for b in batches:
            texts = ["".join(map(chr, p)) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["sample_id", "letter_no", "letter"])

    return rows.mapInArrow(run, "sample_id long, letter_no int, letter string")


def x19_alignments(spark: SparkSession, folder: str) -> DataFrame:
    """The words of a line aligned with the line as recognised: score and number of matched characters."""
    read = ops.line_text(words(spark, folder, "word_str", "left_add_space"), out="read").join(lines(spark, folder).select(*LINE, "line_str"), LINE).filter("line_str IS NOT NULL")

    def fn(g: list[dict]) -> list[dict]:
        out = []
        for r in g:
            score, place = decode.align(r["read"], r["line_str"])
            out.append({"page_id": r["page_id"], "line_id": r["line_id"], "score": score, "matched": sum(p >= 0 for p in place)})
        return out

    return map_groups(read.select(*LINE, "read", "line_str"), LINE, [], fn, "page_id string, line_id int, score double, matched int")


def k3_candidate_text(spark: SparkSession, folder: str) -> DataFrame:
    """Result rows with the lexicon's candidates behind each word."""
    rows = words(spark, folder)
    lexicon = table(spark, folder, "lexicon").filter("lang = 'en'")
    return result_files.candidate_text(rows, decode.expand_candidates(rows, lexicon).filter("cand_id > 0"))


def k4_menu_text(spark: SparkSession, folder: str) -> DataFrame:
    rows = words(spark, folder)
    lexicon = table(spark, folder, "lexicon").filter("lang = 'en'")
    return result_files.candidate_text(rows, decode.expand_candidates(rows, lexicon).filter("cand_id > 0"), probability=True)


def k7_batch_text(spark: SparkSession, folder: str) -> DataFrame:
    return result_files.batch_text(lines(spark, folder))


def k11_estimation_words(spark: SparkSession, folder: str) -> DataFrame:
    return result_files.estimation_words(words(spark, folder))


def r1_answers(spark: SparkSession, folder: str) -> DataFrame:
    """The answers to three kinds of request."""
    forms = [("Locate", "st_ocrapi"), ("LocateRecognize", "st_ocrapi"), ("Recognize", "st_ocrapi_all")]
    out = None
    for detect, service in forms:
        part = result_json.answers(lines(spark, folder), chars(spark, folder), detect, service).select(F.lit(f"{detect}/{service}").alias("request"), "page_id", F.length("result").alias("size"))
        out = part if out is None else out.unionByName(part)
    return out


def y4_rotated(spark: SparkSession, folder: str) -> DataFrame:
    rows = letters(spark, folder).filter("box_left >= 0").select("sample_id", "letter_no", "box_left", "box_top", "wid", "hei")
    return generate.rotated_boxes(rows, 12.0, 100.0, 24.0).select("sample_id", "letter_no", *[f"{a}{i}" for i in range(1, 5) for a in "xy"])


def f19_noise_removed(spark: SparkSession, folder: str) -> DataFrame:
    """English pages without the words that make noise."""
    en = table(spark, folder, "books").filter("lang = 'en'").select("book_id")
    rows = words(spark, folder).join(en, "book_id", "left_semi")
    lexicon = table(spark, folder, "lexicon").filter("lang = 'en'").select("word")
    return repair.noisy_words_removed(rows, lines(spark, folder), lexicon).select(*KEY, "word_str")


def j17_crossing_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines put together again that were cut; heights are doubled here, so that some cross."""
    return repair.joined_crossing_lines(lines(spark, folder).withColumn("hei", F.col("hei") * 2))


def x25_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Words of any alphabet cut where letters, digits and punctuation meet."""
    rows = words(spark, folder).filter("word_str IS NOT NULL").select(*KEY, "word_str")
    return map_groups(rows, LINE, ["word_id"], lambda g: [dict(w, piece=i, text=t, at=a) for w in g for i, (t, a) in enumerate(repair.split_european(w["word_str"]))], "page_id string, line_id int, word_id int, piece int, text string, at int")


def x28_merged(spark: SparkSession, folder: str) -> DataFrame:
    """Words of English lines after close ones were joined: with hyphens, apostrophes, and by the lexicon."""
    en = table(spark, folder, "books").filter("lang = 'en'").select("book_id")
    lexicon = frozenset(r.word.lower() for r in table(spark, folder, "lexicon").filter("lang = 'en'").select("word").limit(500_001).collect())
    if len(lexicon) > 500_000:
        raise ValueError("the lexicon is larger than its bound")
    rows = words(spark, folder).join(en, "book_id", "left_semi").filter("word_str IS NOT NULL").select(*KEY, "word_str", "box_left", "wid")

    def fn(g: list[dict]) -> list[dict]:
        gaps = [b["box_left"] - a["box_left"] - a["wid"] for a, b in zip(g, g[1:])]
        space = max(1.0, sum(gaps) / len(gaps)) if gaps else 1.0
        return repair.merge_known(repair.merge_special(decode.merge_close(g, space), space), lexicon, space)

    return map_groups(rows, LINE, ["word_id"], fn, "page_id string, line_id int, word_id int, word_str string, box_left int, wid int")


QUERIES = {
    f.__name__: f
    for f in (
        f12_nonempty_lines, f13_weak_boxes, f17_small_lines, f21_position_score, f22_dots, j11_extend_limits, j13_batch_scatter, j15_nearest_grid, j18_stems, o10_by_width,
        o11_widest, g10_from_columns, d28_to_height, d11_likeliest_case, d13_words_of_frames, d14_frame_boxes, d18_attention_spans, d30_even_chars,
        d37_first_of_beams, d22_finished_lines, d26_english_share_router, w9_word_groups, g6_component_rows, g1_pixel_measures, x2_encoded_again, x19_alignments,
        k3_candidate_text, k4_menu_text, k7_batch_text, k11_estimation_words, r1_answers, y4_rotated, f19_noise_removed, j17_crossing_lines, x25_pieces, x28_merged,
    )
}
# a name of its own, since p7_ belongs to problem 7
QUERIES["g_page_crop_scale"] = p7_page_crop_scale

_CELL = "concat_ws(chr(9), CAST(box_left AS VARCHAR), CAST(box_top AS VARCHAR), CAST(wid AS VARCHAR), CAST(hei AS VARCHAR)"
_BEST = "b AS (SELECT vec_id, t, CAST(list_position(s, list_max(s)) - 1 AS INTEGER) AS label FROM (SELECT vec_id, t, embedding[t * 8 + 1 : t * 8 + 8] AS s FROM embeddings, (SELECT CAST(unnest(range(0, 8)) AS INTEGER) AS t)))"
_SUM = "list_sum(list_transform(embedding[{a}:{b}], lambda x: CASE WHEN x > 0 THEN ln(CAST(x AS DOUBLE)) ELSE -87.0 END))"
_SHARE = """c AS (SELECT page_id, line_id, avg(CASE WHEN regexp_matches(char_str, '^[0-9]') OR regexp_matches(char_str, '^[!-/:-@\\[-`{-~]') THEN 1.0 ELSE 0.0 END) AS o,
  avg(CASE WHEN regexp_matches(char_str, '^[A-Za-z]') THEN 1.0 ELSE 0.0 END) AS l FROM ch WHERE char_str IS NOT NULL GROUP BY ALL)"""
_RUNS = """s AS (SELECT *, coalesce(regexp_matches(char_str, '^[A-Za-z]'), false) AS same FROM ch),
  e AS (SELECT *, CASE WHEN same AND NOT coalesce(lag(same) OVER (PARTITION BY page_id, line_id ORDER BY word_id, char_id), false) THEN 1 ELSE 0 END AS st FROM s),
  g AS (SELECT *, sum(st) OVER (PARTITION BY page_id, line_id ORDER BY word_id, char_id ROWS UNBOUNDED PRECEDING) AS grp FROM e),
  r AS (SELECT DISTINCT page_id, line_id FROM (SELECT page_id, line_id, grp FROM g WHERE same GROUP BY ALL HAVING count(*) >= 5))"""

ORACLE = {
    "f19_noise_removed": f"""WITH {WORDS}, {LINES}, k AS (SELECT DISTINCT lower(word) AS known FROM lexicon WHERE lang = 'en'),
      b AS (SELECT w.*, lower(regexp_replace(coalesce(word_str, ''), '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')) AS bare FROM w WHERE book_id IN (SELECT book_id FROM books WHERE lang = 'en')),
      h AS (SELECT b.*, k.known IS NOT NULL AS hit, ln.hei > 0.6::DOUBLE * ln.img_h AS only_line FROM b JOIN ln ON ln.page_id = b.page_id AND ln.line_id = b.line_id LEFT JOIN k ON k.known = b.bare),
      c AS (SELECT *, count(*) FILTER (hit AND length(bare) >= 4) OVER l AS n_long, sum(CASE WHEN hit THEN 0 ELSE length(bare) END) OVER l AS noise FROM h WINDOW l AS (PARTITION BY page_id, line_id))
      SELECT page_id, line_id, word_id, word_str FROM c WHERE NOT (NOT only_line AND (n_long <= noise OR noise > 2) AND NOT hit AND length(bare) >= 3)""",
    "f12_nonempty_lines": f"WITH {LINES} SELECT page_id, line_id, line_str FROM ln WHERE line_str IS NOT NULL AND line_str <> ''",
    "f13_weak_boxes": f"WITH {WORDS} SELECT page_id, line_id, coalesce(list(box_left ORDER BY word_id) FILTER (coalesce(prob, 0.0) >= 0.75), []) AS lefts FROM w GROUP BY ALL",
    "f17_small_lines": f"WITH {LINES} SELECT page_id, line_id, wid, hei FROM ln WHERE wid * hei < img_w * img_h / 2000.0 OR wid < 3 OR hei < 3",
    "f21_position_score": f"""WITH {WORDS}, c AS (SELECT *, box_left + wid / 2.0::DOUBLE AS c FROM w) SELECT a.page_id, a.line_id, a.word_id, round(sum(b.hei / (1.0::DOUBLE + abs(a.c - b.c))) / sum(1.0::DOUBLE / (1.0::DOUBLE + abs(a.c - b.c))), 6) AS score
      FROM c a JOIN c b ON a.page_id = b.page_id AND a.line_id = b.line_id AND a.word_id <> b.word_id GROUP BY ALL""",
    "f22_dots": f"""WITH {LETTERS}, l AS (SELECT * FROM lt WHERE box_left >= 0) SELECT a.sample_id, a.letter_no AS dot, b.letter_no AS below FROM l a JOIN l b ON a.sample_id = b.sample_id AND a.letter_no <> b.letter_no
      AND a.wid * a.hei * 2 < b.wid * b.hei AND a.box_left + a.wid / 2.0 BETWEEN b.box_left AND b.box_left + b.wid AND a.box_top + a.hei <= b.box_top + b.hei / 2.0""",
    "j11_extend_limits": f"""WITH {LINES}, m AS (SELECT a.page_id, a.line_id, b.line_id AS o, a.box_top AS t, a.box_top + a.hei AS l, a.hei AS h, b.box_top AS bt, b.box_top + b.hei AS bl FROM ln a LEFT JOIN ln b ON a.page_id = b.page_id AND a.line_id <> b.line_id
        AND a.wid + b.wid - (greatest(a.box_left + a.wid, b.box_left + b.wid) - least(a.box_left, b.box_left)) > 0)
      SELECT page_id, line_id, coalesce(bool_or(bl <= t AND t - bl < h / 2.0), false) AS above, coalesce(bool_or(bt >= l AND bt - l < h / 2.0), false) AS below FROM m GROUP BY ALL""",
    "j13_batch_scatter": f"""WITH {WORDS}, {LINES} SELECT ln.page_id, ln.line_id, CAST(row_number() OVER (PARTITION BY ln.page_id ORDER BY ln.line_id) - 1 AS INTEGER) AS slot, coalesce(n.n, 0) AS n_words
      FROM ln LEFT JOIN (SELECT page_id, line_id, count(*) AS n FROM w GROUP BY ALL) n ON n.page_id = ln.page_id AND n.line_id = ln.line_id""",
    "j15_nearest_grid": f"""WITH {LETTERS}, p AS (SELECT k AS point_id, CAST((k % 100) * 13 + (k // 100) % 5 AS DOUBLE) AS px, CAST((k // 100) * 9 + (k % 100) % 3 AS DOUBLE) AS py FROM (SELECT unnest(range(0, 4000)) AS k)),
      q AS (SELECT sample_id * 1000 + letter_no AS id, CAST(box_left AS DOUBLE) AS x, CAST(box_top AS DOUBLE) AS y FROM lt WHERE box_left >= 0),
      d AS (SELECT id, min({{'d': (x - px) * (x - px) + (y - py) * (y - py), 'p': point_id}}) AS b FROM q JOIN p ON abs(x - px) <= 32 AND abs(y - py) <= 32 AND (x - px) * (x - px) + (y - py) * (y - py) <= 1024 GROUP BY id)
      SELECT q.id, d.b.p AS point_id, round(sqrt(d.b.d), 6) AS distance FROM q LEFT JOIN d ON d.id = q.id""",
    "j18_stems": f"""WITH {LINES}, p AS (SELECT DISTINCT page_id, img_name, img_w, img_h FROM scan_pages), n AS (SELECT page_id, count(*) AS n_lines FROM ln GROUP BY ALL)
      SELECT p.page_id, regexp_replace(img_name, '/[^/]*$', '') AS folder, regexp_extract(img_name, '([^/]+)\\.[^.]*$', 1) AS stem, img_w, img_h, n_lines FROM p JOIN n ON n.page_id = p.page_id""",
    "o10_by_width": f"WITH {LINES} SELECT page_id, line_id, wid, CAST((row_number() OVER (PARTITION BY page_id ORDER BY wid, line_id) - 1) // 8 AS INTEGER) AS batch FROM ln",
    "o11_widest": f"WITH {LETTERS} SELECT sample_id, arg_max(letter_no, (wid, -letter_no)) AS widest FROM lt WHERE box_left >= 0 GROUP BY sample_id",
    "g10_from_columns": f"""WITH {LINES} SELECT page_id, line_id, greatest(0, img_h - box_top - hei) AS "left", greatest(0, CAST(trunc(box_left - 0.25::DOUBLE * wid) AS INTEGER)) AS top, hei AS wid, wid AS hei FROM ln""",
    "d28_to_height": f"""WITH {LETTERS}, h AS (SELECT *, max(box_top + hei) OVER (PARTITION BY sample_id) AS h FROM lt WHERE box_left >= 0), r AS (SELECT *, h / 48.0::DOUBLE AS r FROM h),
      y AS (SELECT *, least(CAST(trunc(box_top * r) AS INTEGER), h - 1) AS y FROM r) SELECT sample_id, letter_no, CAST(trunc(box_left * r) AS INTEGER) AS "left", y AS top, CAST(trunc(wid * r) AS INTEGER) AS wid, least(CAST(trunc(hei * r) AS INTEGER), h - y) AS hei FROM y""",
    "g_page_crop_scale": f"WITH {LINES} SELECT page_id, round(least(595.0::DOUBLE / (max(box_left + wid) - min(box_left)), 842.0::DOUBLE / (max(box_top + hei) - min(box_top))), 6) AS scale FROM ln GROUP BY page_id",
    "d11_likeliest_case": f"""WITH s AS (SELECT vec_id, {_SUM.format(a=1, b=4)} AS a, {_SUM.format(a=5, b=8)} AS b, {_SUM.format(a=9, b=12)} AS c FROM embeddings)
      SELECT vec_id, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS kind FROM s""",
    "d13_words_of_frames": f"""WITH {_BEST}, p AS (SELECT *, sum(CASE WHEN label = 4 THEN 1 ELSE 0 END) OVER o AS word, label IS DISTINCT FROM lag(label) OVER o AS fresh FROM b WINDOW o AS (PARTITION BY vec_id ORDER BY t))
      SELECT vec_id, min(t) AS "first", max(t) AS "last", list(label ORDER BY t) FILTER (fresh) AS path FROM p WHERE label NOT IN (4, 7) GROUP BY vec_id, word""",
    "d14_frame_boxes": f"""WITH {WORDS}, {LINES}, f AS (SELECT *, max(t_end) OVER (PARTITION BY page_id, line_id) + 1 AS frames FROM w WHERE t_start IS NOT NULL AND t_end >= t_start)
      SELECT f.page_id, f.line_id, f.word_id, CAST(ln.box_left + ln.wid * t_start // frames AS BIGINT) AS "left", CAST(greatest(1, ln.wid * (t_end - t_start + 1) // frames) AS BIGINT) AS wid FROM f JOIN ln ON f.page_id = ln.page_id AND f.line_id = ln.line_id""",
    "d18_attention_spans": """WITH a AS (SELECT vec_id, embedding AS e, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS p FROM embeddings),
      n AS (SELECT *, list_position(list_transform(e[p + 2:], lambda x: x < 0.001), true) AS q FROM a) SELECT vec_id, p AS "first", CAST(p + coalesce(nullif(q, 0) - 1, len(e) - p - 1) AS INTEGER) AS "last" FROM n""",
    "d30_even_chars": f"""WITH {WORDS}, c AS (SELECT page_id, line_id, word_id, box_left, wid, word_str, length(word_str) AS n, unnest(range(0, length(word_str))) AS i FROM w WHERE regexp_matches(word_str, '^[!-~]+$'))
      SELECT page_id, line_id, word_id, CAST(i AS INTEGER) AS char_id, substring(word_str, i + 1, 1) AS ch, box_left + wid * i // n AS "left", wid // n AS width FROM c""",
    "d37_first_of_beams": """WITH f AS (SELECT vec_id, CAST(unnest(range(0, len(embedding))) AS INTEGER) AS i, unnest(embedding) AS x FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i DESC) - 1 AS p FROM f)
      SELECT vec_id, list(i ORDER BY p) AS best FROM r WHERE p < 16 AND p % 4 = 0 GROUP BY vec_id""",
    "d26_english_share_router": f"WITH {CHARS}, {_SHARE}, {_RUNS} SELECT c.page_id, c.line_id, CASE WHEN o < 0.6 AND l >= 0.95 THEN 'whole' WHEN r.page_id IS NOT NULL THEN 'pieces' ELSE 'none' END AS route FROM c LEFT JOIN r ON r.page_id = c.page_id AND r.line_id = c.line_id",
    "x2_encoded_again": f"WITH {LETTERS} SELECT sample_id, letter_no, letter FROM lt WHERE letter IS NOT NULL",
    "k7_batch_text": f"WITH {LINES} SELECT page_id || chr(9) || {_CELL}, line_str) || chr(9) AS value FROM ln WHERE line_str IS NOT NULL AND line_str <> ''",
    "k11_estimation_words": f"WITH {WORDS} SELECT page_id, line_id, word_id, word_str FROM w WHERE word_str IS NOT NULL AND word_str <> '<!>'",
    "y4_rotated": f"""WITH {LETTERS}, c AS (SELECT sample_id, letter_no, cos(radians(12.0)) AS c, sin(radians(12.0)) AS s, box_left - 100.0::DOUBLE AS x0, box_top - 24.0::DOUBLE AS y0, box_left + wid - 100.0::DOUBLE AS x1, box_top + hei - 24.0::DOUBLE AS y1 FROM lt WHERE box_left >= 0)
      SELECT sample_id, letter_no, """
    + ", ".join(
        f"CAST(round({x} * c - {y} * s + 100.0) AS INTEGER) AS x{i}, CAST(round({x} * s + {y} * c + 24.0) AS INTEGER) AS y{i}" for i, (x, y) in enumerate((("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")), 1)
    )
    + " FROM c",
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)

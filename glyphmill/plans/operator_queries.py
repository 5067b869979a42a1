"""Queries on decoding, suppression, layout, result files and sample planning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.functions import extract, frames, geometry, text
from glyphmill.operators import decode, generate, greedy, nested, result_json
from glyphmill.operators.grouped import map_groups
from glyphmill.plans.base import KEY, LETTERS, LINES, WORDS, chars, letters, lines, words
from glyphmill.plans.records import result_records
from glyphmill.plans.text_queries import e_keywords
from glyphmill.sources import result_files
from glyphmill.sources.tables import table

LINE = ["page_id", "line_id"]
#: Embeddings are read as matrices of eight frames by eight classes, the last class being the blank.
CLASSES, BLANK = 8, 7


def _matrices(spark: SparkSession, folder: str) -> DataFrame:
    m = F.col("embedding")
    return table(spark, folder, "embeddings").select("vec_id", F.slice(m, 1, CLASSES * CLASSES).alias("m"))


def d1_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    rows = _matrices(spark, folder).withColumn("best", frames.best_labels(F.col("m"), CLASSES))
    return rows.select("vec_id", "best", frames.collapse(F.col("best"), BLANK).alias("path"))


def a18_least_best(spark: SparkSession, folder: str) -> DataFrame:
    return _matrices(spark, folder).select("vec_id", F.round(frames.least_best(F.col("m"), CLASSES).cast("double"), 6).alias("least"))


def d12_label_spans(spark: SparkSession, folder: str) -> DataFrame:
    """First and last frame of every run of a label (gaps and islands)."""
    rows = _matrices(spark, folder).select("vec_id", F.posexplode(frames.best_labels(F.col("m"), CLASSES)).alias("t", "label"))
    w = Window.partitionBy("vec_id").orderBy("t")
    change = F.coalesce((F.lag("label").over(w) != F.col("label")).cast("int"), F.lit(1))
    rows = rows.withColumn("c", change).withColumn("run", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.filter(F.col("label") != BLANK).groupBy("vec_id", "run", "label").agg(F.min("t").alias("first"), F.max("t").alias("last")).drop("run")


def d20_top_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """The three best classes of each frame, blanks left out."""
    rows = _matrices(spark, folder).select("vec_id", F.posexplode(frames.frames(F.col("m"), CLASSES)).alias("t", "scores"))
    rows = rows.select("vec_id", "t", F.posexplode("scores").alias("label", "score")).filter(F.col("label") != BLANK)
    w = Window.partitionBy("vec_id", "t").orderBy(F.desc("score"), F.desc("label"))
    return rows.withColumn("place", F.row_number().over(w)).filter("place <= 3").select("vec_id", "t", "place", "label")


def o6_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", frames.top_k(F.col("embedding"), 5).alias("best"))


def d31_variations(spark: SparkSession, folder: str) -> DataFrame:
    """Readings that differ in one unsure frame: its second best label instead of the best, collapsed anew."""
    rows = _matrices(spark, folder)
    scores = frames.frames(F.col("m"), CLASSES)
    second = F.transform(scores, lambda f: F.element_at(frames.top_k(f, 2), 2))
    rows = rows.select("vec_id", frames.best_labels(F.col("m"), CLASSES).alias("best"), second.alias("second"), F.transform(scores, F.array_max).alias("top"))
    rows = rows.withColumn("own", frames.collapse(F.col("best"), BLANK))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.size("best") - 1)).alias("t")).filter(F.element_at("top", F.col("t") + 1) <= 0.7)
    changed = F.transform("best", lambda x, i: F.when(i == F.col("t"), F.element_at("second", F.col("t") + 1)).otherwise(x))
    rows = rows.withColumn("path", frames.collapse(changed, BLANK)).filter("size(path) > 0 AND path <> own")
    return rows.groupBy("vec_id").agg(F.array_sort(F.collect_set("path")).alias("variants"))


def d3_ctc_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Log probability of each matrix's own greedy path, frames taken through softmax."""
    rows = d1_collapsed(spark, folder).join(_matrices(spark, folder), "vec_id")
    rows = rows.withColumn("p", F.flatten(F.transform(frames.frames(F.col("m"), CLASSES), frames.softmax)))
    return decode.with_ctc_score(rows.select("vec_id", "path", "p"), "p", "path", CLASSES).select("vec_id", F.round("log_prob", 6).alias("log_prob"))


def d4_decoded_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of English books read anew: candidates from the lexicon, word pairs of the corpus, beam search."""
    books = table(spark, folder, "books").filter("lang = 'en'").select("book_id")
    rows = words(spark, folder).join(books, "book_id", "left_semi").filter("word_str IS NOT NULL")
    lexicon = table(spark, folder, "lexicon").filter("lang = 'en'")
    known = lexicon.select(F.lower("word").alias("seen")).distinct()
    w = Window.partitionBy(*LINE).orderBy("word_id")
    pairs = rows.select(*LINE, F.lag(F.lower("word_str")).over(w).alias("prev"), F.lower("word_str").alias("seen")).join(known, "seen", "left_semi")
    pairs = pairs.join(known.select(F.col("seen").alias("prev")), "prev", "left_semi")  # a closed vocabulary bounds the pairs
    counts = pairs.groupBy("prev", "seen").agg(F.count("*").alias("n"))
    totals = counts.groupBy("prev").agg(F.sum("n").alias("total"))
    bigrams = counts.join(totals, "prev").select("prev", F.col("seen").alias("word"), F.log((F.col("n") + 0.5) / (F.col("total") + 1)).alias("logp"))
    ones = rows.select(F.lower("word_str").alias("word")).join(known.select(F.col("seen").alias("word")), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    starts = ones.select(F.lit(None).cast("string").alias("prev"), "word", F.log(F.col("n") / 1e6).alias("logp"))
    candidates = decode.expand_candidates(rows, lexicon)
    return decode.decode_lines(rows, candidates, bigrams.unionByName(starts)).select(*LINE, "decoded", "path")


def d7_candidates(spark: SparkSession, folder: str) -> DataFrame:
    rows = words(spark, folder)
    lexicon = table(spark, folder, "lexicon").filter("lang = 'en'")
    out = decode.expand_candidates(rows, lexicon)
    return out.select(*KEY, "text", F.round("check", 6).alias("check"), F.round("edit", 6).alias("edit"))


def j5_suppressed(spark: SparkSession, folder: str) -> DataFrame:
    """Words left after exact suppression; boxes are widened here, so that neighbours overlap."""
    return greedy.suppress_overlaps(_widened(spark, folder)).select(*KEY)


def j5_dominated(spark: SparkSession, folder: str) -> DataFrame:
    """The set-based relative of j5_suppressed."""
    return greedy.dominated_removed(_widened(spark, folder)).select(*KEY)


def _widened(spark: SparkSession, folder: str) -> DataFrame:
    rows = words(spark, folder)
    return rows.withColumn("box_left", F.col("box_left") - F.lit(20)).withColumn("wid", F.col("wid") + 90)


def j7_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    rows = words(spark, folder)
    again = rows.filter("word_id % 4 = 0").withColumn("word_id", F.col("word_id") + 1000).withColumn("box_left", F.col("box_left") + 2)
    return greedy.merged_duplicates(rows.unionByName(again)).select(*KEY, "word_str", "box_left", "wid", "copies")


def j4_merged_lines(spark: SparkSession, folder: str) -> DataFrame:
    rows = words(spark, folder).withColumn("hei", F.col("hei") + 30)
    return greedy.merged_lines(rows).select(*KEY)


def a5_lines_of_words(spark: SparkSession, folder: str) -> DataFrame:
    return greedy.words_to_lines(words(spark, folder, "box_left", "box_top", "wid", "hei"))


def o3_reading_order(spark: SparkSession, folder: str) -> DataFrame:
    counts = words(spark, folder).groupBy(*LINE).agg(F.count("*").cast("int").alias("n_words"))
    rows = lines(spark, folder).join(counts, LINE, "left").fillna(0, ["n_words"]).withColumn("direction", F.lit(0))
    return greedy.reading_order(rows)


def w6_pushed_down(spark: SparkSession, folder: str) -> DataFrame:
    rows = lines(spark, folder).withColumn("real_height", geometry.polygon_height(F.col("poly")) + 12)
    return greedy.pushed_down(rows)


def b2_stitched(spark: SparkSession, folder: str) -> DataFrame:
    """Words seen in overlapping tiles of their line, put together again."""
    tiles = lines(spark, folder).select(*LINE, F.posexplode(geometry.tiles(F.col("wid"), 300, 80)).alias("tile", "t"), F.col("box_left").alias("x"))
    tiles = tiles.select(*LINE, "tile", (F.col("t.left") + F.col("x")).alias("tile_left"), F.col("t.wid").alias("tile_wid"))
    rows = words(spark, folder).select(*KEY, "word_str", "box_left", "wid").join(tiles, LINE)
    rows = rows.filter("box_left >= tile_left AND box_left + wid <= tile_left + tile_wid")
    return greedy.stitched(rows).select(*KEY, "tile")


def w4_refined(spark: SparkSession, folder: str) -> DataFrame:
    return greedy.refined_positions(words(spark, folder), lines(spark, folder))


def k1_result_text(spark: SparkSession, folder: str) -> DataFrame:
    return result_files.result_text(lines(spark, folder), words(spark, folder))


def k2_result_text_prob(spark: SparkSession, folder: str) -> DataFrame:
    return result_files.result_text(lines(spark, folder), words(spark, folder), probability=True)


def k8_best_readings(spark: SparkSession, folder: str) -> DataFrame:
    """A line's text with one word replaced by each of its lower-cased or upper-cased forms, and the total after that."""
    rows = words(spark, folder).filter("word_str IS NOT NULL AND log_prob < 1.0")
    w = Window.partitionBy(*LINE)
    texts = F.array_sort(F.collect_list(F.struct("word_id", "word_str")).over(w))
    rows = rows.withColumn("all", texts).withColumn("total", F.sum("log_prob").over(w))
    rows = rows.withColumn("variant", F.explode(F.array_distinct(F.array(text.lower_european(F.col("word_str")), text.upper_european(F.col("word_str")))))).filter("variant <> word_str")
    shown = F.array_join(F.transform("all", lambda x: F.when(x["word_id"] == F.col("word_id"), F.col("variant")).otherwise(x["word_str"])), " ")
    return rows.select(*KEY, shown.alias("reading"), F.round(F.col("total") - F.col("log_prob") + (F.col("log_prob") - 1.0), 4).alias("score"))


def k10_whole_line(spark: SparkSession, folder: str) -> DataFrame:
    return result_files.whole_line(words(spark, folder, "word_str"))


def k5_gbk(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of Chinese books in GBK, with the length in bytes, and read back."""
    zh = table(spark, folder, "books").filter("lang = 'zh'").select("book_id")
    rows = lines(spark, folder).join(zh, "book_id", "left_semi").filter("line_str IS NOT NULL").select(*LINE, "line_str")
    rows = result_files.decoded(result_files.encoded(rows, "line_str", "data"), "data", "back")
    return rows.select(*LINE, F.octet_length("data").alias("n_bytes"), "back")


def k13_json(spark: SparkSession, folder: str) -> DataFrame:
    return result_json.envelope(result_json.page_results(lines(spark, folder), polygons=True), sign=F.col("page_id"))


def k14_json_chars(spark: SparkSession, folder: str) -> DataFrame:
    return result_json.envelope(result_json.page_results(lines(spark, folder), chars(spark, folder)), encoded=True)


def k15_single_characters(spark: SparkSession, folder: str) -> DataFrame:
    return result_json.single_characters(words(spark, folder).filter("word_str IS NOT NULL"))


def k16_json_boxes(spark: SparkSession, folder: str) -> DataFrame:
    return result_json.envelope(result_json.page_results(lines(spark, folder), rect_text=True, words=False), direction=F.lit(90))


def k18_report(spark: SparkSession, folder: str) -> DataFrame:
    rows = lines(spark, folder).withColumn("a", extract.account(F.concat(F.coalesce("line_str", F.lit("")), F.lit(" 13912345678")))).filter("a IS NOT NULL")
    return result_json.spam_report(rows.select("page_id", "a.kind", "a.value"), e_keywords(spark, folder))


def k20_errors(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "responses").filter("err_no <> 0").select("response_id", "err_no", "err_msg").distinct()
    return rows.select("response_id", result_json.error_answer(F.col("err_no"), F.col("err_msg")).alias("answer"))


def j16_keyword_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Lexicon words of a page that stand together in a rule: each word with the next of its language."""
    lex = table(spark, folder, "lexicon").filter("length(word) >= 6").select("lang", F.lower("word").alias("first")).distinct()
    rules = lex.withColumn("second", F.lead("first").over(Window.partitionBy("lang").orderBy("first"))).filter("second IS NOT NULL").select("first", "second").distinct()
    return result_json.keyword_pairs(e_keywords(spark, folder).select("page_id", "keyword").distinct(), rules)


def s17_parsed_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the service's answers as typed rows: items without word or rect are left out."""
    records = nested.to_variant(result_records(spark, folder), "json")
    items = records.select("response_id", F.posexplode(nested.elements(F.col("value"), ("ret",))).alias("item", "v"))
    rect = F.try_variant_get("v", "$.rect", "struct<left:string,top:string,width:string,height:string>")
    text = F.split(F.try_variant_get("v", "$.rect", "string"), " ")
    boxes = [F.coalesce(rect[m], F.try_element_at(text, F.lit(i))).try_cast("int").alias(n) for i, (m, n) in enumerate(zip(("left", "top", "width", "height"), ("box_left", "box_top", "wid", "hei")), 1)]
    out = items.select("response_id", "item", F.try_variant_get("v", "$.word", "string").alias("word"), *boxes)
    return out.filter("word IS NOT NULL AND box_left IS NOT NULL")


def x24_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Words cut where letters, digits and punctuation meet, their boxes in proportion."""
    rows = words(spark, folder, "word_str", "box_left", "wid").filter("word_str RLIKE '^[!-~]+$'").select(*KEY, "word_str", "box_left", "wid")
    return map_groups(rows, LINE, ["word_id"], lambda g: [p for w in g for p in decode.split_boxes(w)], "page_id string, line_id int, word_id int, word_str string, box_left int, wid int, piece int")


def y1_font_weights(spark: SparkSession, folder: str) -> DataFrame:
    usage = table(spark, folder, "letters").select("sample_id", "letter_no", "font_id").distinct().groupBy("font_id").agg(F.count("*").alias("uses"))
    return generate.font_weights(usage)


def y2_backgrounds(spark: SparkSession, folder: str) -> DataFrame:
    ticket = (F.col("vec_id") * 7919 % 1000) / F.lit(1000.0)
    rows = table(spark, folder, "embeddings").select("vec_id", generate.background(ticket, [("none", 0.25), ("fusion", 0.35), ("foreground", 0.4)]).alias("kind"))
    return rows.groupBy("kind").agg(F.count("*").alias("n"))


def y3_augmentation(spark: SparkSession, folder: str) -> DataFrame:
    rows = letters(spark, folder).select("sample_id").distinct()
    return generate.augmentation_plan(rows, "sample_id", ["resize", "rotate", "shift", "pepper", "blur", "line"])


def y4_boxes(spark: SparkSession, folder: str) -> DataFrame:
    rows = letters(spark, folder).filter("box_left >= 0").select("sample_id", "letter_no", "box_left", "box_top", "wid", "hei")
    return generate.shifted_boxes(generate.scaled_boxes(rows, 1.5), 3, -2)


def k24_samples(spark: SparkSession, folder: str) -> DataFrame:
    return generate.sample_rows(letters(spark, folder))


QUERIES = {
    f.__name__: f
    for f in (
        d1_collapsed, a18_least_best, d12_label_spans, d20_top_candidates, o6_top_k, d31_variations, d3_ctc_scores, d4_decoded_lines, d7_candidates, j5_suppressed,
        j5_dominated, j7_duplicates, j4_merged_lines, a5_lines_of_words, o3_reading_order, w6_pushed_down, b2_stitched, w4_refined, k1_result_text, k2_result_text_prob,
        k8_best_readings, k10_whole_line, k5_gbk, k13_json, k14_json_chars, k15_single_characters, k16_json_boxes, k18_report, k20_errors, j16_keyword_pairs,
        s17_parsed_lines, x24_pieces, y1_font_weights, y2_backgrounds, y3_augmentation, y4_boxes, k24_samples,
    )
}

_FRAMES = """f AS (SELECT vec_id, t, embedding[t * 8 + 1 : t * 8 + 8] AS s FROM embeddings, (SELECT CAST(unnest(range(0, 8)) AS INTEGER) AS t)),
  b AS (SELECT vec_id, t, CAST(list_position(s, list_max(s)) - 1 AS INTEGER) AS label, list_max(s) AS top FROM f)"""
_CELL = "concat_ws(chr(9), CAST(box_left AS VARCHAR), CAST(box_top AS VARCHAR), CAST(wid AS VARCHAR), CAST(hei AS VARCHAR)"
_HEAD = "h AS (SELECT page_id, -1 AS line_id, -1 AS k, page_id || chr(9) || CAST(max(img_w) AS VARCHAR) || chr(9) || CAST(max(img_h) AS VARCHAR) || chr(9) AS value FROM ln GROUP BY page_id)"
_KEYWORDS = """e AS (SELECT DISTINCT t.page_id, t.token AS keyword FROM (SELECT page_id, unnest(regexp_split_to_array(lower(line_str), '[^a-zà-ÿа-яё]+')) AS token FROM ln WHERE line_str IS NOT NULL) t
  JOIN lexicon x ON lower(x.word) = t.token AND length(x.word) >= 6)"""

_U, _L = f"'{text._UPPER}'", f"'{text._LOWER}'"
_RECT = """{'left': CAST(box_left AS VARCHAR), 'top': CAST(box_top AS VARCHAR), 'width': CAST(wid AS VARCHAR), 'height': CAST(hei AS VARCHAR)}"""
_POINTS = "list_transform(range(0, CAST(len(poly) / 2 AS BIGINT)), lambda i: {'x': CAST(poly[i * 2 + 1] AS VARCHAR), 'y': CAST(poly[i * 2 + 2] AS VARCHAR)})"

ORACLE = {
    "k13_json": f"""WITH {LINES}, i AS (SELECT page_id, line_id, CAST(CASE WHEN len(poly) >= 8 AND len(poly) % 2 = 0 THEN to_json({{'rect': {_RECT}, 'word': coalesce(line_str, ''), 'poly_location': {{'points': {_POINTS}}}}})
        ELSE to_json({{'rect': {_RECT}, 'word': coalesce(line_str, '')}}) END AS VARCHAR) AS item FROM ln)
      SELECT page_id, '{{"errno":"0","errmas":"","querysign":"' || page_id || '","ret":[' || string_agg(item, ',' ORDER BY line_id) || ']}}' AS result FROM i GROUP BY page_id""",
    "k15_single_characters": f"""WITH {WORDS} SELECT page_id, line_id, '{{"ret":[' || string_agg(CAST(to_json({{'word': word_str, 'prob': printf('%.4f', coalesce(prob, 0.0))}}) AS VARCHAR), ',' ORDER BY word_id) || ']}}' AS result FROM w WHERE word_str IS NOT NULL GROUP BY ALL""",
    "k16_json_boxes": f"""WITH {LINES} SELECT page_id, '{{"errno":"0","errmas":"","querysign":"","ret":[{{"imgdir":"90"}},' || string_agg('{{"rect":"' || concat_ws(' ', box_left, box_top, wid, hei) || '"}}', ',' ORDER BY line_id) || ']}}' AS result FROM ln GROUP BY page_id""",
    "d1_collapsed": f"""WITH {_FRAMES}, p AS (SELECT *, lag(label) OVER (PARTITION BY vec_id ORDER BY t) AS prev FROM b)
      SELECT vec_id, list(label ORDER BY t) AS best, coalesce(list(label ORDER BY t) FILTER (label <> 7 AND label IS DISTINCT FROM prev), []) AS path FROM p GROUP BY vec_id""",
    "a18_least_best": f"WITH {_FRAMES} SELECT vec_id, round(CAST(min(top) AS DOUBLE), 6) AS least FROM b GROUP BY vec_id",
    "d12_label_spans": f"""WITH {_FRAMES}, p AS (SELECT *, CASE WHEN label IS DISTINCT FROM lag(label) OVER (PARTITION BY vec_id ORDER BY t) THEN 1 ELSE 0 END AS c FROM b),
      r AS (SELECT *, sum(c) OVER (PARTITION BY vec_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM p) SELECT vec_id, label, min(t) AS "first", max(t) AS "last" FROM r WHERE label <> 7 GROUP BY vec_id, run, label""",
    "d20_top_candidates": """WITH f AS (SELECT vec_id, t, k AS label, embedding[t * 8 + k + 1] AS score FROM embeddings, (SELECT CAST(unnest(range(0, 8)) AS INTEGER) AS t) a, (SELECT CAST(unnest(range(0, 7)) AS INTEGER) AS k) b),
      r AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id, t ORDER BY score DESC, label DESC) AS INTEGER) AS place FROM f) SELECT vec_id, t, place, label FROM r WHERE place <= 3""",
    "o6_top_k": """WITH f AS (SELECT vec_id, CAST(unnest(range(0, len(embedding))) AS INTEGER) AS i, unnest(embedding) AS x FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i DESC) AS p FROM f)
      SELECT vec_id, list(i ORDER BY p) AS best FROM r WHERE p <= 5 GROUP BY vec_id""",
    "j5_dominated": f"""WITH {WORDS}, v AS (SELECT page_id, line_id, word_id, lc_type, box_left - 20 AS x, wid + 90 AS n, CASE WHEN log_prob IS NULL OR log_prob = 1.0 THEN -1e9 ELSE log_prob END AS s FROM w)
      SELECT page_id, line_id, word_id FROM v a WHERE NOT EXISTS (SELECT 1 FROM v b WHERE a.page_id = b.page_id AND a.line_id = b.line_id AND a.word_id <> b.word_id
        AND a.n + b.n - (greatest(a.x + a.n, b.x + b.n) - least(a.x, b.x)) > CASE WHEN a.lc_type = 3 AND b.lc_type = 3 THEN 1.0 ELSE (a.n + b.n) / 4.0 END AND (b.s > a.s OR (b.s = a.s AND b.word_id < a.word_id)))""",
    "k1_result_text": f"""WITH {WORDS}, {LINES}, {_HEAD}, g AS (SELECT page_id, line_id, string_agg({_CELL}, word_str), chr(9) ORDER BY word_id) AS g FROM w GROUP BY ALL),
      r AS (SELECT * FROM h UNION ALL SELECT ln.page_id, ln.line_id, 0, concat_ws(chr(9), {_CELL}, line_str), g.g) || chr(9) FROM ln LEFT JOIN g ON g.page_id = ln.page_id AND g.line_id = ln.line_id WHERE line_str IS NOT NULL AND line_str <> '')
      SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY line_id, k) - 1 AS INTEGER) AS row_no, value FROM r""",
    "k2_result_text_prob": f"""WITH {WORDS}, {LINES}, {_HEAD}, s AS (SELECT * FROM ln WHERE line_str IS NOT NULL AND line_str <> ''),
      r AS (SELECT * FROM h UNION ALL SELECT page_id, line_id, -1, {_CELL}, line_str) || chr(9) FROM s
        UNION ALL SELECT page_id, line_id, word_id, {_CELL}, word_str, printf('%.4f', coalesce(prob, 0.0))) || chr(9) FROM w WHERE EXISTS (SELECT 1 FROM s WHERE s.page_id = w.page_id AND s.line_id = w.line_id))
      SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY line_id, k) - 1 AS INTEGER) AS row_no, value FROM r""",
    "k8_best_readings": f"""WITH {WORDS}, r AS (SELECT *, sum(log_prob) OVER (PARTITION BY page_id, line_id) AS total FROM w WHERE word_str IS NOT NULL AND log_prob < 1.0),
      v AS (SELECT DISTINCT r.page_id, r.line_id, r.word_id, r.total, r.word_str, unnest([translate(word_str, {_U}, {_L}), translate(word_str, {_L}, {_U})]) AS variant FROM r)
      SELECT v.page_id, v.line_id, v.word_id, string_agg(CASE WHEN r.word_id = v.word_id THEN v.variant ELSE r.word_str END, ' ' ORDER BY r.word_id) AS reading, round(v.total - 1.0, 4) AS score
      FROM v JOIN r ON r.page_id = v.page_id AND r.line_id = v.line_id WHERE v.variant <> v.word_str GROUP BY v.page_id, v.line_id, v.word_id, v.variant, v.total""",
    "k10_whole_line": f"""WITH {WORDS}, n AS (SELECT *, row_number() OVER (PARTITION BY page_id, line_id ORDER BY word_id) AS rn FROM w)
      SELECT page_id, line_id, coalesce(string_agg(word_str, ' ' ORDER BY word_id) FILTER (word_str <> '' AND (word_str <> 'i' OR rn = 1)), '') AS whole FROM n GROUP BY ALL""",
    "k20_errors": """SELECT DISTINCT response_id, '{"errno":"' || CAST(err_no AS VARCHAR) || '","errmas":"' || coalesce(err_msg, '') || '","querysign":""}' AS answer FROM responses WHERE err_no <> 0""",
    "j16_keyword_pairs": f"""WITH {LINES}, {_KEYWORDS}, l AS (SELECT DISTINCT lang, lower(word) AS f FROM lexicon WHERE length(word) >= 6), r AS (SELECT DISTINCT f, lead(f) OVER (PARTITION BY lang ORDER BY f) AS s FROM l)
      SELECT DISTINCT a.page_id, a.keyword || '&' || b.keyword AS pair FROM e a JOIN r ON r.f = a.keyword JOIN e b ON b.page_id = a.page_id AND b.keyword = r.s""",
    "y1_font_weights": """WITH u AS (SELECT font_id, count(*) AS uses FROM (SELECT DISTINCT sample_id, letter_no, font_id FROM letters) GROUP BY font_id)
      SELECT font_id, uses, CAST(sum(uses + 1) OVER () // (uses + 1) AS BIGINT) AS weight FROM u""",
    "y2_backgrounds": """WITH t AS (SELECT (vec_id * 7919 % 1000) / 1000.0 AS ticket FROM embeddings) SELECT CASE WHEN ticket < 0.25 THEN 'none' WHEN ticket < 0.6 THEN 'fusion' ELSE 'foreground' END AS kind, count(*) AS n FROM t GROUP BY 1""",
    "y4_boxes": f"""WITH {LETTERS} SELECT sample_id, letter_no, CAST(floor(box_left * 1.5::DOUBLE) AS INTEGER) + 3 AS box_left, CAST(floor(box_top * 1.5::DOUBLE) AS INTEGER) - 2 AS box_top,
      CAST(floor(wid * 1.5::DOUBLE) AS INTEGER) AS wid, CAST(floor(hei * 1.5::DOUBLE) AS INTEGER) AS hei FROM lt WHERE box_left >= 0""",
    "k24_samples": f"""WITH {LETTERS}, s AS (SELECT *, max(box_left + wid) OVER p AS w, max(box_top + hei) OVER p AS h FROM lt WHERE box_left >= 0 AND letter IS NOT NULL AND letter <> '' WINDOW p AS (PARTITION BY sample_id)), k AS (SELECT *, 48.0::DOUBLE / h AS k FROM s)
      SELECT sample_id, concat_ws(' ', CAST(CAST(floor(any_value(w) * any_value(k)) AS INTEGER) AS VARCHAR), '48', CAST(sample_id AS VARCHAR) || '.jpg', string_agg(letter, '' ORDER BY letter_no),
        string_agg(concat_ws(',', CAST(CAST(floor(box_left * k) AS INTEGER) AS VARCHAR), CAST(CAST(floor(box_top * k) AS INTEGER) AS VARCHAR), CAST(CAST(floor((box_left + wid) * k) AS INTEGER) AS VARCHAR), CAST(CAST(floor((box_top + hei) * k) AS INTEGER) AS VARCHAR)), ',' ORDER BY letter_no)) AS "row"
      FROM k GROUP BY sample_id""",
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)

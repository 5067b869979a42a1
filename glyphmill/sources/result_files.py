"""Text files of recognition results: tab-separated rows of boxes and texts, read and written."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.operators.arrow_map import append_columns

LINE = ["page_id", "line_id"]


def image_files(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """path, length and content of .jpg and .png files whose name has five characters or more and no dot in front."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("name", name).filter("name RLIKE '\\\\.(jpg|png)$' AND NOT startswith(name, '.') AND length(name) >= 5").select("path", "name", "length", "content")


def detected_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows of six whole numbers (left right top bottom black blocks); malformed rows and rows with a negative number are dropped.

    Corners are inclusive, so the extents are one more than their difference.
    """
    schema = "x0 int, x1 int, y0 int, y1 int, is_black_wd int, n_blocks int"
    rows = spark.read.schema(schema).option("sep", "\t").option("mode", "DROPMALFORMED").csv(path).withColumn("file", F.input_file_name())
    rows = rows.filter("least(x0, x1, y0, y1, is_black_wd, n_blocks) >= 0 AND n_blocks IS NOT NULL")
    return rows.select(
        "file", F.col("x0").alias("box_left"), F.col("y0").alias("box_top"), (F.col("x1") - F.col("x0") + 1).alias("wid"), (F.col("y1") - F.col("y0") + 1).alias("hei"), "is_black_wd", "n_blocks"
    )


def word_rects(spark: SparkSession, path: str) -> DataFrame:
    """Each text row is a line of repeated groups left, top, wid, hei; an incomplete last group is dropped."""
    rows = spark.read.text(path).withColumn("file", F.input_file_name())
    numbers = F.filter(F.transform(F.split("value", "\\s+"), lambda x: F.try_to_number(x, F.lit("S999999999")).cast("int")), lambda x: x.isNotNull())
    rows = rows.withColumn("line_key", F.monotonically_increasing_id()).withColumn("n", numbers).filter("size(n) >= 4")
    at = F.sequence(F.lit(0), (F.size("n") / 4).cast("int") - 1)
    groups = F.transform(at, lambda i: F.struct(*[F.element_at("n", i * 4 + k).alias(c) for k, c in enumerate(("box_left", "box_top", "wid", "hei"), 1)]))
    return rows.select("file", "line_key", F.posexplode(groups).alias("word_id", "g")).select("file", "line_key", "word_id", "g.*")


def word_results(spark: SparkSession, path: str, with_line: bool = False) -> DataFrame:
    """Rows ``left top wid hei text``, with a line index in front if ``with_line``; texts have no blanks."""
    names = (["line_id"] if with_line else []) + ["box_left", "box_top", "wid", "hei"]
    parts = F.filter(F.split("value", "\\s+"), lambda x: x != "")
    rows = spark.read.text(path).select(F.input_file_name().alias("file"), parts.alias("p")).filter(F.size("p") > len(names))
    out = rows.select("file", *[F.try_element_at("p", F.lit(i + 1)).try_cast("int").alias(n) for i, n in enumerate(names)], F.element_at("p", len(names) + 1).alias("word_str"))
    return out.dropna(subset=names)


def result_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of result files split at tabs: file, row and fields."""
    return spark.read.text(path).select(F.input_file_name().alias("file"), F.split("value", "\t").alias("fields"))


def label_table(spark: SparkSession, path: str, fold_width: bool = True) -> DataFrame:
    """Rows ``code index``: full-width codes become half-width ones; the class after the last is the blank and has no row."""
    rows = spark.read.schema("code int, idx int").option("sep", " ").csv(path).dropna()
    if fold_width:
        rows = rows.withColumn("code", F.when((F.col("code") >= 0xFEE0) & (F.col("code") < 0xFF60), F.col("code") - 0xFEE0).otherwise(F.col("code")))
    return rows


def font_coverage(spark: SparkSession, path: str) -> DataFrame:
    """The fourth tab-separated field of each row, as a flag."""
    parts = F.split("value", "\t")
    return spark.read.text(path).select(F.try_element_at(parts, F.lit(1)).alias("font"), F.try_element_at(parts, F.lit(4)).try_cast("int").alias("flag")).filter("flag IS NOT NULL")


def training_list(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``w h path label,label,...``; rows without four fields or with a negative size are dropped."""
    parts = F.filter(F.split("value", " "), lambda x: x != "")
    rows = spark.read.text(path).select(parts.alias("p")).filter("size(p) = 4")
    rows = rows.select(F.col("p")[0].try_cast("int").alias("wid"), F.col("p")[1].try_cast("int").alias("hei"), F.col("p")[2].alias("path"), F.split(F.col("p")[3], ",").cast("array<int>").alias("labels"))
    return rows.filter("wid >= 0 AND hei >= 0")


def invalid_training_rows(rows: DataFrame, classes: int = 97) -> DataFrame:
    """Rows of a training list with a label outside 0 ... classes - 1."""
    return rows.filter(F.exists("labels", lambda x: (x < 0) | (x >= classes)))


def read_config(path: str, section: str) -> dict[str, str]:
    """Keys and values of one section of an INI file; a section is found by a part of its name."""
    out: dict[str, str] = {}
    inside = False
    with open(path, encoding="utf-8") as f:
        for row in f:
            row = row.strip()
            if row.startswith("["):
                inside = section in row
            elif inside and "=" in row and not row.startswith(("#", ";")):
                key, value = row.split("=", 1)
                out[key.strip()] = value.strip()
    return out


#: The settings of the sample generator, as its JSON file holds them (member names and their spelling are fixed values).
GENERATOR_SETTINGS = """struct<backgrand: struct<no_backgrand: struct<probility: double>, foreground_background: struct<probility: double, list: string>,
  fusion: struct<probility: double, list: string, a: double, b: double, c: double>>,
  rotation: double, Gaussian_blur_kernal_size: int, resize_rate: double, pepper_noise: double, shift: int>"""


def generator_settings(spark: SparkSession, path: str) -> DataFrame:
    """(file, settings, fault): the JSON settings of the generator, typed; ``fault`` names what is missing, null if nothing is.

    Files that are no JSON, or whose background settings are absent or no object, have a
    fault and null settings; members of another type are null.
    """
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    tree = F.try_parse_json("value")
    part = F.try_variant_get(tree, "$.backgrand", "variant")
    kind = F.schema_of_variant(part)
    fault = F.when(tree.isNull(), "no JSON").when(part.isNull(), "no background settings").when(~F.startswith(kind, F.lit("OBJECT")), "background settings are no object")
    rows = rows.withColumn("fault", fault)
    return rows.select("file", F.when(F.col("fault").isNull(), F.from_json("value", GENERATOR_SETTINGS)).alias("settings"), "fault")


def line_list(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): the entries of plain lists, such as fonts, backgrounds or a corpus; empty lines are none."""
    return spark.read.text(path).select(F.input_file_name().alias("file"), F.trim("value").alias("value")).filter("value <> ''")


# --- writing ---------------------------------------------------------------------------------


def _box(*extra: Column) -> Column:
    return F.concat_ws("\t", *[F.col(c).cast("string") for c in ("box_left", "box_top", "wid", "hei")], *extra)


def result_text(lines: DataFrame, words: DataFrame, probability: bool = False) -> DataFrame:
    """(page_id, row_no, value): the rows of a page's result file.

    Without ``probability`` a row holds a line and behind it the groups of its
    words; with it, the line has a row and each word another, its probability with
    four decimals. Lines without text are left out. Row 0 is the header (name, width, height).
    """
    shown = lines.filter("line_str IS NOT NULL AND line_str <> ''")
    header = lines.groupBy("page_id").agg(F.max("img_w").alias("w"), F.max("img_h").alias("h")).select(
        "page_id", F.lit(-1).alias("line_id"), F.lit(-1).alias("at"), F.concat_ws("\t", "page_id", F.col("w").cast("string"), F.col("h").cast("string"), F.lit("")).alias("value")
    )
    if probability:
        head = shown.select("page_id", "line_id", F.lit(-1).alias("at"), F.concat(_box(F.col("line_str")), F.lit("\t")).alias("value"))
        tail = words.join(shown.select(*LINE), LINE, "left_semi").select(
            "page_id", "line_id", F.col("word_id").alias("at"), F.concat(_box(F.col("word_str"), F.format_string("%.4f", F.coalesce("prob", F.lit(0.0)))), F.lit("\t")).alias("value")
        )
        rows = header.unionByName(head).unionByName(tail)
    else:
        cells = F.array_sort(F.collect_list(F.struct("word_id", _box(F.col("word_str")).alias("g"))))
        groups = words.groupBy(*LINE).agg(F.array_join(F.transform(cells, lambda x: x["g"]), "\t").alias("groups"))
        body = shown.join(groups, LINE, "left").select(
            "page_id", "line_id", F.lit(0).alias("at"), F.concat(F.concat_ws("\t", _box(F.col("line_str")), "groups"), F.lit("\t")).alias("value")
        )
        rows = header.unionByName(body)

    w = Window.partitionBy("page_id").orderBy("line_id", "at")
    return rows.select("page_id", (F.row_number().over(w) - 1).alias("row_no"), "value")


def write_results(rows: DataFrame, path: str) -> None:
    """One folder of text for each page, its rows in order."""
    out = rows.repartition("page_id").sortWithinPartitions("page_id", "row_no").select("page_id", "value")
    out.write.mode("overwrite").partitionBy("page_id").text(path)


def whole_line(words: DataFrame) -> DataFrame:
    """Words of a line joined with blanks; empty words are left out, and a lone ``i`` unless it is the first."""
    cells = F.array_sort(F.collect_list(F.struct("word_id", F.coalesce("word_str", F.lit("")).alias("t"))))
    kept = F.filter(F.transform(cells, lambda x: x["t"]), lambda t, i: (t != "") & ((t != "i") | (i == 0)))
    return words.groupBy(*LINE).agg(F.array_join(kept, " ").alias("whole"))


def encoded(df: DataFrame, text: str, out: str, codec: str = "gbk") -> DataFrame:
    """``df`` with ``out``, the bytes of ``text`` in a legacy encoding; characters it lacks become '?'."""
    added = T.StructType([T.StructField(out, T.BinaryType())])

    def make():
        def compute(batch):
            values = batch.column(batch.schema.get_field_index(text)).to_pylist()
            return [pa.array([None if v is None else v.encode(codec, "replace") for v in values], pa.binary())]

        return compute

    return append_columns(df, added, make)


def decoded(df: DataFrame, data: str, out: str, codec: str = "gbk") -> DataFrame:
    """``df`` with ``out``, the text of bytes in a legacy encoding."""
    added = T.StructType([T.StructField(out, T.StringType())])

    def make():
        def compute(batch):
            values = batch.column(batch.schema.get_field_index(data)).to_pylist()
            return [pa.array([None if v is None else v.decode(codec, "replace") for v in values], pa.string())]

        return compute

    return append_columns(df, added, make)


def truth_rows(rows: DataFrame, value: str = "value") -> DataFrame:
    """Rows ``l t w h label text`` as eight corners, ``#``, ``1``, the text, the box and the text; other counts get an empty text."""
    p = F.filter(F.split(value, "\\s+"), lambda x: x != "")
    n = [F.try_element_at(p, F.lit(i)).try_cast("int") for i in (1, 2, 3, 4)]
    left, top, right, low = n[0], n[1], n[0] + n[2], n[1] + n[3]
    text = F.when(F.size(p) == 6, F.element_at(p, 6)).otherwise(F.lit(""))
    cells = [left, top, right, top, right, low, left, low]
    out = F.concat(F.concat_ws("\t", *[c.cast("string") for c in cells], F.lit("#"), F.lit("1"), text, *[c.cast("string") for c in n], text), F.lit("\t"))
    return rows.filter(n[3].isNotNull()).select(out.alias("row"))


def candidate_text(words: DataFrame, candidates: DataFrame, probability: bool = False) -> DataFrame:
    """(page_id, line_id, value): each word's group followed by the groups of its candidates, in order.

    With ``probability`` a word's group carries its probability with three decimals
    and the line's text holds the candidates, too, as menus are written.
    """
    keys = [*LINE, "word_id"]
    cand = F.array_sort(F.collect_list(F.struct("cand_id", F.col("text"))))
    sets = candidates.groupBy(*keys).agg(F.transform(cand, lambda c: c["text"]).alias("cands"))
    rows = words.join(sets, keys, "left").withColumn("cands", F.coalesce("cands", F.array().cast("array<string>")))
    more = [F.format_string("%.3f", F.coalesce("prob", F.lit(0.0)))] if probability else []
    group = F.concat_ws("\t", _box(F.col("word_str"), *more), F.array_join("cands", "\t"))
    shown = F.concat(F.coalesce("word_str", F.lit("")), F.array_join("cands", "")) if probability else F.coalesce("word_str", F.lit(""))
    cells = F.array_sort(F.collect_list(F.struct("word_id", group.alias("g"), shown.alias("t"))))
    out = rows.groupBy(*LINE).agg(F.transform(cells, lambda c: c["t"]).alias("t"), F.transform(cells, lambda c: c["g"]).alias("g"))
    return out.select(*LINE, F.concat(F.array_join("t", ""), F.lit("\t"), F.array_join("g", "\t"), F.lit("\t")).alias("value"))


def write_windows(boxes: DataFrame, path: str) -> None:
    """Writes the word boxes of lines, one row each: line, left, top, width and height, each followed by a tab."""
    row = F.concat(F.concat_ws("\t", *[F.col(c).cast("string") for c in ("line_id", "box_left", "box_top", "wid", "hei")]), F.lit("\t"))
    boxes.sortWithinPartitions("line_id", "box_left").select(row.alias("value")).write.mode("overwrite").text(path)


def batch_text(lines: DataFrame) -> DataFrame:
    """(value): rows of many images for one file, the image's name in front."""
    return lines.filter("line_str IS NOT NULL AND line_str <> ''").select(F.concat(F.concat_ws("\t", "page_id", _box(F.col("line_str"))), F.lit("\t")).alias("value"))


def estimation_words(words: DataFrame) -> DataFrame:
    """Words for an estimate of a language model, without the mark of a failed word."""
    return words.filter("word_str IS NOT NULL AND word_str <> '<!>'").select("page_id", "line_id", "word_id", "word_str")


CONFIG_KINDS = {"int": int, "double": float}


def typed_config(values: dict[str, str], registry: dict[str, tuple[str, float, float, float]]) -> dict[str, float]:
    """Settings by a registry of (kind, least, greatest, default): what is missing, malformed or out of range gets its default."""
    out = {}
    for key, (kind, low, high, default) in registry.items():
        try:
            value = CONFIG_KINDS[kind](values[key])
        except (KeyError, ValueError):
            value = default
        out[key] = value if low <= value <= high else default
    return out


def request_json(images: DataFrame, service: str, detect: str = "LocateRecognize", language: str = "CHN_ENG") -> DataFrame:
    """(name, request): the JSON envelope of a request for each image; nothing is sent."""
    body = F.concat_ws("&", F.lit(f"type={service}"), F.lit(f"detecttype={detect}"), F.lit(f"languagetype={language}"), F.concat(F.lit("image="), F.translate(F.base64("content"), "\r\n", "")))
    return images.select("name", F.to_json(F.struct(F.lit(service).alias("provider"), F.translate(F.base64(F.encode(body, "UTF-8")), "\r\n", "").alias("data"))).alias("request"))

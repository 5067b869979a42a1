"""Recognition results as nested JSON, in the shapes of the service's answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rect(prefix: str = "", as_text: bool = False) -> Column:
    parts = [F.col(prefix + c).cast("string") for c in ("box_left", "box_top", "wid", "hei")]
    if as_text:
        return F.concat_ws(" ", *parts)
    return F.struct(*[p.alias(n) for p, n in zip(parts, ("left", "top", "width", "height"))])


def _polygon() -> Column:
    """Points of a polygon of at least four corners and an even count of numbers, else null."""
    at = F.sequence(F.lit(0), (F.size("poly") / 2 - 1).cast("int"))
    points = F.transform(at, lambda i: F.struct(F.element_at("poly", i * 2 + 1).cast("string").alias("x"), F.element_at("poly", i * 2 + 2).cast("string").alias("y")))
    return F.when((F.size("poly") >= 8) & (F.size("poly") % 2 == 0), F.struct(points.alias("points")))


def page_results(lines: DataFrame, chars: DataFrame | None = None, polygons: bool = False, rect_text: bool = False, words: bool = True) -> DataFrame:
    """(page_id, ret): the lines of each page as an array of items.

    Whole numbers are written as strings. With ``chars`` each item has its charset;
    with ``rect_text`` a rect is one string; without ``words`` only boxes are given.
    """
    members = [_rect(as_text=rect_text).alias("rect")]
    if words:
        members.append(F.coalesce("line_str", F.lit("")).alias("word"))
    if polygons:
        members.append(_polygon().alias("poly_location"))
    rows = lines
    if chars is not None:
        cells = F.array_sort(F.collect_list(F.struct("word_id", "char_id", _rect().alias("rect"), F.coalesce("char_str", F.lit("")).alias("word"))))
        sets = chars.groupBy("page_id", "line_id").agg(F.transform(cells, lambda c: F.struct(c["rect"].alias("rect"), c["word"].alias("word"))).alias("charset"))
        rows = rows.join(sets, ["page_id", "line_id"], "left")
        members.append(F.coalesce("charset", F.array().cast(sets.schema["charset"].dataType)).alias("charset"))
    items = rows.select("page_id", "line_id", F.struct(*members).alias("item"))
    return items.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_id", F.to_json("item").alias("j")))), lambda x: x["j"]).alias("ret"))


def envelope(results: DataFrame, errno: int = 0, message: str = "", sign: Column | None = None, encoded: bool = False, direction: Column | None = None) -> DataFrame:
    """(page_id, result): the answer around the items, errno first; in base64 with ``encoded``.

    ``direction`` puts {"imgdir": ...} in front of the items.
    """
    items = F.array_join("ret", ",")
    if direction is not None:
        first = F.concat(F.lit('{"imgdir":"'), direction.cast("string"), F.lit('"}'))
        items = F.concat(first, F.when(F.size("ret") > 0, F.concat(F.lit(","), items)).otherwise(F.lit("")))
    head = F.to_json(F.struct(F.lit(str(errno)).alias("errno"), F.lit(message).alias("errmas"), (sign if sign is not None else F.lit("")).alias("querysign")))
    text = F.concat(F.expr("substring(h, 1, length(h) - 1)"), F.lit(',"ret":['), items, F.lit("]}"))
    out = results.withColumn("h", head).select("page_id", text.alias("result"))
    # Spark breaks base64 into rows of 76 characters, the format has none
    return out.withColumn("result", F.translate(F.base64(F.encode("result", "UTF-8")), "\r\n", "")) if encoded else out


def error_answer(errno: Column, message: Column) -> Column:
    """The answer to a failed request."""
    return F.to_json(F.struct(errno.cast("string").alias("errno"), F.coalesce(message, F.lit("")).alias("errmas"), F.lit("").alias("querysign")))


def single_characters(words: DataFrame) -> DataFrame:
    """(page_id, line_id, result): words of a line as a flat array of text and probability."""
    cells = F.array_sort(F.collect_list(F.struct("word_id", "word_str", F.format_string("%.4f", F.coalesce("prob", F.lit(0.0))).alias("prob"))))
    items = F.transform(cells, lambda c: F.struct(c["word_str"].alias("word"), c["prob"].alias("prob")))
    return words.groupBy("page_id", "line_id").agg(F.to_json(F.struct(items.alias("ret"))).alias("result"))


def spam_report(accounts: DataFrame, keywords: DataFrame) -> DataFrame:
    """(page_id, result): accounts by kind and keywords by category of each page."""
    a = accounts.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("kind", "value"))).alias("accounts"))
    k = keywords.groupBy("page_id").agg(F.array_sort(F.collect_set(F.struct("category", "keyword"))).alias("vocabulary"))
    return a.join(k, "page_id", "full").select("page_id", F.to_json(F.struct("accounts", "vocabulary")).alias("result"))


def keyword_pairs(found: DataFrame, rules: DataFrame) -> DataFrame:
    """Pairs of keywords of a page that a rule (first, second) names: ``first&second``, once each."""
    second = found.select("page_id", F.col("keyword").alias("second"))
    pairs = found.select("page_id", F.col("keyword").alias("first")).join(rules, "first").join(second, ["page_id", "second"])
    return pairs.select("page_id", F.concat_ws("&", "first", "second").alias("pair")).distinct()


def answer_for(detect: str, service: str, pdf: bool = False) -> str:
    """Which of the answers a request asks for: pdf, boxes, rect_text, characters or lines."""
    if pdf:
        return "pdf"
    if detect == "Locate":
        return "boxes"
    if detect not in ("LocateRecognize", "Recognize", ""):
        raise ValueError(f"unknown detect type {detect}")
    return {"st_ocrapi": "lines", "st_ocrapi_all": "characters"}.get(service, "lines")


def answers(lines: DataFrame, chars: DataFrame, detect: str, service: str) -> DataFrame:
    """(page_id, result) in the form that :func:`answer_for` names."""
    form = answer_for(detect, service)
    if form == "boxes":
        return envelope(page_results(lines, words=False))
    return envelope(page_results(lines, chars if form == "characters" else None, polygons=form == "lines"))

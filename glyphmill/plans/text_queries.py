"""Queries on scalar text functions and extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import extract, text
from glyphmill.plans.base import KEY, LETTERS, LINES, WORDS, letters, lines, words
from glyphmill.sources.tables import table


def x_code_points(spark: SparkSession, folder: str) -> DataFrame:
    rows = letters(spark, folder).filter("letter IS NOT NULL")
    return rows.select("sample_id", "letter_no", text.code_points(F.col("letter")).alias("points"))


def x_widths(spark: SparkSession, folder: str) -> DataFrame:
    w = F.col("word_str")
    return words(spark, folder, "word_str").select(*KEY, text.to_full_width(w).alias("full_width"), text.to_half_width(w).alias("half_width"), text.charset_filter(w).alias("kept"))


def x_classes(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("letter")
    return letters(spark, folder).filter("letter IS NOT NULL AND letter <> ''").select(
        "sample_id", "letter_no", text.is_chinese(c).alias("chinese"), text.is_chinese_punctuation(c).alias("zh_punct"),
        text.is_european_punctuation(c).alias("euro_punct"), text.is_not_alphanumeric(c).alias("not_alnum"), text.char_class(c).alias("char_class"),
        text.letter_case(c).alias("letter_case"),
    )


def x_case(spark: SparkSession, folder: str) -> DataFrame:
    w = F.col("word_str")
    return words(spark, folder, "word_str").select(*KEY, text.lower_european(w).alias("low"), text.upper_european(w).alias("high"), text.capitalised(w).alias("capital"))


def x_high_low(spark: SparkSession, folder: str) -> DataFrame:
    """Case by recognised kind; a line whose words are upper for more than 0.7 is upper as a whole."""
    rows = words(spark, folder, "word_str").filter("word_str RLIKE '^[ -~]*$'")
    kind = F.when(F.col("word_str").rlike("^[A-Z][A-Z]+"), 2).when(F.col("word_str").rlike("^[A-Z]"), 1).otherwise(0)
    rows = rows.withColumn("kind", kind)
    share = rows.groupBy("page_id", "line_id").agg(F.avg((F.col("kind") == 2).cast("double")).alias("share"))
    out = text.high_low(F.col("word_str"), F.when(F.col("share") > 0.7, 2).otherwise(F.col("kind")))
    return rows.join(share, ["page_id", "line_id"]).select(*KEY, out.alias("shown"))


def x_quotes(spark: SparkSession, folder: str) -> DataFrame:
    w = F.col("word_str")
    bare, at = text.without_quote(w), text.quote_position(w)
    return words(spark, folder, "word_str").select(*KEY, text.without_spaces(w).alias("no_space"), bare.alias("bare"), at.alias("quote_at"), text.with_quote(bare, at).alias("back"))


def x_split(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "scan_pages").select("page_id", "img_name").distinct()
    return rows.select("page_id", text.split_keep_inner(F.col("img_name"), "/").alias("parts"))


def x_edit_distance(spark: SparkSession, folder: str) -> DataFrame:
    """Distance of each ASCII word to the lexicon words of its first letter and length."""
    lexicon = table(spark, folder, "lexicon").filter("lang = 'en' AND word RLIKE '^[ -~]*$'").select(F.lower("word").alias("word")).distinct()
    seen = words(spark, folder, "word_str").filter("word_str RLIKE '^[a-z]+$'").select(F.col("word_str").alias("seen")).distinct()
    same = (F.left("seen", F.lit(1)) == F.left("word", F.lit(1))) & (F.length("seen") == F.length("word"))
    return seen.join(lexicon, same).select("seen", "word", F.levenshtein("seen", "word").alias("distance"))


def x35_path_text(spark: SparkSession, folder: str) -> DataFrame:
    """Class ids of ASCII letters back to text by a label table."""
    rows = words(spark, folder, "word_str").filter("word_str RLIKE '^[!-~]+$'")
    labels = F.array(*[F.lit(chr(c)) for c in range(33, 127)])
    path = F.transform(text.code_points(F.col("word_str")), lambda c: c - 33)
    return rows.select(*KEY, text.text_of_path(path, labels).alias("read"))


def e_accounts(spark: SparkSession, folder: str) -> DataFrame:
    """The first web address, mail address or telephone number of each line and document."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text"))
    rows = lines(spark, folder, "line_str").select(F.concat_ws("/", "page_id", F.col("line_id").cast("string")).alias("id"), F.col("line_str").alias("text"))
    names = table(spark, folder, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.concat(F.lit("see http://www.a-b.com/"), "c_name", F.lit("?x=1 or call 13912345678")).alias("text"))
    mails = table(spark, folder, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.concat(F.lit("to "), F.col("s_suppkey").cast("string"), F.lit("_x@mail.example.org, 15800001111")).alias("text"))
    everything = docs.unionByName(rows).unionByName(names).unionByName(mails)
    found = everything.withColumn("account", extract.account(F.col("text"))).filter("account IS NOT NULL")
    return found.select("id", "account.kind", "account.value")


def e_keywords(spark: SparkSession, folder: str) -> DataFrame:
    """Lexicon words of six letters or more that a page holds, by category (language), once each."""
    pages = lines(spark, folder, "line_str").filter("line_str IS NOT NULL").select("page_id", F.explode(F.split(F.lower("line_str"), "[^a-zà-ÿа-яё]+")).alias("token"))
    lexicon = table(spark, folder, "lexicon").filter("length(word) >= 6").select(F.lower("word").alias("token"), F.col("lang").alias("category"))
    return pages.join(lexicon, "token").select("page_id", "category", F.col("token").alias("keyword")).distinct()


def e6_locations(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of a page from the middle outwards, their boxes shifted a little by their size."""
    rows = lines(spark, folder)
    count = rows.groupBy("page_id").agg(F.count("*").cast("int").alias("n"))
    rows = rows.join(count, "page_id")
    middle = (F.col("n") / 2).cast("int")
    shift = (F.lit(0.3) * ((F.col("hei") + F.col("wid")) % 10) / F.lit(10.0) * F.least("hei", "wid")).cast("int")
    return rows.select(
        "page_id", "line_id", F.abs(F.col("line_id") - middle).alias("distance"), (F.col("box_left") + shift).alias("x"), (F.col("box_top") + shift).alias("y")
    )


QUERIES = {f.__name__: f for f in (x_code_points, x_widths, x_classes, x_case, x_high_low, x_quotes, x_split, x_edit_distance, x35_path_text, e_accounts, e_keywords, e6_locations)}

_PUNCT = ", ".join(map(str, text.CHINESE_PUNCTUATION))
_EURO = " OR ".join(f"unicode(letter) BETWEEN {a} AND {b}" for a, b in text.EUROPEAN_PUNCTUATION)


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _account(column: str) -> str:
    def grab(pattern: str) -> str:
        return f"regexp_extract({column}, {_lit(pattern)}, 0)"

    return (
        f"CASE WHEN {grab(extract.URL)} <> '' THEN 'url' WHEN {grab(extract.EMAIL)} <> '' THEN 'email' WHEN {grab(extract.TELEPHONE)} <> '' THEN 'telephone' END AS kind, "
        f"CASE WHEN {grab(extract.URL)} <> '' THEN {grab(extract.URL)} WHEN {grab(extract.EMAIL)} <> '' THEN {grab(extract.EMAIL)} "
        f"WHEN {grab(extract.TELEPHONE)} <> '' THEN {grab(extract.TELEPHONE)} END AS value"
    )


ORACLE = {
    "x_code_points": f"WITH {LETTERS} SELECT sample_id, letter_no, list_transform(list_filter(regexp_extract_all(letter, '.', 0, 's'), lambda c: c <> ''), lambda c: unicode(c)) AS points FROM lt WHERE letter IS NOT NULL",
    "x_widths": f"WITH {WORDS} SELECT page_id, line_id, word_id, translate(word_str, {_lit(text._ASCII)}, {_lit(text._FULL)}) AS full_width, "
    f"translate(word_str, {_lit(text._HALF_FROM)}, {_lit(text._HALF_TO)}) AS half_width, regexp_replace(word_str, '[^\\x{{4E00}}-\\x{{9FA5}}0-9A-Za-z]', '', 'g') AS kept FROM w",
    "x_classes": f"""WITH {LETTERS}, c AS (SELECT *, CASE WHEN unicode(letter) >= 65248 AND unicode(letter) < 65376 THEN unicode(letter) - 65248 ELSE unicode(letter) END AS k FROM lt WHERE letter IS NOT NULL AND letter <> '')
      SELECT sample_id, letter_no, unicode(letter) BETWEEN 19968 AND 40891 AS chinese,
             (k BETWEEN 32 AND 47 OR k BETWEEN 58 AND 64 OR k BETWEEN 91 AND 96 OR k BETWEEN 123 AND 126 OR k IN ({_PUNCT})) AS zh_punct, ({_EURO}) AS euro_punct,
             NOT regexp_matches(letter, '^[A-Za-z0-9]') AS not_alnum,
             CASE WHEN regexp_matches(letter, '^[0-9]') THEN 1 WHEN regexp_matches(letter, '^[A-Za-z]') THEN 2 ELSE 3 END AS char_class,
             CASE WHEN regexp_extract(letter, '[A-Za-z]', 0) = '' THEN NULL WHEN regexp_extract(letter, '[A-Za-z]', 0) = upper(regexp_extract(letter, '[A-Za-z]', 0)) THEN 'upper' ELSE 'lower' END AS letter_case FROM c""",
    "x_case": f"""WITH {WORDS} SELECT page_id, line_id, word_id, translate(word_str, {_lit(text._UPPER)}, {_lit(text._LOWER)}) AS low, translate(word_str, {_lit(text._LOWER)}, {_lit(text._UPPER)}) AS high,
      translate(substring(word_str, 1, 1), {_lit(text._LOWER)}, {_lit(text._UPPER)}) || substring(word_str, 2) AS capital FROM w""",
    "x_high_low": f"""WITH {WORDS}, k AS (SELECT *, CASE WHEN regexp_matches(word_str, '^[A-Z][A-Z]+') THEN 2 WHEN regexp_matches(word_str, '^[A-Z]') THEN 1 ELSE 0 END AS kind FROM w WHERE regexp_matches(word_str, '^[ -~]*$')),
      s AS (SELECT *, avg(CASE WHEN kind = 2 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY page_id, line_id) AS share FROM k), t AS (SELECT *, CASE WHEN share > 0.7 THEN 2 ELSE kind END AS kk FROM s)
      SELECT page_id, line_id, word_id, CASE WHEN kk = 2 THEN upper(word_str) WHEN kk = 1 THEN upper(substring(lower(word_str), 1, 1)) || substring(lower(word_str), 2) ELSE lower(word_str) END AS shown FROM t""",
    "x_quotes": f"""WITH {WORDS}, q AS (SELECT *, length(word_str) - length(replace(word_str, '''', '')) AS n FROM w), p AS (SELECT *, CASE WHEN n = 1 THEN CAST(instr(word_str, '''') AS INTEGER) - 1 ELSE -1 END AS quote_at,
      CASE WHEN n = 1 THEN replace(word_str, '''', '') ELSE word_str END AS bare FROM q)
      SELECT page_id, line_id, word_id, replace(word_str, ' ', '') AS no_space, bare, quote_at, CASE WHEN quote_at >= 1 THEN left(bare, quote_at) || '''' || substring(bare, quote_at + 1) ELSE bare END AS back FROM p""",
    "x_split": "SELECT DISTINCT page_id, CASE WHEN img_name LIKE '%/' THEN string_split(img_name, '/')[:-2] ELSE string_split(img_name, '/') END AS parts FROM scan_pages",
    "x_edit_distance": f"""WITH {WORDS}, l AS (SELECT DISTINCT lower(word) AS word FROM lexicon WHERE lang = 'en' AND regexp_matches(word, '^[ -~]*$')), s AS (SELECT DISTINCT word_str AS seen FROM w WHERE regexp_matches(word_str, '^[a-z]+$'))
      SELECT seen, word, CAST(levenshtein(seen, word) AS INTEGER) AS distance FROM s JOIN l ON left(seen, 1) = left(word, 1) AND length(seen) = length(word)""",
    "x35_path_text": f"WITH {WORDS} SELECT page_id, line_id, word_id, word_str AS read FROM w WHERE regexp_matches(word_str, '^[!-~]+$')",
    "e_accounts": f"""WITH {LINES}, t AS (SELECT CAST(doc_id AS VARCHAR) AS id, text FROM documents UNION ALL SELECT page_id || '/' || CAST(line_id AS VARCHAR), line_str FROM ln
      UNION ALL SELECT 'c' || CAST(c_custkey AS VARCHAR), 'see http://www.a-b.com/' || c_name || '?x=1 or call 13912345678' FROM customer
      UNION ALL SELECT 's' || CAST(s_suppkey AS VARCHAR), 'to ' || CAST(s_suppkey AS VARCHAR) || '_x@mail.example.org, 15800001111' FROM supplier),
      a AS (SELECT id, {_account("text")} FROM t) SELECT id, kind, value FROM a WHERE kind IS NOT NULL""",
    "e_keywords": f"""WITH {LINES}, t AS (SELECT page_id, unnest(regexp_split_to_array(lower(line_str), '[^a-zà-ÿа-яё]+')) AS token FROM ln WHERE line_str IS NOT NULL)
      SELECT DISTINCT t.page_id, x.lang AS category, t.token AS keyword FROM t JOIN lexicon x ON lower(x.word) = t.token AND length(x.word) >= 6""",
    "e6_locations": f"""WITH {LINES}, c AS (SELECT *, CAST(count(*) OVER (PARTITION BY page_id) AS INTEGER) AS n FROM ln), s AS (SELECT *, CAST(trunc(CAST(0.3 AS DOUBLE) * ((hei + wid) % 10) / CAST(10 AS DOUBLE) * least(hei, wid)) AS INTEGER) AS shift FROM c)
      SELECT page_id, line_id, abs(line_id - n // 2) AS distance, box_left + shift AS x, box_top + shift AS y FROM s""",
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)

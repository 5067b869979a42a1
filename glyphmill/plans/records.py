"""Queries of problems 4 and 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.operators import nested
from glyphmill.operators.parse_rows import WORD_FIELDS, parse_responses, parse_word_rows, read_dumps
from glyphmill.plans import records_sql
from glyphmill.sources.tables import table

#: The members of a service result that are lists by its format, from the outside in, and the names of their positions.
RESULT_PATH = ("ret", "charset", "candidate")
RESULT_ORDINALS = ["ret_no", "char_no", "cand_no"]


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = parse_word_rows(table(spark, folder, "word_rows").select("row_id", "raw"))
    rows = rows.filter(F.col("reason").isNotNull()).select(F.lit("word_rows").alias("src"), F.col("row_id").alias("rec_id"), "reason")
    answers = parse_responses(table(spark, folder, "responses").select("response_id", "result", "result_type"))
    answers = answers.filter(F.col("reason").isNotNull()).select(F.lit("responses").alias("src"), F.col("response_id").alias("rec_id"), "reason")
    return rows.unionByName(answers).distinct()


def p4_word_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The valid word records, typed."""
    rows = table(spark, folder, "word_rows").select("row_id", "raw").distinct()
    parsed = parse_word_rows(rows).filter(F.col("reason").isNull())
    return parsed.select("row_id", *[F.col(f"word.{n}").alias(n) for n in WORD_FIELDS])


def p4_faults(spark: SparkSession, folder: str) -> DataFrame:
    """Where each failing record fails: offset in code points and what was wrong."""
    rows = parse_word_rows(table(spark, folder, "word_rows").select("row_id", "raw"))
    answers = parse_responses(table(spark, folder, "responses").select("response_id", "result", "result_type"))
    both = [
        rows.select(F.lit("word_rows").alias("src"), F.col("row_id").alias("rec_id"), "reason", "fault_at", "fault"),
        answers.select(F.lit("responses").alias("src"), F.col("response_id").alias("rec_id"), "reason", "fault_at", "fault"),
    ]
    return both[0].unionByName(both[1]).filter(F.col("reason").isNotNull()).distinct()


def result_records(spark: SparkSession, folder: str) -> DataFrame:
    """``response_id``, ``record`` (a key that is never null) and the JSON text of each valid result, repeats once."""
    answers = table(spark, folder, "responses").select("response_id", "result", "result_type").filter("result IS NOT NULL")
    # repeats are equal in these columns; answers without an id stay apart from each other
    answers = nested.with_key(answers.distinct(), "response_id", "result", "record")
    answers = parse_responses(answers, text="json", quick=True)
    return answers.filter(F.col("json").isNotNull()).select("response_id", "record", "json")


def result_schema(spark: SparkSession, folder: str) -> nested.Node:
    """The merged schema of all valid results: a pass of its own over the answers, which is less than to write their texts."""
    answers = table(spark, folder, "responses").select("result", "result_type").filter("result IS NOT NULL")
    return nested.merged(parse_responses(answers, pairs="pairs", quick=True).filter(F.col("pairs").isNotNull()), "pairs")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Positions of all elements of valid results; answers without an id each give theirs, with a null id."""
    levels = nested.levels_to(result_schema(spark, folder), RESULT_PATH, single=RESULT_PATH)
    if not levels:
        return spark.createDataFrame([], "response_id long, ret_no int, char_no int, cand_no int")
    records = nested.to_variant(result_records(spark, folder), "json", values=False)
    rows = nested.explode_levels(records, "value", levels, RESULT_ORDINALS[: len(levels)])
    ordinals = [(F.col(c) if i < len(levels) else F.lit(-1)).cast(T.IntegerType()).alias(c) for i, c in enumerate(RESULT_ORDINALS)]
    return rows.select("response_id", *ordinals)


def _child(path: tuple[str, ...]):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        texts = result_records(spark, folder)
        schema = result_schema(spark, folder)
        if path and not nested.is_level(schema, path, RESULT_PATH):
            return spark.createDataFrame([], "parent_id string, row_id string, ordinal int")
        records = nested.to_variant(texts, "json")
        if not path:
            return nested.record_table(records, "record", "value", schema, RESULT_PATH)
        return nested.child_table(records, "record", "value", path, schema, RESULT_PATH)

    return query


def queries() -> dict:
    return {
        "p4_found": p4_found,
        "p4_word_rows": p4_word_rows,
        "p4_dump": p4_dump,
        "p4_faults": p4_faults,
        "p4_failing_rows": p4_failing_rows,
        "p5_found": p5_found,
        "p5_records": _child(()),
        "p5_lines": _child(("ret",)),
        "p5_chars": _child(("ret", "charset")),
        "p5_candidates": _child(("ret", "charset", "candidate")),
        "p5_points": _child(("ret", "poly_location", "points")),
        "p5_languages": _child(("image_info", "lang_prob_map")),
        "p5_object_types": _child(("image_info", "detected_obj_type_list")),
    }


_WHOLE = "regexp_full_match({0}, '-?[0-9]+') AND try_cast({0} AS INTEGER) IS NOT NULL"
_FIELDS = """r AS (SELECT DISTINCT row_id, coalesce(raw, '') AS raw FROM word_rows),
  q AS (SELECT row_id, regexp_full_match(raw, '(?:"(?:[^"]|"")*"|[^",\n]*)(?:,(?:"(?:[^"]|"")*"|[^",\n]*))*') AS quoted, regexp_extract_all(',' || raw, ',("(?:[^"]|"")*"|[^",\n]*)', 1) AS parts FROM r),
  f AS (SELECT row_id, quoted, list_transform(parts, lambda x: CASE WHEN left(x, 1) = '"' THEN replace(x[2:-2], '""', '"') ELSE x END) AS f FROM q),
  v AS (SELECT *, CASE WHEN NOT quoted THEN 'quoting' WHEN len(f) <> 9 THEN 'columns' WHEN NOT (""" + " AND ".join(_WHOLE.format(f"f[{i}]") for i in range(2, 8)) + """
    AND try_cast(f[2] AS BIGINT) >= 0 AND try_cast(f[3] AS BIGINT) >= 0 AND try_cast(f[6] AS BIGINT) >= 1 AND try_cast(f[7] AS BIGINT) >= 1 AND f[8] <> ''
    AND (f[9] = '' OR (regexp_full_match(f[9], '-?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?') AND try_cast(f[9] AS DOUBLE) BETWEEN 0 AND 1))) THEN 'value' END AS reason FROM f)"""


def p4_failing_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The failing word records of p4_found, on their own."""
    rows = parse_word_rows(table(spark, folder, "word_rows").select("row_id", "raw")).filter(F.col("reason").isNotNull())
    return rows.select("row_id", "reason").distinct()


def p4_dump(spark: SparkSession, folder: str) -> DataFrame:
    """The valid word records, read from whole dumps in which the grammar finds the record starts itself."""
    records = read_dumps(table(spark, folder, "word_rows")).filter(F.col("reason").isNull())
    return records.select("row_id", *[F.col(f"word.{n}").alias(n) for n in WORD_FIELDS])


def oracle_sql() -> dict[str, str]:
    typed = ", ".join(f"CAST(f[{i}] AS INTEGER) AS {_quoted(n)}" for i, n in enumerate(WORD_FIELDS[1:7], 2))
    valid = f"WITH {_FIELDS} SELECT row_id, f[1] AS page_id, {typed}, f[8] AS text, CASE WHEN f[9] <> '' THEN CAST(f[9] AS DOUBLE) END AS prob FROM v WHERE reason IS NULL"
    failing = "SELECT 'word_rows' AS src, row_id AS rec_id, reason FROM v WHERE reason IS NOT NULL"
    return {
        "p4_failing_rows": f"WITH {_FIELDS} SELECT row_id, reason FROM v WHERE reason IS NOT NULL",
        "p4_found": f"WITH {_FIELDS}, {records_sql.JUDGED} {failing} UNION ALL {records_sql.FAILING_RESPONSES}",
        "p4_word_rows": valid,
        "p4_dump": valid,
        "p5_found": records_sql.FOUND,
        **records_sql.TABLES,
    }


def _quoted(name: str) -> str:
    return f'"{name}"'

"""Tables without repeats, as queries on the reference's operators read them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphmill.sources.tables import table


KEY = ["page_id", "line_id", "word_id"]


def _once(spark: SparkSession, folder: str, name: str, keys: list[str], columns: tuple[str, ...]) -> DataFrame:
    """Repeats have the same values, so the rows are distinct on the keys and any columns; only those are read."""
    df = table(spark, folder, name)
    return (df.select(*dict.fromkeys([*keys, *columns])) if columns else df).distinct()


def words(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Words without repeats: all columns, or the keys and ``columns``."""
    return _once(spark, folder, "words", KEY, columns)


def lines(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return _once(spark, folder, "text_lines", KEY[:2], columns)


def chars(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return _once(spark, folder, "chars", [*KEY, "char_id"], columns)


def letters(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return _once(spark, folder, "letters", ["sample_id", "letter_no"], columns)


#: The same as SQL, to be put before a statement.
WORDS = "w AS (SELECT DISTINCT * FROM words)"
LINES = "ln AS (SELECT DISTINCT * FROM text_lines)"
CHARS = "ch AS (SELECT DISTINCT * FROM chars)"
LETTERS = "lt AS (SELECT DISTINCT * FROM letters)"

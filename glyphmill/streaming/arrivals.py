"""Result files as they arrive. An extension: the reference works on folders alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.operators.parse_rows import parse_responses, parse_word_rows


def arriving(spark: SparkSession, folder: str, schema: str, time: str, late: str = "30 days", files_per_trigger: int = 100) -> DataFrame:
    """A stream of parquet files of a folder, with a watermark on ``time``."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return rows.withWatermark(time, late)


def word_records(rows: DataFrame, key: str = "row_id") -> DataFrame:
    """Word dumps parsed as they come; repeats within the watermark come once."""
    return parse_word_rows(rows.dropDuplicatesWithinWatermark([key]).select(key, "raw", "loaded_at"))


def failures_by_hour(rows: DataFrame) -> DataFrame:
    """How many answers of each hour failed, and why; late answers count until the watermark has passed."""
    parsed = parse_responses(rows.select("response_id", "result", "result_type", "received_at"))
    return parsed.groupBy(F.window("received_at", "1 hour"), F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))

"""glyphmill: batch analytics over recognised-text records, written for Spark.

Sub-packages
    sources    readers and writers (parquet tables, TSV result files, service JSON)
    functions  Column -> Column building blocks
    operators  DataFrame -> DataFrame operators
    plans      named queries with their SQL counterparts
    streaming  file-arrival pipelines
    llm        operators that prepare text for training (optional, nothing else imports it)
"""

__version__ = "0.1.0"

"""File-arrival pipelines, and every registered query against its SQL on the smallest data."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from glyphmill.streaming import arrivals
from tests.conftest import SF_SMALL


def test_streams_run_to_completion(spark, tmp_path):
    source = str(tmp_path / "in")
    os.makedirs(source)
    spark.read.parquet(f"{SF_SMALL}/word_rows.parquet").select("row_id", "raw", "loaded_at").repartition(3).write.mode("overwrite").parquet(source)
    rows = arrivals.arriving(spark, source, "row_id long, raw string, loaded_at timestamp", "loaded_at", "3650 days", 1)
    q = arrivals.word_records(rows).writeStream.outputMode("append").format("memory").queryName("words_in").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT row_id, reason FROM words_in").collect()
    want = spark.read.parquet(source).select("row_id").distinct().count()
    assert len(got) == want == len({r.row_id for r in got})
    answers = str(tmp_path / "answers")
    spark.read.parquet(f"{SF_SMALL}/responses.parquet").select("response_id", "result", "result_type", "received_at").write.parquet(answers)
    rows = arrivals.arriving(spark, answers, "response_id long, result string, result_type string, received_at timestamp", "received_at")
    q = arrivals.failures_by_hour(rows).writeStream.outputMode("complete").format("memory").queryName("failures").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM failures").first()[0] == spark.read.parquet(answers).count()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.8g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF_SMALL):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF_SMALL}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, SF_SMALL)
    columns = sorted(got.columns)
    rows = duck.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in rows.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted((tuple(norm(r[i]) for i in order) for r in rows.fetchall()), key=repr)
    assert sorted((tuple(norm(r[c]) for c in columns) for r in got.collect()), key=repr) == want


def test_every_sql_has_its_query_and_entry_runs(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(__spark_entry__.entry(spark).collect()) == 10


def test_report_has_the_accounts_of_every_line(spark):
    import json

    from glyphmill.plans import operator_queries
    from tests.conftest import SF_SMALL

    rows = operator_queries.k18_report(spark, SF_SMALL).collect()
    n_lines = operator_queries.lines(spark, SF_SMALL).count()  # each has the number that the query puts behind it
    assert sum(len(json.loads(r.result).get("accounts", [])) for r in rows) == n_lines > len(rows)

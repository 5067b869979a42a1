"""Problem 3 against plain counting."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from glyphmill.llm import term_counts

SCHEMA = "rec string, a int, b int, term string, term_count int"


def plain(rows):
    occ, rec = defaultdict(int), defaultdict(set)
    for r, a, b, t, _ in set(rows):
        occ[None] += 1
        rec[None].add(r)
        if t:
            occ[t] += 1
            rec[t].add(r)
    return {t: (occ[t], len(rec[t])) for t in occ}


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    got = term_counts.term_counts(df, "rec", "term", ["a", "b"], **kw).collect()
    assert len({r.term for r in got}) == len(got)
    return {r.term: (r.occurrences, r.records) for r in got}


def test_counts_with_hot_record_hot_term_repeats_and_nulls(spark):
    rng = random.Random(5)
    rows = []
    for i in range(6000):
        rec = "hot" if rng.random() < 0.4 else rng.choice(["", None, *[f"r{k}" for k in range(60)]])
        term = rng.choice(["e", "e", "e", None, "", *"abcdefg", f"t{rng.randrange(900)}", "e\u0301", "é"])
        rows.append((rec, i if rng.random() < 0.9 else None, 0, term, 1))
    rows = [(r, a, b, t if a is not None else "same", c) for r, a, b, t, c in rows]
    rows += rng.sample(rows, 300)
    want = plain(rows)
    assert run(spark, rows) == want
    assert run(spark, rows, max_terms=20) == want


def test_empty_table_and_marks(spark):
    assert run(spark, []) == {}
    counts = spark.createDataFrame(
        [("x", None, 10, 10), ("x", "all", 10, 10), ("x", "half", 5, 4), ("x", "few", 9, 2), ("y", None, 2, 2), ("y", "both", 2, 2)],
        "src string, term string, occurrences long, records long",
    )
    got = {(r.src, r.term): r.mark for r in term_counts.mark_terms(counts).collect()}
    assert got == {("x", "all"): "common", ("x", "half"): None, ("x", "few"): "rare", ("y", "both"): "rare"}
    assert term_counts.mark_terms(counts.filter(F.lit(False))).count() == 0


def test_large_groups_of_copies_are_spread_and_count_once(spark):
    rng = random.Random(8)
    copies = [("r5", 1, 1, "hot", 0)] * 4000 + [("r6", None, None, None, 0)] * 3000
    rows = copies + [(f"r{rng.randrange(12)}", i, 0, rng.choice("abc"), 0) for i in range(900)]
    rng.shuffle(rows)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        df = spark.createDataFrame(rows, SCHEMA).repartition(5)
        want = plain(rows)
        assert run(spark, rows) == want
        got = {r.term: (r.occurrences, r.records) for r in term_counts.term_counts(df, "rec", "term", ["a", "b"], max_terms=2).collect()}
        assert got == want
        # copies are made one before any row leaves its task for a counter
        plan = term_counts.term_counts(df, "rec", "term", ["a", "b"])._jdf.queryExecution().executedPlan().toString()
        assert plan.count("HashAggregate") >= 4 and "rangepartitioning" not in plan
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)

"""Stored sketches against exact ranks and counts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import sketches


@pytest.mark.parametrize("error", [0.05, 0.01])
def test_merged_ranks_are_within_the_error(spark, error):
    rng = random.Random(4)
    rows = [(i % 13, int(rng.paretovariate(0.7) * 100)) for i in range(30_000)] + [(99, None)]
    df = spark.createDataFrame(rows, "day INT, v BIGINT").repartition(5)
    stored = sketches.column_sketches(df, ["day"], ["v"], [], error)
    values = sorted(v for _, v in rows if v is not None)
    for share in (0.0, 0.1, 0.5, 0.8, 0.99, 1.0):
        found = sketches.written_quantile(stored, "v", share).first()["value"]
        below = sum(v < found for v in values) / len(values)
        upto = sum(v <= found for v in values) / len(values)
        assert below - error <= share <= upto + error
    by_half = sketches.merged(stored.withColumn("half", F.col("day") % 2), ["half"])
    assert sorted(r["rows"] for r in by_half.collect()) == sorted(
        [sum(d % 2 == h for d, _ in rows) for h in (0, 1)])


def test_distinct_counts(spark):
    rows = [(i % 7, i * 31 % 5003, f"t{i % 40}", None if i % 3 else i) for i in range(20_000)]
    df = spark.createDataFrame(rows, "day INT, a INT, b STRING, c INT").repartition(5)
    columns = ["a", "b", "c"]
    exact = {r["column"]: r["distinct"] for r in
             sketches.exact_distinct(df, columns).collect()}
    assert exact == {"a": 5003, "b": 40, "c": len({r[3] for r in rows} - {None})}
    merged = sketches.merged(sketches.column_sketches(df, ["day"], [], columns, 0.02))
    about = merged.select(*[sketches.distinct_count(c).alias(c) for c in columns]).first()
    assert all(abs(about[c] - exact[c]) <= 0.02 * exact[c] for c in columns)


def test_nothing_to_summarise(spark):
    empty = spark.createDataFrame([], "day INT, v BIGINT")
    stored = sketches.column_sketches(empty, ["day"], ["v"], ["v"])
    assert stored.collect() == []
    assert sketches.exact_distinct(empty, ["v"]).collect()[0]["distinct"] == 0
    missing = spark.createDataFrame([(1, None)], "day INT, v BIGINT")
    stored = sketches.column_sketches(missing, ["day"], ["v"], ["v"])
    assert sketches.written_quantile(stored, "v", 0.5).first()["value"] is None
    assert stored.select(sketches.distinct_count("v")).first()[0] == 0


def test_sizes_follow_the_error():
    assert sketches.sketch_size(0.01) > sketches.sketch_size(0.05) > 8
    assert sketches.distinct_bits(0.01) > sketches.distinct_bits(0.1)

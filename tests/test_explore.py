from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import explore
from ledgerlens.operators.skew import HotRule, hot_keys


@pytest.mark.parametrize("width", [1, 1000, 10**15])
def test_quantiles_equal_numpy(spark, width):
    rng = random.Random(11)
    values = [rng.randrange(-500, 500) // 3 * width for _ in range(997)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v BIGINT").repartition(5)
    shares = [0.0, 0.1, 0.25, 0.5, 0.8, 1.0]
    got = {r["share"]: r["value"] for r in
           explore.exact_quantiles(df, "v", shares).collect()}
    expected = np.quantile(values, shares, method="inverted_cdf")
    assert [got[s] for s in shares] == list(expected)


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([(None,)], "v BIGINT")
    assert explore.exact_quantiles(empty, "v", [0.5]).collect() == []
    assert explore.approx_quantile(empty, "v", 0.5) is None


def test_quantiles_of_values_at_both_ends_of_64_bits(spark):
    values = [-(2**63), 2**63 - 1, -5, 0, 7, 2**62, -(2**62)]
    df = spark.createDataFrame([(v,) for v in values], "v BIGINT")
    shares = [0.0, 0.2, 0.5, 0.9, 1.0]
    got = {r["share"]: r["value"] for r in explore.exact_quantiles(df, "v", shares).collect()}
    ordered = sorted(values)
    assert got == {s: ordered[max(1, math.ceil(s * 7)) - 1] for s in shares}


def test_quantiles_of_many_columns_share_their_passes(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(10**9), rng.randrange(5), None if i % 3 else i, None)
            for i in range(2000)]
    df = spark.createDataFrame(rows, "a BIGINT, `b.c` INT, c INT, d INT").repartition(4)
    columns, shares = ["a", "b.c", "c", "d"], [0.25, 0.5, 0.75]
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("quantiles", "")
    got = {(r["column"], r["share"]): r["value"]
           for r in explore.exact_quantiles_of(df, columns, shares).collect()}
    jobs = len(tracker.getJobIdsForGroup("quantiles"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for i, name in enumerate(columns):
        values = [r[i] for r in rows if r[i] is not None]
        expected = np.quantile(values, shares, method="inverted_cdf") if values else [None] * 3
        assert [got.get((name, s)) for s in shares] == list(expected)
    # A look, three passes for the widest column, and the result: a few jobs each; nine
    # quantiles one after the other would take about sixty.
    assert jobs <= 16
    summed = {r["column"]: r for r in explore.summary(df.drop("b.c"), ["a", "c", "d"]).collect()}
    assert summed["a"]["median"] == got["a", 0.5] and summed["d"]["median"] is None


def lag_rows(n=600):
    rng = random.Random(2)
    ids = rng.sample(range(5000), n)
    return [(i, 0 if k % 3 == 0 else rng.randrange(1, 4), rng.randrange(60))
            for k, i in enumerate(ids)]


@pytest.mark.parametrize("rule", [None, HotRule(rows=0), HotRule(rows=150)])
@pytest.mark.parametrize("band", [7, 500, 1_000_000])
def test_lag_equals_brute_force(spark, rule, band):
    rows = lag_rows()
    df = spark.createDataFrame(rows, "id BIGINT, k INT, t BIGINT").repartition(5)
    last, expected = {}, {}
    for ident, key, time in sorted(rows, key=lambda r: (r[2], r[0])):
        expected[ident] = last.get(key, (None, None))
        last[key] = (ident, time)
    got = explore.lag_gap(df, ["k"], "t", "id", rule, band).collect()
    assert {r["id"]: (r["prev_id"], r["prev_time"]) for r in got} == expected
    for r in got:
        if r["prev_id"] is not None:
            assert r["id_gap"] == r["id"] - r["prev_id"]
            assert r["time_gap"] == r["t"] - r["prev_time"] >= 0


def test_top_breaks_ties_by_key(spark):
    df = spark.createDataFrame([(k,) for k in "ccbbaad"], "k STRING")
    assert [(r["k"], r["count"]) for r in explore.top_by_count(df, ["k"], 3).collect()] == [
        ("a", 2), ("b", 2), ("c", 2)
    ]
    assert explore.top_by_count(df, ["k"], 3, F.col("k") == "d").first()["k"] == "d"


def test_profile_of_constant_and_missing(spark):
    df = spark.createDataFrame([(5, None), (5, 2)], "a BIGINT, b BIGINT")
    got = {r["column"]: tuple(r)[1:] for r in explore.profile(df, ["a", "b"]).collect()}
    assert got == {"a": (2, 5.0, 0.0, 5, 5), "b": (1, 2.0, None, 2, 2)}


def test_class_shares_add_up(spark):
    df = spark.range(10).selectExpr("if(id < 3, 1, 0) AS label")
    got = {r["label"]: r["share"] for r in explore.class_balance(df, "label").collect()}
    assert got == {1: 0.3, 0: 0.7}


def test_rows_of_any_listed_value(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (3, 4), (5, 6)], "a INT, b INT")
    assert explore.rows_of(df, {"a": [1], "b": [4]}).count() == 3


def test_longest_span(spark):
    df = spark.createDataFrame([(1, 0), (1, 3 * 86400 + 5), (2, 7)], "k INT, t BIGINT")
    assert explore.longest_span_days(df, ["k"], "t").first()["max_days"] == 3


def plain_top(rows, k):
    counts = {}
    for a, b in rows:
        counts[a, b] = counts.get((a, b), 0) + 1
    order = sorted(counts.items(), key=lambda x: (-x[1], (x[0][0] is not None, x[0][0] or 0),
                                                  x[0][1]))
    return [(a, b, n) for (a, b), n in order[:k]]


@pytest.mark.parametrize("tracked", [1024, 100_000])
@pytest.mark.parametrize("k", [1, 7, 40])
def test_top_keys_with_ties_equal_all_counts(spark, tracked, k):
    rng = random.Random(k)
    rows = [(None if rng.random() < 0.2 else int(rng.paretovariate(0.6)) % 3000, rng.randrange(2))
            for _ in range(20_000)]
    df = spark.createDataFrame(rows, "a INT, b INT").repartition(6)
    got = [tuple(r) for r in explore.top_by_count(df, ["a", "b"], k, tracked=tracked).collect()]
    assert got == plain_top(rows, k)


def test_top_keys_are_counted_alone(spark):
    """Frequent keys are told apart without grouping the others; even ones are not."""
    skewed = spark.range(50_000).selectExpr("if(id % 3 = 0, id % 5, id) AS k")
    likely = explore._likely_items(skewed, ["k"], 5, 100_000)
    assert len(likely) == 5
    assert [r["k"] for r in explore.top_by_count(skewed, ["k"], 5).collect()] == [0, 1, 2, 3, 4]
    assert explore._likely_items(spark.range(50_000), ["id"], 5, 1024) is None
    assert [r["id"] for r in explore.top_by_count(spark.range(50_000), ["id"], 3,
                                                 tracked=1024).collect()] == [0, 1, 2]
    assert explore.top_by_count(spark.range(0), ["id"], 3).collect() == []


def test_summary_holds_every_heavy_key_whatever_the_order(spark):
    """Ten keys among a million others, tracked in a summary of a thousand."""
    rows = spark.range(300_000).selectExpr("if(id % 100 < 10, id % 10, id + 1000) AS k")
    rule = HotRule(rows=2_500, tracked=2_000)
    found = hot_keys(rows.repartition(7), ["k"], rule)
    assert sorted(r["k"] for r in found.collect()) == list(range(10))
    assert hot_keys(rows, ["k"], HotRule(rows=4_000, tracked=2_000)) is None

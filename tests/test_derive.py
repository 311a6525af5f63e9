from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import scalars
from ledgerlens.operators import derive


def one(spark, **columns):
    return spark.range(1).select(*[value.alias(name) for name, value in columns.items()]).first()


@pytest.mark.parametrize(
    "text,seconds",
    [("1 minute", 60), ("2 hours", 7200), ("10s", 10), (" 3 Days ", 259200), ("4 weeks", 0),
     ("5 days ago", 432000), ("in 2 days", None), ("7", None), ("", None), (None, None)],
)
def test_interval_seconds(spark, text, seconds):
    got = one(spark, s=scalars.interval_seconds(F.lit(text).cast("string")))
    assert got["s"] == seconds


@pytest.mark.parametrize(
    "value,base,ratio", [(6.0, 3.0, 2.0), (6.0, 0.0, 1.0), (6.0, None, 1.0), (0.0, 0.0, None),
                         (0.0, 4.0, 0.0), (None, 4.0, None)],
)
def test_guarded_ratio(spark, value, base, ratio):
    got = one(spark, r=scalars.guarded_ratio(F.lit(value).cast("double"),
                                             F.lit(base).cast("double")))
    assert got["r"] == ratio


def test_buckets_floor_below_zero(spark):
    starts = spark.createDataFrame([(-1,), (0,), (7199,), (7200,)], "t BIGINT").select(
        scalars.bucket_start(F.col("t"), 7200)
    )
    assert [r[0] for r in starts.collect()] == [-7200, 0, 0, 7200]


def test_epoch_seconds_ignore_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    df = spark.sql("SELECT timestamp_ntz'2024-03-31 02:30:00.9' AS a, "
                   "timestamp'2024-03-31 02:30:00.9Z' AS b, timestamp_ntz'1969-12-31 23:59:59' AS c")
    try:
        for name in ("UTC", "Europe/Berlin", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", name)
            got = df.select(*[scalars.epoch_seconds(df, c).alias(c) for c in "abc"]).first()
            assert tuple(got) == (1711852200, 1711852200, -1)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_row_features(spark):
    rows = [(datetime(2024, 1, 6, 5, 59), 300.0, -1, 4), (datetime(2024, 1, 8, 6, 0), 250.5, 3, -1)]
    df = spark.createDataFrame(rows, "tx_datetime TIMESTAMP_NTZ, tx_amount DOUBLE, "
                                     "terminal_id INT, customer_id INT")
    saturday, monday = derive.add_row_features(df).orderBy("tx_datetime").collect()
    assert (saturday["hour"], saturday["is_night"], saturday["day_of_week"],
            saturday["is_weekend"]) == (5, 1, 7, 1)
    assert (monday["is_night"], monday["day_of_week"], monday["is_weekend"]) == (0, 2, 0)
    assert (saturday[derive.ROUND_FLAG], monday[derive.ROUND_FLAG]) == (1, 0)
    assert saturday[derive.UNKNOWN_TERMINAL_FLAG] == 1 and monday[derive.UNKNOWN_CUSTOMER_FLAG] == 1
    assert monday["hour_sin"] == pytest.approx(1.0)
    assert len(derive.add_row_features(df).columns) == 4 + 11


def test_ratios_honour_the_drop_flag(spark):
    df = spark.createDataFrame([(6.0, 3.0, None)], "x DOUBLE, a DOUBLE, b DOUBLE")
    kept = derive.add_ratios(df, "x", ["a", "b"])
    assert kept.columns == ["x", "a", "b", "ratio_a", "ratio_b"]
    assert derive.add_ratios(df, "x", ["a", "b"], drop_bases=True).columns == [
        "x", "ratio_a", "ratio_b"
    ]


def test_risk(spark):
    df = spark.createDataFrame(
        [(1, 4, 1, 2), (0, 0, 0, 0), (None, None, None, None)],
        "f_sum_w INT, f_cn_w INT, d_sum INT, d_cn INT",
    )
    direct = derive.add_risk(df, [("f_sum_w", "f_cn_w")]).collect()
    assert [(r["f_cn_w_delay"], r["f_risk_w_delay"]) for r in direct] == [
        (4, 0.25), (0, 0.0), (0, 0.0)
    ]
    delayed = derive.add_risk_after_delay(df, [("f_sum_w", "f_cn_w")], ("d_sum", "d_cn"))
    assert delayed.columns == ["f_cn_w_delay", "f_risk_w_delay"]
    assert [tuple(r) for r in delayed.collect()] == [(2, 0.0), (0, 0.0), (0, 0.0)]
    assert "f_sum_w" in derive.add_risk(df, [("f_sum_w", "f_cn_w")], drop_inputs=False).columns


def test_warmup_keeps_later_rows(spark):
    df = spark.range(10).withColumnRenamed("id", "t")
    assert derive.after_warmup(df, df, "t", 4).count() == 6


def test_sample_does_not_depend_on_partitions(spark):
    df = spark.range(20_000)
    first = {r["id"] for r in derive.stable_sample(df, "id", 0.2).collect()}
    second = {r["id"] for r in derive.stable_sample(df.repartition(13), "id", 0.2).collect()}
    assert first == second
    assert 3600 < len(first) < 4400

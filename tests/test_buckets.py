from __future__ import annotations

import random
import statistics
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import buckets, frames
from ledgerlens.operators.buckets import BucketRequest, holds_a_bucket
from ledgerlens.operators.frames import Frame, Request
from ledgerlens.operators.skew import HotRule
from ledgerlens.plans import presets
from tests.conftest import exchanges, same_rows

ALL_HOT = HotRule(rows=0)
SHAPES = {"past": (-400, -100), "far": (-900, -201), "upto": (-300, 0)}
AGGS = {"count", "sum", "avg", "std"}


def sample_rows(n: int = 500, seed: int = 5):
    rng = random.Random(seed)
    return [
        (i, 0 if i % 3 == 0 else rng.randrange(1, 5), rng.randrange(-700, 1500),
         rng.randrange(1, 900))
        for i in range(n)
    ]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(
        sample_rows(), "id BIGINT, term INT, t BIGINT, amount BIGINT"
    ).repartition(4)


def spec(current=True, end=0, **more):
    request = Request("amount", frames.frames(SHAPES), AGGS, ddof=0, empty=0, **more)
    return BucketRequest(request, current, end)


def brute_force(rows, row, start, end, current, end_of_current, width=100):
    def bucket(t):
        return t // width * width

    own = bucket(row[2])
    past = [r[3] for r in rows if r[1] == row[1] and own + start <= bucket(r[2]) <= own + end]
    inside = [
        r[3] for r in rows
        if r[1] == row[1] and bucket(r[2]) == own and r[2] <= row[2] + end_of_current
    ]
    return past + inside if current else past


@pytest.mark.parametrize("rule", [None, ALL_HOT, HotRule(rows=8)])
@pytest.mark.parametrize("current,end", [(True, 0), (True, 30), (True, -10), (False, 0)])
def test_bucketed_frames_equal_brute_force(table, rule, current, end):
    rows = sample_rows()
    got = buckets.rolling_bucketed(table, ["term"], "t", 100, [spec(current, end)], rule).collect()
    assert len(got) == len(rows)
    by_id = {r[0]: r for r in rows}
    for row in got:
        for name, (start, stop) in SHAPES.items():
            values = brute_force(rows, by_id[row["id"]], start, stop, current, end)
            assert row[f"amount_cn_{name}"] == len(values)
            assert row[f"amount_sum_{name}"] == sum(values)
            mean = statistics.mean(values) if values else 0
            assert row[f"amount_avg_{name}"] == pytest.approx(mean)
            deviation = statistics.pstdev(values) if len(values) > 1 else 0
            assert row[f"amount_std_{name}"] == pytest.approx(deviation, abs=1e-9)


def test_frame_ends_decide_about_the_preceding_bucket(spark):
    rows = [(1, 7200 * i, 2**i) for i in range(5)]
    df = spark.createDataFrame(rows, "k INT, t BIGINT, amount BIGINT")
    shapes = (Frame("none", -7202, -7201), Frame("trained", -86400, -7201),
              Frame("fixed", -86400, -7200))
    request = Request("amount", shapes, {"sum"})
    history = buckets.bucket_history(df, ["k"], "t", 7200, [request]).orderBy("_bucket").collect()
    total = request.parts[1]
    got = [[row[buckets.history_column(total, f)] for f in shapes] for row in history]
    assert got == [
        [None, None, None], [None, None, 1], [None, 1, 3], [None, 3, 7], [None, 7, 15]
    ]
    assert [holds_a_bucket(f, 7200) for f in shapes] == [False, True, True]


def test_deviation_alone_needs_no_other_aggregate(table):
    alone = buckets.rolling_bucketed(
        table, ["term"], "t", 100, [replace(spec(), request=replace(spec().request, aggs={"std"}))]
    )
    together = buckets.rolling_bucketed(table, ["term"], "t", 100, [spec()])
    assert same_rows(alone, together.select(alone.columns))


def test_fused_specs_equal_separate_passes(table):
    labelled = table.withColumn("label", (F.col("amount") % 3 == 0).cast("int"))
    first = spec()
    second = replace(
        spec(False), request=Request("label", frames.frames(SHAPES), {"sum", "count"}, empty=0)
    )
    fused = buckets.rolling_bucketed(labelled, ["term"], "t", 100, [first, second])
    one = buckets.rolling_bucketed(labelled, ["term"], "t", 100, [first])
    both = buckets.rolling_bucketed(one, ["term"], "t", 100, [second])
    assert same_rows(fused, both)


def test_terminal_features_take_few_shuffles(spark, table):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        specs = [spec(), replace(spec(False), request=replace(spec().request, name="x_{agg}_{frame}"))]
        # Rows by bucket, totals by bucket, history by entity, history back by bucket.
        assert exchanges(buckets.rolling_bucketed(table, ["term"], "t", 100, specs)) == 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_running_inside_the_bucket(table):
    for rule in (None, ALL_HOT):
        got = buckets.in_bucket_running(table, ["term"], "t", 100, spec(), rule)
        assert got.columns == [*table.columns, "amount_cn_current", "amount_sum_current",
                               "amount_avg_current", "amount_std_current"]
        assert got.filter("amount_cn_current < 1").count() == 0
    assert same_rows(
        buckets.in_bucket_running(table, ["term"], "t", 100, spec(), None),
        buckets.in_bucket_running(table, ["term"], "t", 100, spec(), ALL_HOT),
    )


def test_fixed_presets_hold_buckets_and_leak_no_labels():
    for item in presets.terminal_specs(fixed=True):
        assert all(holds_a_bucket(f, presets.BUCKET) for f in item.request.frames)
        if item.request.target == presets.LABEL:
            assert not item.current
    hour = presets.terminal_specs()[0].request.frames[2]
    assert not holds_a_bucket(hour, presets.BUCKET)


def test_feature_columns_are_complete():
    columns = presets.feature_columns()
    assert len(columns) == len(set(columns)) == 54

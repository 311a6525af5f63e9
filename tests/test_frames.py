from __future__ import annotations

import math
import random
import statistics
from dataclasses import replace
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import buckets, exact, frames
from ledgerlens.operators.frames import Frame, Group, Request
from ledgerlens.operators.skew import HotRule, hot_keys, look_up
from tests.conftest import exchanges, same_rows

ALL_HOT = HotRule(rows=0)
SHAPES = {"tail": (-50, -1), "near": (-7, 0), "apart": (-200, -40), "around": (-5, 5)}
AGGS = {"count", "sum", "avg", "std", "isnew"}


def sample_rows(n: int = 400, seed: int = 3):
    """Few keys, many equal times, times below zero, a third of all rows on one key."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = 0 if i % 3 == 0 else rng.randrange(1, 6)
        rows.append((i, key, rng.randrange(3), rng.randrange(-300, 300), rng.randrange(1, 900)))
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(
        sample_rows(), "id BIGINT, cust INT, term INT, t BIGINT, amount BIGINT"
    ).repartition(4)


def groups():
    request = Request("amount", frames.frames(SHAPES), AGGS)
    pair = replace(request, aggs=frozenset({"isnew"}), name="pair_{agg}_{frame}")
    return [Group(("cust",), (request,)), Group(("cust", "term"), (pair,))]


def brute_force(rows, keys):
    out = {}
    for row in rows:
        for name, (start, end) in SHAPES.items():
            values = [
                r[4] for r in rows
                if all(r[k] == row[k] for k in keys) and row[3] + start <= r[3] <= row[3] + end
            ]
            out[row[0], name] = values
    return out


@pytest.mark.parametrize(
    "rule", [None, ALL_HOT, HotRule(rows=60), HotRule(rows=90)]
)
def test_frames_equal_brute_force(table, rule):
    rows = sample_rows()
    by_customer, by_pair = brute_force(rows, [1]), brute_force(rows, [1, 2])
    got = frames.rolling(table, "t", groups(), rule).collect()
    assert len(got) == len(rows)
    for row in got:
        for name in SHAPES:
            values = by_customer[row["id"], name]
            assert row[f"amount_cn_{name}"] == len(values)
            assert row[f"amount_isnew_{name}"] == (0 if values else 1)
            assert row[f"pair_isnew_{name}"] == (0 if by_pair[row["id"], name] else 1)
            if values:
                assert row[f"amount_sum_{name}"] == sum(values)
                assert row[f"amount_avg_{name}"] == pytest.approx(statistics.mean(values))
            else:
                assert row[f"amount_sum_{name}"] is None
                assert row[f"amount_avg_{name}"] is None
            if len(values) > 1:
                assert row[f"amount_std_{name}"] == pytest.approx(
                    statistics.stdev(values), abs=1e-9
                )
            else:
                assert row[f"amount_std_{name}"] is None


def test_running_totals_equal_sliding_windows(table):
    windows = frames.named_windows(["cust"], "t", SHAPES, "w")
    sliding = table.select(
        "id", *[F.sum("amount").over(windows[f"w_{name}"]).alias(f"amount_sum_{name}")
                for name in SHAPES]
    )
    request = Request("amount", frames.frames(SHAPES), {"sum"})
    ours = frames.rolling(table, "t", [Group(("cust",), (request,))], None)
    assert same_rows(ours.select(sliding.columns), sliding)


def test_nested_groups_share_one_shuffle(table):
    # The table fixture itself adds no hash exchange: it is spread round robin.
    assert exchanges(frames.rolling(table, "t", groups())) == 1


def test_a_table_in_buckets_needs_no_shuffle(spark, sf_dir):
    from checks import QUERIES
    from checks.windows import bucketed_events

    request = Request("tx_amount", frames.frames({"w": (-86400, 0)}), {"count", "avg"})
    wide = frames.rolling(
        bucketed_events(spark, sf_dir), "unix_time", [Group(("customer_id",), (request,))])
    assert exchanges(wide) == 0
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    plain = QUERIES["cust_full"](spark, sf_dir)
    assert same_rows(QUERIES["cust_full_bucketed"](spark, sf_dir), plain)


def test_slices_do_not_change_values(spark):
    rows = [(i, 1, t, i) for i, t in enumerate(range(0, 40_000_000, 997_331))]
    df = spark.createDataFrame(rows, "id BIGINT, k INT, t BIGINT, amount BIGINT")
    spans = {"m": (-2_592_000, -604_800), "w": (-604_800, 0), "f": (0, 2_000_000)}
    group = Group(("k",), (Request("amount", frames.frames(spans), {"count", "sum"}),))
    assert same_rows(
        frames.rolling(df, "t", [group], None), frames.rolling(df, "t", [group], ALL_HOT)
    )


def test_missing_keys_form_a_group_and_missing_amounts_add_nothing(spark):
    rows = [(1, None, 10, 5), (2, None, 12, None), (3, None, 13, 7), (4, 1, 13, 1)]
    df = spark.createDataFrame(rows, "id BIGINT, k INT, t BIGINT, amount BIGINT")
    request = Request("amount", (Frame("w", -10, 0),), {"count", "sum"})
    values = replace(request, counts="values", name="v_{agg}_{frame}", aggs=frozenset({"count"}))
    for rule in (None, ALL_HOT):
        got = {
            r["id"]: (r["amount_cn_w"], r["amount_sum_w"], r["v_cn_w"])
            for r in frames.rolling(df, "t", [Group(("k",), (request, values))], rule).collect()
        }
        assert got == {1: (1, 5, 1), 2: (2, 5, 1), 3: (3, 12, 2), 4: (1, 1, 1)}


def test_amounts_are_summed_in_cents(spark):
    df = spark.createDataFrame([(1, 1, 0.1), (1, 2, 0.2), (1, 3, 0.3)], "k INT, t BIGINT, a DOUBLE")
    request = Request("a", (Frame("w", -9, 0),), {"sum", "avg"}, scale=100)
    last = frames.rolling(df, "t", [Group(("k",), (request,))]).orderBy("t").collect()[-1]
    assert (last["a_sum_w"], last["a_avg_w"]) == (0.6, 0.2)


def test_only_the_requested_totals_are_computed():
    assert Request("a", (), {"count"}).parts == ["n"]
    assert Request("a", (), {"std"}).parts == ["n", "s:1:a", "qh:1:a", "qm:1:a", "ql:1:a"]
    with pytest.raises(TypeError):
        Request("a", (), "avg")
    with pytest.raises(ValueError):
        Request("a", (), {"median"})


def test_first_group_must_be_coarsest(table):
    with pytest.raises(ValueError):
        frames.rolling(table, "t", groups()[::-1])


@pytest.mark.parametrize("size", [0, 8191, 8192, 3_000_000_000, 20_000_000_000])
def test_deviation_is_exact_for_any_amount(spark, size):
    df = spark.range(1000).selectExpr("1 AS k", "id AS t", f"{size} + id % 2 AS amount")
    request = Request("amount", (Frame("w", -999, 0),), {"std"}, ddof=0)
    for rule in (None, ALL_HOT):
        wide = frames.rolling(df, "t", [Group(("k",), (request,))], rule)
        assert wide.orderBy("t").collect()[-1]["amount_std_w"] == 0.5


def test_deviation_of_negative_amounts(spark):
    rows = [(1, t, v) for t, v in enumerate([-5, 3, -100_000, 70_000])]
    df = spark.createDataFrame(rows, "k INT, t BIGINT, v BIGINT")
    request = Request("v", (Frame("w", -9, 0),), {"std"})
    last = frames.rolling(df, "t", [Group(("k",), (request,))]).orderBy("t").collect()[-1]
    assert last["v_std_w"] == pytest.approx(statistics.stdev([-5, 3, -100_000, 70_000]))


def test_hot_keys_are_the_heaviest(table):
    found = hot_keys(table, ["cust"], HotRule(rows=100))
    assert [row["cust"] for row in found.collect()] == [0]
    assert hot_keys(table, ["cust"], HotRule(rows=0)).count() == 6
    assert hot_keys(table, ["cust"]) is None


def test_hot_second_is_split_by_adaptive_execution(spark):
    rows = spark.range(300_000).selectExpr(
        "id", "1 AS k", "if(id % 3 = 0, 7L, id % 1000) AS t", "sha2(string(id), 256) AS text"
    )
    table = spark.range(1000).selectExpr("1 AS k", "id AS t", "id * 2 AS value")
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "32",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        joined = look_up(rows, table, ["k", "t"])
        assert joined.filter("value = t * 2").count() == 300_000
        counted = joined.agg(F.sum("value").alias("s"), F.max("text").alias("m"))
        counted.collect()
        assert "skew=true" in counted._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def test_fresh_ratios_leave_no_helpers(table):
    group = Group(("cust",), (Request("amount", (Frame("w", -50, -1),), {"avg", "std"}),))
    wide = frames.ratio_over_frames(table, "t", group)
    assert wide.columns == [*table.columns, "ratio_amount_avg_w", "ratio_amount_std_w"]
    based = frames.rolling(table, "t", [group])
    expected = based.select(
        "id",
        F.expr("if(amount_avg_w != 0, amount / amount_avg_w, 1.0)").alias("r"),
    )
    got = wide.select("id", F.col("ratio_amount_avg_w").alias("r"))
    pairs = got.join(expected.withColumnRenamed("r", "e"), "id").collect()
    assert all(p["r"] == pytest.approx(p["e"] if p["e"] is not None else 1.0) for p in pairs)


@pytest.mark.parametrize("rule", [None, ALL_HOT])
def test_fractions_are_never_cut_off(spark, rule):
    """Amounts without a scale: the unit is found, whatever decimals they have."""
    for amounts in ([1.9, 1.9, 0.1], [0.004, 0.004, 1.005], [1e-7, 2.5, 3e11], [0.5, 1e17, 2.0]):
        rows = [(1, t, a) for t, a in enumerate(amounts)]
        df = spark.createDataFrame(rows, "k INT, t BIGINT, a DOUBLE")
        request = Request("a", (Frame("w", -9, 0),), {"sum", "avg", "std"})
        last = frames.rolling(df, "t", [Group(("k",), (request,))], rule).orderBy("t").collect()[-1]
        assert last["a_sum_w"] == pytest.approx(sum(amounts), rel=1e-12)
        assert last["a_avg_w"] == pytest.approx(statistics.mean(amounts), rel=1e-12)
        assert last["a_std_w"] == pytest.approx(statistics.stdev(amounts), rel=1e-9)


def test_totals_of_fractions_need_a_unit(spark):
    df = spark.createDataFrame([(1, 1, 1.9)], "k INT, t BIGINT, a DOUBLE")
    request = Request("a", (Frame("w", -9, 0),), {"sum"})
    with pytest.raises(ValueError, match="fraction"):
        buckets.bucket_totals(df, ["k"], "t", 10, [request])
    (found,) = frames.resolve(df, [request])
    assert found.units == "f100"
    total = buckets.bucket_totals(df, ["k"], "t", 10, [found]).first()
    assert total[found.parts[1]] == 190


def test_a_broken_promise_is_an_error(spark):
    df = spark.createDataFrame([(1, 1, 0.125)], "k INT, t BIGINT, a DOUBLE")
    request = Request("a", (Frame("w", -9, 0),), {"sum"}, scale=100)
    with pytest.raises(Exception, match="not a multiple"):
        frames.rolling(df, "t", [Group(("k",), (request,))], None).collect()


@pytest.mark.parametrize("rule", [None, ALL_HOT])
def test_amounts_that_are_not_finite_count_as_missing(spark, rule):
    values = [1.5, float("nan"), float("inf"), None, 2.5, float("-inf")]
    rows = [(1, t, a) for t, a in enumerate(values)]
    df = spark.createDataFrame(rows, "k INT, t BIGINT, a DOUBLE")
    request = Request("a", (Frame("w", -9, 0),), {"count", "sum", "avg"}, counts="values")
    last = frames.rolling(df, "t", [Group(("k",), (request,))], rule).orderBy("t").collect()[-1]
    assert (last["a_cn_w"], last["a_sum_w"], last["a_avg_w"]) == (2, 4.0, 2.0)


def test_large_whole_numbers_do_not_overflow(spark):
    rows = [(1, t, 4 * 10**18) for t in range(4)]
    df = spark.createDataFrame(rows, "k INT, t BIGINT, a BIGINT")
    request = Request("a", (Frame("w", -9, 0),), {"avg", "std"})
    for rule in (None, ALL_HOT):
        wide = frames.rolling(df, "t", [Group(("k",), (request,))], rule)
        last = wide.orderBy("t").collect()[-1]
        assert (last["a_avg_w"], last["a_std_w"]) == (4e18, 0.0)
    near = spark.createDataFrame([(1, t, 10**15 + t) for t in range(4)], "k INT, t BIGINT, a BIGINT")
    request = Request("a", (Frame("w", -9, 0),), {"sum", "std"})
    last = frames.rolling(near, "t", [Group(("k",), (request,))], None).orderBy("t").collect()[-1]
    assert last["a_sum_w"] == 4 * 10**15 + 6
    assert last["a_std_w"] == pytest.approx(statistics.stdev(range(4)), rel=1e-12)


@pytest.mark.parametrize("rule", [None, ALL_HOT, HotRule(rows=90)])
def test_rows_without_a_time_and_open_frames(spark, rule):
    rows = [(i, k, None if i % 9 == 0 else t, a) for i, k, _, t, a in sample_rows()]
    df = spark.createDataFrame(rows, "id BIGINT, cust INT, t BIGINT, amount BIGINT")
    shapes = (Frame("all", None, 0), Frame("ended", None, -100), Frame("later", None, 20),
              Frame("near", -30, 0))
    request = Request("amount", shapes, {"count", "sum", "isnew"}, empty=0)
    got = frames.rolling(df, "t", [Group(("cust",), (request,))], rule).collect()
    assert len(got) == len(rows)
    for row in got:
        for frame in shapes:
            low = float("-inf") if frame.start is None else frame.start
            values = [] if row["t"] is None else [
                a for _, k, t, a in rows if k == row["cust"] and t is not None
                and row["t"] + low <= t <= row["t"] + frame.end]
            assert row[f"amount_cn_{frame.name}"] == len(values)
            assert row[f"amount_sum_{frame.name}"] == sum(values)
            assert row[f"amount_isnew_{frame.name}"] == int(not values)


def exact_figures(values, ddof):
    """Sum, mean and variance as fractions."""
    parts = [Fraction(v) for v in values]
    n, s = len(parts), sum(parts)
    spread = n * sum(p * p for p in parts) - s * s
    return s, s / n, spread / (n * (n - ddof)) if n > 1 else None


AMOUNTS = {
    "tiny": [1e-12, 3e-12, 7.25e-12, -2e-12, 5e-12, 0.0, 1e-13],
    "large": [2e18, 1.0, -3e18, 4e18, 2e18 + 2048, 1e19],
    "mixed": [1e-12, 2e18, 3.5, -1e17, 0.1, 7e-9],
    "far": [1e-300, 1e300, -1e300, 5e-324, 12.5],
    "one": [0.0, 0.0],
}


@pytest.mark.parametrize("rule", [None, ALL_HOT, HotRule(rows=25)])
@pytest.mark.parametrize("kind", sorted(AMOUNTS))
def test_totals_of_doubles_of_any_size_are_exact(spark, rule, kind):
    draw = random.Random(kind)
    rows = [(i, 0 if i % 2 else i % 5, draw.randrange(100), draw.choice(AMOUNTS[kind]))
            for i in range(60)]
    df = spark.createDataFrame(rows, "id INT, k INT, t BIGINT, a DOUBLE").repartition(3)
    request = Request("a", (Frame("w", -40, -1), Frame("all", None, 0)), {"sum", "avg", "std"})
    got = frames.rolling(df, "t", [Group(("k",), (request,))], rule).collect()
    for row in got:
        for name, start, end in (("w", -40, -1), ("all", -1000, 0)):
            values = [a for _, k, t, a in rows
                      if k == row["k"] and row["t"] + start <= t <= row["t"] + end]
            if not values:
                assert row[f"a_sum_{name}"] is None
                continue
            s, _, variance = exact_figures(values, 1)
            assert row[f"a_sum_{name}"] == float(s)
            assert row[f"a_avg_{name}"] == float(s) / len(values)
            if variance is None:
                assert row[f"a_std_{name}"] is None
            elif kind != "far":  # the variance itself is not a double there
                assert row[f"a_std_{name}"] == pytest.approx(math.sqrt(variance), rel=1e-14)


def test_totals_of_whole_numbers_of_64_bits_are_exact(spark):
    draw = random.Random(7)
    rows = [(1, t, draw.randint(-(2**63), 2**63 - 1)) for t in range(50)]
    df = spark.createDataFrame(rows, "k INT, t BIGINT, a BIGINT")
    request = Request("a", (Frame("w", -49, 0),), {"avg", "std"})
    values = [a for _, _, a in rows]
    for rule in (None, ALL_HOT):
        wide = frames.rolling(df, "t", [Group(("k",), (request,))], rule)
        last = wide.orderBy("t").collect()[-1]
        s, _, variance = exact_figures(values, 1)
        assert last["a_avg_w"] == float(s) / 50
        assert last["a_std_w"] == pytest.approx(math.sqrt(variance), rel=1e-14)


@pytest.mark.parametrize("kind", ["tiny", "mixed"])
def test_bucket_totals_of_any_double(spark, kind):
    draw = random.Random(kind)
    rows = [(i, i % 3, draw.randrange(400), draw.choice(AMOUNTS[kind])) for i in range(90)]
    df = spark.createDataFrame(rows, "id INT, k INT, t BIGINT, a DOUBLE").repartition(3)
    spec = buckets.BucketRequest(Request("a", (Frame("w", -200, -50),), {"sum", "std"}, ddof=0))
    for rule in (None, ALL_HOT, HotRule(rows=6)):
        for row in buckets.rolling_bucketed(df, ["k"], "t", 50, [spec], rule).collect():
            bucket = row["t"] // 50 * 50
            values = [a for _, k, t, a in rows if k == row["k"] and (
                bucket - 200 <= t // 50 * 50 <= bucket - 50 or bucket <= t <= row["t"])]
            s, _, variance = exact_figures(values, 0)
            assert row["a_sum_w"] == float(s)
            assert (row["a_std_w"] is None) == (len(values) < 2)
            if len(values) > 1:
                assert row["a_std_w"] == pytest.approx(math.sqrt(variance), rel=1e-14)


def test_limbs_add_up_to_the_number(spark):
    draw = random.Random(1)
    values = [draw.uniform(-1, 1) * 10.0 ** draw.randint(-30, 30) for _ in range(200)]
    shape = exact.layout(min(map(abs, values)), max(map(abs, values)))
    df = spark.createDataFrame([(v,) for v in values], "x DOUBLE")
    unit = Fraction(2) ** shape.low
    for row in df.selectExpr("x", exact.limbs("x", shape) + " AS l",
                             exact.square_limbs("x", shape) + " AS q").collect():
        total = sum(limb * 2 ** (exact.BITS * k) for k, limb in enumerate(row["l"])) * unit
        square = sum(limb * 2 ** (exact.BITS * k) for k, limb in enumerate(row["q"])) * unit**2
        assert (total, square) == (Fraction(row["x"]), Fraction(row["x"]) ** 2)


@pytest.mark.parametrize("rule", [None, ALL_HOT])
def test_totals_in_a_few_limbs_take_plain_arithmetic(spark, rule):
    """Functions over arrays are not compiled, and took most of the time of such frames."""
    draw = random.Random(3)
    rows = [(i % 3, t, draw.choice([-1, 1]) * draw.uniform(1, 2) * 2.0 ** draw.randint(-60, 60))
            for i, t in enumerate(range(200))]
    df = spark.createDataFrame(rows, "k INT, t BIGINT, a DOUBLE")
    request = Request("a", (Frame("w", -90, 0),), {"sum", "avg", "std"})
    wide = frames.rolling(df, "t", [Group(("k",), (request,))], rule)
    assert "lambda" not in wide._jdf.queryExecution().optimizedPlan().toString()
    for row in wide.collect():
        values = [a for k, t, a in rows if k == row["k"] and row["t"] - 90 <= t <= row["t"]]
        s, _, variance = exact_figures(values, 1)
        assert row["a_sum_w"] == float(s)
        assert row["a_avg_w"] == float(s) / len(values)
        if len(values) > 1:
            assert row["a_std_w"] == pytest.approx(math.sqrt(variance), rel=1e-14)


def test_plain_squares_add_up(spark):
    draw = random.Random(2)
    values = [draw.uniform(-1, 1) * 10.0 ** draw.randint(-15, 15) for _ in range(300)]
    values += [math.nextafter(2.0**k, 0) for k in range(-40, 40)]
    shape = exact.layout(min(map(abs, values)), max(map(abs, values)))
    assert shape.plain
    df = spark.createDataFrame([(v,) for v in values], "x DOUBLE").selectExpr(
        "x", exact.limbs("x", shape) + " AS l")
    unit = Fraction(2) ** shape.low
    for row in df.selectExpr("x", "l", exact.squares_from("l", shape) + " AS q").collect():
        total = sum(limb * 2 ** (exact.BITS * k) for k, limb in enumerate(row["l"])) * unit
        square = sum(limb * 2 ** (exact.BITS * k) for k, limb in enumerate(row["q"])) * unit**2
        assert (total, square) == (Fraction(row["x"]), Fraction(row["x"]) ** 2)
        assert max(row["q"]) < 2 ** (exact.BITS + 2)


def test_decimals_are_those_that_rounding_finds(spark):
    draw = random.Random(5)
    values = [round(draw.uniform(-1, 1) * 10.0 ** draw.randint(0, 17), draw.randint(0, 7))
              for _ in range(3000)]
    values += [math.nextafter(v, 1e300) for v in values] + [0.0, -0.0, 1e-300, 5e-324, 1e300, None]
    df = spark.createDataFrame([(v,) for v in values], "a DOUBLE")
    for digits in frames.DECIMALS:
        found = df.select(frames._has_decimals(F.col("a"), digits).alias("ours"),
                          (F.round("a", digits) == F.col("a")).alias("rounded"))
        assert found.filter(~F.col("ours").eqNullSafe(F.col("rounded"))).isEmpty()


@pytest.mark.parametrize("size", [1, 100, 10000])
def test_units_are_those_that_rounding_finds(spark, size):
    """Amounts in units are rounded without making decimals of them, also next to a half."""
    draw = random.Random(size)
    values = [draw.randrange(-(10**15), 10**15) / size for _ in range(500)]
    values += [v / size for v in (0, 1, -1, 2**50 - 1, 2**50, -(2**50), 2**52 + 1)]
    df = spark.createDataFrame([(v,) for v in values], "a DOUBLE")
    units = frames._units("a", f"{frames.FOUND}{size}")
    assert "rint" in units
    found = df.selectExpr(f"{units} AS ours", f"bigint(round(a * {size})) AS rounded")
    assert found.filter("ours IS DISTINCT FROM rounded").isEmpty()

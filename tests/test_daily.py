"""Features by day from stored totals against the full table."""

from __future__ import annotations

from datetime import date, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from checks.windows import transactions
from ledgerlens.operators.frames import Frame
from ledgerlens.operators.skew import HotRule
from ledgerlens.plans import daily, jobs
from ledgerlens.sources import readers, sinks
from tests.conftest import same_rows

WARMUP = 7 * 86400


@pytest.fixture(scope="module")
def given(spark, sf_dir):
    tx = transactions(spark, sf_dir)
    return tx.withColumn("tx_datetime", F.col("tx_datetime").cast("timestamp")).withColumn(
        jobs.DAY, F.to_date("tx_datetime"))


def days_of(df):
    return df.agg(F.min(jobs.DAY), F.max(jobs.DAY)).first()


def full(spark, source, folder, fixed=False):
    jobs.features(spark, source, folder, WARMUP, fixed, by_day=True)
    return readers.read_inferred(spark, folder)


def test_edge_days():
    day = date(2024, 3, 10)
    shapes = [Frame("a", -7 * 86400, -1), Frame("b", -3600, 0)]
    assert daily.edge_days(day, day, shapes, 0) == {date(2024, 3, 3), date(2024, 3, 9)}
    assert daily.edge_days(day, day + timedelta(days=1), shapes[:1], 0) == {
        date(2024, 3, 3), date(2024, 3, 4)}
    assert len(daily.edge_days(day, day, shapes, 1)) == 5
    assert daily._days_back(shapes) == timedelta(days=9)


@pytest.mark.parametrize("rule", [None, HotRule(rows=0)])
def test_days_from_state_equal_the_full_table(spark, given, tmp_path, rule):
    source, state, target = (str(tmp_path / name) for name in ("clean", "state", "features"))
    sinks.write_parquet(given, source, None, [jobs.DAY])
    first, last = days_of(given)
    begun = last - timedelta(days=1)
    daily.daily_features(spark, source, state, target, first, begun, WARMUP, True, rule=rule)
    # What was there before is not read again: it is no Parquet any more.
    for path in Path(source).glob("tx_date=*/*.parquet"):
        if path.parent.name != f"tx_date={last}":
            path.write_bytes(b"gone")
            (path.parent / f".{path.name}.crc").unlink(missing_ok=True)
    daily.daily_features(spark, source, state, target, last, None, WARMUP, True, rule=rule)
    again = str(tmp_path / "again")
    sinks.write_parquet(given, again, None, [jobs.DAY])
    assert same_rows(readers.read_inferred(spark, target),
                     full(spark, again, str(tmp_path / "full"), True))


def test_late_rows_and_repeated_days(spark, given, tmp_path):
    """Rows of an earlier day come late: that day and the ones after it are run again."""
    source, state, target = (str(tmp_path / name) for name in ("clean", "state", "features"))
    first, last = days_of(given)
    late = last - timedelta(days=2)
    on_time = given.filter((F.col(jobs.DAY) != late) | (F.col("transaction_id") % 3 != 0))
    sinks.write_parquet(on_time, source, None, [jobs.DAY])
    daily.daily_features(spark, source, state, target, first, last, WARMUP)
    before = readers.read_inferred(spark, target)
    assert same_rows(before, full(spark, source, str(tmp_path / "before")))
    sinks.write_parquet(given.filter(F.col(jobs.DAY) == late), source, None, [jobs.DAY])
    for _ in range(2):
        daily.daily_features(spark, source, state, target, late, last, WARMUP)
    assert same_rows(readers.read_inferred(spark, target),
                     full(spark, source, str(tmp_path / "after")))


def test_amounts_that_are_no_cents_are_an_error(spark, given, tmp_path):
    source = str(tmp_path / "clean")
    odd = given.withColumn("tx_amount", F.col("tx_amount") + 0.001)
    sinks.write_parquet(odd, source, None, [jobs.DAY])
    first, last = days_of(given)
    with pytest.raises(Exception, match="not a multiple"):
        daily.daily_features(spark, source, str(tmp_path / "s"), str(tmp_path / "f"), first, last)

"""Features by day from state that is kept between runs.

A run reads the rows of its days and, of the days before, totals only. The state is a folder
of tables by day; all of their columns but the keys are sums, so rows of the same key add up.

``seconds``  totals by customer, terminal and second
``days``     the same by customer, terminal and day, at the first second of the pair that day
``buckets``  totals by terminal and bucket
``extents``  the first second of each day

A frame of a customer begins or ends in a few days of the past only, the edge days: of those
the run reads seconds. All of any other day is in a frame or not, so it reads days.

Rows that come late change the features, and the flags that terminals count, of their day and
of those that look back on it: run their day and the ones after it again, in one run. Each
run replaces the state and the features of its days.
"""

from __future__ import annotations

from dataclasses import replace
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators.buckets import BUCKET, bucket_totals, rolling_bucketed
from ledgerlens.operators.derive import add_risk, after_warmup
from ledgerlens.operators.frames import (
    Frame,
    Request,
    added_up,
    all_parts,
    defaults,
    rolling_over_seconds,
    second_totals,
    with_columns,
    with_units,
)
from ledgerlens.operators.skew import DEFAULT_RULE, HotRule, look_up, other_side, same_key
from ledgerlens.plans import presets
from ledgerlens.plans.jobs import DAY, TIME, timed
from ledgerlens.session import cut_lineage, work_space
from ledgerlens.sources import readers, sinks

PAIR, TERMINAL = ["customer_id", "terminal_id"], ["terminal_id"]


def known_units(df: DataFrame, requests, scale: int) -> list[Request]:
    """Requests whose amounts are promised to be whole multiples of 1 / scale.

    Units of stored totals must not depend on the rows of a run.
    """
    promised = [replace(r, scale=scale) if r.target == presets.AMOUNT else r for r in requests]
    return with_units(df, promised, {}, None)


def edge_days(first: date, last: date, shapes: list[Frame], margin: int) -> set[date]:
    """Days before ``first`` in which a frame of a row of the days can begin or end.

    ``margin`` days more on both sides are for sessions whose days are not those of UTC.
    """
    begin = datetime.combine(first, datetime.min.time())
    end = datetime.combine(last, datetime.min.time()) + timedelta(days=1)
    days = set()
    for bound in {edge for f in shapes for edge in (f.start, f.end + 1)}:
        low = (begin + timedelta(seconds=bound)).date() - timedelta(days=margin)
        high = (end + timedelta(seconds=bound - 1)).date() + timedelta(days=margin)
        days |= {low + timedelta(days=k) for k in range((high - low).days + 1)}
    return {day for day in days if day < first}


def _days_back(shapes: list[Frame]) -> timedelta:
    """The days that the longest frame reaches back, and two for its begin and bucket."""
    return timedelta(days=2 - min(frame.start for frame in shapes) // presets.DAY)


def _of_keys(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Totals of the keys that have rows: the others are not asked for."""
    asked = other_side(rows.select(*keys).distinct(), keys)
    return table.join(asked, same_key(keys), "left_semi")


def _write(df: DataFrame, state: str, name: str) -> None:
    sinks.write_parquet(df, f"{state.rstrip('/')}/{name}", None, [DAY])


def _read(spark: SparkSession, state: str, name: str) -> DataFrame:
    return readers.read_inferred(spark, f"{state.rstrip('/')}/{name}")


def _customer_features(
    spark: SparkSession, rows: DataFrame, state: str, first: date, last: date, scale: int
) -> DataFrame:
    """Rows of the days with customer and pair features; keeps the totals of the days."""
    groups = [replace(group, requests=tuple(known_units(rows, group.requests, scale)))
              for group in (presets.customer_group(), presets.pair_group())]
    requests = [request for group in groups for request in group.requests]
    shapes = [frame for request in requests for frame in request.frames]
    _write(second_totals(rows, [*PAIR, DAY], TIME, requests), state, "seconds")
    seconds = _read(spark, state, "seconds")
    own = seconds.filter(F.col(DAY).between(first, last))
    sums = [F.sum(f"`{part}`").alias(part) for part in all_parts(requests)]
    _write(own.groupBy(*PAIR, DAY).agg(F.min(TIME).alias(TIME), *sums), state, "days")
    _write(own.groupBy(DAY).agg(F.min(TIME).alias(TIME)), state, "extents")

    margin = 0 if spark.conf.get("spark.sql.session.timeZone") in ("UTC", "Etc/UTC") else 1
    edges = edge_days(first, last, shapes, margin)
    before = F.col(DAY).between(first - _days_back(shapes), first - timedelta(days=1))
    columns = [*PAIR, TIME, *all_parts(requests)]
    held = own.select(*[f"`{c}`" for c in columns]).unionByName(
        seconds.filter(F.col(DAY).isin(edges)).select(*[f"`{c}`" for c in columns])
    ).unionByName(
        _read(spark, state, "days").filter(before & ~F.col(DAY).isin(edges))
        .select(*[f"`{c}`" for c in columns]))
    begin = own.agg(F.min(TIME).alias("begin"))
    wide, filled = rows, {}
    for group in groups:
        keys = list(group.keys)
        parts = all_parts(group.requests)
        mine = held.select(*keys, TIME, *[f"`{part}`" for part in parts])
        totals = added_up(_of_keys(mine, rows, keys), [*keys, TIME])
        by_second = rolling_over_seconds(totals, keys, TIME, group.requests)
        recent = by_second.filter(F.col(TIME) >= begin.scalar())
        wide = look_up(wide, recent, [*keys, TIME])
        filled |= defaults(group.requests)
    return with_columns(wide, rows.columns, filled)


def daily_features(
    spark: SparkSession, clean: str, state: str, target: str, first: date,
    last: date | None = None, warmup: int = presets.MONTH, fixed: bool = False,
    scale: int = 100, rule: HotRule | None = DEFAULT_RULE,
) -> None:
    """Features of the clean rows of ``first`` to ``last`` into folders by day.

    They are those of the full table (:func:`ledgerlens.plans.jobs.feature_table`) as long as
    the state holds the days before; a run over all days at once begins a state. ``warmup``
    counts from the first row of the state. Amounts are whole multiples of 1 / ``scale``, and
    an error else.
    """
    last = last or first
    with work_space(spark):
        read = readers.read_clean_by_day(spark, clean)
        rows = timed(read.filter(F.col(DAY).between(first, last)).drop("run"))
        by_customer = cut_lineage(
            _customer_features(spark, rows, state, first, last, scale), "daily-customer")
        specs = presets.terminal_specs(fixed)
        requests = known_units(by_customer, [spec.request for spec in specs], scale)
        specs = [replace(spec, request=request) for spec, request in zip(specs, requests)]
        shapes = [frame for request in requests for frame in request.frames]
        _write(bucket_totals(by_customer, [*TERMINAL, DAY], TIME, presets.BUCKET, requests),
               state, "buckets")
        looked_at = _read(spark, state, "buckets").filter(
            F.col(DAY).between(first - _days_back(shapes), last)).drop(DAY)
        stored = added_up(_of_keys(looked_at, by_customer, TERMINAL), [*TERMINAL, BUCKET])
        by_terminal = rolling_bucketed(
            by_customer, TERMINAL, TIME, presets.BUCKET, specs, rule, stored)
        complete = add_risk(by_terminal, presets.risk_pairs(list(presets.FRAUD)))
        extents = _read(spark, state, "extents")
        table = after_warmup(complete, extents, TIME, warmup)
        sinks.write_parquet(table.select(*presets.feature_columns(), DAY), target, None, [DAY])

"""Frame aggregates over time buckets, for entities with very many rows.

The history of a row is read from totals per entity and bucket; only inside the current
bucket are single rows looked at. Frames are compared with bucket starts, so an end of
``-interval`` takes in the preceding bucket, while ``-interval - 1`` leaves it out.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import bucket_start
from ledgerlens.operators.frames import (
    Frame,
    Request,
    RunningTotals,
    all_parts,
    check_resolved,
    defaults,
    finish,
    looked,
    part_value,
    prepared,
    totals,
    with_columns,
)
from ledgerlens.operators.skew import DEFAULT_RULE, HotRule, look_up, split_hot

BUCKET = "_bucket"


@dataclass(frozen=True)
class BucketRequest:
    """A request whose frames select buckets.

    ``current`` adds the rows of the own bucket up to ``end_of_current`` seconds after
    the row; rows of the same second always count.
    """

    request: Request
    current: bool = True
    end_of_current: int = 0

    @property
    def own(self) -> Frame:
        return Frame("current", None, self.end_of_current)


def holds_a_bucket(frame: Frame, interval: int) -> bool:
    """Whether some multiple of ``interval`` lies in the frame."""
    return frame.end // interval * interval >= frame.start


def with_bucket(df: DataFrame, time: str, interval: int) -> DataFrame:
    return df.withColumn(BUCKET, bucket_start(F.col(time), interval))


def bucket_totals(
    df: DataFrame, keys: list[str], time: str, interval: int, requests: list[Request]
) -> DataFrame:
    """One row per entity and bucket with all totals the requests need.

    Totals are named by the units of the requests, so amounts with a fraction must have
    been resolved (:func:`ledgerlens.operators.frames.resolve`).
    """
    check_resolved(df, requests)
    rows = prepared(with_bucket(df, time, interval), requests)
    return rows.groupBy(*keys, BUCKET).agg(*totals(all_parts(requests)))


def bucket_history(
    df: DataFrame, keys: list[str], time: str, interval: int, requests: list[Request]
) -> DataFrame:
    """Totals of the buckets each frame selects, per entity and bucket.

    Columns are named by :func:`history_column`; a frame without any bucket gives null.
    All requests share one aggregation and one window.
    """
    wide, running = _running_buckets(df, keys, time, interval, requests)
    columns = {}
    for request in requests:
        for frame in request.frames:
            some = running.within(request.parts[0], frame)
            for name, value in _selected(request, frame, running).items():
                columns[name] = f"if({some} > 0, {value}, NULL)"
    return with_columns(wide, [*keys, BUCKET], columns)


def _running_buckets(
    df: DataFrame, keys: list[str], time: str, interval: int, requests: list[Request],
    stored: DataFrame | None = None,
) -> tuple[DataFrame, RunningTotals]:
    running = RunningTotals(requests)
    by_bucket = bucket_totals(df, keys, time, interval, requests) if stored is None else stored
    return running.add(by_bucket, keys, BUCKET), running


def _selected(request: Request, frame: Frame, running: RunningTotals) -> dict[str, str]:
    return {history_column(part, frame): running.within(part, frame) for part in request.parts}


def _history_features(
    df: DataFrame, keys: list[str], time: str, interval: int, specs: list[BucketRequest],
    stored: DataFrame | None,
) -> DataFrame:
    """What rows need of the past, per entity and bucket: totals where the own bucket is
    added, and the finished columns where it is not."""
    wide, running = _running_buckets(
        df, keys, time, interval, [s.request for s in specs], stored)
    unfinished: dict[str, str] = {}
    for spec in specs:
        for frame in spec.request.frames if spec.current else ():
            unfinished.update(_selected(spec.request, frame, running))
    table = with_columns(wide, wide.columns, unfinished)
    settled = [(spec.request, running.within) for spec in specs if not spec.current]
    return finish(table, [*keys, BUCKET, *unfinished], settled)


def _settled_columns(specs: list[BucketRequest]) -> dict[str, str]:
    """Finished columns by name; rows without any history get the values of no rows."""
    return defaults(spec.request for spec in specs if not spec.current)


def _looked(
    df: DataFrame, keys: list[str], time: str, interval: int, specs: list[BucketRequest],
    rule: HotRule | None,
) -> tuple[list[BucketRequest], list[int]]:
    """Specs with units, and what may be hot buckets of an entity, by one look."""
    # Without a spec that looks into the own bucket there is no window over rows.
    if not any(spec.current for spec in specs):
        rule = None
    rows = with_bucket(df, time, interval) if rule else df
    found, items = looked(rows, [spec.request for spec in specs], [*keys, BUCKET], rule)
    return [replace(spec, request=request) for spec, request in zip(specs, found)], items


def history_column(part: str, frame: Frame) -> str:
    return f"{part}@{frame.name}@{frame.start}@{frame.end}"


def _own_bucket(specs: list[BucketRequest]) -> RunningTotals:
    inside = [
        replace(spec.request, frames=(spec.own,))
        for spec in specs
        if spec.current
    ]
    return RunningTotals(inside)


def _past_and_own(spec: BucketRequest, running: RunningTotals):
    def total(part: str, frame: Frame) -> str:
        past = f"coalesce(`{history_column(part, frame)}`, 0)"
        return f"({past} + {running.within(part, spec.own)})"

    return total


def in_bucket_running(
    df: DataFrame, keys: list[str], time: str, interval: int, spec: BucketRequest,
    rule: HotRule | None = DEFAULT_RULE,
) -> DataFrame:
    """Aggregates over the rows of the own bucket up to the row itself."""
    inside = replace(spec.request, frames=(spec.own,))
    own = replace(spec, request=inside, current=True)
    specs, items = _looked(df, keys, time, interval, [own], rule)
    return _attach(df, keys, time, interval, specs, None, rule, items)


def rolling_bucketed(
    df: DataFrame, keys: list[str], time: str, interval: int, specs: list[BucketRequest],
    rule: HotRule | None = DEFAULT_RULE, stored: DataFrame | None = None,
) -> DataFrame:
    """Add bucketed frame aggregates to every row.

    All specs share one aggregation by bucket, one history window and one join. ``stored``
    is the table of :func:`bucket_totals` of all rows, where ``df`` is only some of them: it
    has a row for each bucket of ``df``, and the units of the specs are known.
    """
    specs, items = _looked(df, keys, time, interval, specs, rule)
    history = _history_features(df, keys, time, interval, specs, stored)
    return _attach(df, keys, time, interval, specs, history, rule, items)


def _attach(
    df: DataFrame, keys: list[str], time: str, interval: int, specs: list[BucketRequest],
    history: DataFrame | None, rule: HotRule | None, items: list[int],
) -> DataFrame:
    group = [*keys, BUCKET]
    running = _own_bucket(specs)
    inside = [spec.request for spec in specs if spec.current]

    def features(wide: DataFrame, keep: list[str]) -> DataFrame:
        if history is None:
            return finish(wide, keep, [(spec.request, running.within) for spec in specs])
        joined = look_up(wide, history, group, match_missing=False)
        settled = _settled_columns(specs)
        filled = with_columns(
            joined, [name for name in joined.columns if name not in settled], settled
        )
        own = [(spec.request, _past_and_own(spec, running)) for spec in specs if spec.current]
        return finish(filled, [*keep, *settled], own)

    ordinary, hot = split_hot(
        with_bucket(df, time, interval), group, rule if inside else None, items)
    # Ordinary buckets: the window and the join use the same partitioning of the rows.
    by_row = features(
        running.add(prepared(ordinary, inside), group, time, part_value), df.columns)
    if hot is None:
        return by_row
    # Hot buckets: one row per second, at most ``interval`` of them in a window.
    parts = all_parts(inside) or ["n"]
    seconds = prepared(hot, inside).groupBy(*group, time).agg(*totals(parts))
    by_second = features(running.add(seconds, group, time), [*group, time])
    by_lookup = look_up(hot, by_second, [*group, time]).drop(BUCKET)
    return by_row.unionByName(by_lookup)

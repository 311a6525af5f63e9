"""Profiling: counts, extents, quantiles, order checks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import bucket_start
from ledgerlens.operators.skew import (
    DEFAULT_RULE,
    HotRule,
    bound_error,
    frequent_items,
    look_up,
    rows_with_items,
    split_hot,
)


def time_extent(df: DataFrame, time: str) -> DataFrame:
    return df.agg(F.min(time).alias("min_time"), F.max(time).alias("max_time"))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Rows and share per label value."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    # One row per label value is left here, so a window over all of them is small.
    whole = F.sum("count").over(Window.partitionBy())
    return counts.withColumn("share", F.col("count").cast("double") / whole.cast("double"))


def count_by(df: DataFrame, keys: list[str], only: Column | str | None = None) -> DataFrame:
    rows = df if only is None else df.filter(only)
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def top_by_count(
    df: DataFrame, keys: list[str], k: int = 20, only: Column | str | None = None,
    tracked: int = 100_000,
) -> DataFrame:
    """The ``k`` most frequent keys; equal counts in key order.

    One pass keeps a summary of at most ``tracked`` frequent keys, which tells which keys can
    be among the first; a second pass counts those exactly, so only their rows are grouped.
    Where the summary cannot tell, because the keys are too many and too alike, all keys are
    counted.
    """
    rows = df if only is None else df.filter(only)
    likely = _likely_items(rows, keys, k, tracked)
    if likely is not None:
        rows = rows_with_items(rows, keys, likely)
    return count_by(rows, keys).orderBy(F.desc("count"), *keys).limit(k)


def _likely_items(rows: DataFrame, keys: list[str], k: int, tracked: int) -> list[int] | None:
    """Items of the keys that can be among the ``k`` most frequent; None if that is unknown.

    A bound is at most ``error`` above the rows of a key. The k-th bound less that is reached
    by k keys, so keys whose bound is lower are out. A key that the summary does not hold has
    fewer rows than twice the error.
    """
    if not 0 < k <= tracked:
        return None
    error = F.count(F.lit(1)) * bound_error(tracked)
    frequent = frequent_items(keys, tracked)
    least = F.get(frequent, F.least(F.lit(k), F.size(frequent)) - 1)["count"] - error
    found = rows.agg(
        F.size(frequent).alias("held"), (least > 2 * error).alias("known"),
        F.filter(frequent, lambda x: x["count"] >= least)["item"].alias("items")).first()
    # Fewer than k: either there are no more keys, or those that are missing are unknown.
    return list(found["items"]) if found["held"] >= k and found["known"] else None


def rows_of(df: DataFrame, chosen: dict[str, list]) -> DataFrame:
    """Rows in which any of the columns has one of its listed values."""
    wanted = F.lit(False)
    for name, values in chosen.items():
        wanted = wanted | F.col(name).isin(values)
    return df.filter(wanted)


def active_span(df: DataFrame, keys: list[str], time: str) -> DataFrame:
    """First and last time and the seconds between them, per key."""
    spans = df.groupBy(*keys).agg(F.min(time).alias("min_time"), F.max(time).alias("max_time"))
    return spans.withColumn("diff_time", F.col("max_time") - F.col("min_time"))


def longest_span_days(df: DataFrame, keys: list[str], time: str) -> DataFrame:
    longest = F.max("diff_time")
    days = (longest - F.pmod(longest, F.lit(86400))) / 86400
    return active_span(df, keys, time).agg(days.cast("bigint").alias("max_days"))


def counts_where(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Several filtered counts in one pass."""
    return df.agg(*[F.count_if(c).cast("bigint").alias(name) for name, c in conditions.items()])


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, deviation, minimum and maximum of integer columns, one row each.

    The moments are exact integers, so the figures do not depend on the row order.
    """
    measured = []
    for name in columns:
        wide = F.col(name).cast("decimal(19,0)")
        measured += [
            F.count(name).alias(f"n:{name}"),
            F.sum(wide).cast("decimal(38,0)").alias(f"s:{name}"),
            F.sum(wide * wide).alias(f"q:{name}"),
            F.min(name).cast("bigint").alias(f"lo:{name}"),
            F.max(name).cast("bigint").alias(f"hi:{name}"),
        ]
    one = df.agg(*measured)
    rows = []
    for name in columns:
        n, s, q = F.col(f"n:{name}"), F.col(f"s:{name}"), F.col(f"q:{name}")
        count = n.cast("double")
        spread = (n.cast("decimal(19,0)") * q - s * s).cast("double")
        deviation = F.sqrt(F.try_divide(spread, count * (count - 1)))
        rows.append(
            F.struct(
                F.lit(name).alias("column"),
                n.alias("count"),
                F.try_divide(s.cast("double"), count).alias("mean"),
                F.when(n > 1, deviation).alias("stddev"),
                F.col(f"lo:{name}").alias("min"),
                F.col(f"hi:{name}").alias("max"),
            )
        )
    return one.select(F.inline(F.array(*rows)))


BANDS = 1024


def exact_quantiles(df: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """Exact quantiles (share, value) of an integer column: :func:`exact_quantiles_of`."""
    return exact_quantiles_of(df, [column], shares).select("share", "value")


def exact_quantiles_of(df: DataFrame, columns: list[str], shares: list[float]) -> DataFrame:
    """Exact quantiles (column, share, value) of integer columns: the smallest value that at
    least the share of all values does not exceed. No rows come from a column without values.

    Counting passes instead of a global sort: the range of the values is cut into at most
    ``BANDS`` bands, the counts of the bands (few rows) tell in which of them each quantile
    is, and that band is cut again until it is a single value. A pass narrows the ranges of
    all columns and shares at once by a factor of ``BANDS``, so seconds or cents take three
    or four passes however many columns there are.
    """
    spark = df.sparkSession
    values = df.select(*[F.col(f"`{name}`").cast("bigint").alias(f"v{i}")
                         for i, name in enumerate(columns)])
    ends = values.agg(*[measure(f"v{i}").alias(f"{label}{i}") for i in range(len(columns))
                        for label, measure in (("l", F.min), ("m", F.max), ("n", F.count))]).first()
    # For each column and share: the range it is in, and its rank among the values there.
    ranges = {(i, share): (ends[f"l{i}"], ends[f"m{i}"], max(1, math.ceil(share * ends[f"n{i}"])))
              for i in range(len(columns)) if ends[f"n{i}"] for share in shares}
    while any(low < high for low, high, _ in ranges.values()):
        open_ = {key: r for key, r in ranges.items() if r[0] < r[1]}
        widths = {key: (high - low) // BANDS + 1 for key, (low, high, _) in open_.items()}
        inside = F.array_compact(F.array(*[
            F.when(F.col(f"v{i}").between(low, high), F.struct(
                F.lit(i).alias("place"), F.lit(float(share)).alias("share"),
                _band(f"v{i}", low, high, widths[i, share]).alias("band")))
            for (i, share), (low, high, _) in open_.items()]))
        counted = values.select(F.inline(inside)).groupBy("place", "share", "band").count()
        by_key: dict[tuple, list] = {(i, float(share)): [] for i, share in open_}
        for row in counted.collect():
            by_key[row["place"], row["share"]].append((row["band"], row["count"]))
        for key in open_:
            low, high, rank = ranges[key]
            for band, count in sorted(by_key[key[0], float(key[1])]):
                if rank <= count:
                    start = low + band * widths[key]
                    ranges[key] = (start, min(high, start + widths[key] - 1), rank)
                    break
                rank -= count
    found = [(columns[i], float(share), low) for (i, share), (low, _, _) in ranges.items()]
    return spark.createDataFrame(found, "column STRING, share DOUBLE, value BIGINT")


def _band(name: str, low: int, high: int, width: int) -> Column:
    """Number of the band that a value of the range is in."""
    if high - low < 2**62 and low > -(2**62):
        return F.expr(f"({name} - ({low}L)) div {width}L")
    # The distance from the lower end may need more than 64 bits.
    wide = f"cast({name} AS decimal(20, 0)) - cast('{low}' AS decimal(20, 0))"
    return F.expr(f"({wide}) div cast('{width}' AS decimal(20, 0))")


QUARTILES = {"first_quartile": 0.25, "median": 0.5, "third_quartile": 0.75}


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """:func:`profile` with the exact quartiles of all columns, null without values."""
    quartiles = exact_quantiles_of(df, columns, list(QUARTILES.values())).groupBy("column").agg(
        *[F.max(F.when(F.col("share") == share, F.col("value"))).alias(name)
          for name, share in QUARTILES.items()])
    measured = profile(df, columns)
    return measured.join(F.broadcast(quartiles), "column", "left").select(
        *measured.columns[:-1], *QUARTILES, "max")


def approx_quantile(
    df: DataFrame, column: str, share: float, error: float = 0.01
) -> float | None:
    """Approximate quantile on the driver, by a sketch of bounded size; None without values."""
    found = df.approxQuantile(column, [share], error)
    return found[0] if found else None


def lag_gap(
    df: DataFrame, keys: list[str], time: str, ident: str, rule: HotRule | None = DEFAULT_RULE,
    band: int = 1_000_000,
) -> DataFrame:
    """Previous id and time per key in (time, id) order, and the gaps to them.

    ``ident`` is a unique integer. Rows of hot keys find their predecessor in steps that
    are bounded each: inside a band of ids of their second, then in the preceding band of
    the second, then in the preceding second.
    """
    order = Window.partitionBy(*keys).orderBy(time, ident)
    ordinary, hot = split_hot(df, keys, rule)
    by_row = ordinary.withColumns(
        {"prev_id": F.lag(ident).over(order), "prev_time": F.lag(time).over(order)}
    )

    found = by_row
    if hot is not None:
        found = by_row.unionByName(_previous_in_steps(hot, keys, time, ident, band))
    return found.withColumns(
        {
            "id_gap": F.col(ident) - F.col("prev_id"),
            "time_gap": F.col(time) - F.col("prev_time"),
        }
    )


def _previous_in_steps(
    hot: DataFrame, keys: list[str], time: str, ident: str, band: int
) -> DataFrame:
    second, group = [*keys, time], [*keys, time, "_band"]
    banded = hot.withColumn("_band", bucket_start(F.col(ident).cast("bigint"), band))
    bands = banded.groupBy(*group).agg(F.max(ident).alias("_last"))
    in_second = Window.partitionBy(*second).orderBy("_band")
    bands = bands.withColumn("_band_before", F.lag("_last").over(in_second))
    seconds = bands.groupBy(*second).agg(F.max("_last").alias("_last"))
    in_key = Window.partitionBy(*keys).orderBy(time)
    seconds = seconds.select(
        *second,
        F.lag("_last").over(in_key).alias("_id_before"),
        F.lag(time).over(in_key).alias("_time_before"),
    )
    before = look_up(bands.drop("_last"), seconds, second)
    in_band = Window.partitionBy(*group).orderBy(ident)
    ranked = look_up(banded.withColumn("_row_before", F.lag(ident).over(in_band)), before, group)
    same_second = F.coalesce(F.col("_row_before"), F.col("_band_before"))
    return ranked.withColumns(
        {
            "prev_id": F.coalesce(same_second, F.col("_id_before")),
            "prev_time": F.when(same_second.isNotNull(), F.col(time)).otherwise(
                F.col("_time_before")
            ),
        }
    ).select(*hot.columns, "prev_id", "prev_time")

"""Row-level features, ratios, risk rates and the warm-up filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import (
    guarded_ratio,
    hour_flags,
    is_round_amount,
    on_circle,
    rate,
    weekday_flags,
)
from ledgerlens.schema import UNKNOWN


def add_calendar(df: DataFrame, ts: str = "tx_datetime") -> DataFrame:
    return df.withColumns({**hour_flags(ts), **weekday_flags(ts)})


def add_cyclic(df: DataFrame) -> DataFrame:
    """Hour and weekday on a circle; needs :func:`add_calendar`."""
    hour_sin, hour_cos = on_circle(F.col("hour"), 24)
    day_sin, day_cos = on_circle(F.col("day_of_week"), 7)
    return df.withColumns(
        {"hour_sin": hour_sin, "hour_cos": hour_cos, "day_sin": day_sin, "day_cos": day_cos}
    )


# The flag columns keep the spelling models were trained with.
ROUND_FLAG = "is_rovn_sum"
UNKNOWN_TERMINAL_FLAG = "is_unknonw_terminal"
UNKNOWN_CUSTOMER_FLAG = "is_unknonw_customer"


def add_round_flag(df: DataFrame, amount: str = "tx_amount") -> DataFrame:
    return df.withColumn(ROUND_FLAG, is_round_amount(F.col(amount)))


def add_unknown_flags(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            UNKNOWN_TERMINAL_FLAG: (F.col("terminal_id") == UNKNOWN).cast("int"),
            UNKNOWN_CUSTOMER_FLAG: (F.col("customer_id") == UNKNOWN).cast("int"),
        }
    )


def add_row_features(df: DataFrame, ts: str = "tx_datetime", amount: str = "tx_amount"):
    """All eleven features that depend on the row alone."""
    return add_cyclic(add_unknown_flags(add_round_flag(add_calendar(df, ts), amount)))


def add_ratios(
    df: DataFrame, target: str, bases: list[str], drop_bases: bool = False
) -> DataFrame:
    """``ratio_<base>`` for columns that exist already."""
    ratios = {f"ratio_{base}": guarded_ratio(F.col(target), F.col(base)) for base in bases}
    wide = df.withColumns(ratios)
    return wide.drop(*bases) if drop_bases else wide


def own_value_where_missing(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Averages without history take the value of the row itself: {average: value}."""
    return df.withColumns(
        {name: F.coalesce(name, F.col(value).cast("double")) for name, value in columns.items()}
    )


def _risk_name(sum_column: str) -> str:
    return sum_column.replace("_sum_", "_risk_") + "_delay"


def add_risk(df: DataFrame, pairs: list[tuple[str, str]], drop_inputs: bool = True) -> DataFrame:
    """Risk = labelled rows / rows, from (sum, count) columns of frames in the past."""
    added = {}
    for labelled, rows in pairs:
        added[f"{rows}_delay"] = F.coalesce(F.col(rows), F.lit(0))
        added[_risk_name(labelled)] = rate(F.col(labelled), F.col(rows))
    wide = df.withColumns(added)
    return wide.drop(*[name for pair in pairs for name in pair]) if drop_inputs else wide


def add_risk_after_delay(
    df: DataFrame,
    pairs: list[tuple[str, str]],
    delay: tuple[str, str],
    drop_inputs: bool = True,
) -> DataFrame:
    """Risk of frames that reach up to now, less the (sum, count) of the delay frame."""
    added = {}
    for labelled, rows in pairs:
        past_rows = F.col(rows) - F.col(delay[1])
        added[f"{rows}_delay"] = F.coalesce(past_rows, F.lit(0))
        added[_risk_name(labelled)] = rate(F.col(labelled) - F.col(delay[0]), past_rows)
    wide = df.withColumns(added)
    inputs = [name for pair in (*pairs, delay) for name in pair]
    return wide.drop(*inputs) if drop_inputs else wide


def after_warmup(df: DataFrame, source: DataFrame, time: str, seconds: int) -> DataFrame:
    """Rows at least ``seconds`` after the first row of ``source``.

    Call it after the features are computed: earlier rows are their history. The first
    time is a scalar subquery over ``source``, so nothing comes to the driver.
    """
    begin = source.agg((F.min(time) + seconds).alias("begin")).scalar()
    return df.filter(F.col(time) >= begin)


def stable_sample(df: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """About ``share`` of the rows, chosen by a digest of their key: the same in every run
    and in every engine that has MD5."""
    return df.filter(in_stable_sample(key, share, seed))


def in_stable_sample(key: str, share: float, seed: int = 42) -> Column:
    """Whether a row is one of :func:`stable_sample`."""
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(seed)))
    place = F.conv(F.substr(digest, F.lit(1), F.lit(8)), 16, 10).cast("bigint")
    return place < int(share * 2**32)

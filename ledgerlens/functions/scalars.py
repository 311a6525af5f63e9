"""Scalar building blocks shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Unit names accepted in interval texts, in seconds.
UNIT_SECONDS = {
    "s": 1,
    "second": 1,
    "seconds": 1,
    "m": 60,
    "minute": 60,
    "minutes": 60,
    "h": 3600,
    "hour": 3600,
    "hours": 3600,
    "d": 86400,
    "day": 86400,
    "days": 86400,
}


def epoch_seconds(df: DataFrame, column: str) -> Column:
    """Whole seconds since 1970.

    Timestamps without a zone are read field by field, so the session zone never
    shifts them; timestamps with a zone use their instant.
    """
    ts = F.col(column)
    if dict(df.dtypes)[column] == "timestamp_ntz":
        days = F.unix_date(F.to_date(ts)).cast("bigint")
        return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    return F.unix_seconds(ts)


def bucket_start(time: Column, width: int) -> Column:
    """Start of the ``width``-second bucket of an integer time; floors below zero too."""
    return time - F.pmod(time, F.lit(width).cast("bigint"))


def known_or(column: str | Column, mark: int) -> Column:
    """Missing and negative values become ``mark``."""
    value = F.col(column) if isinstance(column, str) else column
    return F.when(value >= 0, value).otherwise(F.lit(mark))


def end_of_day_fix(text: str | Column) -> Column:
    """The invalid clock value 24:00:00 becomes the last second of the same day."""
    return F.regexp_replace(text, "24:00:00", "23:59:59")


def parse_time(text: Column) -> Column:
    """Timestamp from text, null where the text is none."""
    return text.try_cast("timestamp")


def guarded_ratio(value: Column, base: Column) -> Column:
    """``value / base``; 1 where the base is missing or 0, null where both are 0."""
    return F.try_divide(value, F.when(base != 0, base).otherwise(value))


def rate(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double, 0 where there is nothing to divide."""
    share = F.try_divide(part.cast("double"), whole.cast("double"))
    return F.coalesce(share, F.lit(0.0))


def interval_seconds(text: str | Column) -> Column:
    """Seconds of texts such as ``2 hours`` or ``10s``.

    Only the beginning has to match; an unknown unit counts 0, other texts give null.
    """
    pattern = r"^\s*(\d+)\s*([a-z]+)"
    lowered = F.lower(text)
    digits = F.nullif(F.regexp_extract(lowered, pattern, 1), F.lit(""))
    unit = F.regexp_extract(lowered, pattern, 2)
    seconds = F.lit(0)
    for name, size in UNIT_SECONDS.items():
        seconds = F.when(unit == name, size).otherwise(seconds)
    return digits.try_cast("bigint") * seconds


def hour_flags(ts: str) -> dict[str, Column]:
    """Hour of day and whether it belongs to the night (before six)."""
    hour = F.hour(ts)
    return {"hour": hour, "is_night": F.when(hour < 6, 1).otherwise(0)}


def weekday_flags(ts: str) -> dict[str, Column]:
    """Day of week (Sunday is 1) and whether it is a weekend day."""
    day = F.dayofweek(ts)
    return {"day_of_week": day, "is_weekend": F.when(day.isin(1, 7), 1).otherwise(0)}


def on_circle(value: Column, period: int) -> tuple[Column, Column]:
    """Sine and cosine of a periodic value."""
    angle = value * (2 * F.pi()) / period
    return F.sin(angle), F.cos(angle)


def is_round_amount(amount: Column, step: int = 100) -> Column:
    """1 for whole multiples of ``step``, decided on the amount itself."""
    return (amount % step == 0).cast("int")

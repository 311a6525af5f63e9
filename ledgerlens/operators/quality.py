"""Repair, validity, deduplication and the data-quality report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import end_of_day_fix, known_or, parse_time
from ledgerlens.schema import REPAIRED_COLUMNS, UNKNOWN


def repair_unknown(
    df: DataFrame, columns: list[str] = REPAIRED_COLUMNS, mark: int = UNKNOWN
) -> DataFrame:
    """Missing and negative values of ``columns`` become ``mark``."""
    return df.withColumns({name: known_or(name, mark) for name in columns})


def repair_time(df: DataFrame, column: str = "tx_datetime") -> DataFrame:
    """Text to timestamp, with 24:00:00 taken as the end of the day."""
    return df.withColumn(column, parse_time(end_of_day_fix(column)))


def validity() -> dict[str, Column]:
    """Conditions a row must meet, by name; missing values meet none.

    An amount is a finite number: NaN and infinity, which text files can hold, sort above
    every number and do not pass.
    """
    return {
        "transaction_id": F.col("transaction_id") >= 0,
        "tx_datetime": F.col("tx_datetime").isNotNull(),
        "tx_amount": (F.col("tx_amount") >= 0) & (F.col("tx_amount") < float("inf")),
        "tx_fraud": F.col("tx_fraud").isin(0, 1),
    }


def keep_valid(df: DataFrame) -> DataFrame:
    for condition in validity().values():
        df = df.filter(condition)
    return df


def first_of_each(
    df: DataFrame, keys: list[str], order: list[str], counted: str | None = None
) -> DataFrame:
    """One row per key: the first by ``order``, then by all remaining columns.

    ``counted`` names a column to add: the rows of the key.

    The smallest row is an aggregate, so copies are dropped before the shuffle and a key
    with very many copies costs no more than any other. The total order makes the choice
    repeatable.
    """
    ranked = [*order, *[name for name in df.columns if name not in (*keys, *order)]]
    first = F.min(F.struct(*ranked)).alias("_first")
    rows = [F.count(F.lit(1)).alias(counted)] if counted else []
    return df.groupBy(*keys).agg(first, *rows).select(
        *[F.col(name) if name in keys else F.col(f"_first.{name}") for name in df.columns],
        *([counted] if counted else []),
    )


def clean_transactions(
    df: DataFrame, order: list[str], dedup_first: bool = True, copies: Observation | None = None
) -> DataFrame:
    """Unique valid rows; ``df`` is repaired already.

    By default the survivor of a set of copies is chosen before validity is looked at, so
    an invalid survivor removes its id. ``dedup_first=False`` chooses among valid rows.
    ``copies`` observes ``duplicates``, the rows beyond the first of each id; it needs the
    default order, and all ids take part in the shuffle then.
    """
    keys = ["transaction_id"]
    if copies is not None:
        if not dedup_first:
            raise ValueError("copies are counted where they are looked for first")
        first = first_of_each(df, keys, order, "_rows").observe(
            copies, F.coalesce(F.sum(F.col("_rows") - 1), F.lit(0)).alias("duplicates"))
        kept = keep_valid(first.drop("_rows"))
    elif dedup_first:
        # Rows without a usable id can never survive; keep them out of the shuffle.
        known = df.filter(validity()["transaction_id"])
        kept = keep_valid(first_of_each(known, keys, order))
    else:
        kept = first_of_each(keep_valid(df), keys, order)
    return kept.withColumn("tx_fraud", F.col("tx_fraud").cast("boolean"))


def quality_checks(unknown_columns: dict[str, str] | None = None) -> dict[str, Column]:
    """Conditions of bad values in repaired rows, by the name in the report.

    ``unknown_columns`` maps report names to columns whose repaired values are counted.
    """
    if unknown_columns is None:
        unknown_columns = {
            "bad_customer_id": "customer_id",
            "bad_terminal_id": "terminal_id",
            "bad_tx_time_seconds": "tx_time_seconds",
            "bad_tx_time_days": "tx_time_days",
            "bad_scenario_id": "tx_fraud_scenario",
        }
    checks = {
        f"bad_{name}": ~F.coalesce(ok, F.lit(False)) for name, ok in validity().items()
    }
    return checks | {name: F.col(column) == UNKNOWN for name, column in unknown_columns.items()}


def quality_counts(unknown_columns: dict[str, str] | None = None) -> list[Column]:
    """The rows looked at and the bad ones, as aggregates."""
    checks = quality_checks(unknown_columns)
    return [F.count(F.lit(1)).alias("rows_checked"),
            *[F.count_if(bad).alias(name) for name, bad in checks.items()]]


def quality_report(df: DataFrame, unknown_columns: dict[str, str] | None = None) -> DataFrame:
    """One row of counts over repaired rows, before the validity filter.

    Copies are the rows beyond the first of each id; only the ids are shuffled for them.
    """
    checks = quality_checks(unknown_columns)
    per_id = df.groupBy("transaction_id").agg((F.count(F.lit(1)) - 1).alias("_copies"))
    copies = per_id.agg(F.coalesce(F.sum("_copies"), F.lit(0)).alias("duplicates"))
    return df.agg(*quality_counts(unknown_columns)).select("rows_checked", copies.scalar().alias("duplicates"), *checks)


def quality_long(report: DataFrame, rows: str = "rows_checked") -> DataFrame:
    """The one-row report as rows of (check, bad_rows, rate)."""
    checks = [name for name in report.columns if name != rows]
    long = report.unpivot([rows], checks, "check", "bad_rows")
    share = F.try_divide(F.col("bad_rows").cast("double"), F.col(rows).cast("double"))
    return long.select("check", "bad_rows", share.alias("rate"))

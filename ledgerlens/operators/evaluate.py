"""Metrics of a binary prediction and the table of runs. No arithmetic on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import rate

WEEK = 604800
F1 = "test_f1_score"
METRICS = ["precision", "recall", "f1_score", "avg_fp_per_week"]


def confusion(df: DataFrame, label: str = "tx_fraud", prediction: str = "prediction"):
    """Counts per label (rows) and predicted class (columns), 0 where there are none."""
    counts = df.groupBy(label).pivot(prediction, [0.0, 1.0]).agg(F.count(F.lit(1)))
    renamed = counts.withColumnsRenamed({"0.0": "predicted_0", "1.0": "predicted_1"})
    return renamed.na.fill(0)


def _or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def binary_metrics(
    df: DataFrame,
    label: str = "tx_fraud",
    prediction: str = "prediction",
    time: str = "unix_time",
    by: list[str] | None = None,
    negatives: bool = False,
) -> DataFrame:
    """Counts, precision, recall, F1 and false alarms per week in one aggregation.

    Ratios without a denominator are 0. ``by`` gives one row per group, such as split;
    ``negatives`` adds the true negatives, with which the counts are a confusion matrix.
    """
    flagged, fraud = F.col(prediction) == 1, F.col(label) == 1
    counted = df.groupBy(*(by or [])).agg(
        F.count_if(flagged & fraud).alias("tp"),
        F.count_if(flagged & (F.col(label) == 0)).alias("fp"),
        F.count_if((F.col(prediction) == 0) & fraud).alias("fn"),
        F.count_if((F.col(prediction) == 0) & (F.col(label) == 0)).alias("tn"),
        (F.max(time) - F.min(time)).alias("_span"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    weeks = F.col("_span").cast("double") / WEEK
    return counted.select(
        *(by or []),
        "tp",
        "fp",
        "fn",
        *(["tn"] if negatives else []),
        rate(tp, tp + fp).alias("precision"),
        rate(tp, tp + fn).alias("recall"),
        # 2pr / (p + r) with the common factors removed
        rate(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
        _or_zero(F.try_divide(fp.cast("double"), weeks)).alias("avg_fp_per_week"),
    )


def run_rows(metrics: DataFrame, by: list[str], prefix: str = "") -> DataFrame:
    """Metrics as rows (run columns, metric, value) of the runs table."""
    named = metrics.select(*by, *[F.col(m).cast("double").alias(prefix + m) for m in METRICS])
    return named.unpivot(by, [prefix + m for m in METRICS], "metric", "value")


def runs_with(runs: DataFrame, metric: str = F1) -> DataFrame:
    """One row per run with one metric, null where the run lacks it."""
    value = F.max(F.when(F.col("metric") == metric, F.col("value"))).alias(metric)
    return runs.groupBy("run_number", "run_name").agg(value)


def best_run(runs: DataFrame, metric: str = F1) -> DataFrame:
    """The run with the highest metric; the earlier one of equals."""
    return runs_with(runs, metric).orderBy(F.desc_nulls_last(metric), "run_number").limit(1)


def next_run_number(runs: DataFrame) -> DataFrame:
    number = (F.count_distinct("run_number") + 1).cast("int")
    return runs.agg(number.alias("run_number"))


def champions(runs: DataFrame, metric: str = F1) -> DataFrame:
    """For every run: did it beat all runs before it? No earlier value counts as 0.

    The runs table has one row per training and metric, so the window is small.
    """
    earlier = Window.orderBy("run_number").rowsBetween(Window.unboundedPreceding, -1)
    table = runs_with(runs, metric)
    best_before = _or_zero(F.max(metric).over(earlier))
    return table.withColumn("best_before", best_before).withColumn(
        "is_champion", F.coalesce(F.col(metric) > F.col("best_before"), F.lit(False)).cast("int")
    )

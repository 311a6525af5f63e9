"""The batch jobs as functions from paths to paths."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import epoch_seconds
from ledgerlens.operators import evaluate, known_ids, model
from ledgerlens.operators.buckets import rolling_bucketed
from ledgerlens.operators.derive import (
    add_ratios,
    add_risk,
    add_risk_after_delay,
    add_row_features,
    after_warmup,
    own_value_where_missing,
)
from ledgerlens.operators.frames import rolling
from ledgerlens.operators.quality import (
    clean_transactions,
    quality_counts,
    quality_report,
    repair_time,
    repair_unknown,
)
from ledgerlens.operators.skew import DEFAULT_RULE, HotRule
from ledgerlens.plans import presets
from ledgerlens.session import claim_file, cut_lineage, folder_exists, work_space
from ledgerlens.sources import readers, sinks

TIME = "unix_time"
# The folder column of tables that are kept by day.
DAY = "tx_date"
# The longest frame and the bucket in which it begins, in whole days.
LOOK_BACK_DAYS = 31


def sum_csv(spark: SparkSession, source: str, target: str) -> None:
    """Total of the column ``field`` of all CSV files under ``source``."""
    sinks.write_sum(readers.read_csv(spark, source, "field INT"), "field", target)


def clean(
    spark: SparkSession, source: str, target: str, report: bool = False, dedup_first: bool = True,
    by_day: bool = False,
) -> dict[str, int] | None:
    """Raw CSV to clean Parquet; optionally returns the data-quality counts.

    The counts are observed while the rows are written, so the report reads nothing again
    and keeps nothing; only with ``dedup_first=False`` are copies counted in a pass of their
    own. ``by_day`` keeps the output in folders by day.
    """
    files = sinks.planned_files(spark, source, target_mb=512, compression=3)
    lines, checks, copies = Observation(), Observation(), Observation()
    raw = readers.read_raw(spark, source)
    if report:
        raw = raw.observe(lines, *readers.corrupt_counts())
    repaired = repair_time(repair_unknown(readers.well_formed(raw)))
    if report:
        repaired = repaired.observe(checks, *quality_counts())
    watched = copies if report and dedup_first else None
    cleaned = clean_transactions(repaired, ["tx_datetime"], dedup_first, watched)
    if by_day:
        cleaned = cleaned.withColumn(DAY, F.to_date("tx_datetime"))
    sinks.write_parquet(cleaned, target, files, [DAY] if by_day else None)
    if not report:
        return None
    counts = lines.get | checks.get
    if watched is not None:
        return counts | copies.get
    again = repair_time(repair_unknown(readers.well_formed(readers.read_raw(spark, source))))
    return counts | {"duplicates": quality_report(again).first()["duplicates"]}


def clean_run(
    spark: SparkSession, source: str, target: str, run: str, dedup_first: bool = True
) -> None:
    """Raw CSV of one run into clean folders by day and run, without ids of earlier runs.

    An id that another run has written stays as it is there. Of earlier runs the index of
    their ids is read (kept under ``_ids``), and of their rows the ids of those days in which
    the index lets any id through. The index of a run is written before its rows: should the
    run fail in between, the index only lets through too much. A run that is repeated looks
    at the others only and replaces its own folders.
    """
    index_path = f"{target.rstrip('/')}/_ids"
    with work_space(spark):
        repaired = repair_time(repair_unknown(readers.well_formed(
            readers.read_raw(spark, source))))
        cleaned = clean_transactions(repaired, ["tx_datetime"], dedup_first)
        rows = cut_lineage(cleaned.withColumn(DAY, F.to_date("tx_datetime")), "clean-run")
        if folder_exists(spark, index_path):
            others = F.col("run") != run
            index = spark.read.schema(known_ids.SCHEMA).parquet(index_path).filter(others)
            stored = readers.read_clean_by_run(spark, target).filter(others)
            rows = cut_lineage(
                known_ids.without_known(rows, "transaction_id", index, stored, DAY), "new-rows")
        named = F.lit(run).alias("run")
        sinks.write_parquet(
            known_ids.index_rows(rows, "transaction_id", DAY).select("*", named), index_path,
            None, ["run"])
        sinks.write_parquet(rows.select("*", named), target, None, [DAY, "run"])


def feature_table(
    transactions: DataFrame,
    warmup: int = presets.MONTH,
    fixed: bool = False,
    rule: HotRule | None = DEFAULT_RULE,
    start: DataFrame | None = None,
) -> DataFrame:
    """The 54-column feature table of clean transactions.

    Customer and pair features come first, in one shuffle by customer. Their result is
    written to the shared folder, because the terminal features read it several times. The
    warm-up begins with the first of the transactions, or of ``start`` where they are only
    the last ones of a table.
    """
    base = timed(transactions)
    groups = [presets.customer_group(), presets.pair_group()]
    by_customer = cut_lineage(rolling(base, TIME, groups, rule), "customer-features")
    by_terminal = rolling_bucketed(
        by_customer, ["terminal_id"], TIME, presets.BUCKET, presets.terminal_specs(fixed), rule
    )
    complete = add_risk(by_terminal, presets.risk_pairs(list(presets.FRAUD)))
    begun = base if start is None else timed(start)
    return after_warmup(complete, begun, TIME, warmup).select(*presets.feature_columns())


def timed(transactions: DataFrame) -> DataFrame:
    return transactions.withColumns({
        TIME: epoch_seconds(transactions, "tx_datetime"),
        presets.LABEL: F.col(presets.LABEL).cast("int"),
    })


def explore_table(
    transactions: DataFrame,
    warmup: int = presets.WEEK + presets.HOUR,
    fixed: bool = False,
    rule: HotRule | None = DEFAULT_RULE,
) -> DataFrame:
    """The exploratory feature table: shorter frames, buckets of an hour, delayed risk.

    Customer and pair features are computed once and written, as in :func:`feature_table`.
    """
    base = timed(transactions)
    by_customer = cut_lineage(
        rolling(base, TIME, presets.explore_customer_groups(), rule), "explore-customer")
    wide = rolling_bucketed(
        by_customer, ["terminal_id"], TIME, presets.EXPLORE_BUCKET,
        presets.explore_terminal_specs(fixed), rule)
    filled = own_value_where_missing(wide, presets.EXPLORE_OWN)
    complete = add_risk_after_delay(
        filled, presets.risk_pairs(list(presets.EXPLORE_FRAUD)),
        presets.risk_pairs(list(presets.EXPLORE_DELAY))[0])
    return after_warmup(complete, base, TIME, warmup)


def features(
    spark: SparkSession, source: str, target: str, warmup: int = presets.MONTH,
    fixed: bool = False, by_day: bool = False, since: date | None = None,
) -> None:
    """Clean Parquet to the feature table; work tables are removed at the end.

    ``by_day`` keeps the output in folders by day. ``since`` computes the rows of that day
    and later only and replaces their folders; it reads the longest frame before them, and
    only those folders if the source is kept by day. The rows are those of the whole table:
    the warm-up begins where the source does.
    """
    files = sinks.planned_files(spark, source, target_mb=128, compression=0.2)
    transactions = readers.read_clean_by_day(spark, source) if by_day else (
        readers.read_clean(spark, source))
    start = None
    if since is not None:
        start, transactions = first_rows_of(transactions), recent(transactions, since)
    with work_space(spark):
        table = feature_table(transactions, warmup, fixed, start=start)
        if by_day or since is not None:
            table = table.withColumn(DAY, F.to_date("tx_datetime"))
            if since is not None:
                table = table.filter(F.col(DAY) >= F.lit(since))
            sinks.write_parquet(table, target, None, [DAY])
        else:
            sinks.write_parquet(table, target, files)


def first_rows_of(transactions: DataFrame) -> DataFrame:
    """Rows among which the first one is: of a table by day those of its first folder."""
    if DAY not in transactions.columns:
        return transactions
    first = transactions.agg(F.min(DAY)).scalar()
    return transactions.filter(F.col(DAY) == first)


def recent(transactions: DataFrame, since: date) -> DataFrame:
    """Rows that the features of ``since`` and later look at."""
    begin = F.lit(since - timedelta(days=LOOK_BACK_DAYS))
    if DAY in transactions.columns:
        return transactions.filter(F.col(DAY) >= begin)
    return transactions.filter(F.to_date("tx_datetime") >= begin)


def training_table(table: DataFrame) -> DataFrame:
    """Feature table with row features, ratios instead of their bases, and no nulls."""
    wide = add_row_features(table)
    return add_ratios(wide, "tx_amount", presets.RATIO_BASES, drop_bases=True).na.fill(0)


def _known_runs(spark: SparkSession, path: str) -> DataFrame:
    """The runs table; empty if there is none yet. Any other failure is one."""
    schema = "run_number INT, run_name STRING, metric STRING, value DOUBLE"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _claimed_number(spark: SparkSession, runs: str) -> int:
    """The next number that no other training has claimed."""
    number = evaluate.next_run_number(_known_runs(spark, runs)).first()["run_number"]
    while not claim_file(spark, f"{runs.rstrip('/')}/_claims/run-{number}"):
        number += 1
    return number


def train(
    spark: SparkSession,
    source: str,
    models: str,
    runs: str,
    split_error: float = 0.01,
    **params,
) -> dict:
    """Feature table to a saved model, its list of inputs and rows in the runs table.

    Returns the run number, the paths, the confusion counts of the test rows and whether
    this run is the best so far. A run claims its number before it begins, so trainings at
    the same time get numbers of their own, and a number whose training has failed is not
    used again. A run counts from its rows in the runs table on: they are written last, into
    a folder of their own, by one file that is there or not. A model folder that no run
    accounts for is never overwritten.
    """
    return train_table(spark, training_table(readers.read_inferred(spark, source)), models, runs,
                       split_error, **params)


def train_table(
    spark: SparkSession, table: DataFrame, models: str, runs: str, split_error: float = 0.01,
    held_out: float = 0.0, **params,
) -> dict:
    """:func:`train` on a training table.

    With ``held_out`` that share of the training rows decides when boosting ends.
    """
    number = _claimed_number(spark, runs)
    path = f"{models.rstrip('/')}/run-{number}"
    if folder_exists(spark, path):
        raise FileExistsError(f"{path} exists, but run {number} is not in {runs}")

    inputs = model.model_inputs(table)
    split = model.add_time_split(table, TIME, 0.8, split_error)
    train_rows = split.filter(F.col("split") == "train")
    weighted = model.add_class_weight(train_rows)
    if held_out:
        weighted = model.add_validation(weighted, "transaction_id", held_out)
        params = {"validation": model.VALIDATION, **params}
    fitted = model.fitted(model.boosted_trees(inputs, **params), weighted)
    model.save_model(fitted, path)
    listed = spark.createDataFrame(list(enumerate(inputs)), "position INT, feature STRING")
    sinks.write_parquet(listed, f"{path}-inputs", files=1)

    scored = fitted.transform(split.filter(F.col("split").isNotNull()))
    # One row per split: metrics and confusion counts come from one pass over the scores.
    measured = evaluate.binary_metrics(scored, time=TIME, by=["split"], negatives=True).collect()
    run = spark.createDataFrame([
        {**row.asDict(), "run_number": number, "run_name": f"Fraud_Detection_v_{number}"}
        for row in measured
    ]).withColumn("run_number", F.col("run_number").cast("int"))
    long = evaluate.run_rows(run, ["split", "run_number", "run_name"]).select(
        "run_number", "run_name", F.concat_ws("_", "split", "metric").alias("metric"), "value"
    )
    long.drop("run_number").coalesce(1).write.parquet(
        f"{runs.rstrip('/')}/run_number={number}")
    history = evaluate.champions(_known_runs(spark, runs))
    latest = history.filter(F.col("run_number") == number).first()
    test = next((row for row in measured if row["split"] == "test"), None)
    confusion = [] if test is None else [
        {"tx_fraud": 0, "predicted_0": test["tn"], "predicted_1": test["fp"]},
        {"tx_fraud": 1, "predicted_0": test["fn"], "predicted_1": test["tp"]},
    ]
    return {
        "run_number": number,
        "model": path,
        "inputs": f"{path}-inputs",
        "confusion": confusion,
        "best": bool(latest["is_champion"]),
    }

"""Reading, repairing and writing."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views
from checks.registry import query
from ledgerlens import schema
from ledgerlens.functions.scalars import end_of_day_fix, epoch_seconds
from ledgerlens.operators import explore, quality
from ledgerlens.plans import jobs
from ledgerlens.session import work_folder
from ledgerlens.sources import readers, sinks

RAW = ", ".join(schema.RAW_COLUMNS)


def _lines_on_disk(spark, sf_dir):
    path = work_folder(spark, "lines")
    views.raw_lines(spark, sf_dir).write.text(path)
    return path


@query(f"""WITH {views.PARSED}
SELECT count(*) AS total_rows, cast(sum(CASE WHEN corrupt THEN 1 ELSE 0 END) AS bigint)
  AS corrupt_rows FROM parsed""")
def csv_corrupt_report(spark, sf_dir):
    return readers.corrupt_report(readers.read_raw(spark, _lines_on_disk(spark, sf_dir)))


@query(f"WITH {views.PARSED} SELECT {RAW} FROM parsed WHERE NOT corrupt")
def csv_clean_rows(spark, sf_dir):
    return readers.well_formed(readers.parse_rows(views.raw_lines(spark, sf_dir)))


_REPAIRED = """
  SELECT transaction_id, tx_datetime,
         CASE WHEN customer_id >= 0 THEN customer_id ELSE -1 END AS customer_id,
         CASE WHEN terminal_id >= 0 THEN terminal_id ELSE -1 END AS terminal_id"""

@query(f"WITH {views.DIRTY} {_REPAIRED}, src_id FROM dx")
def sentinel_repair(spark, sf_dir):
    repaired = quality.repair_unknown(
        views.tx_dirty(spark, sf_dir), ["customer_id", "terminal_id"]
    )
    return repaired.select("transaction_id", "tx_datetime", "customer_id", "terminal_id", "src_id")


@query(f"""WITH {views.DIRTY}
SELECT src_id, replace(tx_datetime, '24:00:00', '23:59:59') AS fixed_text,
       cast(epoch(try_cast(replace(tx_datetime, '24:00:00', '23:59:59') AS timestamp))
            AS bigint) AS unix_time
FROM dx""")
def midnight_fix(spark, sf_dir):
    fixed = views.tx_dirty(spark, sf_dir).withColumn("fixed_text", end_of_day_fix("tx_datetime"))
    timed = quality.repair_time(fixed)
    # Whole seconds of the wall clock, whatever the session zone is.
    wall = timed.withColumn("tx_datetime", F.col("tx_datetime").cast("timestamp_ntz"))
    return wall.select("src_id", "fixed_text", epoch_seconds(wall, "tx_datetime").alias("unix_time"))


_TIMED = """timed AS (SELECT * REPLACE (
    try_cast(replace(tx_datetime, '24:00:00', '23:59:59') AS timestamp) AS tx_datetime) FROM dx)"""
_VALID = "transaction_id >= 0 AND tx_datetime IS NOT NULL AND tx_amount >= 0 AND tx_fraud IN (0, 1)"


def _dirty_timed(spark, sf_dir):
    return quality.repair_time(views.tx_dirty(spark, sf_dir))


@query(f"""WITH {views.DIRTY}, {_TIMED}
SELECT transaction_id, tx_amount, tx_fraud, src_id FROM timed WHERE {_VALID}""")
def valid_rows(spark, sf_dir):
    kept = quality.keep_valid(_dirty_timed(spark, sf_dir))
    return kept.select("transaction_id", "tx_amount", "tx_fraud", "src_id")


@query(f"""WITH {views.DIRTY}, {_TIMED},
first AS (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY src_id) AS rn
          FROM timed)
SELECT transaction_id, tx_amount, tx_fraud = 1 AS tx_fraud, src_id
FROM first WHERE rn = 1 AND {_VALID}""")
def dedup_rows(spark, sf_dir):
    kept = quality.clean_transactions(_dirty_timed(spark, sf_dir), ["src_id"])
    return kept.select("transaction_id", "tx_amount", "tx_fraud", "src_id")


@query(f"""WITH {views.DIRTY}, {_TIMED},
first AS (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY src_id) AS rn
          FROM timed WHERE {_VALID})
SELECT transaction_id, tx_amount, tx_fraud = 1 AS tx_fraud, src_id FROM first WHERE rn = 1""")
def dedup_valid_first(spark, sf_dir):
    kept = quality.clean_transactions(_dirty_timed(spark, sf_dir), ["src_id"], dedup_first=False)
    return kept.select("transaction_id", "tx_amount", "tx_fraud", "src_id")


@query(f"""WITH {views.ORDERS},
first AS (SELECT *, row_number() OVER (PARTITION BY transaction_id
            ORDER BY unix_time, customer_id, terminal_id, cents, tx_fraud) AS rn FROM ox)
SELECT transaction_id, unix_time, customer_id, terminal_id, cents, tx_fraud
FROM first WHERE rn = 1""")
def dedup_orders(spark, sf_dir):
    columns = ["transaction_id", "unix_time", "customer_id", "terminal_id", "cents", "tx_fraud"]
    rows = views.tx_orders(spark, sf_dir).select(*columns)
    return quality.first_of_each(rows, ["transaction_id"], columns[1:])


_REPORT = f"""WITH {views.DIRTY}, {_TIMED},
ranked AS (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY src_id) AS rn
           FROM timed),
report AS (
SELECT count(*) AS rows_checked,
       count(*) FILTER (rn > 1) AS duplicates,
       count(*) FILTER ((transaction_id >= 0) IS NOT TRUE) AS bad_transaction_id,
       count(*) FILTER (tx_datetime IS NULL) AS bad_tx_datetime,
       count(*) FILTER ((tx_amount >= 0) IS NOT TRUE) AS bad_tx_amount,
       count(*) FILTER ((tx_fraud IN (0, 1)) IS NOT TRUE) AS bad_tx_fraud,
       count(*) FILTER ((customer_id >= 0) IS NOT TRUE) AS bad_customer_id,
       count(*) FILTER ((terminal_id >= 0) IS NOT TRUE) AS bad_terminal_id
FROM ranked)"""


def _report(spark, sf_dir):
    repaired = quality.repair_unknown(_dirty_timed(spark, sf_dir), ["customer_id", "terminal_id"])
    names = {"bad_customer_id": "customer_id", "bad_terminal_id": "terminal_id"}
    return quality.quality_report(repaired, names)


@query(f"{_REPORT} SELECT * FROM report")
def dq_report(spark, sf_dir):
    return _report(spark, sf_dir)


@query(f"""{_REPORT}
SELECT "check", bad_rows, bad_rows::double / rows_checked::double AS rate
FROM report UNPIVOT (bad_rows FOR "check" IN (duplicates, bad_transaction_id, bad_tx_datetime,
  bad_tx_amount, bad_tx_fraud, bad_customer_id, bad_terminal_id))""")
def dq_report_long(spark, sf_dir):
    return quality.quality_long(_report(spark, sf_dir))


@query(f"""WITH {views.PARSED},
timed AS (SELECT * REPLACE (
    try_cast(replace(tx_datetime, '24:00:00', '23:59:59') AS timestamp) AS tx_datetime)
  FROM parsed WHERE NOT corrupt),
repaired AS (
  SELECT transaction_id, tx_datetime,
         CASE WHEN customer_id >= 0 THEN customer_id ELSE -1 END AS customer_id,
         CASE WHEN terminal_id >= 0 THEN terminal_id ELSE -1 END AS terminal_id,
         tx_amount, tx_fraud,
         CASE WHEN tx_time_seconds >= 0 THEN tx_time_seconds ELSE -1 END AS tx_time_seconds,
         CASE WHEN tx_time_days >= 0 THEN tx_time_days ELSE -1 END AS tx_time_days,
         CASE WHEN tx_fraud_scenario >= 0 THEN tx_fraud_scenario ELSE -1 END AS tx_fraud_scenario
  FROM timed),
first AS (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY tx_datetime NULLS FIRST,
    customer_id, terminal_id, tx_amount, tx_time_seconds, tx_time_days, tx_fraud,
    tx_fraud_scenario) AS rn FROM repaired)
SELECT transaction_id, cast(epoch(tx_datetime) AS bigint) AS unix_time, customer_id, terminal_id,
       tx_amount, tx_time_seconds, tx_time_days, tx_fraud = 1 AS tx_fraud, tx_fraud_scenario
FROM first WHERE rn = 1 AND {_VALID}""")
def clean_job(spark, sf_dir):
    target = work_folder(spark, "clean")
    jobs.clean(spark, _lines_on_disk(spark, sf_dir), target)
    cleaned = readers.read_clean(spark, target)
    wall = cleaned.withColumn("tx_datetime", F.col("tx_datetime").cast("timestamp_ntz"))
    return wall.select(
        "transaction_id", epoch_seconds(wall, "tx_datetime").alias("unix_time"),
        *schema.RAW_COLUMNS[2:],
    )


@query("SELECT cast(sum(event_id) AS bigint) AS result FROM events")
def ddl_scan_sum(spark, sf_dir):
    source, target = work_folder(spark, "fields"), work_folder(spark, "sum")
    events = views.table(spark, sf_dir, "events")
    fields = events.select(F.concat(F.when(F.col("event_id") % 9 == 5, F.lit("# skipped\n"))
                                    .otherwise(""), F.col("event_id").cast("string")))
    fields.write.text(source)
    jobs.sum_csv(spark, f"{source}/*.txt", target)
    return spark.read.parquet(target)


@query("SELECT cast(sum(round(value * 100)) AS bigint) AS result FROM events")
def scalar_sink(spark, sf_dir):
    target = work_folder(spark, "scalar")
    sinks.write_sum(views.tx_events(spark, sf_dir), "cents", target)
    return spark.read.parquet(target)


_STORED = f"""WITH {views.TX} SELECT transaction_id, unix_time, customer_id, terminal_id,
 tx_amount, tx_fraud = 1 AS tx_fraud FROM tx"""


def _stored(spark, sf_dir):
    tx = views.tx_events(spark, sf_dir)
    return tx.select("transaction_id", "unix_time", "customer_id", "terminal_id", "tx_amount",
                     F.col("tx_fraud").cast("boolean").alias("tx_fraud"))


@query(f"""WITH {views.TX} SELECT transaction_id, cast(customer_id AS int) AS customer_id,
 terminal_id, tx_amount, tx_fraud = 1 AS tx_fraud FROM tx""")
def parquet_scan(spark, sf_dir):
    path = work_folder(spark, "clean-shape")
    tx = views.tx_events(spark, sf_dir).withColumns({
        "tx_datetime": F.col("tx_datetime").cast("timestamp"),
        "customer_id": F.col("customer_id").cast("int"),
        "tx_fraud": F.col("tx_fraud").cast("boolean"),
    })
    sinks.write_parquet(tx.select(*schema.RAW_COLUMNS), path)
    return readers.read_clean(spark, path).select(
        "transaction_id", "customer_id", "terminal_id", "tx_amount", "tx_fraud"
    )


@query(_STORED)
def parquet_roundtrip(spark, sf_dir):
    path = work_folder(spark, "roundtrip")
    sinks.write_parquet(_stored(spark, sf_dir), path, files=4)
    return readers.read_inferred(spark, path)


def _top_sql(key):
    return f"""{key} IN (SELECT {key} FROM tx WHERE tx_fraud = 1 GROUP BY {key}
 ORDER BY count(*) DESC, {key} LIMIT 6)"""


@query(f"{_STORED} WHERE {_top_sql('customer_id')} OR {_top_sql('terminal_id')}")
def one_file_export(spark, sf_dir):
    """All rows of the six customers and six terminals with the most fraud, as one file."""
    path = work_folder(spark, "export")
    rows = _stored(spark, sf_dir)
    chosen = {
        key: [row[key] for row in explore.top_by_count(rows, [key], 6, F.col("tx_fraud")).collect()]
        for key in ("customer_id", "terminal_id")
    }
    sinks.export_rows(explore.rows_of(rows, chosen), path)
    return readers.read_inferred(spark, path)


@query(_STORED)
def saved_table(spark, sf_dir):
    path = work_folder(spark, "table")
    name = "ledgerlens_" + path.rsplit("-", 1)[1]
    sinks.save_table(_stored(spark, sf_dir), name, path)
    return spark.table(name)


@query(f"""WITH sized AS (SELECT sum(octet_length(encode(value)) + 1) AS size
  FROM ({views.LINES_SELECT}) AS written)
SELECT cast(3 AS bigint) AS files_in, cast(size AS bigint) AS bytes_in,
 cast(greatest(1, ceil(size / 3.0 / 1048576 / 0.05)) AS int) AS files_out FROM sized""")
def output_files(spark, sf_dir):
    """How many files of 0.05 MB the raw lines make, from the sizes of the files they are in."""
    path = work_folder(spark, "sized")
    views.raw_lines(spark, sf_dir).repartition(3).write.text(path)
    return sinks.file_plan(spark, path, target_mb=0.05, compression=3)


# Raw lines among which some amounts are no finite numbers.
_ODD_LINES = views.LINES_SELECT.replace(
    "cast(cast(value AS decimal(12, 2)) AS varchar(20)) AS amount",
    """CASE WHEN event_id % 53 = 9 THEN 'NaN' WHEN event_id % 59 = 10 THEN 'Infinity'
                ELSE cast(cast(value AS decimal(12, 2)) AS varchar(20)) END AS amount""")
_ODD = f"""{views.PARSED.replace(views.LINES_SELECT, _ODD_LINES)},
timed AS (SELECT * REPLACE (
    try_cast(replace(tx_datetime, '24:00:00', '23:59:59') AS timestamp) AS tx_datetime)
  FROM parsed WHERE NOT corrupt),
ranked AS (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY tx_datetime NULLS FIRST,
    coalesce(customer_id, -1), coalesce(terminal_id, -1), tx_amount) AS rn FROM timed)"""
_AMOUNT_OK = "tx_amount >= 0 AND tx_amount < 'Infinity'::double"


def _odd_lines(spark, sf_dir):
    path = work_folder(spark, "odd-lines")
    views.select_from(spark, sf_dir, _ODD_LINES).write.text(path)
    return path


@query(f"""WITH {_ODD} SELECT (SELECT count(*) FROM parsed) AS total_rows,
 (SELECT count(*) FROM parsed WHERE corrupt) AS corrupt_rows, count(*) AS rows_checked,
 count(*) FILTER (rn > 1) AS duplicates,
 count(*) FILTER ((transaction_id >= 0) IS NOT TRUE) AS bad_transaction_id,
 count(*) FILTER (tx_datetime IS NULL) AS bad_tx_datetime,
 count(*) FILTER (({_AMOUNT_OK}) IS NOT TRUE) AS bad_tx_amount,
 count(*) FILTER ((tx_fraud IN (0, 1)) IS NOT TRUE) AS bad_tx_fraud,
 count(*) FILTER ((customer_id >= 0) IS NOT TRUE) AS bad_customer_id,
 count(*) FILTER ((terminal_id >= 0) IS NOT TRUE) AS bad_terminal_id,
 count(*) FILTER ((tx_time_seconds >= 0) IS NOT TRUE) AS bad_tx_time_seconds,
 count(*) FILTER ((tx_time_days >= 0) IS NOT TRUE) AS bad_tx_time_days,
 count(*) FILTER ((tx_fraud_scenario >= 0) IS NOT TRUE) AS bad_scenario_id FROM ranked""")
def clean_report(spark, sf_dir):
    """All counts of the cleaning job, observed while it writes."""
    counts = jobs.clean(spark, _odd_lines(spark, sf_dir), work_folder(spark, "clean"), report=True)
    return spark.createDataFrame([counts], ", ".join(f"{name} BIGINT" for name in counts))


@query(f"""WITH {_ODD} SELECT transaction_id, tx_amount, tx_fraud = 1 AS tx_fraud
FROM ranked WHERE rn = 1 AND transaction_id >= 0 AND tx_datetime IS NOT NULL AND {_AMOUNT_OK}
 AND tx_fraud IN (0, 1)""")
def clean_finite(spark, sf_dir):
    """Rows with NaN or infinite amounts are not valid."""
    target = work_folder(spark, "clean")
    jobs.clean(spark, _odd_lines(spark, sf_dir), target)
    return readers.read_clean(spark, target).select("transaction_id", "tx_amount", "tx_fraud")


@query(f"""WITH {views.TX} SELECT transaction_id, unix_time, tx_fraud,
 tx_fraud = 1 AS is_fraud FROM tx""")
def epoch_label_casts(spark, sf_dir):
    tx = views.tx_events(spark, sf_dir)
    labelled = tx.withColumn("is_fraud", F.col("tx_fraud").cast("boolean"))
    return labelled.select("transaction_id", "unix_time", F.col("is_fraud").cast("int")
                           .alias("tx_fraud"), "is_fraud")


# Lines of 28 days, in two runs: the first half of the lines, and all of them once more.
_DAYS = """'2024-01-' || lpad(cast(event_id % 28 + 1 AS varchar(20)), 2, '0') || ' 12:00:00'"""
_BOTH_RUNS = views.LINES_SELECT.replace("'2024-01-15 12:00:00'", _DAYS)
_FIRST_RUN = _BOTH_RUNS + " WHERE 2 * event_id < (SELECT max(event_id) FROM events)"


def _survivors(lines: str) -> str:
    return f"""WITH {views.PARSED.replace(views.LINES_SELECT, lines)},
timed AS (SELECT * REPLACE (
    try_cast(replace(tx_datetime, '24:00:00', '23:59:59') AS timestamp) AS tx_datetime)
  FROM parsed WHERE NOT corrupt),
ranked AS (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY tx_datetime NULLS FIRST,
    coalesce(customer_id, -1), coalesce(terminal_id, -1), tx_amount) AS rn FROM timed)
SELECT transaction_id, tx_amount, tx_fraud = 1 AS tx_fraud,
 cast(cast(tx_datetime AS date) AS varchar) AS tx_date FROM ranked WHERE rn = 1 AND transaction_id >= 0 AND tx_datetime IS NOT NULL AND {_AMOUNT_OK}
 AND tx_fraud IN (0, 1)"""


@query(f"""WITH one AS ({_survivors(_FIRST_RUN)}), two AS ({_survivors(_BOTH_RUNS)})
SELECT *, 'one' AS run FROM one UNION ALL
SELECT *, 'two' AS run FROM two WHERE transaction_id NOT IN (SELECT transaction_id FROM one)""")
def clean_runs(spark, sf_dir):
    """Two runs that share ids."""
    target = work_folder(spark, "clean-runs")
    for run, lines in (("one", _FIRST_RUN), ("two", _BOTH_RUNS)):
        path = work_folder(spark, f"lines-{run}")
        views.select_from(spark, sf_dir, lines).write.text(path)
        jobs.clean_run(spark, path, target, run)
    return readers.read_clean_by_run(spark, target).select(
        "transaction_id", "tx_amount", "tx_fraud", F.col("tx_date").cast("string"), "run")

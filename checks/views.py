"""The given tables in the shape of transactions, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import epoch_seconds

# First second of the events, as seconds since 1970 (2024-01-01).
ORIGIN = 1704067200

TX = f"""tx AS (
  SELECT event_id AS transaction_id, ts AS tx_datetime,
         cast(floor(epoch(ts)) AS bigint) AS unix_time,
         user_id AS customer_id,
         cast(json_extract(props, '$.k') AS int) AS terminal_id,
         value AS tx_amount,
         cast(round(value * 100) AS bigint) AS cents,
         cast(cast(floor(epoch(ts)) AS bigint) - {ORIGIN} AS int) AS tx_time_seconds,
         cast((cast(floor(epoch(ts)) AS bigint) - {ORIGIN}) // 86400 AS int) AS tx_time_days,
         cast(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS int) AS tx_fraud,
         cast(CASE WHEN event_type = 'error' THEN event_id % 3 + 1 ELSE 0 END AS int)
           AS tx_fraud_scenario
  FROM events)"""

ORDERS = """ox AS (
  SELECT l_orderkey * 8 + l_linenumber AS transaction_id, l_shipdate AS tx_datetime,
         cast(floor(epoch(l_shipdate)) AS bigint) AS unix_time,
         cast(o_custkey AS int) AS customer_id, cast(l_suppkey AS int) AS terminal_id,
         l_extendedprice AS tx_amount,
         cast(round(l_extendedprice * 100) AS bigint) AS cents,
         cast(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS int) AS tx_fraud
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

# The same text runs in both engines.
DIRTY_SELECT = """
SELECT CASE WHEN event_id % 41 = 0 THEN -event_id WHEN event_id % 43 = 0 THEN NULL
            WHEN event_id % 10 = 9 THEN event_id - 1 ELSE event_id END AS transaction_id,
       CASE WHEN event_id % 23 = 0 THEN '2024-01-15 24:00:00' WHEN event_id % 29 = 0 THEN 'n/a'
            ELSE '2024-01-15 12:00:00' END AS tx_datetime,
       CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN -5
            ELSE cast(user_id AS int) END AS customer_id,
       CASE WHEN event_id % 13 = 0 THEN -1 ELSE cast(event_id % 100 AS int) END AS terminal_id,
       CASE WHEN event_id % 31 = 0 THEN -value WHEN event_id % 37 = 0 THEN NULL
            ELSE value END AS tx_amount,
       CASE WHEN event_id % 47 = 0 THEN 7 WHEN event_type = 'error' THEN 1 ELSE 0 END AS tx_fraud,
       event_id AS src_id
FROM events"""
DIRTY = f"dx AS ({DIRTY_SELECT})"

# Raw lines with planted defects: text for a number, missing and extra fields, a number
# out of range, comments, empty lines, copies, and clock values of 24:00:00.
LINES_SELECT = """
SELECT CASE
         WHEN event_id % 23 = 7 THEN '# event ' || cast(event_id AS varchar(20))
         WHEN event_id % 29 = 8 THEN ''
         WHEN event_id % 13 = 4 THEN id || ',' || clock || ',' || customer
         WHEN event_id % 17 = 5 THEN body || ',extra'
         ELSE body END AS value
FROM (
  SELECT event_id, id, clock, customer,
         id || ',' || clock || ',' || customer || ',' || terminal || ',' || amount || ','
           || cast(event_id % 86400 AS varchar(20)) || ',' || cast(event_id % 30 AS varchar(20))
           || ',' || label || ',' || cast(event_id % 4 - 1 AS varchar(20)) AS body
  FROM (
    SELECT event_id,
           cast(CASE WHEN event_id % 10 = 9 THEN event_id - 1 ELSE event_id END
                AS varchar(20)) AS id,
           CASE WHEN event_id % 31 = 0 THEN '2024-01-15 24:00:00'
                WHEN event_id % 37 = 0 THEN 'n/a' ELSE '2024-01-15 12:00:00' END AS clock,
           CASE WHEN event_id % 19 = 6 THEN '99999999999' WHEN event_id % 41 = 1 THEN ''
                WHEN event_id % 43 = 2 THEN '-7' ELSE cast(user_id AS varchar(20)) END AS customer,
           CASE WHEN event_id % 11 = 3 THEN 'Err'
                ELSE cast(event_id % 100 AS varchar(20)) END AS terminal,
           cast(cast(value AS decimal(12, 2)) AS varchar(20)) AS amount,
           CASE WHEN event_id % 47 = 0 THEN '7' WHEN event_type = 'error' THEN '1'
                ELSE '0' END AS label
    FROM events) AS fields) AS bodies"""

# What a line says, read in SQL: NULL where a field is empty, corrupt where the number of
# fields is wrong or a field is not a number of its type.
PARSED = f"""lines AS ({LINES_SELECT}),
cut AS (SELECT value, string_split(value, ',') AS f FROM lines
        WHERE trim(value) <> '' AND NOT starts_with(value, '#')),
parsed AS (
  SELECT value,
         try_cast(nullif(f[1], '') AS bigint) AS transaction_id,
         nullif(f[2], '') AS tx_datetime,
         try_cast(nullif(f[3], '') AS int) AS customer_id,
         try_cast(nullif(f[4], '') AS int) AS terminal_id,
         try_cast(nullif(f[5], '') AS double) AS tx_amount,
         try_cast(nullif(f[6], '') AS int) AS tx_time_seconds,
         try_cast(nullif(f[7], '') AS int) AS tx_time_days,
         try_cast(nullif(f[8], '') AS int) AS tx_fraud,
         try_cast(nullif(f[9], '') AS int) AS tx_fraud_scenario,
         len(f) <> 9
           OR (f[1] <> '' AND try_cast(f[1] AS bigint) IS NULL)
           OR (f[3] <> '' AND try_cast(f[3] AS int) IS NULL)
           OR (f[4] <> '' AND try_cast(f[4] AS int) IS NULL)
           OR (f[5] <> '' AND try_cast(f[5] AS double) IS NULL) AS corrupt
  FROM cut)"""

# Planted predictions, the same in both engines.
PREDICTION = "CASE WHEN transaction_id % 7 < 2 THEN 1.0 ELSE 0.0 END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def select_from(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(text.replace("FROM events", "FROM {events}"),
                     events=table(spark, sf_dir, "events"))


def tx_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    fraud = F.col("event_type") == "error"
    timed = events.withColumn("unix_time", epoch_seconds(events, "ts"))
    seconds = F.col("unix_time") - ORIGIN
    days = (seconds - F.pmod(seconds, F.lit(86400))) / 86400
    return timed.select(
        F.col("event_id").alias("transaction_id"),
        F.col("ts").alias("tx_datetime"),
        "unix_time",
        F.col("user_id").alias("customer_id"),
        F.get_json_object("props", "$.k").cast("int").alias("terminal_id"),
        F.col("value").alias("tx_amount"),
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
        seconds.cast("int").alias("tx_time_seconds"),
        days.cast("int").alias("tx_time_days"),
        F.when(fraud, 1).otherwise(0).alias("tx_fraud"),
        F.when(fraud, F.col("event_id") % 3 + 1).otherwise(0).cast("int").alias(
            "tx_fraud_scenario"
        ),
    )


def tx_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    timed = lines.withColumn("unix_time", epoch_seconds(lines, "l_shipdate"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return timed.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("transaction_id"),
        F.col("l_shipdate").alias("tx_datetime"),
        "unix_time",
        F.col("o_custkey").cast("int").alias("customer_id"),
        F.col("l_suppkey").cast("int").alias("terminal_id"),
        F.col("l_extendedprice").alias("tx_amount"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("tx_fraud"),
    )


def tx_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_from(spark, sf_dir, DIRTY_SELECT)


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_from(spark, sf_dir, LINES_SELECT)


def with_prediction(df: DataFrame) -> DataFrame:
    return df.withColumn("prediction", F.expr(PREDICTION).cast("double"))

"""Row-level features, ratios, filters and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import literals, sqltext, views
from checks.registry import query
from checks.windows import FEATURES_SQL, WARMUP, _items, transactions
from ledgerlens.functions.scalars import interval_seconds
from ledgerlens.operators import derive, frames, model
from ledgerlens.operators.frames import Group, Request
from ledgerlens.operators.quality import repair_unknown
from ledgerlens.plans import jobs, presets

TIME = "unix_time"
EIGHT = literals.RATIO_BASES


def _ratio(base: str, value: str = "tx_amount") -> str:
    whole = f"(CASE WHEN {base} <> 0 THEN {base} ELSE {value} END)"
    return f"{value} / nullif({whole}, 0) AS ratio_{base}"


_BASES = {"7d_hist": literals.CUSTOMER_HISTORY["7d_hist"]}
_BASE_ITEMS = sqltext.row_frames("customer_id", _BASES, ["avg", "std"], "{target}_{agg}_cust_{frame}")
_BASE_NAMES = ["tx_amount_avg_cust_7d_hist", "tx_amount_std_cust_7d_hist"]


@query(f"""WITH {views.TX}, based AS (SELECT *, {_items(_BASE_ITEMS)} FROM tx)
SELECT transaction_id, {", ".join(_BASE_NAMES)}, {_items([_ratio(b) for b in _BASE_NAMES])}
FROM based""")
def ratio_existing(spark, sf_dir):
    bases = {"7d_hist": presets.CUSTOMER_HISTORY["7d_hist"]}
    request = Request("tx_amount", frames.frames(bases), {"avg", "std"},
                      "{target}_{agg}_cust_{frame}")
    based = frames.rolling(views.tx_events(spark, sf_dir), TIME,
                           [Group(("customer_id",), (request,))])
    wide = derive.add_ratios(based, "tx_amount", _BASE_NAMES)
    return wide.select("transaction_id", *_BASE_NAMES, *[f"ratio_{b}" for b in _BASE_NAMES])


_FRESH = {"7d": (-literals.WEEK, -1), "1d": (-literals.DAY, -1)}
_FRESH_ITEMS = sqltext.row_frames("terminal_id", _FRESH, ["cn", "avg", "std"],
                                  "{target}_{agg}_{frame}")
_FRESH_NAMES = [f"tx_amount_{agg}_{frame}" for frame in _FRESH for agg in ("cn", "avg", "std")]


@query(f"""WITH {views.TX}, based AS (SELECT *, {_items(_FRESH_ITEMS)} FROM tx)
SELECT transaction_id, {_items([_ratio(b) for b in _FRESH_NAMES])} FROM based""")
def ratio_fresh(spark, sf_dir):
    request = Request("tx_amount", frames.frames(_FRESH), {"count", "avg", "std"})
    wide = frames.ratio_over_frames(views.tx_events(spark, sf_dir), TIME,
                                    Group(("terminal_id",), (request,)))
    return wide.select("transaction_id", *[f"ratio_{b}" for b in _FRESH_NAMES])


_CALENDAR = """cast(hour(tx_datetime) AS int) AS hour,
 cast(CASE WHEN hour(tx_datetime) < 6 THEN 1 ELSE 0 END AS int) AS is_night,
 cast(dayofweek(tx_datetime) + 1 AS int) AS day_of_week,
 cast(CASE WHEN dayofweek(tx_datetime) IN (0, 6) THEN 1 ELSE 0 END AS int) AS is_weekend"""


@query(f"WITH {views.TX} SELECT transaction_id, {_CALENDAR} FROM tx")
def calendar_flags(spark, sf_dir):
    wide = derive.add_calendar(views.tx_events(spark, sf_dir))
    return wide.select("transaction_id", "hour", "is_night", "day_of_week", "is_weekend")


def _circle(function: str, value: str, period: int, name: str) -> str:
    # Adding 0.0 turns a rounded -0.0 into 0.0.
    return f"round({function}(2 * pi() * {value} / {period}), 9) + 0.0::double AS {name}"


CIRCLE = {"hour_sin": ("sin", "hour", 24), "hour_cos": ("cos", "hour", 24),
          "day_sin": ("sin", "day_of_week", 7), "day_cos": ("cos", "day_of_week", 7)}


@query(f"""WITH {views.TX}, cal AS (SELECT transaction_id, {_CALENDAR} FROM tx)
SELECT transaction_id, {_items([_circle(*spec, name) for name, spec in CIRCLE.items()])}
FROM cal""")
def cyclic(spark, sf_dir):
    wide = derive.add_cyclic(derive.add_calendar(views.tx_events(spark, sf_dir)))
    return wide.select("transaction_id", *[F.round(name, 9).alias(name) for name in CIRCLE])


@query(f"""WITH {views.TX}, whole AS (
  SELECT transaction_id, round(tx_amount) AS tx_amount FROM tx)
SELECT transaction_id, tx_amount,
 cast(CASE WHEN tx_amount % 100 = 0 OR tx_amount % 1000 = 0 THEN 1 ELSE 0 END AS int)
   AS is_rovn_sum FROM whole""")
def round_sum(spark, sf_dir):
    tx = views.tx_events(spark, sf_dir).withColumn("tx_amount", F.round("tx_amount"))
    return derive.add_round_flag(tx).select("transaction_id", "tx_amount", derive.ROUND_FLAG)


@query(f"""WITH {views.DIRTY}
SELECT src_id,
 cast(CASE WHEN coalesce(terminal_id, -1) < 0 THEN 1 ELSE 0 END AS int) AS is_unknonw_terminal,
 cast(CASE WHEN coalesce(customer_id, -1) < 0 THEN 1 ELSE 0 END AS int) AS is_unknonw_customer
FROM dx""")
def unknown_flags(spark, sf_dir):
    rows = repair_unknown(views.tx_dirty(spark, sf_dir), ["customer_id", "terminal_id"])
    flagged = derive.add_unknown_flags(rows)
    return flagged.select("src_id", derive.UNKNOWN_TERMINAL_FLAG, derive.UNKNOWN_CUSTOMER_FLAG)


@query(f"""WITH {views.DIRTY} SELECT src_id, coalesce(transaction_id, 0) AS transaction_id,
 coalesce(customer_id, 0) AS customer_id, coalesce(tx_amount, 0.0) AS tx_amount,
 nullif(tx_datetime, 'n/a') AS tx_datetime FROM dx""")
def fill_zero(spark, sf_dir):
    rows = views.tx_dirty(spark, sf_dir).select(
        "src_id", "transaction_id", "customer_id", "tx_amount",
        F.nullif("tx_datetime", F.lit("n/a")).alias("tx_datetime"),
    )
    return rows.na.fill(0)


@query(f"""WITH {views.TX} SELECT transaction_id, unix_time FROM tx
WHERE unix_time >= (SELECT min(unix_time) FROM tx) + {literals.WEEK + literals.HOUR}""")
def warmup(spark, sf_dir):
    tx = views.tx_events(spark, sf_dir).select("transaction_id", TIME)
    return derive.after_warmup(tx, tx, TIME, presets.WEEK + presets.HOUR)


# Interval texts made from the events: every unit, spaces, capitals, an unknown unit, text
# after the unit, and texts that are no interval.
_TEXTS = """SELECT event_id, CASE event_id % 17
  WHEN 0 THEN n || 's' WHEN 1 THEN n || ' second' WHEN 2 THEN n || ' seconds'
  WHEN 3 THEN n || 'm' WHEN 4 THEN n || ' Minute' WHEN 5 THEN n || ' minutes'
  WHEN 6 THEN n || 'H' WHEN 7 THEN n || '  hour' WHEN 8 THEN '  ' || n || ' hours '
  WHEN 9 THEN n || 'd' WHEN 10 THEN n || ' day' WHEN 11 THEN n || ' DAYS'
  WHEN 12 THEN n || ' weeks' WHEN 13 THEN 'in ' || n || ' days' WHEN 14 THEN n
  WHEN 15 THEN n || ' days ago' ELSE '' END AS text
FROM (SELECT event_id, cast(event_id % 500 AS varchar(20)) AS n FROM events) AS numbers"""


@query(f"""WITH texts AS ({_TEXTS}), cut AS (SELECT event_id, text,
  regexp_extract(lower(trim(text)), '^(\\d+)\\s*([a-z]+)', 1) AS n,
  regexp_extract(lower(trim(text)), '^(\\d+)\\s*([a-z]+)', 2) AS unit FROM texts)
SELECT event_id, text, CASE WHEN n = '' THEN NULL ELSE cast(n AS bigint) *
  CASE WHEN unit IN ('s', 'second', 'seconds') THEN 1
       WHEN unit IN ('m', 'minute', 'minutes') THEN 60
       WHEN unit IN ('h', 'hour', 'hours') THEN 3600
       WHEN unit IN ('d', 'day', 'days') THEN 86400 ELSE 0 END END AS seconds FROM cut""",
       name="interval_seconds")
def interval_texts(spark, sf_dir):
    texts = views.select_from(spark, sf_dir, _TEXTS)
    return texts.withColumn("seconds", interval_seconds("text"))


@query(f"""WITH {views.TX} SELECT transaction_id, tx_amount, tx_fraud FROM tx""")
def column_subset(spark, sf_dir):
    tx = views.tx_events(spark, sf_dir)
    skipped = {"tx_datetime", TIME, "customer_id", "terminal_id", "cents", "tx_time_seconds",
               "tx_time_days", "tx_fraud_scenario"}
    return tx.select([name for name in tx.columns if name not in skipped])


@query(f"""WITH {views.TX} SELECT transaction_id, cast(customer_id AS double) AS customer_id,
 cast(terminal_id AS double) AS terminal_id, cast(cents AS double) AS cents FROM tx""")
def numeric_cast(spark, sf_dir):
    columns = ["customer_id", "terminal_id", "cents"]
    tx = views.tx_events(spark, sf_dir).select("transaction_id", *columns)
    return model.to_double(tx, columns)


@query(f"""WITH {views.TX} SELECT transaction_id, cents FROM tx
WHERE cast('0x' || substr(md5(transaction_id || ':42'), 1, 8) AS bigint) < 858993459""")
def stable_sample(spark, sf_dir):
    tx = views.tx_events(spark, sf_dir).select("transaction_id", "cents")
    return derive.stable_sample(tx, "transaction_id", 0.2)


@query(f"""WITH {views.TX} SELECT transaction_id, unix_time, cents FROM tx
ORDER BY transaction_id LIMIT 5""")
def first_rows(spark, sf_dir):
    tx = views.tx_events(spark, sf_dir).select("transaction_id", TIME, "cents")
    return tx.orderBy("transaction_id").limit(5)


# The training table: row features, ratios instead of their bases, nulls filled.

_KEPT = [c for c in literals.FEATURE_COLUMNS if c not in EIGHT]
_FILLED = [c if c == "tx_datetime" else f"coalesce({c}, 0) AS {c}" for c in _KEPT]
_ROW = ["is_night", "is_weekend", "is_rovn_sum", "is_unknonw_terminal", "is_unknonw_customer",
        "hour", "day_of_week"]


@query(f"""WITH ft AS ({FEATURES_SQL}), rf AS (SELECT *, {_CALENDAR},
  cast(CASE WHEN tx_amount % 100 = 0 THEN 1 ELSE 0 END AS int) AS is_rovn_sum,
  cast(CASE WHEN terminal_id = -1 THEN 1 ELSE 0 END AS int) AS is_unknonw_terminal,
  cast(CASE WHEN customer_id = -1 THEN 1 ELSE 0 END AS int) AS is_unknonw_customer,
  {_items([_ratio(b) for b in EIGHT])} FROM ft)
SELECT {_items(_FILLED)}, {", ".join(_ROW)},
 {_items([_circle(*spec, name) for name, spec in CIRCLE.items()])},
 {_items([f"coalesce(ratio_{b}, 0) AS ratio_{b}" for b in EIGHT])} FROM rf""")
def training_table(spark, sf_dir):
    table = jobs.training_table(jobs.feature_table(transactions(spark, sf_dir), warmup=WARMUP))
    return table.withColumns({name: F.round(name, 9) for name in CIRCLE})

"""Frames over rows and over buckets, risk, and the feature table."""

from __future__ import annotations

from dataclasses import replace
from datetime import timedelta

from pyspark.sql import functions as F

from checks import literals, sqltext, views
from checks.registry import query
from ledgerlens.operators import buckets, derive, explore, frames
from ledgerlens.operators.buckets import BucketRequest
from ledgerlens.operators.frames import Group, Request
from ledgerlens.operators.skew import HotRule
from ledgerlens.plans import daily, jobs, presets
from ledgerlens.session import cut_lineage, work_folder
from ledgerlens.sources import sinks

TIME = "unix_time"
WARMUP = 7 * literals.DAY


def _items(items: list[str]) -> str:
    return ",\n ".join(items)


def _rolled(df, groups):
    wide = frames.rolling(df, TIME, groups)
    new = [c for c in wide.columns if c not in df.columns]
    return wide.select("transaction_id", *new)


CUST = "{target}_{agg}_cust_{frame}"
CT = "{target}_{agg}_ct_{frame}"
FULL_ITEMS = sqltext.row_frames("customer_id", literals.CUSTOMER_FULL, ["cn", "avg"], CUST)
HIST_ITEMS = sqltext.row_frames("customer_id", literals.CUSTOMER_HISTORY, ["cn", "avg", "std"], CUST)
PAIR_ITEMS = sqltext.row_frames("customer_id, terminal_id", literals.PAIR, ["isnew"], CT)


@query(f"WITH {views.TX} SELECT transaction_id, {_items(FULL_ITEMS)} FROM tx")
def cust_full(spark, sf_dir):
    group = presets.customer_group()
    only = replace(group, requests=group.requests[:1])
    return _rolled(views.tx_events(spark, sf_dir), [only])


def bucketed_events(spark, sf_dir, buckets: int = 8):
    """The events as a table in buckets by customer, in the order of time."""
    path = work_folder(spark, "bucketed")
    name = "ledgerlens_" + path.rsplit("-", 1)[1]
    tx = views.tx_events(spark, sf_dir).select("transaction_id", TIME, "customer_id", "tx_amount")
    sinks.save_bucketed(tx, name, path, ["customer_id"], [TIME], buckets)
    return spark.table(name)


@query(f"WITH {views.TX} SELECT transaction_id, {_items(FULL_ITEMS)} FROM tx")
def cust_full_bucketed(spark, sf_dir):
    """From a table whose files are by customer: without an exchange."""
    group = presets.customer_group()
    only = replace(group, requests=group.requests[:1])
    return _rolled(bucketed_events(spark, sf_dir), [only])


@query(f"WITH {views.TX} SELECT transaction_id, {_items(HIST_ITEMS)} FROM tx")
def cust_hist(spark, sf_dir):
    group = presets.customer_group()
    only = replace(group, requests=group.requests[1:])
    return _rolled(views.tx_events(spark, sf_dir), [only])


@query(f"""WITH {views.ORDERS} SELECT transaction_id, cents,
 {_items(FULL_ITEMS + HIST_ITEMS + PAIR_ITEMS)} FROM ox""")
def orders_frames(spark, sf_dir):
    """Thirty-day frames and many rows with the same time."""
    df = views.tx_orders(spark, sf_dir)
    wide = frames.rolling(df, TIME, [presets.customer_group(), presets.pair_group()])
    new = [c for c in wide.columns if c not in df.columns]
    return wide.select("transaction_id", "cents", *new)


@query(f"WITH {views.TX} SELECT transaction_id, {_items(PAIR_ITEMS)} FROM tx")
def pair_isnew(spark, sf_dir):
    return _rolled(views.tx_events(spark, sf_dir), [presets.pair_group()])


SUM_FRAMES = {"1d": (-86400, 0), "around": (-3600, 3600)}


@query(f"""WITH {views.TX} SELECT transaction_id, {_items(sqltext.row_frames(
    "terminal_id", SUM_FRAMES, ["cn", "sum"], "{target}_{agg}_{frame}", target="cents"))}
FROM tx""")
def window_sum(spark, sf_dir):
    request = Request("cents", frames.frames(SUM_FRAMES), {"count", "sum"})
    return _rolled(views.tx_events(spark, sf_dir), [Group(("terminal_id",), (request,))])


@query(f"""WITH {views.TX}, daily AS (SELECT customer_id, unix_time - unix_time % 86400 AS day,
  count(*) AS n, cast(max(cents) AS bigint) AS top FROM tx GROUP BY 1, 2)
SELECT customer_id, day,
 cast(max(top) OVER {sqltext.over("customer_id", "day", -literals.WEEK, 0)} AS bigint) AS top_7d,
 cast(sum(n) OVER {sqltext.over("customer_id", "day", -literals.WEEK, -1)} AS bigint) AS n_before
FROM daily""")
def named_windows(spark, sf_dir):
    """Plain windows with any function, over a table with one row per key and day."""
    tx = views.tx_events(spark, sf_dir)
    day = buckets.with_bucket(tx, TIME, presets.DAY).withColumnRenamed(buckets.BUCKET, "day")
    daily = day.groupBy("customer_id", "day").agg(
        F.count(F.lit(1)).alias("n"), F.max("cents").alias("top")
    )
    spans = {"7d": (-presets.WEEK, 0), "before": (-presets.WEEK, -1)}
    windows = frames.named_windows(["customer_id"], "day", spans, "cust")
    return daily.select(
        "customer_id", "day",
        F.max("top").over(windows["cust_7d"]).alias("top_7d"),
        F.sum("n").over(windows["cust_before"]).alias("n_before"),
    )


def _lag_sql(source: str) -> str:
    w = "(PARTITION BY customer_id, terminal_id ORDER BY unix_time, transaction_id)"
    return f"""SELECT transaction_id, unix_time,
 lag(transaction_id) OVER {w} AS prev_id, lag(unix_time) OVER {w} AS prev_time,
 transaction_id - lag(transaction_id) OVER {w} AS id_gap,
 unix_time - lag(unix_time) OVER {w} AS time_gap FROM {source}"""


@query(f"WITH {views.TX} {_lag_sql('tx')}")
def lag_gap(spark, sf_dir):
    rows = views.tx_events(spark, sf_dir).select(
        "transaction_id", TIME, "customer_id", "terminal_id"
    )
    gaps = explore.lag_gap(rows, ["customer_id", "terminal_id"], TIME, "transaction_id")
    return gaps.drop("customer_id", "terminal_id")


# -- buckets -----------------------------------------------------------------------

TERM = "term_{target}_{agg}_{frame}"


@query(f"""WITH {views.TX}, {sqltext.bucket_tables("tx", literals.BUCKET, {"a": "cents"},
    [(literals.TERMINAL_FULL, ["a"])])}
SELECT terminal_id, b AS bucket, n AS rows, cast(s_a AS bigint) AS cents,
 cast(q_a AS double) AS squares FROM bt""")
def bucket_agg(spark, sf_dir):
    request = Request("cents", (), {"std"})
    table = buckets.bucket_totals(
        views.tx_events(spark, sf_dir), ["terminal_id"], TIME, presets.BUCKET, [request]
    )
    n, s, *squares = [f"`{part}`" for part in request.parts]
    return table.selectExpr(
        "terminal_id", f"{buckets.BUCKET} AS bucket", f"{n} AS rows", f"{s} AS cents",
        f"double({frames.sum_of_squares(*squares, 'decimal(19, 0)')}) AS squares",
    )


def _trained_and_fixed(trained: dict, fixed: dict) -> dict:
    return {f"trained_{k}": v for k, v in trained.items()} | {
        f"fixed_{k}": v for k, v in fixed.items()}


HISTORY_SETS = _trained_and_fixed(literals.TERMINAL_FULL, literals.FIXED)


def _history_items() -> list[str]:
    items = []
    for name, (start, end) in HISTORY_SETS.items():
        tag = f"{-start}_{-end}"
        items += [f"cast(n_{tag} AS bigint) AS rows_{name}",
                  f"cast(s_a_{tag} AS bigint) AS cents_{name}"]
    return items


@query(f"""WITH {views.TX}, {sqltext.bucket_tables("tx", literals.BUCKET, {"a": "cents"},
    [(HISTORY_SETS, ["a"])])}
SELECT terminal_id, b AS bucket, {_items(_history_items())} FROM bh""")
def bucket_history(spark, sf_dir):
    fixed = {"1h": (-presets.BUCKET, -1), "1d": (-presets.DAY, -presets.BUCKET)}
    sets = _trained_and_fixed(presets.TERMINAL_FULL, fixed)
    request = Request("cents", frames.frames(sets), {"sum"})
    table = buckets.bucket_history(
        views.tx_events(spark, sf_dir), ["terminal_id"], TIME, presets.BUCKET, [request]
    )
    n, s = request.parts
    columns = []
    for frame in request.frames:
        columns += [
            F.col(buckets.history_column(n, frame)).alias(f"rows_{frame.name}"),
            F.col(buckets.history_column(s, frame)).alias(f"cents_{frame.name}"),
        ]
    return table.select("terminal_id", F.col(buckets.BUCKET).alias("bucket"), *columns)


@query(f"""WITH {views.TX}, br AS (SELECT *, unix_time - unix_time % 7200 AS b FROM tx)
SELECT transaction_id, count(*) OVER w AS cents_cn_current,
 cast(sum(cents) OVER w AS bigint) AS cents_sum_current,
 {sqltext.mean("count(*) OVER w", "sum(cents) OVER w", 1)} AS cents_avg_current,
 {sqltext.deviation("count(*) OVER w", "sum(cents) OVER w",
                    "sum(cents::hugeint * cents) OVER w", 1, 0, "0")} AS cents_std_current
FROM br
WINDOW w AS (PARTITION BY terminal_id, b ORDER BY unix_time RANGE UNBOUNDED PRECEDING)""")
def in_bucket_running(spark, sf_dir):
    request = Request("cents", (), {"count", "sum", "avg", "std"}, ddof=0, empty=0)
    tx = views.tx_events(spark, sf_dir)
    wide = buckets.in_bucket_running(
        tx, ["terminal_id"], TIME, presets.BUCKET, BucketRequest(request)
    )
    return wide.select("transaction_id", *[c for c in wide.columns if c not in tx.columns])


def _heavy(df, specs, interval=presets.BUCKET):
    wide = buckets.rolling_bucketed(df, ["terminal_id"], TIME, interval, specs)
    return wide.select("transaction_id", *[c for c in wide.columns if c not in df.columns])


def _heavy_sql(source: str, interval: int, targets: dict, specs: list, items: list[str],
               prefix: str = views.TX) -> str:
    tables = sqltext.bucket_tables(source, interval, targets, specs)
    return f"WITH {prefix}, {tables}\nSELECT r.transaction_id, {_items(items)}\n{sqltext.JOINED}"


HEAVY_FULL = sqltext.bucket_items(
    literals.TERMINAL_FULL, "a", "tx_amount", ["cn", "avg"], TERM, "cents", 100
)
HEAVY_HIST = sqltext.bucket_items(
    literals.TERMINAL_HISTORY, "a", "tx_amount", ["cn", "avg", "std"], TERM, "cents", 100, False
)


@query(_heavy_sql("tx", literals.BUCKET, {"a": "cents"}, [(literals.TERMINAL_FULL, ["a"])],
                  HEAVY_FULL))
def heavy_full(spark, sf_dir):
    return _heavy(views.tx_events(spark, sf_dir), presets.terminal_specs()[:1])


@query(_heavy_sql("tx", literals.BUCKET, {"a": "cents"}, [(literals.TERMINAL_HISTORY, ["a"])],
                  HEAVY_HIST))
def heavy_hist(spark, sf_dir):
    return _heavy(views.tx_events(spark, sf_dir), presets.terminal_specs()[1:2])


FLAGS = f"{views.TX}, fl AS (SELECT *, {_items(PAIR_ITEMS)} FROM tx)"
NEW_30, NEW_7 = literals.NEW_FLAGS
NEW_TARGETS = {"n30": NEW_30, "n7": NEW_7}
NEW_ITEMS = [
    item
    for short, flag in NEW_TARGETS.items()
    for item in sqltext.bucket_items(
        literals.TERMINAL_FULL, short, flag, ["sum"], TERM, flag, current=False
    )
]


@query(_heavy_sql("fl", literals.BUCKET, NEW_TARGETS, [(literals.TERMINAL_FULL, list(NEW_TARGETS))],
                  NEW_ITEMS, FLAGS))
def heavy_new(spark, sf_dir):
    # Written once: the terminal features read the flags for rows and for bucket totals.
    flagged = cut_lineage(
        frames.rolling(views.tx_events(spark, sf_dir), TIME, [presets.pair_group()]), "flagged")
    return _heavy(flagged, presets.terminal_specs()[2:4])


FRAUD = "fraud_{target}_{agg}_{frame}"
FRAUD_ITEMS = sqltext.bucket_items(
    literals.FRAUD, "f", "tx_fraud", ["sum", "cn"], FRAUD, "tx_fraud"
)
HEAVY_FRAUD = _heavy_sql("tx", literals.BUCKET, {"f": "tx_fraud"}, [(literals.FRAUD, ["f"])],
                         FRAUD_ITEMS)


@query(HEAVY_FRAUD)
def heavy_fraud(spark, sf_dir):
    return _heavy(views.tx_events(spark, sf_dir), presets.terminal_specs()[4:])


def _risk_items(pairs, delay=None) -> list[str]:
    items = []
    for labelled, rows in pairs:
        s, n = labelled, rows
        if delay:
            s, n = f"({labelled} - {delay[0]})", f"({rows} - {delay[1]})"
        risk = labelled.replace("_sum_", "_risk_")
        items += [f"{n} AS {rows}_delay",
                  f"coalesce({s}::double / nullif({n}, 0)::double, 0.0) AS {risk}_delay"]
    return items


RISK_PAIRS = literals.risk_pairs(list(literals.FRAUD))


@query(f"SELECT transaction_id, {_items(_risk_items(RISK_PAIRS))} FROM ({HEAVY_FRAUD}) x")
def risk_direct(spark, sf_dir):
    counted = _heavy(views.tx_events(spark, sf_dir), presets.terminal_specs()[4:])
    return derive.add_risk(counted, presets.risk_pairs(list(presets.FRAUD)))


NO_LEAK = _heavy_sql(
    "tx", literals.BUCKET, {"f": "tx_fraud"}, [(literals.FRAUD, ["f"])],
    sqltext.bucket_items(literals.FRAUD, "f", "tx_fraud", ["sum", "cn"], FRAUD, "tx_fraud",
                         current=False),
)


@query(f"SELECT transaction_id, {_items(_risk_items(RISK_PAIRS))} FROM ({NO_LEAK}) x")
def risk_no_leak(spark, sf_dir):
    counted = _heavy(views.tx_events(spark, sf_dir), presets.terminal_specs(fixed=True)[4:])
    return derive.add_risk(counted, presets.risk_pairs(list(presets.FRAUD)))


DELAY_FRAMES = literals.EXPLORE_DELAY | literals.EXPLORE_FRAUD
DELAY_SQL = _heavy_sql(
    "tx", literals.EXPLORE_BUCKET, {"f": "tx_fraud"}, [(DELAY_FRAMES, ["f"])],
    sqltext.bucket_items(DELAY_FRAMES, "f", "tx_fraud", ["sum", "cn"], FRAUD, "tx_fraud",
                         current=False),
)
DELAYED_PAIRS = literals.risk_pairs(list(literals.EXPLORE_FRAUD))
DELAY = literals.risk_pairs(list(literals.EXPLORE_DELAY))[0]


@query(f"SELECT transaction_id, {_items(_risk_items(DELAYED_PAIRS, DELAY))} FROM ({DELAY_SQL}) x")
def risk_delayed(spark, sf_dir):
    counted = _heavy(views.tx_events(spark, sf_dir), presets.explore_terminal_specs()[4:],
                     presets.EXPLORE_BUCKET)
    delayed = presets.risk_pairs(list(presets.EXPLORE_FRAUD))
    return derive.add_risk_after_delay(
        counted, delayed, presets.risk_pairs(list(presets.EXPLORE_DELAY))[0])


@query(_heavy_sql("tx", literals.BUCKET, {"a": "cents"}, [(literals.FIXED_FULL, ["a"])],
                  sqltext.bucket_items(literals.FIXED_FULL, "a", "tx_amount", ["cn", "avg"], TERM, "cents",
                                       100)))
def heavy_full_fixed(spark, sf_dir):
    """The terminal frames with the preceding bucket taken in."""
    return _heavy(views.tx_events(spark, sf_dir), presets.terminal_specs(fixed=True)[:1])


# -- the exploratory feature sets --------------------------------------------------

EXPLORE_ROW_ITEMS = (
    sqltext.row_frames("customer_id", literals.EXPLORE_FULL, ["cn", "avg"], CUST)
    + sqltext.row_frames("customer_id", literals.EXPLORE_HISTORY, ["cn", "avg", "std"], CUST)
    + sqltext.row_frames("customer_id, terminal_id", literals.EXPLORE_PAIR, ["isnew"], CT)
)


@query(f"WITH {views.TX} SELECT transaction_id, {_items(EXPLORE_ROW_ITEMS)} FROM tx")
def explore_customer(spark, sf_dir):
    return _rolled(views.tx_events(spark, sf_dir), presets.explore_customer_groups())


EXPLORE_PAIR_ITEMS = sqltext.row_frames(
    "customer_id, terminal_id", literals.EXPLORE_PAIR, ["isnew"], CT
)
EXPLORE_TERM_ITEMS = (
    sqltext.bucket_items(literals.EXPLORE_FULL, "a", "tx_amount", ["cn", "avg"], TERM, "cents", 100)
    + sqltext.bucket_items(literals.EXPLORE_HISTORY, "a", "tx_amount", ["cn", "std"], TERM,
                           "cents", 100, False)
    + [item.replace("ELSE 0 END", "ELSE r.tx_amount END") for item in sqltext.bucket_items(
        literals.EXPLORE_HISTORY, "a", "tx_amount", ["avg"], TERM, "cents", 100, False)]
    + sqltext.bucket_items(literals.EXPLORE_FULL, "n7", NEW_7, ["sum"], TERM, NEW_7, current=False)
)


@query(_heavy_sql(
    "fl", literals.EXPLORE_BUCKET, {"a": "cents", "n7": NEW_7},
    [(literals.EXPLORE_HISTORY, ["a"]), (literals.EXPLORE_FULL, ["a", "n7"])], EXPLORE_TERM_ITEMS,
    f"{views.TX}, fl AS (SELECT *, {_items(EXPLORE_PAIR_ITEMS)} FROM tx)"))
def explore_terminal(spark, sf_dir):
    pairs = presets.explore_customer_groups()[1:]
    flagged = cut_lineage(frames.rolling(views.tx_events(spark, sf_dir), TIME, pairs), "flagged")
    wide = buckets.rolling_bucketed(flagged, ["terminal_id"], TIME, presets.EXPLORE_BUCKET,
                                    presets.explore_terminal_specs()[:4])
    filled = derive.own_value_where_missing(wide, presets.EXPLORE_OWN)
    new = [c for c in wide.columns if c not in flagged.columns]
    return filled.select("transaction_id", *new)


# -- the same operators with every key treated as hot ------------------------------

ALL_HOT = HotRule(rows=0)


@query(f"""WITH {views.TX} SELECT transaction_id,
 {_items(FULL_ITEMS + HIST_ITEMS + PAIR_ITEMS)} FROM tx""")
def customer_frames_hot(spark, sf_dir):
    """Customer and pair frames by second instead of by row."""
    tx = views.tx_events(spark, sf_dir)
    groups = [presets.customer_group(), presets.pair_group()]
    wide = frames.rolling(tx, TIME, groups, ALL_HOT)
    return wide.select("transaction_id", *[c for c in wide.columns if c not in tx.columns])


@query(_heavy_sql("tx", literals.BUCKET, {"a": "cents"},
                  [(literals.TERMINAL_FULL, ["a"]), (literals.TERMINAL_HISTORY, ["a"])],
                  HEAVY_FULL + HEAVY_HIST))
def terminal_frames_hot(spark, sf_dir):
    """Terminal frames with the own bucket reduced to seconds."""
    tx = views.tx_events(spark, sf_dir)
    wide = buckets.rolling_bucketed(tx, ["terminal_id"], TIME, presets.BUCKET,
                                    presets.terminal_specs()[:2], ALL_HOT)
    return wide.select("transaction_id", *[c for c in wide.columns if c not in tx.columns])


@query(f"WITH {views.TX} {_lag_sql('tx')}")
def lag_gap_hot(spark, sf_dir):
    """Predecessors found by band, second and key instead of by one window."""
    rows = views.tx_events(spark, sf_dir).select(
        "transaction_id", TIME, "customer_id", "terminal_id"
    )
    gaps = explore.lag_gap(rows, ["customer_id", "terminal_id"], TIME, "transaction_id",
                           ALL_HOT, band=1000)
    return gaps.drop("customer_id", "terminal_id")


# -- the feature table -------------------------------------------------------------

_ROW_FEATURES = f"cf AS (SELECT *, {_items(FULL_ITEMS + HIST_ITEMS + PAIR_ITEMS)} FROM tx)"
_ALL_BUCKETS = sqltext.bucket_tables(
    "cf", literals.BUCKET, {"a": "cents", **NEW_TARGETS, "f": "tx_fraud"},
    [(literals.TERMINAL_FULL, ["a", *NEW_TARGETS]), (literals.TERMINAL_HISTORY, ["a"]),
     (literals.FRAUD, ["f"])],
)
_TERM_ITEMS = HEAVY_FULL + HEAVY_HIST + NEW_ITEMS + FRAUD_ITEMS
_BASE = [c for c in literals.FEATURE_COLUMNS if not c.startswith(("term_tx", "fraud_"))]
_BASE = [c for c in _BASE if c not in ("tx_datetime", "customer_id")]
_TERM = [c for c in literals.FEATURE_COLUMNS if c.startswith("term_tx")]
FEATURES_SQL = f"""WITH {views.TX}, {_ROW_FEATURES}, {_ALL_BUCKETS},
tf AS (SELECT r.*, {_items(_TERM_ITEMS)} {sqltext.JOINED})
SELECT cast(customer_id AS int) AS customer_id, {", ".join(_BASE + _TERM)},
 {_items(_risk_items(RISK_PAIRS))}, tx_datetime FROM tf
WHERE unix_time >= (SELECT min(unix_time) FROM tx) + {WARMUP}"""


def transactions(spark, sf_dir):
    tx = views.tx_events(spark, sf_dir)
    return tx.select(
        "transaction_id", "tx_datetime", F.col("customer_id").cast("int").alias("customer_id"),
        "terminal_id", "tx_amount", "tx_time_seconds", "tx_time_days",
        F.col("tx_fraud").cast("boolean").alias("tx_fraud"), "tx_fraud_scenario",
    )


@query(FEATURES_SQL)
def feature_table(spark, sf_dir):
    return jobs.feature_table(transactions(spark, sf_dir), warmup=WARMUP)


# -- the exploratory table, and features of the last days ---------------------------

_EXPLORED = sqltext.bucket_tables(
    "cf", literals.EXPLORE_BUCKET, {"a": "cents", "n7": NEW_7, "f": "tx_fraud"},
    [(literals.EXPLORE_HISTORY, ["a"]), (literals.EXPLORE_FULL, ["a", "n7"]),
     (DELAY_FRAMES, ["f"])],
)
_EXPLORE_RISK = sqltext.bucket_items(
    DELAY_FRAMES, "f", "tx_fraud", ["sum", "cn"], FRAUD, "tx_fraud", current=False)


def _names(items: list[str]) -> list[str]:
    return [item.rsplit(" AS ", 1)[1] for item in items]


@query(f"""WITH {views.TX}, cf AS (SELECT *, {_items(EXPLORE_ROW_ITEMS)} FROM tx), {_EXPLORED},
tf AS (SELECT r.*, {_items(EXPLORE_TERM_ITEMS + _EXPLORE_RISK)} {sqltext.JOINED})
SELECT transaction_id, {_items(_names(EXPLORE_ROW_ITEMS + EXPLORE_TERM_ITEMS))},
 {_items(_risk_items(DELAYED_PAIRS, DELAY))} FROM tf
WHERE unix_time >= (SELECT min(unix_time) FROM tx) + 608400""")
def explore_table(spark, sf_dir):
    tx = transactions(spark, sf_dir)
    table = jobs.explore_table(tx)
    return table.select("transaction_id", *[
        c for c in table.columns if c not in tx.columns and c != TIME])


DAYS_AGAIN = 5
_LATE = [c for c in literals.FEATURE_COLUMNS if c != "tx_datetime"]


@query(f"""SELECT {", ".join(_LATE)} FROM ({FEATURES_SQL}) f
WHERE tx_datetime >= (SELECT date_trunc('day', max(ts)) FROM events) - INTERVAL 5 DAY""")
def features_since(spark, sf_dir):
    """The last days only, from transactions that are kept by day."""
    source, target = work_folder(spark, "by-day"), work_folder(spark, "features")
    tx = transactions(spark, sf_dir).withColumn(
        "tx_datetime", F.col("tx_datetime").cast("timestamp"))
    sinks.write_parquet(
        tx.withColumn(jobs.DAY, F.to_date("tx_datetime")), source, partition_by=[jobs.DAY])
    last = tx.agg(F.to_date(F.max("tx_datetime"))).first()[0]
    since = last - timedelta(days=DAYS_AGAIN)
    jobs.features(spark, source, target, WARMUP, by_day=True, since=since)
    return spark.read.parquet(target).select(*_LATE)


DAILY = 2


@query(f"SELECT {', '.join(_LATE)} FROM ({FEATURES_SQL}) f")
def features_daily(spark, sf_dir):
    """All days but the last ones in one run that begins a state, then day by day from it."""
    source, state, target = (work_folder(spark, f"daily-{name}") for name in "abc")
    tx = transactions(spark, sf_dir).withColumn(
        "tx_datetime", F.col("tx_datetime").cast("timestamp"))
    sinks.write_parquet(
        tx.withColumn(jobs.DAY, F.to_date("tx_datetime")), source, partition_by=[jobs.DAY])
    first, last = tx.agg(
        F.to_date(F.min("tx_datetime")), F.to_date(F.max("tx_datetime"))).first()
    begun = last - timedelta(days=DAILY)
    daily.daily_features(spark, source, state, target, first, begun, WARMUP)
    for k in range(1, DAILY + 1):
        day = begun + timedelta(days=k)
        daily.daily_features(spark, source, state, target, day, warmup=WARMUP)
    return spark.read.parquet(target).select(*_LATE)

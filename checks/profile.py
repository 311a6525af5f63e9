"""Counts, extents, quantiles and top lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views
from checks.registry import query
from ledgerlens.operators import explore, sketches
from ledgerlens.session import cut_lineage

TIME = "unix_time"
FRAUD = "tx_fraud = 1"


@query("SELECT cast(sum(cast(round(value * 100) AS bigint)) AS bigint) AS total FROM events")
def sum_scalar(spark, sf_dir):
    return views.tx_events(spark, sf_dir).agg(F.sum("cents").alias("total"))


@query(f"WITH {views.TX} SELECT min(unix_time) AS min_time, max(unix_time) AS max_time FROM tx")
def time_extent(spark, sf_dir):
    return explore.time_extent(views.tx_events(spark, sf_dir), TIME)


@query(f"""WITH {views.TX} SELECT tx_fraud, count(*) AS count,
 count(*)::double / (SELECT count(*) FROM tx)::double AS share FROM tx GROUP BY tx_fraud""")
def class_balance(spark, sf_dir):
    return explore.class_balance(views.tx_events(spark, sf_dir), "tx_fraud")


@query(f"""WITH {views.TX} SELECT customer_id, terminal_id, count(*) AS count FROM tx
GROUP BY customer_id, terminal_id""")
def count_by_entity(spark, sf_dir):
    return explore.count_by(views.tx_events(spark, sf_dir), ["customer_id", "terminal_id"])


@query(f"""WITH {views.TX} SELECT tx_fraud_scenario, count(*) AS count FROM tx WHERE tx_fraud = 1
GROUP BY tx_fraud_scenario""")
def fraud_scenarios(spark, sf_dir):
    return explore.count_by(views.tx_events(spark, sf_dir), ["tx_fraud_scenario"], FRAUD)


_SPAN = """SELECT customer_id, min(unix_time) AS min_time, max(unix_time) AS max_time,
 max(unix_time) - min(unix_time) AS diff_time FROM tx WHERE tx_fraud = 1 GROUP BY customer_id"""


@query(f"WITH {views.TX} {_SPAN}")
def active_span(spark, sf_dir):
    return explore.active_span(views.tx_events(spark, sf_dir).filter(FRAUD), ["customer_id"], TIME)


@query(f"WITH {views.TX} SELECT max(diff_time) // 86400 AS max_days FROM ({_SPAN}) s")
def longest_span(spark, sf_dir):
    rows = views.tx_events(spark, sf_dir).filter(FRAUD)
    return explore.longest_span_days(rows, ["customer_id"], TIME)


PROFILED = ["cents", "customer_id", "terminal_id", "unix_time"]


def _profile_sql(name: str) -> str:
    n, s, q = f"count({name})", f"sum({name})::hugeint", f"sum({name}::hugeint * {name})"
    return f"""SELECT '{name}' AS "column", {n} AS count, ({s})::double / ({n})::double AS mean,
 sqrt((({n})::hugeint * ({q}) - ({s}) * ({s}))::double / (({n})::double * (({n})::double - 1)))
   AS stddev,
 cast(min({name}) AS bigint) AS "min", cast(max({name}) AS bigint) AS "max" FROM tx"""


@query(f"WITH {views.TX} " + " UNION ALL ".join(_profile_sql(name) for name in PROFILED))
def profile(spark, sf_dir):
    return explore.profile(views.tx_events(spark, sf_dir), PROFILED)


def _quartiles_sql(name: str) -> str:
    return ", ".join(f"cast(quantile_disc({name}, {share}) AS bigint) AS {label}" for label, share in (
        ("first_quartile", 0.25), ("median", 0.5), ("third_quartile", 0.75)))


@query(f"WITH {views.TX} " + " UNION ALL ".join(
    _profile_sql(name).replace(" FROM tx", f", {_quartiles_sql(name)} FROM tx")
    for name in PROFILED))
def profile_summary(spark, sf_dir):
    """The profile with exact quartiles."""
    return explore.summary(views.tx_events(spark, sf_dir), PROFILED)


QUARTILES = [0.25, 0.5, 0.75]


def _quantile_sql(column: str, shares: list[float]) -> str:
    parts = [f"""SELECT {share}::double AS share,
 cast(quantile_disc({column}, {share}) AS bigint) AS value FROM tx""" for share in shares]
    return f"WITH {views.TX} " + " UNION ALL ".join(parts)


@query(_quantile_sql("cents", QUARTILES))
def quartiles(spark, sf_dir):
    return explore.exact_quantiles(views.tx_events(spark, sf_dir), "cents", QUARTILES)


@query(_quantile_sql("unix_time", [0.8]))
def quantile_exact(spark, sf_dir):
    return explore.exact_quantiles(views.tx_events(spark, sf_dir), TIME, [0.8])


SKETCHED = [0.01, 0.25, 0.5, 0.8, 0.99]
SKETCH_ERROR = 0.01


@query(f"""WITH {views.TX} SELECT unnest({SKETCHED}::double[]) AS share,
 (SELECT count(*) FROM tx) AS rows, true AS within""")
def quantile_sketch(spark, sf_dir):
    """Whether the rank of each sketched quantile lies within the error."""
    tx = views.tx_events(spark, sf_dir)
    found = [(s, explore.approx_quantile(tx, "cents", s, SKETCH_ERROR)) for s in SKETCHED]
    counts = [F.struct(F.lit(share).alias("share"), F.count("cents").alias("rows"),
                       F.count_if(F.col("cents") < value).alias("below"),
                       F.count_if(F.col("cents") <= value).alias("upto"))
              for share, value in found]
    return tx.agg(F.array(*counts).alias("c")).select(F.inline("c")).select("share", "rows", (
        (F.col("below") <= (F.col("share") + SKETCH_ERROR) * F.col("rows"))
        & (F.col("upto") >= (F.col("share") - SKETCH_ERROR) * F.col("rows"))).alias("within"))


@query(f"""WITH {views.TX}, gaps AS (SELECT
  transaction_id - lag(transaction_id) OVER w AS id_gap,
  tx_time_seconds - lag(tx_time_seconds) OVER w AS time_gap FROM tx
  WINDOW w AS (PARTITION BY customer_id, terminal_id ORDER BY tx_time_seconds, transaction_id))
SELECT count(*) FILTER (time_gap < 0) AS time_backwards,
       count(*) FILTER (id_gap < 0) AS id_backwards,
       count(*) FILTER (time_gap = 0) AS same_time FROM gaps""")
def filtered_counts(spark, sf_dir):
    gaps = explore.lag_gap(views.tx_events(spark, sf_dir), ["customer_id", "terminal_id"],
                           "tx_time_seconds", "transaction_id")
    return explore.counts_where(gaps, {
        "time_backwards": F.col("time_gap") < 0,
        "id_backwards": F.col("id_gap") < 0,
        "same_time": F.col("time_gap") == 0,
    })


@query(f"WITH {views.ORDERS} SELECT count(DISTINCT transaction_id) AS transactions FROM ox")
def distinct_ids(spark, sf_dir):
    return views.tx_orders(spark, sf_dir).agg(
        F.count_distinct("transaction_id").alias("transactions")
    )


def _top_sql(keys: str, where: str = "") -> str:
    return f"""WITH {views.TX} SELECT {keys}, count(*) AS count FROM tx {where}
GROUP BY {keys} ORDER BY count DESC, {keys} LIMIT 20"""


@query(_top_sql("customer_id"))
def top_customers(spark, sf_dir):
    return explore.top_by_count(views.tx_events(spark, sf_dir), ["customer_id"])


@query(_top_sql("customer_id", "WHERE tx_fraud = 1"))
def top_fraud_customers(spark, sf_dir):
    return explore.top_by_count(views.tx_events(spark, sf_dir), ["customer_id"], only=FRAUD)


@query(_top_sql("terminal_id"))
def top_terminals(spark, sf_dir):
    return explore.top_by_count(views.tx_events(spark, sf_dir), ["terminal_id"])


@query(_top_sql("terminal_id", "WHERE tx_fraud = 1"))
def top_fraud_terminals(spark, sf_dir):
    return explore.top_by_count(views.tx_events(spark, sf_dir), ["terminal_id"], only=FRAUD)


@query(_top_sql("customer_id, terminal_id"))
def top_pairs(spark, sf_dir):
    return explore.top_by_count(views.tx_events(spark, sf_dir), ["customer_id", "terminal_id"])


DISTINCT = ["customer_id", "terminal_id", "transaction_id"]
DISTINCT_ERROR = 0.02


@query(f"""WITH {views.TX} SELECT unnest(['customer_id', 'terminal_id', 'transaction_id'])
  AS "column", unnest([count(DISTINCT customer_id), count(DISTINCT terminal_id),
  count(DISTINCT transaction_id)]) AS "distinct", true AS within FROM tx""")
def distinct_sketched(spark, sf_dir):
    """Exact counts, and whether those of merged sketches of each day are within the error."""
    tx = views.tx_events(spark, sf_dir).withColumn("day", F.floor(F.col(TIME) / 86400))
    stored = cut_lineage(
        sketches.column_sketches(tx, ["day"], [], DISTINCT, DISTINCT_ERROR), "sketches")
    about = sketches.merged(stored).select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("_name"), sketches.distinct_count(name).alias("_about"))
        for name in DISTINCT])))
    exact = sketches.exact_distinct(tx, DISTINCT)
    apart = F.abs(F.col("_about") - F.col("distinct")) <= DISTINCT_ERROR * F.col("distinct")
    return exact.join(F.broadcast(about), F.col("column") == F.col("_name")).select(
        "column", "distinct", apart.alias("within"))

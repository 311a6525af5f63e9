"""Frames over amounts of any size and fineness, and over rows at the edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sqltext, views
from checks.registry import query
from checks.windows import _items
from ledgerlens.operators import buckets, frames
from ledgerlens.operators.buckets import BucketRequest
from ledgerlens.operators.frames import Frame, Group, Request
from ledgerlens.operators.skew import HotRule

TIME = "unix_time"
SPANS = {"7d": (-604800, 0), "before": (-86400, -3600)}
PATTERN = "{target}_{agg}_{frame}"

# Five decimals: cents divided by 800. Units of a millionth hold them.
FINE = f"""{views.TX}, fx AS (SELECT *, cents / 800.0::double AS fine,
 cast(cast(cents / 800.0::double AS decimal(18, 6)) * 1000000 AS bigint) AS units FROM tx)"""


def _fine(spark, sf_dir):
    return views.tx_events(spark, sf_dir).withColumn("fine", F.col("cents") / F.lit(800.0))


def _sums(keys: str, value: str, scale: int, target: str) -> list[str]:
    return [
        f"(sum({value}) OVER {sqltext.over(keys, 'unix_time', *span)})::double / {scale}"
        f" AS {target}_sum_{name}" for name, span in SPANS.items()
    ]


_FINE_ITEMS = sqltext.row_frames("customer_id", SPANS, ["cn", "avg", "std"], PATTERN, "units",
                                 "fine", 1000000)


@query(f"""WITH {FINE} SELECT transaction_id,
 {_items(_FINE_ITEMS + _sums("customer_id", "units", 1000000, "fine"))} FROM fx""")
def fine_frames(spark, sf_dir):
    """Amounts with more than two decimals, in doubles."""
    df = _fine(spark, sf_dir)
    request = Request("fine", frames.frames(SPANS), {"count", "sum", "avg", "std"})
    wide = frames.rolling(df, TIME, [Group(("customer_id",), (request,))])
    return wide.select("transaction_id", *[c for c in wide.columns if c not in df.columns])


_PAST = {"7d": (-604800, -7200), "1d": (-86400, -7200)}
_FINE_BUCKETS = sqltext.bucket_items(_PAST, "a", "fine", ["cn", "avg", "std"], PATTERN, "units",
                                     1000000)


@query(f"""WITH {FINE}, {sqltext.bucket_tables("fx", 7200, {"a": "units"}, [(_PAST, ["a"])])}
SELECT r.transaction_id, {_items(_FINE_BUCKETS)} {sqltext.JOINED}""")
def fine_buckets(spark, sf_dir):
    df = _fine(spark, sf_dir)
    request = Request("fine", frames.frames(_PAST), {"count", "avg", "std"}, ddof=0, empty=0)
    wide = buckets.rolling_bucketed(df, ["terminal_id"], TIME, 7200, [BucketRequest(request)])
    return wide.select("transaction_id", *[c for c in wide.columns if c not in df.columns])


# Cents, but some amounts are so large that squares do not fit into 64 bits.
LARGE_SELECT = "CASE WHEN transaction_id % 97 = 0 THEN 300000000000.25 ELSE tx_amount END"
LARGE = f"""{views.TX}, lx AS (SELECT *, ({LARGE_SELECT})::double AS large,
 cast(round(({LARGE_SELECT})::double * 100) AS bigint) AS units FROM tx)"""
_LARGE_ITEMS = sqltext.row_frames("customer_id", SPANS, ["cn", "avg", "std"], PATTERN, "units",
                                  "large", 100)


@query(f"""WITH {LARGE} SELECT transaction_id,
 {_items(_LARGE_ITEMS + _sums("customer_id", "units", 100, "large"))} FROM lx""")
def large_frames(spark, sf_dir):
    tx = views.tx_events(spark, sf_dir)
    df = tx.withColumn("large", F.expr(LARGE_SELECT).cast("double"))
    request = Request("large", frames.frames(SPANS), {"count", "sum", "avg", "std"})
    wide = frames.rolling(df, TIME, [Group(("customer_id",), (request,))])
    return wide.select("transaction_id", *[c for c in wide.columns if c not in df.columns])


# Amounts of about 1e-12, of 2e18 and of both. All are whole multiples of a power of two, so
# whole numbers give their totals in SQL.
TINY, VAST, BOTH = ("tiny", "cents", "1125899906842624"), (
    "vast", "vast_units", "(1.0::double / 524288)"), ("any", "any_units", "1125899906842624")
ANY = f"""{views.TX}, ax AS (SELECT *, cents / 1125899906842624.0::double AS tiny,
 3814697265625 + cents AS vast_units,
 CASE WHEN transaction_id % 97 = 0 THEN 2000000000000000000::hugeint * 1125899906842624
   ELSE cents END AS any_units FROM tx)"""


def _any(spark, sf_dir):
    tx = views.tx_events(spark, sf_dir)
    tiny = F.col("cents") / F.lit(2.0**50)
    return tx.withColumns({
        "tiny": tiny, "vast": (F.lit(3814697265625) + F.col("cents")) * F.lit(2.0**19),
        "any": F.when(F.col("transaction_id") % 97 == 0, F.lit(2e18)).otherwise(tiny)})


def _any_items(keys: str) -> list[str]:
    items = []
    for target, value, scale in (TINY, VAST, BOTH):
        aggs = ["cn", "avg"] if target == "any" else ["cn", "avg", "std"]
        items += sqltext.row_frames(keys, SPANS, aggs, PATTERN, value, target, scale)
        items += _sums(keys, value, scale, target)
    return items


def _any_requests(shapes, aggs, **more) -> list[Request]:
    return [Request(target, frames.frames(shapes), aggs - ({"std"} if target == "any" else set()),
                    **more) for target, _, _ in (TINY, VAST, BOTH)]


def _any_frames(spark, sf_dir, keys, rule):
    df = _any(spark, sf_dir)
    requests = _any_requests(SPANS, {"count", "sum", "avg", "std"})
    wide = frames.rolling(df, TIME, [Group((keys,), tuple(requests))], rule)
    return wide.select("transaction_id", *[c for c in wide.columns if c not in df.columns])


@query(f"WITH {ANY} SELECT transaction_id, {_items(_any_items('customer_id'))} FROM ax")
def any_frames(spark, sf_dir):
    """Totals of doubles without a unit."""
    return _any_frames(spark, sf_dir, "customer_id", None)


@query(f"WITH {ANY} SELECT transaction_id, {_items(_any_items('terminal_id'))} FROM ax")
def any_frames_hot(spark, sf_dir):
    """Every terminal taken as hot."""
    return _any_frames(spark, sf_dir, "terminal_id", HotRule(rows=0))


@query(f"WITH {ANY} SELECT transaction_id, {_items(_any_items('terminal_id'))} FROM ax")
def any_frames_mixed(spark, sf_dir):
    """The terminals with more rows than the mean taken as hot."""
    tx = views.tx_events(spark, sf_dir)
    mean = tx.agg(F.count(F.lit(1)) / F.count_distinct("terminal_id")).first()[0]
    return _any_frames(spark, sf_dir, "terminal_id", HotRule(rows=int(mean)))


_ANY_BUCKETS = [item for short, (target, value, scale), aggs in (
    ("t", TINY, ["cn", "avg", "std"]), ("v", VAST, ["cn", "avg", "std"]),
    ("b", BOTH, ["cn", "avg"])) for item in sqltext.bucket_items(
        _PAST, short, target, aggs, PATTERN, value, scale)]


@query(f"""WITH {ANY}, {sqltext.bucket_tables(
    "ax", 7200, {"t": "cents", "v": "vast_units", "b": "any_units"}, [(_PAST, ["t", "v", "b"])],
    sums_only=("b",))}
SELECT r.transaction_id, {_items(_ANY_BUCKETS)} {sqltext.JOINED}""")
def any_buckets(spark, sf_dir):
    df = _any(spark, sf_dir)
    specs = [BucketRequest(r) for r in
             _any_requests(_PAST, {"count", "avg", "std"}, ddof=0, empty=0)]
    wide = buckets.rolling_bucketed(df, ["terminal_id"], TIME, 7200, specs)
    return wide.select("transaction_id", *[c for c in wide.columns if c not in df.columns])


# Rows without a time, and frames without a start.

OPEN = {"all": (None, 0), "ended": (None, -3600), "day": (-86400, 0)}


def _open_items() -> list[str]:
    items = []
    for name, (start, end) in OPEN.items():
        first = "UNBOUNDED PRECEDING" if start is None else sqltext.bound(start)
        w = (f"(PARTITION BY terminal_id ORDER BY moment RANGE BETWEEN {first} "
             f"AND {sqltext.bound(end)})")
        n = f"count(*) OVER {w}"
        s, q = f"sum(cents) OVER {w}", f"sum(cents::hugeint * cents) OVER {w}"
        items += [
            f"{n} AS cents_cn_{name}",
            f"cast(CASE WHEN {n} = 0 THEN 1 ELSE 0 END AS int) AS cents_isnew_{name}",
            f"cast({s} AS bigint) AS cents_sum_{name}",
            f"{sqltext.mean(n, s, 1)} AS cents_avg_{name}",
            f"{sqltext.deviation(n, s, q, 1, 1)} AS cents_std_{name}",
        ]
    return items


def _empty_items() -> list[str]:
    made = {"cn": "0::bigint", "isnew": "1::int", "sum": "NULL::bigint", "avg": "NULL::double",
            "std": "NULL::double"}
    return [f"{value} AS cents_{agg}_{name}" for name in OPEN for agg, value in made.items()]


EDGES = f"""WITH {views.TX}, ex AS (SELECT *,
  CASE WHEN transaction_id % 11 <> 0 THEN unix_time END AS moment FROM tx)
SELECT transaction_id, {_items(_open_items())} FROM ex WHERE moment IS NOT NULL
UNION ALL SELECT transaction_id, {_items(_empty_items())} FROM ex WHERE moment IS NULL"""


def _edges(spark, sf_dir, rule):
    tx = views.tx_events(spark, sf_dir)
    at = F.when(F.col("transaction_id") % 11 != 0, F.col(TIME))
    df = tx.withColumn("moment", at)
    shapes = tuple(Frame(name, start, end) for name, (start, end) in OPEN.items())
    request = Request("cents", shapes, {"count", "sum", "avg", "std", "isnew"})
    wide = frames.rolling(df, "moment", [Group(("terminal_id",), (request,))], rule)
    return wide.select("transaction_id", *[c for c in wide.columns if c not in df.columns])


@query(EDGES)
def edge_frames(spark, sf_dir):
    """No terminal taken as hot."""
    return _edges(spark, sf_dir, None)


@query(EDGES)
def edge_frames_hot(spark, sf_dir):
    """Every terminal taken as hot."""
    return _edges(spark, sf_dir, HotRule(rows=0))


@query(EDGES)
def edge_frames_mixed(spark, sf_dir):
    """The terminals with more rows than the mean taken as hot."""
    tx = views.tx_events(spark, sf_dir)
    mean = tx.agg(F.count(F.lit(1)) / F.count_distinct("terminal_id")).first()[0]
    return _edges(spark, sf_dir, HotRule(rows=int(mean)))

"""Named sets of frames and the feature sets made of them."""

from __future__ import annotations

from dataclasses import replace

from ledgerlens.operators.buckets import BucketRequest, holds_a_bucket
from ledgerlens.operators.frames import Frame, Group, Request, frames
from ledgerlens.schema import BASE_COLUMNS

# Frame lengths and bounds in seconds, column name patterns.
HOUR = 3600
DAY = 86400
WEEK = 604800
MONTH = 2592000
BUCKET = 7200

PAIR = {"30d_hist": (-MONTH, -1), "7d_hist": (-WEEK, -1)}
CUSTOMER_FULL = {"7d_full": (-WEEK, 0), "1d_full": (-DAY, 0), "1h_full": (-HOUR, 0)}
CUSTOMER_HISTORY = {
    "30d_hist": (-MONTH, -WEEK),
    "7d_hist": (-WEEK, -DAY),
    "1d_hist": (-DAY, -HOUR),
}
TERMINAL_FULL = {
    "7d_full": (-WEEK, -BUCKET - 1),
    "1d_full": (-DAY, -BUCKET - 1),
    "1h_full": (-BUCKET - 2, -BUCKET - 1),
}
TERMINAL_HISTORY = {
    "30d_hist": (-MONTH, -DAY - BUCKET - 1),
    "7d_hist": (-WEEK, -DAY - BUCKET - 1),
    "1d_hist": (-DAY, -HOUR - BUCKET - 1),
}
FRAUD = {
    "1d_full": (-WEEK - DAY, -WEEK),
    "7d_full": (-2 * WEEK, -WEEK),
    "21d_full": (-MONTH, -WEEK),
}

# The exploratory variants, with buckets of one hour.
EXPLORE_BUCKET = 3600
EXPLORE_PAIR = {"7d_hist": (-WEEK - 1, -1)}
EXPLORE_FULL = {"7d_full": (-WEEK, 0), "1d_full": (-DAY, 0), "1h_full": (-HOUR, 0)}
EXPLORE_HISTORY = {"7d_hist": (-WEEK - HOUR, -HOUR), "1d_hist": (-DAY - HOUR, -HOUR)}
EXPLORE_DELAY = {"3d_delay": (-3 * DAY, 0)}
EXPLORE_FRAUD = {"1d_full": (-4 * DAY, 0), "4d_full": (-7 * DAY, 0)}

# Averages and deviations that the amount is compared with.
RATIO_BASES = [
    "term_tx_amount_avg_30d_hist",
    "term_tx_amount_avg_7d_hist",
    "term_tx_amount_std_30d_hist",
    "term_tx_amount_std_7d_hist",
    "tx_amount_avg_cust_30d_hist",
    "tx_amount_std_cust_30d_hist",
    "tx_amount_avg_cust_7d_hist",
    "tx_amount_std_cust_7d_hist",
]

AMOUNT = "tx_amount"
LABEL = "tx_fraud"
# Flags that the terminal features count.
NEW_FLAGS = ["tx_amount_isnew_ct_30d_hist", "tx_amount_isnew_ct_7d_hist"]


def _amounts(definitions: dict, aggs: set[str], name: str, **more) -> Request:
    return Request(AMOUNT, frames(definitions), frozenset(aggs), name, **more)


def customer_group() -> Group:
    name = "{target}_{agg}_cust_{frame}"
    return Group(
        ("customer_id",),
        (
            _amounts(CUSTOMER_FULL, {"count", "avg"}, name),
            _amounts(CUSTOMER_HISTORY, {"count", "avg", "std"}, name),
        ),
    )


def pair_group() -> Group:
    return Group(
        ("customer_id", "terminal_id"),
        (_amounts(PAIR, {"isnew"}, "{target}_{agg}_ct_{frame}"),),
    )


def _past_buckets(spec: BucketRequest, interval: int) -> BucketRequest:
    """The same spec with frames that end at the bucket before the current one."""
    kept = []
    for frame in spec.request.frames:
        fixed = Frame(frame.name, frame.start, frame.end + 1)
        kept.append(fixed if fixed.end < 0 else frame)
    if any(not holds_a_bucket(frame, interval) for frame in kept):
        raise ValueError("a frame holds no bucket start")
    return replace(spec, request=replace(spec.request, frames=tuple(kept)))


def terminal_specs(fixed: bool = False) -> list[BucketRequest]:
    """Terminal features over two-hour buckets.

    By default the frames are those the models were trained with: they leave out the
    preceding bucket, and the risk counts the labels of the current bucket. ``fixed``
    takes in the preceding bucket and keeps current labels out of the risk.
    """
    name = "term_{target}_{agg}_{frame}"
    zero = {"ddof": 0, "empty": 0}
    full = BucketRequest(_amounts(TERMINAL_FULL, {"count", "avg"}, name, **zero))
    history = BucketRequest(
        _amounts(TERMINAL_HISTORY, {"count", "avg", "std"}, name, **zero), current=False
    )
    new = [
        BucketRequest(
            Request(flag, frames(TERMINAL_FULL), frozenset({"sum"}), name, **zero), current=False
        )
        for flag in NEW_FLAGS
    ]
    fraud = BucketRequest(
        Request(
            LABEL,
            frames(FRAUD),
            frozenset({"sum", "count"}),
            "fraud_{target}_{agg}_{frame}",
            **zero,
        ),
        current=not fixed,
    )
    if not fixed:
        return [full, history, *new, fraud]
    return [*[_past_buckets(spec, BUCKET) for spec in (full, history, *new)], fraud]


def risk_pairs(names: list[str]) -> list[tuple[str, str]]:
    return [(f"fraud_tx_fraud_sum_{name}", f"fraud_tx_fraud_cn_{name}") for name in names]


def explore_customer_groups() -> list[Group]:
    name = "{target}_{agg}_cust_{frame}"
    return [
        Group(
            ("customer_id",),
            (
                _amounts(EXPLORE_FULL, {"count", "avg"}, name, counts="values"),
                _amounts(EXPLORE_HISTORY, {"count", "avg", "std"}, name, counts="values"),
            ),
        ),
        Group(
            ("customer_id", "terminal_id"),
            (_amounts(EXPLORE_PAIR, {"isnew"}, "{target}_{agg}_ct_{frame}", counts="values"),),
        ),
    ]


def explore_terminal_specs(fixed: bool = False) -> list[BucketRequest]:
    """Current values, history, new customers and the frames of the delayed risk.

    The frames of the current values reach into the current bucket, whose rows up to the
    own one then count twice; ``fixed`` ends them before it. Averages of the history
    without rows are missing here, see :data:`EXPLORE_OWN`.
    """
    name = "term_{target}_{agg}_{frame}"
    fraud = "fraud_{target}_{agg}_{frame}"
    labels = frames(EXPLORE_DELAY | EXPLORE_FRAUD)
    values = {"ddof": 0, "counts": "values"}
    zero = {**values, "empty": 0}
    full = EXPLORE_FULL
    if fixed:
        full = {name: (start, -EXPLORE_BUCKET) for name, (start, _) in full.items()}
    return [
        BucketRequest(_amounts(full, {"count", "avg"}, name, **zero)),
        BucketRequest(_amounts(EXPLORE_HISTORY, {"count", "std"}, name, **zero), current=False),
        BucketRequest(_amounts(EXPLORE_HISTORY, {"avg"}, name, **values), current=False),
        BucketRequest(
            Request(NEW_FLAGS[1], frames(EXPLORE_FULL), frozenset({"sum"}), name, **zero),
            current=False,
        ),
        BucketRequest(
            Request(LABEL, labels, frozenset({"sum", "count"}), fraud, **zero), current=False
        ),
    ]


# Averages that take the amount of the row itself where there is no history.
EXPLORE_OWN = {f"term_tx_amount_avg_{name}": AMOUNT for name in EXPLORE_HISTORY}


def feature_columns() -> list[str]:
    """The 54 columns of the feature table, in order."""
    columns = list(BASE_COLUMNS) + NEW_FLAGS
    for request in customer_group().requests:
        for frame in request.frames:
            columns += [request.column(agg, frame) for agg in _ordered(request)]
    for spec in terminal_specs():
        if spec.request.target == LABEL:
            continue
        for frame in spec.request.frames:
            columns += [spec.request.column(agg, frame) for agg in _ordered(spec.request)]
    for name in FRAUD:
        columns += [f"fraud_tx_fraud_cn_{name}_delay", f"fraud_tx_fraud_risk_{name}_delay"]
    return columns


def _ordered(request: Request) -> list[str]:
    return [agg for agg in ("count", "sum", "avg", "std") if agg in request.aggs]

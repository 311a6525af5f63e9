"""Fixed schemas and column lists of the three job stages."""

from __future__ import annotations

# Column names, types and their order are the data contract.
RAW_SCHEMA = (
    "transaction_id BIGINT, tx_datetime STRING, customer_id INT, terminal_id INT, "
    "tx_amount DOUBLE, tx_time_seconds INT, tx_time_days INT, tx_fraud INT, "
    "tx_fraud_scenario INT"
)
CORRUPT = "_corrupt"
CLEAN_SCHEMA = (
    "transaction_id BIGINT, tx_datetime TIMESTAMP, customer_id INT, terminal_id INT, "
    "tx_amount DOUBLE, tx_time_seconds INT, tx_time_days INT, tx_fraud BOOLEAN, "
    "tx_fraud_scenario INT"
)
RAW_COLUMNS = [part.split()[0] for part in RAW_SCHEMA.split(", ")]
BASE_COLUMNS = [*RAW_COLUMNS, "unix_time"]

# Columns that never enter the model.
NOT_MODEL_INPUTS = [
    "terminal_id",
    "transaction_id",
    "tx_datetime",
    "customer_id",
    "tx_time_seconds",
    "tx_time_days",
    "tx_fraud",
    "tx_fraud_scenario",
    "unix_time",
    "hour",
    "day_of_week",
]

# Replacement for missing or negative ids and offsets.
UNKNOWN = -1
REPAIRED_COLUMNS = [
    "customer_id",
    "terminal_id",
    "tx_fraud_scenario",
    "tx_time_seconds",
    "tx_time_days",
]

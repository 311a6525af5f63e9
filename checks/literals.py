"""Numbers and names as the SQL states them, independent of the library.

Fixed values: frame bounds in seconds, and the names of columns.
"""

from __future__ import annotations

HOUR, DAY, WEEK = 3600, 86400, 604800
BUCKET, EXPLORE_BUCKET = 7200, 3600

PAIR = {"30d_hist": (-2592000, -1), "7d_hist": (-604800, -1)}
CUSTOMER_FULL = {"7d_full": (-604800, 0), "1d_full": (-86400, 0), "1h_full": (-3600, 0)}
CUSTOMER_HISTORY = {
    "30d_hist": (-2592000, -604800),
    "7d_hist": (-604800, -86400),
    "1d_hist": (-86400, -3600),
}
TERMINAL_FULL = {"7d_full": (-604800, -7201), "1d_full": (-86400, -7201), "1h_full": (-7202, -7201)}
TERMINAL_HISTORY = {
    "30d_hist": (-2592000, -93601),
    "7d_hist": (-604800, -93601),
    "1d_hist": (-86400, -10801),
}
FRAUD = {
    "1d_full": (-691200, -604800),
    "7d_full": (-1209600, -604800),
    "21d_full": (-2592000, -604800),
}
FIXED = {"1h": (-7200, -1), "1d": (-86400, -7200)}
FIXED_FULL = {"7d_full": (-604800, -7200), "1d_full": (-86400, -7200), "1h_full": (-7202, -7200)}

EXPLORE_PAIR = {"7d_hist": (-604801, -1)}
EXPLORE_FULL = {"7d_full": (-604800, 0), "1d_full": (-86400, 0), "1h_full": (-3600, 0)}
EXPLORE_HISTORY = {"7d_hist": (-608400, -3600), "1d_hist": (-90000, -3600)}
EXPLORE_DELAY = {"3d_delay": (-259200, 0)}
EXPLORE_FRAUD = {"1d_full": (-345600, 0), "4d_full": (-604800, 0)}

NEW_FLAGS = ["tx_amount_isnew_ct_30d_hist", "tx_amount_isnew_ct_7d_hist"]
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
FEATURE_COLUMNS = """
transaction_id tx_datetime customer_id terminal_id tx_amount tx_time_seconds tx_time_days
tx_fraud tx_fraud_scenario unix_time tx_amount_isnew_ct_30d_hist tx_amount_isnew_ct_7d_hist
tx_amount_cn_cust_7d_full tx_amount_avg_cust_7d_full tx_amount_cn_cust_1d_full
tx_amount_avg_cust_1d_full tx_amount_cn_cust_1h_full tx_amount_avg_cust_1h_full
tx_amount_cn_cust_30d_hist tx_amount_avg_cust_30d_hist tx_amount_std_cust_30d_hist
tx_amount_cn_cust_7d_hist tx_amount_avg_cust_7d_hist tx_amount_std_cust_7d_hist
tx_amount_cn_cust_1d_hist tx_amount_avg_cust_1d_hist tx_amount_std_cust_1d_hist
term_tx_amount_cn_7d_full term_tx_amount_avg_7d_full term_tx_amount_cn_1d_full
term_tx_amount_avg_1d_full term_tx_amount_cn_1h_full term_tx_amount_avg_1h_full
term_tx_amount_cn_30d_hist term_tx_amount_avg_30d_hist term_tx_amount_std_30d_hist
term_tx_amount_cn_7d_hist term_tx_amount_avg_7d_hist term_tx_amount_std_7d_hist
term_tx_amount_cn_1d_hist term_tx_amount_avg_1d_hist term_tx_amount_std_1d_hist
term_tx_amount_isnew_ct_30d_hist_sum_7d_full term_tx_amount_isnew_ct_30d_hist_sum_1d_full
term_tx_amount_isnew_ct_30d_hist_sum_1h_full term_tx_amount_isnew_ct_7d_hist_sum_7d_full
term_tx_amount_isnew_ct_7d_hist_sum_1d_full term_tx_amount_isnew_ct_7d_hist_sum_1h_full
fraud_tx_fraud_cn_1d_full_delay fraud_tx_fraud_risk_1d_full_delay
fraud_tx_fraud_cn_7d_full_delay fraud_tx_fraud_risk_7d_full_delay
fraud_tx_fraud_cn_21d_full_delay fraud_tx_fraud_risk_21d_full_delay
""".split()
# Model inputs beside the features: flags, places on a circle, and ratios.
ROW_INPUTS = """
is_night is_weekend is_rovn_sum is_unknonw_terminal is_unknonw_customer
hour_sin hour_cos day_sin day_cos
""".split()
NOT_INPUTS = """
transaction_id tx_datetime customer_id terminal_id tx_time_seconds tx_time_days tx_fraud
tx_fraud_scenario unix_time
""".split()


def risk_pairs(names) -> list[tuple[str, str]]:
    return [(f"fraud_tx_fraud_sum_{name}", f"fraud_tx_fraud_cn_{name}") for name in names]


def model_inputs() -> list[str]:
    features = [c for c in FEATURE_COLUMNS if c not in NOT_INPUTS and c not in RATIO_BASES]
    return [*features, *ROW_INPUTS, *[f"ratio_{base}" for base in RATIO_BASES]]

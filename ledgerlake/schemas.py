"""Data model: raw landing schemas, curated table schemas and the fixed
lookup values the ledger domain defines.

Raw records are read with an explicit schema (no inference); amounts stay
strings there and become ``decimal(38,7)`` once curated (7 fractional
digits is the ledger's native precision).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

AMOUNT = T.DecimalType(38, 7)
# Σ of decimal(28,7) is decimal(38,7): summing at (28,7) keeps headroom.
AMOUNT_SUM_INPUT = T.DecimalType(28, 7)

# ---------------------------------------------------------------------------
# Fixed values of the ledger domain (must equal the reference's lists).
# ---------------------------------------------------------------------------

# All operation types, in the reference's declared order.
OPERATION_TYPES = [
    "create_account",
    "payment",
    "path_payment_strict_receive",
    "path_payment_strict_send",
    "manage_sell_offer",
    "manage_buy_offer",
    "create_passive_sell_offer",
    "set_options",
    "change_trust",
    "allow_trust",
    "account_merge",
    "inflation",
    "manage_data",
    "bump_sequence",
    "claim_claimable_balance",
    "begin_sponsoring_future_reserves",
    "end_sponsoring_future_reserves",
    "revoke_sponsorship",
    "clawback",
    "clawback_claimable_balance",
    "set_trust_line_flags",
    "liquidity_pool_deposit",
    "liquidity_pool_withdraw",
    "invoke_host_function",
]

# Operation type -> category (types in no list are "other").
PAYMENT_OPERATIONS = ["payment", "path_payment_strict_receive", "path_payment_strict_send"]
TRUSTLINE_OPERATIONS = ["change_trust", "allow_trust", "set_trust_line_flags", "clawback",
                        "clawback_claimable_balance"]
ACCOUNT_OPERATIONS = ["create_account", "set_options", "account_merge", "bump_sequence",
                      "begin_sponsoring_future_reserves", "end_sponsoring_future_reserves",
                      "revoke_sponsorship"]
DEX_OPERATIONS = ["manage_sell_offer", "manage_buy_offer", "create_passive_sell_offer",
                  "liquidity_pool_deposit", "liquidity_pool_withdraw"]
CONTRACT_OPERATIONS = ["invoke_host_function"]
DATA_OPERATIONS = ["manage_data", "claim_claimable_balance"]

OPERATION_CATEGORIES = [
    ("payment", PAYMENT_OPERATIONS),
    ("trustline", TRUSTLINE_OPERATIONS),
    ("account", ACCOUNT_OPERATIONS),
    ("dex", DEX_OPERATIONS),
    ("contract", CONTRACT_OPERATIONS),
    ("data", DATA_OPERATIONS),
]

# Operation type -> display name.
OPERATION_LABELS = {
    "create_account": "Create Account",
    "payment": "Payment",
    "path_payment_strict_receive": "Path Payment (Strict Receive)",
    "path_payment_strict_send": "Path Payment (Strict Send)",
    "manage_sell_offer": "Manage Sell Offer",
    "manage_buy_offer": "Manage Buy Offer",
    "create_passive_sell_offer": "Create Passive Sell Offer",
    "set_options": "Set Options",
    "change_trust": "Change Trust",
    "allow_trust": "Allow Trust",
    "account_merge": "Account Merge",
    "inflation": "Inflation",
    "manage_data": "Manage Data",
    "bump_sequence": "Bump Sequence",
    "claim_claimable_balance": "Claim Claimable Balance",
    "begin_sponsoring_future_reserves": "Begin Sponsoring Future Reserves",
    "end_sponsoring_future_reserves": "End Sponsoring Future Reserves",
    "revoke_sponsorship": "Revoke Sponsorship",
    "clawback": "Clawback",
    "clawback_claimable_balance": "Clawback Claimable Balance",
    "set_trust_line_flags": "Set Trust Line Flags",
    "liquidity_pool_deposit": "Liquidity Pool Deposit",
    "liquidity_pool_withdraw": "Liquidity Pool Withdraw",
    "invoke_host_function": "Invoke Host Function",
}

ASSET_TYPES = ["native", "credit_alphanum4", "credit_alphanum12"]
MEMO_TYPES = ["none", "text", "id", "hash", "return"]

# Time-range labels -> seconds (union of the API and chart labels).
TIME_RANGES = {
    "1h": 3600,
    "6h": 6 * 3600,
    "24h": 24 * 3600,
    "7d": 7 * 86400,
    "30d": 30 * 86400,
    "90d": 90 * 86400,
    "365d": 365 * 86400,
}
# The three analytic horizons used by stats, asset and account metrics.
HORIZONS = [("24h", 24 * 3600), ("7d", 7 * 86400), ("30d", 30 * 86400)]

# Retention policy in days per table.
RETENTION_DAYS = {
    "ledgers": 365,
    "transactions": 180,
    "operations": 180,
    "payments": 90,
    "network_metrics": 365,
    "asset_metrics": 90,
    "account_metrics": 90,
}

# Duration histogram bucket sets (seconds, cumulative "le" buckets).
HISTOGRAM_BUCKETS = {
    "cycle": [0.1, 0.5, 1, 2, 5, 10, 30],
    "db_write": [0.01, 0.05, 0.1, 0.5, 1, 2],
    "source_request": [0.1, 0.25, 0.5, 1, 2, 5],
}

# Operating parameters.
PAGE_SIZE_DEFAULT = 20
PAGE_SIZE_MAX = 100
SLOW_QUERY_MS = 100
DEAD_LETTER_MAX_ATTEMPTS = 5
RETRY_BASE_MS = 1000
RETRY_CAP_MS = 300_000
RECONNECT_CAP_MS = 30_000
WRITE_CHUNK_ROWS = 100
LIVE_POLL_LEDGERS = 10
LIVE_POLL_TRANSACTIONS = 20
STROOPS_PER_UNIT = 10_000_000

# Validation patterns.
ADDRESS_PATTERN = r"^G[A-Z2-7]{55}$"
HASH_PATTERN = r"^[a-fA-F0-9]{64}$"
NUMERIC_STRING_PATTERN = r"^\d+(\.\d+)?$"
ISO_WITH_OFFSET_PATTERN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})$"

# ---------------------------------------------------------------------------
# Raw landing schemas (JSON records as the ledger API emits them).
# ---------------------------------------------------------------------------

RAW_LEDGER = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("paging_token", T.StringType()),
    T.StructField("hash", T.StringType()),
    T.StructField("sequence", T.LongType()),
    T.StructField("successful_transaction_count", T.LongType()),
    T.StructField("failed_transaction_count", T.LongType()),
    T.StructField("operation_count", T.LongType()),
    T.StructField("tx_set_operation_count", T.LongType()),
    T.StructField("closed_at", T.StringType()),
    T.StructField("total_coins", T.StringType()),
    T.StructField("fee_pool", T.StringType()),
    T.StructField("base_fee_in_stroops", T.LongType()),
    T.StructField("base_reserve_in_stroops", T.LongType()),
    T.StructField("max_tx_set_size", T.LongType()),
    T.StructField("protocol_version", T.LongType()),
    T.StructField("header_xdr", T.StringType()),
])

INNER_TRANSACTION = T.StructType([
    T.StructField("hash", T.StringType()),
    T.StructField("signatures", T.ArrayType(T.StringType())),
])

RAW_TRANSACTION = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("paging_token", T.StringType()),
    T.StructField("successful", T.BooleanType()),
    T.StructField("hash", T.StringType()),
    T.StructField("ledger", T.LongType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("source_account", T.StringType()),
    T.StructField("source_account_sequence", T.StringType()),
    T.StructField("fee_account", T.StringType()),
    # Fee arrives as string or number; reading it as string coerces both.
    T.StructField("fee_charged", T.StringType()),
    T.StructField("max_fee", T.StringType()),
    T.StructField("operation_count", T.LongType()),
    T.StructField("envelope_xdr", T.StringType()),
    T.StructField("result_xdr", T.StringType()),
    T.StructField("result_meta_xdr", T.StringType()),
    T.StructField("fee_meta_xdr", T.StringType()),
    T.StructField("memo_type", T.StringType()),
    T.StructField("memo", T.StringType()),
    T.StructField("signatures", T.ArrayType(T.StringType())),
    T.StructField("valid_after", T.StringType()),
    T.StructField("valid_before", T.StringType()),
    T.StructField("fee_bump_transaction", T.BooleanType()),
    T.StructField("inner_transaction", INNER_TRANSACTION),
])

RAW_OPERATION = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("paging_token", T.StringType()),
    T.StructField("transaction_hash", T.StringType()),
    T.StructField("transaction_successful", T.BooleanType()),
    T.StructField("type", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("source_account", T.StringType()),
    # payment / path payments
    T.StructField("from", T.StringType()),
    T.StructField("to", T.StringType()),
    T.StructField("amount", T.StringType()),
    T.StructField("asset_type", T.StringType()),
    T.StructField("asset_code", T.StringType()),
    T.StructField("asset_issuer", T.StringType()),
    T.StructField("source_amount", T.StringType()),
    T.StructField("source_max", T.StringType()),
    T.StructField("destination_asset", T.StringType()),
    T.StructField("destination_min", T.StringType()),
    T.StructField("path", T.ArrayType(T.StructType([
        T.StructField("asset_type", T.StringType()),
        T.StructField("asset_code", T.StringType()),
        T.StructField("asset_issuer", T.StringType()),
    ]))),
    # create_account
    T.StructField("account", T.StringType()),
    T.StructField("funder", T.StringType()),
    T.StructField("starting_balance", T.StringType()),
    # manage_sell_offer
    T.StructField("offer_id", T.StringType()),
    T.StructField("price", T.StringType()),
    T.StructField("selling_asset", T.StringType()),
    T.StructField("buying_asset", T.StringType()),
    T.StructField("selling_asset_type", T.StringType()),
    T.StructField("buying_asset_type", T.StringType()),
    # change_trust
    T.StructField("limit", T.StringType()),
    T.StructField("trustor", T.StringType()),
    T.StructField("trustee", T.StringType()),
])

# One landed unit of work: a ledger with its transactions and operations.
RAW_LEDGER_UNIT = T.StructType(RAW_LEDGER.fields + [
    T.StructField("transactions", T.ArrayType(RAW_TRANSACTION)),
    T.StructField("operations", T.ArrayType(RAW_OPERATION)),
])

RAW_SCHEMAS = {
    "ledger_unit": RAW_LEDGER_UNIT,
    "ledger": RAW_LEDGER,
    "transaction": RAW_TRANSACTION,
    "operation": RAW_OPERATION,
    "payment": RAW_OPERATION,
}

# ---------------------------------------------------------------------------
# Curated schemas.
# ---------------------------------------------------------------------------

LEDGERS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("hash", T.StringType()),
    T.StructField("sequence", T.LongType()),
    T.StructField("successful_transaction_count", T.LongType()),
    T.StructField("failed_transaction_count", T.LongType()),
    T.StructField("operation_count", T.LongType()),
    T.StructField("tx_set_operation_count", T.LongType()),
    T.StructField("closed_at", T.TimestampNTZType()),
    T.StructField("total_coins", AMOUNT),
    T.StructField("fee_pool", AMOUNT),
    T.StructField("base_fee_in_stroops", T.LongType()),
    T.StructField("base_reserve_in_stroops", T.LongType()),
    T.StructField("max_tx_set_size", T.LongType()),
    T.StructField("protocol_version", T.LongType()),
    T.StructField("header_xdr", T.StringType()),
])

TRANSACTIONS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("paging_token", T.StringType()),
    T.StructField("successful", T.BooleanType()),
    T.StructField("hash", T.StringType()),
    T.StructField("ledger_sequence", T.LongType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("source_account", T.StringType()),
    T.StructField("source_account_sequence", T.StringType()),
    T.StructField("fee_account", T.StringType()),
    T.StructField("fee_charged", T.LongType()),
    T.StructField("max_fee", T.LongType()),
    T.StructField("operation_count", T.LongType()),
    T.StructField("envelope_xdr", T.StringType()),
    T.StructField("result_xdr", T.StringType()),
    T.StructField("result_meta_xdr", T.StringType()),
    T.StructField("fee_meta_xdr", T.StringType()),
    T.StructField("memo_type", T.StringType()),
    T.StructField("memo", T.StringType()),
    T.StructField("signatures", T.ArrayType(T.StringType())),
    T.StructField("valid_after", T.TimestampNTZType()),
    T.StructField("valid_before", T.TimestampNTZType()),
    T.StructField("fee_bump_transaction", T.BooleanType()),
    T.StructField("inner_transaction_hash", T.StringType()),
    T.StructField("inner_transaction_signatures", T.ArrayType(T.StringType())),
])

OPERATIONS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("paging_token", T.StringType()),
    T.StructField("transaction_hash", T.StringType()),
    T.StructField("transaction_successful", T.BooleanType()),
    T.StructField("type", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("source_account", T.StringType()),
    T.StructField("ledger_sequence", T.LongType()),
    T.StructField("operation_index", T.IntegerType()),
    T.StructField("details", T.StringType()),
])

PAYMENTS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("from", T.StringType()),
    T.StructField("to", T.StringType()),
    T.StructField("amount", T.StringType()),
    T.StructField("asset", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

ACCOUNTS = T.StructType([
    T.StructField("account_id", T.StringType()),
    T.StructField("balance", T.StringType()),
    T.StructField("asset_type", T.StringType()),
    T.StructField("asset_code", T.StringType()),
    T.StructField("asset_issuer", T.StringType()),
    T.StructField("buying_liabilities", T.StringType()),
    T.StructField("selling_liabilities", T.StringType()),
    T.StructField("last_modified_ledger", T.LongType()),
    T.StructField("is_authorized", T.BooleanType()),
    T.StructField("is_authorized_to_maintain_liabilities", T.BooleanType()),
    T.StructField("is_clawback_enabled", T.BooleanType()),
    T.StructField("sequence_number", T.StringType()),
    T.StructField("num_subentries", T.LongType()),
    T.StructField("thresholds", T.StructType([
        T.StructField("low_threshold", T.IntegerType()),
        T.StructField("med_threshold", T.IntegerType()),
        T.StructField("high_threshold", T.IntegerType())])),
    T.StructField("flags", T.StructType([
        T.StructField("auth_required", T.BooleanType()),
        T.StructField("auth_revocable", T.BooleanType()),
        T.StructField("auth_immutable", T.BooleanType())])),
    T.StructField("signers", T.ArrayType(T.StructType([
        T.StructField("key", T.StringType()),
        T.StructField("weight", T.IntegerType()),
        T.StructField("type", T.StringType())]))),
    T.StructField("data", T.MapType(T.StringType(), T.StringType())),
    T.StructField("sponsor", T.StringType()),
    T.StructField("num_sponsored", T.LongType()),
    T.StructField("num_sponsoring", T.LongType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("updated_at", T.TimestampNTZType()),
    T.StructField("deleted_at", T.TimestampNTZType()),
])

ASSETS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("asset_type", T.StringType()),
    T.StructField("asset_code", T.StringType()),
    T.StructField("asset_issuer", T.StringType()),
    T.StructField("native", T.BooleanType()),
])

TRUSTLINES = T.StructType([
    T.StructField("account_id", T.StringType()),
    T.StructField("asset_id", T.LongType()),
    T.StructField("balance", T.StringType()),
    T.StructField("limit", T.StringType()),
    T.StructField("buying_liabilities", T.StringType()),
    T.StructField("selling_liabilities", T.StringType()),
    T.StructField("is_authorized", T.BooleanType()),
    T.StructField("is_authorized_to_maintain_liabilities", T.BooleanType()),
    T.StructField("is_clawback_enabled", T.BooleanType()),
    T.StructField("last_modified_ledger", T.LongType()),
    T.StructField("sponsor", T.StringType()),
    T.StructField("deleted_at", T.TimestampNTZType()),
])

# Metric snapshots as the jobs produce them (rates and averages as doubles
# rounded HALF_UP; amounts as decimal text).
NETWORK_METRICS = T.StructType([
    T.StructField("sequence", T.LongType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("ledger_count", T.LongType()),
    T.StructField("transaction_count", T.LongType()),
    T.StructField("operation_count", T.LongType()),
    T.StructField("active_accounts", T.LongType()),
    T.StructField("total_volume", T.StringType()),
    T.StructField("average_fee", T.DoubleType()),
    T.StructField("success_rate", T.DoubleType()),
])

ASSET_METRICS = T.StructType([
    T.StructField("asset_id", T.LongType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("volume_24h", T.StringType()),
    T.StructField("volume_7d", T.StringType()),
    T.StructField("volume_30d", T.StringType()),
    T.StructField("trades_24h", T.LongType()),
    T.StructField("trades_7d", T.LongType()),
    T.StructField("trades_30d", T.LongType()),
    T.StructField("price_change_24h", T.DoubleType()),
    T.StructField("market_cap", T.StringType()),
    T.StructField("holders", T.LongType()),
])

ACCOUNT_METRICS = T.StructType([
    T.StructField("account_id", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("balance_native", T.StringType()),
    T.StructField("total_balance_usd", T.StringType()),
    T.StructField("transaction_count_24h", T.LongType()),
    T.StructField("transaction_count_7d", T.LongType()),
    T.StructField("transaction_count_30d", T.LongType()),
    T.StructField("first_transaction", T.TimestampNTZType()),
    T.StructField("last_transaction", T.TimestampNTZType()),
    T.StructField("is_active", T.BooleanType()),
    T.StructField("trustlines", T.LongType()),
    T.StructField("signers", T.LongType()),
])

PROCESSED_LEDGERS = T.StructType([
    T.StructField("sequence", T.LongType(), False),
    T.StructField("processed_at", T.TimestampNTZType()),
    T.StructField("tx_count", T.LongType()),
    T.StructField("op_count", T.LongType()),
])

DEAD_LETTER = T.StructType([
    T.StructField("sequence", T.LongType(), False),
    T.StructField("attempt_count", T.LongType()),
    T.StructField("first_failed_at", T.TimestampNTZType()),
    T.StructField("last_failed_at", T.TimestampNTZType()),
    T.StructField("last_error", T.StringType()),
])

FAILURE_LOG = T.StructType([
    T.StructField("sequence", T.LongType(), False),
    T.StructField("failed_at", T.TimestampNTZType()),
    T.StructField("error", T.StringType()),
])


def lookup_frame(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A small constant frame (bounded by the fixed lists above)."""
    return spark.createDataFrame(rows, schema)


def operation_category_frame(spark: SparkSession) -> DataFrame:
    rows = [(t, cat) for cat, types in OPERATION_CATEGORIES for t in types]
    return lookup_frame(spark, rows, "type string, category string")


def operation_label_frame(spark: SparkSession) -> DataFrame:
    return lookup_frame(spark, list(OPERATION_LABELS.items()), "type string, label string")

"""Second batch of registered queries: quality, windows, projections,
filters, search, metrics builds and maintenance jobs (see catalog.py)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake import schemas as S
from ledgerlake.operators import aggregates as A
from ledgerlake.operators import filters as FL
from ledgerlake.operators import joins as J
from ledgerlake.operators import maintain as M
from ledgerlake.operators import paging as L
from ledgerlake.operators import project as P
from ledgerlake.operators import quality as Q
from ledgerlake.operators import search as U
from ledgerlake.operators import windows as W
from ledgerlake.plans.catalog import (NETWORK_METRICS_SQL, PAYMENTS_SQL, _t, amt_txt, category_case,
                                      cte, json_amt, query, ratio_sql)
from ledgerlake.plans.testviews import _views, SPARK

# ---------------------------------------------------------------------------
# Quality
# ---------------------------------------------------------------------------


def _view_columns(name: str) -> set[str]:
    import re
    text = _views(SPARK)[name]
    return set(re.findall(r"AS `?([a-z_]+)`?\s*(?:,|\n\s*FROM)", text))


def _rule_sql(field: str, kind: str, cols: set[str]) -> str:
    top = field.split(".")[0]
    c = f'"{field}"' if "." not in field else ".".join(f'"{p}"' for p in field.split("."))
    if top not in cols:
        c = "NULL"

    def rx(p):
        return f"NOT COALESCE(regexp_matches({c}, '{p}'), false)"
    return {
        "required": f"{c} IS NULL",
        "nonempty": f"({c} IS NULL OR length(CAST({c} AS VARCHAR)) < 1)",
        "gt0": f"({c} IS NULL OR NOT (CAST({c} AS BIGINT) > 0))",
        "ge0": f"({c} IS NULL OR NOT (CAST({c} AS BIGINT) >= 0))",
        "iso": rx(S.ISO_WITH_OFFSET_PATTERN),
        "numeric": rx(S.NUMERIC_STRING_PATTERN),
        "hash": rx(S.HASH_PATTERN),
        "address": rx(S.ADDRESS_PATTERN),
        "address_or_null": f"({c} IS NOT NULL AND {rx(S.ADDRESS_PATTERN)})",
        "required_if_parent": ("false" if top not in cols else f'("{top}" IS NOT NULL AND {c} IS NULL)'),
        "hash_if_parent": ("false" if top not in cols else
                           f'("{top}" IS NOT NULL AND {rx(S.HASH_PATTERN)})'),
    }[kind]


# Fixed rules, written out for the oracle alone: "field kind" per line, with
# the operation type in front where a rule is bound to it.
ORACLE_RULES = {
    "ledger": """id nonempty
paging_token nonempty
sequence gt0
successful_transaction_count ge0
failed_transaction_count ge0
operation_count ge0
tx_set_operation_count ge0
closed_at iso
total_coins numeric
fee_pool numeric
base_fee_in_stroops ge0
base_reserve_in_stroops ge0
max_tx_set_size gt0
protocol_version ge0
header_xdr nonempty""",
    "transaction": """id nonempty
paging_token nonempty
successful required
hash hash
ledger gt0
created_at iso
source_account address
source_account_sequence nonempty
fee_account address_or_null
fee_charged required
max_fee required
operation_count ge0
envelope_xdr nonempty
result_xdr nonempty
result_meta_xdr nonempty
fee_meta_xdr nonempty
signatures required
inner_transaction.hash hash_if_parent
inner_transaction.signatures required_if_parent""",
    "operation": """id nonempty
paging_token nonempty
transaction_hash hash
transaction_successful required
type nonempty
created_at iso
source_account address
payment:from address
payment:to address
payment:amount numeric
payment:asset_type nonempty
payment:asset_issuer address_or_null
path_payment_strict_receive:from address
path_payment_strict_receive:to address
path_payment_strict_receive:amount numeric
path_payment_strict_receive:asset_type nonempty
path_payment_strict_receive:asset_issuer address_or_null
path_payment_strict_receive:source_amount numeric
path_payment_strict_send:from address
path_payment_strict_send:to address
path_payment_strict_send:amount numeric
path_payment_strict_send:asset_type nonempty
path_payment_strict_send:asset_issuer address_or_null
path_payment_strict_send:source_amount numeric
create_account:account address
create_account:funder address
create_account:starting_balance numeric""",
}
ORACLE_MESSAGES = {
    "required": "Required", "required_if_parent": "Required", "nonempty": "must be a non-empty string",
    "gt0": "must be a positive integer", "ge0": "must be a non-negative integer",
    "iso": "must be an ISO date-time with offset", "numeric": "Expected a numeric string",
    "hash": "Invalid transaction hash", "hash_if_parent": "Invalid transaction hash",
    "address": "Invalid account address", "address_or_null": "Invalid account address",
}


def errors_sql(entity: str, view: str) -> str:
    cols = _view_columns(view)
    arms = []
    rules = []
    for line in ORACLE_RULES[entity].splitlines():
        name, kind = line.split()
        t, _, field = name.rpartition(":")
        rules.append(((field, kind, ORACLE_MESSAGES[kind]), t or None))
    for (field, kind, msg), t in rules:
        cond = _rule_sql(field, kind, cols)
        top = field.split(".")[0]
        value = ('"' + field + '"') if top in cols else "NULL"
        missing = None if kind.endswith(("_or_null", "_if_parent")) else f"{value} IS NULL"
        if t is not None:
            cond = f"(type = '{t}' AND {cond})"
            missing = None if missing is None else f"(type = '{t}' AND {missing})"
        if missing is None:
            arms.append(f"CASE WHEN {cond} THEN '{field}: {msg}' END")
        else:
            arms.append(f"CASE WHEN {missing} THEN '{field}: Required' WHEN {cond} THEN '{field}: {msg}' END")
    return f"concat_ws('; ', {', '.join(arms)})"


@query("validation_errors_transactions", cte("raw_tx_orders") + f"""
SELECT id, errs AS error FROM (
  SELECT id, {errors_sql('transaction', 'raw_tx_orders')} AS errs FROM raw_tx_orders)
WHERE errs <> ''""")
def q_validation_errors_transactions(spark, sf):
    """Q2/Q4: invalid raw transactions with their error text."""
    _, invalid = Q.split_valid(_t(spark, sf).raw_tx_orders, "transaction")
    return invalid.select(F.get_json_object("raw", "$.id").alias("id"), "error")


@query("valid_transactions", cte("raw_tx_orders") + f"""
SELECT id, hash FROM raw_tx_orders WHERE {errors_sql('transaction', 'raw_tx_orders')} = ''""")
def q_valid_transactions(spark, sf):
    """Q4: the valid side of the split."""
    valid, _ = Q.split_valid(_t(spark, sf).raw_tx_orders, "transaction")
    return valid.select("id", "hash")


@query("validation_report_operations", cte("raw_ops_events") + f"""
SELECT 'operation' AS entity, split_part(e, ':', 1) AS rule, count(*) AS failures
FROM (SELECT unnest(string_split(errs, '; ')) AS e
      FROM (SELECT {errors_sql('operation', 'raw_ops_events')} AS errs FROM raw_ops_events) WHERE errs <> '')
GROUP BY 2""")
def q_validation_report_operations(spark, sf):
    """Q3/Q5: type-dispatched operation checks, failures per rule."""
    return Q.validation_report(_t(spark, sf).raw_ops_events, "operation")


@query("validation_report_ledgers", cte("raw_ledgers_orders") + f"""
SELECT 'ledger' AS entity, split_part(e, ':', 1) AS rule, count(*) AS failures
FROM (SELECT unnest(string_split(errs, '; ')) AS e
      FROM (SELECT {errors_sql('ledger', 'raw_ledgers_orders')} AS errs FROM raw_ledgers_orders) WHERE errs <> '')
GROUP BY 2""")
def q_validation_report_ledgers(spark, sf):
    """Q1/Q5: ledger checks, failures per rule (empty when all pass)."""
    return Q.validation_report(_t(spark, sf).raw_ledgers_orders, "ledger")


@query("integrity_report", cte("op_lineitem", "tx_orders", "ledgers_orders", "trustlines", "accounts", "assets") + """
SELECT 'operations.transaction_hash -> transactions.hash' AS rule,
       (SELECT count(*) FROM op_lineitem o WHERE NOT EXISTS (SELECT 1 FROM tx_orders t WHERE t.hash = o.transaction_hash)) AS violations
UNION ALL
SELECT 'transactions.ledger_sequence -> ledgers.sequence',
       (SELECT count(*) FROM tx_orders t WHERE NOT EXISTS (SELECT 1 FROM ledgers_orders l WHERE l.sequence = t.ledger_sequence))
UNION ALL
SELECT 'operations.id unique', (SELECT count(*) FROM (SELECT id FROM op_lineitem GROUP BY id HAVING count(*) > 1))
UNION ALL
SELECT 'transactions.hash unique', (SELECT count(*) FROM (SELECT hash FROM tx_orders GROUP BY hash HAVING count(*) > 1))
UNION ALL
SELECT 'ledgers.sequence unique', (SELECT count(*) FROM (SELECT sequence FROM ledgers_orders GROUP BY sequence HAVING count(*) > 1))
UNION ALL
SELECT 'operations.ledger_sequence -> ledgers.sequence',
       (SELECT count(*) FROM op_lineitem o WHERE NOT EXISTS (SELECT 1 FROM ledgers_orders l WHERE l.sequence = o.ledger_sequence))
UNION ALL
SELECT 'trustlines.account_id -> accounts.account_id',
       (SELECT count(*) FROM trustlines t WHERE NOT EXISTS (SELECT 1 FROM accounts a WHERE a.account_id = t.account_id))
UNION ALL
SELECT 'trustlines.asset_id -> assets.id',
       (SELECT count(*) FROM trustlines t WHERE NOT EXISTS (SELECT 1 FROM assets a WHERE a.id = t.asset_id))
UNION ALL
SELECT 'assets (asset_type, asset_code, asset_issuer) unique',
       (SELECT count(*) FROM (SELECT asset_type, asset_code, asset_issuer FROM assets GROUP BY ALL HAVING count(*) > 1))
UNION ALL
SELECT 'trustlines (account_id, asset_id) unique',
       (SELECT count(*) FROM (SELECT account_id, asset_id FROM trustlines GROUP BY ALL HAVING count(*) > 1))""")
def q_integrity_report(spark, sf):
    """Q6: foreign-key and uniqueness violations, one row per rule."""
    t = _t(spark, sf)
    op, tx, led = t.op_lineitem, t.tx_orders, t.ledgers_orders
    n_op, n_tx, n_account, n_asset = t.rows("lineitem", "orders", "customer", "part")
    n_led = led.count()
    parts = [
        Q.table_integrity(op, ("operations.id unique", ["id"]), [
            ("operations.transaction_hash -> transactions.hash", "transaction_hash", tx, "hash"),
            ("operations.ledger_sequence -> ledgers.sequence", "ledger_sequence", led, "sequence")],
            rows=[n_op, n_tx, n_led]),
        Q.table_integrity(tx, ("transactions.hash unique", ["hash"]), [
            ("transactions.ledger_sequence -> ledgers.sequence", "ledger_sequence", led, "sequence")], rows=[n_tx, n_led]),
        Q.table_integrity(led, ("ledgers.sequence unique", ["sequence"]), rows=[n_led]),
        Q.table_integrity(t.trustlines, ("trustlines (account_id, asset_id) unique", ["account_id", "asset_id"]), [
            ("trustlines.account_id -> accounts.account_id", "account_id", t.accounts, "account_id"),
            ("trustlines.asset_id -> assets.id", "asset_id", t.assets, "id")],
            rows=[n_op, n_account, n_asset]),
        Q.table_integrity(t.assets, ("assets (asset_type, asset_code, asset_issuer) unique",
                                     ["asset_type", "asset_code", "asset_issuer"]), rows=[n_asset]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# Fixed values of the stored tables, written out for the oracle.
MEMO_TYPES_SQL = "'none', 'text', 'id', 'hash', 'return'"
OPERATION_TYPES_SQL = """'create_account', 'payment', 'path_payment_strict_receive', 'path_payment_strict_send',
  'manage_sell_offer', 'manage_buy_offer', 'create_passive_sell_offer', 'set_options', 'change_trust', 'allow_trust',
  'account_merge', 'inflation', 'manage_data', 'bump_sequence', 'claim_claimable_balance',
  'begin_sponsoring_future_reserves', 'end_sponsoring_future_reserves', 'revoke_sponsorship', 'clawback',
  'clawback_claimable_balance', 'set_trust_line_flags', 'liquidity_pool_deposit', 'liquidity_pool_withdraw',
  'invoke_host_function'"""
CONSTRAINTS_OP_SQL = f"""
SELECT 'type allowed values' AS rule, count(*) FILTER (type NOT IN ({OPERATION_TYPES_SQL})) AS violations FROM op_lineitem
UNION ALL SELECT 'id max length 64', count(*) FILTER (length(id) > 64) FROM op_lineitem
UNION ALL SELECT 'paging_token max length 64', count(*) FILTER (length(paging_token) > 64) FROM op_lineitem
UNION ALL SELECT 'transaction_hash max length 64', count(*) FILTER (length(transaction_hash) > 64) FROM op_lineitem
UNION ALL SELECT 'type max length 32', count(*) FILTER (length(type) > 32) FROM op_lineitem
UNION ALL SELECT 'source_account max length 56', count(*) FILTER (length(source_account) > 56) FROM op_lineitem"""
CONSTRAINTS_TX_SQL = f"""
SELECT 'memo_type allowed values' AS rule, count(*) FILTER (memo_type NOT IN ({MEMO_TYPES_SQL})) AS violations FROM tx_orders
UNION ALL SELECT 'id max length 64', count(*) FILTER (length(id) > 64) FROM tx_orders
UNION ALL SELECT 'paging_token max length 64', count(*) FILTER (length(paging_token) > 64) FROM tx_orders
UNION ALL SELECT 'hash max length 64', count(*) FILTER (length(hash) > 64) FROM tx_orders
UNION ALL SELECT 'source_account max length 56', count(*) FILTER (length(source_account) > 56) FROM tx_orders
UNION ALL SELECT 'memo_type max length 16', count(*) FILTER (length(memo_type) > 16) FROM tx_orders"""


@query("constraint_report_operations", cte("op_lineitem") + CONSTRAINTS_OP_SQL)
def q_constraint_report_operations(spark, sf):
    """Q7: allowed operation types and column length limits."""
    return Q.constraint_report(_t(spark, sf).op_lineitem, "operation")


@query("constraint_report_transactions", cte("tx_orders") + CONSTRAINTS_TX_SQL)
def q_constraint_report_transactions(spark, sf):
    """Q7: allowed memo types and column length limits."""
    return Q.constraint_report(_t(spark, sf).tx_orders, "transaction")


# ---------------------------------------------------------------------------
# Windows
# ---------------------------------------------------------------------------

@query("latest_transaction_row_per_account", cte("tx_events") + """
SELECT * FROM tx_events
QUALIFY row_number() OVER (PARTITION BY source_account ORDER BY created_at DESC, id DESC) = 1""")
def q_latest_row_per_account(spark, sf):
    """DISTINCT ON (source_account) newest transaction."""
    return W.latest_row_per_key(_t(spark, sf).tx_events, "source_account", "created_at", "id")


@query("ledger_trend", cte("ledgers_events") + """
SELECT (SELECT operation_count FROM ledgers_events ORDER BY closed_at DESC LIMIT 1)
     - (SELECT operation_count FROM ledgers_events ORDER BY closed_at ASC LIMIT 1) AS trend""")
def q_ledger_trend(spark, sf):
    """Latest − earliest operation count."""
    return W.trend(_t(spark, sf).ledgers_events, "closed_at", "operation_count")


@query("ledger_scaled_ops", cte("ledgers_events") + """
SELECT *, 100.0 * CAST(operation_count AS DOUBLE)
          / greatest(CAST((SELECT max(operation_count) FROM ledgers_events) AS DOUBLE), 1.0) AS scaled
FROM ledgers_events""")
def q_ledger_scaled_ops(spark, sf):
    """Operation count scaled to the maximum (0-100)."""
    return W.scale_to_max(_t(spark, sf).ledgers_events, "operation_count")


@query("recent_distinct_operation_types", cte("op_events") + """
SELECT source_account, type, created_at, rank FROM (
  SELECT source_account, type, max(created_at) AS created_at,
         row_number() OVER (PARTITION BY source_account ORDER BY max(created_at) DESC, type ASC) AS rank
  FROM op_events GROUP BY source_account, type)
WHERE rank <= 3""")
def q_recent_distinct(spark, sf):
    """Per account, the newest 3 distinct operation types used."""
    out = W.recent_distinct(_t(spark, sf).op_events, "source_account", "type", "created_at", 3)
    return out.withColumn("rank", F.col("rank").cast("long"))


@query("account_fee_horizons", cte("tx_events") + f"""
SELECT source_account,
       CAST(count_if(created_at >= m - INTERVAL 24 HOUR) AS BIGINT) AS count_24h,
       {amt_txt("COALESCE(sum(CASE WHEN created_at >= m - INTERVAL 24 HOUR THEN CAST(fee_charged AS DECIMAL(28,7)) END), 0)")} AS sum_24h,
       CAST(count_if(created_at >= m - INTERVAL 7 DAY) AS BIGINT) AS count_7d,
       {amt_txt("COALESCE(sum(CASE WHEN created_at >= m - INTERVAL 7 DAY THEN CAST(fee_charged AS DECIMAL(28,7)) END), 0)")} AS sum_7d,
       CAST(count_if(created_at >= m - INTERVAL 30 DAY) AS BIGINT) AS count_30d,
       {amt_txt("COALESCE(sum(CASE WHEN created_at >= m - INTERVAL 30 DAY THEN CAST(fee_charged AS DECIMAL(28,7)) END), 0)")} AS sum_30d
FROM tx_events, (SELECT max(created_at) AS m FROM tx_events) a
WHERE created_at >= m - INTERVAL 30 DAY AND created_at <= m
GROUP BY source_account""")
def q_account_fee_horizons(spark, sf):
    """Per-account counts and fee sums over 24h/7d/30d."""
    return W.multi_horizon(_t(spark, sf).tx_events, "source_account", "created_at", "fee_charged")


@query("daily_asset_quantity_change", cte("op_lineitem") + f"""
, d AS (SELECT asset_id, CAST(created_at AS DATE) AS day, sum(CAST(quantity AS DECIMAL(28,7))) AS total
        FROM op_lineitem GROUP BY 1, 2)
, p AS (SELECT *, lag(total) OVER (PARTITION BY asset_id ORDER BY day) AS prev FROM d)
SELECT asset_id, strftime(day, '%Y-%m-%d') AS day, {amt_txt("total")} AS total, {amt_txt("prev")} AS previous,
       CASE WHEN prev IS NULL THEN NULL
            WHEN prev = 0 THEN (CASE WHEN total > 0 THEN 100.0 ELSE 0.0 END)
            ELSE CAST(total - prev AS DOUBLE) / CAST(prev AS DOUBLE) * 100.0 END AS change_pct
FROM p""")
def q_daily_asset_quantity_change(spark, sf):
    """Day-over-day percentage change of each asset's traded quantity."""
    return W.percentage_change(_t(spark, sf).op_lineitem, "asset_id", "created_at", "quantity")


# ---------------------------------------------------------------------------
# Aggregations on derived tables
# ---------------------------------------------------------------------------

@query("average_close_time", cte("ledgers_events") + """
, g AS (SELECT epoch_us(closed_at) - epoch_us(lag(closed_at) OVER (ORDER BY sequence)) AS gap FROM ledgers_events)
SELECT CASE WHEN count(gap) > 0 THEN CAST(sum(gap) AS DOUBLE) / CAST(count(gap) AS DOUBLE) / 1000000.0 END
         AS average_close_seconds,
       count(gap) AS gaps
FROM g""")
def q_average_close_time(spark, sf):
    """Mean gap between successive ledgers."""
    return A.average_close_time(_t(spark, sf).ledgers_events)


@query("metrics_summary", NETWORK_METRICS_SQL.replace(
    "\nSELECT l.sequence, l.closed_at AS timestamp", "\n, nm AS (SELECT l.sequence, l.closed_at AS timestamp", 1)
    + """)
SELECT CAST(sum(transaction_count) AS BIGINT) AS total_transactions,
       CAST(sum(CAST(average_fee AS DECIMAL(18,2))) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS mean_average_fee,
       CAST(sum(CAST(success_rate AS DECIMAL(18,2))) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS mean_success_rate,
       (SELECT transaction_count FROM nm ORDER BY timestamp DESC LIMIT 1)
     - (SELECT transaction_count FROM nm ORDER BY timestamp ASC LIMIT 1) AS trend
FROM nm""")
def q_metrics_summary(spark, sf):
    """Summary of the network-metrics series (W1 output)."""
    t = _t(spark, sf)
    m = W.network_metrics(t.ledgers_events, t.tx_events, t.op_events)
    return A.metrics_summary(m)


def _lineitem_payments(t):
    """Payment operations of the lineitem family with asset and amount."""
    from ledgerlake.functions.scalar import json_decimal
    return t.op_lineitem.where(F.col("type").isin(S.PAYMENT_OPERATIONS)).select(
        "asset_id", json_decimal(F.col("details"), "amount").alias("amount"), "created_at")


ASSET_METRICS_SQL = cte("op_lineitem", "trustlines", "assets") + f"""
, pay AS (SELECT asset_id, {json_amt('details')} AS amount, created_at FROM op_lineitem
          WHERE type IN ({', '.join(repr(t) for t in S.PAYMENT_OPERATIONS)}))
, m AS (SELECT max(created_at) AS m FROM pay)
, v AS (SELECT asset_id,
          sum(CASE WHEN created_at >= m - INTERVAL 24 HOUR THEN amount END) AS v_24h,
          CAST(count_if(created_at >= m - INTERVAL 24 HOUR) AS BIGINT) AS trades_24h,
          sum(CASE WHEN created_at >= m - INTERVAL 7 DAY THEN amount END) AS v_7d,
          CAST(count_if(created_at >= m - INTERVAL 7 DAY) AS BIGINT) AS trades_7d,
          sum(CASE WHEN created_at >= m - INTERVAL 30 DAY THEN amount END) AS v_30d,
          CAST(count_if(created_at >= m - INTERVAL 30 DAY) AS BIGINT) AS trades_30d,
          sum(CASE WHEN created_at >= m - INTERVAL 2 DAY AND created_at < m - INTERVAL 1 DAY THEN amount END) AS v_prev
        FROM pay, m WHERE created_at >= m - INTERVAL 30 DAY GROUP BY asset_id)
, h AS (SELECT asset_id, count(*) AS holders FROM trustlines WHERE balance > 0 GROUP BY asset_id)
, am AS (
SELECT a.id AS asset_id, (SELECT m FROM m) AS timestamp,
       {amt_txt("COALESCE(v.v_24h, 0)")} AS volume_24h,
       {amt_txt("COALESCE(v.v_7d, 0)")} AS volume_7d,
       {amt_txt("COALESCE(v.v_30d, 0)")} AS volume_30d,
       COALESCE(v.trades_24h, 0) AS trades_24h, COALESCE(v.trades_7d, 0) AS trades_7d,
       COALESCE(v.trades_30d, 0) AS trades_30d,
       CASE WHEN COALESCE(v.v_prev, 0) = 0 THEN (CASE WHEN COALESCE(v.v_24h, 0) > 0 THEN 100.0 ELSE 0.0 END)
            ELSE CAST(COALESCE(v.v_24h, 0) - COALESCE(v.v_prev, 0) AS DOUBLE) / CAST(COALESCE(v.v_prev, 0) AS DOUBLE) * 100.0
       END AS price_change_24h,
       CAST(NULL AS VARCHAR) AS market_cap,
       COALESCE(h.holders, 0) AS holders
FROM assets a LEFT JOIN v ON v.asset_id = a.id LEFT JOIN h ON h.asset_id = a.id)
"""


def _asset_metrics(t):
    return A.build_asset_metrics(_lineitem_payments(t), t.trustlines, t.assets)


@query("asset_metrics", ASSET_METRICS_SQL + "SELECT * FROM am")
def q_asset_metrics(spark, sf):
    """Per-asset volume/trades over 24h/7d/30d, holders, 24 h change."""
    return _asset_metrics(_t(spark, sf))


@query("asset_totals", ASSET_METRICS_SQL + f"""
SELECT {amt_txt("COALESCE(sum(CAST(volume_24h AS DECIMAL(28,7))), 0)")} AS total_volume_24h,
       CAST(COALESCE(sum(trades_24h), 0) AS BIGINT) AS total_trades_24h FROM am""")
def q_asset_totals(spark, sf):
    """Totals over the asset metrics set."""
    return A.asset_totals(_asset_metrics(_t(spark, sf)))


@query("top_assets", ASSET_METRICS_SQL + """
SELECT *, row_number() OVER (ORDER BY CAST(volume_24h AS DECIMAL(28,7)) DESC NULLS LAST, asset_id ASC) AS rank
FROM am ORDER BY CAST(volume_24h AS DECIMAL(28,7)) DESC NULLS LAST, asset_id ASC LIMIT 10""")
def q_top_assets(spark, sf):
    """Top ten assets by 24 h volume over all assets."""
    return L.top_assets(_asset_metrics(_t(spark, sf)), 10).withColumn("rank", F.col("rank").cast("long"))


@query("filtered_asset_metrics", ASSET_METRICS_SQL + """
SELECT am.* FROM am JOIN assets a ON a.id = am.asset_id
WHERE lower(CASE WHEN a.asset_type = 'native' THEN 'XLM' ELSE a.asset_code END) LIKE '%p1%'
  AND COALESCE(am.holders, 0) >= 1""")
def q_filtered_asset_metrics(spark, sf):
    """asset metrics whose code contains 'p1' and that have holders."""
    t = _t(spark, sf)
    m = _asset_metrics(t).join(t.assets.select(F.col("id").alias("asset_id"), "asset_type",
                                               "asset_code"), "asset_id")
    return FL.filter_asset_metrics(m, search="p1", min_holders=1).drop("asset_type", "asset_code")


ACCOUNT_METRICS_SQL = cte("accounts", "tx_orders", "trustlines") + """
, m AS (SELECT max(created_at) AS m FROM tx_orders)
, x AS (SELECT source_account AS account_id,
          CAST(count_if(created_at >= m - INTERVAL 24 HOUR) AS BIGINT) AS c24,
          CAST(count_if(created_at >= m - INTERVAL 7 DAY) AS BIGINT) AS c7,
          CAST(count_if(created_at >= m - INTERVAL 30 DAY) AS BIGINT) AS c30,
          min(created_at) AS first_transaction, max(created_at) AS last_transaction
        FROM tx_orders, m WHERE created_at <= m GROUP BY 1)
, tl AS (SELECT account_id, count(*) AS n FROM trustlines GROUP BY 1)
, acm AS (
SELECT a.account_id, (SELECT m FROM m) AS timestamp, a.balance AS balance_native, '0' AS total_balance_usd,
       COALESCE(x.c24, 0) AS transaction_count_24h, COALESCE(x.c7, 0) AS transaction_count_7d,
       COALESCE(x.c30, 0) AS transaction_count_30d, x.first_transaction, x.last_transaction,
       COALESCE(x.c30 > 0, false) AS is_active, COALESCE(tl.n, 0) AS trustlines, CAST(1 AS BIGINT) AS signers
FROM accounts a LEFT JOIN x ON x.account_id = a.account_id LEFT JOIN tl ON tl.account_id = a.account_id)
"""


def _account_metrics(t):
    return A.build_account_metrics(t.accounts, t.tx_orders, t.trustlines)


@query("account_metrics", ACCOUNT_METRICS_SQL + "SELECT * FROM acm")
def q_account_metrics(spark, sf):
    """Per-account activity snapshot."""
    return _account_metrics(_t(spark, sf))


@query("active_accounts_filter", ACCOUNT_METRICS_SQL + """
SELECT a.* FROM accounts a JOIN acm ON acm.account_id = a.account_id
WHERE acm.is_active AND TRY_CAST(a.balance AS DECIMAL(28,7)) >= 1000""")
def q_active_accounts_filter(spark, sf):
    """accounts with balance ≥ 1000 that are active per latest metrics."""
    t = _t(spark, sf)
    return FL.filter_accounts(t.accounts, min_balance=1000, is_active=True,
                              account_metrics=_account_metrics(t))


@query("account_metrics_range", ACCOUNT_METRICS_SQL + """
SELECT * FROM acm WHERE account_id = '42' ORDER BY timestamp DESC LIMIT 100""")
def q_account_metrics_range(spark, sf):
    """One account's metric snapshots, newest 100."""
    return L.account_metrics_range(_account_metrics(_t(spark, sf)), "42")


@query("duration_summary", cte("op_log") + """
SELECT count(*) AS total_queries, CAST(count_if(duration_ms >= 100) AS BIGINT) AS slow_queries,
       CAST(COALESCE(sum(duration_ms), 0) AS VARCHAR) AS total_duration_ms,
       COALESCE(""" + ratio_sql("CAST(sum(duration_ms) * 100 AS BIGINT)", "count(*) * 100", 2) + """, 0.0) AS avg_duration_ms
FROM op_log""")
def q_duration_summary(spark, sf):
    """Duration statistics with a 100 ms slow threshold."""
    return A.duration_summary(_t(spark, sf).op_log, 100)


@query("slow_queries", cte("op_log") + """
SELECT id, logged_at, CAST(duration_ms AS VARCHAR) AS duration_ms,
       substring(trim(regexp_replace(query_text, '\\s+', ' ', 'g')), 1, 500) AS query_text
FROM op_log WHERE duration_ms >= 100 ORDER BY logged_at DESC, id DESC LIMIT 10""")
def q_slow_queries(spark, sf):
    """The ten most recent slow entries with collapsed text."""
    return A.recent_slow_queries(_t(spark, sf).op_log, 100, 10)


def _histogram_sql() -> str:
    b = S.HISTOGRAM_BUCKETS["cycle"]
    arms = [f"SELECT label, '{float(x)}' AS le, CAST(count_if(duration_s <= {float(x)}) AS BIGINT) AS bucket_count FROM op_log GROUP BY label"
            for x in b]
    arms.append("SELECT label, '+Inf', count(*) FROM op_log GROUP BY label")
    return (cte("op_log") + ", hb AS (" + " UNION ALL ".join(arms) + ")\n"
            + ", tot AS (SELECT label, CAST(sum(CAST(duration_s AS DECIMAL(28,6))) AS VARCHAR) AS sum, count(*) AS count FROM op_log GROUP BY label)\n"
            + "SELECT hb.label, hb.le, hb.bucket_count, tot.sum, tot.count FROM hb JOIN tot ON tot.label = hb.label")


@query("duration_histogram", _histogram_sql())
def q_duration_histogram(spark, sf):
    """Cumulative histogram of durations per label (cycle buckets)."""
    return A.duration_histogram(_t(spark, sf).op_log, S.HISTOGRAM_BUCKETS["cycle"], "label")


@query("event_counters", cte("op_log") + """
SELECT name, label, count(*) AS value FROM op_log GROUP BY name, label""")
def q_event_counters(spark, sf):
    """Counters by name and label."""
    return A.event_counters(_t(spark, sf).op_log)


@query("daily_counters", cte("op_log") + """
SELECT name, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, count(*) AS value
FROM op_log WHERE CAST(ts AS DATE) > CAST((SELECT max(ts) FROM op_log) AS DATE) - INTERVAL 7 DAY
GROUP BY 1, 2""")
def q_daily_counters(spark, sf):
    """Per-metric daily counts, last 7 days kept."""
    return A.daily_counters(_t(spark, sf).op_log, 7)


@query("pipeline_health", cte("op_log") + f"""
, a AS (SELECT pipeline, max(source_sequence) AS newest_source,
               max(CASE WHEN ok THEN processed_sequence END) AS last_processed,
               count(*) AS cycles, CAST(count_if(NOT ok) AS BIGINT) AS errors, max(cycle_at) AS last_cycle_at
        FROM op_log GROUP BY pipeline)
SELECT pipeline, newest_source - COALESCE(last_processed, 0) AS lag,
       COALESCE({ratio_sql("errors", "cycles", 2, pct=True)}, 0.0) AS error_rate, cycles, errors,
       CASE WHEN last_cycle_at < (SELECT max(cycle_at) FROM op_log) - INTERVAL 300 SECOND THEN 'error'
            WHEN newest_source - COALESCE(last_processed, 0) > 10
              OR COALESCE({ratio_sql("errors", "cycles", 2, pct=True)}, 0.0) > 10 THEN 'degraded'
            ELSE 'healthy' END AS status
FROM a""")
def q_pipeline_health(spark, sf):
    """Lag, error rate and status per pipeline."""
    return A.pipeline_health(_t(spark, sf).op_log, 300)


@query("network_report", NETWORK_METRICS_SQL.replace(
    "\nSELECT l.sequence, l.closed_at AS timestamp", "\n, nm AS (SELECT l.sequence, l.closed_at AS timestamp", 1)
    + ")\n" + ASSET_METRICS_SQL.replace("WITH ", ", ", 1) + """
, top AS (SELECT *, row_number() OVER (ORDER BY CAST(volume_24h AS DECIMAL(28,7)) DESC NULLS LAST, asset_id ASC) AS rank
          FROM am ORDER BY CAST(volume_24h AS DECIMAL(28,7)) DESC NULLS LAST, asset_id ASC LIMIT 5)
, last AS (SELECT * FROM nm ORDER BY timestamp DESC LIMIT 1)
SELECT (SELECT timestamp FROM last) AS metrics_timestamp,
       (SELECT transaction_count FROM last) AS metrics_transaction_count,
       (SELECT active_accounts FROM last) AS metrics_active_accounts,
       (SELECT CAST(to_json(list({'rank': rank, 'asset_id': asset_id, 'volume_24h': volume_24h} ORDER BY rank)) AS VARCHAR) FROM top) AS top_assets,
       (SELECT count(DISTINCT source_account) FROM tx_events
         WHERE created_at >= (SELECT max(created_at) FROM tx_events) - INTERVAL 24 HOUR) AS active_accounts_24h,
       (SELECT count(*) FROM ledgers_events) AS total_ledgers,
       (SELECT count(*) FROM tx_events) AS total_transactions,
       (SELECT count(*) FROM op_events) AS total_operations""")
def q_network_report(spark, sf):
    """Latest network metrics, top assets, activity and totals."""
    t = _t(spark, sf)
    m = W.network_metrics(t.ledgers_events, t.tx_events, t.op_events)
    return A.network_report(t.ledgers_events, t.tx_events, t.op_events, m, _asset_metrics(t))


@query("network_metrics_range", NETWORK_METRICS_SQL.replace(
    "\nSELECT l.sequence, l.closed_at AS timestamp", "\n, nm AS (SELECT l.sequence, l.closed_at AS timestamp", 1)
    + """)
SELECT * FROM nm WHERE timestamp >= TIMESTAMP '2024-01-10 00:00:00' AND timestamp <= TIMESTAMP '2024-01-20 00:00:00'
ORDER BY timestamp DESC, sequence DESC LIMIT 1000""")
def q_network_metrics_range(spark, sf):
    """Network metrics inside a closed time range, newest 1000."""
    t = _t(spark, sf)
    m = W.network_metrics(t.ledgers_events, t.tx_events, t.op_events)
    return L.network_metrics_range(m, "2024-01-10 00:00:00", "2024-01-20 00:00:00")


@query("chart_points", NETWORK_METRICS_SQL.replace(
    "\nSELECT l.sequence, l.closed_at AS timestamp", "\n, nm AS (SELECT l.sequence, l.closed_at AS timestamp", 1)
    + """)
SELECT timestamp, transaction_count AS transactions,
       CAST(round(CAST(transaction_count AS DECIMAL(20,0)) * CAST(success_rate AS DECIMAL(9,4)) / 100, 0) AS BIGINT) AS successful_tx,
       CAST(round(CAST(transaction_count AS DECIMAL(20,0)) * (100 - CAST(success_rate AS DECIMAL(9,4))) / 100, 0) AS BIGINT) AS failed_tx,
       CAST(CAST(total_volume AS DECIMAL(28,7)) AS VARCHAR) AS volume
FROM nm""")
def q_chart_points(spark, sf):
    """successful/failed split per network-metrics snapshot."""
    t = _t(spark, sf)
    return P.chart_points(W.network_metrics(t.ledgers_events, t.tx_events, t.op_events))


# ---------------------------------------------------------------------------
# Projections
# ---------------------------------------------------------------------------

@query("payments", cte("raw_ops_events", extra={"payments": PAYMENTS_SQL}) + "SELECT * FROM payments")
def q_payments(spark, sf):
    """Payments from raw operations with source-account defaults."""
    return P.normalize_payments(_t(spark, sf).raw_ops_events)


def _details_sql() -> str:
    def obj(*fields):
        parts = ["'{\"type\":' || to_json(type)", "CASE WHEN source_account IS NOT NULL THEN ',\"source_account\":' || to_json(source_account) ELSE '' END"]
        parts += [f"CASE WHEN \"{f}\" IS NOT NULL THEN ',\"{f}\":' || to_json(\"{f}\") ELSE '' END" for f in fields]
        return " || ".join(parts) + " || '}'"
    return f"""CASE type
  WHEN 'payment' THEN {obj('asset_type', 'asset_code', 'asset_issuer', 'from', 'to', 'amount')}
  WHEN 'create_account' THEN {obj('account', 'starting_balance', 'funder')}
  WHEN 'manage_sell_offer' THEN {obj('selling_asset', 'buying_asset', 'amount', 'price', 'offer_id')}
  WHEN 'path_payment_strict_receive' THEN {obj('from', 'to', 'amount', 'source_amount', 'source_max', 'destination_asset', 'destination_min', 'path')}
  WHEN 'change_trust' THEN {obj('asset_type', 'asset_code', 'asset_issuer', 'trustor', 'trustee', 'limit')}
  ELSE {obj()} END"""


@query("operation_details", cte("raw_ops_events") + f"""
SELECT id, type, {_details_sql()} AS details FROM raw_ops_events""")
def q_operation_details(spark, sf):
    """P5: type-dispatched details JSON per operation."""
    return P.operation_details(_t(spark, sf).raw_ops_events).select("id", "type", "details")


@query("curated_transactions", cte("raw_tx_orders") + """
SELECT id, paging_token, successful, hash, ledger AS ledger_sequence,
       CAST(rtrim(replace(created_at, 'T', ' '), 'Z') AS TIMESTAMP) AS created_at,
       source_account, source_account_sequence, fee_account,
       TRY_CAST(fee_charged AS BIGINT) AS fee_charged, TRY_CAST(max_fee AS BIGINT) AS max_fee,
       operation_count, envelope_xdr, result_xdr, result_meta_xdr, fee_meta_xdr,
       COALESCE(memo_type, 'none') AS memo_type, memo, CAST(to_json(COALESCE(signatures, [])) AS VARCHAR) AS signatures,
       CAST(NULL AS TIMESTAMP) AS valid_after, CAST(NULL AS TIMESTAMP) AS valid_before,
       false AS fee_bump_transaction, CAST(NULL AS VARCHAR) AS inner_transaction_hash,
       CAST(NULL AS VARCHAR) AS inner_transaction_signatures
FROM raw_tx_orders""")
def q_curated_transactions(spark, sf):
    """The 24-column curated transaction row (arrays as JSON text)."""
    out = P.curate_transactions(_t(spark, sf).raw_tx_orders)
    return out.withColumn("signatures", F.to_json("signatures")).withColumn(
        "inner_transaction_signatures", F.to_json("inner_transaction_signatures"))


@query("operation_position", cte("op_lineitem") + """
SELECT *, CAST(split_part(id, '-', 1) AS BIGINT) AS id_ledger_sequence,
       CAST(split_part(id, '-', 2) AS INTEGER) AS id_operation_index, true AS position_ok
FROM op_lineitem""")
def q_operation_position(spark, sf):
    """Ledger sequence and index parsed from the operation id."""
    return P.operation_position(_t(spark, sf).op_lineitem)


@query("ledger_api_view", cte("ledgers_events") + """
SELECT id, hash, sequence, successful_transaction_count AS successfulTransactionCount,
       failed_transaction_count AS failedTransactionCount, operation_count AS operationCount,
       tx_set_operation_count AS txSetOperationCount, closed_at AS closedAt
FROM ledgers_events""")
def q_ledger_api_view(spark, sf):
    """camelCase API view of ledgers."""
    return P.api_view(_t(spark, sf).ledgers_events)


@query("ledger_timeline", cte("ledgers_events") + f"""
SELECT sequence, closed_at, successful_transaction_count + failed_transaction_count AS total_tx,
       {ratio_sql("successful_transaction_count", "greatest(successful_transaction_count + failed_transaction_count, 1)", 1, pct=True)} AS success_rate
FROM ledgers_events""")
def q_ledger_timeline(spark, sf):
    """P10: per-ledger totals and success % (1 dp)."""
    return P.ledger_timeline(_t(spark, sf).ledgers_events)


@query("ledger_density", cte("ledgers_events") + """
SELECT *, least(CAST(successful_transaction_count + failed_transaction_count AS DOUBLE) * 100.0 / 50.0, 100.0) AS density
FROM ledgers_events""")
def q_ledger_density(spark, sf):
    """Fill level of each ledger, capped at 100."""
    return P.ledger_density(_t(spark, sf).ledgers_events)


def _label_case() -> str:
    arms = " ".join(f"WHEN type = '{t}' THEN '{lab}'" for t, lab in S.OPERATION_LABELS.items())
    return f"(CASE {arms} ELSE type END)"


@query("operation_categories", cte("op_lineitem") + f"""
SELECT id, type, {category_case()} AS category, {_label_case()} AS label FROM op_lineitem""")
def q_operation_categories(spark, sf):
    """Category and display label for every operation."""
    op = _t(spark, sf).op_lineitem.select("id", "type")
    return P.operation_label(P.operation_category(op)).select("id", "type", "category", "label")


@query("ledger_envelopes", cte("ledgers_events") + """
SELECT '{"type":"ledger","data":{"sequence":' || sequence || ',"closed_at":' || to_json(CAST(closed_at AS VARCHAR))
       || '},"timestamp":' || to_json(CAST(closed_at AS VARCHAR)) || '}' AS envelope
FROM ledgers_events""")
def q_ledger_envelopes(spark, sf):
    """Event envelopes for ledgers."""
    led = _t(spark, sf).ledgers_events.select(
        "sequence", F.col("closed_at").cast("string").alias("closed_at"))
    return P.event_envelope(led, "ledger", "closed_at")


# ---------------------------------------------------------------------------
# Filters
# ---------------------------------------------------------------------------

@query("payment_operations", cte("op_lineitem") + """
SELECT * FROM op_lineitem WHERE type = 'payment' AND transaction_successful""")
def q_payment_operations(spark, sf):
    """successful payment operations."""
    return FL.filter_operations(_t(spark, sf).op_lineitem, type="payment", successful=True)


@query("balance_range_accounts", cte("accounts") + """
SELECT * FROM accounts WHERE TRY_CAST(balance AS DECIMAL(28,7)) >= 1000 AND TRY_CAST(balance AS DECIMAL(28,7)) <= 5000""")
def q_balance_range_accounts(spark, sf):
    """accounts with a balance between 1000 and 5000."""
    return FL.filter_accounts(_t(spark, sf).accounts, min_balance=1000, max_balance=5000)


@query("credit4_assets", cte("assets") + """
SELECT * FROM assets WHERE asset_type = 'credit_alphanum4'""")
def q_credit4_assets(spark, sf):
    """assets of one type."""
    return FL.filter_assets(_t(spark, sf).assets, type="credit_alphanum4")


@query("busy_ledgers", cte("ledgers_events") + """
SELECT * FROM ledgers_events WHERE operation_count >= 15 AND operation_count <= 25""")
def q_busy_ledgers(spark, sf):
    """ledgers by operation-count range."""
    return FL.filter_ledgers_by_ops(_t(spark, sf).ledgers_events, 15, 25)


@query("search_ledgers", cte("ledgers_orders") + """
SELECT * FROM ledgers_orders WHERE CAST(sequence AS VARCHAR) LIKE '%105%'""")
def q_search_ledgers(spark, sf):
    """ledgers whose sequence digits contain '105'."""
    return FL.search_ledgers(_t(spark, sf).ledgers_orders, "105")


@query("lookup_transaction", cte("tx_orders") + "SELECT * FROM tx_orders WHERE hash = '12345'")
def q_lookup_transaction(spark, sf):
    """point lookup by hash."""
    return FL.lookup(_t(spark, sf).tx_orders, "hash", "12345")


@query("account_feed", cte("tx_orders") + """
SELECT * FROM tx_orders WHERE source_account = '42' ORDER BY created_at DESC, id DESC LIMIT 10""")
def q_account_feed(spark, sf):
    """an account's ten newest transactions."""
    return FL.by_account(_t(spark, sf).tx_orders, "42", 10)


@query("preset_last_24h", cte("tx_events") + """
SELECT * FROM tx_events WHERE created_at >= (SELECT max(created_at) FROM tx_events) - INTERVAL 24 HOUR""")
def q_preset_last_24h(spark, sf):
    """the 'last 24 hours' preset."""
    return FL.preset("last_24h", _t(spark, sf).tx_events)


@query("preset_high_fee", cte("tx_orders") + "SELECT * FROM tx_orders WHERE fee_charged >= 1000")
def q_preset_high_fee(spark, sf):
    """the 'fee > 1000' preset (applied as >=)."""
    return FL.preset("high_fee", _t(spark, sf).tx_orders)


@query("live_after_soft_delete", cte("tx_orders") + "SELECT * FROM tx_orders WHERE successful")
def q_live_after_soft_delete(spark, sf):
    """M8 + F13: soft-delete failed transactions, then read the live rows."""
    t = _t(spark, sf)
    failed = t.tx_orders.where(~F.col("successful")).select("hash")
    marked = M.soft_delete(t.tx_orders, "hash", failed, "2001-08-02 00:00:00")
    return FL.not_deleted(marked).drop("deleted_at", "updated_at")


# ---------------------------------------------------------------------------
# Paging and set operations
# ---------------------------------------------------------------------------

@query("transaction_page_before", cte("tx_orders") + """
SELECT * FROM (SELECT * FROM tx_orders
  WHERE created_at > TIMESTAMP '1998-06-01 00:00:00'
     OR (created_at = TIMESTAMP '1998-06-01 00:00:00' AND id > '7000')
  ORDER BY created_at ASC, id ASC LIMIT 20)""")
def q_transaction_page_before(spark, sf):
    """L3: the page before a cursor (ascending)."""
    conn = L.connection(_t(spark, sf).tx_orders, "created_at", last=20,
                        before=("1998-06-01 00:00:00", "7000"))
    return conn.edges.drop("cursor")


@query("accounts_by_balance", cte("accounts") + """
SELECT * FROM accounts ORDER BY TRY_CAST(balance AS DECIMAL(28,7)) DESC NULLS LAST, account_id DESC LIMIT 20""")
def q_accounts_by_balance(spark, sf):
    """Whitelisted sort (balance, numeric), top 20."""
    return L.sort_by(_t(spark, sf).accounts, "account", "balance", "desc").limit(20)


@query("global_search", cte("accounts", "tx_orders", "ledgers_orders") + """
SELECT * FROM (
  SELECT 'ledger' AS type, CAST(sequence AS VARCHAR) AS id, 'Ledger #' || sequence AS label,
         successful_transaction_count || ' txs · ' || operation_count || ' ops' AS sublabel
  FROM ledgers_orders WHERE CAST(sequence AS VARCHAR) LIKE '%105%'
  ORDER BY lpad(CAST(sequence AS VARCHAR), 20, '0') DESC, CAST(sequence AS VARCHAR) DESC LIMIT 5)""")
def q_global_search(spark, sf):
    """Classified search ('105' is a ledger number), 5 per type."""
    t = _t(spark, sf)
    return U.global_search(t.accounts, t.tx_orders, t.ledgers_orders, "105")


@query("search_counts", cte("accounts", "tx_orders", "ledgers_orders") + """
SELECT 'ledger' AS type, count(*) AS matches FROM ledgers_orders WHERE CAST(sequence AS VARCHAR) LIKE '%105%'""")
def q_search_counts(spark, sf):
    """Uncapped search, matches per type."""
    t = _t(spark, sf)
    _, counts = U.search_page(t.accounts, t.tx_orders, t.ledgers_orders, "105")
    return counts


@query("archive_union", cte("tx_orders") + "SELECT * FROM tx_orders")
def q_archive_union(spark, sf):
    """M6 + U3: split by a 3-year retention, then live ∪ archive = all."""
    tx = _t(spark, sf).tx_orders
    kept, expired = M.retention_split(tx, "created_at", 3 * 365)
    return U.archive_union(kept, expired, "hash").select(*tx.columns)


@query("expired_transactions", cte("tx_orders") + """
SELECT * FROM tx_orders WHERE created_at < (SELECT max(created_at) FROM tx_orders) - INTERVAL 180 DAY""")
def q_expired_transactions(spark, sf):
    """M6: rows past the 180-day transaction retention."""
    _, expired = M.retention_split(_t(spark, sf).tx_orders, "created_at", S.RETENTION_DAYS["transactions"])
    return expired


@query("live_merge", cte("tx_events") + """
, page AS (SELECT * FROM tx_events ORDER BY created_at DESC, id DESC LIMIT 40 OFFSET 10)
, fresh AS (SELECT * FROM tx_events ORDER BY created_at DESC, id DESC LIMIT 20)
, merged AS (SELECT *, 0 AS g FROM fresh WHERE id NOT IN (SELECT id FROM page)
             UNION ALL SELECT *, 1 AS g FROM page)
SELECT * EXCLUDE (g), row_number() OVER (ORDER BY g, created_at DESC, id DESC) AS live_rank FROM merged""")
def q_live_merge(spark, sf):
    """U4: merge a poll of new rows in front of the current page."""
    tx = _t(spark, sf).tx_events
    ordered = tx.orderBy(F.col("created_at").desc(), F.col("id").desc())
    page = ordered.limit(50).exceptAll(ordered.limit(10))
    fresh = ordered.limit(20)
    return U.merge_live(page, fresh, "id", "created_at").withColumn(
        "live_rank", F.col("live_rank").cast("long"))


# ---------------------------------------------------------------------------
# Maintenance
# ---------------------------------------------------------------------------

def _bounds(led):
    r = led.agg(F.min("sequence").alias("lo"), F.max("sequence").alias("hi")).first()
    return int(r["lo"]), int(r["hi"])


STATUS_SQL = cte("raw_ledgers_orders", "processed_orders") + f"""
, b AS (SELECT min(sequence) AS lo, max(sequence) AS hi FROM raw_ledgers_orders)
, plan AS (SELECT s AS sequence, CAST(floor((s - (SELECT lo FROM b)) / 1000) AS BIGINT) AS batch
           FROM range((SELECT lo FROM b), (SELECT hi FROM b) + 1) r(s))
, chk AS (SELECT sequence, {errors_sql('ledger', 'raw_ledgers_orders')} AS errs FROM raw_ledgers_orders)
, status AS (
  SELECT p.sequence, p.batch,
         CASE WHEN EXISTS (SELECT 1 FROM processed_orders d WHERE d.sequence = p.sequence) THEN 'skipped'
              WHEN c.sequence IS NOT NULL AND c.errs = '' THEN 'processed' ELSE 'failed' END AS status,
         CASE WHEN EXISTS (SELECT 1 FROM processed_orders d WHERE d.sequence = p.sequence) THEN NULL
              WHEN c.sequence IS NULL THEN 'ledger not found'
              WHEN c.errs <> '' THEN c.errs END AS error
  FROM plan p LEFT JOIN chk c ON c.sequence = p.sequence)
"""


def _status(t):
    lo, hi = _bounds(t.raw_ledgers_orders)
    return M.run_backfill(t.raw_ledgers_orders, t.processed_orders, lo, hi, 1000)


@query("backfill_plan", cte("ledgers_orders") + """
, b AS (SELECT min(sequence) AS lo, max(sequence) AS hi FROM ledgers_orders)
SELECT s AS sequence, CAST(floor((s - (SELECT lo FROM b)) / 1000) AS BIGINT) AS batch
FROM range((SELECT lo FROM b), (SELECT hi FROM b) + 1) r(s)""")
def q_backfill_plan(spark, sf):
    """M1: every sequence between the lowest and highest ledger, batched."""
    led = _t(spark, sf).ledgers_orders
    lo, hi = _bounds(led)
    return M.plan_backfill(spark, lo, hi, 1000)


@query("backfill_status", STATUS_SQL + "SELECT * FROM status")
def q_backfill_status(spark, sf):
    """M2: processed / skipped / failed per planned sequence."""
    return _status(_t(spark, sf))


@query("backfill_progress", STATUS_SQL + f"""
SELECT count(*) AS total, CAST(count_if(status = 'processed') AS BIGINT) AS processed,
       CAST(count_if(status = 'skipped') AS BIGINT) AS skipped, CAST(count_if(status = 'failed') AS BIGINT) AS failed,
       CAST(COALESCE({ratio_sql("count_if(status IN ('processed', 'skipped', 'failed'))", "count(*)", 0, pct=True)}, 0.0) AS BIGINT) AS percent,
       CAST(NULL AS DOUBLE) AS eta_seconds, true AS done
FROM status""")
def q_backfill_progress(spark, sf):
    """M4: totals and percent done of the backfill status."""
    out = M.backfill_progress(_status(_t(spark, sf)))
    return out.withColumn("eta_seconds", F.col("eta_seconds").cast("double"))  # nullable → double


@query("backfill_result", STATUS_SQL + """
SELECT CAST(count_if(status = 'processed') AS BIGINT) AS processed, CAST(count_if(status = 'skipped') AS BIGINT) AS skipped,
       CAST(count_if(status = 'failed') AS BIGINT) AS failed, min(CASE WHEN status = 'failed' THEN sequence END) AS resume_from
FROM status""")
def q_backfill_result(spark, sf):
    """M5: counts and the lowest failed sequence to resume from."""
    return M.backfill_result(_status(_t(spark, sf)))


@query("sequence_gaps", cte("ledgers_orders") + """
, b AS (SELECT min(sequence) AS lo, max(sequence) AS hi FROM ledgers_orders)
SELECT s AS sequence FROM range((SELECT lo FROM b), (SELECT hi FROM b) + 1) r(s)
WHERE s NOT IN (SELECT sequence FROM ledgers_orders)""")
def q_sequence_gaps(spark, sf):
    """M5: missing sequences between the lowest and highest ledger."""
    led = _t(spark, sf).ledgers_orders
    lo, hi = _bounds(led)
    return M.sequence_gaps(led, lo, hi)


@query("last_processed", cte("processed_orders", "ledgers_orders") + """
SELECT COALESCE((SELECT max(sequence) FROM processed_orders), (SELECT max(sequence) FROM ledgers_orders)) AS last_processed""")
def q_last_processed(spark, sf):
    """M3: where a live ingest resumes."""
    t = _t(spark, sf)
    return M.last_processed(t.processed_orders, t.ledgers_orders)


@query("retention_report", cte("ledgers_orders", "tx_orders", "op_lineitem") + """
SELECT * FROM (VALUES ('ledgers', 365), ('transactions', 180), ('operations', 180)) p(table_name, retention_days)
JOIN (SELECT 'ledgers' AS table_name, count(*) AS row_count, min(closed_at) AS oldest FROM ledgers_orders
      UNION ALL SELECT 'transactions', count(*), min(created_at) FROM tx_orders
      UNION ALL SELECT 'operations', count(*), min(created_at) FROM op_lineitem) s USING (table_name)""")
def q_retention_report(spark, sf):
    """Policy days with row count and oldest row per table."""
    t = _t(spark, sf)
    out = M.retention_report({"ledgers": (t.ledgers_orders, "closed_at"),
                              "transactions": (t.tx_orders, "created_at"),
                              "operations": (t.op_lineitem, "created_at")})
    return out.withColumn("retention_days", F.col("retention_days").cast("int"))

"""Operators at a past ``as_of``: rows after it must count in no horizon.

The SQL bounds every horizon on both sides by hand.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerlake.operators import aggregates as A
from ledgerlake.operators import filters as FL
from ledgerlake.operators import joins as J
from ledgerlake.operators import rollups as R
from ledgerlake.operators import windows as W
from ledgerlake.plans.catalog import (NETWORK_METRICS_SQL, PAYMENTS_SQL, _t, amt_txt, cte, json_amt, payments, query,
                                      ratio_sql)
from ledgerlake.plans.queries_more import _asset_metrics, _lineitem_payments

PAST = "2024-01-10 06:30:00"
PAST_ORDERS = "1996-06-15 00:00:00"
T, TO = f"TIMESTAMP '{PAST}'", f"TIMESTAMP '{PAST_ORDERS}'"


def _in(hours: int, ts: str = "created_at", t: str = T, op: str = ">=") -> str:
    return f"{ts} {op} {t} - INTERVAL {hours} HOUR AND {ts} <= {t}"


HOURS = {"24h": 24, "7d": 168, "30d": 720}


@query("active_accounts_past", cte("tx_events") + "SELECT " + ", ".join(
    f"count(DISTINCT CASE WHEN {_in(h)} THEN source_account END) AS active_accounts_{n}" for n, h in HOURS.items())
    + " FROM tx_events")
def q_active_accounts_past(spark, sf):
    """A2 at a past time."""
    return A.active_accounts(_t(spark, sf).tx_events, PAST)


@query("payment_volume_past", cte("op_events") + "SELECT " + ", ".join(
    amt_txt(f"COALESCE(SUM(CASE WHEN {_in(h)} THEN {json_amt('details')} END), 0)") + f" AS volume_{n}"
    for n, h in HOURS.items()) + " FROM op_events WHERE type = 'payment'")
def q_payment_volume_past(spark, sf):
    """A3 at a past time."""
    return A.payment_volume(_t(spark, sf).op_events, PAST)


@query("average_fee_past", cte("tx_events") + f"""
SELECT CAST(sum(fee_charged) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS average_fee_24h FROM tx_events WHERE {_in(24)}""")
def q_average_fee_past(spark, sf):
    """A4 at a past time."""
    return A.average_fee(_t(spark, sf).tx_events, PAST)


@query("success_rate_past", cte("tx_events") + f"""
SELECT CAST(count_if(successful) * 100 AS DOUBLE) / CAST(count(*) AS DOUBLE) AS success_rate_24h
FROM tx_events WHERE {_in(24)}""")
def q_success_rate_past(spark, sf):
    """A5 at a past time."""
    return A.success_rate(_t(spark, sf).tx_events, PAST)


@query("stats_summary_past", cte("ledgers_events", "tx_events", "op_events", "accounts", "assets") + """
SELECT (SELECT count(*) FROM ledgers_events) AS total_ledgers,
       (SELECT count(*) FROM tx_events) AS total_transactions,
       (SELECT count(*) FROM op_events) AS total_operations,
       (SELECT count(*) FROM accounts) AS total_accounts,
       (SELECT count(*) FROM assets) AS total_assets,
       (SELECT max(sequence) FROM ledgers_events) AS latest_ledger,
       (SELECT arg_max(closed_at, sequence) FROM ledgers_events) AS latest_ledger_time, """ + ", ".join(
    f"(SELECT count(DISTINCT source_account) FROM tx_events WHERE {_in(h)}) AS active_accounts_{n}"
    for n, h in HOURS.items()) + ", " + ", ".join(
    f"(SELECT " + amt_txt(f"COALESCE(SUM({json_amt('details')}), 0)") + f" FROM op_events WHERE type = 'payment' AND {_in(h)}) AS volume_{n}"
    for n, h in HOURS.items()) + f""",
       (SELECT CAST(sum(fee_charged) AS DOUBLE) / CAST(count(*) AS DOUBLE) FROM tx_events WHERE {_in(24)}) AS average_fee_24h,
       (SELECT CAST(count_if(successful) * 100 AS DOUBLE) / CAST(count(*) AS DOUBLE) FROM tx_events WHERE {_in(24)}) AS success_rate_24h""")
def q_stats_summary_past(spark, sf):
    """A6 at a past time."""
    t = _t(spark, sf)
    return A.stats_summary(t.ledgers_events, t.tx_events, t.op_events, t.accounts, t.assets, PAST)


@query("network_overview_past", cte("tx_events", "ledgers_events") + f"""
SELECT CAST(count_if(created_at > {T} - INTERVAL 60 SECOND AND created_at <= {T}) AS DOUBLE) / 60.0 AS tps,
       count(DISTINCT source_account) AS total_accounts,
       count(DISTINCT CASE WHEN {_in(24, op=">")} THEN source_account END) AS active_accounts_24h,
       (SELECT count(*) FROM ledgers_events) AS total_ledgers
FROM tx_events""")
def q_network_overview_past(spark, sf):
    """A8 at a past time."""
    t = _t(spark, sf)
    return A.network_overview(t.tx_events, t.ledgers_events, PAST)


@query("asset_volume_past", cte("raw_ops_events", extra={"payments": PAYMENTS_SQL}) + f"""
SELECT asset AS asset_code, {amt_txt("COALESCE(sum(TRY_CAST(amount AS DECIMAL(28,7))), 0)")} AS volume, '7d' AS timeframe
FROM payments WHERE {_in(168, op=">")} GROUP BY asset""")
def q_asset_volume_past(spark, sf):
    """A9 at a past time."""
    return A.asset_volume(payments(_t(spark, sf)), timeframe="7d", as_of=PAST)


@query("daily_transaction_count_past", cte("tx_events") + f"""
SELECT strftime(CAST(created_at AS DATE), '%Y-%m-%d') AS date, count(*) AS count
FROM tx_events WHERE {_in(168, op=">")} GROUP BY 1""")
def q_daily_transaction_count_past(spark, sf):
    """A11 at a past time."""
    return A.daily_transaction_count(_t(spark, sf).tx_events, days=7, as_of=PAST)


@query("asset_metrics_past", cte("op_lineitem", "trustlines", "assets") + f"""
, pay AS (SELECT asset_id, {json_amt('details')} AS amount, created_at FROM op_lineitem
          WHERE type IN ('payment', 'path_payment_strict_receive', 'path_payment_strict_send')
            AND created_at <= {TO})
, v AS (SELECT asset_id, """ + ", ".join(
    f"sum(CASE WHEN {_in(h, t=TO)} THEN amount END) AS v_{n}, CAST(count_if({_in(h, t=TO)}) AS BIGINT) AS n_{n}"
    for n, h in HOURS.items()) + f""",
   sum(CASE WHEN created_at >= {TO} - INTERVAL 48 HOUR AND created_at < {TO} - INTERVAL 24 HOUR THEN amount END) AS v_prev
   FROM pay GROUP BY asset_id)
, h AS (SELECT asset_id, count(*) AS holders FROM trustlines WHERE balance > 0 GROUP BY asset_id)
SELECT a.id AS asset_id, {TO} AS timestamp, """ + ", ".join(
    amt_txt(f"COALESCE(v_{n}, 0)") + f" AS volume_{n}, COALESCE(n_{n}, 0) AS trades_{n}" for n in HOURS) + """,
  CASE WHEN COALESCE(v_prev, 0) = 0 THEN (CASE WHEN COALESCE(v_24h, 0) > 0 THEN 100.0 ELSE 0.0 END)
       ELSE CAST(COALESCE(v_24h, 0) - v_prev AS DOUBLE) / CAST(v_prev AS DOUBLE) * 100.0 END AS price_change_24h,
  CAST(NULL AS VARCHAR) AS market_cap, COALESCE(h.holders, 0) AS holders
FROM assets a LEFT JOIN v ON v.asset_id = a.id LEFT JOIN h ON h.asset_id = a.id""")
def q_asset_metrics_past(spark, sf):
    """A18 at a past time."""
    t = _t(spark, sf)
    return A.build_asset_metrics(_lineitem_payments(t), t.trustlines, t.assets, PAST_ORDERS)


@query("daily_counters_past", cte("op_log") + f"""
SELECT name, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, count(*) AS value
FROM op_log WHERE ts >= TIMESTAMP '2024-01-04 00:00:00' AND ts <= {T} GROUP BY 1, 2""")
def q_daily_counters_past(spark, sf):
    """A23 at a past time."""
    return A.daily_counters(_t(spark, sf).op_log, 7, PAST)


@query("pipeline_health_past", cte("op_log") + f"""
, a AS (SELECT pipeline, max(source_sequence) AS newest, COALESCE(max(CASE WHEN ok THEN processed_sequence END), 0) AS done,
               count(*) AS cycles, CAST(count_if(NOT ok) AS BIGINT) AS errors, max(cycle_at) AS last_at
        FROM op_log WHERE cycle_at <= {T} GROUP BY pipeline)
SELECT pipeline, newest - done AS lag, {ratio_sql("errors", "cycles", 2, pct=True)} AS error_rate, cycles, errors,
       CASE WHEN last_at < {T} - INTERVAL 300 SECOND THEN 'error'
            WHEN newest - done > 10 OR {ratio_sql("errors", "cycles", 2, pct=True)} > 10 THEN 'degraded'
            ELSE 'healthy' END AS status
FROM a""")
def q_pipeline_health_past(spark, sf):
    """A24 at a past time."""
    return A.pipeline_health(_t(spark, sf).op_log, 300, PAST)


@query("network_report_past", NETWORK_METRICS_SQL.replace(
    "\nSELECT l.sequence, l.closed_at AS timestamp", "\n, nm AS (SELECT l.sequence, l.closed_at AS timestamp", 1) + f""")
, last AS (SELECT * FROM nm WHERE timestamp <= {T} ORDER BY timestamp DESC LIMIT 1)
SELECT (SELECT timestamp FROM last) AS metrics_timestamp,
       (SELECT transaction_count FROM last) AS metrics_transaction_count,
       (SELECT active_accounts FROM last) AS metrics_active_accounts,
       (SELECT count(DISTINCT source_account) FROM tx_events WHERE {_in(24)}) AS active_accounts_24h,
       (SELECT count(*) FROM ledgers_events) AS total_ledgers,
       (SELECT count(*) FROM tx_events) AS total_transactions,
       (SELECT count(*) FROM op_events) AS total_operations""")
def q_network_report_past(spark, sf):
    """A26 at a past time (the top assets are checked by ``network_report``)."""
    t = _t(spark, sf)
    m = W.network_metrics(t.ledgers_events, t.tx_events, t.op_events)
    return A.network_report(t.ledgers_events, t.tx_events, t.op_events, m, _asset_metrics(t), PAST).drop("top_assets")


@query("preset_last_7d_past", cte("tx_events") + f"SELECT * FROM tx_events WHERE {_in(168)}")
def q_preset_last_7d_past(spark, sf):
    """F12 ``last_7d`` at a past time."""
    return FL.preset("last_7d", _t(spark, sf).tx_events, PAST)


# J4 with far more keys than a request list ----------------------------------
@query("aligned_lookup_many", cte("tx_orders", "op_lineitem") + """
, k AS (SELECT CAST(transaction_hash AS BIGINT) * 100 + operation_index AS pos, transaction_hash AS hash FROM op_lineitem)
SELECT k.pos, k.hash, t.id, t.source_account FROM k LEFT JOIN tx_orders t ON t.hash = k.hash""")
def q_aligned_lookup_many(spark, sf):
    """J4 with a frame of keys: the transaction of every operation."""
    t = _t(spark, sf)
    keys = t.op_lineitem.select((F.col("transaction_hash").cast("long") * 100 + F.col("operation_index")).alias("pos"),
                                F.col("transaction_hash").alias("hash"))
    return J.aligned_lookup(keys, t.tx_orders, "hash").select("pos", "hash", "id", "source_account")


def _rolled(spark, sf):
    """Roll-ups of all transactions, written as three batches."""
    from ledgerlake.session import ensure_checkpoint_dir
    root = f"{ensure_checkpoint_dir(spark)}/rolled-{uuid.uuid4().hex}"
    tx = _t(spark, sf).tx_events
    for batch in range(3):
        R.roll_up(spark, root, tx.where(F.pmod(F.xxhash64("id"), F.lit(3)) == batch), batch)
    return root, tx


ROLLED_AT = (PAST, "2024-01-20 00:00:00")


@query("active_accounts_rolled", cte("tx_events") + " UNION ALL ".join(
    f"SELECT '{at}' AS as_of, " + ", ".join(
        f"count(DISTINCT CASE WHEN {_in(h, t=f"TIMESTAMP '{at}'")} THEN source_account END) AS active_accounts_{n}"
        for n, h in HOURS.items()) + " FROM tx_events" for at in ROLLED_AT))
def q_active_accounts_rolled(spark, sf):
    """A2 from bitmaps of hours and days at two past times."""
    root, tx = _rolled(spark, sf)
    one, two = (R.active_accounts(spark, root, tx, at).select(F.lit(at).alias("as_of"), "*") for at in ROLLED_AT)
    return one.unionByName(two)


@query("network_overview_rolled", cte("tx_events", "ledgers_events") + f"""
SELECT CAST(count_if(created_at > {T} - INTERVAL 60 SECOND AND created_at <= {T}) AS DOUBLE) / 60.0 AS tps,
       count(DISTINCT source_account) AS total_accounts,
       count(DISTINCT CASE WHEN {_in(24, op=">")} THEN source_account END) AS active_accounts_24h,
       (SELECT count(*) FROM ledgers_events) AS total_ledgers
FROM tx_events""")
def q_network_overview_rolled(spark, sf):
    """A8 from roll-ups at a past time."""
    root, tx = _rolled(spark, sf)
    return R.network_overview(spark, root, tx, _t(spark, sf).ledgers_events, PAST)


@query("account_activity_rolled", cte("tx_events") + "SELECT source_account AS account_id, " + ", ".join(
    f"CAST(count_if({_in(h)}) AS BIGINT) AS transaction_count_{n}" for n, h in HOURS.items()) + f""",
       min(created_at) AS first_transaction, max(created_at) AS last_transaction
FROM tx_events WHERE source_account IS NOT NULL AND created_at <= {T} GROUP BY 1""")
def q_account_activity_rolled(spark, sf):
    """A19's activity from roll-ups at a past time."""
    root, tx = _rolled(spark, sf)
    return R.account_activity(spark, root, tx, PAST)

"""Third batch of registered queries: lookups and cascades, profile views,
streaming operators in their batch form, curation projections, range scans
and the scalar column transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake import schemas as S
from ledgerlake.functions import scalar as E
from ledgerlake.operators import aggregates as _A
from ledgerlake.operators import joins as J
from ledgerlake.operators import paging as _L
from ledgerlake.operators import project as P
from ledgerlake.operators import search as _U
from ledgerlake.plans.catalog import NETWORK_METRICS_SQL, PAYMENTS_SQL, _t, amt_txt, cte, query
from ledgerlake.sources import sinks as _SNK
from ledgerlake.plans.queries_more import (ACCOUNT_METRICS_SQL, ASSET_METRICS_SQL, _account_metrics,
                                           _asset_metrics, _bounds)
from ledgerlake.sources import raw as SRC
from ledgerlake.streaming import jobs as T

LOOKUP_KEYS = ["5", "999999999", "5", "17", "100"]


@query("aligned_lookup", cte("tx_orders") + """
SELECT CAST(k.pos AS BIGINT) AS pos, k.hash,
       t.* EXCLUDE (hash, ledger_sequence, fee_charged, successful),
       CAST(t.ledger_sequence AS DOUBLE) AS ledger_sequence, CAST(t.fee_charged AS DOUBLE) AS fee_charged,
       CAST(t.successful AS VARCHAR) AS successful
FROM (VALUES (0, '5'), (1, '999999999'), (2, '5'), (3, '17'), (4, '100')) k(pos, hash)
LEFT JOIN tx_orders t ON t.hash = k.hash""")
def q_aligned_lookup(spark, sf):
    """One row per requested hash, in request order, nulls when absent."""
    out = J.aligned_lookup(LOOKUP_KEYS, _t(spark, sf).tx_orders, "hash")
    # absent keys give nulls: nullable integers are emitted as doubles and
    # the nullable flag as text, so both engines' pandas conversions agree
    return out.withColumns({"pos": F.col("pos").cast("long"),
                            "ledger_sequence": F.col("ledger_sequence").cast("double"),
                            "fee_charged": F.col("fee_charged").cast("double"),
                            "successful": F.col("successful").cast("string")})


@query("cascade_removed_operations", cte("ledgers_orders", "tx_orders", "op_lineitem") + """
SELECT o.* FROM op_lineitem o
WHERE o.transaction_hash IN (
  SELECT t.hash FROM tx_orders t WHERE t.ledger_sequence IN (
    SELECT sequence FROM ledgers_orders WHERE closed_at < TIMESTAMP '1996-01-01 00:00:00'))""")
def q_cascade_removed_operations(spark, sf):
    """Operations removed when the 1995 ledgers are deleted."""
    t = _t(spark, sf)
    gone = t.ledgers_orders.where(F.col("closed_at") < F.lit("1996-01-01 00:00:00").cast("timestamp_ntz"))
    _, removed = J.cascade_delete(t.ledgers_orders, t.tx_orders, t.op_lineitem, gone.select("sequence"))
    return removed["operations"]


@query("cascade_kept_transactions", cte("ledgers_orders", "tx_orders") + """
SELECT t.* FROM tx_orders t WHERE t.ledger_sequence NOT IN (
    SELECT sequence FROM ledgers_orders WHERE closed_at < TIMESTAMP '1996-01-01 00:00:00')""")
def q_cascade_kept_transactions(spark, sf):
    """Transactions that survive the deletion of the 1995 ledgers."""
    t = _t(spark, sf)
    gone = t.ledgers_orders.where(F.col("closed_at") < F.lit("1996-01-01 00:00:00").cast("timestamp_ntz"))
    kept, _ = J.cascade_delete(t.ledgers_orders, t.tx_orders, t.op_lineitem, gone.select("sequence"))
    return kept["transactions"]


@query("asset_metrics_view", ASSET_METRICS_SQL + """
SELECT a.id AS asset_id, a.asset_type, a.asset_code, a.asset_issuer, am.timestamp, am.volume_24h,
       am.trades_24h, COALESCE(am.price_change_24h, 0.0) AS price_change_24h, am.holders
FROM assets a LEFT JOIN am ON am.asset_id = a.id
WHERE a.asset_type = 'credit_alphanum12'
ORDER BY a.id LIMIT 20""")
def q_asset_metrics_view(spark, sf):
    """Filtered assets with their latest metrics, first 20 by id."""
    t = _t(spark, sf)
    v = J.asset_metrics_view(t.assets, _asset_metrics(t), type="credit_alphanum12", first=20)
    return v.select("asset_id", "asset.asset_type", "asset.asset_code", "asset.asset_issuer",
                    "timestamp", "volume_24h", "trades_24h", "price_change_24h", "holders")


@query("account_profile", ACCOUNT_METRICS_SQL + """
, r AS (SELECT id, created_at FROM tx_orders WHERE source_account = '42'
        ORDER BY created_at DESC, id DESC LIMIT 20)
SELECT a.account_id, a.balance, acm.transaction_count_30d AS metrics_transaction_count_30d,
       acm.is_active AS metrics_is_active,
       (SELECT count(*) FROM r) AS n_recent,
       (SELECT string_agg(id, ',' ORDER BY created_at DESC, id DESC) FROM r) AS recent_ids
FROM accounts a LEFT JOIN acm ON acm.account_id = a.account_id
WHERE a.account_id = '42'""")
def q_account_profile(spark, sf):
    """Account, latest metrics and its 20 newest transactions."""
    t = _t(spark, sf)
    p = J.account_profile(t.accounts, _account_metrics(t), t.tx_orders, "42")
    return p.select("account_id", "balance", "metrics_transaction_count_30d", "metrics_is_active",
                    F.size("recent_transactions").cast("long").alias("n_recent"),
                    F.array_join(F.col("recent_transactions.id"), ",")
                    .alias("recent_ids"))


# ---------------------------------------------------------------------------
# Streaming operators, batch form (same DataFrame functions)
# ---------------------------------------------------------------------------

@query("live_totals", cte("ledgers_events") + """
SELECT max(sequence) AS latest_ledger, arg_max(closed_at, sequence) AS latest_closed_at,
       max(sequence) AS total_ledgers, CAST(sum(successful_transaction_count) AS BIGINT) AS total_transactions,
       CAST(sum(operation_count) AS BIGINT) AS total_operations
FROM ledgers_events""")
def q_live_totals(spark, sf):
    """Running dashboard totals (the streaming aggregation on a table)."""
    return T.live_totals(_t(spark, sf).ledgers_events)


@query("channel_fanout", cte("op_events") + """
SELECT id, 'OPERATION_ADDED' AS channel FROM op_events
UNION ALL SELECT id, 'OPERATION_ADDED.account.' || source_account FROM op_events
UNION ALL SELECT id, 'OPERATION_ADDED.type.' || type FROM op_events""")
def q_channel_fanout(spark, sf):
    """T5: every operation routed to its global, account and type channels."""
    return T.route_channels(_t(spark, sf).op_events, "operation").select("id", "channel")


@query("subscription_feed", cte("op_events") + """
SELECT * FROM op_events WHERE source_account = '7' AND type = 'payment'""")
def q_subscription_feed(spark, sf):
    """One account's payment operations."""
    return T.subscribe(_t(spark, sf).op_events, account="7", type="payment")


@query("ledger_batch_summary", cte("tx_events") + """
SELECT 'testnet' AS network, ledger_sequence AS ledger, count(*) AS txCount, max(created_at) AS at
FROM tx_events GROUP BY ledger_sequence""")
def q_ledger_batch_summary(spark, sf):
    """One broadcast summary row per ledger."""
    return T.batch_summary(_t(spark, sf).tx_events, "testnet")


@query("incremental_poll", cte("ledgers_events") + """
SELECT * FROM ledgers_events WHERE sequence > (SELECT max(sequence) - 15 FROM ledgers_events)
ORDER BY sequence LIMIT 10""")
def q_incremental_poll(spark, sf):
    """T4: next 10 ledgers above a high-water mark 15 below the newest."""
    led = _t(spark, sf).ledgers_events
    hwm = led.select(F.max("sequence") - 15).scalar()
    return T.incremental_poll(led, hwm, S.LIVE_POLL_LEDGERS)


@query("late_ledgers_dropped", cte("ledgers_events", "processed_orders") + """
SELECT * FROM ledgers_events WHERE sequence > (SELECT max(sequence) - 48 FROM ledgers_events)""")
def q_late_ledgers_dropped(spark, sf):
    """A batch keeps only ledgers above the last processed sequence."""
    led = _t(spark, sf).ledgers_events
    return T.drop_late(led, led.select(F.max("sequence") - 48).scalar())


DLQ_SQL = cte("failure_log", "success_log") + """
, dlq AS (SELECT f.sequence, count(*) AS attempt_count, min(f.failed_at) AS first_failed_at,
               max(f.failed_at) AS last_failed_at, arg_max(f.error, f.failed_at) AS last_error
        FROM failure_log f
        WHERE NOT EXISTS (SELECT 1 FROM success_log s WHERE s.sequence = f.sequence AND s.succeeded_at >= f.failed_at)
        GROUP BY f.sequence)
"""


def _dlq(t):
    return T.dead_letters(t.failure_log, t.success_log)


@query("dead_letters", DLQ_SQL + "SELECT * FROM dlq")
def q_dead_letters(spark, sf):
    """Dead-letter entries still failing after their last success."""
    return _dlq(_t(spark, sf))


@query("ready_for_retry", DLQ_SQL + """
SELECT * FROM dlq WHERE attempt_count < 5
  AND epoch_us((SELECT max(failed_at) FROM failure_log))
      >= epoch_us(last_failed_at) + least(1000 * pow(2, attempt_count), 300000) * 1000""")
def q_ready_for_retry(spark, sf):
    """Entries whose backoff has elapsed at the newest failure time."""
    t = _t(spark, sf)
    now = t.failure_log.select(F.max("failed_at")).scalar()
    return T.ready_for_retry(_dlq(t), now)


@query("network_metrics_latest_batch", NETWORK_METRICS_SQL.replace(
    "\nSELECT l.sequence, l.closed_at AS timestamp", "\n, nm AS (SELECT l.sequence, l.closed_at AS timestamp", 1)
    + """)
SELECT * FROM nm WHERE timestamp >= (SELECT max(closed_at) FROM ledgers_events) - INTERVAL 1 DAY""")
def q_network_metrics_latest_batch(spark, sf):
    """W1 recomputed for the last day's ledgers only, as one micro-batch."""
    t = _t(spark, sf)
    led = t.ledgers_events
    batch = led.where(F.col("closed_at") >= led.select(F.max("closed_at")).scalar()
                      - F.expr("INTERVAL 1 DAY"))
    return T.network_metrics_for_batch(batch, t.tx_events, t.op_events)


# ---------------------------------------------------------------------------
# Curation projections and range scans
# ---------------------------------------------------------------------------

@query("normalized_ledgers", cte("raw_ledgers_orders") + """
SELECT sequence, hash, CAST(rtrim(replace(closed_at, 'T', ' '), 'Z') AS TIMESTAMP) AS close_time,
       successful_transaction_count AS tx_count FROM raw_ledgers_orders""")
def q_normalized_ledgers(spark, sf):
    """Narrow ledger rows."""
    return P.normalize_ledgers(_t(spark, sf).raw_ledgers_orders)


@query("normalized_transactions", cte("raw_tx_orders") + """
SELECT hash, ledger AS ledger_seq, source_account, fee_charged FROM raw_tx_orders""")
def q_normalized_transactions(spark, sf):
    """Narrow transaction rows."""
    return P.normalize_transactions(_t(spark, sf).raw_tx_orders)


@query("normalized_operations", cte("raw_ops_events") + """
SELECT id, transaction_hash AS tx_hash, type, source_account,
       CAST(rtrim(replace(created_at, 'T', ' '), 'Z') AS TIMESTAMP) AS created_at FROM raw_ops_events""")
def q_normalized_operations(spark, sf):
    """Narrow operation rows."""
    return P.normalize_operations(_t(spark, sf).raw_ops_events)


@query("sequence_range", cte("ledgers_orders") + """
SELECT * FROM ledgers_orders
WHERE sequence BETWEEN (SELECT min(sequence) + 100 FROM ledgers_orders) AND (SELECT min(sequence) + 200 FROM ledgers_orders)""")
def q_sequence_range(spark, sf):
    """Inclusive ledger range scan."""
    led = _t(spark, sf).ledgers_orders
    lo, _ = _bounds(led)
    return SRC.read_sequence_range(led, lo + 100, lo + 200)


# ---------------------------------------------------------------------------
# Scalar column transforms
# ---------------------------------------------------------------------------

@query("asset_keys", cte("raw_ops_events") + f"""
SELECT id, CASE WHEN asset_type = 'native' THEN 'XLM' ELSE asset_code || ':' || asset_issuer END AS asset_key,
       CASE WHEN asset_type = 'native' THEN 'native'
            WHEN length(asset_code) <= 4 THEN 'credit_alphanum4' ELSE 'credit_alphanum12' END AS parsed_type,
       CASE WHEN asset_type = 'native' THEN NULL ELSE asset_code END AS parsed_code
FROM raw_ops_events WHERE type IN ({', '.join(repr(x) for x in S.PAYMENT_OPERATIONS)})""")
def q_asset_keys(spark, sf):
    """Asset key text and its parse back into type and code."""
    ops = _t(spark, sf).raw_ops_events.where(F.col("type").isin(S.PAYMENT_OPERATIONS))
    key = E.asset_key(F.col("asset_type"), F.col("asset_code"), F.col("asset_issuer"))
    parsed = E.parse_asset_key(key)
    return ops.select("id", key.alias("asset_key"), parsed["asset_type"].alias("parsed_type"),
                      parsed["asset_code"].alias("parsed_code"))


@query("base_units", cte("raw_ops_events") + """
SELECT id, CAST(floor(TRY_CAST(amount AS DECIMAL(38,7)) * 10000000) AS BIGINT) AS stroops,
       CAST(CAST(CAST(floor(TRY_CAST(amount AS DECIMAL(38,7)) * 10000000) AS DECIMAL(38,0)) / 10000000 AS DECIMAL(38,7)) AS VARCHAR) AS units
FROM raw_ops_events WHERE amount IS NOT NULL""")
def q_base_units(spark, sf):
    """Amounts to base units and back, exact decimals."""
    ops = _t(spark, sf).raw_ops_events.where(F.col("amount").isNotNull())
    st = E.units_to_stroops(F.col("amount"))
    from ledgerlake.operators.common import amount_text
    return ops.select("id", st.alias("stroops"), amount_text(E.stroops_to_units(st)).alias("units"))


@query("truncated_accounts", cte("raw_tx_orders") + """
SELECT id, CASE WHEN length(source_account) <= 10 THEN source_account
                ELSE left(source_account, 6) || '...' || right(source_account, 4) END AS short_account
FROM raw_tx_orders""")
def q_truncated_accounts(spark, sf):
    """E5: first 6 + '...' + last 4 of each address."""
    tx = _t(spark, sf).raw_tx_orders
    return tx.select("id", E.truncate_id(F.col("source_account")).alias("short_account"))


@query("account_active_spans", cte("tx_events") + """
, s AS (SELECT source_account, (epoch_us(max(created_at)) - epoch_us(min(created_at))) // 1000000 AS secs
        FROM tx_events GROUP BY 1)
SELECT source_account,
       CASE WHEN secs // 86400 > 0 THEN (secs // 86400) || 'd ' || ((secs // 3600) % 24) || 'h'
            WHEN secs // 3600 > 0 THEN (secs // 3600) || 'h ' || ((secs // 60) % 60) || 'm'
            WHEN secs // 60 > 0 THEN (secs // 60) || 'm ' || (secs % 60) || 's'
            ELSE secs || 's' END AS active_span
FROM s""")
def q_account_active_spans(spark, sf):
    """Duration text between each account's first and last transaction."""
    per = _t(spark, sf).tx_events.groupBy("source_account").agg(
        F.min("created_at").alias("first"), F.max("created_at").alias("last"))
    return per.select("source_account", E.duration_text(F.col("first"), F.col("last")).alias("active_span"))


@query("identifier_kinds", cte("raw_tx_orders") + f"""
SELECT id, text, CASE WHEN regexp_matches(trim(text), '{S.ADDRESS_PATTERN}') THEN 'account'
                      WHEN regexp_matches(trim(text), '{S.HASH_PATTERN}') THEN 'transaction'
                      WHEN regexp_matches(trim(text), '^\\d+$') THEN 'ledger'
                      WHEN length(trim(text)) >= 2 THEN 'partial' END AS kind
FROM (SELECT id, hash AS text FROM raw_tx_orders
      UNION ALL SELECT id, source_account FROM raw_tx_orders
      UNION ALL SELECT id, CAST(ledger AS VARCHAR) FROM raw_tx_orders
      UNION ALL SELECT id, memo_type FROM raw_tx_orders)""")
def q_identifier_kinds(spark, sf):
    """Classify search texts (hashes, addresses, numbers, free text)."""
    tx = _t(spark, sf).raw_tx_orders
    texts = (tx.select("id", F.col("hash").alias("text"))
             .unionByName(tx.select("id", F.col("source_account").alias("text")))
             .unionByName(tx.select("id", F.col("ledger").cast("string").alias("text")))
             .unionByName(tx.select("id", F.col("memo_type").alias("text"))))
    return texts.select("id", "text", E.identifier_kind(F.col("text")).alias("kind"))


@query("ledger_cursors", cte("ledgers_events") + """
SELECT sequence, to_base64(encode(CAST(sequence AS VARCHAR))) AS cursor,
       TRY_CAST(decode(from_base64(to_base64(encode(CAST(sequence AS VARCHAR))))) AS BIGINT) AS decoded
FROM ledgers_events""")
def q_ledger_cursors(spark, sf):
    """base64 cursors of ledger sequences and their decoding."""
    led = _t(spark, sf).ledgers_events
    cur = E.encode_cursor(F.col("sequence"))
    return led.select("sequence", cur.alias("cursor"), E.decode_cursor(cur).alias("decoded"))


@query("retry_backoff", DLQ_SQL + """
SELECT sequence, attempt_count, CAST(least(1000 * pow(2, attempt_count), 300000) AS BIGINT) AS backoff_ms FROM dlq""")
def q_retry_backoff(spark, sf):
    """Retry delay per dead-letter entry, capped at 300 s."""
    d = _dlq(_t(spark, sf))
    return d.select("sequence", "attempt_count", E.backoff_ms(F.col("attempt_count")).alias("backoff_ms"))



# ---------------------------------------------------------------------------
# More forms of A9, U2, L6 and E12
# ---------------------------------------------------------------------------



@query("asset_volume_xlm", cte("raw_ops_events", extra={"payments": PAYMENTS_SQL}) + f"""
SELECT 'XLM' AS asset_code,
       {amt_txt("COALESCE(sum(TRY_CAST(amount AS DECIMAL(28,7))), 0)")} AS volume, '30d' AS timeframe
FROM payments, (SELECT max(created_at) AS m FROM payments) a
WHERE created_at > m - INTERVAL 30 DAY AND asset = 'XLM'""")
def q_asset_volume_xlm(spark, sf):
    """A9 (one-asset form): native payment volume over the last 30 days."""
    pay = P.normalize_payments(_t(spark, sf).raw_ops_events)
    return _A.asset_volume(pay, asset_code="XLM", timeframe="30d")


@query("search_page_transactions", cte("raw_tx_orders") + """
, tx AS (SELECT id, hash, successful, memo_type FROM raw_tx_orders)
SELECT 'transaction' AS type, hash AS id,
       CASE WHEN length(hash) <= 21 THEN hash ELSE left(hash, 10) || '...' || right(hash, 8) END AS label,
       CASE WHEN successful THEN 'Successful' ELSE 'Failed' END AS sublabel
FROM tx WHERE lower(hash) LIKE '%ab%' AND successful AND COALESCE(memo_type, 'none') <> 'none'""")
def q_search_page_transactions(spark, sf):
    """U2 with F2 filters: general text 'ab' over accounts, transactions and
    ledgers, only successful transactions with a memo, uncapped."""
    t = _t(spark, sf)
    tx = t.raw_tx_orders.select("id", "hash", "successful", "memo_type", "source_account",
                                P.parse_time("created_at").alias("created_at"))
    rows, _ = _U.search_page(t.accounts, tx, t.ledgers_orders, "ab", successful=True, has_memo=True)
    return rows


@query("time_range_counts", cte("tx_events") + "\n, m AS (SELECT max(created_at) AS m FROM tx_events)\n"
       + "\nUNION ALL\n".join(
           f"SELECT '{lb}' AS range_label, CAST({secs} AS BIGINT) AS range_seconds, "
           f"(SELECT count(*) FROM tx_events, m WHERE created_at >= m.m - INTERVAL {secs} SECOND "
           f"AND created_at <= m.m) AS count"
           for lb, secs in S.TIME_RANGES.items()))
def q_time_range_counts(spark, sf):
    """Transactions inside each labelled trailing range (1h … 365d)."""
    return _A.counts_by_range(_t(spark, sf).tx_events, "created_at")


@query("transactions_by_fee", cte("tx_orders") + """
SELECT * FROM tx_orders ORDER BY fee_charged DESC NULLS LAST, id DESC LIMIT 20""")
def q_transactions_by_fee(spark, sf):
    """Transactions sorted by fee (whole set), top 20."""
    return _L.sort_by(_t(spark, sf).tx_orders, "transaction", "feeCharged", "desc").limit(20)


@query("ledgers_by_operations", cte("ledgers_events") + """
SELECT * FROM ledgers_events ORDER BY operation_count ASC NULLS FIRST, sequence ASC LIMIT 20""")
def q_ledgers_by_operations(spark, sf):
    """Ledgers sorted by operation count ascending, first 20."""
    return _L.sort_by(_t(spark, sf).ledgers_events, "ledger", "operationCount", "asc").limit(20)


@query("account_profiles", ACCOUNT_METRICS_SQL + """
, r AS (SELECT source_account, id, created_at,
               row_number() OVER (PARTITION BY source_account ORDER BY created_at DESC, id DESC) AS rn
        FROM tx_orders)
, agg AS (SELECT source_account, count(*) AS n_recent,
                 string_agg(id, ',' ORDER BY created_at DESC, id DESC) AS recent_ids
          FROM r WHERE rn <= 20 GROUP BY source_account)
SELECT a.account_id, a.balance, acm.transaction_count_30d AS metrics_transaction_count_30d,
       acm.is_active AS metrics_is_active, COALESCE(agg.n_recent, 0) AS n_recent,
       COALESCE(agg.recent_ids, '') AS recent_ids
FROM accounts a LEFT JOIN acm ON acm.account_id = a.account_id
LEFT JOIN agg ON agg.source_account = a.account_id""")
def q_account_profiles(spark, sf):
    """J11 for every account in one job: latest metrics and 20 newest
    transactions each (per-account top-n pre-limited per map task)."""
    t = _t(spark, sf)
    p = J.account_profile(t.accounts, _account_metrics(t), t.tx_orders)
    return p.select("account_id", "balance", "metrics_transaction_count_30d", "metrics_is_active",
                    F.size("recent_transactions").cast("long").alias("n_recent"),
                    F.array_join(F.col("recent_transactions.id"), ",").alias("recent_ids"))


# ---------------------------------------------------------------------------
# Pure-DataFrame forms of the write-path operators
# ---------------------------------------------------------------------------



@query("progress_marks", cte("ledgers_orders", "processed_orders") + """
SELECT sequence, successful_transaction_count + failed_transaction_count AS tx_count,
       operation_count AS op_count
FROM ledgers_orders l WHERE NOT EXISTS (SELECT 1 FROM processed_orders p WHERE p.sequence = l.sequence)""")
def q_progress_marks(spark, sf):
    """Progress rows for ledgers not yet in the progress log."""
    t = _t(spark, sf)
    return T.idempotent_marks(t.ledgers_orders, t.processed_orders).drop("processed_at")


@query("insert_ignore_ledgers", cte("ledgers_orders") + """
SELECT * FROM ledgers_orders
WHERE sequence NOT IN (SELECT sequence FROM ledgers_orders WHERE closed_at < TIMESTAMP '1997-01-01 00:00:00')""")
def q_insert_ignore_ledgers(spark, sf):
    """Rows of a full ledger batch that a table holding the ledgers
    before 1997 would append (one per key, none already stored)."""
    led = _t(spark, sf).ledgers_orders
    stored = led.where(F.col("closed_at") < F.lit("1997-01-01 00:00:00").cast("timestamp_ntz"))
    return _SNK.insert_ignore(stored, led, "sequence")


@query("upsert_transactions", cte("tx_orders") + """
SELECT * FROM tx_orders""")
def q_upsert_transactions(spark, sf):
    """Transactions before 1999 upserted with the batch of transactions
    from 1998 on (overlapping 1998 keys update ``successful``; new keys are
    inserted): the result is the whole table."""
    tx = _t(spark, sf).tx_orders
    cut = F.lit("1999-01-01 00:00:00").cast("timestamp_ntz")
    target = tx.where(F.col("created_at") < cut)
    batch = tx.where(F.col("created_at") >= F.lit("1998-01-01 00:00:00").cast("timestamp_ntz"))
    return _SNK.merge_upsert(target, batch, "hash", ["successful"])


@query("asset_metrics_history", cte("op_lineitem") + f"""
, pay AS (SELECT asset_id, TRY_CAST(json_extract_string(details, '$.amount') AS DECIMAL(28,7)) AS amount, epoch_us(created_at) // 86400000000 AS day_num
          FROM op_lineitem WHERE type IN ({', '.join(repr(t) for t in S.PAYMENT_OPERATIONS)}))
, d AS (SELECT asset_id, day_num, count(*) AS n, sum(amount) AS v FROM pay GROUP BY 1, 2)
SELECT asset_id, CAST(DATE '1970-01-01' + CAST(day_num AS INTEGER) AS VARCHAR) AS day,
       CAST(sum(n) OVER (PARTITION BY asset_id ORDER BY day_num RANGE BETWEEN 0 PRECEDING AND CURRENT ROW) AS BIGINT) AS trades_1d,
       {amt_txt("sum(v) OVER (PARTITION BY asset_id ORDER BY day_num RANGE BETWEEN 0 PRECEDING AND CURRENT ROW)")} AS volume_1d,
       CAST(sum(n) OVER (PARTITION BY asset_id ORDER BY day_num RANGE BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS trades_7d,
       {amt_txt("sum(v) OVER (PARTITION BY asset_id ORDER BY day_num RANGE BETWEEN 6 PRECEDING AND CURRENT ROW)")} AS volume_7d,
       CAST(sum(n) OVER (PARTITION BY asset_id ORDER BY day_num RANGE BETWEEN 29 PRECEDING AND CURRENT ROW) AS BIGINT) AS trades_30d,
       {amt_txt("sum(v) OVER (PARTITION BY asset_id ORDER BY day_num RANGE BETWEEN 29 PRECEDING AND CURRENT ROW)")} AS volume_30d
FROM d""")
def q_asset_metrics_history(spark, sf):
    """A18 over time: per asset and active day, trades and volume over the
    trailing 1/7/30 days (daily snapshot history)."""
    from ledgerlake.operators import windows as _W
    from ledgerlake.plans.queries_more import _lineitem_payments
    return _W.rolling_daily(_lineitem_payments(_t(spark, sf)), "asset_id", "created_at", "amount")


@query("account_activity_history", cte("tx_orders") + f"""
, d AS (SELECT source_account, epoch_us(created_at) // 86400000000 AS day_num, count(*) AS n,
               sum(CAST(fee_charged AS DECIMAL(28,7))) AS v
        FROM tx_orders GROUP BY 1, 2)
SELECT source_account, CAST(DATE '1970-01-01' + CAST(day_num AS INTEGER) AS VARCHAR) AS day,
       CAST(sum(n) OVER (PARTITION BY source_account ORDER BY day_num RANGE BETWEEN 0 PRECEDING AND CURRENT ROW) AS BIGINT) AS trades_1d,
       {amt_txt("sum(v) OVER (PARTITION BY source_account ORDER BY day_num RANGE BETWEEN 0 PRECEDING AND CURRENT ROW)")} AS volume_1d,
       CAST(sum(n) OVER (PARTITION BY source_account ORDER BY day_num RANGE BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS trades_7d,
       {amt_txt("sum(v) OVER (PARTITION BY source_account ORDER BY day_num RANGE BETWEEN 6 PRECEDING AND CURRENT ROW)")} AS volume_7d,
       CAST(sum(n) OVER (PARTITION BY source_account ORDER BY day_num RANGE BETWEEN 29 PRECEDING AND CURRENT ROW) AS BIGINT) AS trades_30d,
       {amt_txt("sum(v) OVER (PARTITION BY source_account ORDER BY day_num RANGE BETWEEN 29 PRECEDING AND CURRENT ROW)")} AS volume_30d
FROM d""")
def q_account_activity_history(spark, sf):
    """A19 over time: per account and active day, transactions and fees
    over the trailing 1/7/30 days (daily snapshot history)."""
    from ledgerlake.operators import windows as _W
    return _W.rolling_daily(_t(spark, sf).tx_orders, "source_account", "created_at", "fee_charged")

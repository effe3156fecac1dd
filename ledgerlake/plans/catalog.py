"""Registered queries and their DuckDB oracles.

Each entry runs library operators over the stand-in ledger views of a
scale-factor folder (whole tables, no sampling) and is paired with an
independent SQL formulation of the same semantics for DuckDB. Column names
and types are aligned on both sides: amounts are decimal text, rates are
exact HALF_UP roundings as doubles, counts are longs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake import schemas as S
from ledgerlake.operators import aggregates as A
from ledgerlake.operators.common import amount_text
from ledgerlake.operators import filters as FL
from ledgerlake.operators import joins as J
from ledgerlake.operators import paging as L
from ledgerlake.operators import project as P
from ledgerlake.operators import windows as W
from ledgerlake.plans.testviews import TestTables, duck_cte

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------------------
# SQL helpers for the oracle side
# ---------------------------------------------------------------------------

def amt_txt(expr: str) -> str:
    return f"CAST(CAST({expr} AS DECIMAL(38,7)) AS VARCHAR)"


def json_amt(doc: str) -> str:
    return f"TRY_CAST(json_extract_string({doc}, '$.amount') AS DECIMAL(28,7))"


def ratio_sql(num: str, den: str, scale: int = 2, pct: bool = False) -> str:
    mult = 10 ** scale * (100 if pct else 1)
    return (f"(CASE WHEN ({den}) > 0 THEN CAST((({num}) * {2 * mult} + ({den})) // (2 * ({den})) "
            f"AS DOUBLE) / {10 ** scale} END)")


def category_case(col: str = "type") -> str:
    arms = " ".join(
        f"WHEN {col} IN ({', '.join(repr(t) for t in types)}) THEN '{cat}'"
        for cat, types in S.OPERATION_CATEGORIES)
    return f"(CASE {arms} ELSE 'other' END)"


PAYMENTS_SQL = f"""
SELECT id,
       COALESCE(NULLIF("from", ''), source_account) AS "from",
       COALESCE(NULLIF("to", ''), source_account) AS "to",
       COALESCE(NULLIF(amount, ''), '0') AS amount,
       CASE WHEN asset_type = 'native' THEN 'XLM' ELSE asset_code END AS asset,
       CAST(rtrim(replace(created_at, 'T', ' '), 'Z') AS TIMESTAMP) AS created_at
FROM raw_ops_events
WHERE type IN ({', '.join(repr(t) for t in S.PAYMENT_OPERATIONS)})"""


def cte(*views: str, extra: dict[str, str] | None = None) -> str:
    text = duck_cte(*views)
    for name, body in (extra or {}).items():
        text = text.rstrip("\n") + f",\n{name} AS ({body})\n"
    return text


def _t(spark: SparkSession, sf: str) -> TestTables:
    return TestTables(spark, sf)


def payments(t: TestTables) -> DataFrame:
    return P.normalize_payments(t.raw_ops_events)


# ---------------------------------------------------------------------------
# A: aggregations
# ---------------------------------------------------------------------------

@query("daily_transaction_count", cte("tx_events") + """
SELECT strftime(CAST(created_at AS DATE), '%Y-%m-%d') AS date, count(*) AS count
FROM tx_events
WHERE created_at > (SELECT max(created_at) FROM tx_events) - INTERVAL 7 DAY
GROUP BY 1""")
def q_daily_transaction_count(spark, sf):
    """Transactions per day over the last 7 days of the event stream."""
    return A.daily_transaction_count(_t(spark, sf).tx_events, days=7)


@query("daily_transaction_count_orders", cte("tx_orders") + """
SELECT strftime(CAST(created_at AS DATE), '%Y-%m-%d') AS date, count(*) AS count
FROM tx_orders
WHERE created_at > (SELECT max(created_at) FROM tx_orders) - INTERVAL 365 DAY
GROUP BY 1""")
def q_daily_transaction_count_orders(spark, sf):
    """A11 over a year of day-grain transactions."""
    return A.daily_transaction_count(_t(spark, sf).tx_orders, days=365)


@query("active_accounts", cte("tx_events") + """
SELECT count(DISTINCT CASE WHEN created_at >= m - INTERVAL 24 HOUR THEN source_account END) AS active_accounts_24h,
       count(DISTINCT CASE WHEN created_at >= m - INTERVAL 7 DAY THEN source_account END) AS active_accounts_7d,
       count(DISTINCT CASE WHEN created_at >= m - INTERVAL 30 DAY THEN source_account END) AS active_accounts_30d
FROM tx_events, (SELECT max(created_at) AS m FROM tx_events) a""")
def q_active_accounts(spark, sf):
    """A2: distinct sources over 24h/7d/30d from one per-account pass."""
    return A.active_accounts(_t(spark, sf).tx_events)


@query("payment_volume", cte("op_events") + f"""
SELECT {amt_txt(f"COALESCE(SUM(CASE WHEN created_at >= m - INTERVAL 24 HOUR THEN {json_amt('details')} END), 0)")} AS volume_24h,
       {amt_txt(f"COALESCE(SUM(CASE WHEN created_at >= m - INTERVAL 7 DAY THEN {json_amt('details')} END), 0)")} AS volume_7d,
       {amt_txt(f"COALESCE(SUM(CASE WHEN created_at >= m - INTERVAL 30 DAY THEN {json_amt('details')} END), 0)")} AS volume_30d
FROM op_events, (SELECT max(created_at) AS m FROM op_events) a
WHERE type = 'payment'""")
def q_payment_volume(spark, sf):
    """A3: Σ amount of `payment` operations over three horizons."""
    return A.payment_volume(_t(spark, sf).op_events)


@query("average_fee", cte("tx_events") + """
SELECT CASE WHEN count(*) > 0 THEN CAST(sum(fee_charged) AS DOUBLE) / CAST(count(*) AS DOUBLE)
            ELSE 0.0 END AS average_fee_24h
FROM tx_events, (SELECT max(created_at) AS m FROM tx_events) a
WHERE created_at >= m - INTERVAL 24 HOUR""")
def q_average_fee(spark, sf):
    """A4: mean fee of the last 24 h."""
    return A.average_fee(_t(spark, sf).tx_events)


@query("success_rate", cte("tx_events") + """
SELECT CASE WHEN count(*) > 0 THEN CAST(count_if(successful) * 100 AS DOUBLE) / CAST(count(*) AS DOUBLE)
            ELSE 0.0 END AS success_rate_24h
FROM tx_events, (SELECT max(created_at) AS m FROM tx_events) a
WHERE created_at >= m - INTERVAL 24 HOUR""")
def q_success_rate(spark, sf):
    """A5: success percentage of the last 24 h."""
    return A.success_rate(_t(spark, sf).tx_events)


@query("stats_summary", cte("ledgers_events", "tx_events", "op_events", "accounts", "assets") + f"""
, m AS (SELECT max(created_at) AS m FROM tx_events)
, l AS (SELECT sequence, closed_at FROM ledgers_events ORDER BY sequence DESC LIMIT 1)
SELECT (SELECT count(*) FROM ledgers_events) AS total_ledgers,
       (SELECT count(*) FROM tx_events) AS total_transactions,
       (SELECT count(*) FROM op_events) AS total_operations,
       (SELECT count(*) FROM accounts) AS total_accounts,
       (SELECT count(*) FROM assets) AS total_assets,
       (SELECT sequence FROM l) AS latest_ledger,
       (SELECT closed_at FROM l) AS latest_ledger_time,
       (SELECT count(DISTINCT source_account) FROM tx_events, m WHERE created_at >= m.m - INTERVAL 24 HOUR) AS active_accounts_24h,
       (SELECT count(DISTINCT source_account) FROM tx_events, m WHERE created_at >= m.m - INTERVAL 7 DAY) AS active_accounts_7d,
       (SELECT count(DISTINCT source_account) FROM tx_events, m WHERE created_at >= m.m - INTERVAL 30 DAY) AS active_accounts_30d,
       (SELECT {amt_txt(f"COALESCE(SUM({json_amt('details')}), 0)")} FROM op_events, m WHERE type = 'payment' AND created_at >= m.m - INTERVAL 24 HOUR) AS volume_24h,
       (SELECT {amt_txt(f"COALESCE(SUM({json_amt('details')}), 0)")} FROM op_events, m WHERE type = 'payment' AND created_at >= m.m - INTERVAL 7 DAY) AS volume_7d,
       (SELECT {amt_txt(f"COALESCE(SUM({json_amt('details')}), 0)")} FROM op_events, m WHERE type = 'payment' AND created_at >= m.m - INTERVAL 30 DAY) AS volume_30d,
       (SELECT CASE WHEN count(*) > 0 THEN CAST(sum(fee_charged) AS DOUBLE) / CAST(count(*) AS DOUBLE) ELSE 0.0 END
          FROM tx_events, m WHERE created_at >= m.m - INTERVAL 24 HOUR) AS average_fee_24h,
       (SELECT CASE WHEN count(*) > 0 THEN CAST(count_if(successful) * 100 AS DOUBLE) / CAST(count(*) AS DOUBLE) ELSE 0.0 END
          FROM tx_events, m WHERE created_at >= m.m - INTERVAL 24 HOUR) AS success_rate_24h""")
def q_stats_summary(spark, sf):
    """The dashboard summary row (A1-A5 + L8), one pass per table."""
    t = _t(spark, sf)
    return A.stats_summary(t.ledgers_events, t.tx_events, t.op_events, t.accounts, t.assets)


@query("table_totals", cte("ledgers_events", "tx_events", "op_events", "accounts", "assets") + """
SELECT (SELECT count(*) FROM ledgers_events) AS total_ledgers,
       (SELECT count(*) FROM tx_events) AS total_transactions,
       (SELECT count(*) FROM op_events) AS total_operations,
       (SELECT count(*) FROM accounts) AS total_accounts,
       (SELECT count(*) FROM assets) AS total_assets""")
def q_table_totals(spark, sf):
    """A1: row counts of the five tables."""
    t = _t(spark, sf)
    return A.table_totals(ledgers=t.ledgers_events, transactions=t.tx_events,
                          operations=t.op_events, accounts=t.accounts, assets=t.assets)


@query("account_stats", cte("tx_events", "raw_ops_events", extra={"payments": PAYMENTS_SQL}) + f"""
, t AS (SELECT source_account AS address, count(*) AS transaction_count, max(created_at) AS last_active
        FROM tx_events GROUP BY 1)
, p AS (SELECT "from" AS address, sum(TRY_CAST(amount AS DECIMAL(28,7))) AS vol FROM payments GROUP BY 1)
SELECT COALESCE(t.address, p.address) AS address,
       COALESCE(t.transaction_count, 0) AS transaction_count,
       {amt_txt("COALESCE(p.vol, 0)")} AS total_payment_volume,
       t.last_active
FROM t FULL OUTER JOIN p ON t.address = p.address""")
def q_account_stats(spark, sf):
    """Per-account transaction count, outgoing payment volume, last activity."""
    t = _t(spark, sf)
    return A.account_stats(t.tx_events, payments(t))


@query("network_overview", cte("tx_events", "ledgers_events") + """
SELECT CAST(count_if(created_at > m - INTERVAL 60 SECOND) AS DOUBLE) / 60.0 AS tps,
       count(DISTINCT source_account) AS total_accounts,
       count(DISTINCT CASE WHEN created_at > m - INTERVAL 24 HOUR THEN source_account END) AS active_accounts_24h,
       (SELECT count(*) FROM ledgers_events) AS total_ledgers
FROM tx_events, (SELECT max(created_at) AS m FROM tx_events) a""")
def q_network_overview(spark, sf):
    """Tps, distinct accounts, active accounts, ledger count."""
    t = _t(spark, sf)
    return A.network_overview(t.tx_events, t.ledgers_events)


@query("asset_volume", cte("raw_ops_events", extra={"payments": PAYMENTS_SQL}) + f"""
SELECT asset AS asset_code, {amt_txt("COALESCE(sum(TRY_CAST(amount AS DECIMAL(28,7))), 0)")} AS volume,
       '7d' AS timeframe
FROM payments, (SELECT max(created_at) AS m FROM payments) a
WHERE created_at > m - INTERVAL 7 DAY
GROUP BY asset""")
def q_asset_volume(spark, sf):
    """Payment volume per asset over the last 7 days (strict bound)."""
    return A.asset_volume(payments(_t(spark, sf)), timeframe="7d")


@query("top_accounts", cte("tx_orders") + """
SELECT source_account AS address, count(*) AS activity
FROM tx_orders GROUP BY 1 ORDER BY activity DESC, address ASC LIMIT 10""")
def q_top_accounts(spark, sf):
    """A10: ten most active accounts, ties by address."""
    return A.top_accounts(_t(spark, sf).tx_orders, 10)


@query("operation_distribution", cte("op_lineitem") + f"""
SELECT type, {category_case()} AS category, count(*) AS count,
       {ratio_sql("count(*)", "(SELECT count(*) FROM op_lineitem)", 2, pct=True)} AS share_pct
FROM op_lineitem GROUP BY type""")
def q_operation_distribution(spark, sf):
    """Count, category and share per operation type."""
    return A.operation_distribution(_t(spark, sf).op_lineitem)


@query("duplicate_operation_ids", cte("op_lineitem") + """
SELECT id, count(*) AS occurrences FROM op_lineitem GROUP BY id HAVING count(*) > 1""")
def q_duplicate_operation_ids(spark, sf):
    """Operation ids that occur more than once."""
    return A.duplicate_keys(_t(spark, sf).op_lineitem, "id")


# ---------------------------------------------------------------------------
# W: window semantics
# ---------------------------------------------------------------------------

NETWORK_METRICS_SQL = cte("ledgers_events", "tx_events", "op_events") + f"""
, tw AS (
  SELECT l.sequence, count(t.id) AS n, count_if(t.successful) AS ok,
         COALESCE(sum(t.fee_charged), 0) AS fee, count(DISTINCT t.source_account) AS acc
  FROM ledgers_events l LEFT JOIN tx_events t
    ON t.created_at >= l.closed_at - INTERVAL 1 HOUR AND t.created_at <= l.closed_at
  GROUP BY l.sequence)
, ow AS (
  SELECT l.sequence, count(o.id) AS ops,
         sum(CASE WHEN o.type = 'payment' THEN {json_amt('o.details')} END) AS vol
  FROM ledgers_events l LEFT JOIN op_events o
    ON o.created_at >= l.closed_at - INTERVAL 1 HOUR AND o.created_at <= l.closed_at
  GROUP BY l.sequence)
SELECT l.sequence, l.closed_at AS timestamp, CAST(1 AS BIGINT) AS ledger_count,
       tw.n AS transaction_count, ow.ops AS operation_count, tw.acc AS active_accounts,
       {amt_txt("COALESCE(ow.vol, 0)")} AS total_volume,
       COALESCE({ratio_sql("tw.fee", "tw.n", 2)}, 0.0) AS average_fee,
       COALESCE({ratio_sql("tw.ok", "tw.n", 2, pct=True)}, 0.0) AS success_rate
FROM ledgers_events l JOIN tw ON tw.sequence = l.sequence JOIN ow ON ow.sequence = l.sequence"""


@query("network_metrics", NETWORK_METRICS_SQL)
def q_network_metrics(spark, sf):
    """Exact trailing-hour network metrics at every ledger close."""
    t = _t(spark, sf)
    return W.network_metrics(t.ledgers_events, t.tx_events, t.op_events)


@query("ledger_close_times", cte("ledgers_events") + """
SELECT sequence, closed_at, lag(closed_at) OVER (ORDER BY sequence) AS prev_closed_at,
       CAST(epoch_us(closed_at) - epoch_us(lag(closed_at) OVER (ORDER BY sequence)) AS DOUBLE) AS gap_micros,
       CAST(epoch_us(closed_at) - epoch_us(lag(closed_at) OVER (ORDER BY sequence)) AS DOUBLE) / 1000000.0 AS gap_seconds
FROM ledgers_events""")
def q_ledger_close_times(spark, sf):
    """Gap to the previous ledger (bucketed lag with carry-over).
    Nullable integer columns of registered outputs are emitted as doubles
    (exact below 2^53) so both engines' pandas conversions agree."""
    out = W.ledger_close_times(_t(spark, sf).ledgers_events)
    return out.withColumn("gap_micros", F.col("gap_micros").cast("double"))


# ---------------------------------------------------------------------------
# J: joins
# ---------------------------------------------------------------------------

@query("latest_transaction_per_account", cte("accounts", "tx_events") + """
SELECT a.*, t.created_at AS latest_created_at, t.id AS latest_id, CAST(t.fee_charged AS DOUBLE) AS latest_fee_charged
FROM accounts a LEFT JOIN LATERAL (
  SELECT created_at, id, fee_charged FROM tx_events x WHERE x.source_account = a.account_id
  ORDER BY created_at DESC LIMIT 1) t ON true""")
def q_latest_transaction_per_account(spark, sf):
    """Every account with its newest transaction (nulls when none)."""
    t = _t(spark, sf)
    hist = t.tx_events.select("source_account", "created_at", "id", "fee_charged")
    out = J.latest_per_entity(t.accounts, hist, "source_account", "created_at",
                              entity_key="account_id", prefix="latest_")
    return out.withColumn("latest_fee_charged", F.col("latest_fee_charged").cast("double"))


@query("transactions_with_operations", cte("tx_orders", "op_lineitem") + """
SELECT t.hash, t.created_at, count(o.id) AS n_operations,
       COALESCE(string_agg(o.id, ',' ORDER BY o.operation_index, o.id, o.type), '') AS operation_ids
FROM tx_orders t LEFT JOIN op_lineitem o ON o.transaction_hash = t.hash
GROUP BY t.hash, t.created_at""")
def q_transactions_with_operations(spark, sf):
    """Operations nested under each transaction, in index order."""
    t = _t(spark, sf)
    nested = J.with_operations(t.tx_orders, t.op_lineitem, fields=("operation_index", "id", "type"))
    return nested.select("hash", "created_at",
                         F.size("operations").cast("long").alias("n_operations"),
                         F.array_join(F.col("operations.id"), ",")
                         .alias("operation_ids"))


@query("ledgers_with_transactions", cte("ledgers_orders", "tx_orders") + """
SELECT l.sequence, l.closed_at, count(t.id) AS n_transactions,
       COALESCE(string_agg(t.id, ',' ORDER BY t.created_at, t.id), '') AS transaction_ids
FROM ledgers_orders l LEFT JOIN tx_orders t ON t.ledger_sequence = l.sequence
GROUP BY l.sequence, l.closed_at""")
def q_ledgers_with_transactions(spark, sf):
    """Transactions nested under each ledger."""
    t = _t(spark, sf)
    nested = J.with_transactions(t.ledgers_orders, t.tx_orders, fields=("created_at", "id"))
    return nested.select("sequence", "closed_at",
                         F.size("transactions").cast("long").alias("n_transactions"),
                         F.array_join(F.col("transactions.id"), ",")
                         .alias("transaction_ids"))


@query("operations_for_ledgers", cte("op_lineitem", "tx_orders") + """
SELECT o.*, t.ledger_sequence AS tx_ledger_sequence
FROM op_lineitem o JOIN tx_orders t ON o.transaction_hash = t.hash""")
def q_operations_for_ledgers(spark, sf):
    """Operations joined to their transactions' ledgers (all ledgers)."""
    t = _t(spark, sf)
    return J.operations_for_ledgers(t.op_lineitem, t.tx_orders)


@query("orphan_operations", cte("op_lineitem", "tx_orders") + """
SELECT o.* FROM op_lineitem o
WHERE o.transaction_hash IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM tx_orders t WHERE t.hash = o.transaction_hash)""")
def q_orphan_operations(spark, sf):
    """Operations whose transaction is missing."""
    t = _t(spark, sf)
    return J.orphans(t.op_lineitem, t.tx_orders, "transaction_hash", "hash")


@query("childless_transactions", cte("op_lineitem", "tx_orders") + """
SELECT t.* FROM tx_orders t
WHERE NOT EXISTS (SELECT 1 FROM op_lineitem o WHERE o.transaction_hash = t.hash)""")
def q_childless_transactions(spark, sf):
    """J6 (anti join): transactions with no operation recorded."""
    t = _t(spark, sf)
    return J.unprocessed(t.tx_orders, t.op_lineitem.select(F.col("transaction_hash").alias("hash")),
                         key="hash")


@query("trustline_holdings", cte("trustlines", "accounts", "assets") + """
SELECT tl.account_id, tl.asset_id, CAST(tl.balance AS VARCHAR) AS balance, a.asset_type, a.asset_code, a.asset_issuer,
       ac.balance AS native_balance
FROM trustlines tl JOIN assets a ON a.id = tl.asset_id JOIN accounts ac ON ac.account_id = tl.account_id""")
def q_trustline_holdings(spark, sf):
    """Trustline balances with account and asset attached."""
    t = _t(spark, sf)
    return J.trustline_holdings(t.trustlines, t.accounts, t.assets).select(
        "account_id", "asset_id", amount_text(F.col("balance")).alias("balance"), "asset_type",
        "asset_code", "asset_issuer", "native_balance")


@query("since_row", cte("tx_events") + """
SELECT t.* FROM tx_events t,
  (SELECT created_at AS c, id AS i FROM tx_events WHERE id = '5000') a
WHERE t.created_at > a.c OR (t.created_at = a.c AND t.id > a.i)""")
def q_since_row(spark, sf):
    """Rows after an anchor row in (created_at, id) order."""
    return J.since_row(_t(spark, sf).tx_events, "5000")


# ---------------------------------------------------------------------------
# F / L: filters and paging
# ---------------------------------------------------------------------------

@query("filtered_transactions", cte("tx_orders") + """
SELECT * FROM tx_orders
WHERE successful AND fee_charged >= 20000000 AND fee_charged <= 30000000
  AND COALESCE(memo_type, 'none') <> 'none'""")
def q_filtered_transactions(spark, sf):
    """successful transactions with a memo and a fee in a closed range."""
    return FL.filter_transactions(_t(spark, sf).tx_orders, successful=True, min_fee=20_000_000,
                                  max_fee=30_000_000, has_memo=True)


@query("search_transactions", cte("tx_orders") + """
SELECT * FROM tx_orders WHERE lower(hash) LIKE '%777%' OR lower(source_account) LIKE '%777%'""")
def q_search_transactions(spark, sf):
    """F8: substring search over hash and source account, whole table."""
    return FL.search_transactions(_t(spark, sf).tx_orders, "777")


@query("recent_transactions", cte("tx_events") + """
SELECT * FROM tx_events ORDER BY created_at DESC, id DESC LIMIT 10""")
def q_recent_transactions(spark, sf):
    """L1: newest ten transactions."""
    return L.recent(_t(spark, sf).tx_events, "created_at", 10, "id")


@query("latest_ledger", cte("ledgers_events") + """
SELECT sequence AS latest_ledger, closed_at AS latest_ledger_time
FROM ledgers_events ORDER BY sequence DESC LIMIT 1""")
def q_latest_ledger(spark, sf):
    """The highest ledger and its close time."""
    return A.latest_ledger(_t(spark, sf).ledgers_events)


PAGE_CURSOR = ("1998-06-01 00:00:00", "7000")


@query("transaction_page", cte("tx_orders") + """
SELECT * FROM tx_orders
WHERE created_at < TIMESTAMP '1998-06-01 00:00:00'
   OR (created_at = TIMESTAMP '1998-06-01 00:00:00' AND id < '7000')
ORDER BY created_at DESC, id DESC LIMIT 20""")
def q_transaction_page(spark, sf):
    """One keyset page of 20 after a (created_at, id) cursor."""
    conn = L.connection(_t(spark, sf).tx_orders, "created_at", first=20, after=PAGE_CURSOR)
    return conn.edges.drop("cursor")


@query("transaction_page_info", cte("tx_orders") + """
, page AS (SELECT created_at, id FROM tx_orders
  WHERE created_at < TIMESTAMP '1998-06-01 00:00:00'
     OR (created_at = TIMESTAMP '1998-06-01 00:00:00' AND id < '7000')
  ORDER BY created_at DESC, id DESC LIMIT 21)
, kept AS (SELECT * FROM page ORDER BY created_at DESC, id DESC LIMIT 20)
SELECT (SELECT count(*) FROM page) > 20 AS has_next_page, true AS has_previous_page,
       (SELECT created_at FROM kept ORDER BY created_at DESC, id DESC LIMIT 1) AS start_created_at,
       (SELECT id FROM kept ORDER BY created_at DESC, id DESC LIMIT 1) AS start_id,
       (SELECT created_at FROM kept ORDER BY created_at ASC, id ASC LIMIT 1) AS end_created_at,
       (SELECT id FROM kept ORDER BY created_at ASC, id ASC LIMIT 1) AS end_id,
       (SELECT count(*) FROM tx_orders) AS total_count""")
def q_transaction_page_info(spark, sf):
    """Page info of the same page plus the filtered total."""
    conn = L.connection(_t(spark, sf).tx_orders, "created_at", first=20, after=PAGE_CURSOR)
    return conn.page_info.select(
        "has_next_page", "has_previous_page",
        F.col("start_cursor.k").alias("start_created_at"), F.col("start_cursor.id").alias("start_id"),
        F.col("end_cursor.k").alias("end_created_at"), F.col("end_cursor.id").alias("end_id"),
        conn.total_count.select("total_count").scalar().alias("total_count"))


def _load_all() -> None:
    from ledgerlake.plans import queries_asof, queries_extra, queries_gate, queries_more  # noqa: F401  (register on import)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(ORACLES)

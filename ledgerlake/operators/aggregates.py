"""Aggregations.

Design rules used throughout:

* horizons are closed on both sides: rows after ``as_of`` count in none of
  them (totals of whole tables are not horizons);
* one conditional-aggregate pass per fact table instead of one query per
  horizon (the reference issues up to 15 scalar subqueries);
* distinct counts over several horizons are computed from one
  ``groupBy(account).agg(max(ts))`` pass (no 3-way distinct Expand), and
  the per-account partial aggregate collapses hot accounts map-side;
* money is summed as ``decimal(28,7)`` (sum type ``decimal(38,7)``) and
  emitted as the ledger's decimal text; rates and averages are exact
  integer HALF_UP roundings emitted as doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake import schemas as S
from ledgerlake.functions import scalar as E
from ledgerlake.operators.common import amount_text, as_of_column, decimal_text, minus, up_to

def _zero() -> Column:
    return F.lit(0).cast(S.AMOUNT_SUM_INPUT)


def _count_frame(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def _one_row(*frames: DataFrame) -> DataFrame:
    """Combine 1-row aggregate frames into one row: the first frame's row,
    with every column of the others attached as a scalar subquery (no join;
    Spark merges subqueries over the same aggregate and runs it once)."""
    out = frames[0]
    for i, f in enumerate(frames[1:]):
        row = f.select(F.struct(*[F.col(f"`{c}`") for c in f.columns])).scalar()
        out = out.withColumn(f"_r{i}", row)
        out = out.select(*[c for c in out.columns if c != f"_r{i}"],
                         *[F.col(f"_r{i}").getField(c).alias(c) for c in f.columns])
    return out


# A1 -------------------------------------------------------------------------
def table_totals(**tables: DataFrame) -> DataFrame:
    """``total_<name>`` = row count of every given table, one row."""
    return _one_row(*[_count_frame(df, f"total_{name}") for name, df in tables.items()])


# A2 -------------------------------------------------------------------------
def _last_seen_per_account(tx: DataFrame) -> DataFrame:
    return tx.groupBy("source_account").agg(F.max("created_at").alias("last_seen"))


def active_accounts(tx: DataFrame, as_of=None) -> DataFrame:
    """Distinct source accounts with ``as_of - h <= created_at <= as_of`` for 24h/7d/30d."""
    t = as_of_column(tx, "created_at", as_of)
    per = _last_seen_per_account(up_to(tx, "created_at", t).where(
        F.col("source_account").isNotNull() & (F.col("created_at") >= minus(t, S.HORIZONS[-1][1]))))
    return per.agg(*[
        F.count_if(F.col("last_seen") >= minus(t, secs)).alias(f"active_accounts_{label}")
        for label, secs in S.HORIZONS])


# A3 -------------------------------------------------------------------------
def payment_volume(op: DataFrame, as_of=None) -> DataFrame:
    """Σ details.amount of ``payment`` operations per horizon, 0 when none."""
    t = as_of_column(op, "created_at", as_of)
    amt = E.json_decimal(F.col("details"), "amount")
    pay = up_to(op, "created_at", t).where((F.col("type") == "payment")
                   & (F.col("created_at") >= minus(t, S.HORIZONS[-1][1])))
    return pay.agg(*[
        amount_text(F.coalesce(F.sum(F.when(F.col("created_at") >= minus(t, secs), amt)),
                               _zero())).alias(f"volume_{label}")
        for label, secs in S.HORIZONS])


# A4 -------------------------------------------------------------------------
def _fee_avg(fee_sum: Column, n: Column) -> Column:
    return F.when(n > 0, fee_sum.cast("double") / n.cast("double")).otherwise(F.lit(0.0))


def average_fee(tx: DataFrame, as_of=None) -> DataFrame:
    """Mean fee of the last 24 h (exact long sum / count); 0 when empty."""
    t = as_of_column(tx, "created_at", as_of)
    recent = up_to(tx, "created_at", t).where(F.col("created_at") >= minus(t, 86400))
    agg = recent.agg(F.sum("fee_charged").alias("s"), F.count(F.lit(1)).alias("n"))
    return agg.select(_fee_avg(F.col("s"), F.col("n")).alias("average_fee_24h"))


# A5 -------------------------------------------------------------------------
def _rate(succ: Column, n: Column) -> Column:
    return F.when(n > 0, (succ * F.lit(100)).cast("double") / n.cast("double")).otherwise(F.lit(0.0))


def success_rate(tx: DataFrame, as_of=None) -> DataFrame:
    """100 · successful / all over the last 24 h, unrounded; 0 when empty."""
    t = as_of_column(tx, "created_at", as_of)
    recent = up_to(tx, "created_at", t).where(F.col("created_at") >= minus(t, 86400))
    agg = recent.agg(F.count_if(F.col("successful")).alias("s"), F.count(F.lit(1)).alias("n"))
    return agg.select(_rate(F.col("s"), F.col("n")).alias("success_rate_24h"))


# L8 (used by A6) ------------------------------------------------------------
def latest_ledger(led: DataFrame) -> DataFrame:
    """Sequence and close time of the highest sequence (one row)."""
    best = F.max_by(F.struct("sequence", "closed_at"), F.col("sequence"))
    return led.agg(best.alias("l")).select(F.col("l.sequence").alias("latest_ledger"),
                                           F.col("l.closed_at").alias("latest_ledger_time"))


# A6 -------------------------------------------------------------------------
def stats_summary(led: DataFrame, tx: DataFrame, op: DataFrame, acct: DataFrame,
                  asset: DataFrame, as_of=None) -> DataFrame:
    """A1-A5 and L8 in one row; one aggregate pass per table.

    Transactions: one per-account partial aggregate feeds the total count,
    the 3 distinct-account horizons, the 24 h fee mean and success rate.
    """
    t = as_of_column(tx, "created_at", as_of)
    past = F.col("created_at") <= t
    day = past & (F.col("created_at") >= minus(t, 86400))
    per = tx.groupBy("source_account").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.when(past, F.col("created_at"))).alias("last_seen"),
        F.sum(F.when(day, F.col("fee_charged"))).alias("fee_24h"),
        F.count_if(day).alias("n_24h"),
        F.count_if(day & F.col("successful")).alias("ok_24h"))
    txs = per.agg(
        F.sum("n").alias("total_transactions"),
        *[F.count_if(F.col("source_account").isNotNull() & (F.col("last_seen") >= minus(t, secs)))
          .alias(f"active_accounts_{label}") for label, secs in S.HORIZONS],
        F.sum("fee_24h").alias("fee_24h"), F.sum("n_24h").alias("n_24h"),
        F.sum("ok_24h").alias("ok_24h"))
    amt = E.json_decimal(F.col("details"), "amount")
    is_pay = F.col("type") == "payment"
    ops = op.agg(
        F.count(F.lit(1)).alias("total_operations"),
        *[amount_text(F.coalesce(
            F.sum(F.when(is_pay & past & (F.col("created_at") >= minus(t, secs)), amt)), _zero()))
          .alias(f"volume_{label}") for label, secs in S.HORIZONS])
    leds = led.agg(F.count(F.lit(1)).alias("total_ledgers"),
                   F.max_by(F.struct("sequence", "closed_at"), F.col("sequence")).alias("l"))
    out = _one_row(leds, txs, ops, _count_frame(acct, "total_accounts"),
                   _count_frame(asset, "total_assets"))
    n24 = F.coalesce(F.col("n_24h"), F.lit(0))
    return out.select(
        "total_ledgers", F.coalesce(F.col("total_transactions"), F.lit(0)).alias("total_transactions"),
        "total_operations", "total_accounts", "total_assets",
        F.col("l.sequence").alias("latest_ledger"), F.col("l.closed_at").alias("latest_ledger_time"),
        *[F.col(f"active_accounts_{label}") for label, _ in S.HORIZONS],
        *[F.col(f"volume_{label}") for label, _ in S.HORIZONS],
        _fee_avg(F.col("fee_24h"), n24).alias("average_fee_24h"),
        _rate(F.col("ok_24h"), n24).alias("success_rate_24h"))


# A7 -------------------------------------------------------------------------
def account_stats(tx: DataFrame, pay: DataFrame, address: str | None = None) -> DataFrame:
    """Per account: transaction count, Σ outgoing payment amount ("0" when
    none) and last activity. All accounts in one job; ``address`` narrows
    both inputs before the shuffle."""
    if address is not None:
        tx = tx.where(F.col("source_account") == F.lit(address))
        pay = pay.where(F.col("from") == F.lit(address))
    t = tx.groupBy(F.col("source_account").alias("address")).agg(
        F.count(F.lit(1)).alias("transaction_count"), F.max("created_at").alias("last_active"))
    p = pay.groupBy(F.col("from").alias("address")).agg(
        F.sum(E.to_amount(F.col("amount"))).alias("vol"))
    return t.join(p, "address", "full_outer").select(
        "address",
        F.coalesce(F.col("transaction_count"), F.lit(0)).alias("transaction_count"),
        amount_text(F.coalesce(F.col("vol"), _zero())).alias("total_payment_volume"),
        "last_active")


# A8 -------------------------------------------------------------------------
def network_overview(tx: DataFrame, led: DataFrame, as_of=None) -> DataFrame:
    """tps over the last 60 s (strict >), all-time distinct accounts,
    distinct accounts of the last 24 h (strict >), ledger count."""
    t = as_of_column(tx, "created_at", as_of)
    past = F.col("created_at") <= t
    per = tx.groupBy("source_account").agg(
        F.max(F.when(past, F.col("created_at"))).alias("last_seen"),
        F.count_if(past & (F.col("created_at") > minus(t, 60))).alias("n_minute"))
    txs = per.agg(
        (F.coalesce(F.sum("n_minute"), F.lit(0)).cast("double") / F.lit(60.0)).alias("tps"),
        F.count("source_account").alias("total_accounts"),
        F.count_if(F.col("source_account").isNotNull() & (F.col("last_seen") > minus(t, 86400)))
        .alias("active_accounts_24h"))
    return _one_row(txs, _count_frame(led, "total_ledgers"))


# A9 -------------------------------------------------------------------------
def timeframe_seconds(timeframe: str) -> int:
    """Asset-volume labels; unknown labels fall back to 24 h."""
    return dict(S.HORIZONS).get(timeframe, 86400)


def asset_volume(pay: DataFrame, asset_code: str | None = None, timeframe: str = "24h",
                 as_of=None) -> DataFrame:
    """Σ payment amount per asset with ``as_of - timeframe < created_at <= as_of``;
    "0" when nothing matched. ``asset_code`` gives the one-asset form."""
    secs = timeframe_seconds(timeframe)
    t = as_of_column(pay, "created_at", as_of)
    recent = up_to(pay, "created_at", t).where(F.col("created_at") > minus(t, secs))
    if asset_code is not None:
        recent = recent.where(F.col("asset") == F.lit(asset_code))
        agg = recent.agg(F.sum(E.to_amount(F.col("amount"))).alias("v"))
        return agg.select(F.lit(asset_code).alias("asset_code"),
                          amount_text(F.coalesce(F.col("v"), _zero())).alias("volume"),
                          F.lit(timeframe).alias("timeframe"))
    agg = recent.groupBy(F.col("asset").alias("asset_code")).agg(
        F.sum(E.to_amount(F.col("amount"))).alias("v"))
    return agg.select("asset_code", amount_text(F.coalesce(F.col("v"), _zero())).alias("volume"),
                      F.lit(timeframe).alias("timeframe"))


# A10 ------------------------------------------------------------------------
def top_accounts(tx: DataFrame, n: int = 10) -> DataFrame:
    """Accounts by transaction count, ties by address (TakeOrderedAndProject)."""
    return (tx.groupBy(F.col("source_account").alias("address"))
            .agg(F.count(F.lit(1)).alias("activity"))
            .orderBy(F.col("activity").desc(), F.col("address").asc())
            .limit(n))


# A11 ------------------------------------------------------------------------
def daily_transaction_count(tx: DataFrame, days: int = 7, as_of=None) -> DataFrame:
    """Transactions per UTC day with ``as_of - days < created_at <= as_of``, newest first."""
    t = as_of_column(tx, "created_at", as_of)
    recent = up_to(tx, "created_at", t).where(F.col("created_at") > minus(t, days * 86400))
    return (recent.groupBy(F.to_date("created_at").alias("day"))
            .agg(F.count(F.lit(1)).alias("count"))
            .select(E.day_text(F.col("day")).alias("date"), "count")
            .orderBy(F.col("date").desc()))


def counts_by_range(df: DataFrame, ts: str, labels: list[str] | None = None, as_of=None) -> DataFrame:
    """Rows inside each labelled trailing range (chart range selector,
    E12 labels ``1h … 365d``): one conditional-count pass, then one row per
    label (label, seconds, count)."""
    labels = labels or list(S.TIME_RANGES)
    t = as_of_column(df, ts, as_of)
    secs = [E.range_seconds(lb) for lb in labels]
    rows = df.where((F.col(ts) >= minus(t, max(secs))) & (F.col(ts) <= t))
    agg = rows.agg(*[F.count_if(F.col(ts) >= minus(t, s)).alias(f"c{i}") for i, s in enumerate(secs)])
    stack = ", ".join(f"'{lb}', CAST({s} AS BIGINT), c{i}" for i, (lb, s) in enumerate(zip(labels, secs)))
    return agg.select(F.expr(f"stack({len(labels)}, {stack}) AS (range_label, range_seconds, count)"))


# A12 ------------------------------------------------------------------------
def operation_distribution(op: DataFrame, start=None, end=None) -> DataFrame:
    """Count per operation type with its category and share (% of all,
    HALF_UP 2 dp). The total comes from the aggregated counts (one row per
    type, so the un-partitioned window sees a few dozen rows), not from a
    second scan of the operations. The category map is a 24-row constant
    frame, broadcast."""
    from pyspark.sql import Window
    from ledgerlake.operators.filters import in_time_range
    spark = op.sparkSession
    sel = in_time_range(op, "created_at", start, end)
    counts = sel.groupBy("type").agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy())
    cats = F.broadcast(S.operation_category_frame(spark))
    return (counts.join(cats, "type", "left")
            .select("type", F.coalesce(F.col("category"), F.lit("other")).alias("category"),
                    "count", E.ratio_half_up(F.col("count"), total, 2, pct=True).alias("share_pct")))


# A13 ------------------------------------------------------------------------
def average_close_time(led: DataFrame, start=None, end=None) -> DataFrame:
    """Mean gap in seconds between successive ledgers in the range."""
    from ledgerlake.operators.filters import in_time_range
    from ledgerlake.operators.windows import ledger_close_times
    gaps = ledger_close_times(in_time_range(led, "closed_at", start, end))
    return gaps.agg(
        F.sum("gap_micros").alias("s"), F.count("gap_micros").alias("n")).select(
        F.when(F.col("n") > 0, F.col("s").cast("double") / F.col("n").cast("double") / F.lit(1e6))
        .alias("average_close_seconds"), F.col("n").alias("gaps"))


# A14 ------------------------------------------------------------------------
def metrics_summary(m: DataFrame) -> DataFrame:
    """Σ transactions, unweighted mean of the average fee and of the success
    rate, and the trend (latest − earliest transaction count)."""
    def exact_mean(c: str) -> Column:
        # the snapshots hold 2-dp values: sum them exactly as decimals, so
        # the mean does not depend on the order partial sums are combined
        return (F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
                / F.count(F.col(c)).cast("double"))
    return m.agg(
        F.sum("transaction_count").alias("total_transactions"),
        exact_mean("average_fee").alias("mean_average_fee"),
        exact_mean("success_rate").alias("mean_success_rate"),
        (F.max_by("transaction_count", "timestamp") - F.min_by("transaction_count", "timestamp"))
        .alias("trend"))


# A15 ------------------------------------------------------------------------
def asset_totals(m: DataFrame) -> DataFrame:
    return m.agg(
        amount_text(F.coalesce(F.sum(E.to_amount(F.col("volume_24h"))), _zero()))
        .alias("total_volume_24h"),
        F.coalesce(F.sum("trades_24h"), F.lit(0)).alias("total_trades_24h"))


# A16 ------------------------------------------------------------------------
def retention_status(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Per table: row count and oldest timestamp (``{name: (df, ts_col)}``)."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count"), F.min(ts).alias("oldest"))
             .select(F.lit(name).alias("table_name"), "row_count", "oldest")
             for name, (df, ts) in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# A17 ------------------------------------------------------------------------
def filtered_count(df: DataFrame) -> DataFrame:
    """Total rows matching the filter, before any cursor/page limit."""
    return df.agg(F.count(F.lit(1)).alias("total_count"))


# A18 ------------------------------------------------------------------------
def build_asset_metrics(pay: DataFrame, trustlines: DataFrame, assets: DataFrame,
                        as_of=None) -> DataFrame:
    """Per asset snapshot at ``as_of``: volume and trades over 24h/7d/30d,
    holders (trustlines with balance > 0), ``price_change_24h`` and a null
    ``market_cap`` (no price source exists). ``pay`` carries ``asset_id``,
    ``amount`` (decimal) and ``created_at``. Without a price feed the 24 h
    change is computed on volume: last 24 h against the 24 h before it."""
    t = as_of_column(pay, "created_at", as_of)
    amt = F.col("amount").cast(S.AMOUNT_SUM_INPUT)
    win = up_to(pay, "created_at", t).where(F.col("created_at") >= minus(t, 30 * 86400))
    prev_day = (F.col("created_at") >= minus(t, 2 * 86400)) & (F.col("created_at") < minus(t, 86400))
    aggs = []
    for label, secs in S.HORIZONS:
        inside = F.col("created_at") >= minus(t, secs)
        aggs.append(F.sum(F.when(inside, amt)).alias(f"v_{label}"))
        aggs.append(F.count_if(inside).alias(f"trades_{label}"))
    aggs.append(F.sum(F.when(prev_day, amt)).alias("v_prev"))
    vol = win.groupBy("asset_id").agg(*aggs)
    holders = (trustlines.where(F.col("balance").cast(S.AMOUNT_SUM_INPUT) > 0)
               .groupBy("asset_id").agg(F.count(F.lit(1)).alias("holders")))
    from ledgerlake.operators.windows import percentage_change_col
    base = assets.select(F.col("id").alias("asset_id"))
    out = base.join(vol, "asset_id", "left").join(holders, "asset_id", "left")
    z = _zero()
    return out.select(
        "asset_id", t.alias("timestamp"),
        *[amount_text(F.coalesce(F.col(f"v_{label}"), z)).alias(f"volume_{label}")
          for label, _ in S.HORIZONS],
        *[F.coalesce(F.col(f"trades_{label}"), F.lit(0)).alias(f"trades_{label}")
          for label, _ in S.HORIZONS],
        percentage_change_col(F.coalesce(F.col("v_prev"), z), F.coalesce(F.col("v_24h"), z))
        .alias("price_change_24h"),
        F.lit(None).cast("string").alias("market_cap"),
        F.coalesce(F.col("holders"), F.lit(0)).alias("holders"))


# A19 ------------------------------------------------------------------------
def build_account_metrics(acct: DataFrame, tx: DataFrame, trustlines: DataFrame,
                          as_of=None) -> DataFrame:
    """Per account snapshot: native balance, tx counts 24h/7d/30d, first and
    last transaction, active (a tx in 30 d), trustline and signer counts,
    ``total_balance_usd`` "0" (no rate source)."""
    t = as_of_column(tx, "created_at", as_of)
    txa = tx.where(F.col("created_at") <= t).groupBy(F.col("source_account").alias("account_id")).agg(
        *[F.count_if(F.col("created_at") >= minus(t, secs)).alias(f"transaction_count_{label}")
          for label, secs in S.HORIZONS],
        F.min("created_at").alias("first_transaction"),
        F.max("created_at").alias("last_transaction"))
    tl = trustlines.groupBy("account_id").agg(F.count(F.lit(1)).alias("trustlines"))
    signers = F.size(F.col("signers")) if "signers" in acct.columns else F.lit(1)
    base = acct.select("account_id", F.col("balance").alias("balance_native"),
                       signers.alias("signers"))
    out = base.join(txa, "account_id", "left").join(tl, "account_id", "left")
    return out.select(
        "account_id", t.alias("timestamp"), "balance_native",
        F.lit("0").alias("total_balance_usd"),
        *[F.coalesce(F.col(f"transaction_count_{label}"), F.lit(0)).alias(f"transaction_count_{label}")
          for label, _ in S.HORIZONS],
        "first_transaction", "last_transaction",
        F.coalesce(F.col("transaction_count_30d") > 0, F.lit(False)).alias("is_active"),
        F.coalesce(F.col("trustlines"), F.lit(0)).alias("trustlines"),
        F.col("signers").cast("long").alias("signers"))


# A20 ------------------------------------------------------------------------
def duration_summary(log: DataFrame, threshold_ms: float = S.SLOW_QUERY_MS) -> DataFrame:
    """Count, slow count (>= threshold), Σ and mean (HALF_UP 2 dp) of
    ``duration_ms``. ``duration_ms`` is decimal(18,2)."""
    d = F.col("duration_ms").cast("decimal(18,2)")
    agg = log.agg(F.count(F.lit(1)).alias("total_queries"),
                  F.count_if(d >= F.lit(threshold_ms)).alias("slow_queries"),
                  F.sum(d).alias("s"))
    cents = (F.col("s") * 100).cast("long")
    return agg.select("total_queries", "slow_queries",
                      decimal_text(F.coalesce(F.col("s"), F.lit(0).cast("decimal(28,2)")), 28, 2)
                      .alias("total_duration_ms"),
                      F.coalesce(E.ratio_half_up(cents, F.col("total_queries") * 100, 2),
                                 F.lit(0.0)).alias("avg_duration_ms"))


def recent_slow_queries(log: DataFrame, threshold_ms: float = S.SLOW_QUERY_MS,
                        n: int = 10) -> DataFrame:
    """n most recent slow entries, whitespace-collapsed text cut at 500."""
    from ledgerlake.operators.paging import recent
    slow = log.where(F.col("duration_ms").cast("decimal(18,2)") >= F.lit(threshold_ms))
    page = recent(slow, "logged_at", n, "id")
    return page.select("id", "logged_at", decimal_text(F.col("duration_ms"), 18, 2).alias("duration_ms"),
                       F.substring(F.trim(F.regexp_replace("query_text", r"\s+", " ")), 1, 500)
                       .alias("query_text"))


# A21 ------------------------------------------------------------------------
def duration_histogram(log: DataFrame, buckets: list[float], label: str = "label") -> DataFrame:
    """Cumulative ``le`` bucket counts (+Inf included), Σ and count per label.
    One pass of conditional counts, then a stack into rows: no explode of
    the fact rows."""
    v = F.col("duration_s")
    edges = [float(b) for b in buckets]
    aggs = [F.count_if(v <= F.lit(b)).alias(f"b{i}") for i, b in enumerate(edges)]
    agg = log.groupBy(label).agg(*aggs, F.count(F.lit(1)).alias("count"),
                                 F.sum(v.cast("decimal(28,6)")).alias("sum"))
    stack = ", ".join([f"'{b}', b{i}" for i, b in enumerate(edges)] + ["'+Inf', count"])
    return agg.select(label, F.expr(f"stack({len(edges) + 1}, {stack}) AS (le, bucket_count)"),
                      decimal_text(F.col("sum"), 38, 6).alias("sum"), "count")


# A22 ------------------------------------------------------------------------
def event_counters(log: DataFrame) -> DataFrame:
    return log.groupBy("name", "label").agg(F.count(F.lit(1)).alias("value"))


# A23 ------------------------------------------------------------------------
def daily_counters(log: DataFrame, keep_days: int = 7, as_of=None) -> DataFrame:
    t = as_of_column(log, "ts", as_of)
    kept = up_to(log, "ts", t).where(F.to_date("ts") > F.date_sub(F.to_date(t), keep_days))
    return (kept.groupBy("name", E.day_text(F.col("ts")).alias("day"))
            .agg(F.count(F.lit(1)).alias("value")))


# A24 ------------------------------------------------------------------------
def pipeline_health(cycles: DataFrame, timeout_seconds: int = 300, as_of=None) -> DataFrame:
    """Per pipeline: lag = newest source sequence − last processed sequence,
    error rate % (HALF_UP 2 dp, 0 without cycles) and status:
    ``error`` when no cycle within ``timeout_seconds`` of ``as_of``,
    ``degraded`` when lag > 10 or rate > 10, else ``healthy``."""
    t = as_of_column(cycles, "cycle_at", as_of)
    agg = up_to(cycles, "cycle_at", t).groupBy("pipeline").agg(
        F.max("source_sequence").alias("newest_source"),
        F.max(F.when(F.col("ok"), F.col("processed_sequence"))).alias("last_processed"),
        F.count(F.lit(1)).alias("cycles"),
        F.count_if(~F.col("ok")).alias("errors"),
        F.max("cycle_at").alias("last_cycle_at"))
    rate = F.coalesce(E.ratio_half_up(F.col("errors"), F.col("cycles"), 2, pct=True), F.lit(0.0))
    lag = F.col("newest_source") - F.coalesce(F.col("last_processed"), F.lit(0))
    return agg.select(
        "pipeline", lag.alias("lag"), rate.alias("error_rate"), "cycles", "errors",
        F.when(F.col("last_cycle_at") < minus(t, timeout_seconds), F.lit("error"))
        .when((lag > 10) | (rate > 10), F.lit("degraded")).otherwise(F.lit("healthy"))
        .alias("status"))


# A25 ------------------------------------------------------------------------
def duplicate_keys(df: DataFrame, key: str | list[str]) -> DataFrame:
    """Key values occurring more than once, with their multiplicity."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences")).where(
        F.col("occurrences") > 1)


# A26 ------------------------------------------------------------------------
def network_report(led: DataFrame, tx: DataFrame, op: DataFrame, metrics: DataFrame,
                   asset_metrics: DataFrame, as_of=None, top_n: int = 5) -> DataFrame:
    """One row: latest network metrics, the top assets by 24 h volume (as a
    JSON array), active accounts, transaction and operation totals."""
    from ledgerlake.operators.paging import top_assets
    if as_of is not None:
        metrics = up_to(metrics, "timestamp", as_of_column(metrics, "timestamp", as_of))
    latest = metrics.agg(F.max_by(F.struct(*[c for c in metrics.columns]), "timestamp").alias("m"))
    top = top_assets(asset_metrics, top_n).agg(
        F.to_json(F.sort_array(F.collect_list(F.struct(
            F.col("rank"), F.col("asset_id"), F.col("volume_24h"))))).alias("top_assets"))
    aa = active_accounts(tx, as_of).select("active_accounts_24h")
    tots = table_totals(ledgers=led, transactions=tx, operations=op)
    out = _one_row(latest, top, aa, tots)
    return out.select(
        F.col("m.timestamp").alias("metrics_timestamp"),
        F.col("m.transaction_count").alias("metrics_transaction_count"),
        F.col("m.active_accounts").alias("metrics_active_accounts"),
        "top_assets", "active_accounts_24h", "total_ledgers", "total_transactions",
        "total_operations")


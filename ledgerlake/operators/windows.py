"""Window semantics.

The reference has no ``OVER(...)``; these are the window *semantics* it
computes by other means, built so that no step runs the whole input through
one task: no un-partitioned ``Window.orderBy`` over fact rows anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake import schemas as S
from ledgerlake.functions import scalar as E
from ledgerlake.operators.common import amount_text, as_of_column, micros, minus
from ledgerlake.session import ensure_checkpoint_dir

HOUR_US = 3_600_000_000

_MEASURES = ["c_tx", "c_ok", "c_fee", "c_op", "c_vol", "c_acct"]


def _marks(t: Column, **vals) -> list[Column]:
    out = [t.alias("t")]
    for m in _MEASURES:
        v = vals.get(m)
        if m == "c_vol":
            out.append((v if v is not None else F.lit(0)).cast("decimal(38,7)").alias(m))
        else:
            out.append((v if v is not None else F.lit(0)).cast("long").alias(m))
    return out


def account_islands(tx: DataFrame, window_us: int = HOUR_US) -> DataFrame:
    """+1/−1 marks of the maximal time spans in which each account has a
    transaction in the trailing window.

    An account is active at ``t`` iff some tx lies in ``[t − w, t]``, i.e.
    ``t ∈ ∪ [c, c + w]``. Transactions of one account inside one aligned
    ``w``-bucket give a single interval ``[min, max + w]``, so the first
    aggregate collapses any hot account to at most one row per bucket
    (bounded by the time span, not by its row count). Adjacent intervals are
    then merged with lag/lead over that short per-account list.
    Output: (t, c_acct) with +1 at an island start and −1 just after its end.
    """
    per = (tx.select(F.col("source_account").alias("a"), micros("created_at").alias("c"))
           .groupBy("a", F.floor(F.col("c") / F.lit(window_us)).alias("b"))
           .agg(F.min("c").alias("lo"), F.max("c").alias("hi")))
    w = Window.partitionBy("a").orderBy("b")
    prev_hi = F.lag("hi").over(w)
    next_lo = F.lead("lo").over(w)
    flagged = per.select(
        "lo", "hi",
        (prev_hi.isNull() | (F.col("lo") > prev_hi + F.lit(window_us))).alias("is_start"),
        (next_lo.isNull() | (next_lo > F.col("hi") + F.lit(window_us))).alias("is_end"))
    starts = flagged.where("is_start").select(_marks(F.col("lo"), c_acct=F.lit(1)))
    ends = flagged.where("is_end").select(
        _marks(F.col("hi") + F.lit(window_us + 1), c_acct=F.lit(-1)))
    return starts.unionByName(ends)


def network_metrics(led: DataFrame, tx: DataFrame, op: DataFrame, window_seconds: int = 3600,
                    partitions: int | None = None) -> DataFrame:
    """For every ledger close ``t``, metrics over the closed interval
    ``[t − 1h, t]``: transaction, operation and distinct-source counts,
    Σ ``payment`` amount ("0" when none), mean fee and success % (HALF_UP
    2 dp, 0 when no transactions); ``ledger_count`` is 1.

    Plan (exact, no per-ledger query, no single-task window):

    1. deltas: every tx/op becomes a +1 mark at its time; marks are summed
       per exact timestamp (map-side), so a ledger's transactions, which
       share its close time, collapse to one row;
    2. account islands (see :func:`account_islands`) add ±1 marks for the
       distinct count;
    3. probes: each close ``t`` adds a mark at ``t`` (sign +1) and one at
       ``t − 1h − 1µs`` (sign −1), ordered after deltas at equal times;
    4. a distributed prefix sum: range-partition by (time, kind) — sampled
       bounds split any dense stretch of time across tasks — running sums
       inside each partition, partition totals prefix-summed over the few
       partitions (the last row of each partition holds its totals), offset
       added back. The probe rows (2 per ledger) and one row per partition
       are checkpointed so offsets and running sums come from one execution;
    5. per ledger: Σ sign·prefix gives counts and sums over the window; the
       distinct count is the island prefix at ``t``.
    """
    spark = led.sparkSession
    w_us = window_seconds * 1_000_000
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    amount = E.json_decimal(F.col("details"), "amount")
    tx_marks = tx.select(_marks(
        micros("created_at"), c_tx=F.lit(1),
        c_ok=F.when(F.col("successful"), 1).otherwise(0),
        c_fee=F.col("fee_charged")))
    op_marks = op.select(_marks(
        micros("created_at"), c_op=F.lit(1),
        c_vol=F.when(F.col("type") == "payment", F.coalesce(amount, F.lit(0)))))
    deltas = (tx_marks.unionByName(op_marks).unionByName(account_islands(tx, w_us))
              .groupBy("t").agg(*[F.sum(m).alias(m) for m in _MEASURES])
              .select("t", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("seq"),
                      F.lit(0).alias("sign"), *_MEASURES))
    deltas = deltas.withColumn("close", F.lit(None).cast("timestamp_ntz"))
    closes = led.select(F.col("sequence").alias("seq"), micros("closed_at").alias("t"),
                        F.col("closed_at").alias("close"))
    zero = [F.lit(0).cast("decimal(38,7)" if m == "c_vol" else "long").alias(m) for m in _MEASURES]
    probes = (closes.select("t", F.lit(1).alias("kind"), "seq", F.lit(1).alias("sign"), *zero, "close")
              .unionByName(closes.select((F.col("t") - F.lit(w_us + 1)).alias("t"),
                                         F.lit(1).alias("kind"), "seq", F.lit(-1).alias("sign"),
                                         *zero, "close")))
    marks = deltas.unionByName(probes)

    ranged = marks.repartitionByRange(n, "t", "kind").withColumn("pid", F.spark_partition_id())
    w_ord = Window.partitionBy("pid").orderBy("t", "kind")
    w_run = w_ord.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the last row of a partition carries the partition totals in its
    # running sums; a one-row lookahead finds it (no unbounded frame)
    swept = ranged.select(
        "pid", "kind", "seq", "sign", "close",
        F.lead("t").over(w_ord).isNull().alias("last"),
        *[F.sum(m).over(w_run).alias(m) for m in _MEASURES])
    kept = swept.where((F.col("kind") == 1) | F.col("last"))
    ensure_checkpoint_dir(spark)
    kept = kept.checkpoint(eager=True)

    w_prev = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    # ≤ `partitions` rows: the offsets table is bounded by configuration.
    offsets = kept.where(F.col("last")).select(
        "pid", *[F.coalesce(F.sum(m).over(w_prev),
                            F.lit(0).cast("decimal(38,7)" if m == "c_vol" else "long")).alias(f"off_{m}")
                 for m in _MEASURES])
    at = kept.where(F.col("kind") == 1).join(F.broadcast(offsets), "pid")


    def prefix(m: str) -> Column:
        if m != "c_vol":
            return F.col(f"off_{m}") + F.col(m)
        # a sum or product of 38-digit decimals would drop the seventh decimal
        return F.col(f"off_{m}").cast("decimal(37,7)") + F.col(m).cast("decimal(37,7)")

    signed = [F.sum(F.when(F.col("sign") == 1, prefix(m)).otherwise(-prefix(m))).alias(m)
              for m in _MEASURES if m != "c_acct"]
    acct = F.sum(F.when(F.col("sign") == 1, F.col("off_c_acct") + F.col("c_acct"))).alias("c_acct")
    # every ledger has its two probes, so this yields one row per ledger
    out = at.groupBy("seq").agg(F.max("close").alias("close"), *signed, acct)
    return hour_metrics(out)


def hour_metrics(out: DataFrame) -> DataFrame:
    """Metric rows from (seq, close) and the sums over its window."""
    zero_l = F.lit(0).cast("long")
    return out.select(
        F.col("seq").alias("sequence"), F.col("close").alias("timestamp"),
        F.lit(1).cast("long").alias("ledger_count"),
        F.coalesce(F.col("c_tx"), zero_l).alias("transaction_count"),
        F.coalesce(F.col("c_op"), zero_l).alias("operation_count"),
        F.coalesce(F.col("c_acct"), zero_l).alias("active_accounts"),
        amount_text(F.coalesce(F.col("c_vol"), F.lit(0))).alias("total_volume"),
        F.coalesce(E.ratio_half_up(F.col("c_fee"), F.col("c_tx"), 2), F.lit(0.0))
        .cast("double").alias("average_fee"),
        F.coalesce(E.ratio_half_up(F.col("c_ok"), F.col("c_tx"), 2, pct=True), F.lit(0.0))
        .cast("double").alias("success_rate"))


# W2 -------------------------------------------------------------------------
def latest_row_per_key(df: DataFrame, key: str | list[str], ts: str,
                       tiebreak: str | None = None) -> DataFrame:
    """``DISTINCT ON (key) ORDER BY ts DESC``: one row per key via
    ``max_by`` (a partial aggregate: hot keys collapse map-side, no sort)."""
    keys = [key] if isinstance(key, str) else list(key)
    order = F.struct(F.col(ts), F.col(tiebreak)) if tiebreak else F.col(ts)
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"))
            .select(*keys, "_r.*"))


# W3 -------------------------------------------------------------------------
def ledger_close_times(led: DataFrame, bucket: int = 65536) -> DataFrame:
    """Gap to the previous ledger (by sequence) in micros and seconds.

    ``lag`` runs inside sequence buckets of at most ``bucket`` ledgers
    (sequences are unique, so no bucket can hold more). The first ledger of
    a bucket takes its predecessor from the last ledger of the nearest
    earlier non-empty bucket; that table has one row per bucket.
    """
    b = F.floor(F.col("sequence") / F.lit(bucket))
    base = led.select("sequence", "closed_at", b.alias("b"))
    w = Window.partitionBy("b").orderBy("sequence")
    inner = base.select("sequence", "closed_at", "b", F.lag("closed_at").over(w).alias("p"))
    last = base.groupBy("b").agg(F.max_by("closed_at", "sequence").alias("last_close"))
    prev_last = last.select(
        "b", F.lag("last_close").over(Window.orderBy("b")).alias("carry"))
    out = inner.join(prev_last, "b", "left")
    prev = F.coalesce(F.col("p"), F.col("carry"))
    gap = micros("closed_at") - micros(prev)
    return out.select("sequence", "closed_at", prev.alias("prev_closed_at"),
                      gap.alias("gap_micros"),
                      (gap.cast("double") / F.lit(1e6)).alias("gap_seconds"))


# W4 -------------------------------------------------------------------------
def trend(m: DataFrame, ts: str, value: str, key: str | None = None) -> DataFrame:
    """latest − earliest value (per key when given)."""
    agg = (F.max_by(value, ts) - F.min_by(value, ts)).alias("trend")
    return m.groupBy(key).agg(agg) if key else m.agg(agg)


# W5 -------------------------------------------------------------------------
def scale_to_max(df: DataFrame, value: str, out: str = "scaled") -> DataFrame:
    """``100·v / greatest(max(v), 1)``; the max is a scalar subquery."""
    mx = df.select(F.max(value)).scalar()
    return df.withColumn(out, F.lit(100.0) * F.col(value).cast("double")
                         / F.greatest(mx.cast("double"), F.lit(1.0)))


# W6 -------------------------------------------------------------------------
def recent_distinct(df: DataFrame, user: str, key: str, ts: str, n: int = 20) -> DataFrame:
    """Per user, the newest occurrence of each distinct key, newest ``n``.
    The ``row_number() <= n`` filter lets Spark insert a partial
    WindowGroupLimit before the shuffle, so a hot user ships at most ``n``
    rows per map task."""
    newest = df.groupBy(user, key).agg(F.max(ts).alias(ts))
    w = Window.partitionBy(user).orderBy(F.col(ts).desc(), F.col(key).asc())
    return newest.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


# W7 -------------------------------------------------------------------------
def multi_horizon(df: DataFrame, key: str, ts: str, value: str, as_of=None) -> DataFrame:
    """Per key: count and Σ value over 24h/7d/30d, one conditional pass."""
    t = as_of_column(df, ts, as_of)
    v = F.col(value).cast(S.AMOUNT_SUM_INPUT)
    rows = df.where((F.col(ts) >= minus(t, S.HORIZONS[-1][1])) & (F.col(ts) <= t))
    aggs = []
    for label, secs in S.HORIZONS:
        inside = F.col(ts) >= minus(t, secs)
        aggs += [F.count_if(inside).alias(f"count_{label}"),
                 F.sum(F.when(inside, v)).alias(f"s_{label}")]
    agg = rows.groupBy(key).agg(*aggs)
    return agg.select(key, *[c for label, _ in S.HORIZONS for c in (
        F.col(f"count_{label}"),
        amount_text(F.coalesce(F.col(f"s_{label}"), F.lit(0))).alias(f"sum_{label}"))])


def rolling_daily(df: DataFrame, key: str, ts: str, value: str,
                  spans: tuple[int, ...] = (1, 7, 30)) -> DataFrame:
    """Snapshot history (W7 over time): for every key and every UTC day on
    which it had rows, the count and Σ value over the trailing 1/7/30 days
    ending that day. Rows are first reduced to one per (key, day) — a hot
    key collapses map-side — then trailing sums are range windows over the
    day number, partitioned by key (rows per key = active days, bounded by
    the time span)."""
    from ledgerlake.operators.common import micros as _us
    day = F.floor(_us(ts) / F.lit(86_400_000_000)).cast("long")
    daily = df.groupBy(F.col(key), day.alias("day_num")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast(S.AMOUNT_SUM_INPUT)).alias("v"))
    out = [F.col(key), F.date_from_unix_date(F.col("day_num").cast("int")).cast("string").alias("day")]
    for d in spans:
        w = Window.partitionBy(key).orderBy("day_num").rangeBetween(-(d - 1), 0)
        out.append(F.sum("n").over(w).alias(f"trades_{d}d"))
        out.append(amount_text(F.sum("v").over(w)).alias(f"volume_{d}d"))
    return daily.select(*out)


# W8 -------------------------------------------------------------------------
def percentage_change_col(old: Column, new: Column) -> Column:
    """``(new − old) / old · 100``; when old is 0: 100 if new > 0 else 0."""
    return (F.when(old == 0, F.when(new > 0, F.lit(100.0)).otherwise(F.lit(0.0)))
            .otherwise((new - old).cast("double") / old.cast("double") * F.lit(100.0)))


def percentage_change(df: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Daily Σ value per key and its change against the key's previous day
    with data (rows per key = days, bounded by the time span)."""
    daily = df.groupBy(key, F.to_date(ts).alias("day")).agg(
        F.sum(F.col(value).cast(S.AMOUNT_SUM_INPUT)).alias("total"))
    w = Window.partitionBy(key).orderBy("day")
    prev = F.lag("total").over(w)
    return daily.select(
        key, E.day_text(F.col("day")).alias("day"), amount_text(F.col("total")).alias("total"),
        amount_text(prev).alias("previous"),
        F.when(prev.isNotNull(), percentage_change_col(prev, F.col("total"))).alias("change_pct"))

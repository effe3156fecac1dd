"""Structured Streaming jobs.

Live ingest is ``readStream`` → validate → curate → ``foreachBatch`` that
writes each micro-batch as one committed unit (children keyed by the
batch id, commit marker last), so a replayed epoch rewrites the same
partitions and never duplicates rows. Stateful pieces use Spark state:
streaming aggregation for running totals, ``dropDuplicatesWithinWatermark``
for de-duplication and ``applyInPandasWithState`` for first-event-anchored
rate windows; their state expires by the watermark, their rows do not.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ledgerlake import schemas as S
from ledgerlake.functions import scalar as E
from ledgerlake.operators import project as P
from ledgerlake.operators import quality as Q
from ledgerlake.sources import batches, sinks


# T1 / T3 ----------------------------------------------------------------------
def curate(entity: str, valid: DataFrame) -> DataFrame:
    if entity == "transaction":
        return P.curate_transactions(valid)
    if entity == "ledger":
        return valid.select(*[c for c in valid.columns if c != "_corrupt"]).withColumn(
            "closed_at", P.parse_time("closed_at"))
    return P.operation_details(valid).withColumn("created_at", P.parse_time("created_at"))


EVENT_TIME = {"ledger": "closed_at", "transaction": "created_at", "operation": "created_at",
              "payment": "created_at"}


def already_stored(committed: DataFrame, batch: DataFrame, key: str,
                   ts: str | None = None) -> DataFrame:
    """Keys of this batch that are already committed. The stored table is
    first cut to the batch's key range and, when given, to its event-time
    span (a stored copy of a record has the same key and time) — literal
    bounds that reach the scan and prune day partitions — then semi-joined
    with the batch keys, the small side. A micro-batch never anti-joins
    the whole table."""
    cols = [F.min(key).alias("lo"), F.max(key).alias("hi")]
    if ts:
        cols += [F.min(ts).alias("t0"), F.max(ts).alias("t1")]
    b = batch.agg(*cols).first()
    keys = batch.select(key).distinct()
    if b["lo"] is None:
        return keys.limit(0)
    near = committed.where(F.col(key).between(F.lit(b["lo"]), F.lit(b["hi"])))
    if ts and b["t0"] is not None:
        from ledgerlake.operators.filters import in_time_range
        near = in_time_range(near, ts, b["t0"], b["t1"])
    return near.select(key).join(keys, key, "left_semi")


def process_batch(spark: SparkSession, batch: DataFrame, entity: str, root: str, batch_id: int,
                  key: str) -> None:
    """One micro-batch: validate, curate, drop keys already stored (T3),
    write valid rows and the quarantine as one committed unit (S6). The
    batch is persisted while both outputs are written (recomputed from the
    replayable source if an executor is lost)."""
    data = batch.persist()
    try:
        valid, invalid = Q.split_valid(data, entity)
        curated = sinks.dedupe_batch(curate(entity, valid), key)
        committed = sinks.try_read_committed(spark, root, entity)
        if committed is not None:
            ts = EVENT_TIME.get(entity) if EVENT_TIME.get(entity) in curated.columns else None
            seen = already_stored(committed, curated, key, ts)
            curated = curated.join(seen, key, "left_anti")
        sinks.write_batch(spark, root, {entity: curated, f"{entity}_invalid": invalid.drop("errors")},
                          batch_id)
    finally:
        data.unpersist()


def ingest_stream(spark: SparkSession, stream: DataFrame, entity: str, root: str,
                  checkpoint: str, key: str = "id", trigger: dict | None = None, compact_every: int = 0):
    """Raw stream → Q → P → S6 per micro-batch, with a checkpoint so a
    restarted query resumes after the last committed epoch. With
    ``compact_every`` the stream compacts its tables by day after so many
    batches."""
    def fn(batch, batch_id):
        process_batch(spark, batch, entity, root, int(batch_id), key)
        _compact_after(spark, root, int(batch_id), compact_every)
    w = stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()


def _compact_after(spark: SparkSession, root: str, batch_id: int, every: int) -> None:
    if every and (batch_id + 1) % every == 0:
        batches.compact(spark, root, EVENT_TIME)


def process_ledger_units(spark: SparkSession, batch: DataFrame, root: str, batch_id: int) -> None:
    """One micro-batch of landed ledger units (a ledger with its
    transactions and operations), written as ONE committed unit (S6):
    ledgers, transactions, operations, payments, the quarantine and the
    progress rows (T3) share the batch id, and the commit marker is
    appended last. Ledgers already in the progress log are skipped (T2/T3),
    so replays are no-ops. Children are exploded from their own ledger (a
    ledger's transaction and operation counts are capped by the protocol).
    A ledger landed twice in the batch is taken once (the same copy on every
    replay); children of a rejected ledger are quarantined with it."""
    data = batch.persist()
    try:
        done = sinks.try_read_committed(spark, root, "processed_ledgers")
        if done is not None:
            seen = already_stored(done, data, "sequence")
            data = data.join(seen, "sequence", "left_anti")
        named = data.where(F.col("sequence").isNotNull())
        data = sinks.dedupe_batch(named, "sequence").unionByName(data.where(F.col("sequence").isNull()))
        led_cols = [f.name for f in S.RAW_LEDGER.fields] + [c for c in data.columns if c == "_corrupt"]
        ledgers, bad_led = Q.split_valid(data.select(*led_cols), "ledger")
        ok_seq = ledgers.select("sequence")
        units = data.join(ok_seq, "sequence", "left_semi")
        refused = data.join(ok_seq, "sequence", "left_anti")
        tx_raw = units.select(F.explode("transactions").alias("t")).select("t.*")
        op_raw = units.select(F.explode("operations").alias("o")).select("o.*")
        txs, bad_tx = Q.split_valid(tx_raw, "transaction")
        ops, bad_op = Q.split_valid(op_raw, "operation")
        frames = {
            "ledger": curate("ledger", ledgers),
            "transaction": curate("transaction", txs),
            "operation": curate("operation", ops),
            "payment": P.normalize_payments(ops),
            "ledger_invalid": bad_led.drop("errors"),
            "transaction_invalid": bad_tx.drop("errors").unionByName(_with_ledger(refused, "transactions")),
            "operation_invalid": bad_op.drop("errors").unionByName(_with_ledger(refused, "operations")),
            "processed_ledgers": idempotent_marks(ledgers, spark.createDataFrame([], "sequence long")),
        }
        sinks.write_batch(spark, root, frames, batch_id)
    finally:
        data.unpersist()


def _with_ledger(refused: DataFrame, children: str) -> DataFrame:
    """Children of rejected ledgers as quarantine rows."""
    return refused.select(F.explode(children).alias("c")).select(
        F.monotonically_increasing_id().alias("position"), F.lit("ledger: rejected").alias("error"),
        F.to_json("c").alias("raw"))


def ingest_ledger_units(spark: SparkSession, stream: DataFrame, root: str, checkpoint: str,
                        trigger: dict | None = None, compact_every: int = 0):
    """T1 for whole units of work: a stream of landed ledger units, each
    micro-batch committed all-or-nothing by :func:`process_ledger_units`;
    compacted as by :func:`ingest_stream`."""
    def fn(batch, batch_id):
        process_ledger_units(spark, batch, root, int(batch_id))
        _compact_after(spark, root, int(batch_id), compact_every)
    return (stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


# T2 -------------------------------------------------------------------------
def drop_late(batch: DataFrame, last_processed: int | Column, col: str = "sequence") -> DataFrame:
    """Ignore ledgers at or below the last processed sequence."""
    bound = last_processed if isinstance(last_processed, Column) else F.lit(last_processed)
    return batch.where(F.col(col) > bound)


def idempotent_marks(ledgers: DataFrame, processed: DataFrame) -> DataFrame:
    """Progress rows for ledgers not yet marked:
    (sequence, processed_at, tx_count = successful + failed, op_count)."""
    new = ledgers.join(processed.select("sequence"), "sequence", "left_anti")
    return new.select(
        F.col("sequence").cast("long"), F.localtimestamp().alias("processed_at"),
        (F.col("successful_transaction_count") + F.col("failed_transaction_count")).cast("long")
        .alias("tx_count"), F.col("operation_count").cast("long").alias("op_count"))


# T4 -------------------------------------------------------------------------
def incremental_poll(df: DataFrame, hwm, n: int, order: str = "sequence") -> DataFrame:
    """Rows above the high-water mark, ascending, at most ``n`` per poll.
    The caller keeps ``max(order)`` of the result as the next mark; seed it
    with the current maximum so history is not replayed."""
    return df.where(F.col(order) > F.lit(hwm)).orderBy(order).limit(n)


def poll_stream(spark: SparkSession, path: str, schema, files_per_poll: int = 1,
                fmt: str = "parquet", order: str | None = None, after=None) -> DataFrame:
    """Streaming form: each trigger takes at most ``files_per_poll`` new
    files. With ``order``/``after`` (e.g. the high-water mark from
    :func:`seed_high_water`) rows at or below the mark are never emitted.
    File streams cannot start "from now", so history files are still read
    once; a landing folder that only receives new files avoids that."""
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_poll)
              .format(fmt).load(path))
    if order is not None and after is not None:
        stream = stream.where(F.col(order) > F.lit(after))
    return stream


def seed_high_water(df: DataFrame, order: str = "sequence"):
    """Current maximum of ``order`` (one value) to seed a live poll, so the
    history is not replayed to subscribers."""
    return df.agg(F.max(order)).first()[0]


# T5 / T6 --------------------------------------------------------------------
def route_channels(df: DataFrame, kind: str) -> DataFrame:
    """Fan out every row to its channels: global, per account and, for
    operations, per type. One output row per (row, channel)."""
    acct = F.col("source_account")
    if kind == "transaction":
        chans = F.array(F.lit("TRANSACTION_ADDED"), F.concat(F.lit("TRANSACTION_ADDED."), acct))
    elif kind == "operation":
        chans = F.array(F.lit("OPERATION_ADDED"),
                        F.concat(F.lit("OPERATION_ADDED.account."), acct),
                        F.concat(F.lit("OPERATION_ADDED.type."), F.col("type")))
    elif kind == "ledger":
        chans = F.array(F.lit("LEDGER_ADDED"))
    elif kind == "metrics":
        chans = F.array(F.lit("NETWORK_METRICS_UPDATED"))
    else:
        raise ValueError(kind)
    return df.withColumn("channel", F.explode(chans))


def subscribe(df: DataFrame, account: str | None = None, type: str | None = None) -> DataFrame:
    out = df
    if account is not None:
        out = out.where(F.col("source_account") == F.lit(account))
    if type is not None:
        out = out.where(F.col("type") == F.lit(type))
    return out


# T7 -------------------------------------------------------------------------
def live_totals(ledger_stream: DataFrame) -> DataFrame:
    """Running dashboard totals (streaming aggregation, complete/update mode):
    latest ledger and close time, ledger count = highest sequence,
    Σ successful transactions, Σ operations."""
    return ledger_stream.agg(
        F.max("sequence").alias("latest_ledger"),
        F.max_by("closed_at", "sequence").alias("latest_closed_at"),
        F.max("sequence").alias("total_ledgers"),
        F.sum("successful_transaction_count").alias("total_transactions"),
        F.sum("operation_count").alias("total_operations"))


# T8 -------------------------------------------------------------------------
def network_metrics_for_batch(ledgers: DataFrame, tx_history: DataFrame,
                              op_history: DataFrame) -> DataFrame:
    """Exact W1 rows for the ledgers of one micro-batch: history is cut to
    [first close − 1 h, last close] with literal bounds (pushed to the scan
    and, on day-partitioned history, pruning all other days), then the
    same sweep as the batch job runs."""
    from ledgerlake.operators.filters import in_time_range
    from ledgerlake.operators.windows import network_metrics
    b = ledgers.agg(F.min("closed_at").alias("lo"), F.max("closed_at").alias("hi")).first()
    if b["lo"] is None:
        return network_metrics(ledgers, tx_history.limit(0), op_history.limit(0))
    import datetime as _dt
    lo, hi = b["lo"] - _dt.timedelta(hours=1), b["hi"]
    return network_metrics(ledgers, in_time_range(tx_history, "created_at", lo, hi),
                           in_time_range(op_history, "created_at", lo, hi))


def network_metrics_stream(spark: SparkSession, ledger_stream: DataFrame, tx_path: str,
                           op_path: str, out_path: str, checkpoint: str, trigger=None):
    """Recompute W1 for each micro-batch's ledgers against stored
    history and append the snapshots idempotently (S7)."""
    def fn(batch, batch_id):
        tx = spark.read.parquet(tx_path)
        op = spark.read.parquet(op_path)
        m = network_metrics_for_batch(batch, tx, op)
        sinks.append_snapshot(spark, out_path, m, key=("sequence",))
    return (ledger_stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def windowed_activity(tx_stream: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Cheaper streaming variant of T8: aligned 1-hour windows sliding every
    minute with approximate distinct accounts (exact distinct is refused
    in streaming aggregation)."""
    s, et = event_time(tx_stream, "created_at")
    return (s.withWatermark(et, watermark)
            .groupBy(F.window(et, "1 hour", "1 minute"))
            .agg(F.count(F.lit(1)).alias("transaction_count"),
                 F.approx_count_distinct("source_account").alias("active_accounts_approx")))


# T9 -------------------------------------------------------------------------
def batch_summary(tx: DataFrame, network: str) -> DataFrame:
    """One broadcast row per ledger: {network, ledger, txCount, at}."""
    return tx.groupBy(F.col("ledger_sequence").alias("ledger")).agg(
        F.count(F.lit(1)).alias("txCount"), F.max("created_at").alias("at")).select(
        F.lit(network).alias("network"), "ledger", "txCount", "at")


# T10 ------------------------------------------------------------------------
def event_time(stream: DataFrame, ts: str) -> tuple[DataFrame, str]:
    """Watermarks need TIMESTAMP; ledger times are TIMESTAMP_NTZ in UTC, so
    derive an event-time column (session time zone is UTC)."""
    from pyspark.sql.types import TimestampNTZType
    if isinstance(stream.schema[ts].dataType, TimestampNTZType):
        return stream.withColumn("_event_time", F.col(ts).cast("timestamp")), "_event_time"
    return stream, ts


def dedupe_stream(stream: DataFrame, key: str, ts: str, watermark: str = "1 hour") -> DataFrame:
    """Never emit the same key twice (state bounded by the watermark)."""
    s, et = event_time(stream, ts)
    out = s.withWatermark(et, watermark).dropDuplicatesWithinWatermark([key])
    return out.drop("_event_time") if et != ts else out


# T11 ------------------------------------------------------------------------
RATE_LIMITS = {"subscriptions": (10, 60), "websocket": (50, 1), "api": (100, 60)}


def capped(times, start: int | None, count: int, limit: int, window: int):
    """Flags of sorted event times (micros) beyond ``limit`` in windows that
    start at the first event after the previous window's end; with the window
    start and count to go on from. One step per window, not per event."""
    flags = np.zeros(len(times), dtype=bool)
    at = 0
    while at < len(times):
        if start is None or times[at] >= start + window:
            start, count = int(times[at]), 0
        end = int(np.searchsorted(times, start + window, "left"))
        flags[at:end] = np.arange(count + 1, count + 1 + end - at) > limit
        count, at = count + end - at, end
    return flags, start, count


def rate_cap(stream: DataFrame, key: str, ts: str, limit: int, window_seconds: int,
             id_col: str = "id", watermark: str = "1 hour") -> DataFrame:
    """Flag events beyond ``limit`` per key inside a fixed window that
    starts at the key's first event (a new window opens at the first event
    after the previous one ends). All events of a key in a micro-batch are
    ordered by (time, id) before they are counted. State per key is (window
    start, count); it is dropped once the watermark passes the window's end,
    so state holds only keys seen within the watermark.

    Every event comes out, however late. Spark drops rows whose watermarked
    time is behind the watermark, so that time is on a copy of the row, which
    goes once the watermark has seen it, and null on the row that is counted.
    An event behind the watermark whose key's state is gone opens a window of
    its own; ``late`` marks all events behind the watermark."""
    width = window_seconds * 1_000_000
    source, et = event_time(stream, ts)

    def fn(k, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        seen_ms = state.getCurrentWatermarkMs()
        start, count = state.get if state.exists else (None, 0)
        pdf = pd.concat(list(pdfs)).sort_values([ts, id_col])
        micros = pdf[ts].astype("datetime64[us]").astype("int64").to_numpy()
        flags, start, count = capped(micros, start, count, limit, width)
        state.update((start, count))
        end_ms = (start + width) // 1000
        state.setTimeoutTimestamp(max(end_ms, seen_ms + 1))
        yield pdf.assign(rate_limited=flags, late=micros < seen_ms * 1000)[[key, id_col, ts, "rate_limited", "late"]]

    key_type = stream.schema[key].dataType.simpleString()
    id_type = stream.schema[id_col].dataType.simpleString()
    ts_type = stream.schema[ts].dataType.simpleString()
    at = F.col(et).cast("timestamp")
    none = F.lit(None).cast("timestamp")
    counted = (source.withColumn("_watermarked", F.explode(F.when(at.isNotNull(), F.array(none, at)).otherwise(F.array(none))))
               .withWatermark("_watermarked", watermark).where(F.col("_watermarked").isNull()))
    return counted.groupBy(key).applyInPandasWithState(
        fn, f"{key} {key_type}, {id_col} {id_type}, {ts} {ts_type}, rate_limited boolean, late boolean",
        "start long, count long", "append", GroupStateTimeout.EventTimeTimeout)


# T12 ------------------------------------------------------------------------
def dead_letters(failures: DataFrame, successes: DataFrame | None = None) -> DataFrame:
    """Dead-letter entries from the failure log: attempts = failures, first
    and last failure time, last error. A success deletes the entry, so only
    failures after the sequence's last success count; the next failure starts
    again at one attempt."""
    open_ = failures
    if successes is not None:
        ok = successes.groupBy(F.col("sequence").alias("_ok_seq")).agg(F.max("succeeded_at").alias("_ok_at"))
        open_ = (failures.join(ok, failures["sequence"] == ok["_ok_seq"], "left")
                 .where(F.col("_ok_at").isNull() | (F.col("failed_at") > F.col("_ok_at")))
                 .drop("_ok_seq", "_ok_at"))
    return open_.groupBy("sequence").agg(
        F.count(F.lit(1)).alias("attempt_count"),
        F.min("failed_at").alias("first_failed_at"),
        F.max("failed_at").alias("last_failed_at"),
        F.max_by("error", "failed_at").alias("last_error"))


# T13 ------------------------------------------------------------------------
def ready_for_retry(dlq: DataFrame, now) -> DataFrame:
    """Entries with fewer than 5 attempts whose backoff has elapsed:
    ``now >= last_failed_at + min(1000·2^attempts, 300000) ms``."""
    from ledgerlake.operators.common import micros, ntz_lit
    now_c = ntz_lit(now) if not isinstance(now, Column) else now
    wait_ms = E.backoff_ms(F.col("attempt_count"))
    due_us = micros(F.col("last_failed_at")) + wait_ms * F.lit(1000)
    now_us = micros(now_c)
    return dlq.where((F.col("attempt_count") < S.DEAD_LETTER_MAX_ATTEMPTS) & (now_us >= due_us))

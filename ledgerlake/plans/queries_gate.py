"""Queries that run sources, sinks, streams and small predicates on whole
tables: what is written under the job's folder is read back and compared."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerlake.functions import scalar as E
from ledgerlake.operators import filters as FL
from ledgerlake.operators import joins as J
from ledgerlake.operators import maintain as M
from ledgerlake.operators import quality as Q
from ledgerlake.plans.catalog import NETWORK_METRICS_SQL, _t, cte, query
from ledgerlake.plans.queries_more import ACCOUNT_METRICS_SQL, _account_metrics, errors_sql
from ledgerlake.session import ensure_checkpoint_dir
from ledgerlake.sources import batches, raw, sinks
from ledgerlake.streaming import jobs as T
from ledgerlake.streaming import rolling as R


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _land(spark, sf):
    """Raw transactions as landed JSON lines; returns the folder."""
    path = _folder(spark, "landing")
    _t(spark, sf).raw_tx_orders.write.json(path)
    return path


RAW_TX = cte("raw_tx_orders") + """
SELECT id, hash, ledger, created_at, source_account, fee_charged, max_fee, memo_type FROM raw_tx_orders"""
RAW_COLUMNS = ["id", "hash", "ledger", "created_at", "source_account", "fee_charged", "max_fee", "memo_type"]


@query("read_landed_transactions", RAW_TX)
def q_read_raw(spark, sf):
    """Landed JSON lines read with the entity's schema."""
    return raw.read_raw(spark, _land(spark, sf), "transaction").select(*RAW_COLUMNS)


@query("stream_landed_transactions", RAW_TX)
def q_read_stream(spark, sf):
    """S3: the same lines tailed by a stream, two files per micro-batch."""
    out = _folder(spark, "streamed")
    stream = raw.read_stream(spark, _land(spark, sf), "transaction", per_batch=2).select(*RAW_COLUMNS)
    (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", _folder(spark, "offsets"))
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(out)


@query("invalid_lines", cte("raw_tx_orders") + f"""
SELECT month, line, id, error FROM (
  SELECT CAST(ledger AS BIGINT) // 30 AS month, id, {errors_sql('transaction', 'raw_tx_orders')} AS error,
         row_number() OVER (PARTITION BY CAST(ledger AS BIGINT) // 30 ORDER BY id) AS line
  FROM raw_tx_orders) WHERE error <> ''""")
def q_invalid_lines(spark, sf):
    """Q4: transactions landed as one sorted file a month; file and line of
    every record that fails validation."""
    path = _folder(spark, "landing")
    (_t(spark, sf).raw_tx_orders.withColumn("month", F.expr("ledger div 30")).repartition("month")
     .sortWithinPartitions("month", "id").write.partitionBy("month").json(path))
    _, invalid = Q.split_valid_lines(raw.read_lines(spark, path, "transaction"), "transaction")
    return invalid.select(F.regexp_extract("file", "/month=([0-9]+)/", 1).cast("long").alias("month"), "line",
                          F.get_json_object("raw", "$.id").alias("id"), "error")


def _ingested(spark, sf):
    root = _folder(spark, "tables")
    stream = raw.read_stream(spark, _land(spark, sf), "transaction", per_batch=2)
    T.ingest_stream(spark, stream, "transaction", root, _folder(spark, "offsets"), key="hash").awaitTermination()
    return root


@query("ingested_transactions", cte("raw_tx_orders") + f"""
SELECT id, hash, CAST(ledger AS BIGINT) AS ledger_sequence, TRY_CAST(fee_charged AS BIGINT) AS fee_charged
FROM raw_tx_orders WHERE {errors_sql('transaction', 'raw_tx_orders')} = ''""")
def q_ingest_stream(spark, sf):
    """Landed transactions validated, curated and committed by
    the streaming job; the committed rows."""
    return sinks.read_committed(spark, _ingested(spark, sf), "transaction").select(
        "id", "hash", "ledger_sequence", "fee_charged")


@query("compacted_day_range", cte("tx_events") + """
SELECT id FROM tx_events WHERE created_at >= (SELECT max(created_at) FROM tx_events) - INTERVAL 3 DAY""")
def q_compacted_day_range(spark, sf):
    """Two committed batches compacted by day, a third beside them; of
    the last three days only their folders are opened."""
    root = _folder(spark, "batches")
    tx = _t(spark, sf).tx_events.select("id", "created_at")
    for batch in range(3):
        sinks.write_batch(spark, root, {"transaction": tx.where(F.pmod(F.xxhash64("id"), F.lit(3)) == batch)}, batch)
        if batch == 1:
            batches.compact(spark, root, T.EVENT_TIME)
    since = tx.agg((F.max("created_at") - F.expr("INTERVAL 3 DAY")).cast("string")).first()[0]
    return FL.in_time_range(sinks.read_committed(spark, root, "transaction"), "created_at", since).select("id")


@query("batch_metrics", cte("tx_orders", "op_lineitem") + """
SELECT 'transaction' AS entity, count(*) AS rows, (count(*) + 99) // 100 AS chunks FROM tx_orders
UNION ALL SELECT 'operation', count(*), (count(*) + 99) // 100 FROM op_lineitem""")
def q_batch_metrics(spark, sf):
    """Rows and chunks of a batch, counted while it is written."""
    t = _t(spark, sf)
    tx, seen_tx = sinks.with_batch_metrics(t.tx_orders.select("id", "hash"), "transaction")
    ops, seen_ops = sinks.with_batch_metrics(t.op_lineitem.select("id"), "operation")
    sinks.write_batch(spark, _folder(spark, "batch"), {"transaction": tx, "operation": ops}, 0)
    out = sinks.batch_metrics_frame(spark, {"transaction": seen_tx, "operation": seen_ops})
    return out.select("entity", "rows", "chunks")


@query("ingest_quarantine", cte("raw_tx_orders") + f"""
SELECT id, errs AS error FROM (SELECT id, {errors_sql('transaction', 'raw_tx_orders')} AS errs FROM raw_tx_orders)
WHERE errs <> ''""")
def q_ingest_quarantine(spark, sf):
    """What the same job put into quarantine."""
    bad = sinks.read_committed(spark, _ingested(spark, sf), "transaction_invalid")
    return bad.select(F.get_json_object("raw", "$.id").alias("id"), "error")


@query("snapshots_appended_twice", cte("ledgers_orders") + """
SELECT sequence AS entity_id, closed_at AS timestamp, operation_count FROM ledgers_orders""")
def q_append_snapshot(spark, sf):
    """Snapshots appended twice are stored once."""
    path = _folder(spark, "snapshots")
    snap = _t(spark, sf).ledgers_orders.select(F.col("sequence").alias("entity_id"), F.col("closed_at").alias("timestamp"),
                                               "operation_count")
    sinks.append_snapshot(spark, path, snap)
    sinks.append_snapshot(spark, path, snap)
    return spark.read.parquet(path)


@query("exported_csv", cte("op_log") + "SELECT id, name, label, query_text FROM op_log")
def q_export_csv(spark, sf):
    """Exported CSV read back (texts hold quotes and commas)."""
    path = _folder(spark, "csv")
    cols = ["id", "name", "label", "query_text"]
    sinks.export_csv(_t(spark, sf).op_log, path, cols)
    return (spark.read.option("header", True).option("quote", '"').option("escape", '"')
            .schema("id string, name string, label string, query_text string").csv(path))


@query("exported_json", cte("tx_orders") + "SELECT id, source_account, fee_charged FROM tx_orders")
def q_export_json(spark, sf):
    """Exported JSON lines read back."""
    path = _folder(spark, "json")
    sinks.export_json(_t(spark, sf).tx_orders.select("id", "source_account", "fee_charged"), path)
    return spark.read.schema("id string, source_account string, fee_charged long").json(path)


@query("deduplicated_stream", cte("tx_events") + "SELECT DISTINCT id FROM tx_events")
def q_dedupe_stream(spark, sf):
    """Every event landed twice, emitted once."""
    src, out = _folder(spark, "twice"), _folder(spark, "once")
    tx = _t(spark, sf).tx_events.select("id", "created_at")
    tx.unionByName(tx).write.parquet(src)
    stream = spark.readStream.schema(tx.schema).parquet(src)
    (T.dedupe_stream(stream, "id", "created_at", "40 days").select("id").writeStream.format("parquet")
     .option("path", out).option("checkpointLocation", _folder(spark, "offsets"))
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(out)


@query("payment_subset", cte("op_lineitem") + "SELECT id FROM op_lineitem WHERE type = 'payment'")
def q_payments_only(spark, sf):
    """payments only."""
    return FL.payments_only(_t(spark, sf).op_lineitem).select("id")


@query("memo_subset", cte("tx_orders") + "SELECT id FROM tx_orders WHERE memo_type IS NOT NULL AND memo_type <> 'none'")
def q_with_memo(spark, sf):
    """transactions with a memo."""
    return FL.with_memo(_t(spark, sf).tx_orders).select("id")


@query("fee_subset", cte("tx_events") + "SELECT id FROM tx_events WHERE fee_charged > 0")
def q_fee_positive(spark, sf):
    """transactions that paid a fee."""
    return FL.fee_positive(_t(spark, sf).tx_events).select("id")


@query("processed_transactions", cte("tx_orders", "processed_orders") + """
SELECT id FROM tx_orders WHERE ledger_sequence IN (SELECT sequence FROM processed_orders)""")
def q_processed_only(spark, sf):
    """Transactions of ledgers in the progress log."""
    t = _t(spark, sf)
    done = t.processed_orders.withColumnRenamed("sequence", "ledger_sequence")
    return J.processed_only(t.tx_orders, done, "ledger_sequence").select("id")


@query("identifier_tests", cte("raw_tx_orders") + """
SELECT id, regexp_full_match(source_account, 'G[A-Z2-7]{55}') AS address_ok, regexp_full_match(hash, '[0-9a-fA-F]{64}') AS hash_ok,
       regexp_full_match(fee_charged, '[0-9]+([.][0-9]+)?') AS fee_ok, regexp_full_match(memo_type, '[0-9]+([.][0-9]+)?') IS TRUE AS memo_ok
FROM raw_tx_orders""")
def q_identifier_tests(spark, sf):
    """Address, hash and numeric tests."""
    return _t(spark, sf).raw_tx_orders.select(
        "id", E.is_address("source_account").alias("address_ok"), E.is_hash("hash").alias("hash_ok"),
        E.is_numeric_string("fee_charged").alias("fee_ok"), E.is_numeric_string("memo_type").alias("memo_ok"))


@query("touched_rows", cte("tx_orders") + """
SELECT id, CASE WHEN fee_charged % 2 = 0 THEN TIMESTAMP '2024-05-01 00:00:00' END AS updated_at FROM tx_orders""")
def q_touch_updated(spark, sf):
    """M9: changed rows get the change time, others keep theirs."""
    tx = _t(spark, sf).tx_orders
    return M.touch_updated(tx, F.col("fee_charged") % 2 == 0, "2024-05-01 00:00:00").select("id", "updated_at")


@query("preset_active", ACCOUNT_METRICS_SQL + "SELECT account_id FROM acm WHERE is_active")
def q_preset_active(spark, sf):
    """F12 ``active``: accounts with a transaction in the last 30 days."""
    return FL.preset("active", _account_metrics(_t(spark, sf))).select("account_id")


LIVE_LATENESS_HOURS, LIVE_SLICES, LIVE_BUCKETS = 6, 4, 64


@query("network_metrics_live", NETWORK_METRICS_SQL.replace(
    "\nSELECT l.sequence, l.closed_at AS timestamp", "\n, nm AS (SELECT l.sequence, l.closed_at AS timestamp", 1)
    + f""")
SELECT * FROM nm WHERE timestamp <= (
  SELECT greatest((SELECT max(closed_at) FROM ledgers_events), (SELECT max(created_at) FROM tx_events),
                  (SELECT max(created_at) FROM op_events)) - INTERVAL {LIVE_LATENESS_HOURS} HOUR)""")
def q_network_metrics_live(spark, sf):
    """All events landed in slices of time, each row up to six hours late,
    and streamed through the trailing-hour state; ledgers come out once the
    watermark has passed them. Every slice is landed by all cores and streamed
    as one micro-batch by a stream that goes on from its checkpoint."""
    t = _t(spark, sf)
    staged, path, out, offsets = (_folder(spark, x) for x in ("staged", "events", "live", "offsets"))
    events = R.hour_events(t.ledgers_events, t.tx_events, t.op_events, LIVE_BUCKETS)
    late_us = LIVE_LATENESS_HOURS * 3_600_000_000
    span = events.agg(F.min("t").alias("lo"), F.max("t").alias("hi")).first()      # one row
    wide = -(-(span["hi"] - span["lo"] + late_us + 1) // LIVE_SLICES)
    late = F.pmod(F.xxhash64("t", "account", "bucket"), F.lit(late_us))
    slices = F.floor((F.col("t") - F.lit(span["lo"]) + late) / F.lit(wide)).cast("int")
    events.withColumn("slice", slices).write.partitionBy("slice").parquet(staged)
    for k in range(LIVE_SLICES):
        (spark.read.schema(events.withColumn("slice", slices).schema).parquet(staged)
         .where(F.col("slice") == k).drop("slice").write.mode("append").parquet(path))
        stream = spark.readStream.schema(events.schema).parquet(path)
        R.rolling_network_metrics(spark, stream, out, offsets, f"{LIVE_LATENESS_HOURS} hours",
                                  partitions=LIVE_BUCKETS).awaitTermination()
    return spark.read.parquet(out)


@query("insert_ignore_transactions", cte("tx_orders") + """
SELECT hash, source_account, created_at, fee_charged FROM tx_orders""")
def q_insert_ignore_transactions(spark, sf):
    """S5 on hash keys: the transactions appended in four overlapping batches,
    each a third of a table that grows; the key index finds what is stored."""
    path = _folder(spark, "by_hash")
    tx = _t(spark, sf).tx_orders.select("hash", "source_account", "created_at", "fee_charged")
    part = F.pmod(F.xxhash64("hash"), F.lit(6))
    for k in range(4):
        sinks.insert_ignore_table(spark, path, tx.where(part.between(k, k + 2)), "hash", key_index=True)
    return spark.read.parquet(path)


@query("operations_flat", cte("tx_orders", "op_lineitem") + """
SELECT o.transaction_hash AS hash, row_number() OVER (
         PARTITION BY o.transaction_hash ORDER BY o.operation_index, o.id, o.type) - 1 AS ordinal, o.id, o.type
FROM op_lineitem o WHERE EXISTS (SELECT 1 FROM tx_orders t WHERE t.hash = o.transaction_hash)""")
def q_operations_flat(spark, sf):
    """J2 flat: (transaction, ordinal, operation) rows."""
    t = _t(spark, sf)
    out = J.operations_flat(t.tx_orders, t.op_lineitem, fields=("operation_index", "id", "type"))
    return out.select("hash", "ordinal", "id", "type")


@query("transactions_flat", cte("ledgers_orders", "tx_orders") + """
SELECT t.ledger_sequence AS sequence, row_number() OVER (
         PARTITION BY t.ledger_sequence ORDER BY t.created_at, t.id) - 1 AS ordinal, t.id, t.hash
FROM tx_orders t WHERE EXISTS (SELECT 1 FROM ledgers_orders l WHERE l.sequence = t.ledger_sequence)""")
def q_transactions_flat(spark, sf):
    """J3 flat: (ledger, ordinal, transaction) rows."""
    t = _t(spark, sf)
    return J.transactions_flat(t.ledgers_orders, t.tx_orders).select("sequence", "ordinal", "id", "hash")


@query("retained_transactions", cte("tx_orders") + """
SELECT id, hash, created_at, CASE WHEN created_at < (SELECT max(created_at) FROM tx_orders) - INTERVAL 365 DAY
                                  THEN 'archive' ELSE 'live' END AS stored_in
FROM tx_orders""")
def q_retained_transactions(spark, sf):
    """M6 with its writes: the transactions as a table partitioned by month,
    everything older than a year archived, verified and dropped; what the
    live table and the archive hold then."""
    root = _folder(spark, "retention")
    tx = _t(spark, sf).tx_orders.select("id", "hash", "created_at",
                                        F.date_format("created_at", "yyyy-MM").alias("month"))
    tx.write.partitionBy("month").parquet(f"{root}/live")
    M.apply_retention(spark, f"{root}/live", f"{root}/archive", "created_at", 365, "id", partition_col="month")
    live, archive = (spark.read.parquet(f"{root}/{x}").select("id", "hash", "created_at", F.lit(x).alias("stored_in"))
                     for x in ("live", "archive"))
    return live.unionByName(archive)


@query("upserted_across_partitions", cte("tx_orders") + """
SELECT id, CASE WHEN abs(fee_charged) % 3 = 0 THEN 'changed' ELSE 'first' END AS state, successful AS kept_in
FROM tx_orders""")
def q_upserted_across_partitions(spark, sf):
    """S4 through staged replacement: a third of the rows come again with
    another partition value and update their row where it is."""
    path = _folder(spark, "upserted")
    tx = _t(spark, sf).tx_orders.select("id", "fee_charged", F.lit("first").alias("state"), "successful")
    sinks.upsert_table(spark, path, tx, "id", ["state"], partition_by=["successful"])
    again = tx.where(F.abs("fee_charged") % 3 == 0).select(
        "id", "fee_charged", F.lit("changed").alias("state"), (~F.col("successful")).alias("successful"))
    sinks.upsert_table(spark, path, again, "id", ["state"], partition_by=["successful"], moving_keys=True)
    return spark.read.parquet(path).select("id", "state", F.col("successful").cast("boolean").alias("kept_in"))

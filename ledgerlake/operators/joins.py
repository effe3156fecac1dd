"""Joins (J1-J13).

Joins are declared as plain equi-joins and semi/anti joins; the size of a
dimension is never assumed. Spark broadcasts a side only when its measured
size is under ``spark.sql.autoBroadcastJoinThreshold`` (checked again at
runtime by AQE) and falls back to a shuffle join otherwise. Explicit
``broadcast()`` is used only for inputs whose size is bounded by the call
itself (a list of requested keys, a constant lookup table).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.session import ensure_checkpoint_dir


#: Keys of a lookup that are broadcast; a longer request is shuffled.
BROADCAST_KEYS = 1_000_000


# J1 -------------------------------------------------------------------------
def operations_for_ledgers(op: DataFrame, tx: DataFrame, sequences=None) -> DataFrame:
    """Operations of the given ledgers via an inner join op → tx on
    ``transaction_hash = hash``, with the transaction's ledger attached.
    ``sequences`` is a short list, or a frame with ``sequence`` of any size."""
    t = tx.select(F.col("hash").alias("transaction_hash"),
                  F.col("ledger_sequence").alias("tx_ledger_sequence"))
    if isinstance(sequences, DataFrame):
        wanted = sequences.select(F.col("sequence").alias("_seq")).distinct()
        t = t.join(wanted, F.col("tx_ledger_sequence") == F.col("_seq"), "left_semi")
    elif sequences is not None:
        t = t.where(F.col("tx_ledger_sequence").isin(list(sequences)))
    return op.join(t, "transaction_hash", "inner")


# J2 / J3, flat ----------------------------------------------------------------
def ordinals(child: DataFrame, key: str, order: list[str], out: str = "ordinal",
             partitions: int | None = None, part: str | None = None) -> DataFrame:
    """Number the rows of each ``key`` 0, 1, ... by ``order`` (then by all other
    columns), without gathering a key's rows anywhere.

    Rows are range-partitioned by (key, order): sampled bounds cut a key that
    holds a large share of all rows into many partitions. Rows are numbered
    inside each (partition, key); what the earlier partitions hold of a key is
    added. Only keys that cross a bound have such an offset, so the table of
    offsets has fewer rows than there are partitions and is broadcast. The
    partitioned rows are checkpointed, so that numbers and offsets come from
    one execution. Rows without a key are left out. ``part`` keeps the number
    of the partition under that name."""
    spark = child.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [key, *order, *[c for c in child.columns if c not in (key, *order)]]
    rows = (child.where(F.col(key).isNotNull()).repartitionByRange(n, *[F.col(c) for c in by])
            .withColumn("_part", F.spark_partition_id()))
    ensure_checkpoint_dir(spark)
    rows = rows.checkpoint(eager=True)
    counts = rows.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"))
    crossing = counts.groupBy(F.col(key).alias("_key")).agg(
        F.count(F.lit(1)).alias("_parts"), F.min("_part").alias("_first")).where("_parts > 1")
    several = counts.join(crossing, F.col(key) == F.col("_key"), "left_semi")
    before = (several.select(F.col(key).alias("_key"), F.col("_part").alias("_in"), (F.sum("_n").over(
        Window.partitionBy(key).orderBy("_part")) - F.col("_n")).alias("_before")).where("_before > 0"))
    inside = F.row_number().over(Window.partitionBy("_part", key).orderBy(*by[1:])) - 1
    numbered = rows.withColumn("_inside", inside).join(
        F.broadcast(before), (F.col(key) == F.col("_key")) & (F.col("_part") == F.col("_in")), "left")
    number = (F.col("_inside") + F.coalesce("_before", F.lit(0))).cast("long").alias(out)
    return numbered.select(key, number, *by[1:], *([F.col("_part").alias(part)] if part else []))


def operations_flat(tx: DataFrame, op: DataFrame,
                    fields=("operation_index", "id", "type", "source_account", "created_at", "details")) -> DataFrame:
    """J2 as rows (hash, ordinal, operation fields): the operations of each
    transaction in index order, for groups of any size. Operations without
    their transaction are left out, transactions without operations give no
    row."""
    kids = op.select(F.col("transaction_hash").alias("hash"), *fields)
    return ordinals(kids.join(tx.select("hash").distinct(), "hash", "left_semi"), "hash", ["operation_index", "id"])


def transactions_flat(led: DataFrame, tx: DataFrame,
                      fields=("created_at", "id", "hash", "source_account", "successful", "fee_charged")) -> DataFrame:
    """J3 as rows (sequence, ordinal, transaction fields)."""
    kids = tx.select(F.col("ledger_sequence").alias("sequence"), *fields)
    return ordinals(kids.join(led.select("sequence").distinct(), "sequence", "left_semi"), "sequence",
                    ["created_at", "id"])


# J2 -------------------------------------------------------------------------
def _nest(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str,
          fields: list[str], order: list[str], out: str, most: int | None = None) -> DataFrame:
    """Children grouped under each parent as an ordered array (empty when
    none). An array is one transaction's operations or one ledger's
    transactions; where the ledger's own limits do not bound them, pass
    ``most``: the largest group is then counted first and an error names the
    flat form (:func:`ordinals`) if it holds more."""
    if most is not None:
        largest = child.groupBy(child_key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        if largest and largest > most:
            raise ValueError(f"{largest} rows of one {child_key}, more than {most}: use the flat form")
    kids = child.groupBy(F.col(child_key).alias("_k")).agg(
        F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order + [
            f for f in fields if f not in order]])))
        .alias(out))
    nested = parent.join(kids, parent[parent_key] == kids["_k"], "left").drop("_k")
    empty = F.array().cast(kids.schema[out].dataType)
    return nested.withColumn(out, F.coalesce(F.col(out), empty))


def with_operations(tx: DataFrame, op: DataFrame,
                    fields=("operation_index", "id", "type", "source_account", "created_at",
                            "details"), most: int | None = None) -> DataFrame:
    """Each transaction with its operations ordered by index (then by all
    other fields, so duplicates order deterministically)."""
    return _nest(tx, op, "hash", "transaction_hash", list(fields), ["operation_index", "id"],
                 "operations", most)


# J3 -------------------------------------------------------------------------
def with_transactions(led: DataFrame, tx: DataFrame,
                      fields=("created_at", "id", "hash", "source_account", "successful",
                              "fee_charged"), most: int | None = None) -> DataFrame:
    return _nest(led, tx, "sequence", "ledger_sequence", list(fields), ["created_at", "id"],
                 "transactions", most)


# J4 -------------------------------------------------------------------------
def aligned_lookup(keys, table: DataFrame, key: str) -> DataFrame:
    """One row per requested key in request order, duplicates kept, nulls
    when absent. ``keys`` is a list, or a frame with ``pos`` and the key.

    The table is cut to the distinct keys by a semi join first. Up to
    ``BROADCAST_KEYS`` keys that filters the scan without moving the table;
    beyond that it is a shuffle join. Only the rows found meet the request.
    """
    spark = table.sparkSession
    if isinstance(keys, DataFrame):
        req = keys.select(F.col("pos").cast("long").alias("pos"), F.col(key).alias("_key"))
        n = req.count()
    else:
        dtype = table.schema[key].dataType.simpleString()
        req = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], f"pos long, _key {dtype}")
        n = len(keys)
    wanted = req.where(F.col("_key").isNotNull()).select(F.col("_key").alias("_want")).distinct()
    if n <= BROADCAST_KEYS:
        wanted = F.broadcast(wanted)
    found = table.join(wanted, table[key] == F.col("_want"), "left_semi")
    joined = req.join(found, F.col("_key") == F.col(key), "left")
    return joined.orderBy("pos").drop(key).withColumnRenamed("_key", key)


# J5 -------------------------------------------------------------------------
def latest_per_entity(entity: DataFrame, history: DataFrame, key: str, ts: str,
                      start=None, end=None, entity_key: str | None = None,
                      prefix: str = "latest_") -> DataFrame:
    """``LEFT JOIN LATERAL (… ORDER BY ts DESC LIMIT 1)``: each entity with
    its newest history row inside the optional range; nulls when none.
    ``max_by`` is a partial aggregate, so hot entities collapse map-side."""
    from ledgerlake.operators.filters import in_time_range
    from ledgerlake.operators.windows import latest_row_per_key
    h = in_time_range(history, ts, start, end)
    latest = latest_row_per_key(h, key, ts, "id" if "id" in h.columns and key != "id" else None)
    renamed = latest.select(F.col(key).alias("_hk"),
                            *[F.col(c).alias(prefix + c) for c in latest.columns if c != key])
    ek = entity_key or key
    return entity.join(renamed, entity[ek] == renamed["_hk"], "left").drop("_hk")


# J6 / J7 ----------------------------------------------------------------------
def unprocessed(candidates: DataFrame, processed: DataFrame, key: str = "sequence") -> DataFrame:
    """Left anti: candidates not yet processed."""
    return candidates.join(processed.select(key), key, "left_anti")


def processed_only(df: DataFrame, processed: DataFrame, key: str = "sequence") -> DataFrame:
    """Left semi (EXISTS)."""
    return df.join(processed.select(key), key, "left_semi")


# J8 -------------------------------------------------------------------------
def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Child rows whose non-null foreign key has no parent."""
    p = parent.select(F.col(pk).alias("_pk"))
    return child.where(F.col(fk).isNotNull()).join(p, F.col(fk) == F.col("_pk"), "left_anti")


# J9 -------------------------------------------------------------------------
def cascade_delete(ledgers: DataFrame, tx: DataFrame, ops: DataFrame, sequences):
    """Deleting ledgers removes their transactions, then those transactions'
    operations. ``sequences`` is a frame with a ``sequence`` column (or a
    short list). Returns ``(kept, removed)`` dicts of frames, built from
    semi/anti joins so nothing passes through the driver."""
    if isinstance(sequences, DataFrame):
        seqs = sequences.select(F.col("sequence").alias("_seq")).distinct()
    else:
        seqs = ledgers.sparkSession.createDataFrame([(int(s),) for s in sequences], "_seq long")
    gone_led = ledgers.join(seqs, ledgers["sequence"] == seqs["_seq"], "left_semi")
    gone_tx = tx.join(seqs, tx["ledger_sequence"] == seqs["_seq"], "left_semi")
    gone_keys = gone_tx.select(F.col("hash").alias("transaction_hash"))
    kept = {
        "ledgers": ledgers.join(seqs, ledgers["sequence"] == seqs["_seq"], "left_anti"),
        "transactions": tx.join(seqs, tx["ledger_sequence"] == seqs["_seq"], "left_anti"),
        "operations": ops.join(gone_keys, "transaction_hash", "left_anti"),
    }
    removed = {
        "ledgers": gone_led,
        "transactions": gone_tx,
        "operations": ops.join(gone_keys, "transaction_hash", "left_semi"),
    }
    return kept, removed


# J10 ------------------------------------------------------------------------
def asset_metrics_view(assets: DataFrame, metrics: DataFrame, type=None, code=None, issuer=None,
                       first: int = 20, start=None, end=None) -> DataFrame:
    """Assets (filtered) with their latest metrics in range, ordered by
    asset id, first ``first``; a nested ``asset`` struct;
    ``price_change_24h`` null → 0."""
    from ledgerlake.operators.filters import filter_assets
    a = filter_assets(assets, type, code, issuer)
    j = latest_per_entity(a, metrics, "asset_id", "timestamp", start, end, entity_key="id",
                          prefix="m_")
    return j.orderBy("id").limit(first).select(
        F.col("id").alias("asset_id"),
        F.struct("asset_type", "asset_code", "asset_issuer").alias("asset"),
        F.col("m_timestamp").alias("timestamp"),
        F.col("m_volume_24h").alias("volume_24h"),
        F.col("m_trades_24h").alias("trades_24h"),
        F.coalesce(F.col("m_price_change_24h"), F.lit(0.0)).alias("price_change_24h"),
        F.col("m_holders").alias("holders"))


# J11 ------------------------------------------------------------------------
def account_profile(acct: DataFrame, metrics: DataFrame, tx: DataFrame, account_id=None,
                    n: int = 20) -> DataFrame:
    """Account ⟕ latest metrics ⟕ its most recent ``n`` transactions
    (array, newest first). Without ``account_id`` every account is built in
    one job; the per-account top-n uses a row_number filter, which Spark
    pre-limits per map task."""
    from pyspark.sql import Window
    if account_id is not None:
        acct = acct.where(F.col("account_id") == F.lit(account_id))
        metrics = metrics.where(F.col("account_id") == F.lit(account_id))
        tx = tx.where(F.col("source_account") == F.lit(account_id))
    w = Window.partitionBy("source_account").orderBy(F.col("created_at").desc(), F.col("id").desc())
    top = tx.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    recent = top.groupBy(F.col("source_account").alias("_a")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(
            F.col("_rn"), F.col("id"), F.col("hash"), F.col("created_at"), F.col("successful"),
            F.col("fee_charged")))), lambda s: s.dropFields("_rn")).alias("recent_transactions"))
    prof = latest_per_entity(acct, metrics, "account_id", "timestamp", prefix="metrics_")
    out = prof.join(recent, prof["account_id"] == recent["_a"], "left").drop("_a")
    empty = F.array().cast(recent.schema["recent_transactions"].dataType)
    return out.withColumn("recent_transactions", F.coalesce(F.col("recent_transactions"), empty))


# J12 ------------------------------------------------------------------------
def trustline_holdings(trustlines: DataFrame, acct: DataFrame, assets: DataFrame) -> DataFrame:
    """Account × asset balances with both dimensions attached."""
    a = assets.select(F.col("id").alias("asset_id"), "asset_type", "asset_code", "asset_issuer")
    ac = acct.select("account_id", F.col("balance").alias("native_balance"))
    return trustlines.join(a, "asset_id", "inner").join(ac, "account_id", "inner")


# J13 ------------------------------------------------------------------------
def since_row(tx: DataFrame, anchor_id: str, ts: str = "created_at",
              id_col: str = "id") -> DataFrame:
    """Rows strictly after the anchor row in ``(ts, id)`` order. The anchor
    key is a scalar subquery, not a join."""
    anchor = tx.where(F.col(id_col) == F.lit(anchor_id)).select(
        F.max(F.struct(F.col(ts), F.col(id_col)))).scalar()
    return tx.where(F.struct(F.col(ts), F.col(id_col)) > anchor)


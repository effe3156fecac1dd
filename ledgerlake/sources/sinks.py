"""Sinks (S4-S10): idempotent upsert and insert-ignore over Parquet,
atomic multi-table batches with a commit marker, snapshots and exports.

Plain Parquet has no MERGE, so:

* the merge itself is a DataFrame (:func:`merge_upsert`, :func:`insert_ignore`)
  — a full-outer / anti join on the key, planned and shuffled by Spark;
* writing it never reads and overwrites the same files in one plan: the
  touched partitions are merged into a staging folder next to the table,
  then put in with dynamic partition overwrite, so only partitions
  that received rows are rewritten (``replace`` finishes what a crash left);
* a multi-table unit of work (:func:`write_batch`) writes every child
  keyed by ``batch_id`` and appends the commit marker last; readers
  semi-join the marker (:func:`read_committed`), so a torn batch is
  invisible and a replayed batch overwrites its own partitions. :mod:`ledgerlake.sources.batches`
  compacts batches, by day where a table has an event time.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from ledgerlake import schemas as S
from ledgerlake.operators.common import ntz_lit
from ledgerlake.sources import batches
from ledgerlake.sources import key_index as keyed
from ledgerlake.sources import replace


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def dedupe_batch(batch: DataFrame, key, order: str | None = None) -> DataFrame:
    """One row per key inside a batch: the last by ``order`` when given,
    otherwise (and among equals) the one of the largest row hash, so that a
    replay keeps the same row. ``max_by`` is a partial aggregate."""
    keys = _keys(key)
    rest = [c for c in batch.columns if c not in keys]
    if not rest:
        return batch.distinct()
    tie = F.xxhash64(*[F.to_json(F.struct(*rest))])
    by = tie if order is None else F.struct(F.col(order), tie)
    return batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("_r")).select(
        *keys, "_r.*").select(*batch.columns)


# S4 -------------------------------------------------------------------------
def merge_upsert(target: DataFrame, batch: DataFrame, key, update_cols: list[str], ts=None,
                 order: str | None = None) -> DataFrame:
    """Insert new keys; on a key conflict overwrite only ``update_cols`` and
    set ``updated_at`` (when the table has it), keeping every other column."""
    keys = _keys(key)
    new = dedupe_batch(batch, keys, order)
    cols = target.columns
    o = target.select(*[F.col(c).alias(f"o_{c}") for c in cols], F.lit(True).alias("_o"))
    n = new.select(*[F.col(c).alias(f"n_{c}") for c in new.columns], F.lit(True).alias("_n"))
    cond = None
    for k in keys:
        c = F.col(f"o_{k}") == F.col(f"n_{k}")
        cond = c if cond is None else cond & c
    j = o.join(n, cond, "full_outer")
    both = F.col("_o").isNotNull() & F.col("_n").isNotNull()
    only_new = F.col("_o").isNull()
    from ledgerlake.operators.common import ntz_lit
    stamp = ntz_lit(ts) if ts is not None else F.localtimestamp()
    out = []
    for c in cols:
        newc = F.col(f"n_{c}") if c in new.columns else F.lit(None).cast(target.schema[c].dataType)
        if c in keys:
            v = F.coalesce(F.col(f"o_{c}"), newc)
        elif c == "updated_at":
            v = F.when(both, stamp).when(only_new, F.coalesce(newc, stamp)).otherwise(F.col(f"o_{c}"))
        elif c in update_cols:
            v = F.when(F.col("_n").isNotNull(), newc).otherwise(F.col(f"o_{c}"))
        else:
            v = F.when(only_new, newc).otherwise(F.col(f"o_{c}"))
        out.append(v.cast(target.schema[c].dataType).alias(c))
    return j.select(*out)


# Columns an upsert may overwrite on a key conflict (fixed per entity).
UPSERT_COLUMNS = {
    "ledger": ("sequence", ["successful_transaction_count", "failed_transaction_count",
                            "operation_count", "tx_set_operation_count"]),
    "transaction": ("hash", ["successful"]),
    "operation": ("id", ["transaction_successful", "details"]),
}


def upsert_entity(spark: SparkSession, path: str, batch: DataFrame, entity: str,
                  partition_by: list[str] | None = None, ts=None) -> None:
    """S4 with the entity's key and its fixed set of updatable columns."""
    key, cols = UPSERT_COLUMNS[entity]
    upsert_table(spark, path, batch, key, cols, partition_by=partition_by, ts=ts)


# S5 -------------------------------------------------------------------------
def insert_ignore(target: DataFrame, batch: DataFrame, key) -> DataFrame:
    """Rows of ``batch`` to append: one per key, none already in the target."""
    keys = _keys(key)
    return dedupe_batch(batch, keys).join(target.select(*keys), keys, "left_anti")


# Table IO ---------------------------------------------------------------------
def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    if not _exists(spark, path):
        return None if schema is None else spark.createDataFrame([], schema)
    return spark.read.parquet(path)


def write_merged(spark: SparkSession, path: str, merged: DataFrame,
                 partition_by: list[str] | None = None) -> None:
    """Replace the table's touched partitions by ``merged``.

    ``merged`` (already restricted to the touched partitions) is first
    written to a staging folder, then put in with dynamic partition overwrite;
    unpartitioned tables are rewritten whole. A run that stops in between is
    finished by the next one (:mod:`ledgerlake.sources.replace`)."""
    staged = replace.staging(path)
    w = merged.write
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(staged)
    replace.overwrite(spark, path, staged, partition_by)


def upsert_table(spark: SparkSession, path: str, batch: DataFrame, key, update_cols: list[str],
                 partition_by: list[str] | None = None, ts=None, order: str | None = None,
                 moving_keys: bool = False) -> None:
    """S4 end to end: merge the batch into the touched partitions only.
    An empty batch is a no-op. A record normally keeps its time and so its
    day; with ``moving_keys`` the partitions that hold the batch's keys now
    are looked up (a scan of the key columns) and merged too, so that a key
    which comes with another partition value updates its row where it is."""
    if not batch.take(1):
        return
    replace.recover(spark, path)
    target = read_table(spark, path)
    if target is None:
        first = dedupe_batch(batch, key, order)
        w = first.write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(path)
        return
    scope = target
    if partition_by:
        parts = batch.select(*partition_by).distinct()
        if moving_keys:
            held = target.select(*dict.fromkeys([*_keys(key), *partition_by])).join(
                batch.select(*_keys(key)).distinct(), _keys(key), "left_semi")
            parts = parts.unionByName(held.select(*partition_by)).distinct()
        scope = target.join(parts, partition_by, "left_semi")
    merged = merge_upsert(scope, batch.select(*[c for c in batch.columns]), key, update_cols, ts, order)
    write_merged(spark, path, merged, partition_by)


def key_range_cut(target: DataFrame, batch: DataFrame, key) -> DataFrame:
    """Target rows whose key columns lie within the batch's min/max of each
    key column. A duplicate must have identical key values, so nothing
    outside these literal bounds can match; the bounds reach the scan and
    skip row groups / partitions, so a growing table is not rescanned."""
    keys = _keys(key)
    b = batch.agg(*[F.min(k).alias(f"lo{i}") for i, k in enumerate(keys)],
                  *[F.max(k).alias(f"hi{i}") for i, k in enumerate(keys)]).first()
    out = target
    for i, k in enumerate(keys):
        if b[f"lo{i}"] is None:
            return target.limit(0)
        lo, hi = b[f"lo{i}"], b[f"hi{i}"]
        if isinstance(target.schema[k].dataType, TimestampNTZType):
            lo, hi = ntz_lit(lo), ntz_lit(hi)     # not through the session's time zone
        out = out.where(F.col(k).between(lo, hi))
    return out


def insert_ignore_table(spark: SparkSession, path: str, batch: DataFrame, key,
                        partition_by: list[str] | None = None, key_index: bool = False) -> int:
    """S5 end to end: append only unseen keys; returns rows appended. An empty
    batch writes nothing.

    Of the target only the slice within the batch's key ranges is read, which
    suits keys that grow (sequences, times). For hash keys pass ``key_index``:
    the files that may hold a key of the batch are then found in the index
    beside the table (:mod:`ledgerlake.sources.key_index`), and new files are
    added to it after the append."""
    if not batch.take(1):
        return 0
    replace.recover(spark, path)
    target = read_table(spark, path)
    if target is None:
        rows = dedupe_batch(batch, key)
    elif key_index:
        seen = keyed.stored(spark, path, keyed.candidate_files(spark, path, batch, _keys(key), _exists), _keys(key))
        rows = dedupe_batch(batch, key) if seen is None else insert_ignore(seen, batch, key)
    else:
        rows = insert_ignore(key_range_cut(target, batch, key), batch, key)
    obs = Observation("insert_ignore")
    rows = rows.observe(obs, F.count(F.lit(1)).alias("n"))
    w = rows.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    if key_index:
        known = keyed.known_files(spark, path, _exists)
        keyed.add_files(spark, path, [f for f in spark.read.parquet(path).inputFiles()
                                     if keyed.file_name(f) not in known], _keys(key))
    return int(obs.get["n"])


def write_fact_table(df: DataFrame, path: str, ts: str, mode: str = "append",
                     sort_within: str | None = None, extra_partition: str | None = None) -> None:
    """Curated fact layout: partitioned by ``day = date(ts)`` (UTC), rows
    sorted inside each file by ``sort_within`` (e.g. source account) so
    Parquet row-group statistics skip most groups for point predicates.
    Day filters prune whole partitions (:func:`filters.in_time_range`).

    Rows are range-partitioned on (day, sort key): sampled bounds split a
    day holding a large share of the rows across many writer tasks instead
    of one. Without a sort key a rebalance hint lets AQE split hot days.
    ``extra_partition`` adds a second level (operations by ``type``: the
    payment-only subset then reads only its own folders)."""
    out = df.withColumn("day", F.col(ts).cast("date"))
    parts = ["day"] + ([extra_partition] if extra_partition else [])
    if sort_within:
        out = out.repartitionByRange(*parts, sort_within).sortWithinPartitions(*parts, sort_within, ts)
    else:
        out = out.hint("rebalance", *parts)
    w = out.write.mode(mode).partitionBy(*parts)
    if mode == "overwrite":
        w = w.option("partitionOverwriteMode", "dynamic")
    w.parquet(path)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """Save a catalog table bucketed and sorted by ``key``. Two tables
    bucketed the same way on their join keys (transactions by ``hash``,
    operations by ``transaction_hash``) join and group without any shuffle,
    which pays off when J1/J2 run repeatedly over the same history."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


# S6 -------------------------------------------------------------------------
MARKER = batches.MARKER


def write_batch(spark: SparkSession, root: str, frames: dict[str, DataFrame], batch_id: int,
                marker_rows: DataFrame | None = None) -> None:
    """All-or-nothing unit of work: each frame goes to ``root/<name>``
    partition ``batch_id=<id>`` (overwritten on replay), then the commit
    marker row(s) are appended to ``root/_processed`` last. A batch that is
    already compacted is left as it is."""
    if batches.is_compacted(spark, root, batch_id):
        return
    for name, df in frames.items():
        (df.withColumn("batch_id", F.lit(batch_id).cast("long"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(os.path.join(root, name)))
    marker = marker_rows if marker_rows is not None else spark.range(1).select(
        F.lit(batch_id).cast("long").alias("batch_id"))
    marker = marker.withColumn("batch_id", F.lit(batch_id).cast("long")).withColumn(
        "committed_at", F.localtimestamp())
    insert_ignore_table(spark, os.path.join(root, MARKER), marker, "batch_id")


def read_committed(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Rows of committed batches only: compacted runs, and fresh batches
    semi-joined with their markers."""
    rows = batches.read(spark, root, name)
    return spark.read.parquet(os.path.join(root, name)) if rows is None else rows    # raises: no such table


def try_read_committed(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """Committed rows, or ``None`` while the table holds no data files yet
    (e.g. every record of the first batches was quarantined)."""
    return batches.read(spark, root, name)


# S7 -------------------------------------------------------------------------
def append_snapshot(spark: SparkSession, path: str, metrics: DataFrame,
                    key=("entity_id", "timestamp")) -> int:
    """Append metric snapshots idempotently on (entity, timestamp)."""
    return insert_ignore_table(spark, path, metrics, list(key))


# S8 / S9 --------------------------------------------------------------------
def export_csv(df: DataFrame, path: str, cols: list[str] | None = None) -> None:
    """Header plus selected columns, standard CSV quoting (quote when needed,
    quotes escaped by doubling)."""
    out = df.select(*(cols or df.columns))
    (out.write.mode("overwrite").option("header", True).option("quote", '"')
     .option("escape", '"').csv(path))


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


# S10 ------------------------------------------------------------------------
def with_batch_metrics(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Attach an observation counting rows as they are written."""
    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("rows")), obs


def batch_metrics(observations: dict[str, Observation], duration_ms: float | None = None,
                  chunk: int = S.WRITE_CHUNK_ROWS) -> list[dict]:
    """Per entity: rows written, ``ceil(rows / 100)`` insert chunks, duration."""
    out = []
    for name, obs in observations.items():
        n = int(obs.get["rows"])
        out.append({"entity": name, "rows": n, "chunks": -(-n // chunk), "duration_ms": duration_ms})
    return out


def batch_metrics_frame(spark: SparkSession, observations: dict[str, Observation],
                        duration_ms: float | None = None) -> DataFrame:
    """:func:`batch_metrics` as rows, one for each entity of the batch."""
    rows = [(m["entity"], m["rows"], m["chunks"], m["duration_ms"]) for m in batch_metrics(observations, duration_ms)]
    return spark.createDataFrame(rows, "entity string, rows long, chunks long, duration_ms double")


def chunk_count(c: Column, chunk: int = S.WRITE_CHUNK_ROWS) -> Column:
    return F.ceil(c / F.lit(chunk))

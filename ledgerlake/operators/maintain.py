"""Maintenance jobs (M1-M9): backfill planning and accounting, progress,
retention split, soft delete and change stamps. Each job is one
distributed plan over ``spark.range`` and the tables — no worker pool,
no per-ledger loop on the driver."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake import schemas as S
from ledgerlake.operators.common import as_of_column, minus
from ledgerlake.operators.joins import unprocessed


def _check(start: int, end: int) -> None:
    if start > end:
        raise ValueError(f"startSequence ({start}) must not be greater than endSequence ({end})")


# M1 -------------------------------------------------------------------------
def plan_backfill(spark: SparkSession, start: int, end: int, batch: int = 1000) -> DataFrame:
    """Every sequence of ``[start, end]`` with its batch number."""
    _check(start, end)
    return spark.range(start, end + 1).select(
        F.col("id").alias("sequence"),
        F.floor((F.col("id") - F.lit(start)) / F.lit(batch)).cast("long").alias("batch"))


def live_backfill_range(last_processed: int, latest: int, margin: int = 10):
    """Default live catch-up range: last + 1 … latest − margin."""
    return last_processed + 1, latest - margin


# M2 -------------------------------------------------------------------------
def run_backfill(raw_ledgers: DataFrame, processed: DataFrame, start: int, end: int,
                 batch: int = 1000) -> DataFrame:
    """Status per planned sequence: ``skipped`` when already processed,
    ``processed`` when a valid raw ledger exists, else ``failed`` with the
    reason. One plan: anti/semi joins against the progress log and a left
    join to the landed records."""
    from ledgerlake.operators.quality import validate
    spark = raw_ledgers.sparkSession
    plan = plan_backfill(spark, start, end, batch)
    done = processed.select("sequence").distinct()
    todo = unprocessed(plan, done)
    skipped = plan.join(done, "sequence", "left_semi").select(
        "sequence", "batch", F.lit("skipped").alias("status"), F.lit(None).cast("string").alias("error"))
    checked = validate(raw_ledgers.where(F.col("sequence").between(start, end)), "ledger")
    per_seq = checked.groupBy("sequence").agg(F.min(F.size("errors")).alias("nerr"),
                                              F.min(F.array_join("errors", "; ")).alias("err"))
    tried = todo.join(per_seq, "sequence", "left").select(
        "sequence", "batch",
        F.when(F.col("nerr") == 0, F.lit("processed")).otherwise(F.lit("failed")).alias("status"),
        F.when(F.col("nerr").isNull(), F.lit("ledger not found"))
        .when(F.col("nerr") > 0, F.col("err")).alias("error"))
    return tried.unionByName(skipped)


def load_backfill(spark: SparkSession, raw_ledgers: DataFrame, raw_tx: DataFrame, raw_ops: DataFrame,
                  root: str, start: int, end: int, batch: int = 1000) -> DataFrame:
    """M2 with its writes: the landed records of every processed sequence are
    curated (P1-P4), added to the tables ledger, transaction, operation and
    payment under ``root`` (S5, so a rerun adds nothing), the records that fail
    validation to the quarantine tables of T1, and last the progress log is
    marked. Operations of a transaction without a valid copy are quarantined
    with it; equal records with equal errors are one quarantine row. Returns the status frame, kept under
    ``root/backfill_runs``."""
    from ledgerlake.operators import project as P
    from ledgerlake.operators.quality import split_valid
    from ledgerlake.sources import sinks
    from ledgerlake.streaming.jobs import curate, idempotent_marks
    log = f"{root}/processed_ledgers"
    processed = sinks.read_table(spark, log, "sequence long")
    run = f"{root}/backfill_runs/{uuid.uuid4().hex}"
    run_backfill(raw_ledgers, processed, start, end, batch).write.parquet(run)
    status = spark.read.parquet(run)
    todo = status.where("status = 'processed'").select("sequence")
    ledgers, bad_ledgers = split_valid(raw_ledgers.join(todo, "sequence", "left_semi"), "ledger")
    landed = raw_tx.join(todo.withColumnRenamed("sequence", "ledger"), "ledger", "left_semi").select(*raw_tx.columns)
    txs, bad_txs = split_valid(landed, "transaction")
    mine = txs.select(F.col("hash").alias("transaction_hash"))
    refused = landed.select(F.col("hash").alias("transaction_hash")).join(mine, "transaction_hash", "left_anti")
    ops, bad_ops = split_valid(raw_ops.join(mine, "transaction_hash", "left_semi").select(*raw_ops.columns), "operation")
    orphans = raw_ops.join(refused, "transaction_hash", "left_semi").select(
        F.monotonically_increasing_id().alias("position"), F.lit("transaction: rejected").alias("error"),
        F.to_json(F.struct(*[F.col(f"`{c}`") for c in raw_ops.columns])).alias("raw"))
    bad = ("raw", "error")
    for name, frame, key in (("ledger", curate("ledger", ledgers), "sequence"),
                             ("transaction", curate("transaction", txs), "hash"),
                             ("operation", curate("operation", ops), "id"),
                             ("payment", P.normalize_payments(ops), "id"),
                             ("ledger_invalid", bad_ledgers.drop("errors"), bad),
                             ("transaction_invalid", bad_txs.drop("errors"), bad),
                             ("operation_invalid", bad_ops.drop("errors").unionByName(orphans), bad),
                             ("processed_ledgers", idempotent_marks(ledgers, processed), "sequence")):
        sinks.insert_ignore_table(spark, f"{root}/{name}", frame, key)
    return status


# M3 -------------------------------------------------------------------------
def last_processed(processed: DataFrame, led: DataFrame, latest: int | None = None) -> DataFrame:
    """max(progress log) else max(ledgers) else ``latest − 1``."""
    p = processed.select(F.max("sequence")).scalar()
    ll = led.select(F.max("sequence")).scalar()
    fallback = F.lit(None).cast("long") if latest is None else F.lit(latest - 1).cast("long")
    return led.sparkSession.range(1).select(F.coalesce(p, ll, fallback).alias("last_processed"))


# M4 -------------------------------------------------------------------------
def backfill_progress(status: DataFrame, elapsed_seconds: float | None = None) -> DataFrame:
    """Totals, percent = round(100·done/total), eta = round(remaining /
    rate) (null when the rate is 0 or unknown), done flag."""
    agg = status.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "processed").alias("processed"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status").isin("processed", "skipped", "failed")).alias("done_n"))
    from ledgerlake.functions.scalar import ratio_half_up
    percent = F.coalesce(ratio_half_up(F.col("done_n"), F.col("total"), 0, pct=True), F.lit(0.0))
    if elapsed_seconds:
        rate = F.col("done_n").cast("double") / F.lit(float(elapsed_seconds))
        eta = F.when(rate > 0, F.round((F.col("total") - F.col("done_n")) / rate).cast("long"))
    else:
        eta = F.lit(None).cast("long")
    return agg.select("total", "processed", "skipped", "failed", percent.cast("long").alias("percent"),
                      eta.alias("eta_seconds"), (F.col("done_n") >= F.col("total")).alias("done"))


# M5 -------------------------------------------------------------------------
def backfill_result(status: DataFrame) -> DataFrame:
    """Counts and the resume point: the lowest failed sequence (resuming
    there never skips a failure)."""
    return status.agg(
        F.count_if(F.col("status") == "processed").alias("processed"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.min(F.when(F.col("status") == "failed", F.col("sequence"))).alias("resume_from"))


def sequence_gaps(led: DataFrame, start: int, end: int) -> DataFrame:
    """Sequences of ``[start, end]`` with no ledger (anti join on a range)."""
    _check(start, end)
    return unprocessed(led.sparkSession.range(start, end + 1).withColumnRenamed("id", "sequence"),
                       led.select("sequence"))


# M6 -------------------------------------------------------------------------
def retention_split(df: DataFrame, ts: str, days: int, as_of=None):
    """``(kept, expired)`` for ``ts < as_of − days``. Every row lands in
    exactly one side (null timestamps are kept)."""
    t = as_of_column(df, ts, as_of)
    expired = F.col(ts) < minus(t, days * 86400)
    return df.where(~F.coalesce(expired, F.lit(False))), df.where(F.coalesce(expired, F.lit(False)))


def apply_retention(spark: SparkSession, table_path: str, archive_path: str, ts: str, days: int,
                    key, as_of=None, partition_col: str | None = None) -> dict:
    """Archive, verify, then drop expired rows of a stored table.

    1. rows with ``ts < as_of − days`` are appended to the archive, keyed
       (insert-ignore), so a rerun after a crash never duplicates them;
    2. the archive must then hold every expired key — otherwise nothing is
       dropped and an error is raised;
    3. the kept rows are staged and put in the table's place
       (:mod:`ledgerlake.sources.replace`: a run that stops between any two
       steps is finished or taken back by the next).

    Nothing expired changes nothing, also before there is an archive. The
    staging folder is removed.

    Every row is archived (no cap), and the live table loses only rows that
    the archive verifiably holds. For a table partitioned by day
    (``partition_col``), whole expired days are dropped as folders and only
    the boundary day is rewritten (dynamic partition overwrite), so the
    layout is kept and untouched days are never rewritten. Returns the
    counts."""
    from ledgerlake.sources import replace, sinks
    replace.recover(spark, table_path)
    live = spark.read.parquet(table_path)
    t = as_of_column(live, ts, as_of)
    kept, expired = retention_split(live, ts, days, t)
    scratch = f"{table_path.rstrip('/')}_staging/{uuid.uuid4().hex}"
    try:
        # written once: archived, verified and counted from the copy
        expired.write.parquet(f"{scratch}/expired")
        expired = spark.read.schema(live.schema).parquet(f"{scratch}/expired")
        expired_n = expired.count()
        if not expired_n:
            return {"archived": 0, "expired": 0, "kept": live.count()}
        keys = [key] if isinstance(key, str) else list(key)
        appended = sinks.insert_ignore_table(spark, archive_path, expired, keys)
        archive = spark.read.parquet(archive_path)
        missing = expired.select(*keys).join(archive.select(*keys), keys, "left_anti").count()
        if missing:
            raise RuntimeError(f"{missing} expired rows are not in the archive; live table left untouched")
        if partition_col is None:
            staged = replace.staging(table_path)
            kept.write.parquet(staged)
            replace.swap(spark, table_path, staged)
        else:
            # days holding expired rows are either wholly expired (dropped) or
            # the boundary day (rewritten with its kept rows)
            touched = expired.select(partition_col).distinct()
            boundary = kept.join(touched, partition_col, "left_semi")
            folder = replace.staging(table_path)
            boundary.write.partitionBy(partition_col).parquet(folder)
            staged = spark.read.schema(live.schema).parquet(folder)
            # one entry for each expired day
            drop_days = [f"{partition_col}={r[0]}" for r in touched.join(
                staged.select(partition_col).distinct(), partition_col, "left_anti").collect()]
            replace.overwrite(spark, table_path, folder, [partition_col], drop_days, empty=not staged.take(1))
        spark.catalog.refreshByPath(table_path)
        return {"archived": appended, "expired": expired_n, "kept": spark.read.parquet(table_path).count()}
    finally:
        replace.delete(spark, scratch)


def retention_policy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(S.RETENTION_DAYS.items()), "table_name string, retention_days int")


# M7 -------------------------------------------------------------------------
def retention_report(tables: dict[str, tuple[DataFrame, str]],
                     archives: dict[str, DataFrame] | None = None) -> DataFrame:
    """Policy × per-table count/oldest × archived row count."""
    from ledgerlake.operators.aggregates import retention_status
    spark = next(iter(tables.values()))[0].sparkSession
    status = retention_status(tables)
    out = retention_policy(spark).join(status, "table_name", "inner")
    if archives:
        counts = [a.agg(F.count(F.lit(1)).alias("archived_rows"))
                  .select(F.lit(n).alias("table_name"), "archived_rows") for n, a in archives.items()]
        arch = counts[0]
        for c in counts[1:]:
            arch = arch.unionByName(c)
        out = out.join(arch, "table_name", "left")
    return out


# M8 / M9 --------------------------------------------------------------------
def soft_delete(df: DataFrame, key: str, keys: DataFrame, ts) -> DataFrame:
    """Set ``deleted_at`` (first deletion wins) and ``updated_at`` on rows
    whose key is in ``keys``; other rows unchanged."""
    marked = keys.select(F.col(key).alias("_k"), F.lit(True).alias("_hit")).distinct()
    j = df.join(marked, df[key] == marked["_k"], "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    from ledgerlake.operators.common import ntz_lit
    stamp = ntz_lit(ts)
    cur = F.col("deleted_at") if "deleted_at" in df.columns else F.lit(None).cast("timestamp_ntz")
    out = j.withColumn("deleted_at", F.when(hit, F.coalesce(cur, stamp)).otherwise(cur))
    return touch_updated(out, hit, ts).drop("_k", "_hit")


def touch_updated(df: DataFrame, changed, ts) -> DataFrame:
    """``updated_at = ts`` on changed rows (the trigger's job)."""
    cur = F.col("updated_at") if "updated_at" in df.columns else F.lit(None).cast("timestamp_ntz")
    from ledgerlake.operators.common import ntz_lit
    return df.withColumn("updated_at", F.when(changed, ntz_lit(ts)).otherwise(cur))

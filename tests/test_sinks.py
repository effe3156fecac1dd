"""Upsert, insert-ignore and committed batches over Parquet."""

import datetime as dt
import os

from pyspark.sql import functions as F

from ledgerlake.sources import sinks


def test_upsert_twice_equals_once(spark, tmp):
    path = os.path.join(tmp, "ledgers")
    base = spark.createDataFrame(
        [(1, "h1", 1, 0, dt.date(2024, 1, 1)), (2, "h2", 2, 0, dt.date(2024, 1, 2))],
        "sequence long, hash string, ok_count long, failed long, day date")
    sinks.upsert_table(spark, path, base, "sequence", ["ok_count", "failed"], partition_by=["day"])
    batch = spark.createDataFrame([(2, "changed", 9, 1, dt.date(2024, 1, 2)),
                                   (3, "h3", 3, 0, dt.date(2024, 1, 3))], base.schema)
    sinks.upsert_table(spark, path, batch, "sequence", ["ok_count", "failed"], partition_by=["day"])
    once = sorted(map(tuple, spark.read.parquet(path).select("sequence", "hash", "ok_count", "failed").collect()))
    sinks.upsert_table(spark, path, batch, "sequence", ["ok_count", "failed"], partition_by=["day"])
    twice = sorted(map(tuple, spark.read.parquet(path).select("sequence", "hash", "ok_count", "failed").collect()))
    assert once == twice == [(1, "h1", 1, 0), (2, "h2", 9, 1), (3, "h3", 3, 0)]


def test_merge_updates_only_listed_columns(spark):
    tgt = spark.createDataFrame([(1, "keep", 5, None)], "id long, name string, n long, updated_at timestamp_ntz")
    new = spark.createDataFrame([(1, "ignored", 7), (2, "new", 1)], "id long, name string, n long")
    out = {r["id"]: r for r in sinks.merge_upsert(tgt, new, "id", ["n"], ts="2024-01-01 00:00:00").collect()}
    assert out[1]["name"] == "keep" and out[1]["n"] == 7 and out[1]["updated_at"] == dt.datetime(2024, 1, 1)
    assert out[2]["name"] == "new"


def test_insert_ignore_idempotent(spark, tmp):
    path = os.path.join(tmp, "snap")
    m = spark.createDataFrame([("a", dt.datetime(2024, 1, 1), 1), ("a", dt.datetime(2024, 1, 1), 1)],
                              "entity_id string, timestamp timestamp_ntz, v long")
    assert sinks.append_snapshot(spark, path, m) == 1
    assert sinks.append_snapshot(spark, path, m) == 0
    assert spark.read.parquet(path).count() == 1


def test_torn_batch_invisible(spark, tmp):
    root = os.path.join(tmp, "root")
    tx = spark.createDataFrame([("t1",), ("t2",)], "id string")
    sinks.write_batch(spark, root, {"transactions": tx}, 1)
    # a batch whose children landed but whose marker did not
    (tx.withColumn("batch_id", F.lit(2).cast("long")).write.mode("append")
     .partitionBy("batch_id").parquet(os.path.join(root, "transactions")))
    assert sinks.read_committed(spark, root, "transactions").count() == 2
    sinks.write_batch(spark, root, {"transactions": tx}, 1)   # replay
    assert sinks.read_committed(spark, root, "transactions").count() == 2


def test_export_csv_quoting(spark, tmp):
    df = spark.createDataFrame([("a,b", 'say "hi"')], "x string, y string")
    out = os.path.join(tmp, "csv")
    sinks.export_csv(df, out)
    lines = [ln for f in sorted(os.listdir(out)) if f.endswith(".csv")
             for ln in open(os.path.join(out, f)).read().splitlines()]
    assert set(lines) == {"x,y", '"a,b","say ""hi"""'}
    back = spark.read.option("header", True).option("escape", '"').csv(out).first()
    assert (back["x"], back["y"]) == ("a,b", 'say "hi"')


def test_upsert_entity_ledger_counts_only(spark, tmp):
    path = os.path.join(tmp, "led")
    cols = ("sequence long, hash string, successful_transaction_count long, failed_transaction_count long, "
            "operation_count long, tx_set_operation_count long")
    sinks.upsert_entity(spark, path, spark.createDataFrame([(1, "h", 1, 0, 2, 2)], cols), "ledger")
    sinks.upsert_entity(spark, path, spark.createDataFrame([(1, "changed", 3, 1, 5, 5)], cols), "ledger")
    r = spark.read.parquet(path).first()
    assert (r["hash"], r["successful_transaction_count"], r["failed_transaction_count"],
            r["operation_count"]) == ("h", 3, 1, 5)


def test_hot_day_is_split_across_writer_tasks(spark, tmp):
    from ledgerlake.sources.sinks import write_fact_table
    day = dt.datetime(2024, 1, 1)
    rows = [(str(i), day + dt.timedelta(seconds=i % 86000), f"acct{i % 997}") for i in range(20000)]
    rows += [("x", dt.datetime(2024, 1, 2), "acct1")]
    df = spark.createDataFrame(rows, "id string, created_at timestamp_ntz, source_account string")
    path = os.path.join(tmp, "hot")
    # AQE would coalesce this small input into one task (size-driven); turn
    # coalescing off to observe the range split itself
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_fact_table(df, path, "created_at", sort_within="source_account")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    files = [f for f in os.listdir(os.path.join(path, "day=2024-01-01")) if f.endswith(".parquet")]
    assert len(files) > 1                      # one hot day, several writer tasks
    assert spark.read.parquet(path).count() == len(rows)


def test_empty_batches_are_noops(spark, tmp):
    path = os.path.join(tmp, "t")
    schema = "k long, v long, day date"
    base = spark.createDataFrame([(1, 1, dt.date(2024, 1, 1))], schema)
    sinks.upsert_table(spark, path, base, "k", ["v"], partition_by=["day"])
    empty = spark.createDataFrame([], schema)
    sinks.upsert_table(spark, path, empty, "k", ["v"], partition_by=["day"])
    assert sinks.insert_ignore_table(spark, os.path.join(tmp, "u"), empty, "k") == 0
    assert spark.read.parquet(path).count() == 1

"""Backfill, progress log, retention and retry fixtures (FIXTURES.md §4-6)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlake import schemas as S
from ledgerlake.operators import maintain as M
from ledgerlake.streaming import jobs as T
from tests.test_quality import VALID_LEDGER, frame


def raw_ledgers(spark, seqs):
    return frame(spark, S.RAW_LEDGER, [{**VALID_LEDGER, "sequence": s, "id": str(s)} for s in seqs])


def processed(spark, seqs):
    return spark.createDataFrame([(s, None, 0, 0) for s in seqs], S.PROCESSED_LEDGERS)


def tally(status):
    r = M.backfill_result(status).first()
    return r["processed"], r["skipped"], r["failed"], r["resume_from"]


def test_backfill_fresh_range(spark):
    st = M.run_backfill(raw_ledgers(spark, range(100, 105)), processed(spark, []), 100, 104, 3)
    p, s, f, _ = tally(st)
    assert p + s == 5 and f == 0


def test_backfill_skips_done(spark):
    st = M.run_backfill(raw_ledgers(spark, range(100, 103)), processed(spark, [101]), 100, 102, 3)
    assert tally(st)[:3] == (2, 1, 0)


def test_backfill_all_fail_resume_point(spark):
    st = M.run_backfill(raw_ledgers(spark, []), processed(spark, []), 100, 102, 3)
    p, s, f, resume = tally(st)
    assert (p, s, f) == (0, 0, 3) and resume == 100


def test_backfill_bad_range(spark):
    with pytest.raises(ValueError, match="startSequence"):
        M.plan_backfill(spark, 200, 100)


def test_backfill_progress(spark):
    st = M.run_backfill(raw_ledgers(spark, range(100, 106)), processed(spark, []), 100, 105, 2)
    pr = M.backfill_progress(st, elapsed_seconds=2.0).first()
    assert pr["total"] == 6 and pr["percent"] > 0 and pr["done"]
    assert M.plan_backfill(spark, 100, 105, 2).agg(F.max("batch")).first()[0] == 2


def test_progress_log_marks(spark):
    done = processed(spark, [1000])
    ledgers = spark.createDataFrame([(1001, 3, 2, 10), (1000, 1, 0, 1)],
                                    "sequence long, successful_transaction_count long, "
                                    "failed_transaction_count long, operation_count long")
    marks = T.idempotent_marks(ledgers, done).collect()
    assert [(m["sequence"], m["tx_count"], m["op_count"]) for m in marks] == [(1001, 5, 10)]
    # replaying the same ledgers after marking is a no-op
    again = T.idempotent_marks(ledgers, done.unionByName(
        spark.createDataFrame([(1001, None, 5, 10)], S.PROCESSED_LEDGERS)))
    assert again.count() == 0


def test_retention_keeps_every_row(spark):
    base = dt.datetime(2024, 6, 1)
    rows = [(i, base - dt.timedelta(days=200, seconds=i)) for i in range(1001)]
    rows += [(5000 + i, base - dt.timedelta(days=i)) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, created_at timestamp_ntz")
    kept, expired = M.retention_split(df, "created_at", 180, as_of=base)
    assert expired.count() == 1001
    assert kept.count() + expired.count() == df.count()
    from ledgerlake.operators.search import archive_union
    assert archive_union(kept, expired, "id").count() == df.count()


def test_ready_for_retry(spark):
    last = dt.datetime(2024, 1, 1, 0, 0, 0)
    dlq = spark.createDataFrame([(1, 4, last, last, "e"), (2, 5, last, last, "e")], S.DEAD_LETTER)
    at = last + dt.timedelta(seconds=16)
    before = at - dt.timedelta(milliseconds=1)
    assert T.ready_for_retry(dlq, before).count() == 0
    assert [r["sequence"] for r in T.ready_for_retry(dlq, at).collect()] == [1]
    assert T.ready_for_retry(dlq, last + dt.timedelta(days=1)).select("sequence").collect()[0][0] == 1


def test_dead_letters(spark):
    t0 = dt.datetime(2024, 1, 1)
    fails = spark.createDataFrame([(7, t0, "a"), (7, t0 + dt.timedelta(seconds=5), "b"),
                                   (8, t0, "c")], S.FAILURE_LOG)
    ok = spark.createDataFrame([(8, t0 + dt.timedelta(seconds=1))], "sequence long, succeeded_at timestamp_ntz")
    rows = T.dead_letters(fails, ok).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["sequence"], r["attempt_count"], r["last_error"]) == (7, 2, "b")
    assert r["first_failed_at"] == t0


def test_apply_retention_archives_everything(spark, tmp):
    import os
    base = dt.datetime(2024, 6, 1)
    rows = [(i, base - dt.timedelta(days=120, seconds=i)) for i in range(1001)]
    rows += [(5000 + i, base - dt.timedelta(days=i)) for i in range(10)]
    table, archive = os.path.join(tmp, "payments"), os.path.join(tmp, "payments_archive")
    spark.createDataFrame(rows, "id long, created_at timestamp_ntz").write.parquet(table)
    out = M.apply_retention(spark, table, archive, "created_at", S.RETENTION_DAYS["payments"], "id", base)
    assert out == {"archived": 1001, "expired": 1001, "kept": 10}
    assert spark.read.parquet(table).count() == 10
    assert spark.read.parquet(archive).count() == 1001
    # rerun: nothing left to expire, nothing duplicated in the archive
    again = M.apply_retention(spark, table, archive, "created_at", 90, "id", base)
    assert again["archived"] == 0 and spark.read.parquet(archive).count() == 1001


def test_progress_log_lookup_fixtures(spark):
    from ledgerlake.operators.joins import processed_only, unprocessed
    done = processed(spark, [1000])
    cands = spark.createDataFrame([(1000,), (9999,)], "sequence long")
    assert [r[0] for r in processed_only(cands, done).collect()] == [1000]
    assert [r[0] for r in unprocessed(cands, done).collect()] == [9999]
    assert [r[0] for r in unprocessed(cands, processed(spark, [])).orderBy("sequence").collect()] == [1000, 9999]
    batch = spark.createDataFrame([(500,), (42,)], "sequence long")
    assert [r[0] for r in unprocessed(batch, processed(spark, [500])).collect()] == [42]


def test_apply_retention_keeps_day_partitions(spark, tmp):
    import os
    from ledgerlake.sources.sinks import write_fact_table
    base = dt.datetime(2024, 6, 1, 12, 0)
    rows = [(i, base - dt.timedelta(days=d, hours=h)) for i, (d, h) in
            enumerate([(0, 0), (1, 0), (2, 0), (2, 13), (3, 0), (5, 0), (6, 0)])]
    table, archive = os.path.join(tmp, "tx_days"), os.path.join(tmp, "tx_archive")
    write_fact_table(spark.createDataFrame(rows, "id long, created_at timestamp_ntz"), table, "created_at")
    out = M.apply_retention(spark, table, archive, "created_at", 2, "id", base, partition_col="day")
    live = spark.read.parquet(table)
    # cutoff = 2024-05-30 12:00 (id 2 sits exactly on it and is kept); ids 3-6 expire
    assert sorted(r["id"] for r in live.collect()) == [0, 1, 2]
    assert out == {"archived": 4, "expired": 4, "kept": 3}
    assert "day" in live.columns and spark.read.parquet(archive).count() == 4
    days = sorted(d for d in os.listdir(table) if d.startswith("day="))
    assert days == ["day=2024-05-30", "day=2024-05-31", "day=2024-06-01"]


def test_apply_retention_rewrites_boundary_day(spark, tmp):
    import os
    from ledgerlake.sources.sinks import write_fact_table
    base = dt.datetime(2024, 6, 1, 12, 0)
    rows = [(1, base), (2, base - dt.timedelta(days=2, hours=1)), (3, base - dt.timedelta(days=2) + dt.timedelta(hours=1)),
            (4, base - dt.timedelta(days=9))]
    table, archive = os.path.join(tmp, "b_days"), os.path.join(tmp, "b_archive")
    write_fact_table(spark.createDataFrame(rows, "id long, created_at timestamp_ntz"), table, "created_at")
    out = M.apply_retention(spark, table, archive, "created_at", 2, "id", base, partition_col="day")
    assert sorted(r["id"] for r in spark.read.parquet(table).collect()) == [1, 3]
    assert out == {"archived": 2, "expired": 2, "kept": 2}

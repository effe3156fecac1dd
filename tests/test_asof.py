"""Horizons closed on both sides, lookups of any size, dead letters that
start again after a success."""

from pyspark.sql import functions as F

from ledgerlake.operators import aggregates as A
from ledgerlake.operators import filters as FL
from ledgerlake.operators import joins as J
from ledgerlake.streaming import jobs as T

TX = "source_account string, created_at timestamp_ntz, fee_charged long, successful boolean, ledger_sequence long"


def _tx(spark):
    return spark.sql(f"""SELECT source_account, CAST(at AS TIMESTAMP_NTZ) AS created_at, fee_charged, successful, 1L AS ledger_sequence
        FROM VALUES ('a', '2024-01-01 00:00:00', 10L, true), ('a', '2024-01-20 00:00:00', 90L, false),
                    ('b', '2024-01-20 00:00:00', 90L, false) t(source_account, at, fee_charged, successful)""")


def test_rows_after_as_of_count_nowhere(spark):
    tx, t = _tx(spark), "2024-01-01 12:00:00"
    assert A.active_accounts(tx, t).first()[:] == (1, 1, 1)
    assert A.average_fee(tx, t).first()[0] == 10.0
    assert A.success_rate(tx, t).first()[0] == 100.0
    assert A.daily_transaction_count(tx, 7, t).collect()[0][:] == ("2024-01-01", 1)
    assert FL.preset("last_24h", tx, t).count() == 1
    o = A.network_overview(tx, tx.limit(1), t).first()
    assert (o["active_accounts_24h"], o["total_accounts"]) == (1, 2)


def test_lookup_of_twenty_thousand_keys(spark):
    table = spark.range(50_000).select(F.col("id").cast("string").alias("hash"), "id")
    keys = [str(i * 3) for i in range(20_000)]
    got = J.aligned_lookup(keys, table, "hash").collect()
    assert [r["hash"] for r in got] == keys
    assert sum(r["id"] is None for r in got) == sum(i * 3 >= 50_000 for i in range(20_000))


def test_lookup_does_not_move_the_table(spark, tmp):
    path = f"{tmp}/t"
    spark.range(1000).select(F.col("id").cast("string").alias("hash"), "id").write.parquet(path)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = J.aligned_lookup(["1", "2"], spark.read.parquet(path), "hash")
        plan = df._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    semi = next(x for x in plan.splitlines() if "LeftSemi" in x)
    assert "BroadcastHashJoin" in semi
    assert [r["id"] for r in df.collect()] == [1, 2]


def test_lookup_of_a_frame_with_nulls_and_duplicates(spark):
    table = spark.createDataFrame([("x", 1)], "hash string, v int")
    keys = spark.createDataFrame([(0, None), (1, "x"), (2, "x"), (3, "y")], "pos long, hash string")
    assert [(r["hash"], r["v"]) for r in J.aligned_lookup(keys, table, "hash").collect()] == [
        (None, None), ("x", 1), ("x", 1), ("y", None)]


def test_dead_letter_starts_again_after_a_success(spark):
    fails = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 4, "c"), (2, 1, "d"), (3, 1, "e")],
                                  "sequence long, failed_at long, error string")
    oks = spark.createDataFrame([(1, 3), (3, 2)], "sequence long, succeeded_at long")
    got = {r["sequence"]: r for r in T.dead_letters(fails, oks).collect()}
    assert set(got) == {1, 2}
    assert (got[1]["attempt_count"], got[1]["first_failed_at"], got[1]["last_error"]) == (1, 4, "c")

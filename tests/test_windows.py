"""W1 edge cases and the other window semantics."""

import datetime as dt

from ledgerlake.operators import aggregates as A
from ledgerlake.operators import windows as W

T = dt.datetime(2024, 1, 1, 12, 0, 0)
US = dt.timedelta(microseconds=1)
H = dt.timedelta(hours=1)


def frames(spark, txs, closes):
    tx = spark.createDataFrame(
        [(str(i), c, a, ok, fee) for i, (c, a, ok, fee) in enumerate(txs)],
        "id string, created_at timestamp_ntz, source_account string, successful boolean, fee_charged long")
    op = spark.createDataFrame(
        [(str(i), c, "payment", '{"amount":"1.5"}') for i, (c, *_rest) in enumerate(txs)],
        "id string, created_at timestamp_ntz, type string, details string")
    led = spark.createDataFrame([(i + 1, c) for i, c in enumerate(closes)],
                                "sequence long, closed_at timestamp_ntz")
    return led, tx, op


def test_closed_hour_bounds(spark):
    txs = [(T - H, "a", True, 100), (T, "b", False, 201), (T - H - US, "c", True, 50)]
    led, tx, op = frames(spark, txs, [T])
    r = W.network_metrics(led, tx, op, partitions=3).first()
    assert r["transaction_count"] == 2
    assert r["operation_count"] == 2
    assert r["active_accounts"] == 2
    assert r["total_volume"] == "3.0000000"
    assert r["average_fee"] == 150.5
    assert r["success_rate"] == 50.0
    assert r["ledger_count"] == 1


def test_empty_window_is_zero(spark):
    led, tx, op = frames(spark, [(T - 5 * H, "a", True, 1)], [T])
    r = W.network_metrics(led, tx, op).first()
    assert (r["transaction_count"], r["active_accounts"], r["total_volume"],
            r["average_fee"], r["success_rate"]) == (0, 0, "0.0000000", 0.0, 0.0)


def test_distinct_accounts_against_brute_force(spark):
    import random
    rnd = random.Random(7)
    txs = [(T + dt.timedelta(seconds=rnd.randint(0, 6 * 3600)), f"acct{rnd.randint(0, 9)}",
            rnd.random() < 0.8, rnd.randint(1, 500)) for _ in range(400)]
    closes = sorted({T + dt.timedelta(seconds=rnd.randint(0, 7 * 3600)) for _ in range(60)})
    led, tx, op = frames(spark, txs, closes)
    got = {r["sequence"]: (r["transaction_count"], r["active_accounts"])
           for r in W.network_metrics(led, tx, op, partitions=5).collect()}
    for i, c in enumerate(closes):
        inside = [t for t in txs if c - H <= t[0] <= c]
        assert got[i + 1] == (len(inside), len({t[1] for t in inside}))


def test_success_rate_no_rows(spark):
    tx = spark.createDataFrame([], "created_at timestamp_ntz, successful boolean, fee_charged long, source_account string")
    assert A.success_rate(tx, as_of=T).first()["success_rate_24h"] == 0.0


def test_percentage_change_rule(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(0, 5), (0, 0), (4, 5)], "o long, n long")
    got = [r[0] for r in df.select(W.percentage_change_col(F.col("o"), F.col("n"))).collect()]
    assert got == [100.0, 0.0, 25.0]


def test_ledger_close_times_with_holes(spark):
    led = spark.createDataFrame([(1, T), (2, T + dt.timedelta(seconds=5)), (10, T + dt.timedelta(seconds=50))],
                                "sequence long, closed_at timestamp_ntz")
    got = {r["sequence"]: r["gap_seconds"] for r in W.ledger_close_times(led, bucket=4).collect()}
    assert got == {1: None, 2: 5.0, 10: 45.0}


def test_latest_row_per_key_entity_without_history(spark):
    from ledgerlake.operators.joins import latest_per_entity
    ent = spark.createDataFrame([("a",), ("b",)], "account_id string")
    hist = spark.createDataFrame([("a", T, 1), ("a", T + H, 2)], "account_id string, timestamp timestamp_ntz, v long")
    rows = {r["account_id"]: r["latest_v"] for r in latest_per_entity(ent, hist, "account_id", "timestamp").collect()}
    assert rows == {"a": 2, "b": None}


def test_network_metrics_empty_inputs(spark):
    led, tx, op = frames(spark, [], [T, T + H])
    rows = W.network_metrics(led, tx, op, partitions=7).collect()
    assert len(rows) == 2
    assert all((r["transaction_count"], r["active_accounts"], r["total_volume"], r["success_rate"])
               == (0, 0, "0.0000000", 0.0) for r in rows)
    led0, tx0, op0 = frames(spark, [(T, "a", True, 1)], [])
    assert W.network_metrics(led0, tx0, op0).count() == 0

"""A hot key holding a third of all rows: results stay exact and the
per-key intermediate stays bounded by the time span, not the row count."""

import datetime as dt
import random

from pyspark.sql import functions as F

from ledgerlake.operators import aggregates as A
from ledgerlake.operators import windows as W

T0 = dt.datetime(2024, 1, 1)


def skewed(spark, n=3000, hours=6):
    rnd = random.Random(11)
    rows = []
    for i in range(n):
        acct = "hot" if i % 3 == 0 else f"a{rnd.randint(0, 199)}"
        rows.append((str(i), T0 + dt.timedelta(seconds=rnd.randint(0, hours * 3600)), acct,
                     rnd.random() < 0.9, rnd.randint(1, 1000)))
    return rows, spark.createDataFrame(
        rows, "id string, created_at timestamp_ntz, source_account string, successful boolean, fee_charged long")


def test_islands_bounded_for_hot_account(spark):
    rows, tx = skewed(spark)
    per_hour = (tx.where(F.col("source_account") == "hot")
                .groupBy(F.floor(W.micros("created_at") / F.lit(W.HOUR_US))).count())
    assert per_hour.count() <= 7          # ≤ hours + 1 rows, whatever the hot row count
    marks = W.account_islands(tx.where(F.col("source_account") == "hot"))
    assert marks.count() == 2             # one island: start and end


def test_network_metrics_exact_under_skew(spark):
    rows, tx = skewed(spark)
    op = tx.select("id", "created_at", F.lit("payment").alias("type"),
                   F.lit('{"amount":"2.5"}').alias("details"))
    closes = [T0 + dt.timedelta(minutes=25 * k) for k in range(1, 16)]
    led = spark.createDataFrame([(k + 1, c) for k, c in enumerate(closes)], "sequence long, closed_at timestamp_ntz")
    got = {r["sequence"]: r for r in W.network_metrics(led, tx, op, partitions=6).collect()}
    for k, c in enumerate(closes):
        inside = [r for r in rows if c - dt.timedelta(hours=1) <= r[1] <= c]
        g = got[k + 1]
        assert g["transaction_count"] == len(inside)
        assert g["active_accounts"] == len({r[2] for r in inside})
        assert g["total_volume"] == f"{2.5 * len(inside):.7f}"
        fee = sum(r[4] for r in inside)
        assert g["average_fee"] == (int((fee * 200 + len(inside)) // (2 * len(inside))) / 100 if inside else 0.0)


def test_active_accounts_under_skew(spark):
    rows, tx = skewed(spark)
    as_of = T0 + dt.timedelta(hours=6)
    r = A.active_accounts(tx, as_of).first()
    want = len({x[2] for x in rows if x[1] >= as_of - dt.timedelta(hours=24)})
    assert r["active_accounts_24h"] == want


def test_recent_distinct_hot_user(spark):
    rows, tx = skewed(spark)
    out = W.recent_distinct(tx, "source_account", "id", "created_at", 5)
    assert out.where(F.col("source_account") == "hot").count() == 5

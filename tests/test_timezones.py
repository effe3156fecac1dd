"""Ledger times are UTC wall clocks in timestamp_ntz; results must not
depend on the session time zone (DST gaps included)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators.common import from_micros, micros, ntz_lit
from ledgerlake.operators.project import parse_time


@pytest.fixture()
def los_angeles(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    yield spark
    spark.conf.set("spark.sql.session.timeZone", old)


def test_micros_and_parse_are_zone_free(los_angeles):
    spark = los_angeles
    df = spark.createDataFrame([("2024-03-10T02:30:07.179575Z",), ("1969-12-31T23:59:59.5Z",)], "s string")
    rows = df.select(parse_time("s").alias("t")).select(
        "t", micros("t").alias("us"), from_micros(micros("t")).alias("back")).collect()
    assert rows[0]["t"] == dt.datetime(2024, 3, 10, 2, 30, 7, 179575)
    assert rows[0]["us"] == 1710037807179575
    assert rows[1]["us"] == -500000
    assert all(r["back"] == r["t"] for r in rows)


def test_literals_are_zone_free(los_angeles):
    r = los_angeles.range(1).select(ntz_lit(dt.datetime(2024, 3, 10, 2, 30)).alias("a"),
                                    ntz_lit("2024-03-10T02:30:00Z").alias("b")).first()
    assert r["a"] == r["b"] == dt.datetime(2024, 3, 10, 2, 30)


def test_network_metrics_same_under_any_zone(spark, los_angeles):
    from ledgerlake.operators.windows import network_metrics
    t0 = dt.datetime(2024, 3, 10, 1, 0)          # spans the US DST jump
    tx = spark.createDataFrame([(str(i), t0 + dt.timedelta(minutes=9 * i), f"a{i % 3}", True, 10)
                                for i in range(30)],
                               "id string, created_at timestamp_ntz, source_account string, successful boolean, fee_charged long")
    op = tx.select("id", "created_at", F.lit("payment").alias("type"), F.lit('{"amount":"1"}').alias("details"))
    led = spark.createDataFrame([(i, t0 + dt.timedelta(hours=i)) for i in range(1, 5)],
                                "sequence long, closed_at timestamp_ntz")
    got = {r["sequence"]: (r["transaction_count"], r["active_accounts"])
           for r in network_metrics(led, tx, op).collect()}
    for s in range(1, 5):
        c = t0 + dt.timedelta(hours=s)
        inside = [i for i in range(30) if c - dt.timedelta(hours=1) <= t0 + dt.timedelta(minutes=9 * i) <= c]
        assert got[s] == (len(inside), len({i % 3 for i in inside}))


def test_decimal_text_plain_in_any_ansi_mode(spark):
    from ledgerlake.operators.common import amount_text
    old = spark.conf.get("spark.sql.ansi.enabled")
    try:
        for mode in ("false", "true"):
            spark.conf.set("spark.sql.ansi.enabled", mode)
            df = spark.createDataFrame([("0",), ("0.0000001",), ("-0.25",), ("12.5",)], "v string")
            got = [r[0] for r in df.select(amount_text(F.col("v").cast("decimal(38,7)"))).collect()]
            assert got == ["0.0000000", "0.0000001", "-0.2500000", "12.5000000"], (mode, got)
    finally:
        spark.conf.set("spark.sql.ansi.enabled", old)

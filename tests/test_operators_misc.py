"""Edge cases of smaller operators and column transforms."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlake.functions import scalar as E
from ledgerlake.operators import aggregates as A
from ledgerlake.operators import filters as FL
from ledgerlake.operators import paging as L
from ledgerlake.operators import search as U
from ledgerlake.sources import raw as SRC

T0 = dt.datetime(2024, 1, 1)


def test_pipeline_health_statuses(spark):
    rows = [("ok", T0, 100, 95, True), ("lagging", T0, 100, 50, True),
            ("flaky", T0, 10, 10, False), ("flaky", T0, 10, 10, True),
            ("stale", T0 - dt.timedelta(hours=1), 5, 5, True)]
    df = spark.createDataFrame(rows, "pipeline string, cycle_at timestamp_ntz, source_sequence long, "
                                     "processed_sequence long, ok boolean")
    got = {r["pipeline"]: (r["status"], r["error_rate"]) for r in A.pipeline_health(df, 300, T0).collect()}
    assert got == {"ok": ("healthy", 0.0), "lagging": ("degraded", 0.0),
                   "flaky": ("degraded", 50.0), "stale": ("error", 0.0)}


def test_histogram_is_cumulative(spark):
    df = spark.createDataFrame([("a", 0.05), ("a", 0.3), ("a", 7.0)], "label string, duration_s double")
    got = {r["le"]: r["bucket_count"] for r in A.duration_histogram(df, [0.1, 0.5, 10]).collect()}
    assert got == {"0.1": 1, "0.5": 2, "10.0": 3, "+Inf": 3}


def test_duration_text_and_truncation(spark):
    df = spark.createDataFrame([(T0, T0 + dt.timedelta(days=2, hours=3, minutes=5)),
                                (T0, T0 + dt.timedelta(hours=1, minutes=2)),
                                (T0, T0 + dt.timedelta(minutes=3, seconds=4)),
                                (T0, T0 + dt.timedelta(seconds=9))], "a timestamp_ntz, b timestamp_ntz")
    got = [r[0] for r in df.select(E.duration_text("a", "b")).collect()]
    assert got == ["2d 3h", "1h 2m", "3m 4s", "9s"]
    ids = spark.createDataFrame([("GABCDEFGHIJKLMNOP",), ("short",)], "s string")
    assert [r[0] for r in ids.select(E.truncate_id("s")).collect()] == ["GABCDE...MNOP", "short"]


def test_identifier_kinds_and_cursors(spark):
    texts = ["G" + "A" * 55, "ab" * 32, " 12345 ", "xy", "x", "   "]
    df = spark.createDataFrame([(t,) for t in texts], "q string")
    assert [r[0] for r in df.select(E.identifier_kind("q")).collect()] == [
        "account", "transaction", "ledger", "partial", None, None]
    assert [U.query_kind(t) for t in texts] == ["account", "transaction", "ledger", "general", "general", None]
    cur = spark.createDataFrame([(42,)], "n long").select(E.encode_cursor("n").alias("c"))
    assert cur.select(E.decode_cursor("c")).first()[0] == 42
    bad = spark.createDataFrame([("!!notbase64",)], "c string")
    assert bad.select(E.decode_cursor("c")).first()[0] is None


def test_asset_key_parse(spark):
    df = spark.createDataFrame([("XLM",), ("USDC:GISSUER",), ("LONGERCODE:GX",), ("broken",)], "k string")
    got = [r[0] for r in df.select(E.parse_asset_key("k")).collect()]
    assert got[0]["asset_type"] == "native"
    assert (got[1]["asset_type"], got[1]["asset_code"]) == ("credit_alphanum4", "USDC")
    assert got[2]["asset_type"] == "credit_alphanum12"
    assert got[3] is None


def test_filter_argument_checks(spark):
    with pytest.raises(ValueError):
        FL.check_asset_filter("native", code="X")
    with pytest.raises(ValueError):
        FL.check_asset_filter("credit_alphanum4", code="X")
    with pytest.raises(ValueError):
        FL.filter_operations(spark.range(1), type="not_a_type")
    with pytest.raises(ValueError):
        FL.preset("no_such_preset", spark.range(1))
    with pytest.raises(ValueError):
        FL.in_time_range(spark.range(1), "id", "2024-02-01", "2024-01-01")
    with pytest.raises(ValueError):
        SRC.read_sequence_range(spark.range(1).withColumnRenamed("id", "sequence"), 200, 100)
    with pytest.raises(ValueError):
        L.check_page_size(101)


def test_max_fee_zero_is_a_real_bound(spark):
    tx = spark.createDataFrame([(1, 0, None), (2, 5, "none"), (3, 0, "text")],
                               "id long, fee_charged long, memo_type string")
    assert [r["id"] for r in FL.filter_transactions(tx, max_fee=0).collect()] == [1, 3]
    assert [r["id"] for r in FL.filter_transactions(tx, has_memo=False).orderBy("id").collect()] == [1, 2]


def test_unknown_sort_field_keeps_input(spark):
    df = spark.createDataFrame([(3,), (1,), (2,)], "sequence long")
    assert L.sort_by(df, "ledger", "nonsense") is df


def test_blank_search_is_empty(spark):
    acct = spark.createDataFrame([("G1", "1")], "account_id string, balance string")
    tx = spark.createDataFrame([("h", True, T0)], "hash string, successful boolean, created_at timestamp_ntz")
    led = spark.createDataFrame([(5, 1, 1)], "sequence long, successful_transaction_count long, operation_count long")
    assert U.global_search(acct, tx, led, "   ").count() == 0
    assert U.global_search(acct, tx, led, "5").count() == 1


def test_counts_by_range(spark):
    df = spark.createDataFrame([(T0 - dt.timedelta(minutes=30),), (T0 - dt.timedelta(hours=5),),
                                (T0 - dt.timedelta(days=3),)], "created_at timestamp_ntz")
    got = {r["range_label"]: r["count"] for r in A.counts_by_range(df, "created_at", as_of=T0).collect()}
    assert got["1h"] == 1 and got["6h"] == 2 and got["24h"] == 2 and got["7d"] == 3


def test_merge_live_connection(spark):
    page = spark.createDataFrame([("b", T0), ("a", T0 - dt.timedelta(seconds=1))], "id string, ts timestamp_ntz")
    new = spark.createDataFrame([("c", T0 + dt.timedelta(seconds=1)), ("b", T0)], "id string, ts timestamp_ntz")
    old_info = spark.createDataFrame([(False,)], "has_next_page boolean")
    new_info = spark.createDataFrame([(True,)], "has_next_page boolean")
    rows, info = U.merge_live_connection(page, old_info, new, new_info, "id", "ts")
    assert [r["id"] for r in rows.orderBy("live_rank").collect()] == ["c", "b", "a"]
    assert info.first()["has_next_page"] is True


def test_stats_summary_on_empty_tables(spark):
    led = spark.createDataFrame([], "sequence long, closed_at timestamp_ntz")
    tx = spark.createDataFrame([], "source_account string, created_at timestamp_ntz, fee_charged long, successful boolean")
    op = spark.createDataFrame([], "type string, created_at timestamp_ntz, details string")
    acct = spark.createDataFrame([], "account_id string")
    r = A.stats_summary(led, tx, op, acct, acct).collect()
    assert len(r) == 1
    r = r[0]
    assert (r["total_ledgers"], r["total_transactions"], r["total_operations"]) == (0, 0, 0)
    assert r["volume_24h"] == "0.0000000" and r["success_rate_24h"] == 0.0 and r["latest_ledger"] is None


def test_operators_on_empty_inputs(spark):
    from ledgerlake.operators import quality as Q
    from ledgerlake.operators import windows as W
    ops = spark.createDataFrame([], "id string, type string, created_at timestamp_ntz, details string")
    pay = spark.createDataFrame([], "asset_id long, amount decimal(28,7), created_at timestamp_ntz")
    tl = spark.createDataFrame([], "account_id string, asset_id long, balance decimal(28,7)")
    assets = spark.createDataFrame([(1,)], "id long")
    led = spark.createDataFrame([], "sequence long, closed_at timestamp_ntz")
    log = spark.createDataFrame([], "id string, logged_at timestamp_ntz, duration_ms decimal(18,2), query_text string")
    raw = spark.createDataFrame([], "id string, type string")
    assert A.operation_distribution(ops).count() == 0
    am = A.build_asset_metrics(pay, tl, assets).first()
    assert (am["volume_24h"], am["trades_30d"], am["holders"]) == ("0.0000000", 0, 0)
    assert W.ledger_close_times(led).count() == 0
    d = A.duration_summary(log).first()
    assert (d["total_queries"], d["total_duration_ms"], d["avg_duration_ms"]) == (0, "0.00", 0.0)
    assert Q.validation_report(raw, "operation").count() == 0
    assert W.rolling_daily(pay, "asset_id", "created_at", "amount").count() == 0
    assert W.percentage_change(pay, "asset_id", "created_at", "amount").count() == 0


def test_every_preset_runs(spark):
    tx = spark.createDataFrame([(True, 2000, "text", T0), (False, 10, None, T0 - dt.timedelta(days=2))],
                               "successful boolean, fee_charged long, memo_type string, created_at timestamp_ntz")
    led = spark.createDataFrame([(60, T0)], "operation_count long, closed_at timestamp_ntz")
    acct = spark.createDataFrame([("20000.5", 2), ("3", 0)], "balance string, num_subentries long")
    metrics = spark.createDataFrame([("a", True), ("b", False)], "account_id string, is_active boolean")
    frames = {"busy_ledgers": led, "high_balance": acct, "low_balance": acct, "multi_sig": acct, "active": metrics}
    counts = {p: FL.preset(p, frames.get(p, tx)).count() for p in FL.PRESETS}
    assert counts == {"successful": 1, "failed": 1, "with_memo": 1, "high_fee": 1, "last_1h": 1,
                      "last_24h": 1, "last_7d": 2, "busy_ledgers": 1, "high_balance": 1,
                      "low_balance": 1, "multi_sig": 1, "active": 1}

"""Property tests (hypothesis): the trailing-hour sweep equals brute force,
pages concatenate to the ordered set, upsert replay is a no-op and
archive ∪ live is the original."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlake.operators import maintain as M
from ledgerlake.operators import paging as L
from ledgerlake.operators import search as U
from ledgerlake.operators import windows as W
from ledgerlake.sources import sinks

T0 = dt.datetime(2024, 1, 1)
SETTINGS = settings(max_examples=8, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])

tx_rows = st.lists(st.tuples(st.integers(0, 5 * 3600), st.integers(0, 4), st.booleans(),
                             st.integers(0, 50)), min_size=0, max_size=40)
close_offsets = st.lists(st.integers(0, 6 * 3600), min_size=1, max_size=6, unique=True)


@SETTINGS
@given(rows=tx_rows, closes=close_offsets, parts=st.integers(1, 5))
def test_sweep_equals_brute_force(spark, rows, closes, parts):
    tx = spark.createDataFrame(
        [(str(i), T0 + dt.timedelta(seconds=s), f"a{a}", ok, fee) for i, (s, a, ok, fee) in enumerate(rows)],
        "id string, created_at timestamp_ntz, source_account string, successful boolean, fee_charged long")
    op = tx.select("id", "created_at", F.lit("payment").alias("type"), F.lit('{"amount":"0.5"}').alias("details"))
    led = spark.createDataFrame([(i + 1, T0 + dt.timedelta(seconds=c)) for i, c in enumerate(closes)],
                                "sequence long, closed_at timestamp_ntz")
    got = {r["sequence"]: (r["transaction_count"], r["active_accounts"], r["total_volume"])
           for r in W.network_metrics(led, tx, op, partitions=parts).collect()}
    for i, c in enumerate(closes):
        inside = [r for r in rows if c - 3600 <= r[0] <= c]
        assert got[i + 1] == (len(inside), len({r[1] for r in inside}), f"{0.5 * len(inside):.7f}")


@SETTINGS
@given(minutes=st.lists(st.integers(0, 10), min_size=1, max_size=30), size=st.integers(1, 7))
def test_pages_concatenate(spark, minutes, size):
    rows = [(f"{i:03d}", T0 + dt.timedelta(minutes=m)) for i, m in enumerate(minutes)]
    df = spark.createDataFrame(rows, "id string, created_at timestamp_ntz")
    seen, cursor = [], None
    for _ in range(len(rows) + 1):
        conn = L.connection(df, "created_at", first=size, after=cursor)
        seen += [r["id"] for r in conn.edges.collect()]
        info = conn.page_info.first()
        if not info["has_next_page"]:
            break
        cursor = (info["end_cursor"]["k"], info["end_cursor"]["id"])
    assert seen == [r[0] for r in sorted(rows, key=lambda r: (r[1], r[0]), reverse=True)]


@SETTINGS
@given(old=st.dictionaries(st.integers(0, 9), st.integers(0, 99), max_size=8),
       new=st.lists(st.tuples(st.integers(0, 12), st.integers(0, 99)), max_size=8))
def test_upsert_replay_is_noop(spark, old, new):
    target = spark.createDataFrame([(k, v, "keep") for k, v in old.items()] or [(0, 0, "x")][:0],
                                   "k long, v long, other string")
    batch = spark.createDataFrame([(k, v, "new") for k, v in new] or [(0, 0, "x")][:0],
                                  "k long, v long, other string")
    once = sinks.merge_upsert(target, batch, "k", ["v"], ts="2024-01-01 00:00:00")
    twice = sinks.merge_upsert(once, batch, "k", ["v"], ts="2024-01-01 00:00:00")
    a = sorted(map(tuple, once.collect()))
    b = sorted(map(tuple, twice.collect()))
    if all(sum(1 for x in new if x[0] == k) <= 1 for k, _ in new):
        assert a == b
    assert len(a) == len(set(old) | {k for k, _ in new})
    kept_other = {r[0]: r[2] for r in a}
    assert all(kept_other[k] == "keep" for k in old)


@SETTINGS
@given(ages=st.lists(st.integers(0, 400), max_size=40), days=st.integers(1, 365))
def test_archive_union_is_original(spark, ages, days):
    now = dt.datetime(2024, 6, 1)
    df = spark.createDataFrame([(i, now - dt.timedelta(days=a)) for i, a in enumerate(ages)] or [(0, now)][:0],
                               "id long, created_at timestamp_ntz")
    kept, expired = M.retention_split(df, "created_at", days, as_of=now)
    assert kept.count() + expired.count() == len(ages)
    assert sorted(map(tuple, U.archive_union(kept, expired, "id").collect())) == sorted(map(tuple, df.collect()))


@SETTINGS
@given(rows=st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(0, 40),
                               st.integers(0, 500)), min_size=1, max_size=40))
def test_rolling_daily_equals_brute_force(spark, rows):
    df = spark.createDataFrame(
        [(k, T0 + dt.timedelta(days=d, hours=3), v) for k, d, v in rows],
        "k string, ts timestamp_ntz, v long")
    got = {(r["k"], r["day"]): (r["trades_7d"], r["volume_30d"]) for r in
           W.rolling_daily(df, "k", "ts", "v").collect()}
    for (k, day), (t7, v30) in got.items():
        d = (dt.date.fromisoformat(day) - T0.date()).days
        assert t7 == sum(1 for kk, dd, _ in rows if kk == k and d - 6 <= dd <= d)
        assert v30 == f"{sum(vv for kk, dd, vv in rows if kk == k and d - 29 <= dd <= d)}.0000000"
    assert set(got) == {(k, (T0.date() + dt.timedelta(days=d)).isoformat()) for k, d, _ in rows}

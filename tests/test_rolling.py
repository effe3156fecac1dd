"""Trailing-hour metrics as keyed state (T8) against W1."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators.windows import network_metrics
from ledgerlake.streaming import rolling as R

T0 = dt.datetime(2024, 1, 1)
TX = "id string, created_at timestamp_ntz, source_account string, successful boolean, fee_charged long"
OP = "id string, created_at timestamp_ntz, type string, details string"


def ledger_data(spark, seed=0, hours=5):
    r = random.Random(seed)

    def when():
        return T0 + dt.timedelta(microseconds=r.randrange(hours * 3_600_000_000))
    # one account has a third of all rows; a few rows share a time to the microsecond
    tx = [(f"t{i}", when(), "hot" if i % 3 == 0 else f"a{r.randrange(40)}", r.random() < 0.8, r.randrange(500))
          for i in range(900)] + [("tie", T0 + dt.timedelta(hours=2), "a1", True, 100)] * 2
    tx += [("none", T0 + dt.timedelta(hours=2), None, True, 5)]
    op = [(f"o{i}", when(), r.choice(["payment", "create_account"]),
           '{"amount":"%d.%07d"}' % (r.randrange(10**9), r.randrange(10**7))) for i in range(700)]
    # closes on the hour meet the tied rows on both edges of their interval
    led = [(i, T0 + dt.timedelta(minutes=7 * i)) for i in range(1, hours * 60 // 7)] + [
        (1000 + h, T0 + dt.timedelta(hours=h)) for h in range(1, hours)]
    return (spark.createDataFrame(led, "sequence long, closed_at timestamp_ntz"),
            spark.createDataFrame(tx, TX), spark.createDataFrame(op, OP))


def land(events, path, spark, slices, jitter_us, drop_order=None):
    """Events in files by time, each row up to ``jitter_us`` late."""
    span = -(-(events.agg(F.max("t") - F.min("t")).first()[0] + jitter_us + 1) // slices)
    first = events.agg(F.min("t")).first()[0]
    late = F.pmod(F.xxhash64("t", "account", "bucket", "n"), F.lit(jitter_us + 1))
    events = events.withColumn("slice", F.floor((F.col("t") - first + late) / span)).cache()
    for k in range(slices):
        events.where(F.col("slice") == k).drop("slice").coalesce(1).write.mode("append").parquet(path)
    events.unpersist()
    return spark.readStream.schema(events.drop("slice").schema).option("maxFilesPerTrigger", 1).parquet(path)


def rows(df):
    return {r["sequence"]: r.asDict() for r in df.collect()}


@pytest.mark.parametrize("jitter_minutes", [0, 20])
def test_equals_the_batch_metrics(spark, tmp, jitter_minutes):
    led, tx, op = ledger_data(spark)
    events = R.hour_events(led, tx, op, buckets=5)
    stream = land(events, os.path.join(tmp, "in"), spark, 4, jitter_minutes * 60_000_000)
    out = os.path.join(tmp, "out")
    R.rolling_network_metrics(spark, stream, out, os.path.join(tmp, "ck"), "30 minutes").awaitTermination()
    # the stream ends 30 minutes behind its newest event; without null accounts W1 counts the same
    newest = events.agg(F.max("t")).first()[0]
    limit = T0 + dt.timedelta(microseconds=newest - 30 * 60_000_000 - 1_704_067_200_000_000)
    want = {s: r for s, r in rows(network_metrics(led, tx, op)).items() if r["timestamp"] <= limit}
    for s, r in want.items():        # W1 takes the null account as one more
        if T0 + dt.timedelta(hours=2) <= r["timestamp"] <= T0 + dt.timedelta(hours=3):
            r["active_accounts"] -= 1
    assert rows(spark.read.parquet(out)) == want and len(want) > 30


def test_restart_goes_on_without_repeating(spark, tmp):
    led, tx, op = ledger_data(spark, 1, 4)
    events = R.hour_events(led, tx.where("source_account is not null"), op, buckets=3)
    path, out, ck = (os.path.join(tmp, x) for x in ("in", "out", "ck"))
    half = 1_704_067_200_000_000 + 2 * 3_600_000_000
    for part in (events.where(F.col("t") < half), events.where(F.col("t") >= half)):
        part.coalesce(2).write.mode("append").parquet(path)
        stream = spark.readStream.schema(events.schema).parquet(path)
        R.rolling_network_metrics(spark, stream, out, ck, "1 minute").awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == got.select("sequence").distinct().count()
    want = rows(network_metrics(led, tx.where("source_account is not null"), op))
    assert all(r == want[s] for s, r in rows(got).items()) and got.count() >= len(want) - 2


def test_state_holds_an_hour_only(spark, tmp):
    led, tx, op = ledger_data(spark, 2, 8)
    events = R.hour_events(led, tx, op, buckets=2)
    stream = land(events, os.path.join(tmp, "in"), spark, 8, 0)
    q = R.rolling_network_metrics(spark, stream, os.path.join(tmp, "out"), os.path.join(tmp, "ck"), "1 minute")
    q.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    # minutes, closes and timers of the last hours: as many late in the stream as early
    assert max(held[5:]) <= 1.2 * max(held[2:5]), held


def test_parts_of_nothing():
    assert R.parts_of([], [], [(1, 10)]) == [(1, 10, 0, 0, 0, 0, "0", 0)]
    assert R.parts_of([(5, "a", 2, 1, 30)], [(6, 1, 10**30)], [(1, 6), (2, 5 + 3_600_000_000), (3, 7 + 3_600_000_000)]) == [
        (1, 6, 2, 1, 30, 1, str(10**30), 1), (2, 5 + 3_600_000_000, 2, 1, 30, 1, str(10**30), 1),
        (3, 7 + 3_600_000_000, 0, 0, 0, 0, "0", 0)]


def test_state_is_accessed_by_blocks_not_by_minutes(spark, tmp):
    """A bucket's state grows with the blocks of its rows: few entries for a
    day with an event in each of its minutes."""
    tx = [(f"t{i}", T0 + dt.timedelta(minutes=i), f"a{i % 9}", True, i) for i in range(1440)]
    op = [(f"o{i}", T0 + dt.timedelta(minutes=i), "payment", '{"amount":"1"}') for i in range(1440)]
    led = [(h, T0 + dt.timedelta(hours=h)) for h in range(1, 24)]
    frames = (spark.createDataFrame(led, "sequence long, closed_at timestamp_ntz"),
              spark.createDataFrame(tx, TX), spark.createDataFrame(op, OP))
    path, out = os.path.join(tmp, "in"), os.path.join(tmp, "out")
    R.hour_events(*frames, buckets=1).write.parquet(path)
    stream = spark.readStream.schema(R.EVENTS).parquet(path)
    q = R.rolling_network_metrics(spark, stream, out, os.path.join(tmp, "ck"), "1 minute", partitions=1)
    q.awaitTermination()
    operators = [p["stateOperators"][0] for p in q.recentProgress if p["stateOperators"]]
    assert max(o["numRowsTotal"] for o in operators) < 20
    assert {o["numShufflePartitions"] for o in operators} == {1}
    want = rows(network_metrics(*frames))
    assert rows(spark.read.parquet(out)) == want and len(want) == 23


class FakeMap(dict):
    """A map state in memory."""

    def updateValue(self, key, value):
        self[key] = value

    def getValue(self, key):
        return self.get(key)

    def removeKey(self, key):
        del self[key]


class FakeHandle:
    def __init__(self):
        self.timers = []

    def getMapState(self, *_):
        return FakeMap()

    def registerTimer(self, ms):
        self.timers.append(ms)


class Now:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def test_many_short_batches_of_wide_spans(monkeypatch):
    """Merged blocks, closes worked off in parts, a close that comes again."""
    import numpy as np
    import pandas as pd
    monkeypatch.setattr(R, "BLOCK_ROWS", 7)
    monkeypatch.setattr(R, "GATHER_ROWS", 20)
    monkeypatch.setattr(R, "MANY_BLOCKS", 6)
    r, state, hour = random.Random(3), R.HourState(), 3_600_000_000
    state.init(FakeHandle())
    tx, op, closes, got, most = [], [], {}, [], 0
    for k in range(30):
        new = []
        for _ in range(12):
            t, account = k * hour + r.randrange(2 * hour), r.choice(["a", "b", "c", None])
            tx.append((t, account, 1, 1, r.randrange(9)))
            new.append(("tx", t, account, 0, 1, 1, tx[-1][4], 0, 0, 0, 0))
            op.append((t + 1, 2, r.randrange(-10**36, 10**37)))
            digits = [op[-1][2] >> s & 0xffffffff for s in (0, 32, 64)] + [op[-1][2] >> 96]
            new.append(("op", t + 1, None, 0, 2, 0, 0, *digits))
        for s in (2 * k, 2 * k + 1, max(0, 2 * k - 1)):     # the ledger before comes once more, with another time
            t = k * hour + r.randrange(hour, 2 * hour)
            if (s not in closes or closes[s] > k * hour) and s not in {g[0] for g in got}:
                closes[s] = t
                new = [e for e in new if e[0] != "close" or e[3] != s]
                new.append(("close", t, None, s, 0, 0, 0, 0, 0, 0, 0))
        r.shuffle(new)
        frame = pd.DataFrame(new, columns=["kind", "t", "account", "sequence", "n", "ok", "fee", *R.DIGITS])
        list(state.handleInputRows((0,), iter([frame[:9], frame[9:]]), Now(0)))
        for part in state.handleExpiredTimer((0,), Now(k * hour // 1000), None):
            got += list(part.itertuples(index=False, name=None))
        most = max(most, len(state.events.keys()))
    due = [(s, t) for s, t in sorted(closes.items(), key=lambda c: c[1]) if t <= 29 * hour]
    assert sorted(got) == sorted(R.parts_of(tx, op, due))
    for s, t, *_, vol, accounts in R.parts_of(tx, op, due):
        assert int(vol) == sum(v for at, _, v in op if t - hour <= at <= t)
        assert accounts == len({a for at, a, *_ in tx if a and t - hour <= at <= t})
    assert most <= 30 and all(np.diff([k[0] for k in state.events.keys()]) >= 0)

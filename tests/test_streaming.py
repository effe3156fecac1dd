"""Streaming jobs on file sources with availableNow triggers."""

import datetime as dt
import json
import os

from pyspark.sql import functions as F

from ledgerlake import schemas as S
from ledgerlake.sources import raw, sinks
from ledgerlake.streaming import jobs as T
from tests.test_quality import VALID_LEDGER, VALID_TX


def land(folder, name, records):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        for r in records:
            f.write(json.dumps(r) + "\n")


def test_ingest_replay_is_noop(spark, tmp):
    src, root, ck = (os.path.join(tmp, x) for x in ("src", "root", "ck"))
    recs = [{**VALID_TX, "id": f"t{i}", "hash": f"{i:064x}"} for i in range(5)]
    recs.append({**VALID_TX, "id": "bad", "hash": "short"})
    land(src, "a.json", recs)
    stream = raw.read_stream(spark, src, "transaction", per_batch=1)
    T.ingest_stream(spark, stream, "transaction", root, ck).awaitTermination()
    assert sinks.read_committed(spark, root, "transaction").count() == 5
    assert sinks.read_committed(spark, root, "transaction_invalid").count() == 1
    # same records land again in a new file: nothing is duplicated
    land(src, "b.json", recs[:3])
    T.ingest_stream(spark, raw.read_stream(spark, src, "transaction", per_batch=1),
                    "transaction", root, ck).awaitTermination()
    assert sinks.read_committed(spark, root, "transaction").count() == 5


def test_live_totals_matches_batch(spark, tmp):
    src = os.path.join(tmp, "led")
    led = spark.createDataFrame(
        [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=5 * i), i % 3, i % 5) for i in range(1, 40)],
        "sequence long, closed_at timestamp_ntz, successful_transaction_count long, operation_count long")
    led.repartition(4).write.parquet(src)
    stream = spark.readStream.schema(led.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = (T.live_totals(stream).writeStream.outputMode("complete").format("memory")
         .queryName("live_totals_t").trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.table("live_totals_t").first()
    want = T.live_totals(led).first()
    assert got.asDict() == want.asDict()


def test_route_channels_and_subscribe(spark):
    tx = spark.createDataFrame([("1", "GA"), ("2", "GB")], "id string, source_account string")
    routed = T.route_channels(tx, "transaction")
    assert routed.count() == 4
    assert routed.where(F.col("channel") == "TRANSACTION_ADDED.GA").count() == 1
    assert T.subscribe(tx, account="GB").count() == 1


def test_dedupe_stream(spark, tmp):
    src = os.path.join(tmp, "dup")
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", t0), ("a", t0), ("b", t0)], "id string, ts timestamp_ntz")
    df.coalesce(1).write.parquet(src)
    df.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = (T.dedupe_stream(stream, "id", "ts").writeStream.format("memory").queryName("dedupe_t")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    assert sorted(r["id"] for r in spark.table("dedupe_t").collect()) == ["a", "b"]


def test_rate_cap_first_event_windows(spark, tmp):
    src = os.path.join(tmp, "rate")
    t0 = dt.datetime(2024, 1, 1)
    secs = [0, 1, 2, 3, 59, 60, 61, 200]
    rows = [("k", str(i), t0 + dt.timedelta(seconds=s)) for i, s in enumerate(secs)]
    rows += [("z", "z0", t0)]
    df = spark.createDataFrame(rows, "key string, id string, ts timestamp_ntz")
    df.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    q = (T.rate_cap(stream, "key", "ts", limit=3, window_seconds=60).writeStream
         .format("memory").queryName("rate_t").outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    flags = {r["id"]: r["rate_limited"] for r in spark.table("rate_t").collect()}
    # window 1 starts at 0 s: events at 0,1,2 pass, 3 and 59 are over the cap;
    # 60 opens window 2 (60,61 pass); 200 opens window 3
    assert [flags[str(i)] for i in range(len(secs))] == [False, False, False, True, True, False, False, False]
    assert flags["z0"] is False


def test_network_metrics_for_batch_matches_batch(spark):
    from ledgerlake.operators.windows import network_metrics
    t0 = dt.datetime(2024, 1, 1)
    tx = spark.createDataFrame([(str(i), t0 + dt.timedelta(minutes=7 * i), f"a{i % 4}", True, 10)
                                for i in range(40)],
                               "id string, created_at timestamp_ntz, source_account string, successful boolean, fee_charged long")
    op = tx.select("id", "created_at", F.lit("payment").alias("type"), F.lit('{"amount":"2"}').alias("details"))
    led = spark.createDataFrame([(i, t0 + dt.timedelta(hours=i)) for i in range(1, 5)],
                                "sequence long, closed_at timestamp_ntz")
    part = led.where(F.col("sequence") >= 3)
    a = {r["sequence"]: r.asDict() for r in T.network_metrics_for_batch(part, tx, op).collect()}
    b = {r["sequence"]: r.asDict() for r in network_metrics(led, tx, op).collect() if r["sequence"] >= 3}
    assert a == b


def test_network_metrics_stream_end_to_end(spark, tmp):
    from ledgerlake.operators.windows import network_metrics
    t0 = dt.datetime(2024, 1, 1)
    tx = spark.createDataFrame([(str(i), t0 + dt.timedelta(minutes=5 * i), f"a{i % 6}", i % 4 != 0, 7)
                                for i in range(60)],
                               "id string, created_at timestamp_ntz, source_account string, successful boolean, fee_charged long")
    op = tx.select("id", "created_at", F.lit("payment").alias("type"), F.lit('{"amount":"3"}').alias("details"))
    tx_path, op_path, led_path = (os.path.join(tmp, x) for x in ("tx", "op", "led"))
    tx.write.parquet(tx_path)
    op.write.parquet(op_path)
    led = spark.createDataFrame([(i, t0 + dt.timedelta(minutes=30 * i)) for i in range(1, 10)],
                                "sequence long, closed_at timestamp_ntz")
    led.repartition(3).write.parquet(led_path)
    stream = spark.readStream.schema(led.schema).option("maxFilesPerTrigger", 1).parquet(led_path)
    out = os.path.join(tmp, "nm")
    T.network_metrics_stream(spark, stream, tx_path, op_path, out,
                             os.path.join(tmp, "ck")).awaitTermination()
    got = {r["sequence"]: r.asDict() for r in spark.read.parquet(out).collect()}
    want = {r["sequence"]: r.asDict() for r in network_metrics(led, tx, op).collect()}
    assert got == want


def test_poll_stream_and_incremental_poll(spark, tmp):
    src = os.path.join(tmp, "poll")
    led = spark.createDataFrame([(i,) for i in range(1, 31)], "sequence long")
    led.repartition(5).write.parquet(src)
    batches = []
    stream = T.poll_stream(spark, src, led.schema, files_per_poll=2)
    q = (stream.writeStream.foreachBatch(lambda b, i: batches.append(b.count()))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    assert sum(batches) == 30 and len(batches) >= 3
    first = [r["sequence"] for r in T.incremental_poll(led, 20, 10).collect()]
    assert first == list(range(21, 31))


def test_ingest_ledgers_then_late_dropped(spark, tmp):
    src, root, ck = (os.path.join(tmp, x) for x in ("lsrc", "lroot", "lck"))
    land(src, "a.json", [{**VALID_LEDGER, "sequence": s, "id": str(s)} for s in (10, 11, 12)])
    T.ingest_stream(spark, raw.read_stream(spark, src, "ledger"), "ledger", root, ck,
                    key="sequence").awaitTermination()
    stored = sinks.read_committed(spark, root, "ledger")
    assert sorted(r["sequence"] for r in stored.collect()) == [10, 11, 12]
    late = spark.createDataFrame([(9,), (12,), (13,)], "sequence long")
    last = stored.select(F.max("sequence")).first()[0]
    assert [r["sequence"] for r in T.drop_late(late, last).collect()] == [13]


def test_ledger_units_committed_together_and_replay_is_noop(spark, tmp):
    from tests.test_quality import VALID_OP
    src, root, ck = (os.path.join(tmp, x) for x in ("usrc", "uroot", "uck"))

    def unit(seq, n_tx):
        txs = [{**VALID_TX, "id": f"{seq}-t{i}", "hash": f"{seq:032x}{i:032x}", "ledger": seq}
               for i in range(n_tx)]
        ops = [{**VALID_OP, "id": f"{seq}-{i}", "transaction_hash": t["hash"]} for i, t in enumerate(txs)]
        ops.append({**VALID_OP, "id": f"{seq}-bad", "to": "BADADDRESS"})
        return {**VALID_LEDGER, "sequence": seq, "id": str(seq), "transactions": txs, "operations": ops}

    land(src, "a.json", [unit(100, 3), unit(101, 2)])
    land(src, "b.json", [{**VALID_LEDGER, "sequence": -5, "id": "x", "transactions": [], "operations": []}])
    stream = raw.read_stream(spark, src, "ledger_unit", per_batch=1)
    T.ingest_ledger_units(spark, stream, root, ck).awaitTermination()

    def n(name):
        return sinks.read_committed(spark, root, name).count()
    assert (n("ledger"), n("transaction"), n("operation"), n("payment")) == (2, 5, 5, 5)
    assert (n("operation_invalid"), n("ledger_invalid"), n("processed_ledgers")) == (2, 1, 2)
    # the same units land again: the progress log makes the replay a no-op
    land(src, "c.json", [unit(100, 3)])
    T.ingest_ledger_units(spark, raw.read_stream(spark, src, "ledger_unit", per_batch=1),
                          root, ck).awaitTermination()
    assert (n("ledger"), n("transaction"), n("processed_ledgers")) == (2, 5, 2)


def test_first_batch_all_invalid_then_valid(spark, tmp):
    src, root, ck = (os.path.join(tmp, x) for x in ("isrc", "iroot", "ick"))
    land(src, "a.json", [{**VALID_LEDGER, "sequence": -1, "id": "x", "transactions": [], "operations": []}])
    T.ingest_ledger_units(spark, raw.read_stream(spark, src, "ledger_unit", per_batch=1),
                          root, ck).awaitTermination()
    land(src, "b.json", [{**VALID_LEDGER, "sequence": 7, "id": "7", "transactions": [], "operations": []}])
    T.ingest_ledger_units(spark, raw.read_stream(spark, src, "ledger_unit", per_batch=1),
                          root, ck).awaitTermination()
    assert sinks.read_committed(spark, root, "ledger").count() == 1


def test_rate_cap_state_carries_across_batches(spark, tmp):
    src = os.path.join(tmp, "rate2")
    t0 = dt.datetime(2024, 1, 1)
    first = spark.createDataFrame([("k", f"a{i}", t0 + dt.timedelta(seconds=i)) for i in range(3)],
                                  "key string, id string, ts timestamp_ntz")
    second = spark.createDataFrame([("k", "b0", t0 + dt.timedelta(seconds=10)),
                                    ("k", "b1", t0 + dt.timedelta(seconds=70))],
                                   "key string, id string, ts timestamp_ntz")
    first.coalesce(1).write.parquet(src)
    second.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = (T.rate_cap(stream, "key", "ts", limit=3, window_seconds=60).writeStream
         .format("memory").queryName("rate_t2").outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    flags = {r["id"]: r["rate_limited"] for r in spark.table("rate_t2").collect()}
    # b0 falls in the window opened by a0 in the previous micro-batch: 4th event → limited;
    # b1 opens a new window
    assert flags == {"a0": False, "a1": False, "a2": False, "b0": True, "b1": False}


def test_rate_cap_keeps_rows_behind_the_watermark(spark, tmp):
    """Newest first over several micro-batches, and one key with a fast clock."""
    src = os.path.join(tmp, "rate3")
    t0 = dt.datetime(2024, 1, 1)
    schema = "key string, id string, ts timestamp_ntz"
    want = {}
    for n, hours in enumerate([[900], [12], [9], [3], [0]]):
        rows = [("fast" if h == 900 else "k", f"{h}-{i}", t0 + dt.timedelta(hours=h, seconds=i)) for h in hours for i in range(5)]
        want |= {i: h != 900 for (_, i, _), h in zip(rows, [h for h in hours for _ in range(5)])}
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        for f in os.listdir(src):
            if f.startswith("part-") and not os.path.exists(os.path.join(src, f"_seen{f}")):
                open(os.path.join(src, f"_seen{f}"), "w").close()
                os.utime(os.path.join(src, f), (1_700_000_000 + 60 * n,) * 2)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = (T.rate_cap(stream, "key", "ts", limit=3, window_seconds=60).writeStream
         .format("memory").queryName("rate_t3").outputMode("append").trigger(availableNow=True).start())
    assert q.awaitTermination(100)
    got = spark.table("rate_t3").collect()
    assert sorted(r["id"] for r in got) == sorted(want)
    assert {r["id"]: r["late"] for r in got} == want


def test_network_metrics_stream_rerun_does_not_duplicate(spark, tmp):
    t0 = dt.datetime(2024, 1, 1)
    tx = spark.createDataFrame([(str(i), t0 + dt.timedelta(minutes=7 * i), f"a{i % 3}", True, 5)
                                for i in range(30)],
                               "id string, created_at timestamp_ntz, source_account string, successful boolean, fee_charged long")
    op = tx.select("id", "created_at", F.lit("payment").alias("type"), F.lit('{"amount":"1"}').alias("details"))
    tx_path, op_path, led_path, out = (os.path.join(tmp, x) for x in ("tx2", "op2", "led2", "nm2"))
    tx.write.parquet(tx_path)
    op.write.parquet(op_path)
    led = spark.createDataFrame([(i, t0 + dt.timedelta(minutes=40 * i)) for i in range(1, 6)],
                                "sequence long, closed_at timestamp_ntz")
    led.write.parquet(led_path)
    for ck in ("ck_a", "ck_b"):       # a fresh checkpoint replays every ledger
        stream = spark.readStream.schema(led.schema).parquet(led_path)
        T.network_metrics_stream(spark, stream, tx_path, op_path, out,
                                 os.path.join(tmp, ck)).awaitTermination()
    assert spark.read.parquet(out).count() == 5


def test_seeded_poll_skips_history(spark, tmp):
    src = os.path.join(tmp, "seed")
    hist = spark.createDataFrame([(i,) for i in range(1, 21)], "sequence long")
    hist.repartition(2).write.parquet(src)
    hwm = T.seed_high_water(spark.read.parquet(src))
    spark.createDataFrame([(21,), (22,)], "sequence long").write.mode("append").parquet(src)
    seen = []
    q = (T.poll_stream(spark, src, hist.schema, files_per_poll=1, order="sequence", after=hwm)
         .writeStream.foreachBatch(lambda b, i: seen.extend(r[0] for r in b.collect()))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    assert hwm == 20 and sorted(seen) == [21, 22]

"""Ingest, rate cap, retention, backfill and lookups: cases found wrong
before."""

import datetime as dt
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake import schemas as S
from ledgerlake.operators import joins as J
from ledgerlake.operators import maintain as M
from ledgerlake.operators import project as P
from ledgerlake.operators import quality as Q
from ledgerlake.sources import raw, sinks
from ledgerlake.streaming import jobs as T
from tests.test_quality import VALID_LEDGER, VALID_TX, frame
from tests.test_streaming import land

T0 = dt.datetime(2024, 1, 1)


def test_rate_cap_counts_a_batch_in_time_order(spark, tmp):
    """24 000 events of one key, landed newest first: 10 of each 60 s pass."""
    src = os.path.join(tmp, "rate")
    df = spark.range(24_000).select(
        F.lit("k").alias("key"), F.format_string("%06d", "id").alias("id"),
        F.timestamp_add("SECOND", -F.col("id"), F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")).alias("ts"))
    df.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    q = (T.rate_cap(stream, "key", "ts", limit=10, window_seconds=60).writeStream.format("memory")
         .queryName("rate_reverse").outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    assert spark.table("rate_reverse").where("NOT rate_limited").count() == 4000


def test_capped_equals_row_loop():
    rng = np.random.default_rng(3)
    for _ in range(50):
        times = np.sort(rng.integers(0, 500, rng.integers(0, 80)))
        start, count, want = None, 0, []
        for t in times:
            if start is None or t >= start + 60:
                start, count = int(t), 0
            count += 1
            want.append(count > 4)
        flags, s, c = T.capped(times, None, 0, 4, 60)
        assert flags.tolist() == want and (s, c) == (start, count)


def unit(seq, **change):
    tx = {**VALID_TX, "id": f"t{seq}", "hash": f"{seq:064x}", "ledger": seq}
    return {**VALID_LEDGER, "id": f"l{seq}", "sequence": seq, "transactions": [tx], "operations": [], **change}


def test_ledger_landed_twice_in_one_batch_is_stored_once(spark, tmp):
    src, root, ck = (os.path.join(tmp, x) for x in ("src", "root", "ck"))
    land(src, "a.json", [unit(5), unit(5), unit(6), unit(7, total_coins="abc")])
    with open(os.path.join(src, "b.json"), "w") as f:
        f.write('{"id": "broken", "sequence":\n')
    T.ingest_ledger_units(spark, raw.read_stream(spark, src, "ledger_unit"), root, ck).awaitTermination()
    rows = {n: sinks.read_committed(spark, root, n) for n in ("ledger", "transaction", "processed_ledgers")}
    assert {n: f.count() for n, f in rows.items()} == {"ledger": 2, "transaction": 2, "processed_ledgers": 2}
    bad = sinks.read_committed(spark, root, "ledger_invalid").collect()
    assert any(r["raw"].startswith('{"id": "broken"') for r in bad) and len(bad) == 2
    child = sinks.read_committed(spark, root, "transaction_invalid").collect()
    assert len(child) == 1 and json.loads(child[0]["raw"])["id"] == "t7" and "ledger" in child[0]["error"]


def test_malformed_line_keeps_its_text(spark, tmp):
    src, root, ck = (os.path.join(tmp, x) for x in ("src", "root", "ck"))
    land(src, "a.json", [VALID_TX])
    with open(os.path.join(src, "b.json"), "w") as f:
        f.write("not json at all\n")
    T.ingest_stream(spark, raw.read_stream(spark, src, "transaction"), "transaction", root, ck).awaitTermination()
    assert [r["raw"] for r in sinks.read_committed(spark, root, "transaction_invalid").collect()] == ["not json at all"]
    assert "_corrupt" not in sinks.read_committed(spark, root, "transaction").columns


def test_damaged_table_is_not_taken_for_an_empty_one(spark, tmp):
    root = os.path.join(tmp, "root")
    assert sinks.try_read_committed(spark, root, "t") is None
    sinks.write_batch(spark, root, {"t": spark.range(3)}, 0)
    assert sinks.try_read_committed(spark, root, "t").count() == 3
    spark.range(2).write.parquet(os.path.join(root, "u"))          # no batch_id column
    with pytest.raises(Exception):
        sinks.try_read_committed(spark, root, "u")


def test_first_retention_run_without_expired_rows(spark, tmp):
    live, arch = os.path.join(tmp, "live"), os.path.join(tmp, "arch")
    spark.createDataFrame([(i, T0) for i in range(5)], "id long, ts timestamp_ntz").write.parquet(live)
    assert M.apply_retention(spark, live, arch, "ts", 30, "id") == {"archived": 0, "expired": 0, "kept": 5}
    got = M.apply_retention(spark, live, arch, "ts", 30, "id", as_of="2024-06-01")
    assert got == {"archived": 5, "expired": 5, "kept": 0}
    assert spark.read.parquet(arch).count() == 5
    assert not os.path.exists(live + "_before") and not os.listdir(live + "_staging")


def test_retention_swaps_an_unpartitioned_table(spark, tmp):
    live, arch = os.path.join(tmp, "live"), os.path.join(tmp, "arch")
    rows = [(i, T0 + dt.timedelta(days=i)) for i in range(100)]
    spark.createDataFrame(rows, "id long, ts timestamp_ntz").write.parquet(live)
    got = M.apply_retention(spark, live, arch, "ts", 30, "id")
    assert got["kept"] + got["expired"] == 100 and got["archived"] == got["expired"]
    assert spark.read.parquet(live).count() == got["kept"]
    assert M.apply_retention(spark, live, arch, "ts", 30, "id")["expired"] == 0


def test_backfill_loads_and_marks(spark, tmp):
    root = os.path.join(tmp, "root")
    led = frame(spark, S.RAW_LEDGER, [{**VALID_LEDGER, "id": f"l{i}", "sequence": i} for i in (100, 101, 102)])
    tx = frame(spark, S.RAW_TRANSACTION, [{**VALID_TX, "id": f"t{i}", "hash": f"{i:064x}", "ledger": i} for i in (100, 102, 300)])
    ops = spark.createDataFrame([], S.RAW_OPERATION)
    first = M.load_backfill(spark, led, tx, ops, root, 100, 103)
    assert {r["sequence"]: r["status"] for r in first.collect()} == {
        100: "processed", 101: "processed", 102: "processed", 103: "failed"}
    again = M.load_backfill(spark, led, tx, ops, root, 100, 103)
    assert sorted(r["status"] for r in again.collect()) == ["failed", "skipped", "skipped", "skipped"]
    assert spark.read.parquet(f"{root}/ledger").count() == 3
    assert sorted(r["id"] for r in spark.read.parquet(f"{root}/transaction").collect()) == ["t100", "t102"]
    assert spark.read.parquet(f"{root}/processed_ledgers").count() == 3


def test_backfill_quarantines_malformed_children(spark, tmp):
    from tests.test_quality import VALID_OP
    root = os.path.join(tmp, "root")
    led = frame(spark, S.RAW_LEDGER, [{**VALID_LEDGER, "sequence": 100}])
    good, bad = "a" * 64, "short"
    tx = frame(spark, S.RAW_TRANSACTION, [{**VALID_TX, "id": "t1", "hash": good, "ledger": 100},
                                          {**VALID_TX, "id": "t2", "hash": bad, "ledger": 100},
                                          {**VALID_TX, "id": "t3", "hash": "b", "ledger": 300}])
    ops = frame(spark, S.RAW_OPERATION, [{**VALID_OP, "id": "o1", "transaction_hash": good},
                                         {**VALID_OP, "id": "o2", "transaction_hash": good, "source_account": "bad"},
                                         {**VALID_OP, "id": "o3", "transaction_hash": bad},
                                         {**VALID_OP, "id": "o4", "transaction_hash": "b"}])
    for _ in range(2):                # a rerun adds nothing
        M.load_backfill(spark, led, tx, ops, root, 100, 100)
        ids = {n: sorted(json.loads(r["raw"])["id"] for r in spark.read.parquet(f"{root}/{n}_invalid").collect())
               for n in ("transaction", "operation")}
        assert ids == {"transaction": ["t2"], "operation": ["o2", "o3"]}
        assert [r["id"] for r in spark.read.parquet(f"{root}/operation").collect()] == ["o1"]
        assert spark.read.parquet(f"{root}/processed_ledgers").count() == 1


def test_issuer_and_inner_signatures_are_checked(spark):
    op = {"id": "1", "type": "payment", "asset_issuer": "NOT_AN_ADDRESS", "asset_type": "credit_alphanum4"}
    errs = Q.validate(frame(spark, S.RAW_OPERATION, [op]), "operation").first()["errors"]
    assert "asset_issuer: Invalid account address" in errs
    ok = Q.validate(frame(spark, S.RAW_OPERATION, [{**op, "asset_issuer": None}]), "operation").first()["errors"]
    assert not any(e.startswith("asset_issuer") for e in ok)
    tx = {**VALID_TX, "inner_transaction": {"hash": "a" * 64, "signatures": None}}
    errs = Q.validate(frame(spark, S.RAW_TRANSACTION, [tx]), "transaction").first()["errors"]
    assert errs == ["inner_transaction.signatures: Required"]


def test_path_payment_details_have_all_fields(spark):
    op = {"type": "path_payment_strict_receive", "source_account": "s", "from": "a", "to": "b", "amount": "1",
          "source_amount": "2", "source_max": "3", "destination_asset": "native", "destination_min": "1",
          "path": [{"asset_type": "native", "asset_code": None, "asset_issuer": None}]}
    got = json.loads(P.operation_details(frame(spark, S.RAW_OPERATION, [op])).first()["details"])
    assert got == {**op, "path": [{"asset_type": "native"}]}
    sell = {"type": "manage_sell_offer", "source_account": "s", "selling_asset": "X:Y", "buying_asset": "native",
            "selling_asset_type": "credit_alphanum4"}
    got = json.loads(P.operation_details(frame(spark, S.RAW_OPERATION, [sell])).first()["details"])
    assert (got["selling_asset"], got["buying_asset"]) == ("X:Y", "native")


def test_operations_for_a_frame_of_ledgers(spark):
    tx = spark.createDataFrame([("h1", 1), ("h2", 2)], "hash string, ledger_sequence long")
    op = spark.createDataFrame([("h1", "a"), ("h2", "b")], "transaction_hash string, id string")
    seqs = spark.createDataFrame([(2,), (2,)], "sequence long")
    assert [r["id"] for r in J.operations_for_ledgers(op, tx, seqs).collect()] == ["b"]


def test_integrity_of_a_table_in_one_pass(spark):
    parent = spark.createDataFrame([(1,), (1,), (2,)], "id long")
    child = spark.createDataFrame([("a", 1), ("a", 9), ("b", None), ("c", 8)], "key string, fk long")
    got = {r["rule"]: r["violations"] for r in Q.table_integrity(
        child, ("unique", ["key"]), [("fk", "fk", parent, "id")]).collect()}
    assert got == {"unique": 1, "fk": 2}


def test_integrity_of_large_tables_is_dealt_by_size(spark, monkeypatch):
    """Tables above a task's rows are dealt among more tasks than the session
    shuffles with: same counts with repeated, null and orphan keys."""
    parent = spark.createDataFrame([(i // 2,) for i in range(200)], "id long")
    child = spark.createDataFrame([(None if i % 50 == 0 else f"k{i // 2}", None if i % 9 == 0 else 7 if i % 2 else i)
                                   for i in range(300)], "key string, fk long").repartition(5)

    def report():
        return Q.table_integrity(child, ("unique", ["key"]), [("fk", "fk", parent, "id")])
    want = {r["rule"]: r["violations"] for r in report().collect()}
    assert want["fk"] == sum(1 for i in range(300) if i % 9 and not i % 2 and i >= 100)
    monkeypatch.setattr(Q, "TASK_ROWS", 20)
    assert {r["rule"]: r["violations"] for r in report().collect()} == want
    plan = report()._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count(", 15)") + plan.count(", 25)") >= 3, plan


def test_groups_as_many_as_rows_are_dealt_by_size(spark, monkeypatch):
    from ledgerlake.plans.testviews import TestTables
    from tests.conftest import SF_SMALL
    want = sorted(map(str, TestTables(spark, SF_SMALL).trustlines.collect()))
    monkeypatch.setattr(Q, "TASK_ROWS", 500)
    dealt = TestTables(spark, SF_SMALL).trustlines
    assert "l_suppkey" in dealt._jdf.queryExecution().executedPlan().toString().split("REPARTITION_BY_NUM")[0]
    assert "REPARTITION_BY_NUM" in dealt._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, dealt.collect())) == want


def test_active_preset(spark):
    from ledgerlake.operators import filters as FL
    df = spark.createDataFrame([("a", True), ("b", False), ("c", None)], "account_id string, is_active boolean")
    assert [r["account_id"] for r in FL.preset("active", df).collect()] == ["a"]
    assert "active" in FL.PRESETS

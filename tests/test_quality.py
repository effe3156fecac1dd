"""Fixture cases of the validation rules (FIXTURES.md §1-3)."""

from ledgerlake import schemas as S
from ledgerlake.operators import quality as Q

ADDR_A = "G" + "A" * 55
ADDR_B = "G" + "B" * 55

VALID_LEDGER = dict(
    id="abc123", paging_token="token1", hash="h", sequence=1000, successful_transaction_count=5,
    failed_transaction_count=1, operation_count=10, tx_set_operation_count=10,
    closed_at="2024-01-01T00:00:00Z", total_coins="100000000000.0000000", fee_pool="1234.5678900",
    base_fee_in_stroops=100, base_reserve_in_stroops=5000000, max_tx_set_size=1000,
    protocol_version=20, header_xdr="AAAA")

VALID_TX = dict(
    id="txid1", paging_token="txtoken1", successful=True, hash="a" * 64, ledger=1000,
    created_at="2024-01-01T00:00:00Z", source_account=ADDR_A, source_account_sequence="12345",
    fee_account=None, fee_charged="100", max_fee="200", operation_count=1, envelope_xdr="AAAA",
    result_xdr="AAAA", result_meta_xdr="AAAA", fee_meta_xdr="AAAA", memo_type=None, memo=None,
    signatures=["sig1"], valid_after=None, valid_before=None, fee_bump_transaction=None,
    inner_transaction=None)

VALID_OP = dict(
    id="op1", paging_token="optoken1", transaction_hash="a" * 64, transaction_successful=True,
    type="payment", created_at="2024-01-01T00:00:00Z", source_account=ADDR_A,
    **{"from": ADDR_A, "to": ADDR_B}, amount="100.0000000", asset_type="native")


def frame(spark, schema, rows):
    names = [f.name for f in schema.fields]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def errors(spark, entity, schema, row):
    df = Q.validate(frame(spark, schema, [row]), entity)
    return df.select("errors").first()["errors"]


def test_valid_ledger_passes(spark):
    assert errors(spark, "ledger", S.RAW_LEDGER, VALID_LEDGER) == []


def test_bad_ledgers_rejected(spark):
    for change, field in [({"sequence": None}, "sequence"), ({"sequence": -1}, "sequence"),
                          ({"closed_at": "not-a-date"}, "closed_at"),
                          ({"total_coins": "abc"}, "total_coins")]:
        errs = errors(spark, "ledger", S.RAW_LEDGER, {**VALID_LEDGER, **change})
        assert any(e.startswith(field + ":") for e in errs), (change, errs)


def test_split_valid_positions(spark):
    rows = [VALID_LEDGER, {**VALID_LEDGER, "sequence": -99}, {**VALID_LEDGER, "sequence": 1001}]
    df = frame(spark, S.RAW_LEDGER, rows).coalesce(1)
    valid, invalid = Q.split_valid(df, "ledger")
    assert valid.count() == 2
    bad = invalid.collect()
    assert len(bad) == 1 and bad[0]["position"] == 1
    assert "sequence" in bad[0]["error"] and '"sequence":-99' in bad[0]["raw"]


def test_transactions(spark):
    assert errors(spark, "transaction", S.RAW_TRANSACTION, VALID_TX) == []
    errs = errors(spark, "transaction", S.RAW_TRANSACTION, {**VALID_TX, "hash": "tooshort"})
    assert errs == ["hash: Invalid transaction hash"]
    errs = errors(spark, "transaction", S.RAW_TRANSACTION, {**VALID_TX, "source_account": "INVALID"})
    assert errs == ["source_account: Invalid account address"]


def test_fee_number_coerced_to_text(spark, tmp):
    import json
    import os
    from ledgerlake.sources.raw import read_raw
    rec = {**VALID_TX, "fee_charged": 100}
    path = os.path.join(tmp, "tx.json")
    with open(path, "w") as f:
        f.write(json.dumps(rec) + "\n")
    df = read_raw(spark, path, "transaction")
    row = df.first()
    assert row["fee_charged"] == "100"
    assert Q.validate(df.drop("_corrupt"), "transaction").first()["errors"] == []


def test_operations_type_dispatch(spark):
    assert errors(spark, "operation", S.RAW_OPERATION, VALID_OP) == []
    assert errors(spark, "operation", S.RAW_OPERATION, {**VALID_OP, "to": "BADADDRESS"}) == [
        "to: Invalid account address"]
    assert errors(spark, "operation", S.RAW_OPERATION, {**VALID_OP, "amount": "not-a-number"}) == [
        "amount: Expected a numeric string"]
    generic = {k: v for k, v in VALID_OP.items() if k not in ("from", "to", "amount", "asset_type")}
    generic["type"] = "invoke_host_function"
    assert errors(spark, "operation", S.RAW_OPERATION, generic) == []


def test_constraint_report(spark):
    df = spark.createDataFrame([("x" * 70, "bogus_type"), ("ok", "payment")], "id string, type string")
    rows = {r["rule"]: r["violations"] for r in Q.constraint_report(df, "operation").collect()}
    assert rows["type allowed values"] == 1
    assert rows["id max length 64"] == 1


def test_missing_value_reports_required(spark):
    errs = errors(spark, "ledger", S.RAW_LEDGER, {**VALID_LEDGER, "sequence": None})
    assert errs == ["sequence: Required"]


def test_strict_record_names_entity(spark, tmp):
    import json
    import os
    import pytest
    from ledgerlake.sources.raw import read_raw
    path = os.path.join(tmp, "led.json")
    with open(path, "w") as f:
        f.write(json.dumps({**VALID_LEDGER, "sequence": "bad"}) + "\n")
    df = read_raw(spark, path, "ledger").drop("_corrupt")
    with pytest.raises(ValueError, match="invalid ledger"):
        Q.require_valid(df, "ledger")
    ok = frame(spark, S.RAW_LEDGER, [VALID_LEDGER])
    assert Q.require_valid(ok, "ledger") is ok

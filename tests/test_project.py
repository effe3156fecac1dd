"""Payments normalization and operation details (FIXTURES.md §6)."""

import json

from ledgerlake import schemas as S
from ledgerlake.operators import project as P
from tests.test_quality import VALID_OP, frame


def test_normalize_payments_defaults(spark):
    rows = [{**VALID_OP, "id": "1", "from": ""}, {**VALID_OP, "id": "2", "amount": None},
            {**VALID_OP, "id": "3", "asset_type": "credit_alphanum4", "asset_code": "USDC"},
            {**VALID_OP, "id": "4", "type": "create_account"}]
    out = {r["id"]: r for r in P.normalize_payments(frame(spark, S.RAW_OPERATION, rows)).collect()}
    assert set(out) == {"1", "2", "3"}
    assert out["1"]["from"] == VALID_OP["source_account"]
    assert out["2"]["amount"] == "0"
    assert out["1"]["asset"] == "XLM" and out["3"]["asset"] == "USDC"
    assert out["1"]["created_at"] is not None


def test_operation_details_dispatch(spark):
    rows = [VALID_OP, {**VALID_OP, "id": "x", "type": "bump_sequence"}]
    got = {r["id"]: json.loads(r["details"]) for r in
           P.operation_details(frame(spark, S.RAW_OPERATION, rows)).collect()}
    assert got["op1"]["amount"] == "100.0000000" and got["op1"]["to"] == VALID_OP["to"]
    assert "asset_code" not in got["op1"]          # nulls omitted
    assert got["x"] == {"type": "bump_sequence", "source_account": VALID_OP["source_account"]}


def test_operation_position(spark):
    df = spark.createDataFrame([("123-4",), ("nodash",)], "id string")
    got = {r["id"]: (r["id_ledger_sequence"], r["id_operation_index"], r["position_ok"])
           for r in P.operation_position(df).collect()}
    assert got == {"123-4": (123, 4, True), "nodash": (None, None, False)}


def test_category_and_label(spark):
    df = spark.createDataFrame([("payment",), ("weird",)], "type string")
    got = {r["type"]: (r["category"], r["label"]) for r in
           P.operation_label(P.operation_category(df)).collect()}
    assert got == {"payment": ("payment", "Payment"), "weird": ("other", "weird")}

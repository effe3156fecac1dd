"""Curated outputs carry exactly the declared schemas."""

from ledgerlake import schemas as S
from ledgerlake.operators import aggregates as A
from ledgerlake.operators import project as P
from ledgerlake.operators import windows as W
from ledgerlake.plans.testviews import TestTables
from tests.conftest import SF_SMALL


def names_types(schema):
    return [(f.name, f.dataType.simpleString()) for f in schema.fields]


def test_curated_transactions_schema(spark):
    out = P.curate_transactions(TestTables(spark, SF_SMALL).raw_tx_orders)
    assert names_types(out.schema) == names_types(S.TRANSACTIONS)


def test_payments_schema(spark):
    out = P.normalize_payments(TestTables(spark, SF_SMALL).raw_ops_events)
    assert names_types(out.schema) == names_types(S.PAYMENTS)


def test_metric_snapshot_schemas(spark):
    t = TestTables(spark, SF_SMALL)
    nm = W.network_metrics(t.ledgers_events, t.tx_events, t.op_events)
    assert names_types(nm.schema) == names_types(S.NETWORK_METRICS)
    am = A.build_account_metrics(t.accounts, t.tx_orders, t.trustlines)
    assert names_types(am.schema) == names_types(S.ACCOUNT_METRICS)


def test_every_operation_type_has_a_label_and_at_most_one_category():
    cats = [t for _, types in S.OPERATION_CATEGORIES for t in types]
    assert len(cats) == len(set(cats))
    assert set(S.OPERATION_LABELS) == set(S.OPERATION_TYPES)
    assert len(S.OPERATION_TYPES) == 24


def test_every_inventory_id_has_an_operator():
    from ledgerlake.api import OPERATORS
    ids = ([f"S{i}" for i in range(1, 11)] + [f"P{i}" for i in range(1, 15)]
           + [f"F{i}" for i in range(1, 15)] + [f"J{i}" for i in range(1, 14)]
           + [f"A{i}" for i in range(1, 27)] + [f"W{i}" for i in range(1, 9)]
           + ["L1", "L2", "L3", "L4", "L6", "L7", "L8", "L9", "L10", "L11"]
           + [f"U{i}" for i in range(1, 5)]
           + ["E1", "E2", "E3", "E4", "E5", "E6", "E8", "E9", "E10", "E11", "E12", "E14", "E17", "E18"]
           + [f"Q{i}" for i in range(1, 8)] + [f"T{i}" for i in range(1, 14)]
           + [f"M{i}" for i in range(1, 10)])
    missing = [i for i in ids if i not in OPERATORS or not callable(OPERATORS[i])]
    assert not missing, missing


def test_cluster_conf_is_sane():
    from ledgerlake.session import cluster_conf
    c = cluster_conf(executors=1000, cores_per_executor=8)
    assert c["spark.sql.adaptive.enabled"] == "true"
    assert int(c["spark.sql.shuffle.partitions"]) == 32000
    assert int(c["spark.sql.adaptive.advisoryPartitionSizeInBytes"]) == 256 * 1024 * 1024
    assert c["spark.sql.session.timeZone"] == "UTC"

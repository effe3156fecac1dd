"""Plan-shape assertions: pushdown, pruning, broadcast of bounded lookups
and no single-partition exchange in the flagship sweep."""

from ledgerlake.operators import project as P
from ledgerlake.plans.testviews import TestTables
from tests.conftest import SF_SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_time_filter_is_pushed_to_scan(spark):
    from ledgerlake.operators import aggregates as A
    tx = TestTables(spark, SF_SMALL).tx_events
    p = plan(A.daily_transaction_count(tx, days=7, as_of="2024-01-30 00:00:00"))
    pushed = next(x for x in p.splitlines() if "PushedFilters" in x and "ts" in x)
    assert "GreaterThan(ts," in pushed and "LessThanOrEqual(ts," in pushed      # both ends of the horizon


def test_projection_prunes_columns(spark):
    from ledgerlake.operators import aggregates as A
    tx = TestTables(spark, SF_SMALL).tx_orders
    p = plan(A.top_accounts(tx, 10))
    assert "ReadSchema: struct<o_custkey:bigint>" in p


def test_category_lookup_is_broadcast(spark):
    op = TestTables(spark, SF_SMALL).op_lineitem
    p = plan(P.operation_category(op))
    assert "BroadcastHashJoin" in p or "BroadcastExchange" in p


def test_network_metrics_has_no_single_partition_exchange_on_facts(spark):
    """After the checkpointed sweep, the only single-partition step is the
    offsets window over one row per range partition, and the offsets reach
    the probes by broadcast."""
    from ledgerlake.operators.windows import network_metrics
    t = TestTables(spark, SF_SMALL)
    df = network_metrics(t.ledgers_events, t.tx_events, t.op_events)
    p = plan(df)
    assert "FileScan" not in p                 # fact rows were consumed by the sweep
    assert p.count("SinglePartition") <= 1
    assert "BroadcastHashJoin" in p or "BroadcastExchange" in p


def test_day_partitions_are_pruned(spark, tmp):
    import os
    from ledgerlake.operators.filters import in_time_range
    from ledgerlake.sources.sinks import write_fact_table
    t = TestTables(spark, SF_SMALL)
    path = os.path.join(tmp, "tx")
    write_fact_table(t.tx_events, path, "created_at", sort_within="source_account")
    stored = spark.read.parquet(path)
    sel = in_time_range(stored, "created_at", "2024-01-10 00:00:00", "2024-01-11 12:00:00")
    p = plan(sel)
    assert "PartitionFilters: [isnotnull(day" in p and "day#" in p
    want = in_time_range(t.tx_events, "created_at", "2024-01-10 00:00:00", "2024-01-11 12:00:00")
    assert sel.count() == want.count() > 0


def test_top_n_per_account_is_prelimited(spark):
    from ledgerlake.operators.joins import account_profile
    from ledgerlake.operators.aggregates import build_account_metrics
    t = TestTables(spark, SF_SMALL)
    prof = account_profile(t.accounts, build_account_metrics(t.accounts, t.tx_orders, t.trustlines),
                           t.tx_orders)
    assert "WindowGroupLimit" in plan(prof)


def test_stats_summary_scans_each_table_once(spark):
    from ledgerlake.operators.aggregates import stats_summary
    t = TestTables(spark, SF_SMALL)
    df = stats_summary(t.ledgers_events, t.tx_events, t.op_events, t.accounts, t.assets)
    assert plan(df).count("FileScan") == 5


def test_no_forbidden_operators_in_any_registered_query(spark):
    import sys, os
    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(__file__)), "scripts"))
    from plan_audit import audit
    bad = [(n, f) for n, _, _, f in audit(spark, SF_SMALL) if f]
    assert not bad, bad


def test_bucketed_tables_join_without_exchange(spark):
    from ledgerlake.operators.joins import with_operations
    from ledgerlake.sources.sinks import write_bucketed
    t = TestTables(spark, SF_SMALL)
    write_bucketed(t.tx_orders, "tx_bucketed", "hash", 8)
    write_bucketed(t.op_lineitem, "op_bucketed", "transaction_hash", 8)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        nested = with_operations(spark.table("tx_bucketed"), spark.table("op_bucketed"))
        p = plan(nested)
        assert "SortMergeJoin" in p
        assert "Exchange" not in p
        assert nested.count() == t.tx_orders.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_operations_partitioned_by_type_prune(spark, tmp):
    import os
    from ledgerlake.operators.filters import payments_only
    from ledgerlake.sources.sinks import write_fact_table
    t = TestTables(spark, SF_SMALL)
    path = os.path.join(tmp, "ops")
    write_fact_table(t.op_lineitem, path, "created_at", sort_within="source_account",
                     extra_partition="type")
    stored = spark.read.parquet(path)
    sel = payments_only(stored)
    p = plan(sel)
    assert "PartitionFilters: [isnotnull(type" in p and "(type#" in p
    assert sel.count() == payments_only(t.op_lineitem).count()

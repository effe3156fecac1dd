"""Flat children (J2/J3): ordinals without gathering a group."""

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import joins as J


def test_a_parent_with_a_third_of_all_rows_takes_many_partitions(spark):
    child = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 700).cast("string"))).alias("k"),
        (F.col("id") % 40).alias("at"), F.col("id").cast("string").alias("id"))
    got = J.ordinals(child, "k", ["at", "id"], partitions=24, part="part")
    rows = got.collect()
    assert len(rows) == 6000 and len({r["part"] for r in rows if r["k"] == "hot"}) >= 6
    by = {}
    for r in rows:
        by.setdefault(r["k"], []).append((r["at"], r["id"], r["ordinal"]))
    for v in by.values():
        assert [x[2] for x in sorted(v)] == list(range(len(v)))


def test_ties_repeats_and_null_keys(spark):
    child = spark.createDataFrame([("a", 1, "x")] * 5 + [("b", None, None), (None, 1, "y")], "k string, at int, id string")
    got = sorted((r["k"], r["ordinal"]) for r in J.ordinals(child, "k", ["at", "id"], partitions=4).collect())
    assert got == [("a", i) for i in range(5)] + [("b", 0)]
    assert J.ordinals(child.limit(0), "k", ["at", "id"]).count() == 0


def test_flat_equals_nested(spark):
    tx = spark.createDataFrame([("t1",), ("t2",), ("t3",)], "hash string")
    op = spark.createDataFrame([("t1", i, f"o{i}", "payment") for i in (3, 1, 2)] + [("t2", 0, "p", "x"), ("gone", 0, "q", "x")],
                               "transaction_hash string, operation_index int, id string, type string")
    fields = ("operation_index", "id", "type")
    nested = {(r["hash"], n, o["id"]) for r in J.with_operations(tx, op, fields).collect()
              for n, o in enumerate(r["operations"])}
    assert {(r["hash"], r["ordinal"], r["id"]) for r in J.operations_flat(tx, op, fields).collect()} == nested


def test_the_bound_of_nested_children_is_checked(spark):
    tx = spark.createDataFrame([("t1",)], "hash string")
    op = spark.createDataFrame([("t1", i, str(i)) for i in range(5)], "transaction_hash string, operation_index int, id string")
    fields = ("operation_index", "id")
    assert J.with_operations(tx, op, fields, most=5).count() == 1
    with pytest.raises(ValueError, match="flat form"):
        J.with_operations(tx, op, fields, most=4)

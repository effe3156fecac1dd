"""Table replacement (S4, M6) stopped between any two steps."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import maintain as M
from ledgerlake.sources import replace, sinks


class Stopped(Exception):
    pass


def stop_at(monkeypatch, n):
    """Stop after the n-th step; returns the steps seen."""
    seen = []

    def step(name):
        seen.append(name)
        if len(seen) == n:
            raise Stopped(name)
    monkeypatch.setattr(replace, "_step", step)
    return seen


def left_over(path):
    beside = [f for f in os.listdir(os.path.dirname(path)) if f.startswith(os.path.basename(path) + "_")]
    return [f for f in beside if f.endswith(("_before", "_intent")) or os.listdir(os.path.join(os.path.dirname(path), f))]


def days(spark):
    return spark.range(40).select(F.col("id"), F.expr("date'2024-01-01' + cast(id % 8 as int)").alias("day"),
                                  F.expr("cast(date'2024-01-01' + cast(id % 8 as int) as timestamp_ntz)").alias("at"))


@pytest.mark.parametrize("partitioned", [False, True])
def test_retention_stopped_anywhere_loses_no_row(spark, tmp, monkeypatch, partitioned):
    n, stops = 0, 0
    while True:
        n += 1
        live, archive = os.path.join(tmp, f"live{n}"), os.path.join(tmp, f"old{n}")
        w = days(spark).coalesce(1).write
        (w.partitionBy("day") if partitioned else w).parquet(live)
        seen = stop_at(monkeypatch, n)
        run = dict(ts="at", days=4, key="id", as_of="2024-01-08 00:00:00", partition_col="day" if partitioned else None)
        try:
            M.apply_retention(spark, live, archive, **run)
        except Stopped:
            stops += 1
        else:
            assert len(seen) < n
            break
        monkeypatch.setattr(replace, "_step", lambda name: None)
        replace.recover(spark, live)
        spark.catalog.refreshByPath(live)
        ids = {r["id"] for r in spark.read.parquet(live).collect()} | {r["id"] for r in spark.read.parquet(archive).collect()}
        assert ids == set(range(40)), seen
        M.apply_retention(spark, live, archive, **run)
        spark.catalog.refreshByPath(live)
        assert sorted(r["id"] for r in spark.read.parquet(live).collect()) == [i for i in range(40) if i % 8 >= 3]
        assert sorted(r["id"] for r in spark.read.parquet(archive).collect()) == [i for i in range(40) if i % 8 < 3]
        assert not left_over(live), seen
    assert stops >= 5


def test_upsert_stopped_anywhere_is_finished(spark, tmp, monkeypatch):
    n = 0
    batch = spark.createDataFrame([(1, "new"), (100, "more")], "id long, v string").withColumn("p", F.lit("x"))
    while True:
        n += 1
        path = os.path.join(tmp, f"t{n}")
        spark.range(6).select("id", F.lit("old").alias("v"), F.when(F.col("id") < 3, "x").otherwise("y").alias("p")).write.partitionBy("p").parquet(path)
        seen = stop_at(monkeypatch, n)
        try:
            sinks.upsert_table(spark, path, batch, "id", ["v"], partition_by=["p"])
        except Stopped:
            pass
        monkeypatch.setattr(replace, "_step", lambda name: None)
        sinks.upsert_table(spark, path, batch, "id", ["v"], partition_by=["p"])
        got = {r["id"]: r["v"] for r in spark.read.parquet(path).collect()}
        assert got == {0: "old", 1: "new", 2: "old", 3: "old", 4: "old", 5: "old", 100: "more"} and not left_over(path)
        if len(seen) < n:
            break
    assert n > 3


def test_a_key_that_comes_with_another_partition_stays_one_row(spark, tmp):
    path = os.path.join(tmp, "t")
    first = spark.createDataFrame([(1, "a", "x"), (2, "a", "y")], "id long, v string, p string")
    sinks.upsert_table(spark, path, first, "id", ["v"], partition_by=["p"])
    moved = spark.createDataFrame([(1, "b", "y")], "id long, v string, p string")
    sinks.upsert_table(spark, path, moved, "id", ["v"], partition_by=["p"], moving_keys=True)
    assert sorted((r["id"], r["v"], r["p"]) for r in spark.read.parquet(path).collect()) == [(1, "b", "x"), (2, "a", "y")]


def test_the_only_copy_is_never_deleted(spark, tmp):
    path = os.path.join(tmp, "t")
    spark.range(5).write.parquet(path + "_before")
    spark.range(2).write.parquet(path)
    with pytest.raises(RuntimeError, match="nothing was touched"):
        replace.recover(spark, path)
    with pytest.raises(RuntimeError):
        replace.swap(spark, path, replace.staging(path))
    assert spark.read.parquet(path + "_before").count() == 5 and spark.read.parquet(path).count() == 2
    whole = os.path.join(tmp, "u")
    spark.range(5).write.parquet(whole + "_before")
    assert replace.recover(spark, whole) == "restored" and spark.read.parquet(whole).count() == 5
    assert replace.recover(spark, whole) == "nothing"

"""Day layout, commit log and compaction of committed batches."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import filters as FL
from ledgerlake.sources import batches, raw, sinks
from ledgerlake.streaming import jobs as T
from tests.test_quality import VALID_TX
from tests.test_streaming import land


class Stopped(Exception):
    pass


def frame(spark, lo, hi):
    """Ten days, one row an id; every eleventh has no time."""
    return spark.range(lo, hi).select("id", F.expr(
        "if(id % 11 = 10, null, cast(date'2024-01-01' + cast(id % 10 as int) as timestamp_ntz))").alias("at"))


def write(spark, root, batch, size=40):
    rows = frame(spark, batch * size, (batch + 1) * size)
    sinks.write_batch(spark, root, {"t": rows, "log": rows.select("id")}, batch)


def ids(spark, root, name="t"):
    return sorted(r["id"] for r in sinks.read_committed(spark, root, name).select("id").collect())


def folders(root):
    return [d for at, names, _ in os.walk(root) for d in names if d.startswith("batch_id=")]


def files(path):
    return [f for at, _, names in os.walk(path) for f in names if f.endswith(".parquet")]


def test_range_reads_only_its_days(spark, tmp):
    root = os.path.join(tmp, "root")
    for b in range(2):
        write(spark, root, b)
    batches.compact(spark, root, {"t": "at"})
    write(spark, root, 2)
    between = ("at", "2024-01-03 00:00:00", "2024-01-04 00:00:00")
    log = batches.latest(spark, root)
    rows = FL.in_time_range(batches._compacted_rows(spark, root, "t", log.parts, "at"), *between)
    opened = {r["f"] for r in rows.select(F.input_file_name().alias("f")).distinct().collect()}
    assert opened and all("day=2024-01-03" in f or "day=2024-01-04" in f for f in opened)
    cut = FL.in_time_range(sinks.read_committed(spark, root, "t"), *between)
    assert "PartitionFilters: [isnotnull(day#" in cut._jdf.queryExecution().executedPlan().toString()
    assert cut.count() == sum(i % 11 != 10 and i % 10 in (2, 3) for i in range(120))


def test_many_batches_leave_few_files(spark, tmp):
    root = os.path.join(tmp, "root")
    for b in range(12):
        write(spark, root, b)
    before = len(files(root))
    assert len(files(os.path.join(root, "_processed"))) >= 12 and len(folders(root)) == 24
    assert batches.compact(spark, root, {"t": "at"}) == 12
    assert ids(spark, root) == ids(spark, root, "log") == list(range(480))
    assert folders(root) == [] and len(files(os.path.join(root, "_processed"))) == 1
    assert len(files(root)) < before
    assert batches.compact(spark, root, {"t": "at"}) == 0
    write(spark, root, 11)                                     # replay of a compacted batch
    assert ids(spark, root) == list(range(480))
    write(spark, root, 12)
    assert ids(spark, root) == list(range(520))
    null_day = sinks.read_committed(spark, root, "t").where("day IS NULL").count()
    assert null_day == sum(i % 11 == 10 for i in range(520))


def test_runs_of_a_day_are_merged(spark, tmp):
    root = os.path.join(tmp, "root")
    for b in range(5):
        write(spark, root, b)
        batches.compact(spark, root, {"t": "at"}, most_runs=3)
    assert ids(spark, root) == ids(spark, root, "log") == list(range(200))
    per_day = {}
    for name, run, part in batches.latest(spark, root).parts:
        per_day.setdefault((name, part), []).append(run)
    assert max(map(len, per_day.values())) <= 3
    stored = [d for d in os.listdir(os.path.join(root, "_days", "log"))]
    assert len(stored) <= 3


def test_torn_batch_stays_out_of_a_compaction(spark, tmp):
    root = os.path.join(tmp, "root")
    write(spark, root, 0)
    (frame(spark, 900, 910).withColumn("batch_id", F.lit(1).cast("long"))
     .write.mode("append").partitionBy("batch_id").parquet(os.path.join(root, "t")))
    batches.compact(spark, root, {"t": "at"})
    assert ids(spark, root) == list(range(40))
    write(spark, root, 1)                                      # its replay overwrites its folder
    assert ids(spark, root) == list(range(80))


def test_compaction_stopped_anywhere(spark, tmp, monkeypatch):
    n, stops = 0, 0
    while True:
        n += 1
        root = os.path.join(tmp, f"root{n}")
        seen = []

        def step(name):
            seen.append(name)
            if len(seen) == n:
                raise Stopped(name)
        for b in range(2):
            write(spark, root, b, 4)
        monkeypatch.setattr(batches, "_step", step)
        try:
            batches.compact(spark, root, {"t": "at"})
        except Stopped:
            stops += 1
        else:
            break
        finally:
            monkeypatch.setattr(batches, "_step", lambda name: None)
        assert ids(spark, root) == ids(spark, root, "log") == list(range(8)), seen[-1]
        write(spark, root, 2, 4)
        batches.compact(spark, root, {"t": "at"})
        assert ids(spark, root) == ids(spark, root, "log") == list(range(12)), seen[-1]
        assert folders(root) == []
    assert stops >= 6


def test_empty_and_unknown_tables(spark, tmp):
    root = os.path.join(tmp, "root")
    assert batches.compact(spark, root, {"t": "at"}) == 0 and batches.read(spark, root, "t") is None
    sinks.write_batch(spark, root, {"t": frame(spark, 0, 0)}, 0)
    batches.compact(spark, root, {"t": "at"})
    assert sinks.try_read_committed(spark, root, "t") is None or ids(spark, root) == []
    write(spark, root, 1)
    assert ids(spark, root) == list(range(40, 80))


def test_table_that_gets_days_later(spark, tmp):
    root = os.path.join(tmp, "root")
    for b in range(2):
        sinks.write_batch(spark, root, {"t": frame(spark, 20 * b, 20 * b + 20)}, b)
        batches.compact(spark, root, {"t": "at"} if b else None)
        sinks.write_batch(spark, root, {"t": frame(spark, 900, 901)}, 9)     # fresh beside it
        assert ids(spark, root) == [*range(20 * b + 20), 900]
    cut = FL.in_time_range(sinks.read_committed(spark, root, "t"), "at", "2024-01-03 00:00:00", "2024-01-03 00:00:00")
    assert sorted(r["id"] for r in cut.collect()) == [i for i in range(40) if i % 10 == 2 and i % 11 != 10]


def test_stream_compacts_as_it_goes(spark, tmp):
    src, root, ck = (os.path.join(tmp, x) for x in ("src", "root", "ck"))
    for f in range(4):
        land(src, f"{f}.json", [{**VALID_TX, "id": f"t{f}-{i}", "hash": f"{f * 10 + i:064x}"} for i in range(5)])
    stream = raw.read_stream(spark, src, "transaction", per_batch=1)
    T.ingest_stream(spark, stream, "transaction", root, ck, key="hash", compact_every=2).awaitTermination()
    assert sinks.read_committed(spark, root, "transaction").count() == 20
    assert folders(root) == [] and batches.latest(spark, root).number == 2
    land(src, "again.json", [{**VALID_TX, "id": "t0-0", "hash": f"{0:064x}"}])
    T.ingest_stream(spark, raw.read_stream(spark, src, "transaction", per_batch=1), "transaction", root, ck,
                    key="hash", compact_every=2).awaitTermination()
    assert sinks.read_committed(spark, root, "transaction").count() == 20
    with pytest.raises(Exception):
        sinks.read_committed(spark, root, "nothing")

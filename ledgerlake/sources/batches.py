"""Storage of committed batches (S6/T1): days, a commit log and compaction.

A batch of :func:`ledgerlake.sources.sinks.write_batch` is visible when its
marker is there. Thousands of micro-batches would leave as many small folders
and marker files; :func:`compact` rewrites them::

    <root>/<name>/batch_id=B/               rows of fresh batches
    <root>/_processed/                      markers of fresh batches
    <root>/_days/<name>/run=K/[day=D/]      rows of compacted batches (batch_id is a column)
    <root>/_compacted/<K>/batches, parts    the commit log of compaction K

The log names every compacted batch and the folders (runs and days) that hold
their rows now. It is written beside and put in its place by one rename, so a
compaction is seen whole or not at all: a batch that the newest log names is
read from its runs, any other from its own folder if it has a marker. What a
log no longer needs is removed by :func:`vacuum` (again and again, if it was
stopped); call it when readers of the former state have ended.

A table whose event time is named is compacted by ``day`` (a batch itself is
not split by day: a backlog of years would leave a folder for each day and
batch). A day is added to by one run for each compaction that touches it; from
``most_runs`` on its runs are merged into one. Days bound what a time-range
read opens, since ``filters.in_time_range`` repeats its bounds on ``day``;
fresh batches get the column, too, and are cut by the statistics of the time.

One writer at a time (a stream and its own compaction, or one job). The driver
holds control data only: the batch ids since the last compaction and the
folder names of runs and days.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.sources import replace

MARKER = "_processed"
DAYS = "_days"
LOG = "_compacted"
MARKS = "batch_id long, committed_at timestamp_ntz"
PARTS = "name string, run long, part string, time string"


@dataclass
class Log:
    """The newest commit log: its number (0: none), the compacted batches,
    (name, run, part) of the folders in use, where ``part`` is ``day=...`` or
    '', and the event time of each table that lies in days."""
    number: int
    batches: DataFrame | None
    parts: list[tuple[str, int, str]]
    times: dict[str, str]


def _step(name: str) -> None:
    """Called between any two steps (tests stop here)."""


def _children(spark: SparkSession, path: str) -> list[str]:
    fs, p = replace._fs(spark, path)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())


def latest(spark: SparkSession, root: str) -> Log:
    numbers = [int(n) for n in _children(spark, f"{root}/{LOG}") if n.isdigit()]
    if not numbers:
        return Log(0, None, [], {})
    at = f"{root}/{LOG}/{max(numbers)}"
    parts = spark.read.schema(PARTS).parquet(f"{at}/parts").collect()
    return Log(max(numbers), spark.read.schema(MARKS).parquet(f"{at}/batches"),
               [(r["name"], r["run"], r["part"]) for r in parts],
               {r["name"]: r["time"] for r in parts if r["time"] is not None})


def is_compacted(spark: SparkSession, root: str, batch_id: int) -> bool:
    log = latest(spark, root)
    return log.batches is not None and bool(log.batches.where(F.col("batch_id") == batch_id).take(1))


def _marks(spark: SparkSession, root: str) -> DataFrame:
    path = f"{root}/{MARKER}"
    if not replace.exists(spark, path):
        return spark.createDataFrame([], MARKS)
    return spark.read.schema(MARKS).parquet(path)


def _with_day(df: DataFrame, time: str | None) -> DataFrame:
    return df if time is None else df.withColumn("day", F.col(time).cast("date"))


def _compacted_rows(spark: SparkSession, root: str, name: str, parts, time: str | None) -> DataFrame | None:
    base, out = f"{root}/{DAYS}/{name}", None
    for dated in (True, False):            # a table may have had no days once
        paths = [f"{base}/run={run}" + (f"/{part}" if part else "")
                 for n, run, part in parts if n == name and bool(part) == dated]
        if paths:
            rows = spark.read.option("basePath", base).parquet(*paths).drop("run")
            # a table whose every time is null reads its day as text
            rows = rows.withColumn("day", F.col("day").cast("date")) if dated else _with_day(rows, time)
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def _fresh_rows(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """Rows of all folders of the table, committed or not; None without files."""
    from pyspark.errors import AnalysisException
    if not replace.exists(spark, f"{root}/{name}"):
        return None
    try:
        return spark.read.parquet(f"{root}/{name}")
    except AnalysisException as problem:
        if problem.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """Rows of committed batches, each once; None while there is no data file."""
    log = latest(spark, root)
    time = log.times.get(name)
    old = _compacted_rows(spark, root, name, log.parts, time)
    fresh = _fresh_rows(spark, root, name)
    if fresh is not None:
        marks = _marks(spark, root).select("batch_id")
        if log.batches is not None:
            marks = marks.join(log.batches, "batch_id", "left_anti")
        fresh = _with_day(fresh.join(marks, "batch_id", "left_semi"), time)
    if old is None or fresh is None:
        return fresh if old is None else old
    return fresh.unionByName(old, allowMissingColumns=True)


def compact(spark: SparkSession, root: str, times: dict[str, str] | None = None, most_runs: int = 8,
            remove: bool = True) -> int:
    """Move every committed batch that is still in its own folder into a new
    run; returns how many there were. ``times`` names the event-time column of
    tables that are to lie in days (once named, it stays); rows without a time
    lie in a folder of their own. ``remove`` calls :func:`vacuum` after."""
    log = latest(spark, root)
    marks = _marks(spark, root)
    if log.batches is not None:
        marks = marks.join(log.batches, "batch_id", "left_anti")
    todo = marks.groupBy("batch_id").agg(F.min("committed_at").alias("committed_at")).collect()
    if not todo:
        if remove:
            vacuum(spark, root)
        return 0
    ids = spark.createDataFrame(todo, MARKS)
    number = log.number + 1
    parts, known = list(log.parts), dict(log.times)
    for name in [n for n in _children(spark, root) if not n.startswith(("_", "."))]:
        fresh = _fresh_rows(spark, root, name)
        if fresh is None:
            continue
        if name not in known and (times or {}).get(name) in fresh.columns:
            known[name] = times[name]
        time = known.get(name)
        rows = _with_day(fresh.join(F.broadcast(ids.select("batch_id")), "batch_id", "left_semi"), time)
        runs: dict[str, list[int]] = {}
        for n, run, part in parts:
            if n == name:
                runs.setdefault(part, []).append(run)
        crowded = [(name, run, part) for part, of in runs.items() if len(of) >= most_runs for run in of]
        merged = _compacted_rows(spark, root, name, crowded, time)
        if merged is not None:
            rows = rows.unionByName(merged, allowMissingColumns=True)
        out = f"{root}/{DAYS}/{name}/run={number}"
        by = ["day"] if time is not None else []
        rows.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).parquet(out)
        _step(f"run of {name} written")
        parts = [p for p in parts if p not in crowded]
        parts += [(name, number, part) for part in (_children(spark, out) if by else [""])]
    staged = f"{root}/{LOG}/staged-{number}"
    replace.delete(spark, staged)
    batches = ids if log.batches is None else log.batches.unionByName(ids)
    batches.coalesce(1).write.parquet(f"{staged}/batches")
    (spark.createDataFrame([(*p, known.get(p[0])) for p in parts], PARTS).coalesce(1)
     .write.parquet(f"{staged}/parts"))
    _step("log staged")
    replace._rename(spark, staged, f"{root}/{LOG}/{number}")
    _step("log in place")
    if remove:
        vacuum(spark, root)
    return len(todo)


def _marker_files(spark: SparkSession, root: str, done: DataFrame) -> list[str]:
    """Marker files whose batches are all compacted, but for the newest one
    (the marker table keeps a file)."""
    marks = _marks(spark, root).select("batch_id", F.col("_metadata.file_path").alias("file"))
    files = (marks.join(done.select("batch_id", F.lit(True).alias("done")), "batch_id", "left")
             .groupBy("file").agg(F.bool_and(F.coalesce("done", F.lit(False))).alias("done"),
                                  F.max("batch_id").alias("newest")).collect())
    newest = max((f["newest"] for f in files), default=None)
    return [f["file"] for f in files if f["done"] and f["newest"] != newest]


def vacuum(spark: SparkSession, root: str) -> None:
    """Remove folders and markers that the newest commit log replaces, older
    logs, and runs that no log names (a stopped compaction)."""
    log = latest(spark, root)
    if log.batches is not None:
        done = {r["batch_id"] for r in log.batches.select("batch_id").collect()}
        for name in [n for n in _children(spark, root) if not n.startswith(("_", "."))]:
            table = f"{root}/{name}"
            for folder in _children(spark, table):
                if folder.startswith("batch_id=") and int(folder.split("=")[1]) in done:
                    replace.delete(spark, f"{table}/{folder}")
                    _step("batch folder removed")
            spark.catalog.refreshByPath(table)
        for file in _marker_files(spark, root, log.batches):
            replace.delete(spark, file)
            _step("marker removed")
        spark.catalog.refreshByPath(f"{root}/{MARKER}")
    for name in _children(spark, f"{root}/{LOG}"):
        if name != str(log.number):
            replace.delete(spark, f"{root}/{LOG}/{name}")
            _step("log removed")
    used = set(log.parts)
    for name in _children(spark, f"{root}/{DAYS}"):
        base = f"{root}/{DAYS}/{name}"
        for run in _children(spark, base):
            number = int(run.split("=")[1])
            mine = {part for n, r, part in used if n == name and r == number}
            if not mine:
                replace.delete(spark, f"{base}/{run}")
                _step("run removed")
            elif "" not in mine:
                for part in _children(spark, f"{base}/{run}"):
                    if part not in mine:
                        replace.delete(spark, f"{base}/{run}/{part}")
                        _step("day of a run removed")

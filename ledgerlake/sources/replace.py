"""Replacing a stored table, or some of its partitions, without losing a row.

Plain folders have no transactions, so a replacement is written down first:

1. the new files are staged whole in ``<table>_staging/<id>``;
2. an *intent*, a small JSON file that says what is to happen, is put at
   ``<table>_intent`` by one rename;
3. the steps are taken;
4. intent, old folder and staging are removed.

:func:`recover` finishes or takes back what an earlier run left, and every
writer here calls it first. Before the intent nothing has happened to the
table; after it the staged copy is whole, so a partial overwrite is done again
(the same partitions, the same files) and a swap that has moved the old folder
away is finished. A swap that has not is taken back, since rows may have been
appended meanwhile. A folder ``<table>_before`` is deleted only when the new
table is in its place; where that cannot be known, an error is raised and
nothing is touched.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, name: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, name: str) -> bool:
    fs, p = _fs(spark, name)
    return fs.exists(p)


def delete(spark: SparkSession, name: str) -> None:
    fs, p = _fs(spark, name)
    fs.delete(p, True)


def _rename(spark: SparkSession, old: str, new: str) -> None:
    fs, p = _fs(spark, old)
    if not fs.rename(p, _fs(spark, new)[1]):
        raise RuntimeError(f"could not rename {old} to {new}")


def _root(table: str) -> str:
    return table.rstrip("/")


def staging(table: str) -> str:
    """A fresh folder for new files of the table."""
    return f"{_root(table)}_staging/{uuid.uuid4().hex}"


def _intent(table: str) -> str:
    return f"{_root(table)}_intent"


def _before(table: str) -> str:
    return f"{_root(table)}_before"


def _step(name: str) -> None:
    """Called between any two steps (tests stop here)."""


def _write_intent(spark: SparkSession, table: str, what: dict) -> None:
    temporary = f"{staging(table)}.intent"
    fs, p = _fs(spark, temporary)
    out = fs.create(p)
    out.write(bytearray(json.dumps(what).encode()))
    out.close()
    _step("intent staged")
    _rename(spark, temporary, _intent(table))
    _step("intent written")


def _read_intent(spark: SparkSession, table: str) -> dict | None:
    if not exists(spark, _intent(table)):
        return None
    lines = spark.read.text(_intent(table)).collect()          # one line
    return json.loads(lines[0][0])


def _overwrite(spark: SparkSession, table: str, what: dict) -> None:
    """Put the staged rows in the place of their partitions (or of the whole
    table) and drop partitions; may be done again and again."""
    parts, staged = what["partition_by"], what["staged"]
    if what["rows"]:
        writer = spark.read.parquet(staged).write.mode("overwrite")
        if parts:
            writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*parts)
        writer.parquet(table)
        _step("partitions overwritten")
    for folder in what["drop"]:
        delete(spark, f"{_root(table)}/{folder}")
        _step("partition dropped")


def _finish(spark: SparkSession, table: str, what: dict) -> None:
    delete(spark, _intent(table))
    _step("intent removed")
    delete(spark, what["staged"])


def overwrite(spark: SparkSession, table: str, staged: str, partition_by: list[str] | None = None,
              drop: list[str] | None = None, empty: bool = False) -> None:
    """Replace the partitions that ``staged`` holds (the whole table if it has
    none) by it and delete the partition folders ``drop`` (``column=value``).
    ``staged`` is a folder from :func:`staging` and is removed; ``empty`` says
    that no partition is written, only dropped."""
    what = {"kind": "overwrite", "staged": staged, "partition_by": partition_by or [], "drop": drop or [],
            "rows": not empty}
    _write_intent(spark, table, what)
    _overwrite(spark, table, what)
    _finish(spark, table, what)
    spark.catalog.refreshByPath(table)


def swap(spark: SparkSession, table: str, staged: str) -> None:
    """Put the folder ``staged`` in the table's place by two renames."""
    if exists(spark, _before(table)):
        raise RuntimeError(f"{_before(table)} is there: call recover() first")
    _write_intent(spark, table, {"kind": "swap", "staged": staged})
    _swap_on(spark, table, staged)


def _swap_on(spark: SparkSession, table: str, staged: str) -> None:
    if exists(spark, staged):
        if not exists(spark, _before(table)):
            _rename(spark, _root(table), _before(table))
            _step("old moved away")
        _rename(spark, staged, _root(table))
        _step("new in place")
    delete(spark, _before(table))
    _step("old deleted")
    _finish(spark, table, {"staged": staged})
    spark.catalog.refreshByPath(table)


def recover(spark: SparkSession, table: str) -> str:
    """Bring a table back to one whole state and remove what was staged
    besides; returns what was done: ``nothing``, ``finished``, ``taken back``
    or ``restored``. A table has one writer at a time."""
    done = _recover(spark, table)
    delete(spark, f"{_root(table)}_staging")
    return done


def _recover(spark: SparkSession, table: str) -> str:
    what, live, before = _read_intent(spark, table), exists(spark, table), exists(spark, _before(table))
    if what is None:
        if not before:
            return "nothing"
        if live:
            raise RuntimeError(f"both {table} and {_before(table)} exist and nothing says which is whole; "
                               "nothing was touched")
        _rename(spark, _before(table), _root(table))
        return "restored"
    if what["kind"] == "overwrite":
        if not exists(spark, what["staged"]):
            raise RuntimeError(f"the staged copy {what['staged']} of {table} is gone; nothing was touched")
        _overwrite(spark, table, what)
        _finish(spark, table, what)
        return "finished"
    staged = exists(spark, what["staged"])
    if staged and live and before:
        raise RuntimeError(f"{table} was written anew while {_before(table)} held its rows; nothing was touched")
    if staged and live:
        _finish(spark, table, what)
        return "taken back"
    _swap_on(spark, table, what["staged"])
    return "finished"

"""Mergeable roll-ups of account activity (A2, A8, A19 over horizons).

Horizons over stored history read roll-ups, not facts. Accounts get dense
numbers in a dictionary; each batch of transactions adds, for every hour and
every day it touches,

* ``accounts``: (account, number), only accounts not seen before;
* ``bitmaps``: (level, start, bucket, bitmap): the numbers seen, 32 768 to a
  bitmap. Bitmaps merge by OR, so distinct counts over any set of hours and
  days are exact, and an account counted by two batches counts once;
* ``activity``: (level, start, number, n, first, last) for each account.

Each table is partitioned by ``batch_id`` (and level) and a replayed batch
overwrites its own folders with the same rows: numbers follow from the
dictionary of earlier batches alone. Batches are written one after another,
as a stream's are. Files are ranges of ``start``, so time bounds skip them by
their statistics.

A horizon is cut into whole days, whole hours outside them, and what is left
of the first and last hour; only those last pieces (under two hours) are read
from the facts. Rows without account or time are in no roll-up, as they are in
no horizon. The tables must hold every batch of the facts that are passed.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlake import schemas as S
from ledgerlake.operators.common import ntz_lit
from ledgerlake.sources import replace

ACCOUNTS, BITMAPS, ACTIVITY = "account_numbers", "account_bitmaps", "account_activity"
SCHEMAS = {
    ACCOUNTS: "account string, number long, batch_id long",
    BITMAPS: "start timestamp_ntz, bucket long, bitmap binary, batch_id long, level string",
    ACTIVITY: "start timestamp_ntz, number long, n long, first timestamp_ntz, last timestamp_ntz, batch_id long, level string",
}
DAY, HOUR = dt.timedelta(days=1), dt.timedelta(hours=1)
TICK = dt.timedelta(microseconds=1)
_EPOCH = dt.datetime(1970, 1, 1)
_NUMBERING = 4096       # hash buckets that number new accounts; they hold distinct keys, so none is hot


def _write(df: DataFrame, path: str, batch_id: int, *partitions: str) -> None:
    (df.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id", *partitions).parquet(path))


def _read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}")


def _numbers(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, root, ACCOUNTS)


def number_accounts(accounts: DataFrame, known: DataFrame | None) -> DataFrame:
    """(account, number) of the distinct ``account`` values that ``known``
    lacks, numbered without gaps after it. Numbers are a count inside a hash
    bucket plus the counts of the buckets before it; they depend on the two
    sets alone."""
    first = 1
    if known is not None:
        accounts = accounts.join(known, "account", "left_anti")
        first = (known.agg(F.max("number")).first()[0] or 0) + 1
    new = accounts.select("account", F.pmod(F.xxhash64("account"), F.lit(_NUMBERING)).alias("_b"))
    sizes = new.groupBy("_b").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)      # at most _NUMBERING rows
    offsets = sizes.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy("account"))
    return (new.withColumn("_i", inside).join(F.broadcast(offsets), "_b")
            .select("account", (F.lit(first - 1) + F.col("_off") + F.col("_i")).cast("long").alias("number")))


def roll_up(spark: SparkSession, root: str, tx: DataFrame, batch_id: int,
            account: str = "source_account", ts: str = "created_at") -> None:
    """Add one batch of transactions to the roll-ups under ``root``."""
    path = f"{root}/{ACCOUNTS}"
    hourly = (tx.where(F.col(account).isNotNull() & F.col(ts).isNotNull())
              .groupBy(F.col(account).alias("account"), F.date_trunc("HOUR", ts).cast("timestamp_ntz").alias("start"))
              .agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last")))
    known = _numbers(spark, root).where(F.col("batch_id") < batch_id) if replace.exists(spark, path) else None
    _write(number_accounts(hourly.select("account").distinct(), known), path, batch_id)

    of = _numbers(spark, root).where(F.col("batch_id") <= batch_id).select("account", "number")
    hours = hourly.join(of, "account").select(F.lit("hour").alias("level"), "start", "number", "n", "first", "last")
    days = (hours.groupBy(F.date_trunc("DAY", "start").cast("timestamp_ntz").alias("start"), "number")
            .agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
            .select(F.lit("day").alias("level"), "start", "number", "n", "first", "last"))
    _write(hours.unionByName(days).repartitionByRange("level", "start", "number")
           .sortWithinPartitions("level", "start", "number"), f"{root}/{ACTIVITY}", batch_id, "level")
    activity = _read(spark, root, ACTIVITY).where(F.col("batch_id") == batch_id)
    bitmaps = (activity.groupBy("level", "start", F.bitmap_bucket_number("number").alias("bucket"))
               .agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bitmap")))
    _write(bitmaps.repartitionByRange("level", "start").sortWithinPartitions("level", "start"),
           f"{root}/{BITMAPS}", batch_id, "level")


# horizons --------------------------------------------------------------------
def _floor(t: dt.datetime, unit: dt.timedelta) -> dt.datetime:
    return t - (t - _EPOCH) % unit


def _ceil(t: dt.datetime, unit: dt.timedelta) -> dt.datetime:
    return t + (_EPOCH - t) % unit


def cover(start: dt.datetime | None, end: dt.datetime) -> dict:
    """``[start, end)`` (from the beginning if ``start`` is None) as ranges
    of whole ``day`` and ``hour`` starts and of ``facts`` times, each a list
    of (from, to) half-open and none overlapping another."""
    def cut(a, b, unit):
        """([whole units], [rests]) of one range."""
        lo, hi = (None if a is None else _ceil(a, unit)), _floor(b, unit)
        if lo is not None and lo >= hi:
            return [], [(a, b)]
        rests = [x for x in ((a, lo), (hi, b)) if x[0] is not None and x[0] < x[1]]
        return [(lo, hi)], rests
    if start is not None and start >= end:
        return {"day": [], "hour": [], "facts": []}
    days, rest = cut(start, end, DAY)
    hours, facts = [], []
    for a, b in rest:
        whole, edge = cut(a, b, HOUR)
        hours += whole
        facts += edge
    return {"day": days, "hour": hours, "facts": facts}


def _inside(col: str, ranges: list) -> Column:
    """Simple comparisons with literals, which reach the scan."""
    out = F.lit(False)
    for a, b in ranges:
        one = F.col(col) < ntz_lit(b)
        if a is not None:
            one = (F.col(col) >= ntz_lit(a)) & one
        out = out | one
    return out


def _moment(as_of, facts: DataFrame, ts: str) -> dt.datetime | None:
    if as_of is None:
        return facts.agg(F.max(ts)).first()[0]
    if isinstance(as_of, str):
        return dt.datetime.fromisoformat(as_of.replace("T", " ").rstrip("Z"))
    return as_of


def _spans(as_of: dt.datetime, open_start: bool) -> dict:
    """Pieces of each horizon; times are whole microseconds, so an open or
    closed bound is one tick further."""
    return {label: cover(as_of - dt.timedelta(seconds=secs) + (TICK if open_start else 0 * TICK), as_of + TICK)
            for label, secs in S.HORIZONS}


def _levels(spark, root, name, spans) -> list[DataFrame]:
    """Rows of the roll-up that any horizon wants, with a flag for each."""
    out = []
    for level in ("day", "hour"):
        flags = {label: _inside("start", pieces[level]) for label, pieces in spans.items()}
        any_of = _inside("start", sorted({r for p in spans.values() for r in p[level]}, key=str))
        out.append(_read(spark, root, name).where((F.col("level") == level) & any_of)
                   .select("*", *[f.alias(f"in_{label}") for label, f in flags.items()]))
    return out


def _edges(facts: DataFrame, spans: dict, account: str, ts: str) -> DataFrame:
    any_of = _inside(ts, sorted({r for p in spans.values() for r in p["facts"]}, key=str))
    return (facts.where(any_of & F.col(account).isNotNull())
            .select(F.col(account).alias("account"), F.col(ts).alias("ts"),
                    *[_inside(ts, p["facts"]).alias(f"in_{label}") for label, p in spans.items()]))


def active_accounts(spark: SparkSession, root: str, facts: DataFrame, as_of=None, open_start: bool = False,
                    account: str = "source_account", ts: str = "created_at") -> DataFrame:
    """A2 from roll-ups: distinct accounts of the closed horizons up to
    ``as_of`` (the newest fact if omitted), exact. ``open_start`` leaves the
    instant ``as_of - h`` out. One row; zeros for empty tables."""
    now = _moment(as_of, facts, ts)
    labels = [label for label, _ in S.HORIZONS]
    if now is None:
        return spark.range(1).select(*[F.lit(0).cast("long").alias(f"active_accounts_{x}") for x in labels])
    spans = _spans(now, open_start)
    merged = [lv.groupBy("bucket").agg(*[F.bitmap_or_agg(F.when(F.col(f"in_{x}"), F.col("bitmap"))).alias(x) for x in labels])
              for lv in _levels(spark, root, BITMAPS, spans)]
    seen = (_edges(facts, spans, account, ts).groupBy("account")
            .agg(*[F.bool_or(f"in_{x}").alias(f"in_{x}") for x in labels])
            .join(_numbers(spark, root), "account"))
    merged.append(seen.groupBy(F.bitmap_bucket_number("number").alias("bucket")).agg(*[
        F.bitmap_construct_agg(F.when(F.col(f"in_{x}"), F.bitmap_bit_position("number"))).alias(x) for x in labels]))
    rows = merged[0]
    for other in merged[1:]:
        rows = rows.unionByName(other)
    per = rows.groupBy("bucket").agg(*[F.bitmap_count(F.bitmap_or_agg(x)).alias(x) for x in labels])
    return per.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(f"active_accounts_{x}") for x in labels])


def network_overview(spark: SparkSession, root: str, facts: DataFrame, led: DataFrame, as_of=None) -> DataFrame:
    """A8 from roll-ups: all-time accounts are the dictionary's size, the
    day's accounts come from bitmaps, only the last minute (and the edges of
    the day) from the facts."""
    from ledgerlake.operators.aggregates import _count_frame, _one_row
    now = _moment(as_of, facts, "created_at")
    end = _EPOCH if now is None else now
    minute = _inside("created_at", [(end - dt.timedelta(seconds=60) + TICK, end + TICK)])
    tps = facts.where(minute).agg((F.count("*").cast("double") / F.lit(60.0)).alias("tps"))
    total = _numbers(spark, root).agg(F.count("*").alias("total_accounts"))
    active = active_accounts(spark, root, facts, now, open_start=True).select("active_accounts_24h")
    return _one_row(tps, total, active, _count_frame(led, "total_ledgers"))


def account_activity(spark: SparkSession, root: str, facts: DataFrame, as_of=None,
                     account: str = "source_account", ts: str = "created_at") -> DataFrame:
    """A19's activity from roll-ups: per account the transactions of each
    horizon and the first and last transaction up to ``as_of``: (account_id,
    transaction_count_<h>, first_transaction, last_transaction). Accounts
    without a transaction by then have no row."""
    now = _moment(as_of, facts, ts)
    labels = [label for label, _ in S.HORIZONS]
    end = _EPOCH if now is None else now
    spans = {**_spans(end, False), "ever": cover(None, end + TICK)}
    # the flags of the horizons and of "ever" may take an hour from a day row
    # here and from an hour row there, so each is summed by its own flag
    counts = {x: F.sum(F.when(F.col(f"in_{x}"), F.col("n"))).alias(x) for x in labels}
    ends = (F.min(F.when(F.col("in_ever"), F.col("first"))).alias("first"),
            F.max(F.when(F.col("in_ever"), F.col("last"))).alias("last"))
    parts = [lv.groupBy("number").agg(*counts.values(), *ends) for lv in _levels(spark, root, ACTIVITY, spans)]
    edge = _edges(facts, spans, account, ts).withColumns({"n": F.lit(1), "first": F.col("ts"), "last": F.col("ts")})
    parts.append(edge.groupBy("account").agg(*counts.values(), *ends)
                 .join(_numbers(spark, root).select("account", "number"), "account").drop("account"))
    rows = parts[0]
    for other in parts[1:]:
        rows = rows.unionByName(other)
    per = rows.groupBy("number").agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(f"transaction_count_{x}") for x in labels],
                                     F.min("first").alias("first_transaction"), F.max("last").alias("last_transaction"))
    return (per.where("first_transaction IS NOT NULL").join(_numbers(spark, root), "number")
            .select(F.col("account").alias("account_id"), *[f"transaction_count_{x}" for x in labels],
                    "first_transaction", "last_transaction"))

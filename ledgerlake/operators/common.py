"""Shared helpers: the ``as_of`` contract and small column utilities."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ntz_lit(value) -> Column:
    """A ``timestamp_ntz`` literal from text or a naive datetime, built from
    text so it never passes through a time zone."""
    if isinstance(value, _dt.datetime):
        value = value.isoformat(sep=" ")
    elif isinstance(value, _dt.date):
        value = value.isoformat() + " 00:00:00"
    elif isinstance(value, str):
        value = value.replace("T", " ").rstrip("Z")
    return F.lit(value).cast("timestamp_ntz")


def as_of_column(df: DataFrame, ts: str, as_of=None) -> Column:
    """The reference time of a job.

    It is always a literal, so every horizon bound derived from it reaches
    the Parquet scan as a pushed filter (and prunes day partitions). When
    omitted, it is the newest ``ts`` of the input: one small aggregate job
    returning a single value (Parquet reads only that column).
    """
    if as_of is None:
        newest = df.select(F.max(ts)).first()[0]
        return F.lit(None).cast("timestamp_ntz") if newest is None else ntz_lit(newest)
    if isinstance(as_of, Column):
        return as_of
    return ntz_lit(as_of)


def minus(ts: Column, seconds: int) -> Column:
    """``ts - seconds`` as an interval subtraction (keeps the literal foldable)."""
    return ts - F.expr(f"INTERVAL {int(seconds)} SECONDS")


def up_to(df: DataFrame, ts: str, t: Column) -> DataFrame:
    """Rows known at time ``t`` (a literal, so the bound reaches the scan)."""
    return df.where(F.col(ts) <= t)


def micros(ts) -> Column:
    """Epoch microseconds of a ``timestamp_ntz`` (UTC wall clock) from its
    calendar fields — independent of the session time zone (casting NTZ to
    TIMESTAMP, or ``timestampdiff`` on NTZ, would apply the session zone and
    its DST jumps)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return (F.unix_date(c.cast("date")).cast("long") * F.lit(86_400_000_000)
            + F.hour(c).cast("long") * F.lit(3_600_000_000)
            + F.minute(c).cast("long") * F.lit(60_000_000)
            + (F.date_part(F.lit("SECOND"), c) * F.lit(1_000_000)).cast("long"))


def from_micros(us) -> Column:
    """Inverse of :func:`micros`: wall-clock arithmetic on ``timestamp_ntz``."""
    return F.timestamp_add("MICROSECOND", us, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def decimal_text(c: Column, precision: int = 38, scale: int = 7) -> Column:
    """Plain decimal text with exactly ``scale`` decimals (``-5.5000000``).
    Outside ANSI mode Spark casts with Java's ``BigDecimal.toString``, which
    switches to scientific notation once the adjusted exponent is below −6
    (``0E-7``, ``1E-7``). That needs scale ≥ 7; smaller scales use the
    plain cast, larger ones a digit mask."""
    d = c.cast(f"decimal({precision},{scale})")
    if scale <= 6:
        return d.cast("string")
    mask = "9" * (precision - scale - 1) + "0" + "." + "0" * scale
    digits = F.trim(F.to_char(F.abs(d), F.lit(mask)))
    return F.when(d.isNotNull(), F.concat(F.when(d < 0, F.lit("-")).otherwise(F.lit("")), digits))


def amount_text(c: Column) -> Column:
    """Decimal amount as the text the ledger stores (fixed 7 decimals)."""
    return decimal_text(c, 38, 7)


def require_range(start, end, what: str = "start") -> None:
    if start is not None and end is not None and start > end:
        raise ValueError(f"{what} must not be after end ({start!r} > {end!r})")

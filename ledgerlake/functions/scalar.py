"""Column transforms (E1-E18). Every function returns a native Column
expression, so it stays inside whole-stage codegen; none is a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlake import schemas as S


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# E1 -------------------------------------------------------------------------
def json_decimal(details, field: str = "amount", dtype=S.AMOUNT_SUM_INPUT) -> Column:
    """Numeric field of a JSON object as a decimal; null when missing or
    not a number (the reference's database would error instead)."""
    return F.get_json_object(_c(details), f"$.{field}").try_cast(dtype)


# E2 -------------------------------------------------------------------------
def to_amount(c, dtype=S.AMOUNT_SUM_INPUT) -> Column:
    """Decimal string -> decimal; garbage -> null."""
    return _c(c).try_cast(dtype)


# E3 -------------------------------------------------------------------------
def asset_key(asset_type, code, issuer) -> Column:
    """``XLM`` for the native asset, else ``code:issuer``."""
    return F.when(_c(asset_type) == "native", F.lit("XLM")).otherwise(
        F.concat(_c(code), F.lit(":"), _c(issuer)))


def parse_asset_key(key) -> Column:
    """Inverse of :func:`asset_key` as struct(asset_type, asset_code,
    asset_issuer); malformed keys give a null struct."""
    k = _c(key)
    parts = F.split(k, ":", 2)
    code = F.try_element_at(parts, F.lit(1))
    issuer = F.try_element_at(parts, F.lit(2))
    native = k.isin("XLM", "native")
    ok = (F.size(parts) == 2) & (F.length(code) > 0) & (F.length(issuer) > 0)
    credit = F.struct(
        F.when(F.length(code) <= 4, F.lit("credit_alphanum4"))
        .otherwise(F.lit("credit_alphanum12")).alias("asset_type"),
        code.alias("asset_code"), issuer.alias("asset_issuer"))
    native_s = F.struct(F.lit("native").alias("asset_type"),
                        F.lit(None).cast("string").alias("asset_code"),
                        F.lit(None).cast("string").alias("asset_issuer"))
    return F.when(native, native_s).when(ok, credit)


# E4 -------------------------------------------------------------------------
def stroops_to_units(stroops) -> Column:
    """Base units -> native units with 7 decimals, exact."""
    return (_c(stroops).cast("decimal(38,0)") / F.lit(S.STROOPS_PER_UNIT)).cast(S.AMOUNT)


def units_to_stroops(units) -> Column:
    """Native units -> base units, floored, exact decimal arithmetic."""
    return F.floor(_c(units).try_cast(S.AMOUNT) * F.lit(S.STROOPS_PER_UNIT)).cast("long")


# E5 -------------------------------------------------------------------------
def truncate_id(c, start: int = 6, end: int = 4, slack: int = 0) -> Column:
    """First ``start`` + '...' + last ``end`` chars when longer than
    ``start + end + slack`` (the search box variant uses slack 3)."""
    s = _c(c)
    return F.when(F.length(s) <= start + end + slack, s).otherwise(
        F.concat(F.substring(s, 1, start), F.lit("..."), F.right(s, F.lit(end))))


# E6 -------------------------------------------------------------------------
def duration_text(start_ts, end_ts) -> Column:
    """``Nd Nh`` / ``Nh Nm`` / ``Nm Ns`` / ``Ns`` with floored units."""
    from ledgerlake.operators.common import micros as _us
    micros = _us(_c(end_ts)) - _us(_c(start_ts))
    secs = F.floor(micros / F.lit(1_000_000))
    mins = F.floor(secs / 60)
    hours = F.floor(mins / 60)
    days = F.floor(hours / 24)
    return (F.when(days > 0, F.format_string("%dd %dh", days, F.pmod(hours, F.lit(24))))
            .when(hours > 0, F.format_string("%dh %dm", hours, F.pmod(mins, F.lit(60))))
            .when(mins > 0, F.format_string("%dm %ds", mins, F.pmod(secs, F.lit(60))))
            .otherwise(F.format_string("%ds", secs)))


# E8 -------------------------------------------------------------------------
def is_address(c) -> Column:
    return F.coalesce(_c(c).rlike(S.ADDRESS_PATTERN), F.lit(False))


def is_hash(c) -> Column:
    return F.coalesce(_c(c).rlike(S.HASH_PATTERN), F.lit(False))


def is_numeric_string(c) -> Column:
    return F.coalesce(_c(c).rlike(S.NUMERIC_STRING_PATTERN), F.lit(False))


def is_iso_timestamp(c) -> Column:
    return F.coalesce(_c(c).rlike(S.ISO_WITH_OFFSET_PATTERN), F.lit(False))


# E9 -------------------------------------------------------------------------
def identifier_kind(c) -> Column:
    """Classify a search text: account / transaction / ledger / partial,
    null when blank or shorter than two characters."""
    v = F.trim(_c(c))
    return (F.when(v.rlike(S.ADDRESS_PATTERN), F.lit("account"))
            .when(v.rlike(S.HASH_PATTERN), F.lit("transaction"))
            .when(v.rlike(r"^\d+$"), F.lit("ledger"))
            .when(F.length(v) >= 2, F.lit("partial")))


# E10 ------------------------------------------------------------------------
def floor_div(a, b) -> Column:
    """Exact floor division of non-negative longs (no floating point)."""
    a, b = _c(a).cast("long"), _c(b).cast("long")
    return ((a - F.pmod(a, b)).cast("decimal(38,0)") / b.cast("decimal(38,0)")).cast("long")


def ratio_half_up(num, den, scale: int = 2, pct: bool = False) -> Column:
    """round(num/den (x100 when ``pct``), scale) with HALF_UP, for
    non-negative integer inputs, as a double. The rounding is done in exact
    integer arithmetic (q = (2·m·num + den) div 2·den), so the result never
    depends on binary floating point; only q / 10^scale is a double.
    Null when ``den`` is 0."""
    n, d = _c(num).cast("long"), _c(den).cast("long")
    mult = 10 ** scale * (100 if pct else 1)
    q = floor_div(n * F.lit(2 * mult) + d, d * F.lit(2))
    return F.when(d > 0, q.cast("double") / F.lit(float(10 ** scale)))


# E11 ------------------------------------------------------------------------
def day_of(ts) -> Column:
    return F.to_date(_c(ts))


def day_text(ts) -> Column:
    """``yyyy-MM-dd`` of a date or NTZ timestamp (text cast: zone-free)."""
    return _c(ts).cast("date").cast("string")


# E12 ------------------------------------------------------------------------
def range_seconds(label: str) -> int:
    """Time-range label -> seconds; unknown labels raise."""
    try:
        return S.TIME_RANGES[label]
    except KeyError as exc:
        raise ValueError(f"unknown time range {label!r}; expected one of {sorted(S.TIME_RANGES)}") from exc


def minus_seconds(ts, seconds: int) -> Column:
    return _c(ts) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))


# E14 ------------------------------------------------------------------------
def encode_cursor(c) -> Column:
    return F.base64(_c(c).cast("string").cast("binary"))


def decode_cursor(c) -> Column:
    """base64 text -> long; invalid input -> null."""
    return F.try_to_binary(_c(c), F.lit("base64")).cast("string").try_cast("long")


# E17 ------------------------------------------------------------------------
def backoff_ms(attempt, base_ms: int = S.RETRY_BASE_MS, cap_ms: int = S.RETRY_CAP_MS) -> Column:
    return F.least(F.lit(base_ms) * F.pow(F.lit(2), _c(attempt)), F.lit(cap_ms)).cast("long")


# E18 ------------------------------------------------------------------------
def default_memo(c) -> Column:
    return F.coalesce(_c(c), F.lit("none"))


def default_signatures(c) -> Column:
    return F.coalesce(_c(c), F.array().cast("array<string>"))


def default_amount(c) -> Column:
    return F.coalesce(_c(c), F.lit("0"))

"""Projections (P1-P14): curation of raw records and derived columns.

All projections are narrow ``select``s of native expressions; the two
lookup maps (category, display label) are 24-row constant frames joined
with an explicit broadcast (their size is fixed by the domain).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake import schemas as S
from ledgerlake.functions import scalar as E


def parse_time(c) -> Column:
    """ISO-8601 text with offset -> UTC wall-clock ``timestamp_ntz``; null
    when unparsable. The instant's epoch micros are added to the NTZ epoch,
    so the session time zone never enters."""
    from ledgerlake.operators.common import from_micros
    col = F.col(c) if isinstance(c, str) else c
    return from_micros(F.unix_micros(col.try_cast("timestamp")))


# P1-P3 -----------------------------------------------------------------------
def normalize_ledgers(raw: DataFrame) -> DataFrame:
    """Narrow ledger row; failed transactions are not counted in tx_count."""
    return raw.select("sequence", "hash", parse_time("closed_at").alias("close_time"),
                      F.col("successful_transaction_count").alias("tx_count"))


def normalize_transactions(raw: DataFrame) -> DataFrame:
    return raw.select("hash", F.col("ledger").alias("ledger_seq"), "source_account",
                      "fee_charged")


def normalize_operations(raw: DataFrame) -> DataFrame:
    return raw.select("id", F.col("transaction_hash").alias("tx_hash"), "type",
                      "source_account", parse_time("created_at").alias("created_at"))


# P4 -------------------------------------------------------------------------
def normalize_payments(raw_ops: DataFrame) -> DataFrame:
    """Payments from the three payment operation types. ``from``/``to``
    default to the source account when empty or null, amount to "0", asset
    is ``XLM`` for native else the code. The event time is carried."""
    src = F.col("source_account")

    def or_source(c):
        return F.coalesce(F.nullif(F.col(c), F.lit("")), src)

    return raw_ops.where(F.col("type").isin(S.PAYMENT_OPERATIONS)).select(
        "id", or_source("from").alias("from"), or_source("to").alias("to"),
        F.coalesce(F.nullif(F.col("amount"), F.lit("")), F.lit("0")).alias("amount"),
        F.when(F.col("asset_type") == "native", F.lit("XLM")).otherwise(F.col("asset_code"))
        .alias("asset"),
        parse_time("created_at").alias("created_at"))


# P5 -------------------------------------------------------------------------
_DETAIL_FIELDS = {
    "payment": ["asset_type", "asset_code", "asset_issuer", "from", "to", "amount"],
    "create_account": ["account", "starting_balance", "funder"],
    "manage_sell_offer": ["selling_asset", "buying_asset", "amount", "price", "offer_id"],
    "path_payment_strict_receive": ["from", "to", "amount", "source_amount", "source_max",
                                    "destination_asset", "destination_min", "path"],
    "change_trust": ["asset_type", "asset_code", "asset_issuer", "trustor", "trustee", "limit"],
}


def _field(name: str, df_cols) -> Column:
    c = F.col(f"`{name}`") if name in df_cols else F.lit(None).cast("string")
    return c.alias(name)


def operation_details(raw_ops: DataFrame) -> DataFrame:
    """Type-dispatched details JSON: ``{type, source_account}`` plus the
    type's fields; other types get the base only. Null fields are omitted,
    as ``to_json`` drops nulls."""
    cols = raw_ops.columns
    base = [F.col("type"), F.col("source_account")]
    expr = F.to_json(F.struct(*base))
    for t, fields in reversed(list(_DETAIL_FIELDS.items())):
        expr = F.when(F.col("type") == t, F.to_json(F.struct(*base, *[_field(f, cols) for f in fields]))
                      ).otherwise(expr)
    return raw_ops.withColumn("details", expr)


# P6 -------------------------------------------------------------------------
def curate_transactions(raw: DataFrame) -> DataFrame:
    """24-column transaction row: typed times and fees, memo type default
    ``none``, signatures default [], inner transaction flattened."""
    cols = raw.columns

    def opt(c, dtype="string"):
        return F.col(c) if c in cols else F.lit(None).cast(dtype)

    inner = F.col("inner_transaction") if "inner_transaction" in cols else F.lit(None).cast(
        S.INNER_TRANSACTION)
    return raw.select(
        "id", "paging_token", "successful", "hash",
        F.col("ledger").alias("ledger_sequence"),
        parse_time("created_at").alias("created_at"),
        "source_account", opt("source_account_sequence"), opt("fee_account"),
        F.col("fee_charged").cast("string").try_cast("long").alias("fee_charged"),
        opt("max_fee").cast("string").try_cast("long").alias("max_fee"),
        opt("operation_count", "long").alias("operation_count"),
        opt("envelope_xdr"), opt("result_xdr"), opt("result_meta_xdr"), opt("fee_meta_xdr"),
        E.default_memo(opt("memo_type")).alias("memo_type"), opt("memo"),
        E.default_signatures(opt("signatures", "array<string>")).alias("signatures"),
        parse_time(opt("valid_after")).alias("valid_after"),
        parse_time(opt("valid_before")).alias("valid_before"),
        F.coalesce(opt("fee_bump_transaction", "boolean"), F.lit(False)).alias("fee_bump_transaction"),
        inner.getField("hash").alias("inner_transaction_hash"),
        F.when(inner.isNotNull(), E.default_signatures(inner.getField("signatures")))
        .alias("inner_transaction_signatures"))


# P7 -------------------------------------------------------------------------
def operation_position(op: DataFrame) -> DataFrame:
    """Split ``id`` on '-' into ledger sequence and operation index; ids
    without '-' (or with non-numbers) give nulls and ``position_ok`` false."""
    parts = F.split(F.col("id"), "-")
    seq = F.try_element_at(parts, F.lit(1)).try_cast("long")
    idx = F.try_element_at(parts, F.lit(2)).try_cast("int")
    ok = (F.size(parts) >= 2) & seq.isNotNull() & idx.isNotNull()
    return op.withColumns({
        "id_ledger_sequence": F.when(ok, seq), "id_operation_index": F.when(ok, idx),
        "position_ok": ok})


# P8 -------------------------------------------------------------------------
def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(p[:1].upper() + p[1:] for p in rest)


def api_view(df: DataFrame) -> DataFrame:
    """snake_case -> camelCase column names."""
    return df.withColumnsRenamed({c: _camel(c) for c in df.columns if "_" in c})


# P9 -------------------------------------------------------------------------
def chart_points(m: DataFrame) -> DataFrame:
    """Successful / failed split of each snapshot's transactions, rounded to
    whole transactions; missing count 0, missing rate 100."""
    n = F.coalesce(F.col("transaction_count"), F.lit(0)).cast("decimal(20,0)")
    rate = F.coalesce(F.col("success_rate").cast("decimal(9,4)"), F.lit(100).cast("decimal(9,4)"))
    ok = F.round(n * rate / F.lit(100), 0).cast("long")
    bad = F.round(n * (F.lit(100) - rate) / F.lit(100), 0).cast("long")
    vol = E.to_amount(F.col("total_volume")) if "total_volume" in m.columns else F.lit(None)
    from ledgerlake.operators.common import decimal_text
    return m.select("timestamp", n.cast("long").alias("transactions"), ok.alias("successful_tx"),
                    bad.alias("failed_tx"),
                    decimal_text(F.coalesce(vol, F.lit(0).cast("decimal(28,7)")), 28, 7).alias("volume"))


# P10 ------------------------------------------------------------------------
def ledger_timeline(led: DataFrame) -> DataFrame:
    """total = successful + failed; success % rounded to 1 dp over
    ``max(1, total)``; ascending by sequence."""
    s = F.col("successful_transaction_count")
    f = F.col("failed_transaction_count")
    total = s + f
    return led.select(
        "sequence", "closed_at", total.alias("total_tx"),
        E.ratio_half_up(s, F.greatest(total, F.lit(1)), 1, pct=True).alias("success_rate")
    ).orderBy("sequence")


# P11 ------------------------------------------------------------------------
def ledger_density(led: DataFrame) -> DataFrame:
    total = F.col("successful_transaction_count") + F.col("failed_transaction_count")
    return led.withColumn("density", F.least(total.cast("double") * F.lit(100.0) / F.lit(50.0),
                                             F.lit(100.0)))


# P12 / P13 -------------------------------------------------------------------
def operation_category(op: DataFrame) -> DataFrame:
    cats = F.broadcast(S.operation_category_frame(op.sparkSession))
    return op.join(cats, "type", "left").withColumn(
        "category", F.coalesce(F.col("category"), F.lit("other")))


def operation_label(op: DataFrame) -> DataFrame:
    labels = F.broadcast(S.operation_label_frame(op.sparkSession))
    return op.join(labels, "type", "left").withColumn(
        "label", F.coalesce(F.col("label"), F.col("type")))


# P14 ------------------------------------------------------------------------
ENVELOPE_KINDS = ["ledger", "transaction", "operation", "metrics"]


def event_envelope(df: DataFrame, kind: str, ts: str) -> DataFrame:
    """``{type, data, timestamp}`` JSON envelope per row."""
    if kind not in ENVELOPE_KINDS:
        raise ValueError(f"kind must be one of {ENVELOPE_KINDS}")
    return df.select(F.to_json(F.struct(
        F.lit(kind).alias("type"), F.struct(*[F.col(c) for c in df.columns]).alias("data"),
        F.col(ts).alias("timestamp"))).alias("envelope"))

"""Filters and predicates.

All predicates are plain Column expressions compared against literals, so
Catalyst pushes them into the Parquet scan (``PushedFilters``) and prunes
date partitions where the table is partitioned by day.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake import schemas as S
from ledgerlake.functions import scalar as E
from ledgerlake.operators.common import as_of_column, minus, require_range


def _and(preds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, preds) if preds else F.lit(True)


def _ts_lit(v) -> Column:
    return as_of_column(None, "", v)


# F1 -------------------------------------------------------------------------
def in_time_range(df: DataFrame, col: str, start=None, end=None,
                  partition_col: str = "day") -> DataFrame:
    """Closed interval ``start <= col <= end``; either bound optional. When
    the table is partitioned by ``day`` (see ``sinks.write_fact_table``)
    the same bounds are repeated on the partition column, so whole days
    outside the range are pruned before any file is opened."""
    require_range(start, end)
    preds = []
    prune = partition_col in df.columns
    if start is not None:
        preds.append(F.col(col) >= _ts_lit(start))
        if prune:
            preds.append(F.col(partition_col) >= _ts_lit(start).cast("date"))
    if end is not None:
        preds.append(F.col(col) <= _ts_lit(end))
        if prune:
            preds.append(F.col(partition_col) <= _ts_lit(end).cast("date"))
    return df.where(_and(preds))


# F2 -------------------------------------------------------------------------
def transaction_predicate(successful=None, min_fee=None, max_fee=None, has_memo=None,
                          memo_type=None) -> Column:
    preds = []
    if successful is not None:
        preds.append(F.col("successful") == F.lit(bool(successful)))
    if min_fee is not None:
        preds.append(F.col("fee_charged") >= F.lit(min_fee))
    if max_fee is not None:
        preds.append(F.col("fee_charged") <= F.lit(max_fee))
    if has_memo is not None:
        memo = E.default_memo(F.col("memo_type"))  # null memo type == none
        preds.append(memo != "none" if has_memo else memo == "none")
    if memo_type is not None:
        if memo_type not in S.MEMO_TYPES:
            raise ValueError(f"memo_type must be one of {S.MEMO_TYPES}")
        preds.append(E.default_memo(F.col("memo_type")) == F.lit(memo_type))
    return _and(preds)


def filter_transactions(tx: DataFrame, successful=None, min_fee=None, max_fee=None,
                        has_memo=None, memo_type=None) -> DataFrame:
    """AND of the supplied predicates; only ``None`` skips a bound."""
    return tx.where(transaction_predicate(successful, min_fee, max_fee, has_memo, memo_type))


# F3 -------------------------------------------------------------------------
def filter_operations(op: DataFrame, type=None, successful=None,
                      source_account=None) -> DataFrame:
    preds = []
    if type is not None:
        if type not in S.OPERATION_TYPES:
            raise ValueError(f"unknown operation type {type!r}")
        preds.append(F.col("type") == F.lit(type))
    if successful is not None:
        preds.append(F.col("transaction_successful") == F.lit(bool(successful)))
    if source_account is not None:
        preds.append(F.col("source_account") == F.lit(source_account))
    return op.where(_and(preds))


# F4 -------------------------------------------------------------------------
def filter_accounts(acct: DataFrame, account_id=None, min_balance=None, max_balance=None,
                    is_active=None, account_metrics: DataFrame | None = None) -> DataFrame:
    """Exact id, numeric bounds on the decimal-string balance, and activity
    from each account's latest metrics snapshot."""
    preds = []
    bal = E.to_amount(F.col("balance"))
    if account_id is not None:
        preds.append(F.col("account_id") == F.lit(account_id))
    if min_balance is not None:
        preds.append(bal >= F.lit(str(min_balance)).cast(S.AMOUNT_SUM_INPUT))
    if max_balance is not None:
        preds.append(bal <= F.lit(str(max_balance)).cast(S.AMOUNT_SUM_INPUT))
    out = acct.where(_and(preds))
    if is_active is not None:
        if account_metrics is None:
            raise ValueError("is_active needs account_metrics")
        from ledgerlake.operators.windows import latest_row_per_key
        latest = latest_row_per_key(account_metrics.select("account_id", "timestamp", "is_active"),
                                    "account_id", "timestamp")
        active = latest.where(F.col("is_active") == F.lit(bool(is_active))).select("account_id")
        out = out.join(active, "account_id", "left_semi")
    return out


# F5 -------------------------------------------------------------------------
def check_asset_filter(type=None, code=None, issuer=None) -> None:
    if type is not None and type not in S.ASSET_TYPES:
        raise ValueError(f"asset type must be one of {S.ASSET_TYPES}")
    if type == "native" and (code is not None or issuer is not None):
        raise ValueError("native assets take no code or issuer")
    if (code is None) != (issuer is None) and type != "native":
        raise ValueError("asset code and issuer must be given together")


def asset_predicate(type=None, code=None, issuer=None) -> Column:
    check_asset_filter(type, code, issuer)
    preds = []
    if type is not None:
        preds.append(F.col("asset_type") == F.lit(type))
    if code is not None:
        preds.append(F.col("asset_code") == F.lit(code))
    if issuer is not None:
        preds.append(F.col("asset_issuer") == F.lit(issuer))
    return _and(preds)


def filter_assets(asset: DataFrame, type=None, code=None, issuer=None) -> DataFrame:
    return asset.where(asset_predicate(type, code, issuer))


# F6 -------------------------------------------------------------------------
def filter_ledgers_by_ops(led: DataFrame, min_ops=None, max_ops=None) -> DataFrame:
    preds = []
    if min_ops is not None:
        preds.append(F.col("operation_count") >= F.lit(min_ops))
    if max_ops is not None:
        preds.append(F.col("operation_count") <= F.lit(max_ops))
    return led.where(_and(preds))


# F7 -------------------------------------------------------------------------
def filter_asset_metrics(m: DataFrame, search=None, min_volume=None, max_volume=None,
                         min_holders=None) -> DataFrame:
    """Case-insensitive substring on the code (``XLM`` for native), numeric
    bounds with nulls read as 0."""
    preds = []
    code = F.when(F.col("asset_type") == "native", F.lit("XLM")).otherwise(F.col("asset_code"))
    vol = F.coalesce(E.to_amount(F.col("volume_24h")), F.lit(0).cast(S.AMOUNT_SUM_INPUT))
    if search:
        preds.append(F.lower(code).contains(search.lower()))
    if min_volume is not None:
        preds.append(vol >= F.lit(str(min_volume)).cast(S.AMOUNT_SUM_INPUT))
    if max_volume is not None:
        preds.append(vol <= F.lit(str(max_volume)).cast(S.AMOUNT_SUM_INPUT))
    if min_holders is not None:
        preds.append(F.coalesce(F.col("holders"), F.lit(0)) >= F.lit(min_holders))
    return m.where(_and(preds))


# F8 -------------------------------------------------------------------------
def search_transactions(tx: DataFrame, q: str) -> DataFrame:
    """Case-insensitive substring in hash or source account (whole table)."""
    needle = q.strip().lower()
    return tx.where(F.lower(F.col("hash")).contains(needle)
                    | F.lower(F.col("source_account")).contains(needle))


# F9 -------------------------------------------------------------------------
def search_ledgers(led: DataFrame, q: str) -> DataFrame:
    """Decimal digits of the sequence contain ``q``."""
    return led.where(F.col("sequence").cast("string").contains(q.strip()))


# F10 ------------------------------------------------------------------------
def lookup(df: DataFrame, key: str | list[str], value) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    values = [value] if len(keys) == 1 else list(value)
    return df.where(_and([F.col(k).eqNullSafe(F.lit(v)) for k, v in zip(keys, values)]))


# F11 ------------------------------------------------------------------------
def by_account(tx: DataFrame, address=None, n: int = 10) -> DataFrame:
    from ledgerlake.operators.paging import recent
    out = tx if address is None else tx.where(F.col("source_account") == F.lit(address))
    return recent(out, "created_at", n, "id")


def by_type(op: DataFrame, type=None, n: int = 10) -> DataFrame:
    from ledgerlake.operators.paging import recent
    out = op if type is None else filter_operations(op, type=type)
    return recent(out, "created_at", n, "id")


# F12 ------------------------------------------------------------------------
def preset(name: str, df: DataFrame, as_of=None) -> DataFrame:
    """Saved predicates by name (">1000" and ">50" presets apply ``>=``)."""
    ts = "closed_at" if "closed_at" in df.columns else "created_at"

    def recent(seconds):
        t = as_of_column(df, ts, as_of)
        return (F.col(ts) >= minus(t, seconds)) & (F.col(ts) <= t)

    bal = E.to_amount(F.col("balance")) if "balance" in df.columns else None
    table = {
        "successful": lambda: F.col("successful") == F.lit(True),
        "failed": lambda: F.col("successful") == F.lit(False),
        "with_memo": lambda: E.default_memo(F.col("memo_type")) != "none",
        "high_fee": lambda: F.col("fee_charged") >= F.lit(1000),
        "last_1h": lambda: recent(3600),
        "last_24h": lambda: recent(86400),
        "last_7d": lambda: recent(7 * 86400),
        "busy_ledgers": lambda: F.col("operation_count") >= F.lit(50),
        "high_balance": lambda: bal >= F.lit(10000),
        "low_balance": lambda: bal < F.lit(10),
        "multi_sig": lambda: F.col("num_subentries") > F.lit(1),
        "active": lambda: F.col("is_active") == F.lit(True),
    }
    if name not in table:
        raise ValueError(f"unknown preset {name!r}; known: {sorted(table)}")
    return df.where(table[name]())


PRESETS = ["successful", "failed", "with_memo", "high_fee", "last_1h", "last_24h", "last_7d",
           "busy_ledgers", "high_balance", "low_balance", "multi_sig", "active"]


# F13 ------------------------------------------------------------------------
def not_deleted(df: DataFrame) -> DataFrame:
    if "deleted_at" not in df.columns:
        return df
    return df.where(F.col("deleted_at").isNull())


# F14 ------------------------------------------------------------------------
def payments_only(op: DataFrame) -> DataFrame:
    return op.where(F.col("type") == "payment")


def with_memo(tx: DataFrame) -> DataFrame:
    return tx.where(F.col("memo_type").isNotNull() & (F.col("memo_type") != "none"))


def fee_positive(tx: DataFrame) -> DataFrame:
    return tx.where(F.col("fee_charged") > 0)

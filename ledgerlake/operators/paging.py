"""Sorts, limits, top-k and keyset paging.

Every page is ``orderBy(...).limit(n)``, which Spark plans as
TakeOrderedAndProject: each task keeps its own top ``n`` and only those
rows reach the final merge, so a page never shuffles the table. Cursors are
``(order key, id)`` pairs, so ties on the order key are never skipped or
repeated across page edges.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake import schemas as S
from ledgerlake.functions import scalar as E


# L1 -------------------------------------------------------------------------
def recent(df: DataFrame, ts: str, n: int, id_col: str = "id") -> DataFrame:
    """Newest ``n`` rows, ties broken by id descending."""
    return df.orderBy(F.col(ts).desc(), F.col(id_col).desc()).limit(n)


# L2 / L3 --------------------------------------------------------------------
def _cursor_pred(df: DataFrame, order: str, id_col: str, cursor, before: bool) -> Column:
    """``(order, id) < cursor`` (or ``>``) spelt out as simple comparisons,
    so the bound on ``order`` reaches the Parquet scan as a pushed filter."""
    value, ident = cursor
    v = F.lit(value).cast(df.schema[order].dataType)
    i = F.lit(ident).cast(df.schema[id_col].dataType)
    o, k = F.col(order), F.col(id_col)
    if before:
        return (o < v) | ((o == v) & (k < i))
    return (o > v) | ((o == v) & (k > i))


def page_after(df: DataFrame, order: str, cursor=None, n: int = S.PAGE_SIZE_DEFAULT,
               id_col: str = "id", fetch_extra: bool = True) -> DataFrame:
    """Descending keyset page: rows with ``(order, id) < cursor``. Returns
    ``n + 1`` rows when ``fetch_extra`` so :func:`page_info` can tell if a
    next page exists."""
    check_page_size(n)
    out = df
    if cursor is not None:
        out = out.where(_cursor_pred(df, order, id_col, cursor, before=True))
    return out.orderBy(F.col(order).desc(), F.col(id_col).desc()).limit(n + 1 if fetch_extra else n)


def page_before(df: DataFrame, order: str, cursor=None, n: int = S.PAGE_SIZE_DEFAULT,
                id_col: str = "id", fetch_extra: bool = True) -> DataFrame:
    """Ascending keyset page: rows with ``(order, id) > cursor``; the page
    stays in ascending order."""
    check_page_size(n)
    out = df
    if cursor is not None:
        out = out.where(_cursor_pred(df, order, id_col, cursor, before=False))
    return out.orderBy(F.col(order).asc(), F.col(id_col).asc()).limit(n + 1 if fetch_extra else n)


def check_page_size(n: int) -> None:
    if not (1 <= n <= S.PAGE_SIZE_MAX):
        raise ValueError(f"page size must be between 1 and {S.PAGE_SIZE_MAX}")


# L4 -------------------------------------------------------------------------
def page_info(page: DataFrame, order: str, n: int, id_col: str = "id", cursor_given: bool = False,
              descending: bool = True) -> DataFrame:
    """One row: has_next (``n + 1`` rows fetched), has_previous (a cursor
    was given), start and end cursors of the first ``n`` rows. The page
    holds at most ``n + 1`` ≤ 101 rows."""
    key = F.struct(F.col(order).alias("k"), F.col(id_col).alias("id"))
    agg = page.agg(F.count(F.lit(1)).alias("fetched"), F.collect_list(key).alias("keys"))
    ordered = F.sort_array(F.col("keys"), asc=not descending)
    kept = F.slice(ordered, 1, n)
    return agg.select(
        (F.col("fetched") > n).alias("has_next_page"),
        F.lit(bool(cursor_given)).alias("has_previous_page"),
        F.try_element_at(kept, F.lit(1)).alias("start_cursor"),
        F.try_element_at(kept, F.lit(-1)).alias("end_cursor"))   # last; null when empty


def trim_page(page: DataFrame, order: str, n: int, id_col: str = "id",
              descending: bool = True) -> DataFrame:
    """Drop the look-ahead row fetched by page_after/page_before."""
    o = [F.col(order).desc(), F.col(id_col).desc()] if descending else [F.col(order), F.col(id_col)]
    return page.orderBy(*o).limit(n)


# L6 -------------------------------------------------------------------------
def _sort_fields(entity: str) -> dict[str, Column]:
    table = {
        "transaction": lambda: {
            "createdAt": F.col("created_at"), "feeCharged": F.col("fee_charged"),
            "operationCount": F.col("operation_count"), "ledger": F.col("ledger_sequence")},
        "ledger": lambda: {
            "sequence": F.col("sequence"), "operationCount": F.col("operation_count"),
            "successfulTransactionCount": F.col("successful_transaction_count"),
            "closedAt": F.col("closed_at")},
        "account": lambda: {
            "balance": E.to_amount(F.col("balance")), "numSubentries": F.col("num_subentries"),
            "createdAt": F.col("created_at"), "accountId": F.col("account_id")},
        "asset": lambda: {
            "volume24h": E.to_amount(F.col("volume_24h")), "trades24h": F.col("trades_24h"),
            "holders": F.col("holders"), "priceChange24h": F.col("price_change_24h"),
            "assetCode": F.when(F.col("asset_type") == "native", F.lit("XLM"))
            .otherwise(F.col("asset_code"))},
    }
    return table[entity]()


SORT_FIELD_NAMES = {
    "transaction": ["createdAt", "feeCharged", "operationCount", "ledger"],
    "ledger": ["sequence", "operationCount", "successfulTransactionCount", "closedAt"],
    "account": ["balance", "numSubentries", "createdAt", "accountId"],
    "asset": ["volume24h", "trades24h", "holders", "priceChange24h", "assetCode"],
}
ID_COLUMNS = {"transaction": "id", "ledger": "sequence", "account": "account_id", "asset": "asset_id"}


def sort_by(df: DataFrame, entity: str, field: str | None, direction: str = "desc") -> DataFrame:
    """Whitelisted sort over the whole set; unknown fields keep input order.
    Ties broken by the entity id in the same direction."""
    fields = _sort_fields(entity)
    if field not in fields:
        return df
    key = fields[field]
    idc = F.col(ID_COLUMNS[entity])
    if direction == "asc":
        return df.orderBy(key.asc_nulls_first(), idc.asc())
    return df.orderBy(key.desc_nulls_last(), idc.desc())


# L7 -------------------------------------------------------------------------
def top_assets(m: DataFrame, n: int = 10) -> DataFrame:
    """Top ``n`` assets of the whole set by 24 h volume (ties by asset id)."""
    vol = E.to_amount(F.col("volume_24h"))
    top = m.orderBy(vol.desc_nulls_last(), F.col("asset_id").asc()).limit(n)
    from pyspark.sql import Window
    # ≤ n rows after the limit: numbering them in one partition is bounded.
    return top.withColumn("rank", F.row_number().over(
        Window.orderBy(E.to_amount(F.col("volume_24h")).desc_nulls_last(), F.col("asset_id").asc())))


# L8 -------------------------------------------------------------------------
def latest_ledger(led: DataFrame) -> DataFrame:
    from ledgerlake.operators.aggregates import latest_ledger as _ll
    return _ll(led)


# L9 -------------------------------------------------------------------------
def network_metrics_range(m: DataFrame, start=None, end=None, n: int = 1000) -> DataFrame:
    from ledgerlake.operators.filters import in_time_range
    return recent(in_time_range(m, "timestamp", start, end), "timestamp", n, "sequence")


# L10 ------------------------------------------------------------------------
def account_metrics_range(m: DataFrame, account_id: str, start=None, end=None,
                          n: int = 100) -> DataFrame:
    from ledgerlake.operators.filters import in_time_range
    rows = in_time_range(m.where(F.col("account_id") == F.lit(account_id)), "timestamp", start, end)
    return rows.orderBy(F.col("timestamp").desc()).limit(n)


# L11 ------------------------------------------------------------------------
@dataclass
class Connection:
    """A page of rows, its page info and the filtered total."""
    edges: DataFrame
    page_info: DataFrame
    total_count: DataFrame


def connection(df: DataFrame, order: str, first: int = S.PAGE_SIZE_DEFAULT, after=None,
               last: int | None = None, before=None, id_col: str = "id",
               predicate: Column | None = None) -> Connection:
    """Filter → keyset page (forward with ``first``/``after`` or backward
    with ``last``/``before``) → page info; total counts the filter only."""
    from ledgerlake.operators.aggregates import filtered_count
    rows = df if predicate is None else df.where(predicate)
    if last is not None or before is not None:
        n = last or S.PAGE_SIZE_DEFAULT
        fetched = page_before(rows, order, before, n, id_col)
        info = page_info(fetched, order, n, id_col, before is not None, descending=False)
        edges = trim_page(fetched, order, n, id_col, descending=False)
    else:
        fetched = page_after(rows, order, after, first, id_col)
        info = page_info(fetched, order, first, id_col, after is not None, descending=True)
        edges = trim_page(fetched, order, first, id_col, descending=True)
    edges = edges.withColumn("cursor", F.struct(F.col(order).alias("k"), F.col(id_col).alias("id")))
    return Connection(edges, info, filtered_count(rows))

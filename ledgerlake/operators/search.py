"""Set operations (U1-U4): cross-entity search, archive union, live merge."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake import schemas as S
from ledgerlake.functions import scalar as E
from ledgerlake.operators import filters as FL


def query_kind(q: str) -> str | None:
    """E9 for a single search text: account / transaction / ledger /
    general (``None`` when blank)."""
    v = q.strip()
    if not v:
        return None
    if re.fullmatch(S.ADDRESS_PATTERN.strip("^$"), v):
        return "account"
    if re.fullmatch(S.HASH_PATTERN.strip("^$"), v):
        return "transaction"
    if re.fullmatch(r"\d+", v):
        return "ledger"
    return "general"


def _account_hits(acct: DataFrame, q: str) -> DataFrame:
    return acct.where(F.col("account_id") == F.lit(q.strip())).select(
        F.lit("account").alias("type"), F.col("account_id").alias("id"),
        E.truncate_id(F.col("account_id"), 10, 6, 3).alias("label"),
        F.concat(F.col("balance"), F.lit(" XLM")).alias("sublabel"),
        F.col("account_id").alias("_order"))


def _tx_hits(tx: DataFrame, q: str) -> DataFrame:
    needle = q.strip().lower()
    return tx.where(F.lower(F.col("hash")).contains(needle)).select(
        F.lit("transaction").alias("type"), F.col("hash").alias("id"),
        E.truncate_id(F.col("hash"), 10, 8, 3).alias("label"),
        F.when(F.col("successful"), F.lit("Successful")).otherwise(F.lit("Failed")).alias("sublabel"),
        F.col("created_at").cast("string").alias("_order"))


def _ledger_hits(led: DataFrame, q: str) -> DataFrame:
    return FL.search_ledgers(led, q).select(
        F.lit("ledger").alias("type"), F.col("sequence").cast("string").alias("id"),
        F.concat(F.lit("Ledger #"), F.col("sequence").cast("string")).alias("label"),
        F.format_string("%d txs · %d ops", F.col("successful_transaction_count"),
                        F.col("operation_count")).alias("sublabel"),
        F.lpad(F.col("sequence").cast("string"), 20, "0").alias("_order"))


def _parts(acct, tx, led, q):
    kind = query_kind(q)
    if kind is None:
        return []
    parts = []
    if kind in ("account", "general"):
        parts.append(_account_hits(acct, q))
    if kind in ("transaction", "general"):
        parts.append(_tx_hits(tx, q))
    if kind in ("ledger", "general"):
        parts.append(_ledger_hits(led, q))
    return parts


# U1 -------------------------------------------------------------------------
def global_search(acct: DataFrame, tx: DataFrame, led: DataFrame, q: str,
                  per_type: int = 5) -> DataFrame:
    """Classify ``q`` and union the matching entities as
    (type, id, label, sublabel), newest ``per_type`` per entity type. Each
    part is its own top-k (TakeOrderedAndProject) over the whole table."""
    parts = [p.orderBy(F.col("_order").desc(), F.col("id").desc()).limit(per_type).drop("_order")
             for p in _parts(acct, tx, led, q)]
    if not parts:
        return acct.sparkSession.createDataFrame(
            [], "type string, id string, label string, sublabel string")
    return reduce(lambda a, b: a.unionByName(b), parts)


# U2 -------------------------------------------------------------------------
def search_page(acct: DataFrame, tx: DataFrame, led: DataFrame, q: str, successful=None,
                has_memo=None):
    """All matches (no per-type cap) with transaction filters applied, and
    the count per type. Returns ``(rows, counts)``."""
    tx_f = FL.filter_transactions(tx, successful=successful, has_memo=has_memo)
    parts = [p.drop("_order") for p in _parts(acct, tx_f, led, q)]
    if not parts:
        empty = acct.sparkSession.createDataFrame(
            [], "type string, id string, label string, sublabel string")
        return empty, empty.groupBy("type").agg(F.count(F.lit(1)).alias("matches"))
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    return rows, rows.groupBy("type").agg(F.count(F.lit(1)).alias("matches"))


# U3 -------------------------------------------------------------------------
def archive_union(live: DataFrame, archive: DataFrame, key: str | list[str]) -> DataFrame:
    """Full history = live ∪ archive, one row per key; the live copy wins.
    ``min_by`` over (key) is a partial aggregate, so repeated keys
    collapse map-side."""
    keys = [key] if isinstance(key, str) else list(key)
    both = (live.withColumn("_src", F.lit(0))
            .unionByName(archive.withColumn("_src", F.lit(1)), allowMissingColumns=True))
    rest = [c for c in both.columns if c not in keys and c != "_src"]
    return (both.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col("_src")).alias("_r"))
            .select(*keys, "_r.*"))


# U4 -------------------------------------------------------------------------
def merge_live(page: DataFrame, new_rows: DataFrame, key: str, ts: str) -> DataFrame:
    """New rows not already on the page go in front (newest first); on a
    duplicate key the existing row wins. ``live_rank`` gives the order.

    Contract: ``page`` is one page (≤ 100 rows) and ``new_rows`` one poll
    (≤ 20 rows); the rank is numbered over that merged list in a single
    partition, which is only appropriate for inputs of that size."""
    fresh = new_rows.join(page.select(key), key, "left_anti").withColumn("_g", F.lit(0))
    merged = fresh.unionByName(page.withColumn("_g", F.lit(1)), allowMissingColumns=True)
    w = Window.orderBy(F.col("_g"), F.col(ts).desc(), F.col(key).desc())
    return merged.withColumn("live_rank", F.row_number().over(w)).drop("_g")


def merge_live_connection(page: DataFrame, page_info: DataFrame, new_rows: DataFrame,
                          new_info: DataFrame, key: str, ts: str):
    """U4 for a whole connection: rows merged as in :func:`merge_live`, and
    the page info taken from the newer side. Returns ``(rows, info)``."""
    return merge_live(page, new_rows, key, ts), new_info

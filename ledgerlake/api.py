"""Public operator surface, indexed by the inventory IDs (S, P, F, J, A, W,
L, U, E, Q, T, M). ``OPERATORS[id]`` is the function implementing it; all
take and return DataFrames (or Columns for the E transforms)."""

from __future__ import annotations

from ledgerlake.functions import scalar as E
from ledgerlake.operators import aggregates as A
from ledgerlake.operators import filters as F_
from ledgerlake.operators import joins as J
from ledgerlake.operators import maintain as M
from ledgerlake.operators import paging as L
from ledgerlake.operators import project as P
from ledgerlake.operators import quality as Q
from ledgerlake.operators import search as U
from ledgerlake.operators import windows as W
from ledgerlake.sources import raw as SRC
from ledgerlake.sources import sinks as SNK
from ledgerlake.streaming import jobs as T
from ledgerlake.streaming import rolling as R

OPERATORS = {
    # sources and sinks
    "S1": SRC.read_raw, "S2": SRC.read_sequence_range, "S3": SRC.read_stream,
    "S4": SNK.upsert_table, "S5": SNK.insert_ignore_table, "S6": SNK.write_batch,
    "S7": SNK.append_snapshot, "S8": SNK.export_csv, "S9": SNK.export_json,
    "S10": SNK.with_batch_metrics,
    # projections
    "P1": P.normalize_ledgers, "P2": P.normalize_transactions, "P3": P.normalize_operations,
    "P4": P.normalize_payments, "P5": P.operation_details, "P6": P.curate_transactions,
    "P7": P.operation_position, "P8": P.api_view, "P9": P.chart_points, "P10": P.ledger_timeline,
    "P11": P.ledger_density, "P12": P.operation_category, "P13": P.operation_label,
    "P14": P.event_envelope,
    # filters
    "F1": F_.in_time_range, "F2": F_.filter_transactions, "F3": F_.filter_operations,
    "F4": F_.filter_accounts, "F5": F_.filter_assets, "F6": F_.filter_ledgers_by_ops,
    "F7": F_.filter_asset_metrics, "F8": F_.search_transactions, "F9": F_.search_ledgers,
    "F10": F_.lookup, "F11": F_.by_account, "F12": F_.preset, "F13": F_.not_deleted,
    "F14": F_.payments_only,
    # joins
    "J1": J.operations_for_ledgers, "J2": J.with_operations, "J3": J.with_transactions,
    "J4": J.aligned_lookup, "J5": J.latest_per_entity, "J6": J.unprocessed, "J7": J.processed_only,
    "J8": J.orphans, "J9": J.cascade_delete, "J10": J.asset_metrics_view, "J11": J.account_profile,
    "J12": J.trustline_holdings, "J13": J.since_row,
    # aggregations
    "A1": A.table_totals, "A2": A.active_accounts, "A3": A.payment_volume, "A4": A.average_fee,
    "A5": A.success_rate, "A6": A.stats_summary, "A7": A.account_stats, "A8": A.network_overview,
    "A9": A.asset_volume, "A10": A.top_accounts, "A11": A.daily_transaction_count,
    "A12": A.operation_distribution, "A13": A.average_close_time, "A14": A.metrics_summary,
    "A15": A.asset_totals, "A16": A.retention_status, "A17": A.filtered_count,
    "A18": A.build_asset_metrics, "A19": A.build_account_metrics, "A20": A.duration_summary,
    "A21": A.duration_histogram, "A22": A.event_counters, "A23": A.daily_counters,
    "A24": A.pipeline_health, "A25": A.duplicate_keys, "A26": A.network_report,
    # window semantics
    "W1": W.network_metrics, "W2": W.latest_row_per_key, "W3": W.ledger_close_times,
    "W4": W.trend, "W5": W.scale_to_max, "W6": W.recent_distinct, "W7": W.multi_horizon,
    "W8": W.percentage_change, "W7.daily": W.rolling_daily,
    # sorting and paging
    "L1": L.recent, "L2": L.page_after, "L3": L.page_before, "L4": L.page_info, "L6": L.sort_by,
    "L7": L.top_assets, "L8": L.latest_ledger, "L9": L.network_metrics_range,
    "L10": L.account_metrics_range, "L11": L.connection,
    # set operations
    "U1": U.global_search, "U2": U.search_page, "U3": U.archive_union, "U4": U.merge_live,
    # column transforms
    "E1": E.json_decimal, "E2": E.to_amount, "E3": E.asset_key, "E4": E.stroops_to_units,
    "E5": E.truncate_id, "E6": E.duration_text, "E8": E.is_address, "E9": E.identifier_kind,
    "E10": E.ratio_half_up, "E11": E.day_text, "E12": E.range_seconds, "E14": E.encode_cursor,
    "E17": E.backoff_ms, "E18": E.default_memo,
    # data quality
    "Q1": Q.validate_ledgers, "Q2": Q.validate_transactions, "Q3": Q.validate_operations,
    "Q4": Q.split_valid, "Q5": Q.validation_report, "Q6": Q.integrity_report,
    "Q7": Q.constraint_report,
    # streaming
    "T1": T.ingest_ledger_units, "T2": T.drop_late, "T3": T.idempotent_marks, "T4": T.incremental_poll,
    "T5": T.route_channels, "T6": T.subscribe, "T7": T.live_totals, "T8": R.rolling_network_metrics,
    "T9": T.batch_summary, "T10": T.dedupe_stream, "T11": T.rate_cap, "T12": T.dead_letters,
    "T13": T.ready_for_retry,
    # maintenance
    "M1": M.plan_backfill, "M2": M.run_backfill, "M3": M.last_processed, "M4": M.backfill_progress,
    "M5": M.backfill_result, "M6": M.apply_retention, "M7": M.retention_report,
    "M8": M.soft_delete, "M9": M.touch_updated,
}

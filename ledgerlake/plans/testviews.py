"""Stand-in ledger tables built from the driver's test tables.

The driver ships TPC-H-like tables plus an ``events`` stream. These views
only rename and retype their columns into the ledger schemas the operators
expect (see SURVEY §7.3); they do none of an operator's work. Each view is
one SQL text with a few dialect hooks, so Spark and the DuckDB oracle read
exactly the same rows.

Two families:

* events  -> sub-day facts: ``tx_events``, ``op_events``, ``ledgers_events``,
  ``raw_ops_events`` (hourly ledgers; one operation per transaction).
* orders / lineitem -> day-grain facts for the big joins: ``tx_orders``,
  ``op_lineitem``, ``ledgers_orders``, ``raw_tx_orders``; dimensions
  ``accounts`` (customer), ``assets`` (part), ``trustlines`` (lineitem).
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.operators.quality import dealt_tasks

BASE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders",
               "lineitem", "events"]


@dataclass(frozen=True)
class Dialect:
    name: str

    def epoch_us(self, x: str) -> str:
        if self.name == "spark":
            # calendar fields of the NTZ value: no session time zone involved
            return (f"(CAST(unix_date(CAST({x} AS DATE)) AS BIGINT) * 86400000000"
                    f" + CAST(hour({x}) AS BIGINT) * 3600000000 + CAST(minute({x}) AS BIGINT) * 60000000"
                    f" + CAST(date_part('SECOND', {x}) * 1000000 AS BIGINT))")
        return f"epoch_us({x})"

    def idiv(self, a: str, b: str) -> str:
        return f"(({a}) DIV ({b}))" if self.name == "spark" else f"(({a}) // ({b}))"

    def iso(self, ts: str) -> str:
        # ISO-8601 UTC text from the NTZ value's own text (no zone conversion)
        if self.name == "spark":
            return f"concat(replace(CAST({ts} AS STRING), ' ', 'T'), 'Z')"
        return f"(replace(CAST({ts} AS VARCHAR), ' ', 'T') || 'Z')"

    def q(self, ident: str) -> str:
        return f"`{ident}`" if self.name == "spark" else f'"{ident}"'

    def dec_text(self, expr: str, precision: int, scale: int) -> str:
        """Plain decimal text in both engines (see ``common.decimal_text``)."""
        if self.name == "spark" and scale >= 7:
            mask = "9" * (precision - scale - 1) + "0." + "0" * scale
            d = f"CAST({expr} AS DECIMAL({precision},{scale}))"
            return (f"CASE WHEN {d} < 0 THEN concat('-', trim(to_char(abs({d}), '{mask}'))) "
                    f"ELSE trim(to_char(abs({d}), '{mask}')) END")
        cast = "STRING" if self.name == "spark" else "VARCHAR"
        return f"CAST(CAST({expr} AS DECIMAL({precision},{scale})) AS {cast})"

    def array(self, *items: str) -> str:
        fn = "array" if self.name == "spark" else "list_value"
        return f"{fn}({', '.join(items)})"

    def asset(self, kind: str, code: str, issuer: str) -> str:
        if self.name == "spark":
            return f"named_struct('asset_type', {kind}, 'asset_code', {code}, 'asset_issuer', {issuer})"
        return f"{{'asset_type': {kind}, 'asset_code': {code}, 'asset_issuer': {issuer}}}"

    def json_int(self, doc: str, field: str) -> str:
        if self.name == "spark":
            return f"CAST(get_json_object({doc}, '$.{field}') AS BIGINT)"
        return f"CAST(json_extract_string({doc}, '$.{field}') AS BIGINT)"


SPARK = Dialect("spark")
DUCK = Dialect("duckdb")

# Event type -> operation type for the events family (fixed stand-in rule).
EVENT_OP_TYPE = """CASE event_type
      WHEN 'purchase' THEN 'payment'
      WHEN 'click' THEN 'path_payment_strict_send'
      WHEN 'view' THEN 'path_payment_strict_receive'
      WHEN 'signup' THEN 'create_account'
      ELSE 'manage_sell_offer' END"""

# (return flag, line status) -> operation type for the lineitem family.
LINEITEM_OP_TYPE = """CASE
      WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'payment'
      WHEN l_returnflag = 'A' THEN 'path_payment_strict_receive'
      WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'create_account'
      WHEN l_returnflag = 'N' THEN 'manage_sell_offer'
      WHEN l_linestatus = 'F' THEN 'change_trust'
      ELSE 'invoke_host_function' END"""

# Order priority -> memo type ('5-LOW' has no memo recorded at all).
ORDER_MEMO_TYPE = """CASE o_orderpriority
      WHEN '1-URGENT' THEN 'text'
      WHEN '2-HIGH' THEN 'id'
      WHEN '3-MEDIUM' THEN 'hash'
      WHEN '4-NOT SPECIFIED' THEN 'none'
      ELSE NULL END"""


def _views(d: Dialect) -> dict[str, str]:
    hour = d.idiv(d.epoch_us("ts"), "3600000000")
    day_o = d.idiv(d.epoch_us("o_orderdate"), "86400000000")
    day_l = d.idiv(d.epoch_us("l_shipdate"), "86400000000")
    v: dict[str, str] = {}
    v["tx_events"] = f"""
    SELECT CAST(event_id AS STRING) AS id,
           CAST(event_id AS STRING) AS paging_token,
           CAST(event_id AS STRING) AS hash,
           CAST({hour} AS BIGINT) AS ledger_sequence,
           ts AS created_at,
           CAST(user_id AS STRING) AS source_account,
           CAST(round(value * 100) AS BIGINT) AS fee_charged,
           event_type <> 'error' AS successful,
           CAST(1 AS BIGINT) AS operation_count,
           CASE WHEN event_type IN ('purchase', 'signup') THEN 'text' ELSE 'none' END AS memo_type
    FROM {{events}}"""
    v["op_events"] = f"""
    SELECT CAST(event_id AS STRING) AS id,
           CAST(event_id AS STRING) AS paging_token,
           CAST(event_id AS STRING) AS transaction_hash,
           event_type <> 'error' AS transaction_successful,
           {EVENT_OP_TYPE} AS type,
           ts AS created_at,
           CAST(user_id AS STRING) AS source_account,
           CAST({hour} AS BIGINT) AS ledger_sequence,
           1 AS operation_index,
           concat('{{"amount":"', {d.dec_text("value", 18, 2)}, '"}}') AS details
    FROM {{events}}"""
    v["ledgers_events"] = f"""
    SELECT CAST({hour} AS STRING) AS id,
           CAST({hour} AS STRING) AS hash,
           CAST({hour} AS BIGINT) AS sequence,
           CAST(count_if(event_type <> 'error') AS BIGINT) AS successful_transaction_count,
           CAST(count_if(event_type = 'error') AS BIGINT) AS failed_transaction_count,
           CAST(count(*) AS BIGINT) AS operation_count,
           CAST(count(*) AS BIGINT) AS tx_set_operation_count,
           max(ts) AS closed_at
    FROM {{events}}
    GROUP BY {hour}"""
    v["raw_ops_events"] = f"""
    SELECT CAST(event_id AS STRING) AS id,
           CAST(event_id AS STRING) AS paging_token,
           lpad(lower(hex(event_id)), 64, '0') AS transaction_hash,
           event_type <> 'error' AS transaction_successful,
           {EVENT_OP_TYPE} AS type,
           {d.iso("ts")} AS created_at,
           CAST(user_id AS STRING) AS source_account,
           CASE WHEN event_type IN ('purchase', 'click', 'view') THEN CAST(user_id AS STRING) END AS {d.q("from")},
           CASE WHEN event_type IN ('purchase', 'click', 'view')
                THEN CAST({d.json_int("props", "k")} AS STRING) END AS {d.q("to")},
           CASE WHEN event_type IN ('purchase', 'click', 'view')
                THEN {d.dec_text("value", 18, 2)} END AS amount,
           CASE event_type WHEN 'purchase' THEN 'native'
                WHEN 'click' THEN 'credit_alphanum4'
                WHEN 'view' THEN 'credit_alphanum12' END AS asset_type,
           CASE event_type WHEN 'click' THEN 'USDC' WHEN 'view' THEN 'EURSTABLE' END AS asset_code,
           CASE WHEN event_type IN ('click', 'view') THEN 'ISSUER' END AS asset_issuer,
           CASE WHEN event_type IN ('click', 'view')
                THEN {d.dec_text("value", 18, 2)} END AS source_amount,
           CASE WHEN event_type = 'view' THEN {d.dec_text("value * 2", 18, 2)} END AS source_max,
           CASE WHEN event_type = 'view' THEN 'native' END AS destination_asset,
           CASE WHEN event_type = 'view' THEN {d.dec_text("value", 18, 2)} END AS destination_min,
           CASE WHEN event_type = 'view' THEN {d.array(d.asset("'credit_alphanum4'", "'USDC'", "'ISSUER'"))} END AS path,
           CASE WHEN event_type = 'signup' THEN CAST(user_id AS STRING) END AS account,
           CASE WHEN event_type = 'signup' THEN CAST({d.json_int("props", "k")} AS STRING) END AS funder,
           CASE WHEN event_type = 'signup' THEN {d.dec_text("value", 18, 2)} END AS starting_balance,
           CASE WHEN event_type = 'error' THEN CAST(event_id AS STRING) END AS offer_id,
           CASE WHEN event_type = 'error' THEN {d.dec_text("value", 18, 2)} END AS price,
           CASE WHEN event_type = 'error' THEN 'native' END AS selling_asset,
           CASE WHEN event_type = 'error' THEN 'USDC' END AS buying_asset,
           CASE WHEN event_type = 'error' THEN 'native' END AS selling_asset_type,
           CASE WHEN event_type = 'error' THEN 'credit_alphanum4' END AS buying_asset_type,
           CAST(NULL AS STRING) AS {d.q("limit")},
           CAST(NULL AS STRING) AS trustor,
           CAST(NULL AS STRING) AS trustee
    FROM {{events}}"""
    v["tx_orders"] = f"""
    SELECT CAST(o_orderkey AS STRING) AS id,
           CAST(o_orderkey AS STRING) AS paging_token,
           CAST(o_orderkey AS STRING) AS hash,
           CAST({day_o} AS BIGINT) AS ledger_sequence,
           o_orderdate AS created_at,
           CAST(o_custkey AS STRING) AS source_account,
           CAST(round(o_totalprice * 100) AS BIGINT) AS fee_charged,
           o_orderstatus <> 'F' AS successful,
           {ORDER_MEMO_TYPE} AS memo_type
    FROM {{orders}}"""
    v["op_lineitem"] = f"""
    SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS id,
           concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS paging_token,
           CAST(l_orderkey AS STRING) AS transaction_hash,
           l_linestatus = 'F' AS transaction_successful,
           {LINEITEM_OP_TYPE} AS type,
           l_shipdate AS created_at,
           CAST(l_suppkey AS STRING) AS source_account,
           CAST({day_l} AS BIGINT) AS ledger_sequence,
           l_linenumber AS operation_index,
           l_partkey AS asset_id,
           CAST(l_quantity AS DOUBLE) AS quantity,
           concat('{{"amount":"', {d.dec_text("l_extendedprice", 18, 2)}, '"}}') AS details
    FROM {{lineitem}}"""
    v["ledgers_orders"] = f"""
    SELECT CAST({day_o} AS STRING) AS id,
           CAST({day_o} AS STRING) AS hash,
           CAST({day_o} AS BIGINT) AS sequence,
           CAST(count_if(o_orderstatus <> 'F') AS BIGINT) AS successful_transaction_count,
           CAST(count_if(o_orderstatus = 'F') AS BIGINT) AS failed_transaction_count,
           CAST(count(*) AS BIGINT) AS operation_count,
           CAST(count(*) AS BIGINT) AS tx_set_operation_count,
           max(o_orderdate) AS closed_at
    FROM {{orders}}
    GROUP BY {day_o}"""
    v["accounts"] = f"""
    SELECT CAST(c_custkey AS STRING) AS account_id,
           {d.dec_text("c_acctbal", 18, 2)} AS balance,
           'native' AS asset_type,
           CAST(c_nationkey AS BIGINT) AS num_subentries,
           c_mktsegment AS home_domain,
           CAST(c_custkey AS STRING) AS sequence_number
    FROM {{customer}}"""
    v["assets"] = """
    SELECT p_partkey AS id,
           CASE WHEN length(concat('P', CAST(p_partkey AS STRING))) <= 4
                THEN 'credit_alphanum4' ELSE 'credit_alphanum12' END AS asset_type,
           concat('P', CAST(p_partkey AS STRING)) AS asset_code,
           p_brand AS asset_issuer,
           false AS native
    FROM {part}"""
    v["trustlines"] = """
    SELECT CAST(l_suppkey AS STRING) AS account_id,
           l_partkey AS asset_id,
           CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(28,7)) AS balance
    FROM {lineitem}
    GROUP BY l_suppkey, l_partkey"""
    v["raw_tx_orders"] = f"""
    SELECT CAST(o_orderkey AS STRING) AS id,
           CAST(o_orderkey AS STRING) AS paging_token,
           o_orderstatus <> 'F' AS successful,
           CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW'
                THEN lower(hex(o_orderkey))
                ELSE lpad(lower(hex(o_orderkey)), 64, '0') END AS hash,
           CAST({day_o} AS BIGINT) AS ledger,
           {d.iso("o_orderdate")} AS created_at,
           concat('G', rpad(translate(CAST(o_custkey AS STRING), '0123456789', 'ABCDEFGHIJ'), 55, 'A')) AS source_account,
           CAST(o_orderkey AS STRING) AS source_account_sequence,
           CAST(NULL AS STRING) AS fee_account,
           CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS STRING) AS fee_charged,
           CAST(CAST(round(o_totalprice * 200) AS BIGINT) AS STRING) AS max_fee,
           CAST(1 AS BIGINT) AS operation_count,
           'AAAA' AS envelope_xdr,
           'AAAA' AS result_xdr,
           'AAAA' AS result_meta_xdr,
           'AAAA' AS fee_meta_xdr,
           {ORDER_MEMO_TYPE} AS memo_type,
           CAST(NULL AS STRING) AS memo,
           {d.array("concat('sig', CAST(o_orderkey AS STRING))")} AS signatures
    FROM {{orders}}"""
    v["raw_ledgers_orders"] = f"""
    SELECT CAST({day_o} AS STRING) AS id,
           CAST({day_o} AS STRING) AS paging_token,
           lpad(lower(hex({day_o})), 64, '0') AS hash,
           CAST({day_o} AS BIGINT) AS sequence,
           CAST(count_if(o_orderstatus <> 'F') AS BIGINT) AS successful_transaction_count,
           CAST(count_if(o_orderstatus = 'F') AS BIGINT) AS failed_transaction_count,
           CAST(count(*) AS BIGINT) AS operation_count,
           CAST(count(*) AS BIGINT) AS tx_set_operation_count,
           {d.iso("max(o_orderdate)")} AS closed_at,
           {d.dec_text("sum(CAST(o_totalprice AS DECIMAL(18,2)))", 38, 7)} AS total_coins,
           '0.0000000' AS fee_pool,
           CAST(100 AS BIGINT) AS base_fee_in_stroops,
           CAST(5000000 AS BIGINT) AS base_reserve_in_stroops,
           CAST(1000 AS BIGINT) AS max_tx_set_size,
           CAST(20 AS BIGINT) AS protocol_version,
           'AAAA' AS header_xdr
    FROM {{orders}}
    GROUP BY {day_o}"""
    v["processed_orders"] = f"""
    SELECT CAST({day_o} AS BIGINT) AS sequence,
           max(o_orderdate) AS processed_at,
           CAST(count(*) AS BIGINT) AS tx_count,
           CAST(count(*) AS BIGINT) AS op_count
    FROM {{orders}}
    WHERE o_orderdate < TIMESTAMP '1997-01-01 00:00:00'
    GROUP BY {day_o}"""
    v["failure_log"] = f"""
    SELECT CAST({hour} AS BIGINT) AS sequence, ts AS failed_at, props AS error
    FROM {{events}} WHERE event_type = 'error'"""
    v["success_log"] = f"""
    SELECT CAST({hour} AS BIGINT) AS sequence, ts AS succeeded_at
    FROM {{events}} WHERE event_type <> 'error'"""
    v["op_log"] = f"""
    SELECT CAST(event_id AS STRING) AS id,
           ts AS logged_at,
           ts,
           CAST(value AS DECIMAL(18,2)) AS duration_ms,
           CAST(value AS DECIMAL(18,2)) AS duration_s,
           concat('SELECT *   FROM ', event_type, '  WHERE   k = ', props) AS query_text,
           event_type AS name,
           CASE WHEN value >= 50 THEN 'large' ELSE 'small' END AS label,
           event_type AS pipeline,
           ts AS cycle_at,
           event_id AS source_sequence,
           event_id - {d.json_int("props", "k")} AS processed_sequence,
           value >= 5 AS ok
    FROM {{events}}"""
    return v


def view_sql(name: str, dialect: Dialect, tables: dict[str, str] | None = None) -> str:
    """SQL text of one view, with base-table placeholders resolved."""
    text = _views(dialect)[name]
    for t in BASE_TABLES:
        text = text.replace("{" + t + "}", (tables or {}).get(t, t))
    return text


VIEW_NAMES = list(_views(SPARK).keys())

# Views with about a group for each row of a table: the table, the grouping
# columns, the columns that the view reads.
BY_ROW_GROUPS = {"trustlines": ("lineitem", "l_suppkey, l_partkey", "l_suppkey, l_partkey, l_quantity")}


def duck_cte(*names: str) -> str:
    """``WITH`` clause defining the named views for the DuckDB oracle."""
    return "WITH " + ",\n".join(f"{n} AS ({view_sql(n, DUCK)})" for n in names) + "\n"


class TestTables:
    """Driver tables of one scale-factor folder, exposed as ledger views."""

    __test__ = False  # not a pytest test class

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        tag = hashlib.md5(self.sf_dir.encode()).hexdigest()[:8]
        self._names = {t: f"ll_{t}_{tag}" for t in BASE_TABLES}
        self._cache: dict[str, DataFrame] = {}

    def base(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")

    def _register(self, table: str) -> None:
        name = self._names[table]
        if not self.spark.catalog.tableExists(name):
            self.base(table).createOrReplaceTempView(name)

    def rows(self, *tables: str) -> list[int]:
        """Rows of stored tables, from the footers of their files."""
        counts = [self.base(t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("i"), "n")
                  for i, t in enumerate(tables)]
        return [r["n"] for r in sorted(reduce(DataFrame.unionByName, counts).collect())]

    def _grouped_by(self, name: str) -> dict[str, str]:
        """Names of the stored tables in a view's text. Where the groups of a
        view are as many as the rows of a large table, the rows are dealt by
        group first: the memory of a task does not grow with the table."""
        names = dict(self._names)
        if name in BY_ROW_GROUPS:
            table, keys, columns = BY_ROW_GROUPS[name]
            if tasks := dealt_tasks(self.spark, self.rows(table)[0]):
                names[table] = f"(SELECT /*+ REPARTITION({tasks}, {keys}) */ {columns} FROM {names[table]})"
        return names

    def view(self, name: str) -> DataFrame:
        if name not in self._cache:
            text = _views(SPARK)[name]
            for t in BASE_TABLES:
                if "{" + t + "}" in text:
                    self._register(t)
            self._cache[name] = self.spark.sql(view_sql(name, SPARK, self._grouped_by(name)))
        return self._cache[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in VIEW_NAMES:
            raise AttributeError(name)
        return self.view(name)

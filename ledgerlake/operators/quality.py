"""Data quality (Q1-Q7, with J8 and A25 reused by the integrity report).

Each entity's checks are a list of rules ``(field, check, message)``; a
record's ``errors`` column is the ordered list of ``"field: message"`` texts
of the rules it breaks, computed with native ``when`` expressions in one
projection (no UDF). Operation rules are type-dispatched: the extra checks
for payments, path payments and account creation only fire for their type.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake import schemas as S
from ledgerlake.sources.raw import line_starts

# check kinds: required, nonempty, gt0, ge0, iso, numeric, hash, address,
# address_or_null, bool
LEDGER_RULES = [
    ("id", "nonempty", "must be a non-empty string"),
    ("paging_token", "nonempty", "must be a non-empty string"),
    ("sequence", "gt0", "must be a positive integer"),
    ("successful_transaction_count", "ge0", "must be a non-negative integer"),
    ("failed_transaction_count", "ge0", "must be a non-negative integer"),
    ("operation_count", "ge0", "must be a non-negative integer"),
    ("tx_set_operation_count", "ge0", "must be a non-negative integer"),
    ("closed_at", "iso", "must be an ISO date-time with offset"),
    ("total_coins", "numeric", "Expected a numeric string"),
    ("fee_pool", "numeric", "Expected a numeric string"),
    ("base_fee_in_stroops", "ge0", "must be a non-negative integer"),
    ("base_reserve_in_stroops", "ge0", "must be a non-negative integer"),
    ("max_tx_set_size", "gt0", "must be a positive integer"),
    ("protocol_version", "ge0", "must be a non-negative integer"),
    ("header_xdr", "nonempty", "must be a non-empty string"),
]

TRANSACTION_RULES = [
    ("id", "nonempty", "must be a non-empty string"),
    ("paging_token", "nonempty", "must be a non-empty string"),
    ("successful", "required", "Required"),
    ("hash", "hash", "Invalid transaction hash"),
    ("ledger", "gt0", "must be a positive integer"),
    ("created_at", "iso", "must be an ISO date-time with offset"),
    ("source_account", "address", "Invalid account address"),
    ("source_account_sequence", "nonempty", "must be a non-empty string"),
    ("fee_account", "address_or_null", "Invalid account address"),
    ("fee_charged", "required", "Required"),
    ("max_fee", "required", "Required"),
    ("operation_count", "ge0", "must be a non-negative integer"),
    ("envelope_xdr", "nonempty", "must be a non-empty string"),
    ("result_xdr", "nonempty", "must be a non-empty string"),
    ("result_meta_xdr", "nonempty", "must be a non-empty string"),
    ("fee_meta_xdr", "nonempty", "must be a non-empty string"),
    ("signatures", "required", "Required"),
    ("inner_transaction.hash", "hash_if_parent", "Invalid transaction hash"),
    ("inner_transaction.signatures", "required_if_parent", "Required"),
]

OPERATION_BASE_RULES = [
    ("id", "nonempty", "must be a non-empty string"),
    ("paging_token", "nonempty", "must be a non-empty string"),
    ("transaction_hash", "hash", "Invalid transaction hash"),
    ("transaction_successful", "required", "Required"),
    ("type", "nonempty", "must be a non-empty string"),
    ("created_at", "iso", "must be an ISO date-time with offset"),
    ("source_account", "address", "Invalid account address"),
]
_PAYMENT_EXTRA = [
    ("from", "address", "Invalid account address"),
    ("to", "address", "Invalid account address"),
    ("amount", "numeric", "Expected a numeric string"),
    ("asset_type", "nonempty", "must be a non-empty string"),
    ("asset_issuer", "address_or_null", "Invalid account address"),
]
OPERATION_TYPE_RULES = {
    "payment": _PAYMENT_EXTRA,
    "path_payment_strict_receive": _PAYMENT_EXTRA + [
        ("source_amount", "numeric", "Expected a numeric string")],
    "path_payment_strict_send": _PAYMENT_EXTRA + [
        ("source_amount", "numeric", "Expected a numeric string")],
    "create_account": [
        ("account", "address", "Invalid account address"),
        ("funder", "address", "Invalid account address"),
        ("starting_balance", "numeric", "Expected a numeric string"),
    ],
}

RULES = {"ledger": LEDGER_RULES, "transaction": TRANSACTION_RULES}


def _col(field: str) -> Column:
    return F.col(".".join(f"`{p}`" for p in field.split(".")))


def broken(field: str, kind: str, df_cols: list[str]) -> Column:
    """True when the value breaks the rule (missing columns count as null)."""
    top = field.split(".")[0]
    c = _col(field) if top in df_cols else F.lit(None)
    if kind == "required":
        return c.isNull()
    if kind == "nonempty":
        return c.isNull() | (F.length(c.cast("string")) < 1)
    if kind == "gt0":
        return c.isNull() | ~(c.cast("long") > 0)
    if kind == "ge0":
        return c.isNull() | ~(c.cast("long") >= 0)
    if kind == "iso":
        return ~F.coalesce(c.rlike(S.ISO_WITH_OFFSET_PATTERN), F.lit(False))
    if kind == "numeric":
        return ~F.coalesce(c.rlike(S.NUMERIC_STRING_PATTERN), F.lit(False))
    if kind == "hash":
        return ~F.coalesce(c.rlike(S.HASH_PATTERN), F.lit(False))
    if kind == "address":
        return ~F.coalesce(c.rlike(S.ADDRESS_PATTERN), F.lit(False))
    if kind == "address_or_null":
        return c.isNotNull() & ~F.coalesce(c.rlike(S.ADDRESS_PATTERN), F.lit(False))
    if kind == "hash_if_parent":
        parent = F.col(f"`{top}`") if top in df_cols else F.lit(None)
        return parent.isNotNull() & ~F.coalesce(c.rlike(S.HASH_PATTERN), F.lit(False))
    if kind == "required_if_parent":
        parent = F.col(f"`{top}`") if top in df_cols else F.lit(None)
        return parent.isNotNull() & c.isNull()
    raise ValueError(kind)


def _errors(df: DataFrame, rules, guard: Column | None = None) -> list[Column]:
    out = []
    for field, kind, msg in rules:
        cond = broken(field, kind, df.columns)
        if guard is not None:
            cond = guard & cond
        out.append(F.when(cond, F.lit(f"{field}: {msg}")))
    return out


SEP = "\u001f"   # unit separator: never part of a message


def _rule_list(entity: str):
    """``(field, kind, message, type_guard)`` for every rule of an entity."""
    if entity in ("operation", "payment"):
        out = [(f, k, m, None) for f, k, m in OPERATION_BASE_RULES]
        for t, rules in OPERATION_TYPE_RULES.items():
            out += [(f, k, m, t) for f, k, m in rules]
        return out
    return [(f, k, m, None) for f, k, m in RULES[entity]]


OPTIONAL_KINDS = {"address_or_null", "hash_if_parent", "required_if_parent"}


def _value(field: str, df_cols) -> Column:
    top = field.split(".")[0]
    return _col(field) if top in df_cols else F.lit(None)


def _conditions(df: DataFrame, entity: str) -> list[tuple[str, Column, Column | None]]:
    """``(field, broken, missing)`` per rule; a missing required value
    reports ``Required`` instead of the rule's own message."""
    out = []
    for field, kind, msg, t in _rule_list(entity):
        cond = broken(field, kind, df.columns)
        missing = None if kind in OPTIONAL_KINDS else _value(field, df.columns).isNull()
        if t is not None:
            guard = F.col("type") == F.lit(t)
            cond = guard & cond
            missing = None if missing is None else guard & missing
        out.append((field, msg, cond, missing))
    return out


def _arm(field: str, msg: str, cond: Column, missing: Column | None) -> Column:
    arm = F.when(cond, F.lit(f"{field}: {msg}"))
    if missing is not None:
        arm = F.when(missing, F.lit(f"{field}: Required")).otherwise(arm)
    return arm


def validate(df: DataFrame, entity: str) -> DataFrame:
    """Q1-Q3: add ``errors`` (array<string> of ``"field: message"``, empty
    when valid; a missing required value gives ``"field: Required"``).
    Built with ``concat_ws`` (skips the passing rules) and ``split``, which
    stay inside whole-stage codegen (an array filter would not)."""
    arms = [_arm(*c) for c in _conditions(df, entity)]
    joined = F.concat_ws(SEP, *arms)
    errors = F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, SEP))
    return df.withColumn("errors", errors)


def validate_ledgers(raw: DataFrame) -> DataFrame:
    return validate(raw, "ledger")


def validate_transactions(raw: DataFrame) -> DataFrame:
    return validate(raw, "transaction")


def validate_operations(raw: DataFrame) -> DataFrame:
    return validate(raw, "operation")


# Q4 -------------------------------------------------------------------------
def split_valid(raw: DataFrame, entity: str, position: str | None = None):
    """Return ``(valid, invalid)``. ``invalid`` has the record position (the
    given column, else a monotonically increasing record id, dense within a
    partition), the ``"path: message; …"`` text and the raw record: the text of
    a line that could not be parsed (``_corrupt``), else the record as JSON.
    ``valid`` has no ``_corrupt``."""
    pos = F.col(position) if position else F.monotonically_increasing_id()
    checked = validate(raw.withColumn("_position", pos), entity)
    ok = F.size("errors") == 0
    valid = checked.where(ok).drop("errors", "_position", "_corrupt")
    data_cols = [c for c in raw.columns if c != "_corrupt"]
    text = F.col("_corrupt") if "_corrupt" in raw.columns else F.lit(None).cast("string")
    invalid = checked.where(~ok).select(
        F.col("_position").alias("position"),
        F.array_join("errors", "; ").alias("error"),
        F.coalesce(text, F.to_json(F.struct(*[F.col(f"`{c}`") for c in data_cols]))).alias("raw"),
        "errors")
    return valid, invalid


def split_valid_lines(lines: DataFrame, entity: str) -> tuple[DataFrame, DataFrame]:
    """:func:`split_valid` of landed lines (``raw.read_lines``): the position
    of an invalid record is its ``file`` and ``line`` (from 1), the same
    however the file is split among tasks; ``raw`` is the line itself. Only
    invalid records and one row for each file split are joined."""
    place = ("_text", "_file", "_block", "_at")
    checked = validate(lines, entity).where(F.trim("_text") != "")
    ok = F.size("errors") == 0
    valid = checked.where(ok).drop("errors", "_corrupt", *place)
    invalid = checked.where(~ok).join(line_starts(lines), ["_file", "_block"]).select(
        F.col("_file").alias("file"), (F.col("_at") + F.col("_first")).alias("line"),
        F.array_join("errors", "; ").alias("error"), F.col("_text").alias("raw"), "errors")
    return valid, invalid


def require_valid(df: DataFrame, entity: str) -> DataFrame:
    """Strict mode for a small unit of work (one landed record or batch):
    raise ``ValueError("invalid <entity>: <errors>")`` when any record
    fails, else return the frame. Only the first failing record's text
    reaches the driver."""
    bad = validate(df, entity).where(F.size("errors") > 0).select(
        F.array_join("errors", "; ").alias("e")).limit(1).collect()
    if bad:
        raise ValueError(f"invalid {entity}: {bad[0]['e']}")
    return df


# Q5 -------------------------------------------------------------------------
def validation_report(df: DataFrame, entity: str) -> DataFrame:
    """Failures by entity and rule (the field path before ':').

    On raw records (no ``errors`` column) this is one pass of conditional
    counts, one per rule, summed per field and stacked into rows, keeping
    rules that failed at least once. No per-row arrays, no explode. On a
    frame that already carries ``errors`` (e.g. the invalid side of
    :func:`split_valid`) the messages are exploded and counted."""
    if "errors" not in df.columns:
        conds = _conditions(df, entity)
        fields = []
        for field, *_ in conds:
            if field not in fields:
                fields.append(field)
        sums = {f: [] for f in fields}
        for i, (field, *_) in enumerate(conds):
            sums[field].append(f"r{i}")
        agg = df.agg(*[F.count_if(_arm(*c).isNotNull()).alias(f"r{i}") for i, c in enumerate(conds)])
        per_field = agg.select(*[sum((F.col(c) for c in cols[1:]), F.col(cols[0])).alias(f"f{j}")
                                 for j, (f, cols) in enumerate(sums.items())])
        stack = ", ".join(f"'{f}', f{j}" for j, f in enumerate(fields))
        return (per_field.select(F.expr(f"stack({len(fields)}, {stack}) AS (rule, failures)"))
                .where(F.col("failures") > 0)
                .select(F.lit(entity).alias("entity"), "rule", "failures"))
    return (df.select(F.explode("errors").alias("e"))
            .select(F.lit(entity).alias("entity"),
                    F.substring_index(F.col("e"), ":", 1).alias("rule"))
            .groupBy("entity", "rule").agg(F.count(F.lit(1)).alias("failures")))


# Q6 -------------------------------------------------------------------------
def integrity_report(checks: list[tuple[str, DataFrame]]) -> DataFrame:
    """One row per named rule with its violation count. ``checks`` pairs a
    rule name with a frame of violating rows (e.g. from :func:`orphans` or
    :func:`duplicate_keys`)."""
    parts = [df.agg(F.count(F.lit(1)).alias("violations")).select(
        F.lit(name).alias("rule"), "violations") for name, df in checks]
    return reduce(lambda a, b: a.unionByName(b), parts)


#: Rows that a task of the integrity checks holds the keys of, about.
TASK_ROWS = 500_000


def dealt_tasks(spark: SparkSession, rows: int) -> int | None:
    """Number of tasks among which so many rows are dealt by key, or nothing
    where the session's own partitions do."""
    tasks = -(-rows // TASK_ROWS)
    return tasks if tasks > spark.sparkContext.defaultParallelism else None


def _dealt(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    return df.repartition(tasks, *keys) if tasks else df


def _orphan_rows(df: DataFrame, fk: str, parent: DataFrame, pk: str, rows: int, parent_rows: int) -> DataFrame:
    """Number of rows whose key is in no row of the parent (null keys refer to
    nothing): the rows of a key are counted and meet the parent's keys in one
    aggregate. Keys of a small parent are few: they are counted before the
    shuffle. Those of a large one are dealt out, a hot key to 16 places."""
    child = df.where(F.col(fk).isNotNull()).select(F.col(fk).alias("_k"))
    tasks = dealt_tasks(df.sparkSession, parent_rows) and dealt_tasks(df.sparkSession, rows + parent_rows)
    if tasks:
        child = child.withColumn("_s", F.spark_partition_id() % 16).repartition(tasks, "_k", "_s")
        child = child.groupBy("_k", "_s").agg(F.count(F.lit(1)).alias("_n")).drop("_s")
    else:
        child = child.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
    held = parent.select(F.col(pk).alias("_k"), F.lit(None).cast("long").alias("_n"))
    both = _dealt(child.withColumn("_p", F.lit(False)).unionByName(held.withColumn("_p", F.lit(True))), tasks, "_k")
    counts = both.groupBy("_k").agg(F.sum("_n").alias("_n"), F.max("_p").alias("_p"))
    return counts.agg(F.coalesce(F.sum(F.when(~F.col("_p"), F.col("_n"))), F.lit(0)).alias("violations"))


def table_integrity(df: DataFrame, unique: tuple[str, list[str]] | None = None,
                    references: list[tuple[str, str, DataFrame, str]] = (),
                    rows: list[int] | None = None) -> DataFrame:
    """All rules of one table: ``unique`` is (rule, key columns),
    ``references`` are (rule, foreign key, parent, parent key). Each rule is
    an aggregate by its key, without a join or sort; large tables are dealt
    among tasks of about ``TASK_ROWS`` rows, so a task's memory does not grow
    with the table. ``rows`` are the rows of the table and of each parent, or
    bounds of them (counted if not given). Returns (rule, violations)."""
    n, *n_parents = rows or [df.count(), *[parent.count() for _, _, parent, _ in references]]
    parts = []
    for (name, fk, parent, pk), n_parent in zip(references, n_parents, strict=True):
        parts.append((name, _orphan_rows(df, fk, parent, pk, n, n_parent)))
    if unique:
        keyed = _dealt(df.select(*unique[1]), dealt_tasks(df.sparkSession, n), *unique[1])
        counts = keyed.groupBy(*unique[1]).agg(F.count(F.lit(1)).alias("_n"))
        parts.append((unique[0], counts.agg(F.count_if(F.col("_n") > 1).alias("violations"))))
    return reduce(lambda a, b: a.unionByName(b),
                  [found.select(F.lit(name).alias("rule"), "violations") for name, found in parts])


# Q7 -------------------------------------------------------------------------
MAX_LENGTHS = {
    "transaction": {"id": 64, "paging_token": 64, "hash": 64, "source_account": 56,
                    "source_account_sequence": 20, "fee_account": 56, "memo_type": 16},
    "operation": {"id": 64, "paging_token": 64, "transaction_hash": 64, "type": 32,
                  "source_account": 56},
    "ledger": {"id": 64, "total_coins": 32, "fee_pool": 32},
    "account": {"account_id": 56, "balance": 32, "asset_type": 20, "asset_code": 12,
                "asset_issuer": 56, "sequence_number": 20},
}
ALLOWED_VALUES = {
    "transaction": {"memo_type": S.MEMO_TYPES},
    "operation": {"type": S.OPERATION_TYPES},
    "account": {"asset_type": S.ASSET_TYPES},
}


def constraint_report(df: DataFrame, entity: str) -> DataFrame:
    """Violations of allowed values and maximum lengths, one pass:
    rows (rule, violations)."""
    checks = []
    for c, allowed in ALLOWED_VALUES.get(entity, {}).items():
        if c in df.columns:
            checks.append((f"{c} allowed values",
                           F.col(c).isNotNull() & ~F.col(c).isin(list(allowed))))
    for c, n in MAX_LENGTHS.get(entity, {}).items():
        if c in df.columns:
            checks.append((f"{c} max length {n}", F.length(F.col(c).cast("string")) > n))
    agg = df.agg(*[F.count_if(cond).alias(f"c{i}") for i, (_, cond) in enumerate(checks)])
    stack = ", ".join(f"'{name}', c{i}" for i, (name, _) in enumerate(checks))
    return agg.select(F.expr(f"stack({len(checks)}, {stack}) AS (rule, violations)"))

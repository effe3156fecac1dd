"""Sources (S1-S3): landed raw records, range scans and file streams.

Raw records are read with the entity's explicit schema (never inferred);
malformed lines are kept in ``_corrupt`` instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake import schemas as S

CORRUPT = "_corrupt"


def raw_schema(entity: str, with_corrupt: bool = True) -> T.StructType:
    try:
        schema = S.RAW_SCHEMAS[entity]
    except KeyError as exc:
        raise ValueError(f"unknown entity {entity!r}; expected one of {sorted(S.RAW_SCHEMAS)}") from exc
    if with_corrupt:
        schema = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    return schema


# S1 -------------------------------------------------------------------------
def read_raw(spark: SparkSession, path: str, entity: str) -> DataFrame:
    """Landed JSON-lines records of one entity (ledger / transaction /
    operation / payment)."""
    return (spark.read.schema(raw_schema(entity))
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT)
            .json(path))


def read_lines(spark: SparkSession, path: str, entity: str) -> DataFrame:
    """:func:`read_raw` with each record's place: the entity's columns,
    ``_corrupt``, and ``_text`` (the line), ``_file``, ``_block`` (first byte
    of the file split) and ``_at``. The lines of a split are read in order by
    one task, so ``_at`` counts them; :func:`line_starts` turns it into line
    numbers. Blank lines hold no record but are counted."""
    lines = spark.read.text(path).select(
        F.col("value").alias("_text"), F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    record = F.from_json("_text", raw_schema(entity), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return lines.withColumn("_record", record).select("_record.*", "_text", "_file", "_block", "_at")


def line_starts(lines: DataFrame) -> DataFrame:
    """(``_file``, ``_block``, ``_first``): what to add to ``_at`` for the line
    number in the file, from 1. One row a file split; no record is shuffled."""
    splits = lines.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_low"))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return splits.select("_file", "_block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_low") + 1).alias("_first"))


# S2 -------------------------------------------------------------------------
def read_sequence_range(led: DataFrame, start: int, end: int, col: str = "sequence") -> DataFrame:
    """Inclusive range scan by ledger sequence; literal bounds reach the scan
    (and prune ``sequence_bucket`` partitions when the table has them)."""
    if start > end:
        raise ValueError(f"startSequence ({start}) must not be greater than endSequence ({end})")
    out = led.where(F.col(col).between(F.lit(start), F.lit(end)))
    if "sequence_bucket" in led.columns:
        width = sequence_bucket_width()
        out = out.where(F.col("sequence_bucket").between(start // width, end // width))
    return out


def sequence_bucket_width() -> int:
    return 100_000


def with_sequence_bucket(df: DataFrame, col: str = "sequence") -> DataFrame:
    """Partition column for ledger-keyed tables (``sequence div 100000``)."""
    return df.withColumn("sequence_bucket", F.floor(F.col(col) / F.lit(sequence_bucket_width())).cast("long"))


# S3 -------------------------------------------------------------------------
def read_stream(spark: SparkSession, path: str, entity: str, per_batch: int | None = None,
                fmt: str = "json") -> DataFrame:
    """Tail new landed files; ``per_batch`` bounds files per micro-batch."""
    reader = spark.readStream.schema(raw_schema(entity, with_corrupt=(fmt == "json")))
    if fmt == "json":
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.format(fmt).load(path)

"""Helpers shared by the training-data operators.

Internal columns are prefixed ``_ll_`` and operators project the input
columns they need first, so extra input columns of any name never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.session import ensure_checkpoint_dir

#: A word of plain prose: a run of bytes other than ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder that
    ``spark.checkpoint.dir`` names (an own folder only where it is unset)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def unit_hash(*cols: Column) -> Column:
    """A deterministic number in [0, 1) from the columns (52 hash bits)."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 12).cast("double") / F.lit(float(1 << 52))


def small_side(df: DataFrame, rows: int = 250_000) -> DataFrame:
    """Materialise ``df`` and mark it for broadcast if it has at most ``rows``
    (narrow) rows; beyond that Spark joins it by a shuffle."""
    df = kept(df)
    return F.broadcast(df) if df.count() <= rows else df


#: Rows of a task that reads a kept frame of narrow rows.
TASK_ROWS = 50_000


def few(df: DataFrame) -> DataFrame:
    """``kept``, and read by tasks of about ``TASK_ROWS`` rows (no fewer tasks
    than cores): a small frame does not drag a large cluster's number of
    shuffle partitions through the stages that follow. Joins broadcast it up
    to the bound of ``small_side``."""
    whole = kept(df)
    rows = whole.count()
    tasks = max(-(-rows // TASK_ROWS), df.sparkSession.sparkContext.defaultParallelism)
    out = whole.coalesce(tasks)
    out._ll_whole, out._ll_rows = whole, rows
    return out


def beside(frame: DataFrame, of: DataFrame, rows: int = 250_000) -> DataFrame:
    """``frame``, made of the columns of the ``few`` frame ``of``, marked for
    broadcast if that has at most ``rows`` (narrow) rows."""
    return F.broadcast(frame) if of._ll_rows <= rows else frame


def forget(*frames: DataFrame) -> None:
    """Delete the checkpoints of ``few`` or ``kept`` frames that nothing will
    read again: their successors are checkpointed themselves."""
    for frame in frames:
        frame = getattr(frame, "_ll_whole", frame)
        spark = frame.sparkSession
        path = frame._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if path.isDefined():
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.get())
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

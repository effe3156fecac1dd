"""Key index beside a Parquet table: which files may hold a key.

Minima and maxima say nothing about hash keys, since every file spans all of
them. The index keeps a blocked Bloom filter for each data file instead: a
file of n keys has ``2^level`` blocks (about ``KEYS_PER_BLOCK`` keys each) of
256 bits, four 64-bit words; a key falls into the block that the first bits of
its hash name and sets two bits of each word. Blocks are rows
``(file, level, block, w0..w3)`` of a Parquet table at ``<path>_keys``, about
five bytes a key, built with a map-side ``bit_or`` and probed by an equi-join
on (level, block). Of a batch of a thousand new keys about one in a hundred
thousand probes of a file goes wrong, so nearly no file is opened.

The index only ever rules files out. Files that it does not know (an append
that stopped before it was indexed, files written by others) are opened, files
that are gone are ignored, and the comparison with what is opened is exact.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: 32 bits a key: a wrong hit in about 1e-5 of all probes.
KEYS_PER_BLOCK = 8
WORDS = 4
#: Keys of a batch that are broadcast to the index at most; beyond that Spark
#: joins by a shuffle.
BROADCAST_KEYS = 200_000


def file_name(uri: str) -> str:
    """One spelling of ``file:/a`` and ``file:///a``."""
    return re.sub(r"^(\w+):/+", r"\1:/", uri)


def index_path(path: str) -> str:
    return f"{path.rstrip('/')}_keys"


def _hash(keys: list[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys])


def _words(h: Column) -> list[Column]:
    """Two bits of each of four words from a second hash."""
    g = F.xxhash64(h, F.lit(1))
    one = F.lit(1).cast("long")

    def bit(i: int) -> Column:
        return F.call_function("shiftleft", one, F.shiftrightunsigned(g, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
    return [bit(2 * i).bitwiseOR(bit(2 * i + 1)).alias(f"w{i}") for i in range(WORDS)]


def _block(h: Column, level: Column) -> Column:
    """The first ``level`` bits of the hash."""
    return F.when(level == 0, F.lit(0).cast("long")).otherwise(
        F.call_function("shiftrightunsigned", h, (F.lit(64) - level).cast("int")))


def _read(spark: SparkSession, path: str, files: list[str]) -> DataFrame:
    return spark.read.option("basePath", path).parquet(*files)


def known_files(spark: SparkSession, path: str, exists) -> set[str]:
    """Files that the index describes (a row for each file)."""
    at = f"{index_path(path)}/files"
    if not exists(spark, at):
        return set()
    return {file_name(r["file"]) for r in spark.read.parquet(at).select("file").distinct().collect()}


def add_files(spark: SparkSession, path: str, files: list[str], keys: list[str]) -> None:
    """Index ``files`` of the table: blocks first, then the list of files, so
    that a file is known only when all its blocks are there."""
    if not files:
        return
    rows = _read(spark, path, files).select(F.col("_metadata.file_path").alias("file"), _hash(keys).alias("h"))
    counts = rows.groupBy("file").agg(F.count("*").alias("n")).select(
        "file", F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / KEYS_PER_BLOCK))).cast("int").alias("level"))
    leveled = rows.join(counts, "file")             # as many rows as files
    blocks = (leveled.select("file", "level", _block(F.col("h"), F.col("level")).alias("block"), *_words(F.col("h")))
              .groupBy("file", "level", "block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]))
    blocks.write.mode("append").partitionBy("level").parquet(f"{index_path(path)}/blocks")
    counts.write.mode("append").parquet(f"{index_path(path)}/files")


def candidate_files(spark: SparkSession, path: str, batch: DataFrame, keys: list[str], exists) -> list[str]:
    """Files of the table that may hold a key of ``batch``: those the index
    does not rule out and those it does not know."""
    files = spark.read.parquet(path).inputFiles()
    known = known_files(spark, path, exists)
    unknown = [f for f in files if file_name(f) not in known]
    if len(unknown) == len(files):
        return unknown
    blocks = spark.read.parquet(f"{index_path(path)}/blocks")
    levels = [r["level"] for r in blocks.select("level").distinct().collect()]         # below 64
    hashed = batch.select(_hash(keys).alias("h")).distinct()
    asked = (hashed.withColumn("level", F.explode(F.array(*[F.lit(x) for x in sorted(levels)])))
             .select("level", _block(F.col("h"), F.col("level")).alias("block"),
                     *[w.alias(f"m{i}") for i, w in enumerate(_words(F.col("h")))]))
    if batch.count() * len(levels) <= BROADCAST_KEYS:
        asked = F.broadcast(asked)
    hit = F.lit(True)
    for i in range(WORDS):
        hit = hit & (F.col(f"w{i}").bitwiseAND(F.col(f"m{i}")) == F.col(f"m{i}"))
    found = {file_name(r["file"]) for r in blocks.join(asked, ["level", "block"]).where(hit).select("file").distinct().collect()}
    return unknown + [f for f in files if file_name(f) in found]


def stored(spark: SparkSession, path: str, files: list[str], keys: list[str]) -> DataFrame | None:
    """Key columns of the rows in ``files``."""
    return _read(spark, path, files).select(*keys) if files else None

"""Sharding by longest-processing-time scheduling (LPT).

Groups that must stay together are sorted by size and each goes to the
least-loaded shard, through a heap. A corpus has far too many groups for one
heap, so the heap schedules *parcels*:

* a group of at least ``total / (shards * fine)`` bytes is a parcel of its
  own; there are at most ``shards * fine`` of those whatever the corpus size;
* the other groups are laid on a line in descending order of size class
  (1/1024 of a binary order of magnitude; inside a class by a hash of the
  group), and the line is cut where the bytes that remain shrink by a factor
  ``1 - 1/(shards * fine)``. Parcels therefore get smaller and smaller, down
  to single small groups at the end, as the items of plain LPT do. There are
  at most ``shards * fine * ln(total bytes)`` of them (under 15 000 for 24
  shards and 100 TB).

Only the size classes (at most 65 536 rows) and the parcels reach the driver;
their number depends on the parameters, not on the number of documents.
Documents learn their shard through a join on the group, whose hot keys AQE
splits, and their slot from a window over (shard, one of 512 hash buckets)
plus the rows of the shard's earlier buckets.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, unit_hash

CLASSES_PER_OCTAVE = 1024
SLOT_BUCKETS = 512


def lpt(sizes: list[tuple[str, int]], shards: int) -> dict[str, int]:
    """Longest processing time first: largest item to the least-loaded shard
    (ties: item name, then shard number)."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for name, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        out[name] = shard
    return out


def _size_class(size: Column) -> Column:
    """Order-preserving class of a positive size: binary exponent and ten
    bits of mantissa."""
    exp = F.floor(F.log2(size.cast("double")))
    frac = size.cast("double") / F.pow(F.lit(2.0), exp.cast("double")) - 1
    # log2 of numbers beside a power of two can round across it
    return (exp * CLASSES_PER_OCTAVE + F.floor(F.greatest(F.lit(0.0), frac) * CLASSES_PER_OCTAVE)).cast("long")


def _parcels(groups: DataFrame, shards: int, fine: int) -> DataFrame:
    """Add ``_ll_parcel`` to (``_ll_group``, ``_ll_gsize``)."""
    spark = groups.sparkSession
    cuts = shards * fine
    classes = (groups.groupBy(_size_class(F.col("_ll_gsize")).alias("_ll_class"))
               .agg(F.sum("_ll_gsize").alias("bytes")).collect())
    total = sum(r["bytes"] for r in classes)
    starts, at = [], 0
    for r in sorted(classes, key=lambda r: -r["_ll_class"]):
        starts.append((r["_ll_class"], float(at), float(r["bytes"])))
        at += r["bytes"]
    line = spark.createDataFrame(starts, "_ll_class long, _ll_start double, _ll_bytes double")
    offset = F.col("_ll_start") + unit_hash(F.col("_ll_group")) * F.col("_ll_bytes")
    remain = F.greatest(F.lit(1.0), F.lit(float(total)) - offset)
    cut = F.floor(F.lit(float(cuts)) * F.log(F.lit(float(max(total, 1))) / remain))
    heavy = F.col("_ll_gsize") * cuts >= F.lit(total)
    return (groups.withColumn("_ll_class", _size_class(F.col("_ll_gsize")))
            .join(F.broadcast(line), "_ll_class")      # at most 65 536 classes
            .select("_ll_group", "_ll_gsize",
                    F.when(heavy, F.concat(F.lit("g"), F.col("_ll_group")))
                     .otherwise(F.concat(F.lit("p"), cut.cast("string"))).alias("_ll_parcel")))


def shard_documents(docs: DataFrame, size: Column, group: Column, shards: int = 24,
                    id_col: str = "doc_id", extra: dict[str, Column] | None = None,
                    fine: int = 16) -> DataFrame:
    """Deal documents into ``shards`` shards of nearly equal bytes.

    ``size`` is a positive long, ``group`` a string: rows of equal group share
    a shard (null is a group like any other). Returns ``id_col``, ``size``,
    the ``extra`` columns, ``shard`` and ``slot`` (0, 1, ... without gaps in
    each shard).

    Defined cases: an empty table gives no rows; rows with a null id are dealt
    like others; repeated rows are separate members of their group and get a
    slot each; more shards than groups leaves shards empty.
    """
    extra = extra or {}
    rows = kept(docs.select(
        F.col(id_col).alias("_ll_id"), size.cast("long").alias("_ll_size"),
        F.coalesce(F.concat(F.lit("="), group), F.lit("null")).alias("_ll_group"),
        *[c.alias(f"_ll_x_{k}") for k, c in extra.items()]))
    groups = kept(rows.groupBy("_ll_group").agg(F.sum("_ll_size").alias("_ll_gsize")))
    dealt = _parcels(groups, shards, fine)
    parcels = dealt.groupBy("_ll_parcel").agg(F.sum("_ll_gsize").alias("bytes")).collect()
    plan = lpt([(r["_ll_parcel"], r["bytes"]) for r in parcels], shards)
    where = rows.sparkSession.createDataFrame(list(plan.items()), "_ll_parcel string, _ll_shard int")
    placed = dealt.join(F.broadcast(where), "_ll_parcel").select("_ll_group", "_ll_shard")
    bucket = F.pmod(F.xxhash64("_ll_id", "_ll_group"), F.lit(SLOT_BUCKETS)).cast("int")
    members = rows.join(placed, "_ll_group").withColumn("_ll_bucket", bucket)
    # at most shards * 512 rows
    before = (members.groupBy("_ll_shard", "_ll_bucket").agg(F.count("*").alias("n"))
              .select("_ll_shard", "_ll_bucket", (F.sum("n").over(
                  Window.partitionBy("_ll_shard").orderBy("_ll_bucket")) - F.col("n")).alias("_ll_before")))
    inside = F.row_number().over(
        Window.partitionBy("_ll_shard", "_ll_bucket").orderBy("_ll_id", "_ll_group")) - 1
    return (members.withColumn("_ll_in", inside)
            .join(F.broadcast(before), ["_ll_shard", "_ll_bucket"])
            .select(F.col("_ll_id").alias(id_col), F.col("_ll_size").alias("size"),
                    *[F.col(f"_ll_x_{k}").alias(k) for k in extra],
                    F.col("_ll_shard").alias("shard"),
                    (F.col("_ll_in") + F.col("_ll_before")).cast("long").alias("slot")))


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 8 for the record."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents into 24 shards of nearly equal bytes, equal texts
    together."""
    from .common import table
    return shard_query(table(spark, sf_dir, "documents"))


def shard_query(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    out = shard_documents(docs, text_size(text), F.sha2(text, 256), 24,
                          extra={"text_crc32": F.crc32(text.cast("binary"))})
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"),
                      "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def balance_bound(sizes: list[int], shards: int) -> int:
    """Ceiling of the mean load, the least any schedule can reach."""
    return math.ceil(sum(sizes) / shards)

"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target number of words; a document of it is wanted
``target / source size`` times. The whole part is taken as it is; the fraction
left over is rounded to 0 or 1 so that the words taken stay at the target:
two documents of fractions x, y and sizes a, b move word mass between them,
``a * dx = -b * dy``, at random in one of the two directions that make one of
them integral and with the chances that keep both expectations. The source's
word total never changes in this, so only the last document of a source is
rounded off the target.

The pairs form a reduction tree: documents are dealt by hash into ``LEAVES``
buckets of their source, each bucket is one stream sorted by size (constant
memory: the one document still fractional is paired with the next), and the
residual of every ``FAN`` buckets meets in the next level, up to one document
per source. Draws are hashes of the pair, so reruns agree whatever the
partitioning. A source with a third of all rows is ``LEAVES`` streams.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, kept, table

LEAVES = 256
FAN = 16
CYCLE = (3.0, 1.0, 2.0)


def targets(sizes: list[tuple[str | None, int]], weights: list[float], share: float = 1.5,
            most: float = 2.0) -> list[float]:
    """Words wanted of each source: ``share`` of all words by weight, but at
    most ``most`` times a source's words; what is over is shared again by
    weight among the others until none is above its limit."""
    total = share * sum(n for _, n in sizes)
    out = [0.0] * len(sizes)
    free = set(range(len(sizes)))
    while free:
        left = total - sum(out[i] for i in range(len(sizes)) if i not in free)
        by = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / by > most * sizes[i][1]}
        for i in free:
            out[i] = most * sizes[i][1] if i in over else left * weights[i] / by
        if not over:
            break
        free -= over
    return out


def _uniform(seed: int, a: int, b: int) -> float:
    return (xxhash.xxh3_64_intdigest(struct.pack("<qqq", seed, a, b)) >> 11) / float(1 << 53)


def _pivot(level: int, root: bool):
    """Streams rows sorted by (group, size): resolves all but one row of each
    group; that one keeps its fraction (at the root it is drawn)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None

        def settle(batch, up, x):
            i = batch.schema.get_field_index
            return batch.set_column(i("_ll_up"), "_ll_up", pa.array(up, pa.int32())).set_column(
                i("_ll_x"), "_ll_x", pa.array(x, pa.float64()))

        def last(key, x):
            return (1 if _uniform(level, key, key) < x else 0, None) if root else (None, x)
        for batch in batches:
            if carry is not None:
                batch = pa.Table.from_batches([carry, batch]).combine_chunks().to_batches()[0]
            group = list(zip(batch.column("_ll_source").to_pylist(), batch.column("_ll_bucket").to_pylist()))
            size, key = batch.column("_ll_size").to_pylist(), batch.column("_ll_key").to_pylist()
            x = batch.column("_ll_x").to_pylist()
            up: list[int | None] = [None] * len(x)
            open_at = None
            for j in range(len(x)):
                if open_at is not None and group[open_at] != group[j]:
                    up[open_at], x[open_at] = last(key[open_at], x[open_at])
                    open_at = None
                if x[j] <= 0 or size[j] == 0:
                    up[j], x[j] = 0, None
                    continue
                if open_at is None:
                    open_at = j
                    continue
                i = open_at
                a, b = size[i], size[j]
                rise = min((1 - x[i]) * a, x[j] * b)         # words from j to i
                fall = min(x[i] * a, (1 - x[j]) * b)         # words from i to j
                if _uniform(level, key[i], key[j]) * (rise + fall) < fall:
                    full, empty, mass = i, j, rise
                else:
                    full, empty, mass = j, i, fall
                one = (1 - x[full]) * size[full] <= x[empty] * size[empty]
                if one:
                    x[empty] -= mass / size[empty]
                    up[full], x[full] = 1, None
                    open_at = empty
                else:
                    x[full] += mass / size[full]
                    up[empty], x[empty] = 0, None
                    open_at = full
                if not 1e-12 < x[open_at] < 1 - 1e-12:       # both became integral
                    up[open_at], x[open_at] = int(x[open_at] > 0.5), None
                    open_at = None
            done = settle(batch, up, x)
            if open_at is None:
                carry = None
                yield done
            else:
                yield pa.Table.from_batches([done.slice(0, open_at), done.slice(open_at + 1)]).combine_chunks().to_batches(
                    )[0] if len(x) > 1 else done.slice(0, 0)
                carry = done.slice(open_at, 1)
        if carry is not None:
            up, x = last(carry.column("_ll_key")[0].as_py(), carry.column("_ll_x")[0].as_py())
            yield settle(carry, [up], [x])
    return run


def mix(docs: DataFrame, size: Column, weights=CYCLE, share: float = 1.5, most: float = 2.0,
        id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Copies of each document in a mix of sources.

    ``weights`` repeat over the sources by code point, null last. Returns one
    row per row of ``docs``: ``id_col``, ``_ll_key`` (hash of id, source and
    text), ``size``, ``source_size``, ``target``, ``copies``, ``taken``.

    The sources (one row each, as many as the mix has weights) are the only
    thing that reaches the driver. Defined cases: null texts have size 0 and
    are never taken; a null source is a source; rows without id are mixed by
    their text; repeated rows are documents of their own; a source of size 0
    has target 0; an empty table gives no rows.
    """
    key = F.xxhash64(F.col(id_col), F.col(source_col), F.col(text_col))
    rows = kept(docs.select(F.col(id_col).alias("_ll_id"), F.col(source_col).cast("string").alias("_ll_name"),
                            size.cast("long").alias("_ll_size"), key.alias("_ll_key")))
    found = rows.groupBy("_ll_name").agg(F.sum("_ll_size").alias("n")).collect()
    sizes = sorted(((r["_ll_name"], r["n"]) for r in found), key=lambda r: (r[0] is None, r[0] or ""))
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, most)
    plan = rows.sparkSession.createDataFrame(
        [(name, i, n, t, int((t / n) if n else 0)) for i, ((name, n), t) in enumerate(zip(sizes, goal))],
        "_ll_plan string, _ll_source int, _ll_source_size long, _ll_target double, _ll_base int")
    want = F.when(F.col("_ll_source_size") > 0, F.col("_ll_target") / F.col("_ll_source_size")).otherwise(0.0)
    level = (rows.join(F.broadcast(plan), F.col("_ll_name").eqNullSafe(F.col("_ll_plan"))).drop("_ll_name", "_ll_plan")
             .withColumn("_ll_bucket", F.pmod("_ll_key", F.lit(LEAVES)).cast("int"))
             .withColumn("_ll_x", want - F.col("_ll_base"))
             .withColumn("_ll_up", F.lit(None).cast("int")))
    buckets, depth, parts = LEAVES, 0, []
    while True:
        schema = level.schema
        out = kept(level.repartition("_ll_source", "_ll_bucket")
                   .sortWithinPartitions("_ll_source", "_ll_bucket", F.desc("_ll_size"), "_ll_key", "_ll_x")
                   .mapInArrow(_pivot(depth, buckets == 1), schema))
        parts.append(out.where("_ll_x IS NULL"))
        if buckets == 1:
            break
        buckets, depth = -(-buckets // FAN), depth + 1
        level = out.where("_ll_x IS NOT NULL").withColumn("_ll_bucket", F.pmod("_ll_bucket", F.lit(buckets)))
    done = parts[0]
    for p in parts[1:]:
        done = done.unionByName(p)
    copies = F.col("_ll_base") + F.col("_ll_up")
    return done.select(F.col("_ll_id").alias(id_col), "_ll_key", F.col("_ll_size").alias("size"),
                       F.col("_ll_source_size").alias("source_size"), F.col("_ll_target").alias("target"),
                       copies.alias("copies"), (F.col("_ll_size") * copies).alias("taken"))


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def apply_mix(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", source_col: str = "source",
              text_col: str = "text") -> DataFrame:
    """``docs`` (all its columns), each row as often as ``mixed`` takes it.
    Rows of equal id, source and text stand for one row with their copies
    added."""
    per = kept(mixed.groupBy("_ll_key").agg(F.sum("copies").alias("_ll_copies"), F.count("*").alias("_ll_rows"))
               .withColumnRenamed("_ll_key", "_ll_of"))
    rows = docs.withColumn("_ll_key", F.xxhash64(F.col(id_col), F.col(source_col), F.col(text_col)))
    rows = rows.join(per.where("_ll_copies > 0"), F.col("_ll_key") == F.col("_ll_of"))
    if per.where("_ll_rows > 1").limit(1).count():
        rows = rows.where("_ll_rows = 1").unionByName(rows.where("_ll_rows > 1").dropDuplicates(["_ll_key"]))
    return (rows.withColumn("_ll_again", F.explode(F.sequence(F.lit(1), F.col("_ll_copies").cast("int"))))
            .select(*docs.columns))


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents mixed by source: weights 3, 1, 2, 150 % of all words."""
    return digest(mix(table(spark, sf_dir, "documents"), words(F.col("text"))))


def digest(mixed: DataFrame) -> DataFrame:
    return mixed.select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "copies")


def expected(sizes: np.ndarray, fraction: float) -> float:
    """Words a source is expected to give at a copy probability."""
    return float(sizes.sum() * fraction)

"""Nearest neighbours with inverted lists and adaptive dimension scan.

Index: k-means centroids are fitted by Spark ML on a bounded sample
(``SAMPLE_PER_LIST`` expected vectors for each list, by a hash of the id);
every vector is then put into the list of its nearest centroid. A query probes
its nearest lists until they hold ``PROBE_SHARE`` of all vectors.

Search: lists and the queries that probe them meet in blocks of a bounded
number of vectors and queries, so a list with a third of all rows is many
tasks. Inside a block all vectors are turned by one random rotation and
compared by column blocks: after t of D dimensions the partial distance,
scaled by D/t, is tested against the query's present k-th distance (the
hypothesis "this vector is among the k nearest" is rejected where the scaled
distance exceeds it by a factor ``1 + EPSILON / sqrt(t)``); rejected
candidates are not read further. Survivors are measured on the original
vectors in double precision. The nearest lists are searched first; their k-th
distance is the starting bound in all others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, table, unit_hash

MOST_LISTS = 1024
SAMPLE_PER_LIST = 64
PROBE_SHARE = 0.7
FIRST_SHARE = 0.04       # of all vectors, searched before the other lists
VECTORS_PER_BLOCK = 1024
QUERIES_PER_BLOCK = 1024
COLUMN_BLOCKS = 4
EPSILON = 2.1


def rotation(dim: int, seed: int = 5) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def valid_vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(_ll_id, _ll_vec): vectors without null or non-finite components, not
    zero, of the most frequent length (the longer on a tie)."""
    rows = rows.select(F.col(id_col).alias("_ll_id"), F.col(vec_col).cast("array<double>").alias("_ll_vec")).where(
        F.col("_ll_id").isNotNull() & F.col("_ll_vec").isNotNull()
        & F.forall("_ll_vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists("_ll_vec", lambda x: x != 0))
    dims = rows.groupBy(F.size("_ll_vec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.where(F.size("_ll_vec") == (dims["d"] if dims else 0))


def centroids(vectors: DataFrame, n: int, seed: int = 3) -> np.ndarray:
    """About 2 sqrt(n) centroids, ``MOST_LISTS`` at most."""
    lists = max(1, min(MOST_LISTS, round(2 * math.sqrt(n))))
    share = min(1.0, SAMPLE_PER_LIST * lists / n)
    sample = kept(vectors.where(unit_hash(F.lit("ivf"), F.col("_ll_id")) < share).select(
        array_to_vector("_ll_vec").alias("features")).repartition(4, F.hash("features")))
    model = KMeans(k=lists, maxIter=8, seed=seed, initMode="random").fit(sample)
    return np.array(model.clusterCenters())


def _nearest(c: np.ndarray):
    half = 0.5 * (c ** 2).sum(1)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), c.shape[1])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(np.argmax(x @ c.T - half, axis=1).astype(np.int32))],
                names=["_ll_id", "_ll_vec", "_ll_list"])
    return assign


def _matrix(column, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), dim)


def _probes(c: np.ndarray, counts: np.ndarray, first: int, enough: int):
    """Lists of each query, nearest first, until they hold ``enough`` vectors;
    ``_ll_first`` marks those up to ``first`` vectors."""
    half = 0.5 * (c ** 2).sum(1)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            order = np.argsort(-(_matrix(b.column(1), c.shape[1]) @ c.T - half), axis=1, kind="stable")
            before = np.cumsum(counts[order], axis=1) - counts[order]
            lists = [[{"list": int(i), "first": bool(s < first)} for i, s in zip(o, n) if s < enough and counts[i]]
                     for o, n in zip(order, before)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(lists, pa.list_(pa.struct([("list", pa.int32()), ("first", pa.bool_())])))],
                names=["_ll_id", "_ll_vec", "_ll_lists"])
    return probe


def scan_block(ids: np.ndarray, x: np.ndarray, xr: np.ndarray, qid: int, q: np.ndarray, qr: np.ndarray,
               bound: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Adaptive dimension scan of one block for one query: (ids, distances) of
    up to k nearest whose distance may be within ``bound``."""
    dim = x.shape[1]
    best_i, best_d = np.empty(0, ids.dtype), np.empty(0)
    steps = np.linspace(0, dim, min(COLUMN_BLOCKS, dim) + 1).astype(int)
    for at in range(0, len(ids), 256):
        alive = at + np.flatnonzero(ids[at:at + 256] != qid)
        part = np.zeros(len(alive))
        for lo, hi in zip(steps[:-1], steps[1:]):
            part += ((xr[alive, lo:hi] - qr[lo:hi]) ** 2).sum(1)
            if hi < dim and bound < math.inf:
                ok = part * (dim / hi) <= (bound * (1 + EPSILON / math.sqrt(hi))) ** 2
                alive, part = alive[ok], part[ok]
        if bound < math.inf:
            alive = alive[part <= (bound * (1 + 1e-9)) ** 2 + 1e-12]
        if len(alive):
            d = np.sqrt(((x[alive] - q) ** 2).sum(1))
            best_i, best_d = np.concatenate([best_i, ids[alive]]), np.concatenate([best_d, d])
            if len(best_d) > k:
                top = np.lexsort((best_i, best_d))[:k]
                best_i, best_d = best_i[top], best_d[top]
            if len(best_d) == k:
                bound = min(bound, float(best_d.max()))
    return best_i, best_d


def _searcher(dim: int, k: int):
    def search(key, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        turn = rotation(dim)
        x, q = (np.stack(f["_ll_vec"].to_numpy()).astype(np.float64) for f in (rows, queries))
        ids = rows["_ll_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        xr, qr = x @ turn, q @ turn
        out = []
        for i, (qid, bound) in enumerate(zip(queries["_ll_query"].to_numpy(), queries["_ll_bound"].to_numpy())):
            found, d = scan_block(ids, x, xr, qid, q[i], qr[i], bound, k)
            out.append(pd.DataFrame({"query_id": np.full(len(found), qid), "vec_id": found, "score": d}))
        return pd.concat(out)
    return search


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id",
            vec_col: str = "embedding") -> DataFrame:
    """The k nearest vectors found for each query (a query's own row is no
    candidate), Euclidean: (query_id, rank, vec_id, score), ties to the
    smaller id. Ids are longs.

    Defined cases: null ids, vectors that are null, zero, or hold null or
    non-finite components, and those of another length than most take no
    part; equal vectors are neighbours at distance 0; rows that repeat an id
    with a vector count once; fewer than k candidates are all returned; an
    empty table gives no rows.
    """
    schema = "query_id long, vec_id long, score double"
    vectors = kept(valid_vectors(rows, id_col, vec_col).select(F.col("_ll_id").cast("long").alias("_ll_id"), "_ll_vec"))
    n = vectors.count()
    asked = valid_vectors(queries, id_col, vec_col).select(F.col("_ll_id").cast("long").alias("_ll_id"), "_ll_vec")
    if not n:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = vectors.select(F.size("_ll_vec")).first()[0]
    asked = asked.where(F.size("_ll_vec") == dim)
    c = centroids(vectors, n)
    put = kept(vectors.dropDuplicates(["_ll_id", "_ll_vec"]).mapInArrow(
        _nearest(c), "_ll_id long, _ll_vec array<double>, _ll_list int"))
    counts = np.zeros(len(c), np.int64)
    for r in put.groupBy("_ll_list").agg(F.count("*").alias("n")).collect():       # at most MOST_LISTS rows
        counts[r["_ll_list"]] = r["n"]
    least = 2 * k + 2
    probe = _probes(c, counts, max(least, int(FIRST_SHARE * n)), max(least, math.ceil(PROBE_SHARE * n)))
    asking = kept(asked.mapInArrow(
        probe, "_ll_id long, _ll_vec array<double>, _ll_lists array<struct<list:int,first:boolean>>")
        .select(F.col("_ll_id").alias("_ll_query"), "_ll_vec", F.explode("_ll_lists").alias("p"))
        .select("_ll_query", "_ll_vec", F.col("p.list").alias("_ll_list"), F.col("p.first").alias("_ll_first")))

    def search(who: DataFrame) -> DataFrame:
        load = {r["_ll_list"]: r["n"] for r in who.groupBy("_ll_list").agg(F.count("*").alias("n")).collect()}
        grid = rows.sparkSession.createDataFrame(
            [(i, math.ceil(int(counts[i]) / VECTORS_PER_BLOCK), math.ceil(q / QUERIES_PER_BLOCK)) for i, q in load.items()],
            "_ll_list int, _ll_vs int, _ll_qs int")
        left = (put.join(F.broadcast(grid), "_ll_list")
                .withColumn("_ll_v", F.pmod(F.xxhash64("_ll_id"), F.col("_ll_vs")).cast("int"))
                .withColumn("_ll_q", F.explode(F.sequence(F.lit(0), F.col("_ll_qs") - 1))))
        right = (who.join(F.broadcast(grid), "_ll_list")
                 .withColumn("_ll_q", F.pmod(F.xxhash64("_ll_query"), F.col("_ll_qs")).cast("int"))
                 .withColumn("_ll_v", F.explode(F.sequence(F.lit(0), F.col("_ll_vs") - 1))))
        block = ["_ll_list", "_ll_v", "_ll_q"]
        return (left.select(*block, "_ll_id", "_ll_vec").groupBy(*block)
                .cogroup(right.select(*block, "_ll_query", "_ll_vec", "_ll_bound").groupBy(*block))
                .applyInPandas(_searcher(dim, k), schema))

    def top(found: DataFrame) -> DataFrame:
        best = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    first = kept(top(search(asking.where("_ll_first").withColumn("_ll_bound", F.lit(float("inf"))))))
    bound = first.where(F.col("rank") == k).select(F.col("query_id").alias("_ll_query"), F.col("score").alias("_ll_b"))
    others = asking.where("NOT _ll_first").join(bound, "_ll_query", "left").withColumn(
        "_ll_bound", F.coalesce("_ll_b", F.lit(float("inf")))).drop("_ll_b")
    found = first.drop("rank").unionByName(search(others))
    return top(found.distinct()).select("query_id", "rank", "vec_id", "score")


def op10_nearest(spark, sf_dir: str) -> DataFrame:
    """Ten nearest of every embedding whose id is divisible by 100, among all
    others."""
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where(F.col("vec_id") % 100 == 0))


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact neighbours (query_id, vec_id) that were found."""
    n = exact.count()
    return exact.join(found, ["query_id", "vec_id"], "left_semi").count() / n if n else 1.0

import math

import numpy as np
from pyspark.sql import functions as F

from ledgerlake.llm import ann
from ledgerlake.llm.common import table

SF = "/root/testdata/sf0.1"


def exact(rows, k=10):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for q in ok:
        if q % 100 == 0:
            d = sorted((math.sqrt(((ok[q] - v) ** 2).sum()), i) for i, v in ok.items() if i != q)[:k]
            out[q] = d
    return out


def test_recall_and_scores(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, SF, "embeddings").collect()]
    want = exact(rows)
    got = {}
    for r in ann.op10_nearest(spark, SF).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"], r["rank"]))
    assert set(got) == set(want)
    hit = sum(len({i for _, i in want[q]} & {i for _, i, _ in got[q]}) for q in want)
    assert hit >= 0.9 * 10 * len(want)
    vec = {i: np.array(v, float) for i, v in rows}
    for q, found in got.items():
        assert [r for *_, r in found] == list(range(1, 11))
        assert [x[:2] for x in found] == sorted(x[:2] for x in found)
        for s, i, _ in found:
            assert abs(s - np.sqrt(((vec[q] - vec[i]) ** 2).sum())) < 1e-12


def test_edge_rows(spark):
    v = [1.0, 0.0, 2.0]
    rows = [(0, v), (1, v), (2, v), (3, [1.0, 0.1, 2.0]), (4, None), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 2.0]),
            (7, [float("nan"), 1.0, 1.0]), (8, [float("inf"), 1.0, 1.0]), (9, [1.0, 2.0]), (None, v), (100, [5.0, 5.0, 5.0]),
            (200, None), (300, []), (2, v)]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id long, embedding array<float>, label int, rank int")
    got = ann.nearest(df, df.where(F.col("vec_id") % 100 == 0)).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [
        (0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 4, 100), (100, 1, 3), (100, 2, 0), (100, 3, 1), (100, 4, 2)]
    assert got[0]["score"] == 0.0


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(df, df).count() == 0


def test_common_vector_takes_smallest_ids(spark):
    rng = np.random.default_rng(2)
    hot = rng.normal(size=8).tolist()
    rows = [(i, hot if i % 3 == 0 else rng.normal(size=8).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [r["vec_id"] for r in ann.nearest(df, df.where("vec_id = 300")).orderBy("rank").collect()]
    assert got == [0, 3, 6, 9, 12, 15, 18, 21, 24, 27]


def test_adaptive_scan_abandons_few_true_neighbours():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 64))
    turn = ann.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    ids, hit = np.arange(3000), 0
    for q in range(40):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = [i for i in np.lexsort((ids, d)) if i != q][:10]
        found, _ = ann.scan_block(ids, x, x @ turn, q, x[q], x[q] @ turn, math.inf, 10)
        hit += len(set(want) & set(found))
    assert hit >= 0.97 * 400

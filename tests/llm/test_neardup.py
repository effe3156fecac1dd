import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from ledgerlake.llm import neardup

from tests.llm.conftest import prose


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, num, den):
    """component of each row by exact comparison of all pairs"""
    sets = [shingle_set(t, k) for _, t, *_ in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None:
            both = len(sets[i] & sets[j])
            if both * den >= num * (len(sets[i]) + len(sets[j]) - both):
                top[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return sorted((r[0] is None, r[0] or 0, len(sets[i]), -1 if r[0] is None else least[find(i)]) for i, r in enumerate(rows))


def spark_rows(df):
    return sorted((r[0] is None, r[0] or 0, r[1], -1 if r[2] is None else r[2]) for r in df.select(
        "doc_id", "n_shingles", "component_id").collect())


def mutate(text, r, n):
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"z{r.randrange(10 ** 6)}"
    return " ".join(w)


def test_edge_rows(make, edge_rows):
    got = neardup.near_duplicates(make(edge_rows), 3, 85, 100)
    assert spark_rows(got) == brute(edge_rows, 3, 85, 100)
    for r in got.collect():
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_empty(make):
    assert neardup.near_duplicates(make([]), 3, 85, 100).count() == 0
    assert neardup.drop_near_duplicates(make([])).count() == 0


def test_random_families_equal_brute_force(make):
    """Families of near copies around the threshold: many links lie just above
    or below it, chains join texts that are far apart, and several components
    share band buckets."""
    r = random.Random(8)
    rows, i = [], 0
    for family in range(25):
        base = prose(r.randrange(4, 160), 1000 + family, 10 ** 6)
        text = base
        for _ in range(14):
            text = mutate(text if r.random() < 0.5 else base, r, r.randrange(0, 1 + len(base.split()) // 25))
            rows.append((i, text.upper() if i % 5 == 0 else text, "en", "s"))
            i += 1
    for k, num in ((3, 85), (5, 80)):
        assert spark_rows(neardup.near_duplicates(make(rows), k, num, 100)) == brute(rows, k, num, 100)


def test_large_group_of_near_copies(make):
    base = prose(120, 5, 10 ** 6)
    r = random.Random(2)
    rows = [(i, mutate(base, r, 1), "en", "s") for i in range(400)] + [(1000 + i, base, "en", "s") for i in range(200)]
    got = neardup.near_duplicates(make(rows), 3, 85, 100).collect()
    assert {x["component_id"] for x in got} == {0}
    left = neardup.drop_near_duplicates(make(rows), 3, 85, 100)
    assert [x["doc_id"] for x in left.collect()] == [0] and "node" in left.columns


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["label"] for r in neardup.components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100


def test_signature_estimates_similarity(spark):
    rng = np.random.default_rng(1)
    sign = neardup._signer(3, 40)
    import pyarrow as pa
    base = [f"q{v}" for v in rng.integers(0, 10 ** 6, 600)]
    other = base[:300] + [f"p{v}" for v in rng.integers(0, 10 ** 6, 300)]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([" ".join(base), " ".join(other)]),
                                       pa.array([7, 8])], names=["_ll_id", "_ll_text", "_ll_tag"])
    out = next(sign(iter([batch]))).to_pydict()
    df = spark.createDataFrame([(out["_ll_sig"][0], out["_ll_sig"][1])], "x array<long>, y array<long>")
    m = df.select(neardup.agreeing(F.col("x"), F.col("y"), 10)).first()[0]
    c = 2.0 ** -neardup.BITS
    sets = [shingle_set(" ".join(t), 3) for t in (base, other)]
    true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    assert abs((m / 160 - c) / (1 - c) - true) < 0.15
    assert neardup.least_matches(0.85, 80) < 80 * (c + (1 - c) * 0.85)


def test_repeated_id_keeps_one_row(make):
    rows = [(1, "a b c d e f", "en", "s")] * 3 + [(2, "x y z", "en", "s"), (None, "a b c d e f", "en", "s")]
    got = neardup.drop_near_duplicates(make(rows)).collect()
    assert sorted((r["doc_id"] or 0) for r in got) == [0, 1, 2]


def test_unrelated_texts_of_one_id_both_stay(make):
    text = prose(120, 5, 10 ** 6)
    near = " ".join(text.split()[:-1])
    rows = [(1, text, "en", "s"), (2, near, "en", "s"), (2, prose(90, 6, 10 ** 6), "en", "s"), (2, None, "en", "s"),
            (3, text, "en", "s"), (1, text, "en", "s")]
    got = neardup.drop_near_duplicates(make(rows)).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in got) == sorted([rows[0][:2], rows[2][:2], (2, "")])


def test_forgotten_checkpoints_are_gone(spark):
    import os

    from ledgerlake.llm import common
    frame = common.few(spark.range(1000).toDF("a"))
    at = frame._ll_whole._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:")
    assert os.path.isdir(at) and frame.count() == 1000
    common.forget(frame)
    assert not os.path.exists(at)


def test_group_of_near_copies_of_one_text_around_the_threshold(make):
    """Copies with more and more changes: some link with the base only, some
    with a few others, some with nothing; the base is not the earliest."""
    r = random.Random(5)
    base = prose(150, 77, 10 ** 6)
    rows = []
    for i in range(260):
        text = mutate(base, r, r.randrange(0, 9))
        if i % 7 == 0 and rows:
            text = mutate(rows[r.randrange(len(rows))][1], r, r.randrange(0, 4))
        rows.append((i, text, "en", "s"))
    rows.append((500, base, "en", "s"))
    for k, num in ((3, 85), (5, 80)):
        assert spark_rows(neardup.near_duplicates(make(rows), k, num, 100)) == brute(rows, k, num, 100)

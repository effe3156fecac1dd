import random

import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import mixing

from tests.llm.conftest import prose


def run(df):
    return mixing.digest(mixing.mix(df, mixing.words(F.col("text")))).collect()


def test_targets_reshare_the_excess():
    sizes = [("a", 100), ("b", 1000), ("c", 1000), (None, 10)]
    got = mixing.targets(sizes, [3, 1, 2, 3])
    assert got[0] == 200 and got[3] == 20
    assert sum(got) == pytest.approx(1.5 * 2110)
    assert all(t <= 2 * n + 1e-9 for t, (_, n) in zip(got, sizes))
    assert got[2] == pytest.approx(min(2000, 2 * got[1]))
    assert mixing.targets([("a", 0)], [3]) == [0.0]


def test_edge_rows(make, edge_rows):
    got = run(make(edge_rows))
    assert len(got) == len(edge_rows)
    for r in got:
        assert r["taken"] <= 2 * r["size"] and r["taken"] % max(1, r["size"]) == 0
    assert all(r["taken"] == 0 for r in got if r["doc_id"] in (2, 3, 4))


def test_empty(make):
    assert run(make([])) == []


def test_sources_come_near_their_targets_and_reruns_agree(make):
    r = random.Random(3)
    rows = [(i, prose(r.randrange(1, 60), i), "en", f"s{min(5, r.randrange(9))}") for i in range(3000)]
    source = {i: s for i, _, _, s in rows}
    a = run(make(rows).repartition(5))
    b = run(make(rows).repartition(2, F.col("lang")))
    assert sorted(a) == sorted(b)
    taken, target = {}, {}
    for x in a:
        s = source[x["doc_id"]]
        taken[s] = taken.get(s, 0) + x["taken"]
        target[s] = x["target"]
    assert all(abs(taken[s] - target[s]) <= 60 for s in taken)     # one document at most


def test_expectation_is_kept(make):
    """Over many keys a document is taken as often as its source's rate."""
    rows = [(i, "one two three", "en", "s" if i % 2 else "t") for i in range(4000)]
    got = run(make(rows))
    by = {}
    for x in got:
        by.setdefault(x["target"] / x["source_size"], []).append(x["taken"] / 3)
    for rate, copies in by.items():
        assert abs(sum(copies) / len(copies) - rate) < 0.002
        first = copies[:400]
        assert abs(sum(first) / len(first) - rate) < 0.1


def test_apply_mix_repeats_rows(make, edge_rows):
    docs = make(edge_rows)
    mixed = mixing.mix(docs, mixing.words(F.col("text")))
    out = mixing.apply_mix(docs, mixed)
    assert out.columns == docs.columns
    assert out.count() == mixed.agg(F.sum("copies")).first()[0]

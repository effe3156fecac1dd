"""Lexical search against an exhaustive ranking."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ledgerlake.llm import lexical


def terms(text):
    lower = {i: i + 32 for i in range(65, 91)}
    return re.findall(lexical.TERM, (text or "").translate(lower))


def brute(docs, items, top=20):
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    held = [x for x in held if x[2]]
    n, length = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for t, x in df.items()}
    out = []
    for item, text in dict.fromkeys(items):
        q = Counter(terms(text))
        got = []
        for i, c, size in held:
            m = 75 + 25 * size * n // length
            s = sum(k * w[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, k in q.items() if t in c)
            if s > 0:
                got.append((-s, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(got)[:top], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


def zipf(n, r):
    return " ".join(f"w{int(r.paretovariate(0.7)) % 900}" for _ in range(n))


@pytest.fixture(scope="module")
def items(spark):
    def of(rows):
        return spark.createDataFrame([(*r, 1) for r in rows], "item_id long, text string, doc_id int")
    return of


def test_equals_exhaustive_ranking(make, items):
    r = random.Random(1)
    texts = [zipf(r.randrange(1, 120), r) for _ in range(700)]
    docs = [(i, t) for i, t in enumerate(texts + texts[:150])]
    queries = [(i, zipf(r.randrange(1, 40), r)) for i in range(25)]
    df = make([(i, t, "en", "s") for i, t in docs])
    want = brute(docs, queries)
    assert rows(lexical.search(df, items(queries))) == want
    # several batches of queries, several small blocks in each task
    assert rows(lexical.search(df.repartition(3), items(queries), batch_terms=60, block=1500, task=3000)) == want


def test_odd_rows(make, items, edge_rows):
    edge_rows = edge_rows + [(11, "É é ABC abc 1-2", "fr", "s")]
    docs = [(r[0], r[1]) for r in edge_rows]
    queries = [(1, edge_rows[0][1]), (2, None), (3, ""), (4, "zzz qqq"), (None, "one Ünï"), (6, "ABC É"),
               (6, "ABC É"), (7, edge_rows[5][1])]
    assert rows(lexical.search(make(edge_rows), items(queries))) == brute(docs, queries)


def test_empty_tables(make, items):
    assert lexical.search(make([]), items([(1, "a")])).count() == 0
    assert lexical.search(make([(1, "a", "en", "s")]), items([])).count() == 0
    assert lexical.search(make([(1, None, "en", "s")]), items([(1, "a")])).count() == 0


def test_documents_are_skipped(monkeypatch):
    """A rare term decides: long lists are entered for few documents only."""
    r = random.Random(2)
    n = 20_000
    doc = np.concatenate([np.arange(n), np.arange(0, n, 2), np.sort(np.array(r.sample(range(n), 60)))])
    term = np.repeat([0, 1, 2], [n, n // 2, 60])
    corpus = lexical.Corpus(n, n * 50, np.array([3, 700, 6000]))
    block = lexical.Block(pa.array(range(n)), np.full(n, 50), term, doc, np.ones(len(doc), np.int64), corpus)
    entered = []
    plain = lexical._entered
    monkeypatch.setattr(lexical, "_entered", lambda d, a, w: entered.append(len(w)) or plain(d, a, w))
    found, score = lexical.best_of(block, [(0, 1), (1, 1), (2, 1)], 20)
    whole = np.zeros(n, np.int64)
    for d, a in block.lists([(0, 1), (1, 1), (2, 1)]):
        whole[d] += a
    assert sorted(score)[-20:] == sorted(whole)[-20:] and sum(entered) <= 200

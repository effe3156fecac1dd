import hashlib
import re

import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import decontam

from tests.llm.conftest import prose


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(rows, items, n=10):
    out = []
    for i, t, *_ in rows:
        w = words(t)
        hit, found = set(), set()
        for item, text in items:
            v = words(text)
            k = min(n, len(v))
            wins = {tuple(v[p:p + k]) for p in range(len(v) - k + 1)} if v else set()
            for p in range(len(w) - k + 1):
                if k and tuple(w[p:p + k]) in wins:
                    hit.update(range(p, p + k))
                    if item is not None:
                        found.add(str(item))
        ids = ",".join(sorted(found))
        out.append((i is None, i or 0, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out)


def got(df):
    return sorted((r[0] is None, r[0] or 0, *r[1:]) for r in df.select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())


@pytest.fixture()
def case(spark, make, edge_rows):
    passage = prose(30, 50, 10 ** 6)
    w = passage.split()
    rows = [*edge_rows, (20, f"x, {passage.upper()}! y", "en", "s"), (21, " ".join(w[5:15]), "en", "s"),
            (22, " ".join(w[5:14]), "en", "s"), (23, f"{passage} and {passage}", "en", "s"),
            (24, "tinyé item here", "en", "s"), (24, "tinyé item here", "en", "s")]
    items = [(1, passage), (10, passage), (2, "Tinyé item"), (3, None), (4, "..."), (None, prose(60, 2)), (5, "one")]
    return rows, items, make(rows), spark.createDataFrame(items, "item_id long, text string")


def test_equals_brute_force(case):
    rows, items, docs, bench = case
    assert got(decontam.digest(decontam.contamination(docs, bench))) == brute(rows, items)


def test_parts_of_the_hash_set(case, monkeypatch):
    monkeypatch.setattr(decontam, "MAX_BROADCAST_WINDOWS", 7)
    rows, items, docs, bench = case
    assert got(decontam.digest(decontam.contamination(docs, bench))) == brute(rows, items)


def test_empty_tables(case, make):
    rows, items, docs, bench = case
    assert decontam.digest(decontam.contamination(make([]), bench)).count() == 0
    assert got(decontam.digest(decontam.contamination(docs, bench.limit(0)))) == brute(rows, [])


def test_drop_documents(case):
    rows, items, docs, bench = case
    out = decontam.decontaminate(docs, bench)
    assert out.columns == docs.columns
    dirty = {(r[0], r[1]) for r in brute(rows, items) if r[6]}
    want = sorted((r[0] is None, r[0] or 0) for r in rows if (r[0] is None, r[0] or 0) not in dirty)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.collect()) == want


def test_drop_spans(case):
    rows, items, docs, bench = case
    out = decontam.decontaminate(docs, bench, action="span")
    assert out.columns == docs.columns and out.count() == len(rows)
    text = {r["doc_id"]: r["text"] for r in out.collect()}
    assert words(text[20]) == ["x", "y"] and text[20].startswith("x, ") and text[20].endswith("! y")
    assert text[22] == dict((r[0], r[1]) for r in rows)[22]
    assert words(text[23]) == ["and"] and words(text[24]) == ["here"] and text[2] is None
    again = decontam.digest(decontam.contamination(out.where("doc_id in (20, 21, 22, 23)"), bench))
    assert again.agg(F.sum("n_hit")).first()[0] == 0


def test_unknown_action(case):
    with pytest.raises(ValueError):
        decontam.decontaminate(case[2], case[3], action="nothing")


def test_one_instruction_in_all_items(make, spark):
    told = prose(14, 3, 10 ** 6)
    items = [(i, f"{told} {prose(12, i + 9, 10 ** 6)}") for i in range(300)]
    rows = [(1, told, "en", "s"), (2, items[7][1], "en", "s"), (3, prose(40, 1), "en", "s"), (None, told, "en", "s")]
    docs, bench = make(rows), spark.createDataFrame(items, "item_id long, text string")
    assert got(decontam.digest(decontam.contamination(docs, bench))) == brute(rows, items)
    wins, links = decontam.benchmark_windows(bench)
    assert wins.columns == ["_ll_wid", "_ll_len", "_ll_win", "_ll_hash"]     # what is broadcast lists no items
    assert links.count() == sum(len({tuple(words(t)[p:p + 10]) for p in range(len(words(t)) - 9)}) for _, t in items)

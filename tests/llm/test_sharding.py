import random
import zlib

from pyspark.sql import functions as F

from ledgerlake.llm import sharding


def check(rows, got, shards=24):
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in rows)
    place, slots, load = {}, {}, [0] * shards
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(i, t)
    for r in got:
        t = texts[r["doc_id"]]
        size = len((t or "").encode()) + 8
        assert r["size"] == size
        assert r["text_crc32"] == (None if t is None else zlib.crc32(t.encode()))
        assert place.setdefault(t, r["shard"]) == r["shard"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        load[r["shard"]] += size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return load


def test_edge_rows(make, edge_rows):
    check(edge_rows, sharding.shard_query(make(edge_rows)).collect())


def test_empty(make):
    assert sharding.shard_query(make([])).count() == 0


def test_as_even_as_plain_lpt(make):
    r = random.Random(4)
    rows = [(i, "x" * int(r.paretovariate(1.1) * 20) + str(r.randrange(900)), "en", "s") for i in range(3000)]
    got = sharding.shard_query(make(rows)).collect()
    load = check(rows, got)
    sizes = {}
    for _, t, *_ in rows:
        sizes[t] = sizes.get(t, 0) + len(t) + 8
    plan = sharding.lpt(list(sizes.items()), 24)
    plain = [0] * 24
    for t, s in sizes.items():
        plain[plan[t]] += s
    assert max(load) <= max(plain) + 2 * min(sizes.values())
    assert max(load) >= sharding.balance_bound(list(sizes.values()), 24)


def test_hot_group_stays_together(make):
    rows = [(i, "copy" if i % 3 == 0 else f"text {i}", "en", "s") for i in range(900)]
    check(rows, sharding.shard_query(make(rows)).collect())


def test_same_under_another_partitioning(make):
    rows = [(i, f"text {i % 70} " + "y" * (i % 50), "en", "s") for i in range(500)]
    a = sharding.shard_query(make(rows).repartition(3)).orderBy("doc_id").collect()
    b = sharding.shard_query(make(rows).repartition(7, F.col("text"))).orderBy("doc_id").collect()
    assert a == b

import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import warc


@pytest.fixture()
def pages(spark):
    big = "<p>é\n" * 1000
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, "http://a/3", "small"), (4, "http://a/4", "small"),
            (5, None, None), (6, "http://a/x\r\nWARC-Type: fake\r\n\r\n", ""), (None, "http://a/n", big),
            (7, "http://a/7", "x" * 999), (8, "http://a/8", "x" * 999), (9, "http://a/9", "y" * 1000),
            (10, "http://a/10", "y" * 1000), (11, "http://a/11", "line\r\nWARC/1.1\r\n\r\nend\n\n"),
            (12, "http://a/12", "\n"), (13, "http://a/13", "ü" * 700_001), (13, "http://a/13", "ü" * 700_001),
            (14, "http://a/14", "q\n" * 400_000)]
    return rows, spark.createDataFrame([(*r, "n", 0) for r in rows], "page_id long, url string, html string, n string, last int")


def expect(rows):
    keep = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000 and i is not None:
            keep[b] = max(i, keep.get(b, i))
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        k = keep.get(b)
        back = k is not None and k != i
        out.append((i is None, i or 0, len(b), hashlib.sha1(b).hexdigest(), "revisit" if back else "response", k if back else 0))
    return sorted(out)


def test_round_trip(pages, tmp):
    rows, df = pages
    got = warc.round_trip(df.repartition(3), os.path.join(tmp, "w"))
    assert sorted((r[0] is None, r[0] or 0, r[1], r[2], r[3], r[4] or 0) for r in got.collect()) == expect(rows)


def test_chunks_carry_payload_and_running_digest(pages, tmp, spark):
    rows, df = pages
    path = os.path.join(tmp, "w")
    warc.write_archives(df.coalesce(1), path)
    chunks = warc.read_archives(spark, path)
    by = {}
    for r in chunks.orderBy("page_id", "chunk_no").where("page_id in ('11', '13', '14') and record_type = 'response'").collect():
        by.setdefault(r["page_id"], {}).setdefault(r["chunk_no"], r)
    for i in (11, 13, 14):
        parts = [by[str(i)][n] for n in sorted(by[str(i)])]
        want = dict((r[0], r[2]) for r in rows)[i].encode()
        sha, n = hashlib.sha1(), 0
        for p in parts:
            assert len(p["payload"]) <= warc.CHUNK
            sha.update(bytes(p["payload"]))
            n += len(p["payload"])
            assert (p["sha1_so_far"], p["bytes_so_far"]) == (sha.hexdigest(), n)
        assert b"".join(bytes(p["payload"]) for p in parts) == want
        assert parts[-1]["last"] and parts[-1]["complete"] and parts[-1]["declared"] == sha.hexdigest()
    assert len(by["13"]) > 3


def test_archive_bytes_follow_the_format(pages, tmp):
    rows, df = pages
    path = os.path.join(tmp, "w")
    warc.write_archives(df.where("page_id = 13 OR page_id = 2").coalesce(1).dropDuplicates(["page_id"]).coalesce(1), path)
    data = b"".join(gzip.open(os.path.join(path, f)).read() for f in sorted(os.listdir(path)) if f.endswith(".gz"))
    at, kinds, total = 0, [], 0
    while at < len(data):
        head, _, rest = data[at:].partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n")
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        n = int(fields[b"Content-Length"])
        assert rest[n:n + 4] == b"\r\n\r\n"
        kinds.append(fields[b"WARC-Type"])
        at += len(head) + 4 + n + 4
    assert kinds.count(b"response") == 2 and kinds.count(b"continuation") == 2


def test_cut_archive_is_marked(tmp, spark):
    path = os.path.join(tmp, "w")
    os.makedirs(path)
    whole = (b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <a>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n")
    with gzip.open(os.path.join(path, "a.gz"), "wb") as f:
        f.write(whole + whole[:-6])
    with gzip.open(os.path.join(path, "b.gz"), "wb") as f:
        f.write(whole)
    got = warc.read_archives(spark, path).select("bytes_so_far", "complete").collect()
    assert sorted((r[0], r[1]) for r in got if r[1]) == [(3, True), (3, True)]
    assert len(got) == 3


def test_empty(pages, tmp):
    assert warc.round_trip(pages[1].limit(0), os.path.join(tmp, "w")).count() == 0
    assert warc.round_trip(pages[1].where(F.col("page_id") == 5)).collect()[0]["payload_bytes"] == 0

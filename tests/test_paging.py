"""Keyset paging: pages concatenate to the full ordered set exactly once."""

import datetime as dt

from ledgerlake.operators import paging as L


def test_pages_cover_ties_once(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(f"{i:03d}", base + dt.timedelta(minutes=i // 7)) for i in range(53)]
    df = spark.createDataFrame(rows, "id string, created_at timestamp_ntz")
    seen, cursor = [], None
    while True:
        conn = L.connection(df, "created_at", first=10, after=cursor)
        page = conn.edges.collect()
        info = conn.page_info.first()
        seen += [r["id"] for r in page]
        if not info["has_next_page"]:
            break
        cursor = (info["end_cursor"]["k"], info["end_cursor"]["id"])
    expect = [r[0] for r in sorted(rows, key=lambda r: (r[1], r[0]), reverse=True)]
    assert seen == expect
    assert conn.total_count.first()["total_count"] == 53


def test_page_before_ascending(spark):
    df = spark.createDataFrame([(str(i), i) for i in range(30)], "id string, seq long")
    conn = L.connection(df, "seq", last=5, before=(10, "10"))
    assert [r["seq"] for r in conn.edges.collect()] == [11, 12, 13, 14, 15]


def test_exact_boundary_has_next(spark):
    df = spark.createDataFrame([(str(i), i) for i in range(20)], "id string, seq long")
    assert not L.connection(df, "seq", first=20).page_info.first()["has_next_page"]
    assert L.connection(df, "seq", first=19).page_info.first()["has_next_page"]


def test_connection_on_empty_table(spark):
    df = spark.createDataFrame([], "id string, created_at timestamp_ntz")
    conn = L.connection(df, "created_at", first=10)
    info = conn.page_info.first()
    assert conn.edges.count() == 0
    assert (info["has_next_page"], info["start_cursor"], info["end_cursor"]) == (False, None, None)
    assert conn.total_count.first()["total_count"] == 0

"""Q4: the file and line of invalid landed records."""

import gzip
import json

import pytest

from ledgerlake.operators import quality as Q
from ledgerlake.sources import raw

from tests.test_quality import VALID_TX


@pytest.fixture()
def landed(tmp_path):
    """Three files with blank and unreadable lines, one of them compressed;
    {(file name, line from 1): text} of the invalid records."""
    bad = {}
    for name, n in (("a.json", 400), ("b.json", 3), ("c.json.gz", 50)):
        lines = []
        for i in range(1, n + 1):
            kind = (i * 7 + n) % 23
            text = json.dumps({k: v for k, v in {**VALID_TX, "id": f"{name}{i}"}.items() if v is not None})
            if kind == 0:
                text = "  " if i % 2 else ""
            elif kind == 3:
                text = '{"id": "torn' + str(i)
                bad[name, i] = text
            elif kind == 5:
                text = text.replace('"ledger": 1000', '"ledger": -1')
                bad[name, i] = text
            lines.append(text)
        data = "\n".join(lines).encode()
        (tmp_path / name).write_bytes(gzip.compress(data) if name.endswith("gz") else data)
    return str(tmp_path), bad


@pytest.mark.parametrize("split", ["2k", "16k", "128m"])
def test_positions_do_not_depend_on_splits(spark, landed, split):
    path, bad = landed
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        lines = raw.read_lines(spark, path, "transaction")
        valid, invalid = Q.split_valid_lines(lines, "transaction")
        found = {(r["file"].rsplit("/", 1)[1], r["line"]): r["raw"] for r in invalid.collect()}
        ids = {r["id"] for r in valid.collect()}
        if split == "2k":
            assert lines.rdd.getNumPartitions() > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == bad and len(bad) > 10
    want, _ = Q.split_valid(raw.read_raw(spark, path, "transaction"), "transaction")
    assert ids == {r["id"] for r in want.collect()} and set(valid.columns) == set(want.columns)


def test_errors_name_their_field(spark, landed):
    _, invalid = Q.split_valid_lines(raw.read_lines(spark, landed[0], "transaction"), "transaction")
    rows = {r["raw"]: r["error"] for r in invalid.collect()}
    assert all(("id: Required" in e) == ("torn" in raw_text) for raw_text, e in rows.items())
    assert any(e.startswith("ledger: ") for e in rows.values())


def test_no_lines(spark, tmp_path):
    (tmp_path / "empty.json").write_text("")
    valid, invalid = Q.split_valid_lines(raw.read_lines(spark, str(tmp_path), "transaction"), "transaction")
    assert valid.count() == 0 and invalid.count() == 0

"""Roll-ups of account activity against direct counts over the facts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import aggregates as A
from ledgerlake.operators import rollups as R

BASE = dt.datetime(2024, 3, 1)
AS_OF = ["2024-03-20 00:00:00", "2024-03-20 13:00:00", "2024-03-20 13:27:41.000007", "2024-03-31 23:59:59.999999",
         "2024-03-01 00:10:00", "2023-01-01 00:00:00", None]


@pytest.fixture(scope="module")
def facts(spark):
    r = random.Random(5)
    rows = [(f"a{r.randrange(90) if r.random() < .6 else 0}",
             BASE + dt.timedelta(microseconds=r.randrange(32 * 86400 * 10 ** 6))) for _ in range(4000)]
    at = dt.datetime(2024, 3, 20, 13, 27, 41, 7)
    rows += [("edge24", at - dt.timedelta(days=1)), ("edge24x", at - dt.timedelta(days=1, microseconds=1)),
             ("edge7", at - dt.timedelta(days=7)), ("now", at), ("after", at + dt.timedelta(microseconds=1)),
             (None, at), ("timeless", None)]
    return spark.createDataFrame(rows, "source_account string, created_at timestamp_ntz").withColumn(
        "batch", F.pmod(F.xxhash64("source_account", "created_at"), F.lit(3))).cache()


@pytest.fixture(scope="module")
def root(spark, facts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("rolled"))
    for b in (0, 1, 1, 2, 1):        # batches come again, also out of order
        R.roll_up(spark, path, facts.where(F.col("batch") == b).drop("batch"), b)
    return path


@pytest.mark.parametrize("as_of", AS_OF)
def test_active_accounts_equal_the_direct_count(spark, facts, root, as_of):
    assert R.active_accounts(spark, root, facts, as_of).first() == A.active_accounts(facts, as_of).first()


@pytest.mark.parametrize("as_of", [AS_OF[2], AS_OF[3]])
def test_overview_equals_the_direct_form(spark, facts, root, as_of):
    led = spark.range(7)
    timed = facts.where("created_at IS NOT NULL AND source_account IS NOT NULL")
    got, want = R.network_overview(spark, root, facts, led, as_of).first(), A.network_overview(timed, led, as_of).first()
    assert got["total_accounts"] == want["total_accounts"] and got["total_ledgers"] == 7
    assert got["active_accounts_24h"] == want["active_accounts_24h"]


@pytest.mark.parametrize("as_of", AS_OF)
def test_account_activity_equals_the_direct_form(spark, facts, root, as_of):
    acct = facts.where("source_account IS NOT NULL").select(F.col("source_account").alias("account_id")).distinct().withColumn(
        "balance", F.lit("0"))
    want = A.build_account_metrics(acct, facts, spark.createDataFrame([], "account_id string"), as_of).where(
        "first_transaction IS NOT NULL")
    got = R.account_activity(spark, root, facts, as_of)
    assert sorted(got.collect()) == sorted(want.select(*got.columns).collect())


def test_whole_hours_are_not_read_from_the_facts(spark, facts, root):
    as_of = AS_OF[2]
    now = dt.datetime.fromisoformat(as_of)
    spans = [p for pieces in R._spans(now, False).values() for p in pieces["facts"]]
    assert sum((b - a for a, b in set(spans)), dt.timedelta()) < 4 * R.HOUR
    only = facts.where(R._inside("created_at", spans))
    assert only.count() < facts.count() / 20
    assert R.active_accounts(spark, root, only, as_of).first() == A.active_accounts(facts, as_of).first()


def test_time_bounds_reach_the_scans(spark, facts, root, tmp_path):
    facts.drop("batch").write.parquet(f"{tmp_path}/facts")
    plan = R.active_accounts(spark, root, spark.read.parquet(f"{tmp_path}/facts"), AS_OF[2])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("GreaterThanOrEqual(start") >= 2 and "GreaterThanOrEqual(created_at" in text


def test_numbers_have_no_gaps_and_survive_a_replay(spark, facts, root):
    before = sorted(R._numbers(spark, root).collect())
    assert sorted(r["number"] for r in before) == list(range(1, len(before) + 1))
    R.roll_up(spark, root, facts.where("batch = 2").drop("batch"), 2)
    assert sorted(R._numbers(spark, root).collect()) == before


def test_empty(spark, facts, tmp_path):
    root, none = str(tmp_path / "r"), facts.limit(0).drop("batch")
    R.roll_up(spark, root, none, 0)
    for as_of in (None, AS_OF[0]):
        assert tuple(R.active_accounts(spark, root, none, as_of).first()) == (0, 0, 0)
        assert R.account_activity(spark, root, none, as_of).count() == 0


@pytest.mark.parametrize("start, end", [(BASE, BASE + dt.timedelta(days=3)), (BASE + R.TICK, BASE + 5 * R.HOUR),
                                        (BASE + R.TICK, BASE + 2 * R.TICK), (BASE, BASE), (None, BASE + R.HOUR + R.TICK)])
def test_cover_is_a_partition(start, end):
    pieces = sorted((x for v in R.cover(start, end).values() for x in v), key=lambda x: x[0] or dt.datetime.min)
    assert all(a[1] == b[0] for a, b in zip(pieces, pieces[1:]))
    if start != end:
        assert pieces[0][0] == start and pieces[-1][1] == end
    else:
        assert not pieces

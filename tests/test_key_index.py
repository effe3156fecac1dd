"""Key index of insert-ignore (S5) on hash keys."""

import glob
import os
import shutil

from pyspark.sql import functions as F

from ledgerlake.sources import key_index, sinks


def hashes(spark, lo, hi):
    return spark.range(lo, hi).select(F.sha2(F.col("id").cast("string"), 256).alias("hash"), F.col("id").alias("v"))


def test_new_keys_open_few_files(spark, tmp):
    path = os.path.join(tmp, "t")
    hashes(spark, 0, 40_000).repartition(60).write.parquet(path)
    key_index.add_files(spark, path, spark.read.parquet(path).inputFiles(), ["hash"])
    files = glob.glob(f"{path}/*.parquet")
    fresh = hashes(spark, 100_000, 101_000)
    opened = key_index.candidate_files(spark, path, fresh, ["hash"], sinks._exists)
    assert len(files) == 60 and len(opened) <= 0.05 * len(files)
    # keys of one file open that file
    some = spark.read.parquet(files[0]).limit(50)
    opened = key_index.candidate_files(spark, path, some, ["hash"], sinks._exists)
    assert os.path.basename(files[0]) in {os.path.basename(f) for f in opened} and len(opened) <= 1 + 0.05 * len(files)


def test_many_files_and_exact_appends(spark, tmp):
    path = os.path.join(tmp, "t")
    for k in range(12):       # each batch repeats half of the one before
        n = sinks.insert_ignore_table(spark, path, hashes(spark, 500 * k, 500 * k + 1000), "hash", key_index=True)
        assert n == (1000 if k == 0 else 500)
    got = spark.read.parquet(path)
    assert got.count() == 6500 == got.select("hash").distinct().count()
    files = got.inputFiles()
    opened = key_index.candidate_files(spark, path, hashes(spark, 10**6, 10**6 + 1000), ["hash"], sinks._exists)
    assert len(files) >= 12 and len(opened) <= 0.05 * len(files) + 1


def test_files_the_index_does_not_know_are_read(spark, tmp):
    path = os.path.join(tmp, "t")
    sinks.insert_ignore_table(spark, path, hashes(spark, 0, 100), "hash", key_index=True)
    hashes(spark, 100, 200).write.mode("append").parquet(path)           # stopped before it was indexed
    assert sinks.insert_ignore_table(spark, path, hashes(spark, 0, 250), "hash", key_index=True) == 50
    shutil.move(key_index.index_path(path), os.path.join(tmp, "lost"))    # an index can be built anew
    assert sinks.insert_ignore_table(spark, path, hashes(spark, 0, 260), "hash", key_index=True) == 10
    assert sinks.insert_ignore_table(spark, path, hashes(spark, 0, 260), "hash", key_index=True) == 0


def test_several_key_columns_partitions_and_nulls(spark, tmp):
    path = os.path.join(tmp, "t")
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("b", 1, "y"), (None, 1, "y")], "k string, n long, p string")
    assert sinks.insert_ignore_table(spark, path, df, ["k", "n"], partition_by=["p"], key_index=True) == 4
    more = spark.createDataFrame([("a", 1, "x"), ("c", 1, "y"), (None, 1, "y")], "k string, n long, p string")
    assert sinks.insert_ignore_table(spark, path, more, ["k", "n"], partition_by=["p"], key_index=True) == 2  # null keys never match
    assert sinks.insert_ignore_table(spark, path, more.limit(0), ["k", "n"], key_index=True) == 0

"""The keyed table: merges against the plain upsert, bytes written, versions, failures and compaction."""

import os
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from tagtrail.operators import graph
from tagtrail.session import scratch_path
from tagtrail.sources import keyed_table as kt


def rows(df):
    return sorted(str(sorted(r.asDict().items(), key=str)) for r in df.collect())


def table(spark, n=20_000):
    return spark.range(n).select(F.col("id").cast("string").alias("k"), F.col("id").alias("v"), F.sha2(F.col("id").cast("string"), 256).alias("payload"))


def size(path, name):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(f"{urlparse(path).path}/data/{name}") for f in fs if f.endswith(".parquet"))


@pytest.mark.parametrize("create_only", [False, True])
def test_merges_equal_the_plain_upsert(spark, create_only):
    old = table(spark, 300).unionByName(spark.createDataFrame([(None, 5, "none")], "k string, v bigint, payload string"))
    path = scratch_path(spark, "keyed")
    kt.create_table(old, path, ["k"], buckets=4)
    new = spark.range(250, 350).select(F.col("id").cast("string").alias("k"), (F.col("id") * 10).alias("v"), F.lit("x").alias("more"))
    new = new.unionByName(new.where("v % 3 = 0").withColumn("v", F.col("v") + 1))
    want = rows(graph.upsert(old, new, ["k"], ["v"], create_only))
    for _ in range(2):  # a merge twice over changes nothing
        kt.merge(spark, path, new, ["v"], create_only)
        assert rows(kt.read_table(spark, path)) == want
    assert rows(kt.read_table(spark, path, 1)) == rows(old)
    kt.merge(spark, path, spark.createDataFrame([(None, 7, "again")], "k string, v bigint, payload string"), ["v"])
    assert kt.read_table(spark, path).where("k is null").select("v").collect() == [(7,)]


def test_a_merge_of_one_key_in_a_hundred_writes_as_much(spark):
    path = scratch_path(spark, "keyed")
    first = kt.create_table(table(spark, 200_000), path, ["k"], buckets=2)
    base = size(path, first.segments[0][0][0])
    second = kt.merge(spark, path, table(spark, 200_000).where("v % 100 = 7").withColumn("payload", F.sha2(F.concat("payload", F.lit("!")), 256)), ["v"])
    assert {len(s) for s in second.segments.values()} == {2}
    assert size(path, second.segments[0][1][0]) < 0.02 * base
    assert {s[0] for s in second.segments.values()} == {s[0] for s in first.segments.values()}
    assert kt.read_table(spark, path).count() == 200_000


def test_a_failed_merge_leaves_the_version_before(spark):
    path = scratch_path(spark, "keyed")
    kt.create_table(table(spark, 100), path, ["k"], buckets=2)
    before = rows(kt.read_table(spark, path))
    bad = table(spark, 50).withColumn("v", F.when(F.col("v") == 31, F.raise_error(F.lit("lost"))).otherwise(F.col("v") + 1).cast("bigint"))
    with pytest.raises(Exception, match="lost"):
        kt.merge(spark, path, bad, ["v"])
    assert kt.version_numbers(spark, path) == [1] and rows(kt.read_table(spark, path)) == before
    kt.merge(spark, path, table(spark, 50).withColumn("v", F.col("v") + 1), ["v"])
    assert kt.read_table(spark, path).agg(F.sum("v")).first()[0] == sum(range(100)) + 50


def test_two_writers_of_one_version_do_not_both_win(spark):
    path = scratch_path(spark, "keyed")
    kt.create_table(table(spark, 10), path, ["k"])
    one = kt.version(spark, path)
    kt.merge(spark, path, table(spark, 3).withColumn("v", F.lit(1).cast("bigint")), ["v"])
    with pytest.raises(RuntimeError, match="another job"):
        kt._commit(spark, path, kt.Version(2, one.keys, one.buckets, one.schema, one.segments))


def test_compaction_and_vacuum(spark, monkeypatch):
    monkeypatch.setattr(kt, "MAX_CHANGES", 2)
    path = scratch_path(spark, "keyed")
    kt.create_table(table(spark, 2000), path, ["k"], buckets=2)
    for n in range(4):
        v = kt.merge(spark, path, table(spark, 2000).where(f"v % 97 = {n}").withColumn("v", F.lit(n).cast("bigint")), ["v"])
        assert max(len(s) for s in v.segments.values()) <= 3
    want = rows(kt.read_table(spark, path))
    gone = kt.vacuum(spark, path, keep=1)
    assert gone and kt.version_numbers(spark, path) == [5] and rows(kt.read_table(spark, path)) == want
    assert kt.vacuum(spark, path) == []


def test_empty_tables_and_repeated_keys(spark):
    path = scratch_path(spark, "keyed")
    kt.create_table(table(spark, 0), path, ["k"])
    assert kt.read_table(spark, path).count() == 0
    kt.merge(spark, path, table(spark, 0), ["v"])
    kt.merge(spark, path, table(spark, 5), ["v"])
    assert kt.read_table(spark, path).count() == 5
    with pytest.raises(ValueError, match="several rows"):
        kt.create_table(table(spark, 5).unionByName(table(spark, 1)), scratch_path(spark, "keyed"), ["k"])

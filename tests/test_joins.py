"""Hot and missing keys: results as of a plain join, rows over many tasks."""

import pytest
from pyspark.sql import functions as F

from tagtrail.operators import joins
from tagtrail.operators.ordering import exact_quantiles, with_position


def tables(spark, n=6000):
    left = spark.range(n).select(
        F.col("id").alias("row"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 10 != 1, (F.col("id") % 700).cast("string")).alias("k"),
    )
    right = spark.range(600).select(F.when(F.col("id") == 0, F.lit("hot")).when(F.col("id") != 7, F.col("id").cast("string")).alias("k"), F.col("id").alias("v"))
    return left, right.unionByName(right.where("v < 3").withColumn("v", F.col("v") + 1000))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("null_safe", [False, True])
def test_split_join_equals_plain_join(spark, how, null_safe):
    left, right = tables(spark)
    got = joins.split_join(left, right, ["k"], how, ["row"], parts=16, null_safe=null_safe)
    same = F.col("l.k").eqNullSafe(F.col("r.k")) if null_safe else F.col("l.k") == F.col("r.k")
    want = left.alias("l").join(right.alias("r"), same, how).select("l.row", "l.k", *(["r.v"] if how in ("inner", "left") else []))
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_hot_key_is_dealt_over_tasks(spark):
    left, right = tables(spark)
    assert joins.hot_hashes(left.where("k is not null"), F.xxhash64("k"), 32) == {spark.range(1).select(F.xxhash64(F.lit("hot"))).first()[0]: 23}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        held = joins.split_join(left, right, ["k"], "left", ["row"]).groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    counts = sorted(r["count"] for r in held)
    assert len(counts) >= 28 and counts[-1] < 3 * counts[len(counts) // 2]


def test_split_join_of_empty_tables_and_clashes(spark):
    left, right = tables(spark)
    assert joins.split_join(left.limit(0), right, ["k"], "left", ["row"]).count() == 0
    assert joins.split_join(left, right.limit(0), ["k"], "left", ["row"]).count() == left.count()
    with pytest.raises(ValueError):
        joins.split_join(left, right.withColumnRenamed("v", "row"), ["k"])


def test_null_groups_keep_their_positions_and_quantiles(spark):
    rows = spark.createDataFrame([(None, 3.0), ("a", 1.0), (None, 1.0), (None, 2.0), ("a", 5.0)], "tag string, value double")
    placed = {(r["tag"], r["value"], r["pos"]) for r in with_position(rows, ["tag"], ["value"]).collect()}
    assert placed == {(None, 1.0, 1), (None, 2.0, 2), (None, 3.0, 3), ("a", 1.0, 1), ("a", 5.0, 2)}
    assert {(r["tag"], r["m"]) for r in exact_quantiles(rows, ["tag"], "value", {"m": 0.5}).collect()} == {(None, 2.0), ("a", 3.0)}

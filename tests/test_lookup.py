"""Lookups with hot keys give the plain join's result, spread over tasks."""

import pytest
from pyspark.sql import functions as F

from custvoice.operators import lookup


@pytest.fixture(scope="module")
def sides(spark):
    # A third of all rows has one key, a third has none.
    left = spark.range(3000).select(
        F.col("id").alias("_seq"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, None)
        .otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"))
    right = spark.range(40).select(
        F.concat(F.lit("k"), "id").alias("key"), F.col("id").alias("value")).union(
        spark.createDataFrame([("hot", 99), (None, 5), ("idle", 6)], "key string, value long"))
    return left, right


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
@pytest.mark.parametrize("hot_rows", [10, 100, 10_000, None])
def test_equals_plain_join(sides, how, hot_rows):
    left, right = sides
    got = lookup.lookup_join(left, right, "key", how, hot_rows=hot_rows)
    plain = left.join(right, "key", how)
    assert set(got.columns) == set(plain.columns)
    rows = [tuple(r) for r in got.select(plain.columns).collect()]
    assert sorted(rows, key=repr) == sorted(map(tuple, plain.collect()), key=repr)


def test_hot_key_is_spread(spark, sides):
    left, right = sides
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = lookup.lookup_join(left, right, "key", "inner", hot_rows=50)
        sizes = got.where("key = 'hot'").groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in sizes) == 1000
        assert len(sizes) >= 6 and max(r["count"] for r in sizes) < 400
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture()
def shuffled(spark):
    """Joins are shuffled, 3000 rows to partitions of fifty; larger ones are split."""
    settings = {
        "spark.sql.shuffle.partitions": "60",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200b",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.mark.parametrize("how, key", [
    ("inner", "key = 'hot'"), ("left", "key = 'hot'"), ("left", "key IS NULL")])
def test_adaptive_execution_splits_hot_and_missing_keys(shuffled, sides, how, key):
    left, right = sides
    # A right side that is summed by the key already is dealt anew all the same.
    right = right.groupBy("key").agg(F.max("value").alias("value"))
    got = lookup.lookup_join(left.repartition(8), right, "key", how)
    # The task is noted before the key is chosen, or the choice would reach the join.
    sizes = got.withColumn("task", F.spark_partition_id()).where(key).groupBy("task").count().collect()
    assert sum(r["count"] for r in sizes) == 1000
    assert len(sizes) > 2 and max(r["count"] for r in sizes) < 500
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_first_per_key(spark):
    df = spark.createDataFrame(
        [("a", 2, "x"), ("a", 1, None), ("b", 5, "z"), (None, 0, "n")],
        "key string, at long, value string")
    out = sorted(map(tuple, lookup.first_per_key(df, "key", "at", ["value"]).collect()))
    assert out == [("a", None), ("b", "z")]

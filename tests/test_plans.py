"""Joins under skew and tables in the shared folder."""

import gc
import os

import pytest
from pyspark.sql import functions as F

from quillgraph import session
from quillgraph.plans import skew


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_join_salts_hot_keys(spark, how):
    # a third of the rows on one key, 1/100 on each of many others, keys without a partner, nulls
    facts = spark.range(9_000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 100 == 1, F.concat(F.lit("warm"), F.col("id") % 7)).when(F.col("id") % 11 == 5, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"))
    dim = facts.filter("key IS NOT NULL AND key <> 'k7'").select("key").distinct().withColumn("value", F.length("key"))
    assert skew.spread(facts, ["key"], light=50)
    got = skew.lookup_join(facts, dim, ["key"], how, light=50)
    want = facts.join(dim, ["key"], how).select("id", "key", "value")
    assert got.columns == ["id", "key", "value"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_salted_rows_spread(spark):
    facts = spark.range(20_000).select("id", F.lit("one").alias("key"))
    (bucket, salts), *rest = skew.spread(facts, ["key"], light=100)
    assert not rest and salts == 16  # four per partition
    dim = spark.createDataFrame([("one", 1)], "key string, value int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = skew.lookup_join(facts, dim, ["key"], light=100).groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert max(r["n"] for r in got) < 12_000 and sum(r["n"] for r in got) == 20_000


def test_empty_sides(spark):
    facts = spark.createDataFrame([], "id bigint, key string")
    dim = spark.createDataFrame([], "key string, value int")
    assert skew.lookup_join(facts, dim, ["key"], "left").count() == 0
    assert skew.lookup_join(spark.createDataFrame([(1, "a")], "id bigint, key string"), dim, ["key"], "left").collect() == [(1, "a", None)]


def test_a_cluster_must_name_its_folder():
    for master in ("local-cluster[3,2,1000]", "spark://host:7077", "yarn", "k8s://x"):
        with pytest.raises(RuntimeError):
            session.one_process(master)
    session.one_process("local[4]")
    session.one_process("local")


def test_tables_go_with_the_last_plan_that_reads_them(spark):
    held = session.stored(spark.range(10), "kept")
    path = held._quillgraph_path.removeprefix("file://")
    derived = held.filter("id > 4")
    del held
    for _ in range(3):
        gc.collect()
        session.release(spark)
    assert os.path.isdir(path) and derived.count() == 5
    del derived
    for _ in range(10):
        gc.collect()
        session.release(spark)
        if not os.path.isdir(path):
            break
    assert not os.path.isdir(path)


def test_observed_counts_while_writing(spark):
    df, seen = session.observed(spark.range(100), "seen", odd=F.count_if(F.col("id") % 2 == 1))
    assert seen["odd"] == 50 and df.count() == 100

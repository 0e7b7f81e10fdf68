"""Dense indices, exact caps and running aggregates equal their single-window definitions,
including a hot group holding most rows and many single-row groups, with many buckets."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tripletframe.functions.keys import hkey
from tripletframe.operators.indexing import (
    bucketed_running,
    dense_index,
    derangement_partner,
    exact_cap,
    hash_range_bucket,
    value_range_bucket,
)


def _skewed(spark):
    hot = spark.range(0, 3000).select(F.lit("hot").alias("g"), F.col("id").alias("k"))
    cold = spark.range(3000, 3200).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("g"), F.col("id").alias("k"))
    return hot.unionByName(cold).withColumn("h", hkey("k"))


def test_dense_index_hash_buckets(spark):
    df = _skewed(spark)
    got = dense_index(df, ["g"], ["h", "k"], hash_range_bucket("h", 16), "idx", "n")
    ref = df.withColumn("ref", F.row_number().over(Window.partitionBy("g").orderBy("h", "k")) - 1)
    j = got.join(ref, ["g", "k"])
    assert j.where("idx <> ref").count() == 0
    assert j.where("g = 'hot'").select(F.max("n")).first()[0] == 3000


def test_dense_index_value_buckets(spark):
    df = _skewed(spark)
    got = dense_index(df, ["g"], ["k"], value_range_bucket("k", 0, 3199, 8), "idx", None)
    ref = df.withColumn("ref", F.row_number().over(Window.partitionBy("g").orderBy("k")) - 1)
    assert got.join(ref, ["g", "k"]).where("idx <> ref").count() == 0


def test_exact_cap_matches_row_number(spark):
    df = _skewed(spark)
    got = exact_cap(df, ["g"], "h", 37, "k", bits=6)
    ref = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("h", "k"))).where("r <= 37")
    assert got.count() == ref.count()
    assert got.select("k").subtract(ref.select("k")).count() == 0


def test_bucketed_running_sum_and_max(spark):
    df = _skewed(spark).withColumn("v", (F.col("h") % 1000).cast("double"))
    got = bucketed_running(df, ["g"], ["k"], value_range_bucket("k", 0, 3199, 8),
                           {"rs": ("sum", F.col("v")), "pm": ("max", F.col("v"))}, inclusive=True)
    w = Window.partitionBy("g").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    ref = df.withColumn("rs2", F.sum("v").over(w)).withColumn("pm2", F.max("v").over(w))
    j = got.join(ref.select("k", "rs2", "pm2"), "k")
    assert j.where("abs(rs - rs2) > 1e-9 or pm <> pm2").count() == 0


def test_derangement_never_self(spark):
    df = spark.range(1, 200).select(F.col("id").alias("n")).select("n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    x = df.withColumn("j", derangement_partner("i", "n", hkey("n", "i")))
    assert x.where("n > 1 and (j = i or j < 0 or j >= n)").count() == 0
    assert x.where("n = 1 and j is not null").count() == 0

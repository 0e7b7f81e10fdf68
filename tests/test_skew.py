"""One giant group next to many single-row groups: results stay exact and complete."""

import math

from pyspark.sql import functions as F

from tripletframe.operators import mixing as M
from tripletframe.operators import triplets as T


def _skewed(spark, hot=5000, cold=300):
    hot_rows = spark.range(0, hot).select(F.col("id").alias("row_id"), F.lit("hot").alias("grp"))
    cold_rows = spark.range(hot, hot + cold).select(F.col("id").alias("row_id"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("grp"))
    df = hot_rows.unionByName(cold_rows)
    return df.withColumn("correct_answer", F.concat(F.lit("a"), F.col("row_id").cast("string")))


def test_negatives_hot_group(spark):
    df = _skewed(spark)
    out = T.sample_negatives(df, group_cols=["grp"], batch_size=128).collect()
    # singleton groups have no partner; every hot row gets one from its own group, never itself
    assert len(out) == 5000
    grp_of = {f"a{i}": ("hot" if i < 5000 else f"c{i}") for i in range(5300)}
    assert all(grp_of[r["incorrect_answer"]] == r["grp"] and r["incorrect_answer"] != r["correct_answer"] for r in out)


def test_interleave_hot_source(spark):
    df = _skewed(spark).select("row_id", F.col("grp").alias("source"))
    B = 64
    out = M.interleave(df, B).select("row_id", "source", "batch_seq").collect()
    assert len(out) == 5300
    n_batches = math.ceil(5000 / B) + 300
    assert sorted({r["batch_seq"] for r in out}) == list(range(n_batches))


def test_exact_cap_hot_source(spark):
    df = _skewed(spark).select("row_id", F.col("grp").alias("source"))
    got = {r["source"]: r["count"] for r in M.sample_per_source(df, cap=1000).groupBy("source").count().collect()}
    assert got["hot"] == 1000 and len(got) == 301 and all(v == 1 for k, v in got.items() if k != "hot")

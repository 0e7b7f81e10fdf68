"""Interleaving, batching and curriculum invariants."""

import math

from pyspark.sql import functions as F

from tripletframe.operators import mixing as M

B = 4
SIZES = {"s1": 1, "s2": B, "s3": B + 1, "s4": 3 * B}


def _rows(spark):
    rows, k = [], 0
    for s, n in SIZES.items():
        for _ in range(n):
            rows.append((k, s))
            k += 1
    return spark.createDataFrame(rows, "row_id long, source string")


def test_interleave_round_robin(spark):
    x = M.interleave(_rows(spark), B).collect()
    assert len(x) == sum(SIZES.values())  # multiset unchanged
    n_batches = sum(math.ceil(n / B) for n in SIZES.values())
    seqs = sorted({r["batch_seq"] for r in x})
    assert seqs == list(range(n_batches))
    src_of = {}
    for r in x:
        src_of.setdefault(r["batch_seq"], set()).add(r["source"])
    assert all(len(v) == 1 for v in src_of.values())  # a batch comes from one source
    order = [next(iter(src_of[i])) for i in seqs]
    # while more than one source has batches left, consecutive batches differ in source
    assert order[:6] == ["s1", "s2", "s3", "s4", "s3", "s4"]
    sizes = {}
    for r in x:
        sizes[r["batch_seq"]] = sizes.get(r["batch_seq"], 0) + 1
    assert max(sizes.values()) <= B


def test_batch_count(spark):
    r = M.batch_count(_rows(spark), B).first()
    assert r["n_batches"] == sum(math.ceil(n / B) for n in SIZES.values())


def test_epoch_batches_drop_last(spark):
    df = spark.range(0, 103).withColumnRenamed("id", "row_id")
    x = M.epoch_batches(df, 10)
    assert x.count() == 100
    assert x.groupBy("batch").count().where("count <> 10").count() == 0


def test_sample_per_source_exact(spark):
    df = _rows(spark)
    got = {r["source"]: r["count"] for r in M.sample_per_source(df, cap=3).groupBy("source").count().collect()}
    assert got == {s: min(3, n) for s, n in SIZES.items()}


def test_levels_dense_and_never_fall(spark):
    reg = spark.createDataFrame([("a", 1), ("b", 3), ("c", 4)], "source string, difficulty int")
    lv = {r["source"]: r["level"] for r in M.curriculum_levels(reg).collect()}
    assert lv == {"a": 1, "b": 2, "c": 3}
    steps = spark.range(1, 200).select(F.lit(0).alias("run"), F.col("id").alias("step"), (F.col("id") / 20).cast("long").alias("epoch"))
    out = M.assign_levels(steps, n_epochs=10, n_levels=3).orderBy("step").collect()
    levels = [r["level"] for r in out]
    assert levels == sorted(levels) and levels[0] == 1 and levels[-1] == 3


def test_curriculum_draws_stay_in_level(spark):
    rows = spark.createDataFrame([(i, f"s{i % 3}") for i in range(60)], "row_id long, source string")
    reg = spark.createDataFrame([("s0", 1), ("s1", 1), ("s2", 2)], "source string, difficulty int")
    d = M.curriculum_draw(rows, M.curriculum_levels(reg), level=1)
    assert d.count() == 40
    assert {r["source"] for r in d.select("source").distinct().collect()} <= {"s0", "s1"}


def test_state_roundtrip_defaults(spark, tmp_path):
    p = str(tmp_path / "state")
    spark.createDataFrame([(None, None, None, None)], M.STATE_SCHEMA).write.json(p)
    r = M.load_state(spark, p).first()
    assert (r["current_level"], r["level_progress"], dict(r["sample_counts"]), r["total_samples"]) == (1, 0.0, {}, 0)

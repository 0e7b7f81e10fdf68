"""Structured Streaming ingest and monitoring.

All three use a file source with ``trigger(availableNow=True)`` and
``foreachBatch``: every micro-batch is an ordinary distributed DataFrame, and
each output is written under ``batch_id=<n>`` with overwrite, so replaying a
micro-batch after a failure rewrites the same folder (idempotent sink). The
streaming checkpoint lives under the shared checkpoint directory.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripletframe.functions.keys import hkey
from tripletframe.operators import triplets as TR


def _run(stream_df: DataFrame, fn, checkpoint: str, max_files: int | None = None) -> None:
    q = stream_df.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def _read(spark: SparkSession, src: str, schema: T.StructType, max_files: int | None):
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(src)


# ------------------------------------------------------------------ W1

def stream_triplets(spark: SparkSession, src: str, out: str, checkpoint: str, schema: T.StructType,
                    batch_size: int = TR.DEFAULT_BATCH, max_files: int | None = 1) -> None:
    """Pairs arriving as files -> negatives drawn inside each micro-batch (T4) -> Parquet per batch."""

    def each(batch: DataFrame, batch_id: int) -> None:
        trip = TR.sample_negatives_batch(batch, batch_size=batch_size)
        trip.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    _run(_read(spark, src, schema, max_files), each, checkpoint)


# ------------------------------------------------------------------ W2

def stream_sample_k(spark: SparkSession, src: str, state: str, checkpoint: str, schema: T.StructType, k: int,
                    key_col: str, salt: str = "res", max_files: int | None = 1) -> None:
    """Streaming reservoir = the k smallest hash keys of everything seen (bottom-k is mergeable).

    State version ``n`` = bottom-k of (version n-1 union micro-batch n); it is
    written before the batch commits, so a replay recomputes the same version.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        cur = batch.withColumn("_h", hkey(F.lit(salt), key_col))
        if batch_id > 0:
            prev = spark.read.parquet(f"{state}/batch_id={batch_id - 1}")
            cur = prev.unionByName(cur)
        cur.orderBy("_h", key_col).limit(k).write.mode("overwrite").parquet(f"{state}/batch_id={batch_id}")

    _run(_read(spark, src, schema, max_files), each, checkpoint)


def latest_state(spark: SparkSession, state: str) -> DataFrame:
    """Read the newest state version written by :func:`stream_sample_k`."""
    versions = spark.read.parquet(state).select(F.max("batch_id").alias("m")).first()["m"]
    return spark.read.parquet(f"{state}/batch_id={versions}").drop("_h")


# ------------------------------------------------------------------ W3

def stream_eval_monitor(spark: SparkSession, src: str, out: str, checkpoint: str, schema: T.StructType,
                        group_cols: Sequence[str] = ("run",), window: str = "1 day", watermark: str = "8 days",
                        max_files: int | None = None) -> None:
    """Training-trace events -> event-time tumbling windows with a watermark, update mode.

    Each micro-batch writes the window rows it updated; :func:`final_windows`
    keeps the newest version of every (group, window).
    """
    s = _read(spark, src, schema, max_files).withColumn("_ts", F.col("ts").cast("timestamp"))
    agg = s.withWatermark("_ts", watermark).groupBy(*group_cols, F.window("_ts", window).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("pos_sim").alias("avg_pos_sim"), F.avg("neg_sim").alias("avg_neg_sim")
    )

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.select(*group_cols, F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n", "avg_pos_sim", "avg_neg_sim") \
            .withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    q = agg.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start()
    q.awaitTermination()


def final_windows(spark: SparkSession, out: str, group_cols: Sequence[str] = ("run",)) -> DataFrame:
    """Newest version of each window (a window has at most one row per micro-batch)."""
    u = spark.read.parquet(out)
    w = Window.partitionBy(*group_cols, "window_start").orderBy(F.col("batch_id").desc())
    return u.withColumn("_rk", F.row_number().over(w)).where("_rk = 1").drop("_rk", "batch_id")

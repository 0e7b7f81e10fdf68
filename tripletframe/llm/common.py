"""Helpers shared by the training-data operators: shared scratch tables, text buffers, packed arrays, components."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripletframe.session import checkpoint_dir

#: Texts handled at once inside a task, in bytes (a longer single text is handled alone).
SLICE_BYTES = 4 << 20
NO_ID = (1 << 63) - 1  #: stands for a null doc_id where ids are ordered: after every other


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to shared storage and continue from the written table (lineage is cut there)."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files and broadcasts of DataFrames that nothing refers to any more: its cleaner acts when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty, without decoding."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return []
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1].tolist()
    raw = memoryview(data) if data is not None else memoryview(b"")
    return [bytes(raw[a:b]) for a, b in zip(o, o[1:])]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut a batch into runs of rows whose texts hold about ``limit`` bytes."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size, dtype=np.int64) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        run = batch.slice(a, b - a)
        yield run, texts_of(run.column(column))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound Arrow batches to ``rows`` rows (texts are long: ten thousand rows fill an executor's memory)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


#: What a worker keeps between tasks, by name.
_KEPT: dict[str, object] = {}
#: Hands freed heap pages back to the system, where the C library can.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def kept(name: str, make: Callable[[], object]) -> object:
    """The object of this name, made once and kept by the worker until a task of another operator begins."""
    if name not in _KEPT:
        _KEPT[name] = make()
    return _KEPT[name]


def refcounts_only(keep: str | None = None) -> None:
    """Begin a task: let go of what earlier tasks left in this worker (all kept objects but ``keep``, cycles, unused heap), then stop
    the cycle collector: its passes over millions of small lists cost more than the work, and the tasks make no cycles.

    Workers live on and serve all operators in turn; without this each holds the most that any of them needed.
    """
    for name in [n for n in _KEPT if n != keep]:
        del _KEPT[name]
    gc.collect()
    trim()
    gc.disable()


def trim() -> None:
    """Hand this worker's unused heap back to the system."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def lean(work: Callable, *args):
    """``work(*args)``, then its unused heap goes back at once: an executor has more workers than running tasks, and an idle one would keep the most it needed."""
    out = work(*args)
    trim()
    return out


def longs(column: pa.Array) -> np.ndarray:
    """int64 values of an id column, null as NO_ID."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def starts_of(lengths: list[int] | np.ndarray) -> np.ndarray:
    """Offsets (one more than lengths) of consecutive runs."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def blobs(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(u, v)`` (longs) as ``(node, root)``, root the smallest node.

    Alternating large-star and small-star rounds: the edge count never grows,
    each round is two joins on the node (hot nodes are split by the adaptive
    skew join; the minimum is pre-aggregated), and every round is written to
    shared storage so that a lost executor costs one round.
    """
    def mins(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))

    e = stash(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(mins(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(mins(large), "u")
        e = stash(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
                  .where("u <> v").distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))

"""Exact duplicates by an extendible-hash index on shared files.

Texts that are identical byte for byte form a group. The index is built in
four steps:

1. *Entries.* Tasks collapse the copies in every GATHER_BYTES of rows (a dictionary
   keyed by the text bytes) and writes its rows to the index folder on shared storage,
   with text once per distinct text. A group holding a third of all rows so
   becomes one entry per GATHER_BYTES of input.
2. *Filter.* Keys (64 bits) that several entries share set bits in a bitmap of
   fixed size. Entries whose key finds no bits are groups of their own: their
   texts never travel. (If the bitmap is ever full, all texts travel; the result
   is the same.)
3. *Directory.* Starting from one bucket, the directory doubles and overfull
   buckets split on the next bit of the key until every bucket holds at most
   its capacity of distinct keys' bytes. It works on a histogram of key
   prefixes (bounded by the number of buckets), never on the keys themselves.
4. *Owners.* The entries of a bucket (a key range) go to its owner task, sorted
   by key. The owner streams them, chains entries with the same key, compares
   bytes (equal keys of different texts stay apart) and gives every entry its
   group's result, which goes back to the rows by entry number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripletframe.llm.common import scratch_path, small_batches, texts_of

#: Bytes of distinct texts a bucket may hold, and the directory's size limit: beyond
#: MAX_BUCKETS times that the capacity grows with the input (owners stream, so any size works).
BUCKET_BYTES = 4 << 20
MAX_BUCKETS = 1 << 16

#: Data in which a task collapses copies at once.
GATHER_BYTES = 16 << 20
#: Size of the bitmap of shared keys, in bits (16 MB), and of Spark's bitmap blocks.
FILTER_BITS, BLOCK_BITS = 1 << 27, 1 << 15


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined until they hold GATHER_BYTES of data: copies in one of them collapse to one entry."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= GATHER_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per gathered batch: number the distinct texts; the first row of each leads with row count and largest doc_id, ``best`` is that id's row."""
    from pyspark import TaskContext

    seq = TaskContext.get().partitionId() << 40
    for batch in _gathered(batches):
        ids = batch.column("doc_id").to_pylist()
        slot: dict[bytes, int] = {}
        where = [slot.setdefault(t, len(slot)) for t in texts_of(batch.column("text"))]
        n, first, best = [0] * len(slot), [-1] * len(slot), [-1] * len(slot)
        for row, (i, k) in enumerate(zip(ids, where)):
            n[k] += 1
            if first[k] < 0:
                first[k] = best[k] = row
            elif i is not None and (ids[best[k]] is None or i > ids[best[k]]):
                best[k] = row
        lead, top = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
        lead[first], top[best] = True, True
        text = batch.column("text")
        made = [pa.array([seq + k for k in where], pa.int64()),
                pa.array([n[k] if f else None for k, f in zip(where, lead)], pa.int64()),
                pa.array([ids[best[k]] if f else None for k, f in zip(where, lead)], pa.int64()),
                pa.array(top)]
        columns = [pc.if_else(pa.array(lead | top), text, pa.scalar(None, text.type)) if name == "text" else batch.column(name) for name in batch.schema.names]
        yield pa.RecordBatch.from_arrays([*columns, *made], names=[*batch.schema.names, "entry", "n", "top_id", "best"])
        seq += len(slot)


def build_directory(histogram, capacity: int, depth: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Split buckets on ``{prefix: (keys, bytes)}`` of ``depth`` bits.

    Returns the buckets as (prefix, local depth) in key order, and the prefixes
    of ``depth`` bits that are still overfull with more than one key.
    """
    directory, depths, global_depth = {0: 0}, [(0, 0)], 0  # slot -> bucket; bucket -> (prefix, local depth)
    sums = {depth: dict(histogram)}
    for d in range(depth - 1, -1, -1):
        up: dict[int, tuple[int, int]] = {}
        for p, (k, b) in sums[d + 1].items():
            x = up.get(p >> 1, (0, 0))
            up[p >> 1] = (x[0] + k, x[1] + b)
        sums[d] = up
    todo, deeper = [0], []
    while todo:
        b = todo.pop()
        prefix, local = depths[b]
        keys, size = sums[local].get(prefix, (0, 0))
        if size <= capacity or keys <= 1:
            continue
        if local == depth:
            deeper.append(prefix)
            continue
        if local == global_depth:  # double: every slot becomes two that share its bucket
            directory = {s * 2 + x: v for s, v in directory.items() for x in (0, 1)}
            global_depth += 1
        depths[b] = (prefix * 2, local + 1)
        depths.append((prefix * 2 + 1, local + 1))
        span = global_depth - local - 1
        for s in range((prefix * 2 + 1) << span, (prefix * 2 + 2) << span):
            directory[s] = len(depths) - 1
        todo += [b, len(depths) - 1]
    return sorted(depths, key=lambda x: x[0] << (64 - x[1])), deeper


def _directory(entries: DataFrame, capacity: int, depth: int) -> np.ndarray:
    """Lower key bounds (unsigned) of the buckets, in order."""
    keys = entries.groupBy("key").agg(F.max(F.octet_length("text")).alias("b"))
    done: list[tuple[int, int]] = []
    todo: list[int] | None = None
    while True:
        prefix = F.expr(f"shiftrightunsigned(key, {64 - depth})")
        part = keys if todo is None else keys.where(F.expr(f"shiftrightunsigned(key, {64 - depth + 4})").isin(todo))
        hist = {r[0]: (r[1], r[2]) for r in part.groupBy(prefix.alias("p")).agg(F.count("*"), F.sum("b")).collect()}
        buckets, todo = build_directory(hist, capacity, depth)
        done += [(p << (64 - d), d) for p, d in buckets]
        if not todo or depth + 4 > 60:
            return np.unique(np.array([p for p, _ in done] or [0], np.uint64))
        depth += 4


def _filter(leads: DataFrame) -> np.ndarray:
    """Bitmap (FILTER_BITS bits as bytes) with two bits of every key that several entries share."""
    shared = leads.groupBy("key").count().where("count > 1")
    bit = F.explode(F.array(*(F.pmod(F.shiftrightunsigned("key", s), F.lit(FILTER_BITS)) for s in (0, 32))))
    blocks = (shared.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / BLOCK_BITS).cast("int").alias("block"))
              .agg(F.bitmap_construct_agg(F.pmod("bit", F.lit(BLOCK_BITS))).alias("bits")).collect())
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for block, bits in blocks:
        out[block * BLOCK_BITS // 8 : (block + 1) * BLOCK_BITS // 8] = np.frombuffer(bytes(bits), np.uint8)
    return out


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Owner: entries sorted by (bucket, key); chain equal keys, compare bytes, answer every entry."""
    key, chains, out = None, [], ([], [], [], [])

    def close():
        for _, n, top, keeper, entries in chains:
            for c, v in zip(out, (entries, *([x] * len(entries) for x in (top, n, keeper)))):
                c.extend(v)

    def flush():
        cols = [pa.array(c, pa.int64()) for c in out]
        for c in out:
            c.clear()
        return pa.RecordBatch.from_arrays(cols, names=["entry", "keep_id", "group_size", "keeper"])

    for batch in batches:
        cols = (batch.column(c).to_pylist() for c in ("key", "entry", "n", "top_id"))
        for k, entry, n, top, text in zip(*cols, texts_of(batch.column("text"))):
            if k != key:
                close()
                key, chains = k, []
            for c in chains:
                if c[0] == text:
                    c[1] += n
                    if top is not None and (c[2] is None or (top, -entry) > (c[2], -c[3])) or top is None and c[2] is None and entry < c[3]:
                        c[2], c[3] = top, entry
                    c[4].append(entry)
                    break
            else:
                chains.append([text, n, top, entry, [entry]])
        yield flush()
    close()
    yield flush()


def exact_dedup(docs: DataFrame, extra: list[str] | None = None, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: doc_id, keep_id, group_size, kept, text_sha256, then the columns ``extra``.

    Null text counts as empty; empty texts are one group. Of equal texts the
    largest doc_id stays (null ids stay only if all are null); of rows that repeat id and
    text exactly one is kept. With ``text`` among ``extra`` kept rows carry
    theirs, and others may have null there. Columns not named are not read, so
    their names cannot clash; ``extra`` may not repeat a result column. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    extra = [c for c in extra or [] if c not in ("doc_id", "text")]
    text = F.coalesce(F.col("text"), F.lit(""))
    path = scratch_path(spark, "index")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *(F.col(c).alias(f"own_{c}") for c in extra)).withColumns(
        {"text_sha256": F.sha2(F.col("text").cast("binary"), 256), "key": F.xxhash64("text")})
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "entry long, n long, top_id long, best boolean"])
    rows.mapInArrow(_collapse, schema).write.parquet(f"{path}/entries")
    entries = spark.read.schema(schema).parquet(f"{path}/entries")
    leads = entries.where("n is not null")
    total = leads.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    capacity = max(bucket_bytes, total // MAX_BUCKETS)
    bounds = _directory(leads, capacity, max(4, int(total // capacity).bit_length() + 3))
    bits = spark.sparkContext.broadcast(_filter(leads))

    @F.pandas_udf("int")
    def bucket(keys):
        """Bucket of a key that several entries may share, else -1."""
        import pandas as pd

        k = keys.to_numpy().view(np.uint64)
        at = [((k >> np.uint64(s)) % np.uint64(FILTER_BITS)).astype(np.int64) for s in (0, 32)]
        shared = np.logical_and(*((bits.value[a >> 3] >> (a & 7)) & 1 for a in at))
        return pd.Series(np.where(shared, np.searchsorted(bounds, k, side="right") - 1, -1).astype(np.int32))

    placed = leads.withColumn("bucket", bucket("key"))
    owned = (placed.where("bucket >= 0").select("bucket", "key", "entry", "n", "top_id", "text")
             .repartition(len(bounds), "bucket").sortWithinPartitions("bucket", "key"))
    answers = owned.mapInArrow(_chain, "entry long, keep_id long, group_size long, keeper long").unionByName(
        placed.where("bucket < 0").select("entry", F.col("top_id").alias("keep_id"), F.col("n").alias("group_size"), F.col("entry").alias("keeper")))
    kept = (F.col("best") & (F.col("entry") == F.col("keeper"))).alias("kept")
    return entries.join(answers, "entry").select("doc_id", "keep_id", "group_size", kept, "text_sha256", *([F.col("text")] if "text" in docs.columns else []), *(F.col(f"own_{c}").alias(c) for c in extra))

"""Near-duplicates by SimHash with pigeonring filtering.

A document's fingerprint is the bitwise majority of its shingles' XXH64 values.
Equal fingerprints are one node (pre-aggregated), so copies are never paired.
The 64 bits are a ring of SEGMENTS segments. If two fingerprints differ in at
most ``distance`` bits, some start on the ring has every chain of l consecutive
segments within its proportional budget, distance * l / SEGMENTS. The chain of
two is the join key: every fingerprint meets others at its own 32 bits and at
each single flip of them, so chains that differ in up to two bits share a key.
Pairs that meet are pruned by the budgets of chains 1, 2 and 3 before the full
Hamming check. What follows are connected components of the links.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripletframe.llm.common import components, refcounts_only, slices, small_batches, starts_of, stash

SEED = 42
SEGMENTS = 4
BITS = 64 // SEGMENTS
#: Verified links held before they are reduced to a spanning forest.
HELD_LINKS = 1 << 20


def shingle_hashes(text: bytes, width: int) -> list[int]:
    """XXH64 of the space-joined shingles of a lower-cased text; of the whole sequence when it has fewer words."""
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    x = xxhash.xxh64_intdigest
    if len(words) <= width:
        return [x(joined, SEED)]
    start = starts_of(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    a, b = start[: len(words) - width + 1].tolist(), (start[width:] - 1).tolist()
    return [x(joined[i:j], SEED) for i, j in zip(a, b)]


def majority(hashes: list[list[int]]) -> np.ndarray:
    """Fingerprint (uint64) of each list: a bit is 1 if set in over half; of an empty list 0."""
    n = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(hashes), np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    flat = np.fromiter((v for h in hashes for v in h), np.uint64, int(n.sum()))
    bits = np.unpackbits(flat.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    ones = np.add.reduceat(bits, starts_of(n[full])[:-1], axis=0, dtype=np.int32)
    out[full] = np.packbits(ones * 2 > n[full][:, None], axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def fingerprints(docs: DataFrame, width: int, extra: Sequence[str] = ()) -> DataFrame:
    """doc_id, fp (long) and the ``extra`` columns of every row; null text counts as empty (fingerprint zero)."""
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refcounts_only()
        for batch in batches:
            for part, texts in slices(batch, "text", 1 << 20):
                fp = majority([shingle_hashes(t, width) for t in texts])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp.view(np.int64)), *map(part.column, extra)], names=["doc_id", "fp", *extra])

    return docs.select(F.col("doc_id").cast("long"), "text", *extra).mapInArrow(run, ", ".join(["doc_id long, fp long", *(f"`{c}` {fields[c]}" for c in extra)]))


def ring_keys(fp: np.ndarray) -> np.ndarray:
    """(n, SEGMENTS * 33) keys: ring position over the two segments there, as they are and with one bit flipped."""
    seg = [(fp >> np.uint64(BITS * i)) & np.uint64((1 << BITS) - 1) for i in range(SEGMENTS)]
    flips = np.append(np.uint64(0), np.uint64(1) << np.arange(2 * BITS, dtype=np.uint64))
    return np.concatenate([(np.uint64(i << 2 * BITS) | (seg[i] << np.uint64(BITS)) | seg[(i + 1) % SEGMENTS])[:, None] ^ flips for i in range(SEGMENTS)], axis=1)


def in_budget(position: np.ndarray, diff: np.ndarray, distance: int) -> np.ndarray:
    """Whether chains of 1, 2, ... segments from ``position`` stay within their budgets, then the whole ring."""
    ok, total = np.ones(len(diff), bool), np.zeros(len(diff), np.int64)
    for l in range(1, SEGMENTS + 1):
        shift = (position + np.uint64(l - 1)) % np.uint64(SEGMENTS) * np.uint64(BITS)
        total += np.bitwise_count((diff >> shift) & np.uint64((1 << BITS) - 1))
        ok &= total <= distance * l // SEGMENTS
    return ok


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning star (node, smallest reachable node) of each component of the links."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(nodes))
    while True:
        m = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, m)
        np.minimum.at(new, y, m)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def links(nodes: DataFrame, distance: int) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``fp`` at ``distance`` bits or fewer, as spanning forests of each task's pairs."""
    if distance > SEGMENTS:
        raise ValueError(f"chains of two segments hold at most two differing bits: distance <= {SEGMENTS}")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                fp = batch.column("fp")[a : a + 2000].to_numpy(zero_copy_only=False)
                k = ring_keys(fp.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64).ravel()), pa.array(np.repeat(fp, k.shape[1]))], names=["key", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by key: pair each row with the rows 1, 2, ... places on that have its key."""
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rest_k, rest_f = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def pairs(k: np.ndarray, f: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            at, d, fu = np.arange(len(k) - 1), 1, f.view(np.uint64)
            while len(at := at[at + d < len(k)]) and len(at := at[k[at] == k[at + d]]):
                diff = fu[at] ^ fu[at + d]
                ok = in_budget(k[at].view(np.uint64) >> np.uint64(2 * BITS), diff, distance) & (diff != 0)
                if ok.any():
                    yield f[at[ok]], f[at[ok] + d]
                d += 1

        def reduced():
            star = _forest(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
            held[:] = [star]
            return star

        def take(k, f):
            for p in pairs(k, f):
                held.append(p)
                if sum(len(x) for x, _ in held) > HELD_LINKS:
                    u, v = reduced()
                    if len(u) > HELD_LINKS // 2:
                        held.clear()
                        yield u, v

        for batch in batches:
            k = np.concatenate([rest_k, batch.column("key").to_numpy(zero_copy_only=False)])
            f = np.concatenate([rest_f, batch.column("fp").to_numpy(zero_copy_only=False)])
            cut = int(np.searchsorted(k, k[-1])) if len(k) else 0  # the last key may go on
            rest_k, rest_f = k[cut:], f[cut:]
            for u, v in take(k[:cut], f[:cut]):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
        for u, v in take(rest_k, rest_f):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
        if held:
            u, v = reduced()
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    spread = nodes.select("fp").mapInArrow(keys, "key long, fp long")
    return spread.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "u long, v long")


def simhash_dedup(docs: DataFrame, width: int = 4, distance: int = 4, extra: Sequence[str] = (), classes: bool = False) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id per row of ``docs(doc_id, text, ...)``, then the ``extra`` columns.

    component_id is the smallest doc_id that chains of links reach, the row's
    own included; null ids do not count (null if a component has no other).
    Null and empty texts, and those of white space alone, have fingerprint zero
    and are linked like any other. Repeated rows are answered each. With
    ``classes`` component_root follows, a number of the component that is never
    null. Columns not in ``extra`` are not read; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    prints = stash(fingerprints(docs, width, extra), "fingerprints")
    nodes = stash(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes, distance)).withColumnsRenamed({"node": "fp"})
    grouped = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    answer = grouped.join(least, "root").select("fp", "component_id", F.col("root").alias("component_root"))
    return prints.join(answer, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *extra, *(["component_root"] if classes else []))

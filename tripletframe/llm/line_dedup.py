"""Line dedup: a sharded minimal perfect hash over the hashes of recurring lines, probed by the documents.

1. *Slices.* Documents are written in slices of GATHER_BYTES with the 128-bit hashes of their
   countable lines (keys of at least ``min_chars`` code points).
2. *Counts.* Each slice collapses its hashes to (hash, documents, largest doc_id); Spark adds these up.
   Lines of a single document can never go, so only hashes found in two or more documents are kept.
3. *Index.* Hashes are cut into shards by their top bits, and each shard gets a minimal perfect
   hash: a key's place is the rank of its bit in the first level where no other key takes that
   bit. The places index a fingerprint, a count and a largest-doc_id array.
4. *Probes.* Every slice sends its distinct hashes (16 bytes a line, not the lines) to the shards, where
   they probe the arrays as they stream by. A shard that many probes want is copied and its probes dealt over the
   copies, so that a probing task reads about PROBE_BYTES whatever the shard; hashes whose fingerprint differs are of lines that do not recur.
5. *Documents.* Answers go back to the slices, which drop the lines.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripletframe.llm.common import small_batches, starts_of, stash, texts_of
from tripletframe.llm.exact_dedup import _gathered

#: Hashes in a shard, bytes of hashes a probing task reads, and documents' bytes in a task of the last step.
SHARD_KEYS, PROBE_BYTES, TASK_BYTES = 1 << 17, 32 << 20, 32 << 20
#: Bits a level of the perfect hash has for each key still without a place.
ROOM = 1.5
BLANKS = b" \t\n\x0b\x0c\r"


def line_hashes(text: bytes, min_chars: int) -> tuple[list[bytes], list[int], list[bytes]]:
    """Lines of a text, the numbers of the countable ones, and their hashes (16 bytes each)."""
    lines = text.split(b"\n")
    at, hashes = [], []
    for i, line in enumerate(lines):
        if len(line) >= min_chars:
            key = line.strip(BLANKS).lower()  # bytes: only A-Z change
            if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars):
                at.append(i)
                hashes.append(xxhash.xxh3_128_digest(key))
    return lines, at, hashes


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slot(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
    return (_mix(hi ^ _mix(lo + np.uint64(level + 1))) % np.uint64(size)).astype(np.int64)


def perfect_hash(hi: np.ndarray, lo: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Levels (boolean arrays) of a minimal perfect hash over distinct (hi, lo) pairs, and each pair's place in 0..n-1."""
    levels, place, left, base = [], np.zeros(len(hi), np.int64), np.arange(len(hi)), 0
    while len(left):
        size = max(64, int(ROOM * len(left)))
        slot = _slot(hi[left], lo[left], len(levels), size)
        alone = np.bincount(slot, minlength=size)[slot] == 1
        bits = np.zeros(size, bool)
        bits[slot[alone]] = True
        place[left[alone]] = base + np.cumsum(bits)[slot[alone]] - 1
        base += int(alone.sum())
        levels.append(bits)
        left = left[~alone]
    return levels, place


class Shard:
    """Perfect hash of a shard with its fingerprint, count and largest-doc_id arrays."""

    def __init__(self, levels, prints, counts, tops, known):
        self.levels, self.prints, self.counts, self.tops, self.known = levels, prints, counts, tops, known
        self.ranks, base = [], 0
        for bits in levels:
            r = np.cumsum(bits) + (base - 1)
            self.ranks.append(r)
            base = int(r[-1]) + 1

    @classmethod
    def build(cls, hi, lo, counts, tops, known) -> Shard:
        levels, place = perfect_hash(hi, lo)
        order = np.argsort(place)
        return cls(levels, lo[order], counts[order], tops[order], known[order])

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, sizes=np.array([len(b) for b in self.levels]), bits=np.packbits(np.concatenate(self.levels)),
                 prints=self.prints, counts=self.counts, tops=self.tops, known=np.packbits(self.known))
        return out.getvalue()

    @classmethod
    def load(cls, blob: bytes) -> Shard:
        z = np.load(io.BytesIO(blob))
        sizes, bits = z["sizes"], np.unpackbits(z["bits"]).astype(bool)
        at = starts_of(sizes)
        return cls([bits[a:b] for a, b in zip(at, at[1:])], z["prints"], z["counts"], z["tops"], np.unpackbits(z["known"])[: len(z["prints"])].astype(bool))

    def find(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Places of (hi, lo) pairs, -1 for those that are no members."""
        place, left = np.full(len(hi), -1, np.int64), np.arange(len(hi))
        for k, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            slot = _slot(hi[left], lo[left], k, len(bits))
            hit = bits[slot]
            place[left[hit]] = ranks[slot[hit]]
            left = left[~hit]
        found = place >= 0
        found[found] = self.prints[place[found]] == lo[found]
        return np.where(found, place, -1)


def _pairs(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, ">u8").reshape(-1, 2).astype(np.uint64)


def _distinct(raw: bytes) -> np.ndarray:
    """Distinct hashes, sorted, as an (n, 2) array."""
    pair = _pairs(raw)
    pair = pair[np.lexsort((pair[:, 1], pair[:, 0]))]
    fresh = np.ones(len(pair), bool)
    fresh[1:] = (pair[1:] != pair[:-1]).any(axis=1)
    return pair[fresh]


def _bits(hi: np.ndarray, bits: int) -> np.ndarray:
    return (hi >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hi), np.int64)


def line_dedup(docs: DataFrame, extra: list[str] | None = None, min_chars: int = 40, min_docs: int = 5, shard_keys: int = SHARD_KEYS, probe_bytes: int = PROBE_BYTES,
               task_bytes: int = TASK_BYTES) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: doc_id, n_lines, n_dropped, kept_text, then the columns ``extra``.

    Lines end at ``\\n``; a null or empty text is one empty line. A line's key is the line without blanks
    (space, tab to carriage return) at both ends, A-Z lower-cased. Keys of at least ``min_chars`` code points
    found in at least ``min_docs`` rows lose all their lines except in the largest doc_id holding them:
    in every row with that id, if ids repeat; a null id is smaller than all others (if all ids are null, no line goes).
    Columns not named are not read, so their names cannot clash; those in ``extra`` may bear any other name than
    the result's. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    extra = [c for c in extra or [] if c not in ("doc_id", "text")]
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(F.col(c).alias(f"own_{c}") for c in extra))

    def write_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seq = TaskContext.get().partitionId() << 32
        for batch in _gathered(batches):
            hashes = [b"".join(dict.fromkeys(line_hashes(t, min_chars)[2])) for t in texts_of(batch.column("text"))]
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                yield pa.RecordBatch.from_arrays([pa.array([seq] * part.num_rows, pa.int64()), pa.array(hashes[a : a + 1000], pa.binary()), *part.columns],
                                                 names=["slice", "hashes", *part.schema.names])
            seq += 1

    schema = ", ".join(["slice long", "hashes binary", *(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)])
    rows = stash(own.mapInArrow(write_slices, schema), "slices")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches):
            column = batch.column("hashes")
            raw = b"".join(x.as_py() for x in column)
            if not raw:
                continue
            ids, sizes = batch.column("doc_id"), np.array([len(x.as_py()) // 16 for x in column])
            known = np.repeat(ids.is_valid().to_numpy(zero_copy_only=False), sizes)
            value = np.repeat(ids.fill_null(0).to_numpy(zero_copy_only=False), sizes)
            pair = _pairs(raw)
            order = np.lexsort((value, known, pair[:, 1], pair[:, 0]))
            pair, value, known = pair[order], value[order], known[order]
            last = np.ones(len(pair), bool)  # largest known id of each hash
            last[:-1] = (pair[1:] != pair[:-1]).any(axis=1)
            n = np.diff(np.flatnonzero(last), prepend=-1)
            half = [pa.array(pair[last, i].view(np.int64)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*half, pa.array(n, pa.int64()), pa.array(value[last], pa.int64(), mask=~known[last])],
                                             names=["hi", "lo", "n", "top"])

    counted = rows.select("doc_id", "hashes").mapInArrow(tally, "hi long, lo long, n long, top long")
    recurring = stash(counted.groupBy("hi", "lo").agg(F.sum("n").alias("n"), F.max("top").alias("top")).where("n > 1"), "recurring")
    total, wanted, data = (x or 0 for x in (recurring.count(), *rows.agg(F.sum(F.octet_length("hashes")), F.sum(F.octet_length("text"))).first()))
    bits = max(0, -(-total // shard_keys) - 1).bit_length()
    copies = max(1, -(-wanted // (probe_bytes << bits)))

    def index(group: pa.Table) -> pa.Table:
        hi, lo, n = (group.column(c).to_numpy() for c in ("hi", "lo", "n"))
        top = group.column("top").combine_chunks()
        shard = Shard.build(hi.view(np.uint64), lo.view(np.uint64), n, top.fill_null(0).to_numpy(zero_copy_only=False), top.is_valid().to_numpy(zero_copy_only=False))
        return pa.table({"shard": pa.array([int(_bits(hi[:1].view(np.uint64), bits)[0])], pa.int64()), "body": pa.array([shard.dump()], pa.binary())})

    of_shard = F.expr(f"shiftrightunsigned(hi, {64 - bits})") if bits else F.lit(0).cast("long")
    shards = stash(recurring.groupBy(of_shard.alias("shard")).applyInArrow(index, "shard long, body binary"), "shards")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per (slice, shard): the slice's distinct hashes."""
        for batch in _gathered(batches):
            ids = batch.column("slice").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
            for a, b in zip(cuts, cuts[1:]):
                found = _distinct(b"".join(x.as_py() for x in batch.column("hashes").slice(a, b - a)))
                shard = _bits(found[:, 0], bits)
                edge = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)] if len(shard) else []
                body = [found[x:y].astype(">u8").tobytes() for x, y in zip(edge, edge[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(shard[edge[:-1]] if body else [], pa.int64()), pa.array([int(ids[a])] * len(body), pa.int64()), pa.array(body, pa.binary())],
                                                 names=["shard", "slice", "body"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard's arrays (slice null), then its probes: hashes found often enough with their largest doc_id."""
        at, arrays = None, None
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for shard, slice_, body in zip(*(batch.column(c).to_pylist() for c in ("shard", "slice", "body"))):
                if slice_ is None:
                    at, arrays = shard, Shard.load(body)
                    continue
                if shard != at:  # no recurring line here
                    continue
                pair = _pairs(body)
                place = arrays.find(pair[:, 0], pair[:, 1])
                hit = place >= 0
                hit[hit] = (arrays.counts[place[hit]] >= min_docs) & arrays.known[place[hit]]
                if hit.any():
                    for c, v in zip(out, (slice_, pair[hit].astype(">u8").tobytes(), arrays.tops[place[hit]].astype("<i8").tobytes())):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], names=["slice", "found", "tops"])

    probes = rows.select("slice", "hashes").mapInArrow(ask, "shard long, slice long, body binary").withColumn("copy", F.pmod(F.xxhash64("slice"), F.lit(copies)).cast("int"))
    copied = shards.select("shard", F.lit(None).cast("long").alias("slice"), "body", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
    tasks = min(10_000, copies << bits)
    answers = copied.unionByName(probes).repartition(tasks, "shard", "copy").sortWithinPartitions("shard", "copy", F.col("slice").asc_nulls_first()).select("shard", "slice", "body").mapInArrow(
        answer, "slice long, found binary, tops binary")
    answers = stash(answers, "answers")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A slice's answers (found not null), then its documents without the lines found elsewhere."""
        at, top = None, {}
        for batch in batches:
            kept, total, gone, keep = [], [], [], []
            columns = (batch.column(c).to_pylist() for c in ("slice", "found", "tops", "doc_id"))
            for row, (slice_, found, tops, doc, text) in enumerate(zip(*columns, texts_of(batch.column("text")))):
                if slice_ != at:
                    at, top = slice_, {}
                if found is not None:
                    top.update(zip((found[i : i + 16] for i in range(0, len(found), 16)), np.frombuffer(tops, "<i8").tolist()))
                    continue
                lines, numbers, hashes = line_hashes(text, min_chars)
                lost = {i for i, h in zip(numbers, hashes) if h in top and top[h] != doc}
                keep.append(row)
                total.append(len(lines))
                gone.append(len(lost))
                kept.append(b"\n".join(x for i, x in enumerate(lines) if i not in lost) if lost else text)
            rest = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([rest.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array([k.decode() for k in kept], pa.string()),
                                              *(rest.column(f"own_{c}") for c in extra)], names=["doc_id", "n_lines", "n_dropped", "kept_text", *extra])

    both = answers.unionByName(rows.drop("hashes"), allowMissingColumns=True).repartition(min(100_000, max(spark.sparkContext.defaultParallelism, data // task_bytes)), "slice")
    both = both.sortWithinPartitions("slice", F.col("found").isNull())
    kinds = {f.name: f.dataType.simpleString() for f in own.schema.fields}
    return both.mapInArrow(drop, ", ".join(["doc_id long, n_lines long, n_dropped long, kept_text string", *(f"`{c}` {kinds[f'own_{c}']}" for c in extra)]))

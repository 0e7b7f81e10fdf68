"""Packing of tokenised documents into sequences of bounded length, improved by swap-based local search.

Documents become id runs ending in an end id; only runs longer than a sequence
are cut. Full pieces are sequences of their own. The other pieces are dealt by
a hash of the whole row and its number in the written table into groups of about
``GROUP_PIECES`` (so no repeated or null id, nor a repeated row, makes one hot). A group is packed by best fit in decreasing order,
then its underfull bins take part in a local search: pieces move to a bin
where they fit, one piece is exchanged for one or for two of another bin,
always raising the sum of squared fills, until the bins are as few as can be or
no such step is left among all underfull bins. Bins are looked up by their room
and by what they could give back (sets of sizes as bits of a number).
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripletframe.llm.bpe import load
from tripletframe.llm.common import refcounts_only, slices, small_batches, starts_of, stash

CAPACITY = 2048
GROUP_PIECES = 20_000


def cut_runs(runs: list[bytes], capacity: int, end: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list]:
    """Id runs (4 bytes an id), each with ``end`` behind it, as pieces of ``capacity`` ids: number of the run, piece, start, length, ids."""
    whole = [r + end for r in runs]
    size = np.fromiter(map(len, whole), np.int64, len(whole)) // 4
    n = -(-size // capacity)
    row = np.repeat(np.arange(len(whole)), n)
    piece = np.arange(len(row)) - np.repeat(starts_of(n)[:-1], n)
    start = piece * capacity
    length = np.minimum(size[row] - start, capacity)
    if len(row) > len(whole):
        view = [memoryview(w) for w in whole]
        whole = [view[r][4 * a : 4 * (a + m)] for r, a, m in zip(row.tolist(), start.tolist(), length.tolist())]
    return row, piece, start, length, whole


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, digest: bool = False) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> doc_id, piece, start, length, ids (binary) of every piece; with ``digest`` ids_crc32 (long) for ids.

    Encoding, cutting and checksums are one pass over the texts; with ``digest``
    no ids leave it. A null or empty text is the end id alone. Repeated rows are
    packed as often as they occur, and so are rows with a null id; whole texts
    of any length are cut. Other columns are not read; an empty table has no pieces.
    """
    small_batches(docs.sparkSession)
    end = np.uint32(end_id).astype("<u4").tobytes()
    last = "ids_crc32" if digest else "ids"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refcounts_only(keep=path)
        bpe = load(path)
        for batch in batches:
            for part, texts in slices(batch, "text"):
                row, piece, start, length, ids = cut_runs(bpe.encode(texts), capacity, end)
                own = pa.array(list(map(zlib.crc32, ids)), pa.int64()) if digest else pa.array(list(map(bytes, ids)), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), own],
                                                 names=["doc_id", "piece", "start", "length", last])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, f"doc_id long, piece int, start long, length long, {last} {'long' if digest else 'binary'}")


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins (lists of positions) by best fit, longest first."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]  # room -> open bins
    rooms: list[int] = []  # rooms that have bins, sorted
    bins: list[list[int]] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        at = bisect.bisect_left(rooms, need)
        if at < len(rooms):
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if room > need:
            if not by_room[room - need]:
                bisect.insort(rooms, room - need)
            by_room[room - need].append(b)
    return bins


def _offers(sizes: list[int]) -> int:
    """Bits of what a bin can give back for a piece: nothing, the size of a piece, the sum of two."""
    single = twice = 0
    for v in sizes:
        twice |= (single >> v & 1) << 2 * v
        single |= 1 << v
    out = 1 | single | twice
    for v in set(sizes):
        out |= (single & ~(1 << v)) << v
    return out


class _Rooms:
    """Underfull bins by room, with the offers of the bins of each room joined; a bin's stamp is when it last changed."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.rooms: list[int] = []  # rooms that have bins, sorted
        self.bins: dict[int, dict[int, int]] = {}  # room -> bin -> its offers
        self.joined: dict[int, int] = {}  # room -> offers of all its bins (and maybe of bins that left)
        self.stamp: dict[int, int] = {}
        self.newest: dict[int, int] = {}  # room -> a stamp not below its bins'

    def put(self, k: int, fill: int, offers: int) -> None:
        room = self.capacity - fill
        if room not in self.bins:
            bisect.insort(self.rooms, room)
            self.bins[room], self.joined[room], self.newest[room] = {}, 0, -1
        self.bins[room][k] = offers
        self.joined[room] |= offers
        self.newest[room] = max(self.newest[room], self.stamp[k])

    def take(self, k: int, fill: int) -> int:
        room = self.capacity - fill
        offers = self.bins[room].pop(k)
        if not self.bins[room]:
            self.rooms.pop(bisect.bisect_left(self.rooms, room))
            del self.bins[room], self.joined[room], self.newest[room]
        return offers

    def partner(self, give: int, own_room: int, since: int) -> int | None:
        """The fullest bin changed after ``since`` that gets fuller than the giver by taking a piece of ``give``."""
        for room in self.rooms:
            low, high = max(0, give - room), give - max(1, room - own_room + 1)  # sums that may come back
            if high < low or self.newest[room] <= since:
                continue
            wanted = (1 << high + 1) - (1 << low)
            if not self.joined[room] & wanted:
                continue
            every = 0
            for k, offers in self.bins[room].items():
                if offers & wanted and self.stamp[k] > since:
                    return k
                every |= offers
            self.joined[room] = every
        return None


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Empty underfull bins by moves and exchanges that raise the sum of squared fills.

    The emptiest bin gives: a piece is moved into the fullest bin with room for
    it, or exchanged for one or for two pieces of another bin that together are
    smaller, so that the other bin gets fuller than the giver was. When a bin can
    give nothing more to any other the next one follows; it can still receive, and
    is tried again with the bins that have changed since. The search ends when
    no fewer bins could hold all pieces or no bin can give anything.
    """
    size = lengths.tolist()
    fill = [sum(size[i] for i in b) for b in bins]
    least = -(-sum(fill) // capacity)
    count, now, moved = len(bins), 0, len(bins) > least
    rooms = _Rooms(capacity)
    tried: dict[int, int] = {}  # bin -> when it could give nothing
    if moved:
        for k in range(len(bins)):
            if fill[k] < capacity:
                rooms.stamp[k] = now
                rooms.put(k, fill[k], _offers([size[i] for i in bins[k]]))
    while moved and count > least:
        moved = False
        for _, giver in sorted((capacity - r, k) for r in rooms.rooms for k in rooms.bins[r]):
            if count <= least:
                break
            if fill[giver] >= capacity:
                continue
            offers, since, gave = rooms.take(giver, fill[giver]), tried.get(giver, -1), False
            while bins[giver] and (step := _step(giver, rooms, bins, fill, size, capacity, since)):
                i, k, back = step
                gain = size[i] - sum(size[j] for j in back)
                rooms.take(k, fill[k])
                bins[giver] = [x for x in bins[giver] if x != i] + list(back)
                bins[k] = [x for x in bins[k] if x not in back] + [i]
                fill[giver] -= gain
                fill[k] += gain
                now += 1
                rooms.stamp[k] = rooms.stamp[giver] = now
                tried.pop(k, None)
                if fill[k] < capacity:
                    rooms.put(k, fill[k], _offers([size[x] for x in bins[k]]))
                since, gave, moved = -1, True, True
            if bins[giver]:
                rooms.put(giver, fill[giver], _offers([size[x] for x in bins[giver]]) if gave else offers)
                tried[giver] = now
            count -= not bins[giver]
    return [b for b in bins if b]


def _step(giver: int, rooms: _Rooms, bins: list[list[int]], fill: list[int], size: list[int], capacity: int, since: int) -> tuple[int, int, tuple[int, ...]] | None:
    """A piece of the giver, the bin that gets it, and what comes back."""
    looked = set()
    for i in sorted(bins[giver], key=lambda i: -size[i]):
        if size[i] in looked:
            continue
        looked.add(size[i])
        k = rooms.partner(size[i], capacity - fill[giver], since)
        if k is not None:
            room = capacity - fill[k]
            return i, k, () if size[i] <= room else _exchange(size[i], room, bins[k], size)
    return None


def _exchange(give: int, room: int, other: list[int], size: list[int]) -> tuple[int, ...] | None:
    """One or two pieces of ``other`` to get for a piece of ``give`` so that it gets fuller by 1..room, at most."""
    own = sorted((size[j], j) for j in other)
    values = [v for v, _ in own]
    low, best, found = give - room, 0, None
    at = bisect.bisect_left(values, low)
    if at < len(own) and values[at] < give:
        best, found = give - values[at], (own[at][1],)
    for a, (v, j) in enumerate(own):
        b = bisect.bisect_left(values, low - v, a + 1)
        if b < len(own) and v + values[b] < give and give - v - values[b] > best:
            best, found = give - v - values[b], (j, own[b][1])
    return found


def pack(cut: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset (long) to a table of pieces (doc_id, piece, start, length, ...).

    Offsets are gapless from 0 in each sequence; no sequence is longer than
    ``capacity``. An empty table stays empty.
    """
    cut = stash(cut, "pieces")
    short = cut.where(F.col("length") < capacity)
    groups = max(1, -(-short.count() // group_pieces))
    columns = cut.columns

    def fill(group: pa.Table) -> pa.Table:
        group = group.take(pc.sort_indices(group, [(c, "ascending") for c in ("doc_id", "piece", "start")]))
        lengths = group.column("length").to_numpy()
        bins = local_search(best_fit(lengths, capacity), lengths, capacity)
        size = [len(b) for b in bins]
        rows = np.concatenate([np.array(b) for b in bins])
        ends = np.cumsum(lengths[rows])
        base = np.append(0, ends[np.cumsum(size)[:-1] - 1])
        sequence = group.column("grp")[0].as_py() + groups * np.repeat(np.arange(len(bins)), size)
        return (group.select(columns).take(pa.array(rows)).append_column("sequence_id", pa.array(sequence))
                .append_column("offset", pa.array(ends - lengths[rows] - np.repeat(base, size))))

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields), "sequence_id long, offset long"])
    # numbered over the stashed table itself, whose splits do not change between attempts
    packed = (short.withColumn("grp", F.pmod(F.xxhash64(*columns, F.monotonically_increasing_id()), F.lit(groups)))
              .groupBy("grp").applyInArrow(fill, schema))
    whole = cut.where(F.col("length") >= capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(whole)

"""Repeated passages by sharded phrase automata.

Texts are dealt into slices of about SLICE_BYTES by a hash of the row. Work on
a slice or on a shard happens in one Arrow group of bounded size; between them
only packed arrays travel:

1. *Anchors.* Every window of ``width`` words is represented by its anchor: the
   smallest hash among the windows's ``width - RUN + 1`` runs of RUN words.
   Equal windows have equal anchors, and neighbouring windows share theirs, so
   about a quarter as many anchors as words leave a slice, each distinct one once.
2. *Recurring anchors.* The shard that owns an anchor sees in how many documents
   it occurs and tells the slices which of theirs recur.
3. *Passages.* A slice sends the words of consecutive windows with one recurring
   anchor to the anchor's shard, each distinct passage once with its smallest
   and largest document.
4. *Automata.* The shard confirms, word for word, the windows that recur in
   two documents, compiles them into an Aho-Corasick automaton over word
   numbers and streams all its passages through it; every occurrence is answered
   with the smallest document its phrase starts in.
5. *Removal.* The slices drop each word covered by a window that also starts in
   a smaller document.

A passage that a third of all documents share leaves a slice once, so its shard
sees one entry per slice, not per document.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripletframe.llm.common import NO_ID, SLICE_BYTES, lean, longs, refcounts_only, small_batches, starts_of, texts_of

RUN = 6
#: Text bytes whose anchors one shard owns: about a quarter of a million anchors.
SHARD_BYTES = 6 << 20
#: Characters that spell a word's number in an automaton; their alphabet is the root of the shard's distinct words, so nodes have few branches.
SYMBOLS = 2
#: Text bytes whose words are hashed at once.
HASH_BYTES = 1 << 20
POWER = 0x9E3779B97F4A7C55
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0..n of POWER and of its inverse, modulo 2**64."""
    return tuple(np.cumprod(np.append(np.uint64(1), np.full(n, x, np.uint64))) for x in (POWER, pow(POWER, -1, 1 << 64)))


def word_hashes(text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash (modulo 2**64) of each word text[begin:end], from running sums over HASH_BYTES at a time."""
    out = np.zeros(len(begin), np.uint64)
    a = 0
    while a < len(begin):
        b = max(a + 1, int(np.searchsorted(end, begin[a] + HASH_BYTES, side="right")))
        part = text[begin[a] : end[b - 1]]
        power, back = _powers(max(HASH_BYTES, len(part)))
        total = np.append(np.uint64(0), np.cumsum((part + np.uint64(1)) * power[: len(part)], dtype=np.uint64))
        i, j = begin[a:b] - begin[a], end[a:b] - begin[a]
        out[a:b] = (total[j] - total[i]) * back[i]
        a = b
    return out


class Slice:
    """Words, windows and anchors of a slice's documents, in an order that depends on the rows alone.

    ``text`` holds all words, one space between them; word k is text[begin[k]:end[k]].
    """

    def __init__(self, rows: pa.Table, width: int):
        refcounts_only()
        ids, texts = longs(rows.column("doc_id")), texts_of(rows.column("text"))
        self.order = sorted(range(len(texts)), key=lambda i: (ids[i], texts[i]))
        self.ids = ids[self.order]
        plain = [b" ".join(texts[i].split()) for i in self.order]
        self.lengths = np.array([t.count(b" ") + 1 if t else 0 for t in plain], np.int64)
        self.starts = starts_of(self.lengths)
        self.text = b" ".join(t for t in plain if t)
        raw = np.frombuffer(self.text, np.uint8)
        space = np.flatnonzero(raw == 32)
        self.begin, self.end = (np.append(0, space + 1), np.append(space, len(raw))) if len(raw) else (np.zeros(0, np.int64),) * 2
        self.width = width
        n = len(self.begin)
        self.doc = doc = np.repeat(np.arange(len(plain)), self.lengths)
        if n < width:
            self.window, self.anchor, self.place = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
            return
        h = word_hashes(raw, self.begin, self.end)
        run = min(RUN, width)
        mixed = np.zeros(n - run + 1, np.uint64)
        for j in range(run):
            mixed = mixed * MIX[0] + h[j : n - run + 1 + j]
        mixed = (mixed ^ (mixed >> np.uint64(29))) * MIX[1]
        mixed ^= mixed >> np.uint64(32)
        m, runs = n - width + 1, width - run + 1
        best, place, span = mixed, np.arange(len(mixed)), 1  # smallest of ``span`` runs and where (the first of equal ones)
        while span < runs:
            step = min(span, runs - span)
            less = best[step:] < best[:-step]
            best, place, span = np.where(less, best[step:], best[:-step]), np.where(less, place[step:], place[:-step]), span + step
        inside = np.flatnonzero(doc[:m] == doc[width - 1 :])
        self.window, self.anchor, self.place = inside, best[inside], place[inside]

    def words(self, a: int, b: int) -> bytes:
        """Words a to b (not included), joined by one space."""
        return self.text[self.begin[a] : self.end[b - 1]] if a < b else b""

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchors with their smallest and largest document."""
        order = np.argsort(self.anchor, kind="stable")  # documents ascend within equal anchors
        a, d = self.anchor[order], self.ids[self.doc[self.window[order]]]
        first = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(a)) - 1 if len(a) else first
        return a[first], d[first], d[last]

    def passages(self, recurring: np.ndarray):
        """Runs of windows with one recurring anchor: (first window, windows, anchor) arrays."""
        if not len(recurring) or not len(self.window):
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
        at = np.minimum(np.searchsorted(recurring, self.anchor), len(recurring) - 1)
        keep = recurring[at] == self.anchor
        w, a, p = self.window[keep], self.anchor[keep], self.place[keep]
        if not len(w):
            return w, w, a
        first = np.flatnonzero(np.append(True, (w[1:] != w[:-1] + 1) | (p[1:] != p[:-1]) | (self.doc[w[1:]] != self.doc[w[:-1]])))
        return w[first], np.diff(np.append(first, len(w))), a[first]

    def distinct(self, recurring: np.ndarray, shards: int):
        """Per shard, in order: the sorted distinct passages (bytes) and where each occurs: {shard: {text: [first windows]}}."""
        out: dict[int, dict[bytes, list[int]]] = {}
        first, count, anchor = self.passages(recurring)
        shard = (anchor % np.uint64(shards)).astype(np.int64)
        begin, end, text = self.begin[first], self.end[first + count + self.width - 2], self.text
        for w, i, j, s in zip(first.tolist(), begin.tolist(), end.tolist(), shard.tolist()):
            out.setdefault(s, {}).setdefault(text[i:j], []).append(w)
        return {s: dict(sorted(out[s].items())) for s in sorted(out)}


def _u64(parts) -> np.ndarray:
    return np.frombuffer(b"".join(parts), np.uint64)


def _i64(parts) -> np.ndarray:
    return np.frombuffer(b"".join(parts), np.int64)


def recurring_anchors(rows: pa.Table) -> pa.Table:
    """Shard: packs (slice, anchors, lo, hi) -> per slice the anchors that occur in two documents or more."""
    packs = rows.column("anchors").to_pylist()
    a, lo, hi = _u64(packs), _i64(rows.column("lo").to_pylist()), _i64(rows.column("hi").to_pylist())
    order = np.argsort(a, kind="stable")
    s = a[order]
    first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    many = np.minimum.reduceat(lo[order], first) < np.maximum.reduceat(hi[order], first)
    flag = np.zeros(len(a), bool)
    flag[order] = np.repeat(many, np.diff(np.append(first, len(s))))
    cut = starts_of([len(p) // 8 for p in packs])
    told = [a[x:y][flag[x:y]].tobytes() for x, y in pairwise(cut.tolist())]
    return pa.table({"slice": rows.column("slice"), "anchors": pa.array(told, pa.binary())})


def _spelled(passages: list[bytes]) -> list[str]:
    """Passages as the numbers of their words, SYMBOLS characters each, high ones first."""
    number: dict[bytes, int] = {}
    n = np.array([number.setdefault(w, len(number)) for text in passages for w in text.split(b" ")], np.int64)
    base = 2
    while base**SYMBOLS < len(number):
        base += 1
    signs = np.stack([n // base**j % base + 1 for j in range(SYMBOLS - 1, -1, -1)], axis=1).astype("<u4")
    line = signs.tobytes().decode("utf-32-le")
    ends = np.cumsum([(text.count(b" ") + 1) * SYMBOLS for text in passages]).tolist()
    return [line[a:b] for a, b in zip([0, *ends], ends)]


def answer_passages(rows: pa.Table, width: int) -> pa.Table:
    """Shard: confirm recurring windows, compile the automaton, locate them in all passages.

    Answers per slice: three packed arrays, the passage's number, the window's
    offset in it and the smallest document that has the window.
    """
    refcounts_only()
    size = width * SYMBOLS
    known: dict[bytes, int] = {}  # equal passages of several slices are one
    low, high, refs = [], [], []
    for pack, lo, hi in zip(*(rows.column(c).to_pylist() for c in ("texts", "lo", "hi"))):
        own = []
        for text, x, y in zip(pack.split(b"\n"), np.frombuffer(lo, np.int64).tolist(), np.frombuffer(hi, np.int64).tolist()):
            d = known.setdefault(text, len(known))
            if d == len(low):
                low.append(x)
                high.append(y)
            else:
                low[d], high[d] = min(low[d], x), max(high[d], y)
            own.append(d)
        refs.append(np.array(own, np.int64))
    spelled = _spelled(list(known))
    seen: dict[str, tuple[int, int]] = {}
    for s, x, y in zip(spelled, low, high):
        for i in range(0, len(s) - size + 1, SYMBOLS):
            k = s[i : i + size]
            have = seen.get(k)
            seen[k] = (x, y) if have is None else (min(x, have[0]), max(y, have[1]))
    automaton = ahocorasick.Automaton()
    for k, (x, y) in seen.items():
        if x < y:
            automaton.add_word(k, x)
    seen.clear()
    hits: list[list[tuple[int, int]]] = [[] for _ in spelled]
    if len(automaton):
        automaton.make_automaton()
        for found, s in zip(hits, spelled):
            found.extend([((end + 1) // SYMBOLS - width, x) for end, x in automaton.iter(s) if (end + 1) % SYMBOLS == 0])  # at the end of a word
    count = np.array([len(h) for h in hits], np.int64)
    base = starts_of(count)
    flat = np.array([v for h in hits for v in h], np.int64).reshape(-1, 2)
    slices_, nums, offs, firsts = rows.column("slice").to_pylist(), [], [], []
    for own in refs:
        n = count[own]
        at = np.repeat(base[own], n) + np.arange(n.sum()) - np.repeat(starts_of(n)[:-1], n)
        nums.append(np.repeat(np.arange(len(own)), n).tobytes())
        offs.append(flat[at, 0].tobytes())
        firsts.append(flat[at, 1].tobytes())
    return pa.table({"slice": pa.array(slices_, pa.int64()), "shard": rows.column("shard"), "num": pa.array(nums, pa.binary()), "off": pa.array(offs, pa.binary()), "least": pa.array(firsts, pa.binary())})


def substring_dedup(docs: DataFrame, width: int = 13, extra: list[str] | None = None, slice_bytes: int = SLICE_BYTES, shard_bytes: int = SHARD_BYTES, original: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text, then the columns ``extra``, per row of ``docs(doc_id, text, ...)``.

    Words are runs of anything but ASCII white space, unchanged; kept words are
    joined by one space. Windows lie within one document and are judged on the
    input. Null and empty texts have no words; a null doc_id comes after all
    others; rows with equal ids do not remove each other's words; repeated rows
    are answered each. Columns not named are not read, so their names cannot
    clash; ``extra`` may not repeat a result column. An empty table gives no rows.
    With ``original`` a row that loses no word keeps its text as it is, null or any white space.

    All three steps of a slice read the same whole rows, so these are shuffled once.
    """
    small_batches(docs.sparkSession)
    extra = [c for c in extra or [] if c != "doc_id"]
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(F.col(c).alias(f"own_{c}") for c in extra))
    total = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_slices, n_shards = max(1, -(-total // slice_bytes)), max(1, -(-total // shard_bytes))
    rows = own.withColumn("slice", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_slices)))

    def out_anchors(rows: pa.Table) -> pa.Table:
        part = Slice(rows, width)
        a, lo, hi = part.anchors()
        shard = (a % np.uint64(n_shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        a, lo, hi = a[order], lo[order], hi[order]
        kinds, first = np.unique(shard[order], return_index=True)
        cut = list(pairwise([*first.tolist(), len(a)]))
        pack = lambda x: pa.array([x[i:j].tobytes() for i, j in cut], pa.binary())
        return pa.table({"shard": pa.array(kinds, pa.int64()), "slice": pa.array(np.full(len(kinds), rows.column("slice")[0].as_py()), pa.int64()), "anchors": pack(a), "lo": pack(lo), "hi": pack(hi)})

    def out_passages(key, rows: pa.Table, told: pa.Table) -> pa.Table:
        part = Slice(rows, width)
        found = part.distinct(np.sort(_u64(told.column("anchors").to_pylist())), n_shards)
        cols: dict[str, list] = {"shard": [], "slice": [], "texts": [], "lo": [], "hi": []}
        for shard, passages in found.items():
            docs_of = [part.ids[part.doc[w]] for w in passages.values()]
            cols["shard"].append(shard)
            cols["slice"].append(key[0].as_py())
            cols["texts"].append(b"\n".join(passages))
            cols["lo"].append(np.array([d.min() for d in docs_of], np.int64).tobytes())
            cols["hi"].append(np.array([d.max() for d in docs_of], np.int64).tobytes())
        return pa.table({k: pa.array(v, pa.int64() if k in ("shard", "slice") else pa.binary()) for k, v in cols.items()})

    def removal(key, rows: pa.Table, told: pa.Table) -> pa.Table:
        part = Slice(rows, width)
        kinds = told.column("kind").to_pylist()
        get = {c: told.column(c).to_pylist() for c in ("shard", "anchors", "num", "off", "least")}
        recurring = np.sort(_u64([p for k, p in zip(kinds, get["anchors"]) if k == 0]))
        found = part.distinct(recurring, n_shards) if 1 in kinds else {}
        n = len(part.begin)
        edge = np.zeros(n + 1, np.int64)
        for k, shard, *packs in zip(kinds, *(get[c] for c in ("shard", "num", "off", "least"))):
            if k == 0 or not packs[0]:
                continue
            num, off, least = (np.frombuffer(p, np.int64) for p in packs)
            places = list(found[shard].values())
            size = np.array([len(p) for p in places], np.int64)
            flat, base = np.array([w for p in places for w in p], np.int64), starts_of(size)
            rep = size[num]  # every occurrence of the passage
            which = np.repeat(base[num], rep) + np.arange(rep.sum()) - np.repeat(starts_of(rep)[:-1], rep)
            at = flat[which] + np.repeat(off, rep)
            gone = at[np.repeat(least, rep) < part.ids[part.doc[at]]]
            np.add.at(edge, gone, 1)
            np.add.at(edge, gone + width, -1)
        removed = np.cumsum(edge[:n]) > 0
        per_doc = np.diff(np.append(0, np.cumsum(removed))[part.starts])
        texts = []
        for k, (a, b) in enumerate(pairwise(part.starts.tolist())):
            if not per_doc[k]:
                texts.append(None if original else part.words(a, b))
                continue
            cut = np.flatnonzero(np.diff(np.concatenate([[True], removed[a:b], [True]]))) + a  # kept runs begin and end here
            texts.append(b" ".join(part.words(x, y) for x, y in cut.reshape(-1, 2).tolist()))
        ids, order, kept = pa.array(part.ids, mask=part.ids == NO_ID), pa.array(part.order, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())
        if original:
            kept = pc.if_else(pa.array(per_doc > 0), kept, rows.column("text").combine_chunks().take(order))
        return pa.table({"doc_id": ids, "n_words": part.lengths, "n_removed": per_doc, "kept_text": kept,
                         **{c: rows.column(f"own_{c}").take(order) for c in extra}})

    packs = rows.groupBy("slice").applyInArrow(lambda t: lean(out_anchors, t), "shard long, slice long, anchors binary, lo binary, hi binary")
    told = packs.groupBy("shard").applyInArrow(lambda t: lean(recurring_anchors, t), "slice long, anchors binary").where("octet_length(anchors) > 0")
    passages = rows.groupBy("slice").cogroup(told.groupBy("slice")).applyInArrow(lambda key, t, told: lean(out_passages, key, t, told), "shard long, slice long, texts binary, lo binary, hi binary")
    answers = passages.groupBy("shard").applyInArrow(lambda t: lean(answer_passages, t, width), "slice long, shard long, num binary, off binary, least binary")
    null = F.lit(None)
    replies = told.select("slice", F.lit(0).alias("kind"), null.cast("long").alias("shard"), "anchors", *(null.cast("binary").alias(c) for c in ("num", "off", "least"))).unionByName(
        answers.select("slice", F.lit(1).alias("kind"), "shard", null.cast("binary").alias("anchors"), "num", "off", "least"))
    added = "".join(f", `{c}` {own.schema[f'own_{c}'].dataType.simpleString()}" for c in extra)
    return rows.groupBy("slice").cogroup(replies.groupBy("slice")).applyInArrow(lambda key, t, told: lean(removal, key, t, told), "doc_id long, n_words long, n_removed long, kept_text string" + added)

"""Ranked lexical search: items against all documents by dense blocked matrix products with exact integer scores.

1. *Items* are dealt by a hash into blocks of about BLOCK_BYTES of text; a block's vocabulary
   is bounded by that (or by the one item that is longer) and goes to all tasks.
2. *Postings.* Documents are cut into terms once per block; of every document the vocabulary's terms with their
   counts are written, and its number of terms. Document numbers and frequencies are counted from that table.
3. *Products.* Tasks take DOC_TILE documents and ITEM_TILE items at a time, keep the terms
   that occur in both (a compact vocabulary), cut these into runs in which weights times the
   greatest impact stay below 2^53, and multiply the dense weight tile by the dense impact
   tile in float64: every partial sum is an exact integer. Runs are added in int64.
4. *Top k.* Of each tile what reaches the item's k-th score so far (ties too) is kept, ordered by score
   and doc_id; a task's best go to one ranking per item.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripletframe.llm.common import small_batches, starts_of, stash, texts_of

BLOCK_BYTES = 4 << 20
DOC_TILE, ITEM_TILE, TERM_TILE = 2048, 256, 8192
#: The formula's constants: impact scale, length weight in percent, saturation.
IMPACT, LENGTH_PART, SATURATION = 1_000_000, 50, 20
EXACT = 1 << 53

#: On UTF-8 bytes: ASCII letters and digits and all of every other character.
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def terms(text: bytes) -> list[bytes]:
    return _TERM.findall(text.lower())  # bytes: only A-Z change


def tile_scores(weights: np.ndarray, impacts: np.ndarray, peak: int) -> np.ndarray:
    """Integer scores (items x documents) of float64 tiles (items x terms, terms x documents) whose products are at most ``peak``."""
    run = max(1, min(TERM_TILE, (EXACT - 1) // max(peak, 1)))
    total = np.zeros((len(weights), impacts.shape[1]), np.int64)
    for a in range(0, weights.shape[1], run):
        total += (weights[:, a : a + run] @ impacts[a : a + run]).astype(np.int64)
    return total


class TopK:
    """The ``k`` best (score, smallest id; null ids last) documents of each of ``n`` items."""

    def __init__(self, n: int, k: int):
        self.k, self.floor = k, np.zeros(n, np.int64)  # k-th score so far, or 0
        self.rows = [np.zeros(0, np.int64) for _ in range(4)]  # item, score, id, id is null

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        """Scores (items x documents) of the items from ``first`` on."""
        floor = self.floor[first : first + len(scores), None]
        item, doc = np.nonzero((scores >= floor) & (scores > 0))
        new = (item + first, scores[item, doc], ids[doc], missing[doc].astype(np.int64))
        item, score, id_, null = (np.concatenate(c) for c in zip(self.rows, new))
        order = np.lexsort((id_, null, -score, item))
        item = item[order]
        at = starts_of(np.bincount(item, minlength=len(self.floor)))
        order, item = (x[np.arange(len(item)) - at[item] < self.k] for x in (order, item))
        self.rows = [item, score[order], id_[order], null[order]]
        at = starts_of(np.bincount(item, minlength=len(self.floor)))
        full = np.flatnonzero(np.diff(at) == self.k)
        self.floor[full] = self.rows[1][at[full + 1] - 1]


def _postings(docs: DataFrame, vocab: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms of the document), ids (int32) and tf (int64) of its vocabulary terms, both packed."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)  # bounded by the block

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for batch in batches:
            n, ids, tfs = [], [], []
            for text in texts_of(batch.column("text")):
                words = terms(text)
                n.append(len(words))
                known, tf = np.unique(np.array([i for i in map(get, words) if i is not None], np.int32), return_counts=True)
                ids.append(known.tobytes())
                tfs.append(tf.astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(tfs, pa.binary())], names=["doc_id", "n", "ids", "tfs"])

    return docs.mapInArrow(cut, "doc_id long, n long, ids binary, tfs binary")


def _frequencies(postings: DataFrame, size: int) -> DataFrame:
    """(term, df) of the terms that documents hold, added up per task first."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), np.int32), minlength=size)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(df[held], pa.int64())], names=["term", "df"])

    return postings.select("ids").mapInArrow(tally, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))


def _best(scored: DataFrame, items: list[tuple[int, np.ndarray]], weight: np.ndarray, k: int) -> DataFrame:
    """(number, doc_id, score): each task's best documents of the block's items from (doc_id, m, ids, tfs)."""
    sizes = starts_of([len(t) for _, t in items])
    packed = (np.array([n for n, _ in items], np.int64), sizes, np.concatenate([t for _, t in items]) if items else np.zeros(0, np.int32), weight)
    shared = scored.sparkSession.sparkContext.broadcast(packed)  # bounded by the block

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, sizes, item_terms, weight = shared.value
        best = TopK(len(numbers), k)
        peak = int(weight.max(initial=0)) * IMPACT
        seen = np.zeros(len(weight), bool)
        for batch in batches:
            for start in range(0, batch.num_rows, DOC_TILE):
                part = batch.slice(start, DOC_TILE)
                packs = part.column("ids").to_pylist()
                term = np.frombuffer(b"".join(packs), np.int32)
                doc = np.repeat(np.arange(len(packs)), [len(p) // 4 for p in packs])
                tf = np.frombuffer(b"".join(part.column("tfs").to_pylist()), np.int64)
                m = part.column("m").to_numpy()[doc]
                impact = (1000 * IMPACT * tf) // (1000 * tf + SATURATION * m)
                id_col = part.column("doc_id")
                ids, missing = id_col.fill_null(0).to_numpy(), id_col.is_null().to_numpy(zero_copy_only=False)
                for first in range(0, len(numbers), ITEM_TILE):
                    last = min(first + ITEM_TILE, len(numbers))
                    mine = item_terms[sizes[first] : sizes[last]]
                    seen[:] = False
                    seen[mine] = True
                    here = seen[term]
                    compact = np.unique(term[here])
                    if not len(compact):
                        continue
                    used = np.zeros(len(weight), bool)
                    used[compact] = True
                    owner = np.repeat(np.arange(last - first), np.diff(sizes[first : last + 1]))[used[mine]]
                    column = np.searchsorted(compact, mine[used[mine]])
                    row = np.searchsorted(compact, term[here])
                    scores = np.zeros((last - first, len(packs)), np.int64)
                    for a in range(0, len(compact), TERM_TILE):  # bounded dense tiles
                        own, their = (column >= a) & (column < a + TERM_TILE), (row >= a) & (row < a + TERM_TILE)
                        width = min(TERM_TILE, len(compact) - a)
                        left, right = np.zeros((last - first, width)), np.zeros((width, len(packs)))
                        left[owner[own], column[own] - a] = weight[compact[column[own]]]
                        right[row[their] - a, doc[here][their]] = impact[here][their]
                        scores += tile_scores(left, right, peak)
                    best.add(first, scores, ids, missing)
        item, score, id_, null = best.rows
        yield pa.RecordBatch.from_arrays([pa.array(numbers[item], pa.int64()), pa.array(id_, pa.int64(), mask=null.astype(bool)), pa.array(score, pa.int64())],
                                         names=["number", "doc_id", "score"])

    return scored.select("doc_id", "m", "ids", "tfs").mapInArrow(search, "number long, doc_id long, score long")


def lexical_search(items: DataFrame, docs: DataFrame, k: int = 50, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``k`` best documents of ``docs(doc_id, text)`` for each row of ``items(item_id, text)``: item_id, rank, doc_id, score.

    Scores are above 0; equal ones rank by ascending doc_id, null ids last. Terms are runs of ASCII
    letters and digits and all non-ASCII characters, A-Z lower-cased; null and empty texts have none (such items
    have no rows, such documents count nowhere). Rows that repeat an item or a document are items and documents of
    their own; an item id may be of any type and null. Other columns are not read, so their names cannot clash.
    Empty tables give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark, DOC_TILE)
    asked = stash(items.select("item_id", "text", F.monotonically_increasing_id().alias("number")), "items")
    n_items, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, min(n_items, -(-size // block_bytes)))
    deal = F.pmod(F.xxhash64("number"), F.lit(blocks))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for b in range(blocks):
        block = asked.where(deal == b).select("number", "text").toArrow()  # bounded by the block
        vocab: dict[bytes, int] = {}
        own = []
        for number, text in zip(block.column("number").to_pylist(), texts_of(block.column("text"))):
            own.append((number, np.array(sorted({vocab.setdefault(t, len(vocab)) for t in terms(text)}), np.int32)))
        if not vocab:
            continue
        postings = stash(_postings(docs, vocab), "postings")
        n_docs, n_terms = postings.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            continue
        weigh = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df").cast("double") + 1)))
        held = _frequencies(postings, len(vocab)).select("term", weigh.alias("w")).toArrow()
        weight = np.zeros(len(vocab), np.int64)
        weight[held.column("term").to_numpy()] = held.column("w").to_numpy()
        m = F.expr(f"{100 - LENGTH_PART} + ({LENGTH_PART} * cast(n as decimal(19,0)) * cast({n_docs} as decimal(18,0))) div cast({n_terms} as decimal(18,0))")
        best = _best(postings.where("length(ids) > 0").withColumn("m", m), own, weight, k)
        found = best if found is None else found.unionByName(best)
    if found is None:
        return asked.limit(0).select("item_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    order = Window.partitionBy("number").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select("number", "item_id"), "number").select("item_id", "rank", "doc_id", "score")

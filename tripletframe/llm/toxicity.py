"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

The classifier is fitted on a bounded sample of labelled training rows
(``per_class`` of each label in the order of a hash of the id, at most
``SAMPLE_BYTES`` of text a label). Terms are words; all words of the sampled
examples are the vocabulary. Their document frequencies are counted over all
documents; a term's weight rises with how well it tells the labels apart in the
sample (log-likelihood ratio). The examples lie in blocks of like beside like,
their unit vectors in an inverted index whose lists are cut by block: every
(term, block) entry has its largest weight. Summed over a document's terms these
maxima bound its similarity to any example of a block; the blocks of the highest
bounds are summed exactly first, then only those whose bound reaches the k-th
best similarity found, so the neighbours are exact. Neighbours vote with weights
that fall with distance; a logistic fit of leave-one-out votes, weighted to the
labels' shares among all labelled training rows, calibrates them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripletframe.llm.common import refcounts_only, slices, small_batches, starts_of, stash

#: Bound of the fitted sample: labelled rows of each class, and the bytes of their texts.
PER_CLASS, SAMPLE_BYTES = 3000, 16 << 20
#: A term in this many examples that reaches this log-likelihood ratio gets more weight.
LEAST_DOCS, LEAST_RATIO = 5, 25.0
NEIGHBOURS = 15
BLOCK = 64
#: So many of the commonest terms are kept as dense rows of each block, the others as lists (no effect on results).
HEAD = 512
#: Blocks of the highest bounds that are summed before others are skipped.
FIRST_BLOCKS = 4
BATCH = 128  # texts looked up at once
_BLANK = bytes(32 if c < 128 and not chr(c).isalpha() else c for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs of letters and non-ASCII bytes."""
    return text.lower().translate(_BLANK).split()


class Sparse(NamedTuple):
    """Nonzero entries of a matrix, by row."""

    row: np.ndarray
    term: np.ndarray
    value: np.ndarray
    shape: tuple[int, int]

    @classmethod
    def of(cls, dense: np.ndarray) -> Sparse:
        row, term = np.nonzero(dense)
        return cls(row, term, dense[row, term], dense.shape)


class Vocabulary:
    """Counts of terms in texts."""

    def __init__(self, terms: list[bytes]):
        self.number, self.size = {t: i for i, t in enumerate(terms)}, len(terms)

    def counts(self, texts: list[bytes]) -> Sparse:
        runs = [[i for i in map(self.number.get, words_of(t)) if i is not None] for t in texts]
        size = np.fromiter(map(len, runs), np.int64, len(runs))
        flat = np.fromiter(chain.from_iterable(runs), np.int64, int(size.sum()))
        key, n = np.unique(np.repeat(np.arange(len(texts)), size) * max(1, self.size) + flat, return_counts=True)
        return Sparse(*np.divmod(key, max(1, self.size)), n.astype(float), (len(texts), self.size))


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (n[0] numbers), start[1], ..."""
    return np.repeat(start - starts_of(n)[:-1], n) + np.arange(n.sum())


def like_beside_like(v: Sparse, size: int, dims: int = 8, rounds: int = 3) -> np.ndarray:
    """Rows in an order that puts similar ones into one run of ``size``: split in halves along leading directions."""
    n, m = v.shape
    if n <= size:
        return np.arange(n)
    z = np.random.default_rng(5).standard_normal((m, dims))
    for _ in range(rounds):
        y = np.stack([np.bincount(v.row, v.value * z[v.term, j], n) for j in range(dims)], 1)
        z = np.stack([np.bincount(v.term, v.value * c[v.row], m) for c in np.linalg.qr(y)[0].T], 1)
    y = np.stack([np.bincount(v.row, v.value * z[v.term, j], n) for j in range(dims)], 1)
    todo, out = [np.arange(n)], []
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        rows = rows[np.argsort(y[rows, y[rows].var(axis=0).argmax()], kind="stable")]
        half = max(1, len(rows) // size // 2) * size
        todo += [rows[half:], rows[:half]]
    return np.concatenate(out)


class Index:
    """Block-max inverted index over unit vectors of the examples; exact neighbours of queries."""

    def __init__(self, vectors: np.ndarray | Sparse, labels: np.ndarray, ids: np.ndarray, k: int):
        v = vectors if isinstance(vectors, Sparse) else Sparse.of(vectors)
        has = np.bincount(v.row, minlength=v.shape[0]) > 0
        order = like_beside_like(v, BLOCK)
        order = order[has[order]]
        self.labels, self.ids, self.k = labels[order], ids[order], k
        empty = labels[~has]
        self.empty_vote = float(empty.mean()) if len(empty) else float(labels.mean()) if len(labels) else 0.0
        place = np.zeros(v.shape[0], np.int64)
        place[order] = np.arange(len(order))
        by = np.lexsort((place[v.row], v.term))
        self._lay(place[v.row[by]].astype(np.int32), v.value[by], np.bincount(v.term, minlength=v.shape[1]))

    def _lay(self, at: np.ndarray, weight: np.ndarray, per_term: np.ndarray) -> None:
        """Lists of all terms (example, weight), one after the other, their entries (a run of a list inside a block), and the commonest terms as dense rows."""
        self.at, self.weight, self.per_term = at, weight, per_term
        self.blocks = -(-len(self.ids) // BLOCK)
        term, block = np.repeat(np.arange(len(per_term), dtype=np.int32), per_term), at // BLOCK
        self.entry = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (block[1:] != block[:-1]))) if len(at) else np.zeros(0, np.int64)
        self.entry_size = np.diff(np.append(self.entry, len(at))).astype(np.int32)
        self.entry_block = block[self.entry]
        self.most = np.maximum.reduceat(weight, self.entry) if len(at) else np.zeros(0)
        self.begin = starts_of(np.bincount(term[self.entry], minlength=len(per_term)))
        common = np.sort(np.argsort(-per_term, kind="stable")[:HEAD])
        self.column = np.full(len(per_term), -1)
        self.column[common] = np.arange(len(common))
        own = np.flatnonzero(self.column[term] >= 0)
        self.dense = np.zeros((self.blocks, len(common), BLOCK))
        self.dense[block[own], self.column[term[own]], at[own] % BLOCK] = weight[own]
        self.dense_most = self.dense.max(axis=2).T

    def __getstate__(self):
        return self.labels, self.ids, self.k, self.empty_vote, self.at, self.weight, self.per_term

    def __setstate__(self, state):
        self.labels, self.ids, self.k, self.empty_vote, at, weight, per_term = state
        self._lay(at, weight, per_term)

    def _cut(self, q: Sparse) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Queries as dense rows of the common terms, and the entries of each one's other terms with its values."""
        column = self.column[q.term]
        head = np.zeros((q.shape[0], self.dense.shape[1]))
        head[q.row[column >= 0], column[column >= 0]] = q.value[column >= 0]
        row, term, value = (x[column < 0] for x in (q.row, q.term, q.value))
        n = self.begin[term + 1] - self.begin[term]
        entries, value = _ranges(self.begin[term], n), np.repeat(value, n)
        cuts = starts_of(n)[np.searchsorted(row, np.arange(q.shape[0] + 1))].tolist()
        return head, [(entries[a:b], value[a:b]) for a, b in zip(cuts, cuts[1:])]

    def bounds(self, head: np.ndarray, lists: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """For each query and block a similarity that none of the block's examples exceeds."""
        out = head @ self.dense_most
        for i, (entries, value) in enumerate(lists):
            out[i] += np.bincount(self.entry_block[entries], value * self.most[entries], self.blocks)
        return out

    def _add(self, sims: np.ndarray, head: np.ndarray, lists: list[tuple[np.ndarray, np.ndarray]], live: np.ndarray) -> None:
        """Exact similarities to the examples of each query's live blocks."""
        for b in np.flatnonzero(live.any(axis=0)).tolist():
            rows = np.flatnonzero(live[:, b])
            sims[rows, b * BLOCK : (b + 1) * BLOCK] = head[rows] @ self.dense[b]
        for i, (entries, value) in enumerate(lists):
            now = live[i, self.entry_block[entries]]
            some = entries[now]
            n = self.entry_size[some]
            at = _ranges(self.entry[some], n)
            sims[i] += np.bincount(self.at[at], np.repeat(value[now], n) * self.weight[at], sims.shape[1])

    def nearest(self, queries: np.ndarray | Sparse, leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Similarities and example numbers (k per query, best first, -1 where there are fewer); ties to smaller numbers.

        ``leave`` names an example per query (-1: none) that is no neighbour of it.
        """
        q = queries if isinstance(queries, Sparse) else Sparse.of(queries)
        n, k = q.shape[0], self.k
        best, who = np.zeros((n, k)), np.full((n, k), -1, np.int64)
        if not n or not self.blocks:
            return best, who
        left = np.flatnonzero(leave >= 0) if leave is not None else np.zeros(0, np.int64)
        head, lists = self._cut(q)
        bound = self.bounds(head, lists)
        sims = np.zeros((n, self.blocks * BLOCK))
        first = np.argpartition(-bound, FIRST_BLOCKS, axis=1)[:, :FIRST_BLOCKS] if self.blocks > FIRST_BLOCKS else np.broadcast_to(np.arange(self.blocks), bound.shape)
        live = np.zeros(bound.shape, bool)
        np.put_along_axis(live, first, True, axis=1)
        self._add(sims, head, lists, live)
        sims[left, leave[left] if len(left) else left] = 0
        found = np.take_along_axis(sims.reshape(n, self.blocks, BLOCK), first[:, :, None], axis=1).reshape(n, -1)
        least = (np.partition(found, -k, axis=1)[:, -k] if found.shape[1] >= k else np.zeros(n)) - 1e-9  # the k-th best is not below
        if not live.all():
            self._add(sims, head, lists, (bound >= least[:, None]) & (bound > 0) & ~live)
            sims[left, leave[left] if len(left) else left] = 0
        least = np.maximum(least, 1e-12)
        for i in range(n):
            some = np.flatnonzero(sims[i] >= least[i])
            own = np.round(sims[i, some], 12)
            top = np.lexsort((some, -own))[:k]
            best[i, : len(top)], who[i, : len(top)] = own[top], some[top]
        return best, who

    def votes(self, best: np.ndarray, who: np.ndarray) -> np.ndarray:
        """Distance-weighted share of label 1 among the neighbours."""
        weight = np.where(who >= 0, 1 / (1.05 - best), 0)
        label = self.labels[np.maximum(who, 0)] if len(self.labels) else np.zeros(who.shape)
        total = weight.sum(axis=1)
        return np.where(total > 0, (weight * label).sum(axis=1) / np.where(total > 0, total, 1), self.empty_vote)


class Model:
    """Everything a task needs to score texts (bounded by the sample and the vocabulary)."""

    def __init__(self, terms, idf, index, slope, offset, constant):
        self.vocabulary, self.idf, self.index = Vocabulary(terms), idf, index
        self.slope, self.offset, self.constant = slope, offset, constant

    def __getstate__(self):
        return {**self.__dict__, "vocabulary": b" ".join(self.vocabulary.number)}

    def __setstate__(self, state):
        self.__dict__.update(state, vocabulary=Vocabulary(state["vocabulary"].split()))

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, list[list]]:
        """Score and evidence (example id, label, similarity of the nearest three) of each text."""
        if self.constant is not None:
            return np.full(len(texts), self.constant), [[] for _ in texts]
        vote, evidence = np.full(len(texts), self.index.empty_vote), [[] for _ in texts]
        for a in range(0, len(texts), BATCH):
            queries = unit_vectors(self.vocabulary.counts(texts[a : a + BATCH]), self.idf)
            best, who = self.index.nearest(queries)
            some = np.unique(queries.row)
            vote[a + some] = self.index.votes(best[some], who[some])
            for i, s, w in zip((a + some).tolist(), best[some, :3].tolist(), who[some, :3].tolist()):
                evidence[i] = [{"doc_id": int(self.index.ids[k]), "toxic": int(self.index.labels[k]), "similarity": x} for x, k in zip(s, w) if k >= 0]
        return 1 / (1 + np.exp(-(self.slope * vote + self.offset))), evidence


def unit_vectors(counts: Sparse, weight: np.ndarray) -> Sparse:
    value = (1 + np.log(counts.value)) * weight[counts.term]
    norm = np.sqrt(np.bincount(counts.row, value**2, counts.shape[0]))
    return counts._replace(value=value / norm[counts.row])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic fit (slope, offset) by Newton's method with a small ridge."""
    z, beta = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        grad = z.T @ (weight * (p - y)) + 1e-2 * beta
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2), grad)
        beta -= np.clip(step, -4, 4)
        if abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def sketch(text: bytes, width: int = 5) -> list[bytes]:
    """Two smallest-shingle signatures; texts that share one are copies or near copies."""
    words = words_of(text)
    runs = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    return [min(xxhash.xxh64_digest(r, seed) for r in runs) for seed in (1, 2)]


def _unlike(rows: list, per_class: int, limit: int) -> list[tuple[int, int]]:
    """Examples (doc_id, label) from candidates (doc_id, label, bytes, signatures) in sample order: copies (both signatures
    equal) with one label count once, and each label's examples end at ``per_class`` rows or before ``limit`` bytes are passed."""
    seen, n, held, out = set(), Counter(), Counter(), []
    for d, y, size, signs in rows:
        key = (y, *map(bytes, signs))
        if key not in seen and n[y] < per_class and held[y] + size <= limit:
            seen.add(key)
            n[y] += 1
            held[y] += size
            out.append((d, y))
    return out


def in_training(doc_id: Column, folds: int = 5) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds != 0


def _ratio(p: np.ndarray, q: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Log-likelihood ratio of a term's presence (``p`` and ``q`` examples of label 1 and 0) against the label."""
    def part(k: np.ndarray, e: np.ndarray) -> np.ndarray:
        return np.where(k > 0, k * np.log(np.where(k > 0, k, 1) / np.where(k > 0, e, 1)), 0.0)

    n, d = float(n_pos + n_neg), p + q
    return 2 * (part(p, d * n_pos / n) + part(q, d * n_neg / n) + part(n_pos - p, (n - d) * n_pos / n) + part(n_neg - q, (n - d) * n_neg / n))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fit on labelled rows whose crc32(doc_id) mod 5 is not 0; a null label is no label, a repeated id counts with its larger one."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    known = (labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("doc_id is not null and toxic in (0, 1)")
             .where(in_training(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    share = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    if len(share) < 2:
        return Model([], np.zeros(0), None, 0.0, 0.0, float(next(iter(share), 0)))
    picked = None
    for y in (0, 1):  # twice as many candidates, so that copies can be left out
        part = known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * per_class)
        picked = part if picked is None else picked.unionByName(part)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refcounts_only()
        for batch in batches:
            for part, texts in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([sketch(t) for t in texts], pa.list_(pa.binary()))], names=[*part.schema.names, "signs"])

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refcounts_only()
        for batch in batches:
            for part, texts in slices(batch, "text"):
                words = [Counter(words_of(t)) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([list(c) for c in words], pa.list_(pa.binary())),
                                                  pa.array([list(c.values()) for c in words], pa.list_(pa.int32()))], names=["doc_id", "words", "tf"])

    # bounded: 4 * per_class rows; of a repeated id the largest text counts
    one = docs.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("text").alias("text"))
    sample = stash(one.mapInArrow(sign, "doc_id long, toxic int, text string, signs array<binary>"), "examples")
    rows = sample.orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id", "toxic", F.octet_length("text"), "signs").collect()
    examples = _unlike(rows, per_class, SAMPLE_BYTES)
    n_pos = sum(y for _, y in examples)
    n_neg = len(examples) - n_pos
    if not n_pos or not n_neg:
        return Model([], np.zeros(0), None, 0.0, 0.0, share[1] / (share[0] + share[1]))
    chosen = docs.sparkSession.createDataFrame(examples, "doc_id long, toxic int").select("doc_id")  # bounded: 2 * per_class ids
    bags = sample.join(F.broadcast(chosen), "doc_id").select("doc_id", "text").mapInArrow(bag, "doc_id long, words array<binary>, tf array<int>").orderBy("doc_id").toArrow()
    examples.sort()
    y, ids = np.array([y for _, y in examples]), np.array([d for d, _ in examples])
    names, counts = _all_terms(bags)
    del bags
    pos, neg = (np.bincount(counts.term[y[counts.row] == k], minlength=len(names)).astype(float) for k in (1, 0))
    ratio = np.where(pos + neg >= LEAST_DOCS, _ratio(pos, neg, n_pos, n_neg), 0)
    n, df = _document_frequencies(docs, names)
    idf = (np.log((1 + n) / (1 + df)) + 1) * (1 + np.log1p(np.where(ratio >= LEAST_RATIO, ratio, 0)))
    vectors = unit_vectors(counts, idf)
    del counts
    index = Index(vectors, y, ids, NEIGHBOURS)
    place = {d: k for k, d in enumerate(index.ids.tolist())}
    votes = np.full(len(y), index.empty_vote)
    for a in range(0, len(y), BATCH):
        at = slice(*np.searchsorted(vectors.row, (a, a + BATCH)))
        part = Sparse(vectors.row[at] - a, vectors.term[at], vectors.value[at], (min(BATCH, len(y) - a), len(names)))
        some = np.unique(part.row)
        best, who = index.nearest(part, np.array([place.get(d, -1) for d in ids[a : a + BATCH].tolist()]))
        votes[a + some] = index.votes(best[some], who[some])
    weight = np.where(y == 1, share[1] / n_pos, share[0] / n_neg)
    slope, offset = logistic(votes, y, weight / weight.mean())
    return Model(names, idf, index, slope, offset, None)


def _all_terms(bags: pa.Table) -> tuple[list[bytes], Sparse]:
    """All words of the examples (in byte order) and their counts by example."""
    words, tf = (bags.column(c).combine_chunks() for c in ("words", "tf"))
    size = words.value_lengths().to_numpy(zero_copy_only=False)
    coded = words.flatten().dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    place = np.empty(len(order), np.int32)
    place[order.to_numpy()] = np.arange(len(order))
    term, row = place[coded.indices.to_numpy()], np.repeat(np.arange(len(size), dtype=np.int32), size)
    by = np.lexsort((term, row))
    return coded.dictionary.take(order).to_pylist(), Sparse(row, term[by], tf.flatten().to_numpy()[by].astype(float), (len(size), len(order)))


def _document_frequencies(docs: DataFrame, terms: list[bytes]) -> tuple[int, np.ndarray]:
    """Number of documents and of documents with each term, over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refcounts_only()
        vocabulary = Vocabulary(shared.value)
        df = np.zeros(vocabulary.size + 1, np.int64)
        for batch in batches:
            for _, texts in slices(batch, "text"):
                df[-1] += len(texts)
                for a in range(0, len(texts), BATCH):
                    np.add.at(df, vocabulary.counts(texts[a : a + BATCH]).term, 1)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["term", "n"])

    total = np.zeros(len(terms) + 1, np.int64)
    found = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    shared.destroy()
    total[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return int(total[-1]), total[:-1].astype(float)


def score_rows(docs: DataFrame, shared: Broadcast, names: tuple[str, str] = ("score", "evidence")) -> DataFrame:
    """All columns of ``docs(text, ...)`` plus score and evidence under ``names``, by the broadcast model."""
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("similarity", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refcounts_only()
        for batch in batches:
            for part, texts in slices(batch, "text"):
                score, evidence = shared.value.score(texts)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score), pa.array(evidence, kind)], names=[*part.schema.names, *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields),
                        f"`{names[0]}` double, `{names[1]}` array<struct<doc_id: bigint, toxic: int, similarity: double>>"])
    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence per row of ``docs(doc_id, text, ...)``.

    Null and empty texts, and texts without any vocabulary term, get the
    calibrated share of label 1 among such examples. Without labels of both
    kinds every score is 0 (or 1 if only label 1 occurs). Repeated rows are
    scored each; a null doc_id is held out. Other columns are not read.
    """
    scored = score_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), docs.sparkSession.sparkContext.broadcast(fit(docs, labels, per_class)))
    return scored.select("doc_id", F.coalesce(~in_training(F.col("doc_id")), F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def reject_toxic(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """The rows of ``docs`` (all columns) whose score is below 0.5, by the same model."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, per_class))
    scored = score_rows(docs.withColumnsRenamed({c: f"own_{c}" for c in docs.columns if c != "text"}), shared)
    return scored.where(~(F.col("score") >= 0.5)).select(*(F.col(c if c == "text" else f"own_{c}").alias(c) for c in docs.columns))

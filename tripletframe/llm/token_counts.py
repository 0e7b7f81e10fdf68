"""Token counts of a unigram vocabulary without building the tokens.

An Aho-Corasick automaton enumerates the vocabulary pieces that end at each
character; dynamic programming carries the best score and, along the same path,
the number of pieces. The rules are the tokenizer's: pieces are tried by
start, from left to right, and a later start replaces the best only with a
strictly higher score (so of equal scores the longest last piece wins); a
character that no one-character piece covers may be an unknown, 10 below the lowest score;
neighbouring unknowns are one piece, or their bytes where the vocabulary has byte
pieces. Words (runs of anything but ASCII white space, with the word mark in
front) are independent, so a word is counted once per worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripletframe.llm.common import refcounts_only, slices, small_batches

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_WORDS = 500_000


class Unigram:
    """Vocabulary as (piece, score) in id order; ``unknown`` is an id, byte pieces look like <0x41>."""

    def __init__(self, vocabulary: list[tuple[str, float]], unknown: int = 0):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.low = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        pieces = {p for p, _ in vocabulary}
        self.bytes = {f"<0x{b:02X}>" for b in range(256)} <= pieces
        self.pieces = pieces
        self.cache: dict[bytes, int] = {}

    def count(self, text: str) -> int:
        """Pieces of one marked word."""
        n = len(text)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, (size, score) in self.automaton.iter(text):
            ends[end].append((end - size + 1, score))
        # best[i]: score, pieces before a trailing unknown run, characters of that run start (or -1)
        best: list[tuple[float, int, int]] = [(0.0, 0, -1)]
        low = self.low
        for e in range(n):
            matches = ends[e]
            if not any(s == e for s, _ in matches):
                matches.append((e, low))
                unknown = True
            else:
                unknown = False
            top = None
            for s, score in sorted(matches):
                total = best[s][0] + score
                if top is None or total > top[0]:
                    top = (total, s, unknown and s == e and score == low)
            total, s, is_unknown = top
            _, pieces, run = best[s]
            if is_unknown:
                best.append((total, pieces, run if run >= 0 else s))
            else:
                best.append((total, pieces + self._closed(text, run, s) + 1, -1))
        _, pieces, run = best[n]
        return pieces + self._closed(text, run, n)

    def _closed(self, text: str, run: int, end: int) -> int:
        """Pieces of the unknown run text[run:end]."""
        if run < 0:
            return 0
        return len(text[run:end].encode()) if self.bytes and text[run:end] not in self.pieces else 1

    def counts(self, texts: list[bytes]) -> list[int]:
        words = [t.split() for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        for w in set().union(*words).difference(self.cache):
            self.cache[w] = self.count(MARK + w.decode("utf-8", "replace").replace(" ", MARK))
        get = self.cache.__getitem__
        return [sum(map(get, w)) for w in words]


def piece_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a public sentencepiece file, in id order; control pieces can match no text."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return [("" if p.is_control(i) or p.is_unknown(i) else p.id_to_piece(i), p.get_score(i)) for i in range(p.get_piece_size())]


_LOADED: dict[str, Unigram] = {}


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens of every row's whole text; null and empty texts have none; repeated rows are counted each."""
    small_batches(docs.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _LOADED:
            _LOADED[path] = Unigram(piece_vocabulary(path))
        model = _LOADED[path]
        refcounts_only()
        for batch in batches:
            for part, texts in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.counts(texts), pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long")

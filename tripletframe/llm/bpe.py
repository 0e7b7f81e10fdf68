"""Byte-pair encoding and decoding, exact to the public tokenizer file, without its library.

White-space-separated chunks of a text are independent of each other: no
pre-token, no composition and no special token crosses ASCII white space. So
only chunks that the worker does not remember are encoded, many at once: the
symbols of all their pre-tokens lie in one flat array, and each merge round
looks every new neighbouring pair up by binary search in the sorted pair keys,
takes the lowest rank of each pre-token and merges its occurrences left to right.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripletframe.llm.common import SLICE_BYTES, kept, refcounts_only, slices, small_batches, starts_of, texts_of

#: Bytes of one generation of remembered chunks and of remembered pre-tokens (two of each at most), and of an entry besides its strings.
CACHE_BYTES, ENTRY_BYTES = 48 << 20, 160
NONE = np.iinfo(np.int32).max


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Memory(dict):
    """Ids of strings in two generations: when the new one is full it becomes the old one, whose entries come back when asked for."""

    def __init__(self, limit: int | None = None):
        self.limit, self.held, self.old = limit or CACHE_BYTES, 0, {}

    def unknown(self, asked: set) -> list:
        """The strings of ``asked`` without an entry; make room first, so that all of them can be read afterwards."""
        if self.held > self.limit:
            self.old, self.held = dict(self), 0
            self.clear()
        new, old = [c for c in asked if c not in self], self.old  # set operations with a dict would walk through all its entries
        back = {c: old[c] for c in new if c in old}
        self.learn(back)
        return [c for c in new if c not in back]

    def learn(self, entries: dict) -> None:
        self.update(entries)
        self.held += sum(map(len, entries)) + sum(map(len, entries.values())) + ENTRY_BYTES * len(entries)


class Bpe:
    """Encoder and decoder of a ``word_bpe`` file (lower case, byte-level, word ends)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        end = spec["model"]["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.tokens = [tokens.get(i, "").encode() for i in range(max(tokens) + 1)]
        symbols = byte_symbols()
        self.inner = np.array([vocab[c] for c in symbols], np.int32)
        self.last = np.array([vocab[c + end] for c in symbols], np.int32)
        pairs = [p.split(" ") if isinstance(p, str) else p for p in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)  # by rank
        split = next((t for t in spec["pre_tokenizer"].get("pretokenizers", []) if t["type"] == "Split"), None)
        self.words = regex.compile(split["pattern"]["Regex"]) if split else None
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.chunks, self.plain = Memory(), Memory()  # ids of chunks (bytes) and of pre-tokens (text)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of neighbours, NONE for pairs that don't merge."""
        key = left.astype(np.int64) << 32 | right
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[found] == key, self.ranks[found], NONE)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Token ids (little-endian unsigned 32-bit) of pre-tokens given as UTF-8 bytes, by batched merge rounds."""
        if not words:
            return []
        size = np.fromiter(map(len, words), np.int64, len(words))
        raw, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - 1
        sym = self.inner[raw]
        sym[ends] = self.last[raw[ends]]
        rank = self.pair_ranks(sym, np.append(sym[1:], 0))  # of the pair that begins at each symbol
        rank[ends] = NONE
        live = np.arange(len(words))
        done_sym, done_word = [], []
        while True:
            best = np.minimum.reduceat(rank, starts_of(size)[:-1])
            going = best != NONE
            if not going.all():
                stay = np.repeat(going, size)
                done_sym.append(sym[~stay])
                done_word.append(np.repeat(live[~going], size[~going]))
                sym, rank, live, size, best = sym[stay], rank[stay], live[going], size[going], best[going]
            if not len(live):
                break
            at = np.flatnonzero(rank == np.repeat(best, size))
            touch = np.append(False, at[1:] == at[:-1] + 1)
            if touch.any():  # overlapping occurrences (equal symbols in a row): every second one, from the left
                i = np.arange(len(at))
                at = at[(i - np.maximum.accumulate(np.where(touch, 0, i))) % 2 == 0]
            sym[at] = self.merged[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            size = np.add.reduceat(keep, starts_of(size)[:-1], dtype=np.int64)
            sym, rank = sym[keep], rank[keep]
            at -= np.arange(len(at))  # where the merged symbols are now
            near = np.concatenate([at, np.maximum(at - 1, 0)])  # pairs with a merged symbol
            rank[near] = self.pair_ranks(sym[near], sym[np.minimum(near + 1, len(sym) - 1)])
            rank[np.cumsum(size) - 1] = NONE
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        flat = sym[np.argsort(word, kind="stable")].astype("<u4").tobytes()
        cut = (4 * starts_of(np.bincount(word, minlength=len(words)))).tolist()
        return [flat[a:b] for a, b in zip(cut, cut[1:])]

    def pre_tokens(self, chunks: list[bytes]) -> list[list[str]]:
        """Pre-tokens of white-space-free chunks; they are normalised all at once, a line each."""
        text = unicodedata.normalize("NFC", b"\n".join(chunks).decode("utf-8", "replace")).replace("Σ", "σ").lower()  # lower case has no context
        find = self.words.findall
        return [[t] if t.isalpha() else find(t) for t in text.split("\n")]

    def encode_parts(self, parts: list[list[str]]) -> list[bytes]:
        """Ids of every list of pre-tokens; only pre-tokens not remembered are merged, each once."""
        ids = self.plain
        new = ids.unknown(set(chain.from_iterable(parts)))
        ids.learn(dict(zip(new, self.merge([w.encode() for w in new]))))
        return [ids[p[0]] if len(p) == 1 else b"".join([ids[w] for w in p]) for p in parts]

    def learn(self, chunks: list[bytes]) -> None:
        """Encode new chunks and remember them."""
        odd = [c for c in chunks if b"<|" in c and self.split_special]
        if odd:
            chunks = [c for c in chunks if b"<|" not in c]
        if chunks:
            self.chunks.learn(dict(zip(chunks, self.encode_parts(self.pre_tokens(chunks)))))
        for c in odd:  # may hold strings of special tokens
            pieces = [p for p in self.split_special.split(c.decode("utf-8", "replace")) if p]
            own = b"".join(np.uint32(self.special[p]).astype("<u4").tobytes() if p in self.special else self.encode_parts(self.pre_tokens([p.encode()]))[0] for p in pieces)
            self.chunks.learn({c: own})

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if not texts:
            return []
        ends = starts_of(list(map(len, texts)))
        column = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends.tobytes()), pa.py_buffer(b"".join(texts)))
        words = pc.ascii_split_whitespace(column)  # an empty chunk before or behind a text that begins or ends with white space
        code = words.flatten().dictionary_encode()
        distinct = texts_of(code.dictionary)
        new = self.chunks.unknown({c for c in distinct if c})
        if new:
            self.learn(new)
        get = self.chunks.__getitem__
        runs = [get(c) if c else b"" for c in distinct]
        size = np.fromiter(map(len, runs), np.int64, len(runs)) // 4
        place = code.indices.to_numpy(zero_copy_only=False)
        own = size[place]
        to = starts_of(own)
        ids = np.frombuffer(b"".join(runs), "<u4")[np.repeat(starts_of(size)[place] - to[:-1], own) + np.arange(to[-1])].tobytes()
        cut = (4 * to[words.offsets.to_numpy()]).tolist()
        return [ids[a:b] for a, b in zip(cut, cut[1:])]

    def decode(self, ids: bytes) -> bytes:
        """Text of ids: the tokens joined by spaces (the file names no decoder)."""
        return b" ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def load(path: str) -> Bpe:
    """The encoder of ``path``, kept by the worker."""
    return kept(path, lambda: Bpe(path))


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` key columns plus ``ids`` (binary, little-endian unsigned 32-bit) and no text.

    Null and empty texts get empty ids. Rows are neither dropped nor merged;
    the whole text is encoded; strings of special tokens become their ids.
    """
    small_batches(docs.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refcounts_only(keep=path)
        bpe = load(path)
        for batch in batches:
            for part, texts in slices(batch, text, SLICE_BYTES):
                keys = part.drop_columns([text])
                yield pa.RecordBatch.from_arrays([*keys.columns, pa.array(bpe.encode(texts), pa.binary())], names=[*keys.schema.names, "ids"])

    keys = [f for f in docs.schema.fields if f.name != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keys), "ids binary"])
    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded`` (string) to a table with ``ids``; null ids decode to the empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                text = pa.array([bpe.decode(i or b"") for i in part.column("ids").to_pylist()], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, text], names=[*part.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{fields}, decoded string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> doc_id, ids, decoded."""
    return decode(encode(docs.select("doc_id", F.col("text")), path), path)

"""Merkle manifest, ranked lexical search and line dedup against brute force on edge rows, with small tiles, runs and shards."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripletframe.llm.lexical_search import EXACT, TopK, lexical_search, terms, tile_scores
from tripletframe.llm.line_dedup import Shard, line_dedup
from tripletframe.llm.merkle import ENTRY, merkle_manifest, tampered_manifest

LINE = "This Line is long enough to be counted as Ä line"
LONG = "\n".join(f"line number {i % 3000} of a very long text that goes on" for i in range(40_000))
DOCS = [
    (1, None, "en", "s", 3), (2, "", "en", None, None), (3, f"  {LINE}\t\nshort\n{LINE.upper()}", "en", "s", 7), (4, f"{LINE.lower()}\n\n", "de", "s", 2 ** 63 - 1),
    (4, f"{LINE.lower()}\n\n", "de", "s", 2 ** 63 - 1), (5, f"x\n{LINE}\ny", None, "s", 5), (6, f"{LINE}\r\n{LINE}", None, "s", 5), (None, LINE, "en", "s", 5), (None, LINE, "en", "s", 5),
    (7, LONG, "", "s", 5), (8, LONG + "\n" + LINE, "zz", "s", 5), (9, "Ü" * 39, "zz", "s", 5), (10, "Ü" * 39, "é", "s", 5), (2 ** 63 - 1, LINE + "\nlast", "en", "s", 1),
    (11, "don't stop; STOP 中文 12³ naïve\x85x", "en", "s", 1), (12, "!!! ...", "en", "s", 1),
] + [(100 + i, f"number {i} of the lines\n" + "Ω" * 40, "hot", "s", i) for i in range(37)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, slice long, tree long, id long, leaf string, own_lang string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, 1, 1, 1, "x", "y") for r in DOCS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# Merkle manifest

def field(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def path(levels, pos):
    out = []
    for level in levels[:-1]:
        out.append(("L" if pos & 1 else "R", level[pos ^ 1]) if pos ^ 1 < len(level) else ("-", ""))
        pos >>= 1
    return out


def brute_manifest(rows):
    langs = defaultdict(list)
    for i, text, lang, source, n in rows:
        leaf = lambda m: sha(*map(field, (i, source, lang, m, text)))  # noqa: E731, B023
        hit = i is not None and n is not None and zlib.crc32(str(i).encode()) % 7 == 0
        langs[lang].append((i is None, i or 0, leaf(n), i, leaf(n + 1) if hit else leaf(n)))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {k: tree([x[2] for x in sorted(langs[k], key=lambda x: x[:3])]) for k in order}
    over = tree([trees[k][-1][0] for k in order])
    out = Counter()
    for g, k in enumerate(order):
        for p, (_, _, leaf, i, other) in enumerate(sorted(langs[k], key=lambda x: x[:3])):
            way = path(trees[k], p) + path(over, g)
            folded = other
            for side, d in way:
                folded = sha(d, folded) if side == "L" else sha(folded, d)
            root = over[-1][0]
            out[(i, leaf, trees[k][-1][0], root, sha(*(d for _, d in way)), folded, folded == root)] += 1
    return out


@pytest.mark.parametrize(("bits", "fan_bits"), [(10, 16), (1, 1), (2, 3)])
def test_manifest_edge_rows(docs, bits, fan_bits):
    got = tampered_manifest(docs, bits=bits, fan_bits=fan_bits)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(map(tuple, got.collect())) == brute_manifest(DOCS)


def test_manifest_of_one_row_of_one_group_and_of_none(spark, docs, none):
    assert tampered_manifest(none).count() == 0
    one = tampered_manifest(docs.where("doc_id = 7")).collect()
    assert len(one) == 1 and one[0].leaf == one[0].subroot == one[0].root and one[0].proof_sha256 == sha("")
    hot = [r for r in DOCS if r[2] == "hot"]
    assert Counter(map(tuple, tampered_manifest(docs.where("lang = 'hot'"), bits=2).collect())) == brute_manifest(hot)


def test_proof_has_one_entry_a_level(docs):
    rows = docs.select("lang", "doc_id", F.sha2(F.col("doc_id").cast("string").cast("binary"), 256).alias("leaf")).where("doc_id is not null")
    got = merkle_manifest(rows.where("lang = 'hot'")).collect()
    assert {len(r.proof) for r in got} == {6 * ENTRY} and len({bytes(r.proof) for r in got}) == 37  # 37 leaves: 6 levels, one group
    assert all(bytes(r.proof[i * ENTRY : i * ENTRY + 1]) in (b"L", b"R", b"-") for r in got for i in range(6))


# ranked lexical search

def brute_search(items, rows, k):
    cut = lambda t: [w for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))]
    held = [(i, Counter(cut(t))) for i, t in rows]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(w for _, c, _ in held for w in c)
    out = Counter()
    for item, text in items:
        asked = set(cut(text))
        scores = []
        for i, c, n in held:
            m = 50 + (50 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10 ** 9 * c[w]) // (1000 * c[w] + 20 * m)) for w in asked if w in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out.update((item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k], 1))
    return out


ITEMS = [(1, "stop the LINE"), (2, None), (3, ""), (4, "中文 naïve ω zzz"), (4, "number of lines"), (None, "long text that goes on"), (5, "absent"), (6, "Stop STOP stop"),
         (7, " ".join(f"number {i}" for i in range(50))), (8, LONG)]


@pytest.mark.parametrize(("k", "block", "doc_tile", "item_tile", "term_tile"), [(50, 4 << 20, 2048, 256, 8192), (3, 4 << 20, 5, 2, 3), (2, 1 << 20, 7, 1, 8192)])
def test_search_edge_rows(spark, docs, monkeypatch, k, block, doc_tile, item_tile, term_tile):
    for name, v in (("DOC_TILE", doc_tile), ("ITEM_TILE", item_tile), ("TERM_TILE", term_tile)):
        monkeypatch.setattr(f"tripletframe.llm.lexical_search.{name}", v)
    items = spark.createDataFrame([(*r, 1) for r in ITEMS], "item_id long, text string, score int")
    got = lexical_search(items, docs, k=k, block_bytes=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == brute_search(ITEMS, [r[:2] for r in DOCS], k)


def test_search_of_empty_tables(spark, docs, none):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical_search(items, none).count() == 0
    assert lexical_search(items.where("false"), docs).count() == 0
    assert lexical_search(items.where("item_id = 3"), docs).count() == 0


def test_terms_are_cut_on_bytes_as_on_characters():
    text = "".join(map(chr, range(1, 0x250))) + " ΣΑΣ  　中 A_b-C9"
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    assert [t.decode() for t in terms(text.encode())] == re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def test_partial_sums_stay_exact_beyond_two_to_the_53():
    rng = np.random.default_rng(1)
    weight, impact = rng.integers(1 << 29, 1 << 30, (3, 200)), rng.integers(900_000, 1_000_000, (200, 4))
    exact = [[sum(int(a) * int(b) for a, b in zip(w, col)) for col in impact.T] for w in weight]
    assert max(map(max, exact)) > EXACT
    assert tile_scores(weight.astype(float), impact.astype(float), (1 << 30) * 1_000_000).tolist() == exact


def test_top_k_keeps_ties_by_id():
    best = TopK(1, 3)
    for a in range(0, 12, 4):
        best.add(0, np.array([[5, 7, 5, 0]]), np.array([12 - a, 11 - a, 10 - a, 9 - a]), np.array([False, False, False, False]))
    assert list(zip(best.rows[1], best.rows[2])) == [(7, 3), (7, 7), (7, 11)]
    best.add(0, np.array([[7, 7]]), np.array([1, 0]), np.array([False, True]))
    assert list(zip(best.rows[1], best.rows[2])) == [(7, 1), (7, 3), (7, 7)]


# line dedup

def brute_lines(rows, min_chars, min_docs):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holders = defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                holders[k].append(i)
    out = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        tops = [max((h for h in holders[key(x)] if h is not None), default=i) if len(holders.get(key(x), [])) >= min_docs else i for x in lines]
        kept = [x for x, top in zip(lines, tops) if top == i]
        out[(i, len(lines), len(lines) - len(kept), "\n".join(kept))] += 1
    return out


@pytest.mark.parametrize(("min_docs", "sizes"), [(5, {}), (5, {"shard_keys": 4, "probe_bytes": 64, "task_bytes": 1000}), (2, {"shard_keys": 100}), (1, {})])
def test_lines_edge_rows(docs, min_docs, sizes):
    got = line_dedup(docs, min_docs=min_docs, **sizes)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_text"]
    assert Counter(map(tuple, got.collect())) == brute_lines([r[:2] for r in DOCS], 40, min_docs)


def test_lines_of_rows_without_ids_and_of_an_empty_table(spark, none):
    rows = [(None, LINE)] * 6
    got = line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == brute_lines(rows, 40, 5) and all(r.n_dropped == 0 for r in got)
    assert line_dedup(none).count() == 0


def test_lines_extra_columns(docs):
    got = line_dedup(docs, extra=["slice", "lang", "own_lang"])
    assert got.columns[4:] == ["slice", "lang", "own_lang"]
    assert Counter((r.doc_id, r.lang) for r in got.collect()) == Counter((r[0], r[2]) for r in DOCS)


def test_perfect_hash_is_minimal_and_rejects_strangers():
    rng = np.random.default_rng(3)
    hi, lo = (rng.integers(0, 1 << 64, 20_000, dtype=np.uint64) for _ in range(2))
    hi[:50] = hi[0]  # equal halves, told apart by the other
    shard = Shard.load(Shard.build(hi, lo, np.arange(20_000), np.arange(20_000) * 3, np.arange(20_000) % 2 == 0).dump())
    place = shard.find(hi, lo)
    assert sorted(place.tolist()) == list(range(20_000))
    assert (shard.counts[place] == np.arange(20_000)).all() and (shard.known[place] == (np.arange(20_000) % 2 == 0)).all()
    assert (shard.find(hi + np.uint64(1), lo + np.uint64(7)) == -1).all()

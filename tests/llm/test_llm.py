"""Training-data operators against brute force, library tokenizers and DuckDB, on edge rows and the smallest tables."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer, models
from pyspark.sql import functions as F

import corpus_pipeline
from tools.oracle_check import rows_of
from tripletframe.llm import bpe, lm, packing, queries as Q, simhash, topk, toxicity, warc
from tripletframe.llm.common import components, table
from tripletframe.llm.exact_dedup import build_directory, exact_dedup
from tripletframe.llm.lm import Attention, windows
from tripletframe.llm.simhash import simhash_dedup
from tripletframe.llm.substring_dedup import substring_dedup
from tripletframe.llm.token_counts import Unigram, piece_vocabulary, token_counts

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, key string, score double, entry int"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
PASSAGE = " ".join(f"p{i}" for i in range(30))
EDGE = [
    (1, None), (2, ""), (3, " \n\t "), (4, "One"), (5, "one two three four five"), (6, "one two three four five"),
    (6, "one two three four five"), (7, LONG), (8, LONG + " tail"), (9, "a b " + PASSAGE + " c"), (10, "x " + PASSAGE), (11, PASSAGE + " " + PASSAGE),
    (None, "one two three four five"), (None, None), (12, "Ünïcode ΣΑΣ ß İ don't 12³ ½ ﬁ <|endoftext|>x 中文テキスト é  nb sp \x85nel \U0001f600\x1c."), (13, "!!! ... ???"),
    (14, "z" * 5000), (15, "aaaa aaaaaaa abababab"), (16, "idiot " * 3),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, "k", 0.5, 1) for i, t in EDGE], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def small_docs():
    return duckdb.sql(f"select doc_id, text from '{SMALL}/documents.parquet'").fetchall()


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


# exact dedup

def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = Counter()
    for t, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        left = 1
        for i in ids:
            kept = i == top and left
            left -= bool(kept)
            out[(i, top, len(ids), bool(kept), sha(t.encode()))] += 1
    return out


@pytest.mark.parametrize("bucket_bytes", [4 << 20, 64])
def test_exact_dedup_edge_rows(edge, bucket_bytes):
    got = exact_dedup(edge, bucket_bytes=bucket_bytes).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert Counter(map(tuple, got)) == brute_exact(EDGE)


def test_exact_dedup_extra_columns_and_empty(edge, none):
    kept = exact_dedup(edge, extra=edge.columns).where("kept")
    assert {"key", "score", "entry", "text"} <= set(kept.columns)
    assert sorted(r.text for r in kept.collect()) == sorted({t or "" for _, t in EDGE})
    assert exact_dedup(none).count() == 0


def test_chain_separates_equal_keys_of_different_texts():
    import pyarrow as pa
    from tripletframe.llm.exact_dedup import _chain

    batch = pa.RecordBatch.from_pydict({"bucket": [0] * 4, "key": [7] * 4, "entry": [1, 2, 3, 4], "n": [1, 2, 1, 1], "top_id": [5, 9, 6, None], "text": ["a", "b", "a", "b"]})
    rows = {r["entry"]: (r["keep_id"], r["group_size"], r["keeper"]) for b in _chain(iter([batch])) for r in b.to_pylist()}
    assert rows == {1: (6, 2, 3), 3: (6, 2, 3), 2: (9, 3, 2), 4: (9, 3, 2)}


def test_directory_splits_only_overfull_buckets():
    buckets, deeper = build_directory({0: (5, 50), 1: (1, 500), 2: (1, 10), 3: (9, 400)}, capacity=100, depth=2)
    assert buckets == [(0, 2), (1, 2), (2, 2), (3, 2)] and deeper == [3]
    assert build_directory({}, 10, 4) == ([(0, 0)], [])


# substring dedup

def brute_substring(rows, width):
    order = lambda i: (i is None, i or 0)
    first = {}
    words = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in sorted(words, key=lambda x: order(x[0])):
        for k in range(len(w) - width + 1):
            first.setdefault(tuple(w[k : k + width]), order(i))
    out = Counter()
    for i, w in words:
        gone = bytearray(len(w))
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < order(i):
                gone[k : k + width] = b"\1" * width
        out[(i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())] += 1
    return out


@pytest.mark.parametrize("width,slice_bytes,shard_bytes", [(13, 4 << 20, 6 << 20), (13, 200, 300), (3, 500, 100)])
def test_substring_dedup_edge_rows(edge, width, slice_bytes, shard_bytes):
    got = substring_dedup(edge, width, slice_bytes=slice_bytes, shard_bytes=shard_bytes).collect()
    assert Counter(map(tuple, got)) == brute_substring(EDGE, width)


def test_substring_dedup_small_table_extra_and_empty(spark, none):
    docs = table(spark, SMALL, "documents")
    got = substring_dedup(docs, extra=["source"], slice_bytes=20_000, shard_bytes=40_000)
    assert Counter(tuple(r)[:4] for r in got.collect()) == brute_substring(small_docs(), 13)
    assert "source" in got.columns
    assert substring_dedup(none).count() == 0


# BPE

def test_bpe_matches_the_library(spark, edge, none):
    library = Tokenizer.from_file(Q.WORD_BPE)
    rows = [(i, t) for i, t in EDGE] + small_docs()
    got = Counter((r.doc_id, bytes(r.ids), r.decoded) for r in bpe.round_trip(spark.createDataFrame(rows, "doc_id long, text string"), Q.WORD_BPE).collect())
    want = Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[(i, np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False))] += 1
    assert got == want
    assert bpe.round_trip(none, Q.WORD_BPE).count() == 0


def test_byte_ids_match_the_library():
    library, own = Tokenizer.from_file(Q.BYTE_BPE), lm.WordIds(Q.BYTE_BPE)
    words = [w for _, t in small_docs()[:20] for w in t.encode().lower().split()]
    distinct = sorted(set(words))
    ids, n = own.coded(distinct)
    place, size = lm.tokens_of([words, []], [*distinct, lm.END])
    flat, n = lm.gather(np.append(ids, own.end), np.append(n, 1), place)
    want = [library.encode(" " + w.decode(), add_special_tokens=False).ids for w in words]
    assert flat.tolist() == [k for w in want for k in w] + [own.end] * 2
    assert n.tolist() == [*map(len, want), 1, 1] and size.tolist() == [len(words) + 1, 1]


# language model

def test_windows_score_every_id_once():
    sizes = np.array([1, 2, 24, 25, 100, 3])
    flat = np.arange(sizes.sum())
    x, target, fresh = windows(flat, sizes)
    assert sorted(target[fresh].tolist()) == flat.tolist()
    b, i = np.nonzero(fresh & (target > 0))
    starts = set(np.cumsum(sizes)[:-1].tolist())
    assert all(x[r, c] == target[r, c] - 1 for r, c in zip(b, i) if target[r, c] not in starts)


def test_later_windows_give_eight_ids_of_context():
    flat, sizes = np.arange(300) % 50, np.array([100, 200])
    x, target, fresh = windows(flat, sizes)
    later = np.isin(target[:, 0], (0, 100), invert=True)
    assert x.shape[1] == 32 and later.any() and not fresh[later, :8].any()  # a scored id follows its window's 8 ids of context at least
    assert sorted(target[fresh]) == list(range(300))


def test_attention_is_causal_normalised_and_learns():
    rng = np.random.default_rng(0)
    classes = rng.integers(0, lm.CLASSES, 200)
    model = Attention(classes, lm.class_shares(classes, np.ones(200)))
    x = rng.integers(0, 200, (2, lm.WINDOW))
    y = x.copy()
    y[:, 10:] = rng.integers(0, 200, (2, lm.WINDOW - 10))
    assert np.allclose(model.forward(x)[:, :10], model.forward(y)[:, :10], atol=1e-5)
    assert np.allclose(np.exp(model.forward(x)).sum(axis=2), 1, atol=1e-4)
    per_class = np.bincount(classes, np.exp(model.share), lm.CLASSES)
    assert np.allclose(per_class[np.unique(classes)], 1)
    eps, name = 1e-3, "V"  # gradient against finite differences
    goal, weight = classes[x], np.ones(x.shape, np.float32)
    _, grad = model.step(x, goal, weight)
    model.p[name][1, 2] += eps
    up = model.step(x, goal, weight)[0]
    model.p[name][1, 2] -= 2 * eps
    down = model.step(x, goal, weight)[0]
    model.p[name][1, 2] += eps
    assert abs((up - down) / (2 * eps) - grad[name][1, 2]) < 2e-2 * max(1, abs(grad[name][1, 2]))
    flat, sizes = np.tile(np.arange(50), 40), np.full(40, 50)
    x, t, f = windows(flat, sizes)
    losses = model.train(x, classes[flat[t]], f.astype(np.float32), epochs=100)
    assert losses[-1] < 0.5 * losses[0]
    log = model.forward(x)
    b, i = np.nonzero(f)
    want = np.zeros(len(flat))
    want[t[b, i]] = log[b, i, classes[flat[t[b, i]]]] + model.share[flat[t[b, i]]]
    assert np.allclose(model.score(flat, sizes), want, atol=1e-4)


def plain_gradients(model, x, y, weight):
    """Loss and gradients of all parameters in float64, window by window and position by position."""
    p = {k: v.astype(np.float64) for k, v in model.p.items()}
    g, loss = {k: np.zeros_like(v) for k, v in p.items()}, 0.0
    for row, goal, part in zip(x, y, weight / weight.sum()):
        e = p["E"][row]
        q, k, v = (e @ p[n] for n in "QKV")
        de, dq, dk, dv = (np.zeros_like(e) for _ in range(4))
        for i in np.flatnonzero(part):
            a = q[i] @ k[: i + 1].T * lm.WIDTH**-0.5 + p["R"][i - np.arange(i + 1)]
            a = np.exp(a - a.max())
            a /= a.sum()
            h = e[i] + a @ v[: i + 1]
            z = h @ p["C"] + p["b"]
            z = np.exp(z - z.max())
            z /= z.sum()
            loss -= part[i] * np.log(z[goal[i]])
            z[goal[i]] -= 1
            z *= part[i]
            dh = p["C"] @ z
            g["C"] += np.outer(h, z)
            g["b"] += z
            ds = a * (v[: i + 1] @ dh - a @ (v[: i + 1] @ dh))
            np.add.at(g["R"], i - np.arange(i + 1), ds)
            de[i] += dh
            dv[: i + 1] += np.outer(a, dh)
            dq[i] += ds @ k[: i + 1] * lm.WIDTH**-0.5
            dk[: i + 1] += np.outer(ds, q[i]) * lm.WIDTH**-0.5
        for n, d in zip("QKV", (dq, dk, dv)):
            g[n] += e.T @ d
            de += d @ p[n].T
        np.add.at(g["E"], row, de)
    return loss, g


@pytest.mark.parametrize("size", [1, 3.5])  # with large parameters exponents are not bounded by the norms
def test_step_works_out_scored_positions_alone_and_all_gradients(size):
    rng = np.random.default_rng(4)
    classes = rng.integers(0, lm.CLASSES, 90)
    model = Attention(classes, lm.class_shares(classes, np.ones(90)))
    model.p["R"][:] = rng.standard_normal(lm.WINDOW)
    model.p["b"][:] = rng.standard_normal(lm.CLASSES)
    for k in "EQKCC":
        model.p[k] *= size
    x = rng.integers(0, 60, (5, lm.WINDOW))
    weight = (rng.random(x.shape) < 0.6).astype(np.float32)
    y = np.where(weight > 0, classes[rng.integers(0, 90, x.shape)], 10**6)  # no class where nothing is scored
    loss, grad = model.step(x, y, weight)
    want, plain = plain_gradients(model, x, y, weight)
    ids, rows = grad.pop("E")
    assert (ids == np.unique(x)).all() and np.allclose(rows, plain["E"][ids], rtol=2e-3, atol=2e-4 * abs(plain["E"]).max())
    assert abs(loss - want) < 1e-4 * max(1, abs(want))
    assert all(np.allclose(grad[k], plain[k], rtol=2e-3, atol=2e-4 * abs(plain[k]).max()) for k in grad)


def brute_base(rows):
    count = Counter()
    for i, t in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            count.update((t or "").encode().lower().split())
            count[None] += 1
    n, v = sum(count.values()), len(count)
    out = []
    for i, t in rows:
        w = [*(t or "").encode().lower().split(), None]
        out.append((i, i is None or zlib.crc32(str(i).encode()) % 10 == 0, len(w), sum(x in count for x in w), n, round(sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 4)))
    return Counter(out)


def test_lm_scores(spark, edge, none):
    got = lm.lm_scores(edge, Q.BYTE_BPE, slice_bytes=500, shard_bytes=300).collect()
    assert Counter((*tuple(r)[:5], round(r.base_score, 4)) for r in got) == brute_base(EDGE)
    rows = lm.lm_scores(table(spark, SMALL, "documents"), Q.BYTE_BPE).collect()
    assert Counter((*tuple(r)[:5], round(r.base_score, 4)) for r in rows) == brute_base(small_docs())
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm.lm_scores(none, Q.BYTE_BPE).count() == 0


def test_attention_learns_from_every_training_document(spark, monkeypatch):
    docs = [(i, "red green blue " * 6) for i in range(3000)] + [(i, "quartz violin harbor " * 6) for i in range(3000, 3010)]
    learned = [(i, t) for i, t in docs if zlib.crc32(str(i).encode()) % 10]
    made, train = [], lm.train

    def keep(coded, n_slices, id_counts):
        flat = np.concatenate([np.frombuffer(r.ids, np.uint16) for r in coded.collect()])
        made.append((flat, id_counts, *train(coded, n_slices, id_counts)))
        return made[-1][2:]

    monkeypatch.setattr(lm, "train", keep)
    rows = lm.lm_scores(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), Q.BYTE_BPE, slice_bytes=10_000).collect()
    flat, id_counts, model, losses = made[0]
    assert (np.bincount(flat, minlength=len(id_counts)) == id_counts).all()  # every id of every training document
    codec = lm.WordIds(Q.BYTE_BPE)
    rare, _ = codec.coded([b"quartz", b"violin", b"harbor"])
    start = Attention(model.classes, model.share).p["E"]
    assert any(i >= 3000 for i, _ in learned) and (model.p["E"][rare] != start[rare]).any(axis=1).all()
    assert (model.classes[rare] < lm.CLASSES - 1).all() and losses[1] < losses[0]
    assert len(rows) == len(docs)


def test_epoch_of_one_slice_is_local_adam_and_slices_average(spark):
    rng = np.random.default_rng(3)
    runs = [rng.integers(0, 40, 200) for _ in range(20)]
    counts = np.bincount(np.concatenate(runs), minlength=300).astype(float)
    frame = spark.createDataFrame([(k, r.astype(np.uint16).tobytes(), np.array([len(r)]).tobytes()) for k, r in enumerate(runs)], "slice long, ids binary, sizes binary")
    column = np.full(300, -1)
    column[np.argsort(-counts, kind="stable")[: lm.COMMON]] = np.arange(lm.COMMON)
    co = lm.all_neighbours(frame, 20, column)
    want = np.zeros_like(co)
    for r in runs:
        for a, b in zip(r, r[1:]):
            want[a, column[b]] += 1
            want[b, lm.COMMON + column[a]] += 1
    assert (co == want).all()
    model, _ = lm.train(frame, 20, counts)
    own = Attention(model.classes, model.share)
    for epoch in range(lm.EPOCHS):
        new = []
        for r in runs:
            part = Attention(model.classes, model.share)
            part.p = {k: v.copy() for k, v in own.p.items()}
            x, t, f = windows(r, np.array([len(r)]))
            part.train(x, part.classes[r[t]], f.astype(np.float32), only=epoch)
            new.append(part.p)
        share = np.array([np.bincount(r, minlength=300) for r in runs]) / np.maximum(counts, 1)
        own.p = {k: v + (sum(s[:, None] * (n[k] - v) for s, n in zip(share, new)) if k == "E" else np.mean([n[k] - v for n in new], axis=0)) for k, v in own.p.items()}
    assert all(np.allclose(own.p[k], model.p[k], atol=1e-4) for k in own.p)


# SimHash

def brute_prints(rows, width=4):
    out = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        runs = [b" ".join(w[k : k + width]) for k in range(len(w) - width + 1)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
        out.append((i, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))))
    return out


def brute_components(prints, distance=4):
    fps = sorted({f for _, f in prints})
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= distance:
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for i, f in prints:
        least[root(f)].append(i)
    return Counter((i, f"{f:016x}", min((x for x in least[root(f)] if x is not None), default=None)) for i, f in prints)


def test_simhash_edge_rows_and_small_table(spark, edge, none):
    assert Counter(map(tuple, simhash_dedup(edge).collect())) == brute_components(brute_prints(EDGE))
    assert Counter(map(tuple, simhash_dedup(table(spark, SMALL, "documents")).collect())) == brute_components(brute_prints(small_docs()))
    assert simhash_dedup(none).count() == 0


def test_links_miss_no_pair_within_distance(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.int64)
    fps = {int(b) for b in base}
    for b in base.tolist():
        for d in range(1, 7):
            x = b
            for k in rng.choice(64, d, replace=False).tolist():
                x ^= 1 << k
            fps.add(x - (1 << 64) if x >= 1 << 63 else x)
    got = components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), 4)).collect()
    group = {f: f for f in fps} | {r.node: r.root for r in got}
    want = brute_components([(f, f % (1 << 64)) for f in fps])
    of = {i: c for i, _, c in want}
    assert len({(group[f], of[f]) for f in fps}) == len(set(of.values())) == len(set(group.values()))


# token counts

def test_token_counts_match_the_library(spark, edge, none):
    v = [(p or f"\0{i}", s) for i, (p, s) in enumerate(piece_vocabulary(Q.PIECES))]
    library = Tokenizer(models.Unigram(v, 0, True))
    rows = EDGE + small_docs()[:60]
    got = Counter(map(tuple, token_counts(spark.createDataFrame(rows, "doc_id long, text string"), Q.PIECES).collect()))
    assert got == Counter((i, sum(len(library.encode("▁" + w.decode()).ids) for w in (t or "").encode().split())) for i, t in rows)
    assert token_counts(none, Q.PIECES).count() == 0


def test_unigram_ties_and_unknown_runs():
    v = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("aba", -3.0), ("ba", -2.0)]
    own, library = Unigram([("", s) if p == "<unk>" else (p, s) for p, s in v]), Tokenizer(models.Unigram(v, 0, False))
    for text in ("abab", "aba", "xxabyyab", "bbaab", "x", "abxba"):
        assert own.count(text) == len(library.encode(text).ids), text


# revisits

def test_revisits_edges(spark):
    at = lambda s: f"2024-01-01 00:00:{s:02d}"
    rows = [
        (1, "http://A.com:80/x/?b=2&a=1#f", at(1), "response", {"ETag": '"1"', "Content-Length": "9", "date": "d1"}, "p1"),
        (2, "https://www.a.com/x?a=1&b=2&utm_source=q", at(5), "revisit", {"etag": 'W/"1"', "content-length": "0", "Date": "d2"}, None),
        (3, "a.com/x?a=1&b=2", at(3), "response", {"etag": '"3"'}, "p3"),
        (4, "a.com/x?a=1&b=2", at(2), "revisit", {"etag": '"1"'}, None),
        (5, "a.com/x?a=1&b=2", at(1), "revisit", None, None),
        (6, "a.com/x?a=1&b=2", at(9), "revisit", None, None),
        (7, None, at(9), "revisit", {"etag": '"1"'}, None),
        (8, "a.com/x?a=1&b=2", None, "revisit", {}, None),
    ]
    df = spark.createDataFrame(rows, "record_id long, url string, ts string, kind string, headers map<string,string>, payload_sha256 string").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("url_key", F.lit("clash"))
    got = {r.record_id: r for r in warc.resolve_revisits(df, buckets=4).collect()}
    assert {k: (r.refers_to, r.status) for k, r in got.items()} == {2: (3, "mismatch"), 4: (1, "resolved"), 5: (None, "unresolved"), 6: (3, "unchecked"), 7: (None, "unresolved"), 8: (None, "unresolved")}
    assert got[4].headers == {"etag": '"1"', "content-length": "9", "date": "d1"} and got[4].payload_sha256 == "p1"
    assert warc.resolve_revisits(df.limit(0)).count() == 0


def test_revisits_share_ids_repeat_and_spell_headers_twice(spark):
    at = lambda s: f"2024-01-01 00:00:{s:02d}"
    twice = (1, "a.com/x", at(1), "response", {"ETag": '"1"', "VIA": "b", "via": "c", "Via": "a", "server": None}, "px")
    rows = [
        twice, twice, (0, "a.com/x", at(1), "response", {"etag": '"0"'}, "p0"),
        (2, "b.com/y", at(1), "response", {"etag": '"2"'}, "py"),
        (None, "c.com/z", at(1), "response", None, "pz"),
        (9, "a.com/x", at(5), "revisit", {"ETAG": '"1"'}, None), (9, "b.com/y", at(5), "revisit", {"Etag": '"2"'}, None),
        (None, "a.com/x", at(6), "revisit", {"Warning": "1", "warning": "2"}, None),
        (None, "c.com/z", at(7), "revisit", {}, None),
        (10, "b.com/y", at(5), "revisit", None, None), (10, "b.com/y", at(5), "revisit", None, None),
        (11, "b.com/y", at(1), "revisit", None, None), (12, "b.com/y", at(9), "request", None, None),
    ]
    df = spark.createDataFrame(rows, "record_id long, url string, ts string, kind string, headers map<string,string>, payload_sha256 string").withColumn("ts", F.col("ts").cast("timestamp"))
    df = df.withColumn("t", F.lit("clash")).withColumn("refers_to", F.lit(7)).withColumn("at", F.lit(7))
    x, y = {"etag": '"1"', "via": "b, a, c"}, {"etag": '"2"'}
    want = [(9, "a.com/x", 1, "resolved", x, "px"), (9, "b.com/y", 2, "resolved", y, "py"), (None, "a.com/x", 1, "unchecked", {**x, "warning": "1, 2"}, "px"),
            (None, "c.com/z", None, "unchecked", {}, "pz"), *[(10, "b.com/y", 2, "unchecked", y, "py")] * 2, (11, "b.com/y", None, "unresolved", {}, None)]
    for buckets in (1, 2, 16):
        got = [(r.record_id, r.url_key, r.refers_to, r.status, r.headers, r.payload_sha256) for r in warc.resolve_revisits(df, buckets=buckets).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


# toxicity

def test_nearest_examples_are_exact():
    rng = np.random.default_rng(1)
    v = rng.random((300, 40)) * (rng.random((300, 40)) < 0.15)
    v /= np.maximum(np.sqrt((v**2).sum(axis=1, keepdims=True)), 1e-12)
    index = toxicity.Index(v, rng.integers(0, 2, 300), np.arange(300), 7)
    q = v[:50]
    best, who = index.nearest(q)
    place = {d: k for k, d in enumerate(index.ids.tolist())}
    for i in range(50):
        sims = np.round(q[i] @ v.T, 12)
        order = sorted((d for d in range(300) if sims[d] > 0), key=lambda d: (-sims[d], place[d]))[:7]
        assert [place[d] for d in order] == [w for w in who[i].tolist() if w >= 0]


def test_toxicity_edges_and_accuracy(spark, edge, none):
    labels = table(spark, SMALL, "labels")
    empty = labels.limit(0)
    assert {r.score for r in toxicity.toxicity(edge, empty).collect()} == {0.0}
    assert toxicity.toxicity(none, labels).count() == 0
    own = ["".join(chr(97 + int(c)) for c in str(i)) for i in range(400)]
    docs = spark.createDataFrame([(i, ("idiot moron scum " if i % 4 == 0 else "") + f"the w{x} of r{x} s{x} t{x} u{x}", "en") for i, x in enumerate(own)], "doc_id long, text string, score string")
    marks = docs.selectExpr("doc_id", "cast(doc_id % 4 = 0 as int) as toxic")
    rows = toxicity.toxicity(docs.unionByName(docs.where("doc_id = 4")).unionByName(spark.createDataFrame([(None, None, None)], docs.schema)), marks).collect()
    assert len(rows) == 402 and all(r.predicted == int(r.doc_id % 4 == 0) for r in rows if r.doc_id is not None)
    assert {r.predicted for r in rows if r.doc_id is None} == {0}
    assert toxicity.reject_toxic(docs, marks).count() == 300


@pytest.mark.parametrize("block,first,head", [(4, 1, 6), (16, 3, 0), (1, 2, 512)])
def test_neighbours_are_exact_when_blocks_are_skipped(monkeypatch, block, first, head):
    monkeypatch.setattr(toxicity, "HEAD", head)
    monkeypatch.setattr(toxicity, "BLOCK", block)
    monkeypatch.setattr(toxicity, "FIRST_BLOCKS", first)
    test_nearest_examples_are_exact()


@pytest.mark.parametrize("head", [0, 20, 512])
def test_bounds_hold_for_every_term_and_let_blocks_be_skipped(monkeypatch, head):
    monkeypatch.setattr(toxicity, "HEAD", head)
    rng = np.random.default_rng(6)
    v = np.zeros((640, 90))
    for i in range(640):  # three vocabularies
        v[i, 30 * (i % 3) + rng.choice(30, 6, replace=False)] = rng.random(6) + 0.1
    v /= np.sqrt((v**2).sum(axis=1, keepdims=True))
    index = toxicity.Index(v, rng.integers(0, 2, 640), np.arange(640), 5)
    skipped = 0
    for q in v[:60]:
        s = toxicity.Sparse.of(q[None])
        bound = index.bounds(*index._cut(s))[0]
        sims = v[index.ids] @ q
        assert all(sims[b * toxicity.BLOCK : (b + 1) * toxicity.BLOCK].max() <= bound[b] + 1e-12 for b in range(index.blocks))
        skipped += (bound < np.sort(sims)[-5]).sum()
    assert skipped > 60 * index.blocks / 2


def test_sample_counts_copies_of_a_label_once_and_ends_at_its_bounds():
    rows = [(1, 0, 5, [b"a", b"b"]), (2, 1, 5, [b"a", b"b"]), (3, 0, 5, [b"a", b"b"]), (4, 0, 5, [b"a", b"c"]), (5, 0, 95, [b"d", b"e"]), (6, 0, 5, [b"f", b"g"]), (7, 0, 5, [b"h", b"i"])]
    assert toxicity._unlike(rows, 3, 100) == [(1, 0), (2, 1), (4, 0), (6, 0)]


def test_repeated_ids_learn_the_largest_text(spark):
    own = ["".join(chr(97 + int(c)) for c in str(i)) for i in range(200)]
    docs = [(i, ("idiot moron " if i % 4 == 0 else "") + f"the w{x} of r{x}") for i, x in enumerate(own)]
    marks = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    twice = docs + [(i, "aa " + t) for i, t in docs[1::4]]
    both = [{tuple(r)[:4] for r in toxicity.toxicity(spark.createDataFrame(d, "doc_id long, text string").repartition(p), marks).collect()} for d, p in ((twice, 2), (twice[::-1], 5))]
    assert both[0] == both[1]


def test_copy_of_a_toxic_example_with_rare_words_finds_it(spark):
    own = ["".join(chr(97 + int(c)) for c in str(i)) for i in range(300)]
    learned = next(i for i in range(300, 400) if zlib.crc32(str(i).encode()) % 5)
    rare = "zephyr quixotic vamoose jabberwock krill"
    docs = spark.createDataFrame([(i, ("idiot moron scum " if i % 4 == 0 else "") + f"the w{x} of r{x} s{x}") for i, x in enumerate(own)] + [(learned, rare), (1000, rare), (1001, "unheard")], "doc_id long, text string")
    marks = docs.where("doc_id < 1000").selectExpr("doc_id", f"cast(doc_id % 4 = 0 or doc_id = {learned} as int) as toxic")
    rows = {r.doc_id: r for r in toxicity.toxicity(docs, marks).collect()}
    assert rows[1000].evidence[0].doc_id == learned and rows[1000].evidence[0].similarity == pytest.approx(1)
    assert rows[1000].score >= 0.5 > rows[1].score


# top-k

def test_top_inner_products_edges(spark, monkeypatch):
    monkeypatch.setattr(topk, "GROUP_ROWS", 64)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 8)
    monkeypatch.setattr(topk, "HEAD_ROWS", 16)
    rng = np.random.default_rng(2)
    rows = [(i, (rng.standard_normal(8) * rng.random()).round(1).tolist()) for i in range(300)] + [(300, None), (301, [None] + [0.1] * 7), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (None, [1.0] * 8)]
    df = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    ints = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in rows[:300]}
    want = set()
    for q in range(0, 300, 50):
        s = sorted(((-sum(a * b for a, b in zip(ints[q], ints[c])), c) for c in ints if c != q))[:5]
        want |= {(q, r + 1, c, -x) for r, (x, c) in enumerate(s)}
    assert {tuple(r) for r in topk.top_inner_products(df).collect()} == want
    assert topk.top_inner_products(df.limit(0)).count() == 0
    assert topk.top_inner_products(df.where("vec_id < 2")).count() == 1
    assert topk.top_inner_products(df.where("vec_id = 0")).count() == topk.top_inner_products(df.where("vec_id % 50 <> 0")).count() == 0


def brute_top(rows, k=5):
    """(query_id, rank, vec_id, score) of every row whose id 50 divides, by rows."""
    edge, want = (1 << 63) - 1, Counter()
    ints = [(i, [max(-edge, min(edge, math.floor(256 * x))) for x in v]) for i, v in rows]
    for a, (q, x) in enumerate(ints):
        if q % 50 == 0:
            s = sorted((-max(-edge, min(edge, sum(e * f for e, f in zip(x, y)))), c) for b, (c, y) in enumerate(ints) if b != a)[:k]
            want.update((q, r + 1, c, -t) for r, (t, c) in enumerate(s))
    return want


@pytest.mark.parametrize("kind", ["ragged", "huge", "beyond", "repeated", "one length", "falling lengths", "zero"])
def test_top_inner_products_odd_vectors(spark, monkeypatch, kind):
    for name, value in (("GROUP_ROWS", 40), ("BLOCK_ROWS", 8), ("HEAD_ROWS", 16), ("QUERY_ROWS", 3), ("LOT_BLOCKS", 2), ("STEPS", 4)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(4)
    near = rng.standard_normal((200, 6)).round(2)
    rows = {
        "ragged": [(i, x[: i % 7].tolist()) for i, x in enumerate(near)],
        "huge": [(i, (x * 1e9).tolist()) for i, x in enumerate(near)] + [(200 + i, (near[0] * 1e9 + i).tolist()) for i in range(9)],
        "beyond": [(i, (x * (1e300 if i % 3 else 1.0)).tolist()) for i, x in enumerate(near)],
        "repeated": [(i % 60, near[i % 90].tolist()) for i in range(200)] + [(50, near[0].tolist())] * 70,
        "one length": [(i, (x / np.linalg.norm(x)).tolist()) for i, x in enumerate(near)],
        "falling lengths": [(i, (x * 0.97 ** (i * 7 % 200)).tolist()) for i, x in enumerate(near)],
        "zero": [(i, [0.0] * 6) for i in range(120)],
    }[kind]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5).withColumn("grp", F.lit("clash")).withColumn("v", F.lit(1))
    assert Counter(map(tuple, topk.top_inner_products(topk.integer_vectors(df)).collect())) == brute_top(rows)


# packing

def test_packing_edges(spark, edge, none):
    library = Tokenizer.from_file(Q.WORD_BPE)
    cut = packing.pieces(edge, Q.WORD_BPE, capacity=64).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("c"))
    rows = packing.pack(cut, capacity=64, group_pieces=10).collect()
    want = Counter()
    for i, t in EDGE:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(ids), 64)):
            want[(i, k, a, len(ids[a : a + 64]), zlib.crc32(np.array(ids[a : a + 64], "<u4").tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    assert packing.pack(packing.pieces(none, Q.WORD_BPE).drop("ids")).count() == 0


def test_packing_keeps_large_and_null_ids(spark):
    top = 2**60
    docs = spark.createDataFrame([(top + 1, "one two"), (top + 2, "three"), (None, "four"), (None, None), (2**63 - 1, "x " * 300)], "doc_id long, text string").coalesce(1)
    whole = packing.pieces(docs, Q.WORD_BPE, capacity=64)
    want = Counter(map(tuple, whole.select("doc_id", "piece", "start", "length", F.crc32("ids")).collect()))
    got = packing.pack(packing.pieces(docs, Q.WORD_BPE, capacity=64, digest=True), capacity=64).collect()
    assert Counter(tuple(r)[:5] for r in got) == want and {r.doc_id for r in got} == {top + 1, top + 2, None, 2**63 - 1}


def test_encoder_remembers_within_its_bounds(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 2000)
    own, library = bpe.Bpe(Q.WORD_BPE), Tokenizer.from_file(Q.WORD_BPE)
    for a in range(0, 400, 7):
        texts = [f"word{i} item{i % 13}, word{i - 9}! " + "y" * (i % 50) for i in range(a, a + 7)]
        assert [np.frombuffer(r, "<u4").tolist() for r in own.encode([t.encode() for t in texts])] == [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(own.chunks) < 60 and len(own.chunks.old) < 60


def test_packing_spreads_repeated_and_null_ids(spark):
    row = "cast(null as long) as doc_id, 0 as piece, 0L as start, 7L as length, 9L as ids_crc32"
    rows = packing.pack(spark.range(3000).selectExpr(*row.split(", ")), capacity=64, group_pieces=100).collect()
    groups = Counter(r.sequence_id % 30 for r in rows)
    assert len(rows) == 3000 and len(groups) == 30 and max(groups.values()) < 200


def test_local_search_empties_bins_and_keeps_pieces():
    size = np.array([6, 6, 4, 3, 3, 2, 5, 5, 3, 3])
    bins = packing.local_search([[0], [1], [2, 3], [4, 5], [6], [7], [8, 9]], size, 10)
    assert sorted(i for b in bins for i in b) == list(range(10)) and max(size[b].sum() for b in bins) <= 10 and len(bins) <= 5
    assert packing._exchange(5, 2, [0, 1], [2, 2]) == (0, 1)  # two for one
    assert packing._exchange(5, 1, [0], [4]) == (0,)  # one for one


def test_local_search_looks_at_every_underfull_bin():
    size = np.array([99] * 70 + [30, 30])  # more bins with room for one id than any window of the fullest
    assert len(packing.local_search([[i] for i in range(72)], size, 100)) == 71
    rng = np.random.default_rng(4)
    left = 0
    for sizes in (rng.integers(700, 1300, 400), rng.integers(400, 1100, 400), rng.integers(1, 2047, 300)):
        bins = packing.local_search(packing.best_fit(sizes, 2048), sizes, 2048)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        fill = [int(sizes[b].sum()) for b in bins]
        assert max(fill) <= 2048
        if len(bins) == -(-int(sizes.sum()) // 2048):
            continue
        left += 1
        for g, own in enumerate(bins):  # no improving move or exchange is left
            for k, other in enumerate(bins):
                if k != g and fill[k] < 2048:
                    sums = {0, *(int(sizes[i]) for i in other), *(int(sizes[i] + sizes[j]) for n, i in enumerate(other) for j in other[:n])}
                    assert not any(0 < s - v <= 2048 - fill[k] and fill[k] + s - v > fill[g] for s in map(int, sizes[own]) for v in sums if fill[g] < 2048)
    assert left


# registered queries and the pipeline

@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    df = Q.QUERIES[name](spark, SMALL)
    cur = con.execute(Q.ORACLES[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_pipeline_stages_by_brute_force(spark):
    docs = table(spark, SMALL, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        docs = stage(spark, docs, SMALL).cache()
        after = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        assert docs.columns == columns and after
        if name == "exact_dedup":
            assert Counter(i for i, _ in after) == Counter({r[0]: 1 for r in brute_exact(before) if r[3]})
        if name == "simhash_near_dedup":
            assert {i for i, _ in after} == {c for _, _, c in brute_components(brute_prints(before))}
        if name == "substring_dedup":
            kept = {r[0]: r for r in brute_substring(before, 13)}
            assert all(t == (kept[i][3] if kept[i][2] else dict(before)[i]) for i, t in after) and len(after) == len(before)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert packed.select("doc_id").distinct().count() == len(after)


def test_near_duplicate_stage_writes_no_copy_of_the_rows(spark, edge, tmp_path, monkeypatch):
    monkeypatch.setattr("tripletframe.llm.common.checkpoint_dir", lambda _: str(tmp_path))
    docs = edge.select("doc_id", "text", "key")
    rows = corpus_pipeline.near(spark, docs, SMALL).collect()
    groups = defaultdict(list)
    for n, _, c in brute_components(brute_prints([(n, t) for n, (_, t) in enumerate(EDGE)])):
        groups[c].append(EDGE[n])
    keep = Counter(min((i for i, _ in g), key=lambda i: (i is None, i or 0)) for g in groups.values())
    assert Counter(r.doc_id for r in rows) == keep and all((r.doc_id, r.text) in EDGE and r.key == "k" for r in rows)
    written = [spark.read.parquet(str(p)) for p in tmp_path.iterdir()]
    assert written and all("text" not in c for t in written for c in t.columns)


def test_pipeline_stages_take_edge_rows(spark, edge, none):
    for rows in (edge, none):
        docs = rows.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SMALL).cache()
            docs.count()


def test_pipeline_stages_with_clashing_columns_null_and_repeated_ids(spark):
    text = " ".join(f"n{i}" for i in range(60))
    rows = [(1, text), (1, text + " more"), (None, text), (None, "alone here " * 9), (None, "alone here " * 9), (7, None), (8, ""), (9, "q " + PASSAGE), (10, "r " + PASSAGE)]
    clash = ["kept", "keep_id", "stays", "n_words", "kept_text", "fp", "row_nr", "own_text", "score", "ids", "length"]
    docs = spark.createDataFrame([(i, t, *["v"] * len(clash)) for i, t in rows], ", ".join(["doc_id long, text string", *(f"{c} string" for c in clash)]))
    out = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SMALL)
        assert got.columns == docs.columns
        out[name] = [tuple(r) for r in got.collect()]
        assert all(set(r[2:]) == {"v"} for r in out[name])
    ids = {n: Counter(r[0] for r in o) for n, o in out.items()}
    assert ids["toxicity"] == Counter(i for i, _ in rows)
    assert ids["exact_dedup"] == Counter({1: 2, None: 1, 8: 1, 9: 1, 10: 1})
    classes = brute_components(brute_prints([(n, t) for n, (_, t) in enumerate(rows)]))
    groups = defaultdict(list)
    for n, _, c in classes:
        groups[c].append(rows[n][0])
    assert ids["simhash_near_dedup"] == Counter(min(g, key=lambda i: (i is None, i or 0)) for g in groups.values())
    want = Counter((i, kept) for (i, _, _, kept), n in brute_substring(rows, 13).items() for _ in range(n))
    assert Counter((r[0], " ".join((r[1] or "").split())) for r in out["substring_dedup"]) == want
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == len(rows)

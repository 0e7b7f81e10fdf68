"""Encoder, attribution and fitting invariants."""

import numpy as np

from tripletframe.operators import attribution as I
from tripletframe.operators import corpus as C
from tripletframe.operators import scoring as S


def test_dense_forward_equals_table_lookup():
    """Fact 1: the sentence embedding is the mean of a fixed per-token table (no position mixing)."""
    d, senses, vocab = 8, 4, 30
    rng = np.random.default_rng(0)
    w = C.init_sense_weights(d, senses, seed=1)
    table = rng.normal(size=(vocab, d))
    ids = rng.integers(0, vocab, size=17)
    dense = (C.sense_forward(table[ids], w) @ w["T"]).mean(axis=(0, 1))
    lookup = C.token_vectors_from_senses(table, w)[ids].mean(axis=0)
    assert np.allclose(dense, lookup, atol=1e-12)


def test_token_senses_distributed_equals_numpy(spark):
    rng = np.random.default_rng(2)
    vecs = rng.normal(size=(50, 8))
    df = spark.createDataFrame([(f"t{i}", [float(x) for x in v]) for i, v in enumerate(vecs)], "token string, vec array<double>")
    w = C.init_sense_weights(8, 4)
    got = {r["token"]: np.asarray(r["g"]) for r in C.token_senses(df, w).collect()}
    want = C.token_vectors_from_senses(vecs, w)
    assert all(np.allclose(got[f"t{i}"], want[i]) for i in range(50))


def test_embed_texts_padded_mean(spark):
    toks = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "a")], "row_id long, pos int, token string")
    vec = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 0.0), ("b", 0, 0.0), ("b", 1, 1.0), ("<pad>", 0, 0.5), ("<pad>", 1, 0.5)],
                                "token string, j int, v double")
    e = {r["j"]: r["e"] for r in S.embed_texts(toks, vec, length=4).collect()}
    assert np.allclose([e[0], e[1]], [(2 + 0.5) / 4, (1 + 0.5) / 4])
    e2 = {r["j"]: r["e"] for r in S.embed_texts(toks, vec, length=2).collect()}  # longer than L: whole text
    assert np.allclose([e2[0], e2[1]], [2 / 3, 1 / 3])


def test_integrated_gradients_completeness():
    rng = np.random.default_rng(4)
    ex, eb, et = rng.normal(size=6), rng.normal(size=6), rng.normal(size=6)
    g = I.path_gradient(ex, eb, et, n_steps=200)
    total = (ex - eb) @ g
    cos = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    assert abs(total - (cos(ex, et) - cos(eb, et))) < 1e-4


def test_normalise_importance_unit_norm(spark):
    df = spark.createDataFrame([(1, 0, 3.0), (1, 1, 4.0), (2, 0, 0.0)], "pid long, pos int, attr double")
    out = {(r["pid"], r["pos"]): r["weight"] for r in I.normalise_importance(df, ["pid"]).collect()}
    assert np.allclose([out[(1, 0)], out[(1, 1)], out[(2, 0)]], [0.6, 0.8, 0.0])


def test_projection_fit_reduces_loss(spark):
    rng = np.random.default_rng(9)
    d = 6
    ref = rng.normal(size=(200, d))
    pos = ref + 0.5 * rng.normal(size=(200, d))
    neg = rng.normal(size=(200, d))
    rows = [([float(x) for x in a], [float(x) for x in b], [float(x) for x in c]) for a, b, c in zip(ref, pos, neg)]
    df = spark.createDataFrame(rows, "ref array<double>, pos array<double>, neg array<double>").repartition(4)
    from tripletframe.operators.training import fit_projection

    _, trace = fit_projection(df, d, steps=8, lr=0.05)
    assert trace[-1]["loss"] < trace[0]["loss"]


def test_mauve_identical_is_one(spark):
    rows = [(c, s) for c in range(5) for s in ("p", "q") for _ in range(c + 1)]
    df = spark.createDataFrame(rows, "cluster int, side string")
    assert abs(C.mauve_from_clusters(df).first()["mauve"] - 1.0) < 1e-6


def test_attribution_reference_baseline_completeness(spark):
    """Closed-form pad term with the target's tokens as baseline, including target tokens beyond the input."""
    rng = np.random.default_rng(8)
    toks = ["a", "b", "c", "d", "<pad>", "<unk>"]
    vec = spark.createDataFrame([(t, [float(x) for x in rng.normal(size=5)]) for t in toks], "token string, vec array<double>")
    tokens = spark.createDataFrame(
        [(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (2, 1, "d"), (2, 2, "a"), (2, 3, "c"), (3, 0, "d")],
        "text_id long, pos int, token string")
    pairs = spark.createDataFrame([(10, 1, 2, "reference"), (11, 2, 1, "reference"), (12, 3, 2, "zero")],
                                  "pair_id long, in_id long, tgt_id long, baseline string")
    att, tot = I.token_attribution(pairs, tokens, vec, length=3, n_steps=400)
    rows = tot.collect()
    assert len(rows) == 3
    assert all(abs(r["delta"]) < 1e-4 for r in rows)
    # dense check: embeddings over explicit positions for pair 10 (input 1 = a b + pad, baseline = c d a)
    v = {r["token"]: np.asarray(r["vec"]) for r in vec.collect()}
    ex = (v["a"] + v["b"] + v["<pad>"]) / 3
    eb = (v["c"] + v["d"] + v["a"]) / 3
    et = (v["c"] + v["d"] + v["a"] + v["c"]) / 4
    cos = lambda x, y: x @ y / np.linalg.norm(x) / np.linalg.norm(y)
    r10 = next(r for r in rows if r["pair_id"] == 10)
    assert abs(r10["cos_x"] - cos(ex, et)) < 1e-12 and abs(r10["cos_base"] - cos(eb, et)) < 1e-12
    assert att.where("pair_id = 10").count() == 3  # two tokens + one pad row


def test_embed_lengths_around_L(spark):
    """n = L-1, L, L+1 tokens: pads fill up to L; a longer text is averaged whole."""
    L = 4
    vec = spark.createDataFrame([("a", 0, 1.0), ("<pad>", 0, 0.25)], "token string, j int, v double")
    for n in (L - 1, L, L + 1):
        toks = spark.createDataFrame([(1, i, "a") for i in range(n)], "row_id long, pos int, token string")
        e = S.embed_texts(toks, vec, length=L).first()["e"]
        assert abs(e - (n * 1.0 + max(L - n, 0) * 0.25) / max(n, L)) < 1e-12


def test_token_table_holds_the_senses_and_is_written_once(spark, tmp_path):
    """g is the projected mean of the senses; a finished version is read again, another lies beside it."""
    rng = np.random.default_rng(3)
    w = C.init_sense_weights(4, 3)
    rows = [(t, [float(v) for v in rng.normal(size=4)]) for t in "abc"] + [("none", None)]
    df = spark.createDataFrame(rows, "token string, vec array<double>")
    table = C.write_token_table(C.token_senses(df, w), str(tmp_path / "tokens"), "1")
    got = {r.token: r for r in table.collect()}
    assert set(got) == set("abc")
    for t, v in rows[:3]:
        senses = C.sense_forward(np.array([v]), w)[0]
        assert np.allclose(got[t].senses, senses) and np.allclose(got[t].vec, (senses @ w["T"]).mean(0))
    other = C.token_senses(df.where("token = 'a'"), w)
    assert C.write_token_table(other, str(tmp_path / "tokens"), "1").count() == 3
    assert C.write_token_table(other, str(tmp_path / "tokens"), "2").count() == 1

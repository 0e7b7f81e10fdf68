"""Numeric checks of the metrics against independent numpy / Python computations."""

import math
import random

import numpy as np

from tripletframe.functions.porter import stem
from tripletframe.functions.vectors import cosine
from tripletframe.operators import agreement as G
from tripletframe.operators import evalstats as A
from tripletframe.operators import lexical as L


def test_cosine_properties(spark):
    rows = [([1.0, 0.0], [0.0, 1.0]), ([1.0, 2.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 2.0], [-2.0, -4.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    got = [r[0] for r in df.select(cosine("a", "b")).collect()]
    back = [r[0] for r in df.select(cosine("b", "a")).collect()]
    assert np.allclose(got, [0.0, 1.0, 0.0, -1.0]) and np.allclose(got, back)


def _lcs_dp(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            d[i + 1][j + 1] = d[i][j] + 1 if a[i] == b[j] else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def test_lcs_bit_parallel_matches_dp():
    rng = random.Random(7)
    for _ in range(300):
        a = [rng.choice("abcde") for _ in range(rng.randint(0, 40))]
        b = [rng.choice("abcde") for _ in range(rng.randint(0, 40))]
        assert L.lcs_length(a, b) == _lcs_dp(a, b)


def test_rouge_identity_and_symmetry(spark):
    rows = [(1, "the cat sat on the mat", "the cat sat on the mat"), (2, "a b c", "c d"), (3, "", "x y"), (4, "Élan vital", "vital")]
    df = spark.createDataFrame(rows, "pair_id long, g string, r string")
    arr = L.token_arrays(df, "pair_id", "g", "r", False)
    r1 = {r["pair_id"]: r for r in L.rouge_n(arr, 1).collect()}
    rl = {r["pair_id"]: r for r in L.rouge_l(arr).collect()}
    assert r1[1]["r1f1"] == 1.0 and rl[1]["rLf1"] == 1.0
    assert abs(r1[2]["r1f1"] - 2 * (1 / 3) * (1 / 2) / (1 / 3 + 1 / 2)) < 1e-12
    assert r1[3]["r1f1"] == 0.0
    swapped = L.token_arrays(df, "pair_id", "r", "g", False)
    r1s = {r["pair_id"]: r["r1f1"] for r in L.rouge_n(swapped, 1).collect()}
    assert all(abs(r1s[k] - r1[k]["r1f1"]) < 1e-12 for k in r1)


def test_porter_examples():
    # Examples from the published algorithm description.
    cases = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster",
             "motoring": "motor", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat",
             "conditional": "condit", "generalization": "gener", "adjustable": "adjust", "controlling": "control", "roll": "roll"}
    assert {w: stem(w) for w in cases} == cases


def _w1(u, v):
    allv = np.sort(np.concatenate([u, v]))
    d = np.diff(allv)
    cu = np.searchsorted(np.sort(u), allv[:-1], side="right") / len(u)
    cv = np.searchsorted(np.sort(v), allv[:-1], side="right") / len(v)
    return float(np.sum(np.abs(cu - cv) * d))


def test_wasserstein_against_numpy(spark):
    rng = np.random.default_rng(1)
    u, v = rng.normal(0.3, 0.1, 300).round(3), rng.normal(0.5, 0.2, 250).round(3)
    rows = [("g", 1, float(x)) for x in u] + [("g", 0, float(x)) for x in v] + [("same", 1, float(x)) for x in u] + [("same", 0, float(x)) for x in u]
    df = spark.createDataFrame(rows, "grp string, label int, score double")
    got = {r["grp"]: r["wasserstein"] for r in A.wasserstein1(df, ["grp"], rows_per_bucket=50).collect()}
    assert abs(got["g"] - _w1(u, v)) < 1e-9
    assert abs(got["same"]) < 1e-12


def test_wasserstein_translation(spark):
    u = np.arange(20) / 10.0
    rows = [(1, float(x)) for x in u] + [(0, float(x) + 0.5) for x in u]
    df = spark.createDataFrame(rows, "label int, score double")
    assert abs(A.wasserstein1(df, []).first()["wasserstein"] - 0.5) < 1e-9


def test_macro_f1_and_bacc_edges(spark):
    rows = [("tied", 1, 0.5), ("tied", 0, 0.5), ("tied", 1, 0.5), ("onlypos", 1, 0.9), ("onlypos", 1, 0.8)]
    df = spark.createDataFrame(rows, "g string, label int, score double")
    f = {r["g"]: r["f1"] for r in A.macro_f1(df, ["g"]).collect()}
    b = {r["g"]: r["bacc"] for r in A.balanced_accuracy(df, ["g"]).collect()}
    # tied at the threshold: all predicted positive -> F1(pos)=0.8, F1(neg)=0 -> 0.4
    assert abs(f["tied"] - 0.4) < 1e-12 and abs(b["tied"] - 0.5) < 1e-12
    assert f["onlypos"] == 1.0 and b["onlypos"] == 1.0


def test_ccc_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=200)
    y = 0.7 * x + rng.normal(scale=0.3, size=200)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    got = G.ccc(df, "x", "y").first()["ccc"]
    want = 2 * np.mean((x - x.mean()) * (y - y.mean())) / (x.var() + y.var() + (x.mean() - y.mean()) ** 2)
    assert abs(got - want) < 1e-9
    assert abs(G.ccc(df, "x", "x").first()["ccc"] - 1.0) < 1e-12


def test_closeness_rank_ties_average(spark):
    rows = [(1, m, s, 0.5) for m, s in (("a", 0.5), ("b", 0.4), ("c", 0.6), ("d", 0.9))]
    df = spark.createDataFrame(rows, "sid long, metric string, score double, human double")
    r = {x["metric"]: x["rank"] for x in G.closeness_rank(df, ["sid"]).collect()}
    assert r == {"a": 1.0, "b": 2.5, "c": 2.5, "d": 4.0}
    assert sum(r.values()) == 4 * 5 / 2


def test_kde_integrates_to_one(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(float(v),) for v in rng.normal(size=400)], "v double")
    d = sorted(G.score_density(df, "v", []).collect(), key=lambda r: r["j"])
    xs = np.array([r["x"] for r in d])
    ys = np.array([r["density"] for r in d])
    assert abs(np.sum((xs[1:] - xs[:-1]) * (ys[1:] + ys[:-1]) / 2) - 1.0) < 0.01


def test_threshold_curve_grid_edges(spark):
    # differences exactly on grid points 0 and 1/99, and above everything
    rows = [("g", 1, 0.3 + 30 / 99, 0.3), ("g", 2, 0.3 + 31 * (1 / 99), 0.3), ("g", 3, 0.99, 0.01), ("g", 4, 0.8, 0.6)]
    df = spark.createDataFrame(rows, "grp string, row_id long, correct double, incorrect double")
    c = {r["j"]: r["pct"] for r in A.threshold_curve(df, ["grp"]).collect()}
    direct = {}
    for j in range(100):
        t = 1.0 if j == 99 else j * (1.0 / 99)
        direct[j] = sum(1 for _, _, cc, ii in rows if cc - ii > t and ii < 0.5 and cc > 0.5) / len(rows) * 100
    assert all(abs(c[j] - direct[j]) < 1e-9 for j in range(100))
    assert math.isclose(c[0], 75.0)


def test_bertscore_paths_agree(spark):
    from tripletframe.operators import scoring as S

    rng = np.random.default_rng(11)
    toks = ["w%d" % i for i in range(12)]
    vecs = spark.createDataFrame([(t, j, float(rng.normal())) for t in toks for j in range(4)], "token string, j int, v double")
    rows = [(tid, t) for tid in range(6) for t in rng.choice(toks, size=int(rng.integers(1, 9)))]
    tokens = spark.createDataFrame([(int(a), str(b)) for a, b in rows], "text_id long, token string")
    pairs = spark.createDataFrame([(k, 2 * k, 2 * k + 1) for k in range(3)], "pair_id long, cand_id long, ref_id long")
    big = {r["pair_id"]: r for r in S.bertscore(pairs, tokens, vecs).collect()}
    small = {r["pair_id"]: r for r in S.bertscore(pairs, tokens, vecs, limit=0).collect()}
    assert set(big) == set(small) == {0, 1, 2}
    for k in big:
        assert all(abs(big[k][c] - small[k][c]) < 1e-12 for c in ("bert_p", "bert_r", "bert_f"))
    self_pairs = spark.createDataFrame([(9, 1, 1)], "pair_id long, cand_id long, ref_id long")
    assert abs(S.bertscore(self_pairs, tokens, vecs).first()["bert_f"] - 1.0) < 1e-12

"""All pair metrics at once, METEOR's stages, the learned score's fit and the joint quantisation, each against a plain Python version."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripletframe.functions.porter import stem
from tripletframe.operators import corpus, lexical, quantise, score_all
from tripletframe.sources.fixtures import hashed_vectors

PAIRS = [
    (1, "the quick brown foxes were running", "the quick brown fox runs"), (2, "a big house", "a large house stood there"), (3, None, "the cat"), (4, "", "the cat"),
    (5, "The cat, the CAT; the hat!", "the hat the cat the cat"), (6, "walk walked walking walks", "walks walking walk"), (7, "b a", "a b"), (8, "12 x 34", "34 12"),
    (9, "no overlap here", "totally different words"), (10, "the cat", None), (11, "", ""), (12, "a big large huge thing", "a large huge big thing"),
]
SYNSETS = [("big", "large"), ("huge", "large"), ("totally", "wholly"), ("here", "wholly")]


def brute_meteor(hyp, ref, synonyms=None):
    """Words from the last one backwards, each to the last free equal word: exact, then stems, then synsets."""
    if not hyp or not ref:
        return 0.0
    free_h, free_r, hits = set(range(len(hyp))), set(range(len(ref))), []
    for rule in (lambda w: w, stem, *([lambda w: synonyms.get(w, w)] if synonyms else [])):
        for i in sorted(free_h, reverse=True):
            j = max((j for j in free_r if rule(ref[j]) == rule(hyp[i])), default=None)
            if j is not None:
                hits.append((i, j))
                free_h.discard(i)
                free_r.discard(j)
    if not hits:
        return 0.0
    hits.sort()
    m, chunks = len(hits), 1 + sum((b[0] - a[0], b[1] - a[1]) != (1, 1) for a, b in zip(hits, hits[1:]))
    p, r = m / len(hyp), m / len(ref)
    return (1 - 0.5 * (chunks / m) ** 3) * p * r / (0.9 * p + 0.1 * r)


def words(t):
    import re

    return re.findall("[a-z0-9]+", t.lower())


def frame(spark, rows=PAIRS):
    return spark.createDataFrame(rows, "pair_id long, gen string, ref string").repartition(3)


@pytest.mark.parametrize("synonyms", [None, dict(SYNSETS)])
def test_meteor_against_plain_python(spark, synonyms):
    arrays = lexical.token_arrays(frame(spark), "pair_id", "gen", "ref", False)
    table = spark.createDataFrame(SYNSETS, "word string, synset string") if synonyms else None
    got = {r.pair_id: r.meteor for r in lexical.meteor(arrays, synonyms=table).collect()}
    assert set(got) == {p[0] for p in PAIRS}
    for i, g, r in PAIRS:
        assert got[i] is None if g is None or r is None else abs(got[i] - brute_meteor(words(g), words(r), synonyms)) < 1e-12


def test_a_synonym_raises_meteor(spark):
    arrays = lexical.token_arrays(frame(spark, [(1, "a big house", "a large house")]), "pair_id", "gen", "ref", False)
    plain = lexical.meteor(arrays).first().meteor
    assert lexical.meteor(arrays, synonyms=spark.createDataFrame(SYNSETS, "word string, synset string")).first().meteor > plain > 0


def test_meteor_on_random_texts(spark):
    rng = np.random.default_rng(4)
    vocab = ["run", "runs", "running", "cat", "cats", "big", "large", "huge", "x"]
    rows = [(i, " ".join(rng.choice(vocab, rng.integers(1, 25))), " ".join(rng.choice(vocab, rng.integers(1, 25)))) for i in range(80)]
    arrays = lexical.token_arrays(frame(spark, rows), "pair_id", "gen", "ref", False)
    got = {r.pair_id: r.meteor for r in lexical.meteor(arrays, synonyms=spark.createDataFrame(SYNSETS, "word string, synset string")).collect()}
    assert all(abs(got[i] - brute_meteor(words(g), words(r), dict(SYNSETS))) < 1e-12 for i, g, r in rows)


def test_meteor_runs_no_python_per_pair(spark):
    arrays = lexical.token_arrays(frame(spark), "pair_id", "gen", "ref", False)
    tokens = arrays.select("pair_id", F.lit(0).alias("side"), F.posexplode("g").alias("pos", "word")).withColumn("root", F.col("word"))
    plan = lexical.meteor_of_tokens(tokens)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert plan.count("Exchange hashpartitioning") == 1  # every window and sum follows the one shuffle


def brute_lexical(g, r):
    g, r = ([stem(w) if len(w) > 3 else w for w in words(t)] for t in (g, r))

    def f1(ov, a, b):
        return 2 * ov / (a + b) if ov else 0.0

    out = {}
    for n in (1, 2):
        a, b = ([tuple(x[i : i + n]) for i in range(len(x) - n + 1)] for x in (g, r))
        out[f"r{n}f1"] = f1(sum(min(a.count(x), b.count(x)) for x in set(a)), len(a), len(b))
    lcs = np.zeros((len(g) + 1, len(r) + 1), int)
    for i, x in enumerate(g):
        for j, y in enumerate(r):
            lcs[i + 1, j + 1] = lcs[i, j] + 1 if x == y else max(lcs[i, j + 1], lcs[i + 1, j])
    out["rLf1"] = f1(lcs[-1, -1], len(g), len(r))
    return out


def pad(spark):
    return [r.v for r in hashed_vectors(spark.createDataFrame([("<pad>",)], "token string")).orderBy("j").collect()]


def test_all_metrics_of_triplets_keep_every_row(spark):
    rows = [(i, r, g, "the dog barked") for i, g, r in PAIRS]
    df = spark.createDataFrame(rows, "row_id long, premise string, correct_answer string, incorrect_answer string")
    got = {(r.row_id, r.label, r.metric): r.score for r in score_all.score_all(df, vectors=hashed_vectors, pad=pad(spark)).collect()}
    names = [*score_all.METRICS, "learned"]
    assert set(got) == {(p[0], label, m) for p in PAIRS for label in (0, 1) for m in names}
    for i, g, r in PAIRS:
        for label, cand in ((1, g), (0, "the dog barked")):
            if cand is None or r is None:
                assert all(got[i, label, m] is None for m in names)
                continue
            want = {**brute_lexical(cand, r), "meteor": brute_meteor(words(cand), words(r))}
            assert all(abs(got[i, label, m] - v) < 1e-12 for m, v in want.items())
            assert all(-1 - 1e-9 <= got[i, label, m] <= 1 + 1e-9 for m in ("embsim", "bert", "simcse"))
    same = {m: got[12, 1, m] for m in names}
    assert abs(same["embsim"] - 1) < 1e-6 and abs(same["bert"] - 1) < 1e-9 and abs(same["simcse"] - 1) < 1e-9  # the same bag of words


def test_named_metrics_of_pairs_and_given_weights(spark):
    df = spark.createDataFrame([(7, "a cat sat", "the cat sat", 3.0), (8, "x", "y", 0.0)], "row_id long, text1 string, text2 string, gold double")
    got = {(r.row_id, r.metric): r.score for r in score_all.score_all(df, ["r1f1", "learned"], kind="pairs", label_col="gold", weights=[0.25, 0.5]).collect()}
    assert got == {(7, "r1f1"): pytest.approx(2 / 3), (8, "r1f1"): 0.0, (7, "learned"): pytest.approx(0.25 + 1 / 3), (8, "learned"): 0.25}


def test_unknown_metric_and_kind_raise(spark):
    df = spark.createDataFrame([(7, "a", "b", 3.0)], "row_id long, text1 string, text2 string, label double")
    with pytest.raises(ValueError, match="bleu"):
        score_all.score_all(df, ["bleu"], kind="pairs")
    with pytest.raises(ValueError, match="kind"):
        score_all.score_all(df, ["r1f1"], kind="triples")


def test_scores_of_an_empty_table(spark):
    df = spark.createDataFrame([], "row_id long, premise string, correct_answer string, incorrect_answer string")
    assert score_all.score_all(df, ["r1f1", "rLf1", "meteor", "learned"]).count() == 0


def test_fit_equals_least_squares_and_survives_dependent_columns(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + rng.normal(scale=0.1, size=300)
    rows = [(*map(float, a), float(a[0] * 2), float(b)) for a, b in zip(x, y)] + [(None, 1.0, 1.0, 1.0, 5.0), (1.0, 1.0, 1.0, 2.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double, a2 double, label double").repartition(4)
    want = np.linalg.lstsq(np.c_[np.ones(300), x], y, rcond=None)[0]
    assert np.allclose(score_all.fit_linear(df, ["a", "b", "c"]), want, atol=1e-9)
    w = score_all.fit_linear(df, ["a", "a2", "b", "c"])
    got = [r.learned for r in score_all.predict_linear(df, ["a", "a2", "b", "c"], w).where("a is not null and label is not null").select("a", "b", "c", "learned").collect()]
    assert np.allclose(sorted(got), sorted(np.c_[np.ones(300), x] @ want), atol=1e-6)


# joint quantisation

def points(spark, n=60, shift=4.0, seed=6):
    rng = np.random.default_rng(seed)
    rows = [("g", s, i, [float(v) for v in rng.normal(size=5) + (shift if s == "q" else 0)]) for s in "pq" for i in range(n)]
    return rows, spark.createDataFrame(rows, "grp string, side string, key long, vec array<double>").repartition(5)


def test_lloyd_equals_plain_k_means(spark):
    rows, df = points(spark)
    hashed = sorted(df.withColumn("h", quantise.hkey("side", "key")).collect(), key=lambda r: (r.h, r.side, r.key))
    centres = np.array([r.vec for r in hashed[:4]])
    x = np.array([r[3] for r in rows])
    for _ in range(6):
        near = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
        centres = np.array([x[near == c].mean(0) if (near == c).any() else centres[c] for c in range(4)])
    near = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
    got = {(r.side, r.key): r.cluster for r in quantise.lloyd(df, 4, 6, order=("side", "key")).collect()}
    assert got == {(s, i): int(c) for (_, s, i, _), c in zip(rows, near)}


def test_axes_equal_the_covariance_eigenvectors(spark):
    rows, df = points(spark, shift=2.0)
    x = np.array([r[3] for r in rows])
    mean, axes = quantise.principal_axes(df, 2)
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    assert np.allclose(mean, x.mean(0)) and np.allclose(np.abs(axes.T @ vectors[:, ::-1][:, :2]), np.eye(2), atol=1e-8)
    got = {(r.side, r.key): r.vec for r in quantise.project(df, mean, axes).collect()}
    assert all(np.allclose(got[s, i], (np.array(v) - mean) @ axes) for _, s, i, v in rows)


def test_mauve_of_vectors_tells_apart_and_keeps_one_sided_groups_null(spark):
    far = quantise.mauve(points(spark)[1], 4, pca_dim=2, order=("side", "key")).first()
    near = quantise.mauve(points(spark, shift=0.0)[1], 4, order=("side", "key")).first()
    assert 0 <= far.mauve < 0.3 < near.mauve <= 1.0
    one = points(spark)[1].where("side = 'p'").unionByName(spark.createDataFrame([("g", "p", 99, None), (None, "q", 1, [0.0] * 5)], "grp string, side string, key long, vec array<double>"))
    assert [tuple(r) for r in quantise.mauve(one, 3, order=("side", "key")).collect()] == [("g", None)]


def test_mauve_from_identical_sides_is_one(spark):
    rows = [(c, s) for c in range(3) for s in "pq"]
    assert abs(corpus.mauve_from_clusters(spark.createDataFrame(rows, "cluster int, side string")).first().mauve - 1) < 1e-6

"""Pair metrics move whole texts, never a row a token: the deal by pair, the slices of pairs and what score_all writes."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripletframe.functions.porter import stem
from tripletframe.operators import lexical as L
from tripletframe.operators import score_all, scoring
from tripletframe.sources.fixtures import hashed_vectors

VECTORS = {"a": [1.0, 2.0], "b": [0.5, -1.0], "c": [3.0, 0.0], "z": [0.0, 0.0], "": [9.0, 9.0]}
ROWS = [(1, "a b a", "c a"), (2, "b nope", "a"), (3, None, "a b"), (4, "", "c"), (5, "nope", "nope"), (6, "z a", "z z"), (7, "a", "b"), (7, "c c", None), (7, "b", "a b"),
        *((10 + i, " ".join("abcz"[i % 4] for _ in range(1 + i % 3)), " ".join("abc"[: 1 + i % 3])) for i in range(30))]


def matched(a, b):
    """Weighted best-match means over distinct words, as E13 defines them."""
    unit = lambda w: np.array(VECTORS[w]) / (np.linalg.norm(VECTORS[w]) or 1.0)
    if not a or not b:
        return 0.0, 0.0, 0.0
    best = lambda x, y: sum(k * max(unit(w) @ unit(v) for v in y) for w, k in x.items()) / sum(x.values())
    p, r = best(a, b), best(b, a)
    return p, r, 2 * p * r / (p + r) if p + r else 0.0


@pytest.mark.parametrize("slice_tokens, slice_keys", [(1 << 23, 1 << 11), (8, 2)])
def test_bags_of_pairs_against_plain_python(spark, monkeypatch, slice_tokens, slice_keys):
    monkeypatch.setattr(scoring, "PAIR_SLICE_TOKENS", slice_tokens)
    monkeypatch.setattr(scoring, "SLICE_KEYS", slice_keys)
    pairs = spark.createDataFrame([*ROWS, (None, "a", "b")], "pair_id long, a string, b string").repartition(4)
    vectors = spark.createDataFrame([*VECTORS.items(), ("nope", None)], "token string, vec array<double>")
    got = {r.pair_id: r for r in scoring.pair_bags(pairs, vectors, 150).collect()}
    assert set(got) == {r[0] for r in ROWS}
    for key, r in got.items():
        bags = [Counter(w for row in ROWS if row[0] == key for w in (row[i] or "").split() if w in VECTORS) for i in (1, 2)]
        for bag, n, s in zip(bags, (r.known_a, r.known_b), (r.sums_a, r.sums_b)):
            assert n == sum(bag.values())
            assert s == pytest.approx(sum(k * np.array(VECTORS[w]) for w, k in bag.items()).tolist() if bag else [])
        assert (r.bert_p, r.bert_r, r.bert_f) == pytest.approx(matched(*bags))


def test_pairs_without_known_words_get_the_pad_vector(spark):
    bags = scoring.pair_bags(spark.createDataFrame([(1, "nope", "a b")], "pair_id long, a string, b string"),
                             spark.createDataFrame(list(VECTORS.items()), "token string, vec array<double>"), 3)
    r = scoring.pair_embeddings(bags, [0.25, 0.5], 4).first()
    assert r.a == [0.25, 0.5] and r.b == pytest.approx([(1.5 + 2 * 0.25) / 4, (1.0 + 2 * 0.5) / 4])


def test_dealt_tokens_are_the_words_with_stems(spark, monkeypatch):
    monkeypatch.setattr(L, "TASK_TOKENS", 10)
    rows = [(i, f"Running, the CATS {'ran ' * i}!", None if i % 3 == 0 else "" if i % 3 == 1 else "flies of agreed men") for i in range(8)]
    texts = spark.createDataFrame([*rows, (None, "lost", "key")], "pair_id long, x string, y string")
    total = L.n_tokens(texts, ["x", "y"])
    tokens = L.dealt_tokens(texts, "pair_id", ["x", "y"], total)
    words = [(k, side, pos, w) for k, *both in rows for side, t in enumerate(both) for pos, w in enumerate((t or "").lower().replace(",", "").replace("!", "").split())]
    assert total == len(words) + 2
    assert sorted(map(tuple, tokens.collect())) == sorted((k, side, pos, w, stem(w) if len(w) > 3 else w, stem(w)) for k, side, pos, w in words)


def test_metrics_on_dealt_tokens_shuffle_texts_only(spark):
    long = spark.createDataFrame([(1, "the cat", "a cat sat")], "pair_id long, reference string, candidate string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        x = score_all.prepare(long)
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (L.meteor_of_tokens(x.tokens, dealt=True), L.rouge_n(x.arrays, 2))]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    for plan in plans:  # a shuffle above a Generate would move a row a token or n-gram
        lines = plan.split("\n")
        depth = lambda line: len(line) - len(line.lstrip(" :+-"))
        for i, line in enumerate(lines):
            if "Exchange hashpartitioning" in line:
                below = []
                for other in lines[i + 1 :]:
                    if depth(other) <= depth(line):
                        break
                    below.append(other)
                assert not any("Generate" in b for b in below)


def test_score_all_writes_no_row_a_token(spark, monkeypatch):
    written = []
    keep = score_all.cut_lineage

    def cut(df):
        out = keep(df)
        written.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(score_all, "cut_lineage", cut)
    text = lambda i, n: " ".join(f"w{(i * 7 + j * j) % 50}" for j in range(n))
    rows = [(i, text(i, 60), text(i + 1, 60), text(i + 2, 60)) for i in range(20)]
    df = spark.createDataFrame(rows, "row_id long, premise string, correct_answer string, incorrect_answer string")
    pad = [r.v for r in hashed_vectors(spark.createDataFrame([("<pad>",)], "token string")).orderBy("j").collect()]
    found = score_all.score_all(df, vectors=hashed_vectors, pad=pad)
    assert found.count() == 20 * 2 * 8 and found.where(F.col("score").isNull()).count() == 0
    assert max(n for _, n in written) <= 20 * 2 * 8  # tokens would be 20 * 4 * 60 rows


def test_score_table_of_scores_writes_no_row_a_token(spark, monkeypatch, tmp_path):
    from tripletframe.plans.scoring_queries import a8e_score_table_of_scores

    written = []
    keep = score_all.cut_lineage

    def cut(df):
        out = keep(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(score_all, "cut_lineage", cut)
    turns = [(c, t, "assistant" if t % 2 else "user", " ".join(f"w{(c * 5 + t + j * j) % 40}" for j in range(50))) for c in range(10) for t in range(4)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    table = {r.metric: r for r in a8e_score_table_of_scores(spark, str(tmp_path)).collect()}
    assert set(table) == {*score_all.METRICS, "learned"}
    pairs = {(c, t): [words.split() for _, _, _, words in turns[c * 4 + t : c * 4 + t + 2]] for c in range(10) for t in (0, 2)}
    f1 = [2 * sum((Counter(a) & Counter(b)).values()) / (len(a) + len(b)) for a, b in pairs.values()]
    assert table["r1f1"].correct == pytest.approx(100 * np.mean(f1), abs=0.006)
    assert max(written) <= 20 * 2 * 8  # tokens would be 20 * 4 * 50 rows

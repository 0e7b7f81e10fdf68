"""Edge rows outside the test tables: token-less texts, constant columns, one-sided groups, unmapped labels."""

import pytest

from tripletframe import session
from tripletframe.functions import columns as P
from tripletframe.operators import agreement, corpus, lexical, score_all, scoring, triplets


def test_embedding_keeps_texts_without_tokens(spark):
    tokens = spark.createDataFrame([(1, 0, "a")], "row_id long, pos int, token string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0])], "token string, vec array<double>")
    texts = spark.createDataFrame([(1,), (2,)], "row_id long")
    got = {r.row_id: (r.n, r.emb) for r in scoring.embed_texts_arrays(tokens, vectors, [0.0, 1.0], length=2, texts=texts).collect()}
    assert got == {1: (1, [0.5, 0.5]), 2: (0, [0.0, 1.0])}


def test_ccc_of_equal_constants_is_null(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "x double, y double")
    assert agreement.ccc(df, "x", "y").first()[0] is None


def test_mauve_of_a_one_sided_group_is_null(spark):
    df = spark.createDataFrame([("one", "p", 0), ("one", "p", 1), ("two", "p", 0), ("two", "q", 0)], "g string, side string, cluster int")
    got = {r.g: r.mauve for r in corpus.mauve_from_clusters(df, "side", "cluster", ["g"]).collect()}
    assert got["one"] is None and abs(got["two"] - 1.0) < 1e-6 and len(got) == 2


def test_map_label_keeps_unmapped_values(spark):
    df = spark.createDataFrame([("a",), ("z",)], "c string")
    assert sorted(r.o for r in P.map_label(df, "c", {"a": "A"}, "o", drop_unmapped=False).collect()) == ["A", "z"]


def test_markers_go_anywhere(spark):
    df = spark.createDataFrame([("a##b",), ("x\u2581y",), ("##",)], "t string")
    assert [r[0] for r in df.select(P.clean_token("t")).collect()] == ["ab", "xy", None]


def test_three_views_have_distinct_keys(spark):
    df = spark.createDataFrame([(i, *(f"summary {i} {v}." for v in range(3)), "sentence one.") for i in range(4)], "row_id long, a string, b string, c string, s string")
    out = triplets.two_view_union(df, views=(("a", "s"), ("b", "s"), ("c", "s")))
    assert out.count() == out.select("row_id").distinct().count() == 12


def test_checkpoint_folder_must_be_shared_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(Conf)

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        session.checkpoint_dir(Session())


def test_long_embedding_keeps_texts_without_tokens(spark):
    tokens = spark.createDataFrame([(1, 0, "a")], "row_id long, pos int, token string")
    vectors = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 0.0), ("<pad>", 0, 0.0), ("<pad>", 1, 1.0)], "token string, j int, v double")
    texts = spark.createDataFrame([(1,), (2,)], "row_id long")
    got = {(r.row_id, r.j): (r.n, r.e) for r in scoring.embed_texts(tokens, vectors, length=2, texts=texts).collect()}
    assert got == {(1, 0): (1, 0.5), (1, 1): (1, 0.5), (2, 0): (0, 0.0), (2, 1): (0, 1.0)}


@pytest.mark.parametrize("limit", [scoring.BROADCAST_LIMIT_BYTES, 0])
def test_bertscore_keeps_every_pair_and_blocks_agree(spark, limit, monkeypatch):
    monkeypatch.setattr(scoring, "MATCH_CELLS", 1)
    pairs = spark.createDataFrame([(1, 10, 11), (2, 10, 12), (3, 13, 12)], "pair_id long, cand_id long, ref_id long")
    tokens = spark.createDataFrame([(10, "a"), (10, "b"), (11, "a"), (11, "b")], "text_id long, token string")
    vectors = spark.createDataFrame([(t, j, float(t == "ab"[j])) for t in "ab" for j in (0, 1)], "token string, j int, v double")
    got = {r.pair_id: (r.bert_p, r.bert_r, r.bert_f) for r in scoring.bertscore(pairs, tokens, vectors, limit=limit).collect()}
    assert got == {1: (1.0, 1.0, 1.0), 2: (0.0, 0.0, 0.0), 3: (0.0, 0.0, 0.0)}


@pytest.mark.parametrize("stem", [False, True])
def test_null_text_scores_null(spark, stem):
    df = spark.createDataFrame([(1, "the cat", "the cat"), (2, None, "the cat"), (3, "", "the cat")], "pair_id long, gen string, ref string")
    arrays = lexical.token_arrays(df, "pair_id", "gen", "ref", stem)
    for scored, col in ((lexical.rouge_n(arrays, 1), "r1f1"), (lexical.rouge_l(arrays), "rLf1"), (lexical.meteor(arrays), "meteor")):
        got = {r.pair_id: r[col] for r in scored.collect()}
        assert got[1] > 0.9 and got[2] is None and got[3] == 0.0


def test_learned_score_keeps_rows_with_a_null_feature(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 1.0), (3, 0.5, 0.5), (4, None, 1.0)], "pair_id long, f double, label double")
    scored = score_all.predict_linear(df, ["f"], score_all.fit_linear(df, ["f"]))
    got = {r.pair_id: r.learned for r in scored.collect()}
    assert len(got) == 4 and got[4] is None and abs(got[3] - 0.5) < 1e-6


def test_duplicate_metric_rows_keep_the_smallest_score(spark):
    human = spark.createDataFrame([("d", 1, 1, 5.0)], "dataset string, row_id long, label int, human_score double")
    metrics = spark.createDataFrame([("d", 1, 1, "m", 0.7), ("d", 1, 1, "m", 0.2)], "dataset string, row_id long, label int, metric string, score double")
    assert [r.score for r in agreement.attach_human(human, metrics).collect()] == [0.2]

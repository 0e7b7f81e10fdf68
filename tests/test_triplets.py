"""Edge rows and invariants of triplet construction and negative sampling."""

import pytest
from pyspark.sql import functions as F

from tripletframe.functions import columns as P
from tripletframe.operators import triplets as T


def test_nli_pivot_edges(spark):
    rows = [
        (1, "p1", "c1", 0), (2, "p1", "i1", 2), (3, "p1", "c1b", 0),  # two hypotheses of one role: first wins
        (4, "p2", "c2", 0),                                            # only one role -> dropped
        (5, None, "x", 0), (6, None, "y", 2),                          # null premise vanishes
        (7, "p3", "c3", 0), (8, "p3", "i3", 2), (9, "p3", "u3", -1),   # unmapped label ignored
        (10, "p3", "n3", 1),
    ]
    df = spark.createDataFrame(rows, "row_id long, premise string, hypothesis string, label int")
    out = {r["premise"]: r for r in T.nli_pivot(df).collect()}
    assert set(out) == {"p1", "p3"}
    assert out["p1"]["correct_answer"] == "c1" and out["p1"]["neutral"] is None
    assert out["p3"]["neutral"] == "n3" and out["p3"]["incorrect_answer"] == "i3"


def test_negatives_batch_invariants(spark):
    df = spark.range(0, 1000).select(F.col("id").alias("row_id"), F.concat(F.lit("a"), F.col("id").cast("string")).alias("correct_answer"))
    out = T.sample_negatives_batch(df, batch_size=64).collect()
    assert len(out) == 1000
    assert all(r["incorrect_answer"] != r["correct_answer"] for r in out)


def test_negatives_keep_every_row_at_any_batch_and_bucket_size(spark):
    df = spark.range(0, 401).select(F.col("id").alias("row_id"), F.concat(F.lit("a"), F.col("id").cast("string")).alias("correct_answer"))
    for batch in (2, 3, 4, 100, 400, 401):
        out = T.sample_negatives(df, batch_size=batch).collect()
        assert len(out) == 401 and all(r["incorrect_answer"] != r["correct_answer"] for r in out), batch
    whole = {tuple(r) for r in T.sample_negatives(df).collect()}
    assert whole == {tuple(r) for r in T.sample_negatives(df, rows_per_bucket=16).collect()}  # buckets change the plan only
    with pytest.raises(ValueError):
        T.sample_negatives(df, batch_size=1)


def test_negative_of_single_row_batch_is_dropped(spark):
    df = spark.createDataFrame([(1, "only")], "row_id long, correct_answer string")
    assert T.sample_negatives(df).count() == 0


def test_all_answers_equal_keep_positional_semantics(spark):
    df = spark.createDataFrame([(i, "same") for i in range(5)], "row_id long, correct_answer string")
    out = T.sample_negatives(df).collect()
    assert len(out) == 5 and all(r["incorrect_answer"] == "same" for r in out)


def test_caption_triplets_edges(spark):
    rows = [
        (1, "imgA", "a one"), (2, "imgA", "a two"), (3, "imgA", "a two"),  # duplicate text
        (4, "imgB", "b only"),                                            # one caption: no positive
        (5, "imgC", "c same"), (6, "imgC", "c same"),                     # identical captions: no positive
        (7, "imgD", "d one"), (8, "imgD", "d two"),
    ]
    df = spark.createDataFrame(rows, "row_id long, image_id string, caption string")
    out = T.caption_triplets(df).collect()
    ids = {r["row_id"] for r in out}
    assert ids == {1, 2, 3, 7, 8}
    img = {r[0]: r[1] for r in rows}
    by_text = {r[2]: r[1] for r in rows}
    for r in out:
        assert r["correct_answer"] != r["premise"]
        assert by_text[r["correct_answer"]] == img[r["row_id"]]
        assert by_text[r["incorrect_answer"]] != img[r["row_id"]]


def test_single_image_gives_nothing(spark):
    df = spark.createDataFrame([(1, "i", "x"), (2, "i", "y")], "row_id long, image_id string, caption string")
    assert T.caption_triplets(df).count() == 0


def test_answer_list_cleaning(spark):
    rows = [
        (1, [], ["aaa", "bbb"]),
        (2, ["only one"], ["aaa", "bbb"]),
        (3, ["I have no comment", "ok answer", "yes", "no"], ["I have no comment", "wrong one", "bad two"]),
        (4, ["first right", "second right", "third right"], ["x", "wrong a", "wrong b"]),
    ]
    df = spark.createDataFrame(rows, "q_id long, correct_answers array<string>, incorrect_answers array<string>")
    out = {r["q_id"]: r for r in T.answer_list_triplets(df).collect()}
    assert set(out) == {3, 4}
    assert out[3]["premise"] == "yes" and out[3]["correct_answer"] == "ok answer"
    assert out[4]["premise"] == "third right" and out[4]["incorrect_answer"] == "wrong a"


def test_head_sentence_edges(spark):
    df = spark.createDataFrame([("no period",), ("",), (".lead",), ("A. B.",)], "t string")
    got = [r[0] for r in df.select(P.head_sentence("t")).collect()]
    assert got == ["no period", "", "", "A"]


def test_balanced_pairs_small_class(spark):
    rows = [(i, 1) for i in range(10)] + [(100 + i, 0) for i in range(3)]
    df = spark.createDataFrame(rows, "row_id long, label int")
    with pytest.raises(ValueError):
        T.balanced_pairs(df, k=5)
    assert T.balanced_pairs(df, k=3).count() == 6
    out = T.balanced_pairs(df, k=5, strict=False).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in out} == {1: 5, 0: 3}


def test_reservoir_sample_size(spark):
    df = spark.range(0, 5000).withColumnRenamed("id", "row_id")
    assert T.reservoir_sample(df, k=123).count() == 123


def test_null_answer_negative_is_dropped_in_batch_mode(spark):
    rows = [(1, "a"), (2, None), (3, "c")]
    df = spark.createDataFrame(rows, "row_id long, correct_answer string")
    out = T.sample_negatives_batch(df, batch_size=10).collect()
    assert all(r["incorrect_answer"] is not None for r in out)
    assert {r["row_id"] for r in out} <= {1, 2, 3} and len(out) >= 1

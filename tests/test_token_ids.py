"""P14 in slices: ids of whole token lists, repeated and null keys, and no row a token in the plan's shuffles."""

import pytest

from tripletframe.operators import token_ids as K
from tripletframe.plans import column_queries as Q


@pytest.mark.parametrize("slice_tokens", [1 << 20, 4])
def test_ids_against_plain_python(spark, monkeypatch, slice_tokens):
    monkeypatch.setattr(K, "SLICE_TOKENS", slice_tokens)
    vocab = {"a": 3, "b": 1, "c": 2}
    rows = [(1, ["a", "b", "a"]), (2, ["c"]), (2, ["a", "b"]), (None, ["b"]), (None, ["a", "zz"]), (3, ["zz"]), *((10 + i, ["abc"[i % 3]] * (i % 4 + 1)) for i in range(30))]
    lists = spark.createDataFrame(rows, "row_id long, tokens array<string>").repartition(3)
    got = K.token_ids(lists, spark.createDataFrame(list(vocab.items()), "token string, id int")).collect()
    parts = {}
    for k, t in rows:
        parts.setdefault(k, []).extend((p, vocab[w]) for p, w in enumerate(t) if w in vocab)
    assert sorted((repr(r.row_id), r.ids) for r in got) == sorted((repr(k), [i for _, i in sorted(v)]) for k, v in parts.items() if v)


def test_tokens_of_texts_are_not_shuffled_one_by_one(spark, tmp_path):
    rows = [(1, "Some words, some more words"), (2, None), (3, ""), (4, "words words"), (4, "more"), (5, "--")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = Q.p14_encode_pad(spark, str(tmp_path))
    got = {r.row_id: (r.n_tokens, [int(i) for i in r.encoded.split(",")]) for r in df.collect()}
    ids = {t.token: t.id for t in Q.vocabulary(spark, str(tmp_path)).collect()}
    assert sorted(ids) == ["more", "some", "words"] and sorted(ids.values()) == [1, 2, 3]
    want = {1: [ids[w] for w in "some words some more words".split()], 4: [*sorted([ids["words"], ids["more"]]), ids["words"]]}
    assert got == {k: (len(v), v + [0] * (Q.ENCODE_LENGTH - len(v))) for k, v in want.items()}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "posexplode" not in plan

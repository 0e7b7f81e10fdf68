"""E2 in slices: the same sums whatever the slices, odd keys and tokens included, and no vector table on the driver."""

from collections import defaultdict

import numpy as np
import pytest

from tripletframe.operators import scoring

TOKENS = [(1, "a"), (1, "b"), (1, "a"), (2, "b"), (2, "zz"), (3, "zz"), (None, "a"), (5, "c"), (5, None), *((10 + i, "abc"[i % 3]) for i in range(40))]
VECTORS = {"a": [1.0, 2.0], "b": [0.5, -1.0], "c": [3.0, 0.0]}
PAD, LENGTH = [0.25, 0.5], 2
TEXTS = [1, 2, 3, 4, 4, 5, None, *range(10, 50)]


@pytest.fixture(params=[1 << 20, 8])
def slice_tokens(request, monkeypatch):
    monkeypatch.setattr(scoring, "SLICE_TOKENS", request.param)


def frames(spark):
    tokens = spark.createDataFrame([(k, i, t) for i, (k, t) in enumerate(TOKENS)], "row_id long, pos int, token string").repartition(3)
    long = spark.createDataFrame([(t, j, v) for t, vec in {**VECTORS, "<pad>": PAD}.items() for j, v in enumerate(vec)], "token string, j int, v double")
    return tokens, long, spark.createDataFrame([(k,) for k in TEXTS], "row_id long")


def plain(known_only):
    """(key, n, embedding) of every key with a known token."""
    bags, n = defaultdict(list), defaultdict(int)
    for k, t in TOKENS:
        n[k] += t in VECTORS if known_only else 1
        if t in VECTORS:
            bags[k].append(VECTORS[t])
    return {k: (n[k], ((np.sum(b, axis=0) + max(LENGTH - n[k], 0) * np.array(PAD)) / max(n[k], LENGTH)).round(9).tolist()) for k, b in bags.items()}


def test_long_form_against_plain_python(spark, slice_tokens):
    tokens, long, texts = frames(spark)
    got = sorted((repr(r.row_id), r.n, r.j, round(r.e, 9)) for r in scoring.embed_texts(tokens, long, length=LENGTH, texts=texts).collect())
    want = [(repr(k), n, j, x) for k, (n, e) in plain(False).items() for j, x in enumerate(e)]
    want += [(repr(k), 0, j, x) for k in (4, 4, None) for j, x in enumerate(PAD)]  # 3 has tokens, none of them known: absent
    assert got == sorted(want)


def test_arrays_against_plain_python(spark, slice_tokens):
    tokens, long, texts = frames(spark)
    vectors = scoring.vectors_to_arrays(long)
    read = lambda df: sorted((repr(r.row_id), r.n, [round(x, 9) for x in r.emb]) for r in df.collect())
    want = {k: (n, e) for k, (n, e) in plain(True).items()}
    assert read(scoring.embed_texts_arrays(tokens, vectors, PAD, length=LENGTH)) == sorted((repr(k), *v) for k, v in want.items())
    assert read(scoring.embed_texts_arrays(tokens, vectors, PAD, length=LENGTH, texts=texts)) == sorted((repr(k), *(want[k] if k in want and k is not None else (0, PAD))) for k in TEXTS)


def test_vectors_are_neither_broadcast_nor_kept(spark):
    tokens, long, texts = frames(spark)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (
            scoring.embed_texts(tokens, long, length=LENGTH, texts=texts), scoring.embed_texts_arrays(tokens, scoring.vectors_to_arrays(long), PAD, length=LENGTH, texts=texts))]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert not any("Broadcast" in p or "InMemory" in p for p in plans)

"""I1 in slices of pairs: the same attributions whatever the slices, repeated and null keys included, and no row a pair and token shuffled."""

import re

import numpy as np
import pytest

from tripletframe.operators import attribution as I

VECTORS = {"a": [1.0, 0.5], "b": [0.2, 1.0], "c": [-0.4, 0.7], "<pad>": [0.1, 0.3], "<unk>": [0.0, 0.2]}
TEXTS = {"s": "a b", "t": "c b a c b", "u": "b zz a", "v": "c"}
PAIRS = [(1, "s", "t", "reference"), (2, "t", "s", "zero"), (3, "u", "t", "reference"), (4, "t", "u", "reference"), (5, None, "s", "zero"), (6, "v", None, "reference"),
         (7, "none", "t", "reference"), (8, "u", "none", None), *((10 + i, "stuv"[i % 4], "stuv"[i * 7 // 4 % 4], ("zero", "reference")[i % 2]) for i in range(24))]
LENGTH, STEPS = 3, 40


def frames(spark, pairs):
    tokens = [(k, i, w) for k, t in TEXTS.items() for i, w in enumerate(t.split())]
    return (spark.createDataFrame(pairs, "pair_id long, in_id string, tgt_id string, baseline string").repartition(3),
            spark.createDataFrame(tokens, "text_id string, pos int, token string").repartition(3),
            spark.createDataFrame(list(VECTORS.items()), "token string, vec array<double>"))


def plain(in_id, tgt_id, baseline):
    """(position, attribution) rows, cos_x and cos_base of one pair by the definition, position by position."""
    v = {k: np.array(x) for k, x in VECTORS.items()}
    own, other = (TEXTS.get(k, "").split() for k in (in_id, tgt_id))
    n = max(len(own), LENGTH)
    at = lambda words, p: None if p < len(words) and words[p] not in v else v[words[p]] if p < len(words) else v["<pad>"]
    x, b = np.zeros((n, 2)), np.zeros((n, 2))
    for p in range(n):
        o = at(other, p)
        base = v["<unk>"] if baseline == "zero" else v["<pad>"] if o is None else o
        if at(own, p) is not None:  # a token without a vector has no row
            x[p], b[p] = at(own, p), base
    t = sum((v[w] for w in other if w in v), np.zeros(2)) + max(LENGTH - len(other), 0) * v["<pad>"]
    ex, eb, et = x.sum(0) / n, b.sum(0) / n, t / max(len(other), LENGTH)
    g = I.path_gradient(ex, eb, et, STEPS)
    attr = (x - b) @ g / n
    cos = lambda p, q: p @ q / np.linalg.norm(p) / np.linalg.norm(q)
    rows = [(p, attr[p]) for p, w in enumerate(own) if w in v] + [(-1, attr[len(own):].sum())]
    return rows, cos(ex, et), cos(eb, et)


@pytest.mark.parametrize("slice_tokens", [1 << 18, 8])
def test_against_plain_python(spark, monkeypatch, slice_tokens):
    monkeypatch.setattr(I, "SLICE_TOKENS", slice_tokens)
    pairs = [p for p in PAIRS if p[3]]
    att, tot = I.token_attribution(*frames(spark, pairs), length=LENGTH, n_steps=STEPS)
    want = {p[0]: plain(*p[1:]) for p in pairs}
    got = sorted((r.pair_id, r.pos, round(r.attr, 9) + 0.0) for r in att.collect())
    assert got == sorted((k, p, round(x, 9) + 0.0) for k, (rows, _, _) in want.items() for p, x in rows)
    rows = {r.pair_id: r for r in tot.collect()}
    assert set(rows) == set(want)
    for k, (parts, cos_x, cos_base) in want.items():
        r = rows[k]
        assert np.allclose([r.total, r.cos_x, r.cos_base, r.delta], [sum(x for _, x in parts), cos_x, cos_base, sum(x for _, x in parts) - cos_x + cos_base])


def test_rows_of_one_pair_id_share_their_sums_and_null_ids_have_pads_alone(spark):
    pairs = [(1, "s", "t", "zero"), (1, "s", "t", "zero"), (None, "s", "t", "zero")]
    att, tot = I.token_attribution(*frames(spark, pairs), length=LENGTH, n_steps=STEPS)
    assert [(r.pair_id, r.pos) for r in att.where("pair_id is null").collect()] == [(None, -1)]
    assert att.where("pair_id = 1").count() == 2 * 2 * 2 + 2  # each row's tokens under each row's gradient, and the pads of each
    assert [r.pair_id for r in tot.collect()] == [1, 1]


def test_no_vector_travels_with_a_pair(spark):
    """Vectors reach a slice once for each of its distinct tokens: the plan sorts and shuffles them on no other way."""
    _, tot = I.token_attribution(*frames(spark, PAIRS), length=LENGTH, n_steps=STEPS)
    plan = tot._jdf.queryExecution().optimizedPlan().toString()
    joins = re.findall(r"Join \w+, \((\S+) = (\S+)\)", plan)
    assert len([j for j in joins if any("token" in c for c in j)]) == 1 and "collect_list(vec" not in plan and "collect_list(v_" not in plan

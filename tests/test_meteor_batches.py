"""METEOR deals its tokens to as many tasks as their number asks for."""

import pytest

from tripletframe.operators import lexical as L


def brute(hyp, ref):
    """The k-th last free occurrence of a word, then of a root, with the k-th last on the other side."""
    free, hits = ([*enumerate(hyp)], [*enumerate(ref)]), []
    for term in (lambda w: w, L.porter_stem):
        a, b = ({}, {})
        for side, to in zip(free, (a, b)):
            for i, w in reversed(side):
                to.setdefault(term(w), []).append(i)
        hits += [x for t in a for x in zip(a[t], b.get(t, []))]
        gone = [{x[k] for x in hits} for k in (0, 1)]
        free = tuple([(i, w) for i, w in side if i not in gone[k]] for k, side in enumerate(free))
    hits.sort()
    m = len(hits)
    if not m:
        return 0.0
    chunks = 1 + sum((i + 1, j + 1) != n for (i, j), n in zip(hits, hits[1:]))
    p, r = m / len(hyp), m / len(ref)
    return (1 - 0.5 * (chunks / m) ** 3) * p * r / (0.9 * p + 0.1 * r)


def test_meteor_deals_tokens_to_tasks_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(L, "TASK_TOKENS", 100, raising=False)
    words = "run running runs cat cats the a sat sitting mat".split()
    pairs = [(i, [words[(i * j + j // 3) % 10] for j in range(i % 9)], [words[(j * j + i) % 10] for j in range(i % 7)]) for i in range(60)]
    found = L.meteor(spark.createDataFrame(pairs, "pair_id long, g array<string>, r array<string>"))
    assert {r["pair_id"]: r["meteor"] for r in found.collect()} == pytest.approx({k: brute(g, r) for k, g, r in pairs})
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()

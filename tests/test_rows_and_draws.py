"""Rows are neither lost nor given their own text: token-less texts (E2, E3, I1), distinct negatives (T3, T4), open sources (M12), first evaluation."""

from collections import Counter

import numpy as np
import pytest

from tripletframe.operators import attribution, corpus, mixing, training, triplets


def repeated(spark):
    """A third of the rows share one text, another text is frequent, the rest are rare or unique; groups of one text exist."""
    rows = [(i, "g", "hot") for i in range(40)] + [(40 + i, "g", "warm") for i in range(15)] + [(60 + i, "g", f"t{i % 20}") for i in range(45)]
    rows += [(200 + i, "one", "same") for i in range(5)] + [(300, "single", "x"), (301, "g", None), (302, "h", "a"), (303, "h", "b")]
    return rows, spark.createDataFrame(rows, "row_id long, grp string, correct_answer string").repartition(4)


@pytest.mark.parametrize("buckets", [None, 4])
@pytest.mark.parametrize("batch", [None, 7])
def test_distinct_negatives_are_other_texts_of_the_group(spark, buckets, batch):
    rows, df = repeated(spark)
    got = triplets.sample_negatives(df, group_cols=["grp"], batch_size=batch, distinct_text=True, rows_per_bucket=buckets).collect()
    texts = {g: {t for _, gg, t in rows if gg == g and t is not None} for g in ("g", "h")}
    assert all(r.incorrect_answer != r.correct_answer and r.incorrect_answer in texts[r.grp] for r in got)
    assert {r.grp for r in got} <= {"g", "h"} and len({r.row_id for r in got}) == len(got)
    if batch is None:
        assert {r.row_id for r in got} == {i for i, g, t in rows if g in texts and t is not None}
        again = triplets.sample_negatives(df.repartition(1), group_cols=["grp"], distinct_text=True).collect()
        assert Counter(map(tuple, got)) == Counter(map(tuple, again))  # neither partitions nor buckets matter


def test_distinct_negatives_follow_the_rows_of_the_texts(spark):
    rows = [(i, "hot") for i in range(600)] + [(600 + i, "warm") for i in range(300)] + [(900 + i, "cold") for i in range(100)]
    df = spark.createDataFrame(rows, "row_id long, correct_answer string")
    got = Counter((r.correct_answer, r.incorrect_answer) for r in triplets.sample_negatives(df, distinct_text=True).collect())
    assert sum(got.values()) == 1000 and got["hot", "warm"] + got["hot", "cold"] == 600
    assert abs(got["hot", "warm"] / 600 - 0.75) < 0.08 and abs(got["warm", "hot"] / 300 - 6 / 7) < 0.08


def test_distinct_negatives_of_an_empty_table(spark):
    df = spark.createDataFrame([], "row_id long, correct_answer string")
    assert triplets.sample_negatives(df, distinct_text=True).count() == 0


def test_open_sources_are_those_of_the_level_and_below(spark):
    levels = spark.createDataFrame([("a", 1), ("b", 1), ("c", 3)], "source string, level int")
    steps = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 9), (5, 0), (6, None)], "step int, level int")
    got = sorted((r.step, r.source, r.source_level) for r in mixing.open_sources(steps, levels).collect())
    assert got == sorted((s, x, lv) for s, open_ in ((1, "ab"), (2, "ab"), (3, "abc"), (4, "abc")) for x, lv in (("a", 1), ("b", 1), ("c", 3)) if x in open_)
    plan = mixing.open_sources(steps, levels)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_every_run_has_a_point_before_its_first_step(spark):
    trace = spark.createDataFrame([(1, i, 0.5, 0.25) for i in range(1, 9)], "run long, step int, pos_sim double, neg_sim double")
    runs = spark.createDataFrame([(1,), (1,), (2,)], "run long")
    got = training.eval_points(trace, 3, 8, runs=runs).collect()
    first = [r for r in got if r.kind == "initial"]
    assert sorted((r.run, r.step, r.epoch, r.steps_seen, r.train_pos_sim) for r in first) == [(1, 0, 0, 0, None), (2, 0, 0, 0, None)]
    assert sorted(r.step for r in got if r.run == 1) == [0, 3, 4, 6, 8]


def test_bag_encoder_takes_texts_without_tokens(spark):
    import pandas as pd

    made = []

    def vector(t):
        made.append(t)
        return np.array([len(t), 1.0])

    m = corpus.BagEncoder(vector, 2, 3, np.array([0.5, -1.0]))
    got = m.predict(pd.DataFrame({"row_id": [1, 2, 3, 4], "tokens": [["a", "bb", "a", "ccc"], None, [], ["bb"]]}))
    e = {r: got[got.row_id == r].sort_values("j").e.tolist() for r in (1, 2, 3, 4)}
    assert e == {1: [7 / 4, 1.0], 2: [0.5, -1.0], 3: [0.5, -1.0], 4: [1.0, -1 / 3]} and sorted(made) == ["a", "bb", "ccc"]


def test_attribution_keeps_pairs_without_input_tokens(spark):
    vec = spark.createDataFrame([("a", [1.0, 0.5]), ("b", [0.2, 1.0]), ("<pad>", [0.1, 0.3]), ("<unk>", [0.0, 0.2])], "token string, vec array<double>")
    tokens = spark.createDataFrame([(1, 0, "a"), (2, 0, "b"), (2, 1, "a")], "text_id long, pos int, token string")
    pairs = spark.createDataFrame([(10, 1, 2, "reference"), (11, 9, 2, "reference"), (12, 9, 2, "zero"), (13, 1, 9, "reference")],
                                  "pair_id long, in_id long, tgt_id long, baseline string")
    att, tot = attribution.token_attribution(pairs, tokens, vec, length=3, n_steps=300)
    assert {r.pair_id for r in tot.collect()} == {10, 11, 12, 13}
    assert all(abs(r.delta) < 1e-3 for r in tot.collect())
    assert Counter(r.pair_id for r in att.collect()) == {10: 2, 11: 1, 12: 1, 13: 2}


def _cos(a, b):
    return (a * b).sum(1) / np.linalg.norm(a, axis=1) / np.linalg.norm(b, axis=1)


def test_training_run_reads_its_batches_and_keeps_the_best_matrix(spark):
    """Each step's loss is that of its M9 batch, points come at the stated steps, the best matrix is that of the best point."""
    rng = np.random.default_rng(7)
    rows = []
    for i in range(95):
        ref, noise, neg = rng.normal(size=4), rng.normal(size=4), rng.normal(size=4)
        rows.append((i, ref.tolist(), (ref + noise).tolist(), (0.6 * ref + neg).tolist()))
    df = spark.createDataFrame(rows, "row_id long, ref array<double>, pos array<double>, neg array<double>").repartition(3)
    train, valid = df.where("row_id < 75"), df.where("row_id >= 75")
    best, steps, points = training.train_projection(train, valid, 4, batch_size=20, epochs=4, eval_every=2, lr=0.05)
    assert [s["step"] for s in steps] == list(range(1, 13))  # 3 whole batches an epoch
    assert [(p["step"], p["kind"]) for p in points[:5]] == [(0, "initial"), (1, "mid_epoch"), (2, "interval"), (3, "epoch_end"), (4, "mid_epoch")]
    x = {r[0]: [np.array(v) for v in r[1:]] for r in rows}
    batch = [r.row_id for r in mixing.epoch_batches(train.select("row_id"), 20, epoch=0).where("batch = 0").collect()]
    ref, pos, neg = (np.array([x[i][k] for i in batch]) for k in range(3))
    assert len(batch) == 20 and abs(steps[0]["loss"] - np.maximum(1 + _cos(ref, neg) - _cos(ref, pos), 0).mean()) < 1e-9
    held = [np.array([x[i][k] for i in range(75, 95)]) @ best for k in range(3)]
    diffs = [p["pos_sim"] - p["neg_sim"] for p in points]
    assert abs((_cos(held[0], held[1]) - _cos(held[0], held[2])).mean() - max(diffs)) < 1e-9
    assert points[-1]["kind"] == "epoch_end" and max(diffs) > diffs[0]
    trace = spark.createDataFrame([(0, p["step"], p["pos_sim"], p["neg_sim"]) for p in points], "run int, step int, pos_sim double, neg_sim double")
    marked = {r.step for r in training.best_checkpoint(trace).collect() if r.is_best}
    top, want = 0.0, set()
    for p, d in zip(points, diffs):
        if d > top:
            top = d
            want.add(p["step"])
    assert marked == want


def test_training_on_fewer_rows_than_a_batch_only_evaluates(spark):
    rows = [(i, [1.0, 0.0], [1.0, 0.1], [0.0, 1.0]) for i in range(3)]
    df = spark.createDataFrame(rows, "row_id long, ref array<double>, pos array<double>, neg array<double>")
    best, steps, points = training.train_projection(df, df, 2, batch_size=10, epochs=1, eval_every=1)
    assert steps == [] and [p["kind"] for p in points] == ["initial"] and (best == np.eye(2)).all()

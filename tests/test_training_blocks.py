"""R3 in blocks of batches: the steps of a plain sequential run, in jobs that grow with the blocks and not with the steps."""

import numpy as np
import pytest

from tripletframe.operators import mixing, training


def frame(spark, n, dim=3):
    rng = np.random.default_rng(3)
    rows = [(i, *(rng.normal(size=dim).tolist() for _ in range(3))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "row_id long, ref array<double>, pos array<double>, neg array<double>").repartition(3)


@pytest.mark.parametrize("block_rows", [1, 30, 20_000])
def test_steps_equal_a_sequential_run(spark, monkeypatch, block_rows):
    monkeypatch.setattr(training, "BLOCK_ROWS", block_rows)
    rows, df = frame(spark, 47)
    best, steps, points = training.train_projection(df, df, 3, batch_size=10, epochs=2, eval_every=3, lr=0.05)
    x = {r[0]: [np.array(v) for v in r[1:]] for r in rows}
    mat, m, v, step, want, mats = np.eye(3), np.zeros((3, 3)), np.zeros((3, 3)), 0, [], {0: np.eye(3)}
    for epoch in range(2):
        drawn = mixing.epoch_batches(df.select("row_id"), 10, epoch=epoch).collect()
        for b in range(4):
            step += 1
            part = [np.array([x[r.row_id][k] for r in drawn if r.batch == b]) for k in range(3)]
            loss, g = training._grad_partition(mat, 1.0, *part)
            want.append(loss / 10)
            m, v = 0.9 * m + 0.1 * g / 10, 0.999 * v + 0.001 * (g / 10) ** 2
            mat = mat - 0.05 * 0.95**epoch * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            mats[step] = mat
    assert np.allclose([s["loss"] for s in steps], want, atol=1e-9) and [s["step"] for s in steps] == list(range(1, 9))
    whole = [np.array([r[k] for r in rows]) for k in (1, 2, 3)]
    assert [(p["step"], p["kind"]) for p in points] == [(0, "initial"), (2, "mid_epoch"), (3, "interval"), (4, "epoch_end"), (6, "mid_epoch"), (8, "epoch_end")]
    assert np.allclose([p["loss"] for p in points], [training._grad_partition(mats[p["step"]], 1.0, *whole)[0] / 47 for p in points], atol=1e-9)
    top = max(points, key=lambda p: p["pos_sim"] - p["neg_sim"])
    assert np.allclose(best, mats[top["step"]] if top["pos_sim"] > top["neg_sim"] else np.eye(3), atol=1e-9)


def test_jobs_do_not_grow_with_the_steps(spark):
    _, df = frame(spark, 200)
    sc = spark.sparkContext
    sc.setJobGroup("train-jobs", "training")
    try:
        _, steps, points = training.train_projection(df, df, 3, batch_size=4, epochs=1, eval_every=2)
    finally:
        sc.setJobGroup("", "")
    assert len(steps) == 50 and len(points) == 27
    assert len(sc.statusTracker().getJobIdsForGroup("train-jobs")) < 40

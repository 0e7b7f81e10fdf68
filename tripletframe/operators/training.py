"""Training trace and projection fitting (R1-R3) as Spark jobs.

R1/R2 work on the (run, step) trace. R3 fits the learned metric's projection
matrix ``T`` by the triplet hinge on cosine: each step broadcasts ``T``, every
partition returns one partial gradient (d x d), and the driver holds only ``T``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from copy import copy

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripletframe.operators.indexing import bucketed_running, buckets_for, value_range_bucket, zero_of


# ------------------------------------------------------------------ R1

def eval_trace(trace: DataFrame, every: int, group_cols: Sequence[str] = ("run",), step_col: str = "step") -> DataFrame:
    """Metrics at fixed step intervals: mean pos / neg similarity and count per (run, interval).

    Interval ``k`` holds steps ``(k-1)*every+1 .. k*every`` (evaluated at step k*every);
    averages divide by the steps actually seen.
    """
    k = F.ceil(F.col(step_col) / F.lit(every)).cast("long")
    return trace.groupBy(*group_cols, k.alias("interval")).agg(
        F.count(F.lit(1)).alias("n_steps"),
        F.avg("pos_sim").alias("pos_sim"),
        F.avg("neg_sim").alias("neg_sim"),
        F.avg(F.col("pos_sim") - F.col("neg_sim")).alias("diff"),
        F.max(step_col).alias("last_step"),
    )


def eval_points(trace: DataFrame, every: int, steps_per_epoch: int, group_cols: Sequence[str] = ("run",),
                step_col: str = "step", runs: DataFrame | None = None) -> DataFrame:
    """R1 at the evaluation points: every ``every`` steps, at mid-epoch and at epoch end.

    Each point carries the running mean of pos / neg similarity over the
    steps seen so far in its epoch (the reference divides by the full epoch
    length mid-epoch; here by the steps seen). Running sums use bucketed
    prefix sums per (run, epoch); no per-run single-task window. Sums are
    kept in integer micro-units, so they are exact and independent of the
    order partitions are added in, and the mean is rounded half-up to 1e-6
    with integer arithmetic. ``runs`` names the runs, also those without any
    step: each starts with the evaluation before its first step (point 0, kind
    ``initial``, no steps seen, null means).
    """
    g = list(group_cols)
    x = trace.withColumn("epoch", F.floor((F.col(step_col) - 1) / steps_per_epoch).cast("long")).withColumn(
        "step_in_epoch", (F.pmod(F.col(step_col) - 1, F.lit(steps_per_epoch)) + 1).cast("long"))
    st = x.agg(F.min(step_col).alias("lo"), F.max(step_col).alias("hi"), F.count(F.lit(1)).alias("c")).first()
    bkt = value_range_bucket(step_col, float(st["lo"] or 0), float(st["hi"] or 0), buckets_for(int(st["c"] or 0)))
    micro = 1_000_000
    x = bucketed_running(x, [*g, "epoch"], [step_col], bkt, {
        "_sp": ("sum", F.round(F.col("pos_sim") * micro).cast("long")),
        "_sn": ("sum", F.round(F.col("neg_sim") * micro).cast("long")),
        "_k": ("sum", F.lit(1).cast("long"))})

    def mean(total):  # floor((2 s + k) / (2 k)) micro-units: half-up, exact for integer operands
        return F.floor((2 * F.col(total) + F.col("_k")) / (2 * F.col("_k"))) / micro
    point = ((F.col(step_col) % every) == 0) | (F.col("step_in_epoch") == steps_per_epoch // 2) | (
        F.col("step_in_epoch") == steps_per_epoch)
    kind = (F.when(F.col("step_in_epoch") == steps_per_epoch, "epoch_end")
            .when(F.col("step_in_epoch") == steps_per_epoch // 2, "mid_epoch").otherwise("interval"))
    out = x.where(point).select(*g, F.col(step_col).cast("long").alias(step_col), "epoch", kind.alias("kind"), F.col("_k").alias("steps_seen"),
                                mean("_sp").alias("train_pos_sim"), mean("_sn").alias("train_neg_sim"))
    if runs is None:
        return out
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("double")
    first = runs.select(*g).distinct().select(*g, zero.alias(step_col), zero.alias("epoch"), F.lit("initial").alias("kind"), zero.alias("steps_seen"),
                                              none.alias("train_pos_sim"), none.alias("train_neg_sim"))
    return out.unionByName(first)


# ------------------------------------------------------------------ R2

def best_checkpoint(trace: DataFrame, group_cols: Sequence[str] = ("run",), step_col: str = "step",
                    steps_per_epoch: int | None = None) -> DataFrame:
    """R2: a step is 'best' when pos - neg strictly exceeds the best so far (starting at 0).

    The running maximum over strictly preceding steps uses bucketed prefix
    maxima (no per-run single-task window). Also tags the last step and, with
    ``steps_per_epoch``, half-epoch and epoch-end steps.
    """
    g = list(group_cols)
    x = trace.withColumn("diff", F.col("pos_sim") - F.col("neg_sim"))
    st = x.agg(F.min(step_col).alias("lo"), F.max(step_col).alias("hi"), F.count(F.lit(1)).alias("c")).first()
    bkt = value_range_bucket(step_col, float(st["lo"] or 0), float(st["hi"] or 0), buckets_for(int(st["c"] or 0)))
    x = bucketed_running(x, g, [step_col], bkt, {"prev_best": ("max", F.col("diff"))}, inclusive=False)
    x = x.withColumn("is_best", F.col("diff") > F.greatest(F.coalesce("prev_best", F.lit(0.0)), F.lit(0.0)))
    last = x.groupBy(*g).agg(F.max(step_col).alias("_last"))
    x = x.join(last, g).withColumn("is_last", F.col(step_col) == F.col("_last")).drop("_last")
    if steps_per_epoch:
        pos = F.pmod(F.col(step_col) - 1, F.lit(steps_per_epoch)) + 1
        x = x.withColumn("is_half_epoch", pos == steps_per_epoch // 2).withColumn("is_epoch_end", pos == steps_per_epoch)
    return x


# ------------------------------------------------------------------ R3

# Rows of a block of batches that one task steps through, and cells of the matrices it may return.
BLOCK_ROWS, BLOCK_CELLS = 20_000, 1 << 20

def _grad_partition(T_mat: np.ndarray, margin: float, ref: np.ndarray, pos: np.ndarray, neg: np.ndarray):
    """Loss sum and dLoss/dT for rows (ref, pos, neg) of sentence features (before projection)."""

    def proj(x):
        return x @ T_mat

    a, p, n = proj(ref), proj(pos), proj(neg)

    def cos_and_grads(u, v):
        nu = np.linalg.norm(u, axis=1, keepdims=True) + 1e-12
        nv = np.linalg.norm(v, axis=1, keepdims=True) + 1e-12
        c = (u * v).sum(axis=1, keepdims=True) / (nu * nv)
        du = v / (nu * nv) - c * u / (nu * nu)
        dv = u / (nu * nv) - c * v / (nv * nv)
        return c[:, 0], du, dv

    cp, dap, dpp = cos_and_grads(a, p)
    cn, dan, dnn = cos_and_grads(a, n)
    h = margin + cn - cp
    act = (h > 0).astype(np.float64)[:, None]
    loss = float(np.maximum(h, 0).sum())
    # dL/d(proj) for each input, then chain through proj(x) = x @ T
    ga = act * (dan - dap)
    gp = act * (-dpp)
    gn = act * dnn
    grad = ref.T @ ga + pos.T @ gp + neg.T @ gn
    return loss, grad


def fit_projection(
    triplets: DataFrame,
    dim: int,
    steps: int = 20,
    lr: float = 1e-2,
    decay: float = 0.05,
    margin: float = 1.0,
    steps_per_epoch: int = 10,
    seed: int = 42,
    checkpoint_every: int = 5,
) -> tuple[np.ndarray, list[dict]]:
    """Fit T (dim x dim) by the triplet hinge on cosine with Adam; lr decays by (1 - decay) per epoch.

    ``triplets``: (ref, pos, neg) arrays of sentence features. The feature
    table is persisted; each step is one job whose partitions return one
    gradient each. The lineage is cut with ``checkpoint()`` (shared folder).
    """
    rng = np.random.default_rng(seed)
    T_mat = np.eye(dim) + rng.normal(0, 0.01, size=(dim, dim))
    m = np.zeros_like(T_mat)
    v = np.zeros_like(T_mat)
    b1, b2, eps = 0.9, 0.999, 1e-8
    from tripletframe.session import checkpoint_dir

    checkpoint_dir(triplets.sparkSession)
    data = triplets.select("ref", "pos", "neg").checkpoint()
    n = data.count()
    spark = triplets.sparkSession
    out_schema = T.StructType([T.StructField("loss", T.DoubleType()), T.StructField("grad", T.ArrayType(T.DoubleType()))])
    trace = []
    for step in range(1, steps + 1):
        bT = spark.sparkContext.broadcast(T_mat)

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            Tm = bT.value
            tot_l, tot_g = 0.0, np.zeros_like(Tm)
            for b in batches:
                if len(b) == 0:
                    continue
                r = np.stack(b["ref"].map(lambda z: np.asarray(z, dtype=np.float64)).to_numpy())
                p = np.stack(b["pos"].map(lambda z: np.asarray(z, dtype=np.float64)).to_numpy())
                q = np.stack(b["neg"].map(lambda z: np.asarray(z, dtype=np.float64)).to_numpy())
                lo, g = _grad_partition(Tm, margin, r, p, q)
                tot_l += lo
                tot_g += g
            yield pd.DataFrame({"loss": [tot_l], "grad": [tot_g.ravel().tolist() + [tot_l]]})

        parts = data.mapInPandas(part, out_schema)
        # one partial gradient per partition, summed by position (d*d + 1 rows reach the driver: T itself)
        sums = parts.select(F.posexplode("grad").alias("i", "g")).groupBy("i").agg(F.sum("g").alias("g")).collect()
        bT.unpersist()
        vec = np.zeros(dim * dim + 1)
        for r in sums:
            vec[r["i"]] = r["g"]
        loss = vec[-1] / n
        g = vec[:-1].reshape(dim, dim) / n
        epoch = (step - 1) // steps_per_epoch
        lr_t = lr * (1 - decay) ** epoch
        m = b1 * m + (1 - b1) * g
        v = b2 * v + (1 - b2) * g * g
        mh = m / (1 - b1**step)
        vh = v / (1 - b2**step)
        T_mat = T_mat - lr_t * mh / (np.sqrt(vh) + eps)
        trace.append({"step": int(step), "epoch": int(epoch), "loss": float(loss), "lr": float(lr_t)})
    return T_mat, trace


def _triples(b: pd.DataFrame) -> list[np.ndarray]:
    return [np.stack([np.asarray(v, np.float64) for v in b[c]]) for c in ("ref", "pos", "neg")]


def _measure(T_mat: np.ndarray, margin: float, r: np.ndarray, p: np.ndarray, q: np.ndarray) -> list[float]:
    """Sums of loss, pos_sim and neg_sim over rows, and their number."""
    a, u, v = r @ T_mat, p @ T_mat, q @ T_mat
    norm = [np.linalg.norm(x, axis=1) for x in (a, u, v)]
    cp, cn = (a * u).sum(1) / (norm[0] * norm[1] + 1e-12), (a * v).sum(1) / (norm[0] * norm[2] + 1e-12)
    return [np.maximum(margin + cn - cp, 0).sum(), cp.sum(), cn.sum(), len(r)]


def _means(sums: np.ndarray) -> dict:
    return dict(zip(("loss", "pos_sim", "neg_sim"), (sums[:3] / max(sums[3], 1.0)).tolist()))


def _pass(data: DataFrame, T_mat: np.ndarray, margin: float) -> tuple[dict, np.ndarray]:
    """Means of loss, pos_sim and neg_sim over ``data(ref, pos, neg)`` and the mean gradient.

    Each task adds up its rows; the sums are added by position in Spark, so the driver receives
    four numbers and one matrix whatever the number of tasks.
    """
    spark = data.sparkSession
    shared = spark.sparkContext.broadcast(T_mat)  # dim x dim

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        T_ = shared.value
        sums, grad = np.zeros(4), np.zeros_like(T_)
        for b in batches:
            if len(b):
                r, p, q = _triples(b)
                grad += _grad_partition(T_, margin, r, p, q)[1]
                sums += _measure(T_, margin, r, p, q)
        yield pd.DataFrame({"s": [sums.tolist() + grad.ravel().tolist()]})

    cells = data.select("ref", "pos", "neg").mapInPandas(part, "s array<double>").select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    out = np.zeros(4 + T_mat.size)
    for r in cells.collect():
        out[r["i"]] = r["v"]
    shared.unpersist()
    return _means(out[:4]), out[4:].reshape(T_mat.shape) / max(out[3], 1.0)


def _evaluations(data: DataFrame, mats: list[np.ndarray], margin: float) -> list[dict]:
    """Means of loss, pos_sim and neg_sim over ``data(ref, pos, neg)`` with each of ``mats``: one pass over the rows for all of them."""
    shared = data.sparkSession.sparkContext.broadcast(mats)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(shared.value), 4))
        for b in batches:
            if len(b):
                rows = _triples(b)
                sums += [_measure(T_, margin, *rows) for T_ in shared.value]
        yield pd.DataFrame({"s": [sums.ravel().tolist()]})

    cells = data.select("ref", "pos", "neg").mapInPandas(part, "s array<double>").select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    out = np.zeros(4 * len(mats))
    for r in cells.collect():
        out[r["i"]] = r["v"]
    shared.unpersist()
    return [_means(s) for s in out.reshape(-1, 4)]


class Adam:
    """The matrix with Adam's moments; ``step`` counts from 1."""

    def __init__(self, mat: np.ndarray, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8):
        self.mat, self.m, self.v, self.b1, self.b2, self.eps = mat, np.zeros_like(mat), np.zeros_like(mat), b1, b2, eps

    def update(self, g: np.ndarray, step: int, rate: float) -> None:
        self.m, self.v = self.b1 * self.m + (1 - self.b1) * g, self.b2 * self.v + (1 - self.b2) * g * g
        self.mat = self.mat - rate * (self.m / (1 - self.b1 ** step)) / (np.sqrt(self.v / (1 - self.b2 ** step)) + self.eps)


def _run_steps(data: DataFrame, adam: Adam, margin: float, batches: range, first: int, rate: float, keep: set[int]) -> tuple[list[dict], dict[int, np.ndarray]]:
    """Steps ``first``, ``first + 1``, ... over the consecutive ``batches`` of ``data(batch, key, ref, pos, neg)``; ``adam`` goes on from them.

    A step needs the matrix of the step before, so consecutive short batches are taken in one task, one after
    another: its rows are at most BLOCK_ROWS. Returns the means of each step and the matrices after the steps in ``keep``.
    """
    shared = data.sparkSession.sparkContext.broadcast(adam)

    def run(b: pd.DataFrame) -> pd.DataFrame:
        own = copy(shared.value)  # the worker keeps the broadcast value for a task that is run again
        b = b.sort_values(["batch", "key"], kind="stable")
        at, rows, out = b["batch"].to_numpy(), _triples(b), []
        for step, k in enumerate(batches, first):
            part = [x[np.searchsorted(at, k) : np.searchsorted(at, k, "right")] for x in rows]
            sums = np.array(_measure(own.mat, margin, *part))
            own.update(_grad_partition(own.mat, margin, *part)[1] / max(sums[3], 1.0), step, rate)
            out.append((step, sums.tolist(), own.mat.ravel().tolist() if step in keep else None, None))
        out[-1] = (*out[-1][:3], np.concatenate([own.mat, own.m, own.v]).ravel().tolist())
        return pd.DataFrame(out, columns=["step", "sums", "mat", "state"])

    got = data.groupBy(zero_of(F.col("batch")).alias("all")).applyInPandas(run, "step long, sums array<double>, mat array<double>, state array<double>").collect()
    shared.unpersist()
    got.sort(key=lambda r: r["step"])
    adam.mat, adam.m, adam.v = np.array(got[-1]["state"]).reshape(3, *adam.mat.shape)
    return [_means(np.array(r["sums"])) for r in got], {r["step"]: np.array(r["mat"]).reshape(adam.mat.shape) for r in got if r["mat"] is not None}


def train_projection(train: DataFrame, valid: DataFrame, dim: int, batch_size: int, epochs: int, eval_every: int, lr: float = 1e-2, decay: float = 0.05, margin: float = 1.0,
                     key_col: str = "row_id", init: np.ndarray | None = None) -> tuple[np.ndarray, list[dict], list[dict]]:
    """R3 as a training run: shuffled batches, a step for each, evaluation on held-out rows, the best matrix kept.

    Every epoch draws new batches (M9: hash order, a last short batch is left out) and writes them to shared
    storage, one folder for a block of consecutive batches (BLOCK_ROWS rows, one batch at least), so the work of an
    epoch is one shuffle and one read of the data. A block is one job: its batches are stepped through in
    order (a batch longer than a block is summed by many tasks), and the matrices to be evaluated meet the held-out rows in
    one further pass. Adam starts from ``init`` (identity), its rate falls by ``1 - decay`` an epoch. ``valid`` is
    evaluated before the first step, every ``eval_every`` steps, at mid-epoch and at epoch end; a point
    whose pos_sim - neg_sim exceeds all before it (and 0) keeps its matrix.
    ``train(key_col, ref, pos, neg)`` with unique keys; ``valid(ref, pos, neg)``: arrays of sentence features.
    Returns the best matrix, the steps (step, epoch, loss, pos_sim, neg_sim, lr) and the points (step, epoch, kind, loss, pos_sim, neg_sim).
    """
    import uuid

    from tripletframe.operators.mixing import epoch_batches
    from tripletframe.session import checkpoint_dir, cut_lineage

    spark = train.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/train-{uuid.uuid4().hex}"
    valid = cut_lineage(valid.select("ref", "pos", "neg"))
    keys = cut_lineage(train.select(key_col))
    per_epoch = keys.count() // batch_size
    block = max(1, min(BLOCK_ROWS // batch_size, BLOCK_CELLS // (dim * dim)))
    adam = Adam(np.eye(dim) if init is None else np.array(init, np.float64))
    best, top, steps, points = adam.mat, 0.0, [], []

    def evaluate(todo: list[tuple[int, int, str, np.ndarray]]) -> None:
        nonlocal best, top
        for (step, epoch, kind, mat), got in zip(todo, _evaluations(valid, [t[3] for t in todo], margin) if todo else []):
            points.append({"step": step, "epoch": epoch, "kind": kind, **got})
            if got["pos_sim"] - got["neg_sim"] > top:
                best, top = mat, got["pos_sim"] - got["neg_sim"]

    def kind_of(step: int, b: int) -> str | None:
        return "epoch_end" if b + 1 == per_epoch else "mid_epoch" if b + 1 == per_epoch // 2 else "interval" if step % eval_every == 0 else None

    evaluate([(0, 0, "initial", adam.mat)])
    for epoch in range(epochs):
        drawn = epoch_batches(keys, batch_size, epoch=epoch, key_col=key_col).select(key_col, "batch")
        path, rate = f"{folder}/epoch-{epoch}", lr * (1 - decay) ** epoch
        rows = train.select(key_col, "ref", "pos", "neg").join(drawn, key_col).withColumnRenamed(key_col, "key").withColumn("block", F.floor(F.col("batch") / block))
        if block > 1:  # a block is short: one file each
            rows = rows.repartition("block")
        rows.write.partitionBy("block").parquet(path)
        for a in range(0, per_epoch, block):
            part = range(a, min(a + block, per_epoch))
            first = epoch * per_epoch + a + 1
            kinds = {first + b - a: kind_of(first + b - a, b) for b in part}
            data = spark.read.schema(rows.drop("block").schema).parquet(f"{path}/block={a // block}")
            if block > 1:
                got, mats = _run_steps(data, adam, margin, part, first, rate, {s for s, k in kinds.items() if k})
            else:
                one, g = _pass(data, adam.mat, margin)
                adam.update(g, first, rate)
                got, mats = [one], {first: adam.mat}
            steps += [{"step": first + i, "epoch": epoch, **x, "lr": rate} for i, x in enumerate(got)]
            evaluate([(s, epoch, k, mats[s]) for s, k in kinds.items() if k])
    return best, steps, points

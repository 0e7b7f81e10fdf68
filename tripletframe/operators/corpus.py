"""Model-backed and corpus-level scoring.

* E1 runs the sense network of the learned metric over the *vocabulary*
  (one forward per token, not per text position): since no layer mixes
  positions, ``g(token) = mean_senses(senses(token)) @ T`` is a fixed table and
  E2 turns any corpus into embeddings with joins.
* E3 is the generic batched-inference hook: a model is loaded once per
  partition and applied to Arrow batches (``mapInPandas``).
* E16 computes MAUVE from cluster histograms with Spark aggregates.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ------------------------------------------------------------------ E1

LN_EPS = 1e-5


def init_sense_weights(d: int, num_senses: int, inter_scale: int = 4, seed: int = 42) -> dict:
    """Random weights with the reference's shapes (fixed seed); real weights are loaded the same way."""
    rng = np.random.default_rng(seed)

    def lin(nx, nf):
        return rng.normal(0, 0.02, size=(nx, nf)), np.zeros(nf)

    w = {}
    w["ln_w"], w["ln_b"] = np.ones(d), np.zeros(d)
    w["ln1_w"], w["ln1_b"] = np.ones(d), np.zeros(d)
    w["ln2_w"], w["ln2_b"] = np.ones(d), np.zeros(d)
    w["fc_w"], w["fc_b"] = lin(d, 4 * d)
    w["proj_w"], w["proj_b"] = lin(4 * d, d)
    w["ffc_w"], w["ffc_b"] = lin(d, inter_scale * d)
    w["fproj_w"], w["fproj_b"] = lin(inter_scale * d, d * num_senses)
    w["T"] = rng.normal(0, 1.0, size=(d, d))
    w["num_senses"] = num_senses
    return w


def _gelu_new(x):
    return 0.5 * x * (1.0 + np.tanh(math.sqrt(2.0 / math.pi) * (x + 0.044715 * x**3)))


def _ln(x, w, b):
    mu = x.mean(axis=-1, keepdims=True)
    var = x.var(axis=-1, keepdims=True)
    return (x - mu) / np.sqrt(var + LN_EPS) * w + b


def sense_forward(x: np.ndarray, w: dict) -> np.ndarray:
    """Token embeddings (n, d) -> senses (n, num_senses, d) (eval mode: dropout off)."""
    h = _ln(x, w["ln_w"], w["ln_b"])
    res = h + x
    hs = _ln(res, w["ln1_w"], w["ln1_b"])
    mlp = _gelu_new(hs @ w["fc_w"] + w["fc_b"]) @ w["proj_w"] + w["proj_b"]
    res = mlp + res
    out = _ln(res, w["ln2_w"], w["ln2_b"])
    senses = _gelu_new(out @ w["ffc_w"] + w["ffc_b"]) @ w["fproj_w"] + w["fproj_b"]
    return senses.reshape(x.shape[0], w["num_senses"], x.shape[1])


def token_vectors_from_senses(x: np.ndarray, w: dict) -> np.ndarray:
    """g = mean over senses of (senses @ T): the per-token table behind every sentence embedding."""
    return (sense_forward(x, w) @ w["T"]).mean(axis=1)


def _lists(values: pa.Array, size: int) -> pa.ListArray:
    """Consecutive runs of ``size`` values as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, size, dtype=np.int32)), values)


def token_senses(vocab: DataFrame, weights: dict, token_col: str = "token", vec_col: str = "vec") -> DataFrame:
    """(token, vec) -> (token, senses, g) with a vectorised forward per Arrow batch; weights broadcast once.

    ``senses`` holds num_senses arrays of the vector's length, ``g`` is their mean after the projection T.
    Rows with a null vector are left out.
    """
    spark = vocab.sparkSession
    bw = spark.sparkContext.broadcast(weights)  # the model: d x d and d x num_senses matrices

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = bw.value
        for b in batches:
            n = b.num_rows
            if n == 0:
                continue
            x = b.column(vec_col).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
            s = sense_forward(x, w)
            k, d = s.shape[1:]
            g = (s.reshape(n * k, d) @ w["T"]).reshape(n, k, d).mean(axis=1)
            senses = _lists(_lists(pa.array(s.ravel()), d), k)
            yield pa.RecordBatch.from_arrays([b.column(token_col), senses, _lists(pa.array(g.ravel()), d)], names=[token_col, "senses", "g"])

    doubles = T.ArrayType(T.DoubleType())
    schema = T.StructType([T.StructField(token_col, T.StringType()), T.StructField("senses", T.ArrayType(doubles)), T.StructField("g", doubles)])
    return vocab.select(token_col, vec_col).where(F.col(vec_col).isNotNull()).mapInArrow(run, schema)


def write_token_table(senses: DataFrame, path: str, version: str) -> DataFrame:
    """Write E1's table under ``path/version=<version>`` once and return it as (token, vec, senses) for E2's joins.

    A finished version is read, not computed again; another version lies beside it.
    """
    from tripletframe.sources.io import skip_if_done

    out = skip_if_done(senses.sparkSession, f"{path}/version={version}", lambda: senses)
    return out.select("token", F.col("g").alias("vec"), "senses")


# ------------------------------------------------------------------ E3

def batch_infer(df: DataFrame, load_model: Callable[[], object], predict: Callable[[object, pd.DataFrame], pd.DataFrame],
                schema: T.StructType | str) -> DataFrame:
    """Batched model scoring. The model is built once per task; each Arrow batch is scored at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load_model()
        for b in batches:
            if len(b):
                yield predict(model, b)

    return df.mapInPandas(run, schema)


class BagEncoder:
    """The learned metric's structure as a numpy model for :func:`batch_infer`: padded mean of token vectors.

    ``vector(token)`` gives a token's vector; a task keeps those it has met (at most ``keep``). A text without
    tokens (also a null one) is the pad vector with n = 0.
    """

    def __init__(self, vector: Callable[[str], np.ndarray], dim: int, length: int, pad: np.ndarray, keep: int = 200_000):
        self.vector, self.dim, self.length, self.pad, self.keep = vector, dim, length, pad, keep
        self.known: dict[str, np.ndarray] = {}

    def _of(self, token: str) -> np.ndarray:
        v = self.known.get(token)
        if v is None:
            if len(self.known) >= self.keep:
                self.known.clear()
            v = self.known[token] = self.vector(token)
        return v

    def predict(self, b: pd.DataFrame) -> pd.DataFrame:
        """(row_id, tokens) -> long (row_id, n, j, e), the whole batch gathered and summed at once."""
        lists = [[] if t is None else list(t) for t in b["tokens"]]
        n = np.array([len(t) for t in lists], np.int64)
        distinct: dict[str, int] = {}
        where = np.array([distinct.setdefault(t, len(distinct)) for ts in lists for t in ts], np.int64)
        total = np.zeros((len(lists), self.dim))
        if len(where):
            table = np.stack([self._of(t) for t in distinct])
            full = np.flatnonzero(n)  # reduceat has no empty runs
            total[full] = np.add.reduceat(table[where], (np.cumsum(n) - n)[full], axis=0)
        e = (total + np.maximum(self.length - n, 0)[:, None] * self.pad) / np.maximum(n, self.length)[:, None]
        ids = b["row_id"].to_numpy(np.int64)
        return pd.DataFrame({"row_id": np.repeat(ids, self.dim), "n": np.repeat(n, self.dim),
                             "j": np.tile(np.arange(self.dim, dtype=np.int32), len(ids)), "e": e.ravel()})


# ------------------------------------------------------------------ E16

MAUVE_GRID = 25
MAUVE_SCALE = 5.0


def mauve_from_clusters(assign: DataFrame, side_col: str = "side", cluster_col: str = "cluster",
                        group_cols: Sequence[str] = (), grid: int = MAUVE_GRID, scale: float = MAUVE_SCALE) -> DataFrame:
    """MAUVE from cluster assignments of two sides ``p`` and ``q``.

    Histograms per (group, cluster, side) -> mixtures r = w p + (1-w) q on a
    ``grid``-point weight grid (one exploded row per cluster and weight) ->
    KL(q||r), KL(p||r) sums -> curve exp(-scale * KL) with the two extreme
    points -> trapezoid area (windows over <= grid + 2 points per group).
    A group with one side only has a null score.
    """
    if not group_cols:
        from tripletframe.operators.indexing import zero_of

        a = assign.withColumn("_all", zero_of(F.col(cluster_col)))
        return mauve_from_clusters(a, side_col, cluster_col, ["_all"], grid, scale).drop("_all")
    g = list(group_cols)
    h = assign.groupBy(*g, cluster_col).agg(
        F.sum(F.when(F.col(side_col) == "p", 1).otherwise(0)).alias("cp"),
        F.sum(F.when(F.col(side_col) == "q", 1).otherwise(0)).alias("cq"),
    )
    tot = h.groupBy(*g).agg(F.sum("cp").alias("np"), F.sum("cq").alias("nq"))
    # tot has one row per group
    h = h.join(tot, g).select(*g, cluster_col, F.try_divide(F.col("cp"), F.col("np")).alias("p"),
                                           F.try_divide(F.col("cq"), F.col("nq")).alias("q"))
    step = (1 - 2e-6) / (grid - 1)
    x = h.select("*", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("k"))
    x = x.withColumn("w", F.lit(1e-6) + F.col("k").cast("double") * F.lit(step))
    x = x.withColumn("r", F.col("w") * F.col("p") + (1 - F.col("w")) * F.col("q"))
    kl = x.groupBy(*g, "k").agg(
        F.sum(F.when(F.col("q") > 0, F.col("q") * F.log(F.col("q") / F.col("r"))).otherwise(0.0)).alias("kq"),
        F.sum(F.when(F.col("p") > 0, F.col("p") * F.log(F.col("p") / F.col("r"))).otherwise(0.0)).alias("kp"),
    )
    pts = kl.select(*g, F.exp(-scale * F.col("kq")).alias("x"), F.exp(-scale * F.col("kp")).alias("y"))
    ends = tot.select(*g).select(*g, F.explode(F.array(
        F.struct(F.lit(0.0).alias("x"), F.lit(1.0).alias("y")), F.struct(F.lit(1.0).alias("x"), F.lit(0.0).alias("y"))
    )).alias("_e")).select(*g, "_e.x", "_e.y")
    pts = pts.unionByName(ends)
    from pyspark.sql import Window

    w = Window.partitionBy(*g).orderBy("x", F.col("y").desc())
    pts = pts.withColumn("_x2", F.lead("x").over(w)).withColumn("_y2", F.lead("y").over(w))
    area = (F.col("_x2") - F.col("x")) * (F.col("_y2") + F.col("y")) / 2
    out = pts.groupBy(*g).agg(F.sum(F.when(F.col("_x2").isNotNull(), area).otherwise(0.0)).alias("mauve"))
    both = tot.where("np > 0 and nq > 0").select(*g, F.lit(True).alias("_both"))  # a one-sided group has no score
    return out.join(both, g, "left").select(*g, F.when(F.col("_both"), F.col("mauve")).alias("mauve"))

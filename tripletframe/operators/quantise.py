"""Joint quantisation for corpus-level scores (E16): principal axes and k-means fitted on both sides together.

Statistics are sums that every task adds up over its rows (moments of the
vectors; sums and sizes of clusters); the driver sees only these, dimension x
dimension and groups x k x dimension numbers. Starting centres are the rows
with the smallest hash keys, so a fit is reproducible on any partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripletframe.functions.keys import hkey
from tripletframe.session import cut_lineage


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(flat)
    return flat.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def principal_axes(points: DataFrame, dim: int, vec: str = "vec") -> tuple[np.ndarray, np.ndarray]:
    """Mean and the ``dim`` leading principal axes (columns; largest component positive) of all vectors."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, ss = 0, None, None
        for b in batches:
            x = _matrix(b.column(0))
            if len(x):
                s, ss = (x.sum(0), x.T @ x) if s is None else (s + x.sum(0), ss + x.T @ x)
                n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tolist()], pa.list_(pa.float64())), pa.array([ss.ravel().tolist()], pa.list_(pa.float64()))], names=["n", "s", "ss"])

    part = points.select(vec).mapInArrow(moments, "n long, s array<double>, ss array<double>")
    cell = lambda c: part.select("n", F.posexplode(c).alias("j", "v")).groupBy("j").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).orderBy("j").collect()
    s, ss = cell("s"), cell("ss")  # dimension and dimension^2 numbers
    if not s:
        return np.zeros(0), np.zeros((0, 0))
    n, mean = s[0]["n"], np.array([r["v"] for r in s]) / s[0]["n"]
    cov = np.array([r["v"] for r in ss]).reshape(len(mean), -1) / n - np.outer(mean, mean)
    axes = np.linalg.eigh(cov)[1][:, ::-1][:, :dim]
    lead = axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])]
    return mean, axes * np.where(lead < 0, -1.0, 1.0)


def project(points: DataFrame, mean: np.ndarray, axes: np.ndarray, vec: str = "vec") -> DataFrame:
    """Replace ``vec`` by its coordinates on ``axes``."""
    at = points.columns.index(vec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = (_matrix(b.column(at)) - mean) @ axes if b.num_rows else np.zeros((0, 0))
            yield pa.RecordBatch.from_arrays([pa.array(y.tolist(), pa.list_(pa.float64())) if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)

    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    return points.mapInArrow(run, ", ".join(f"`{c}` {'array<double>' if c == vec else kinds[c]}" for c in points.columns))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres ** 2).sum(1) - 2.0 * (x @ centres.T)).argmin(1)


def lloyd(points: DataFrame, k: int, rounds: int = 10, group: str = "grp", vec: str = "vec", order: Sequence[str] = ("key",)) -> DataFrame:
    """Add ``cluster`` (0..k-1) to ``points``: ``rounds`` steps of k-means in every ``group``, all sides together.

    Starting centres are the ``k`` rows with the smallest (hash of ``order``, ``order``); a cluster that
    loses all its rows keeps its centre; of equally near centres the first wins. Vectors are neither null nor
    empty and equally long. Groups are few (their centres are held by the driver and sent to all tasks).
    """
    points = cut_lineage(points)
    first = Window.partitionBy(group).orderBy(hkey(*order), *order)
    start = points.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k).select(group, F.col("_r") - 1, vec).collect()  # groups x k vectors
    centres: dict = {}
    for g, _, v in sorted(start, key=lambda r: r[1]):
        centres.setdefault(g, []).append(v)
    centres = {g: np.array(c, np.float64) for g, c in centres.items()}
    at_g, at_v = points.columns.index(group), points.columns.index(vec)
    kind = points.schema[group].dataType.simpleString()
    sc = points.sparkSession.sparkContext
    for _ in range(rounds):
        shared = sc.broadcast(centres)

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total: dict = {}
            for b in batches:
                x, groups = _matrix(b.column(1)), np.array(b.column(0).to_pylist(), object)
                for g in set(groups.tolist()):
                    mine = x[groups == g]
                    near = _nearest(mine, shared.value[g])
                    for c in np.unique(near).tolist():
                        n, s = total.get((g, c), (0, 0.0))
                        total[g, c] = n + int((near == c).sum()), s + mine[near == c].sum(0)
            if total:
                yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in total]), pa.array([c for _, c in total], pa.int32()), pa.array([n for n, _ in total.values()], pa.int64()),
                                                  pa.array([s.tolist() for _, s in total.values()], pa.list_(pa.float64()))], names=["g", "c", "n", "s"])

        part = points.select(group, vec).mapInArrow(sums, f"g {kind}, c int, n long, s array<double>")
        sizes = part.groupBy("g", "c").agg(F.sum("n").alias("n"))
        cells = part.select("g", "c", F.posexplode("s").alias("j", "v")).groupBy("g", "c", "j").agg(F.sum("v").alias("v")).join(sizes, ["g", "c"])
        centres = {g: m.copy() for g, m in centres.items()}
        for r in cells.collect():  # groups x k x dimension numbers
            centres[r["g"]][r["c"], r["j"]] = r["v"] / r["n"]
        shared.unpersist()
    shared = sc.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, groups = _matrix(b.column(at_v)), np.array(b.column(at_g).to_pylist(), object)
            near = np.zeros(b.num_rows, np.int32)
            for g in set(groups.tolist()):
                near[groups == g] = _nearest(x[groups == g], shared.value[g])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near)], names=[*b.schema.names, "cluster"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)
    return points.mapInArrow(assign, f"{kinds}, cluster int")


def mauve(points: DataFrame, k: int, rounds: int = 10, pca_dim: int | None = None, group: str = "grp", side: str = "side", vec: str = "vec", order: Sequence[str] = ("key",)) -> DataFrame:
    """E16 from vectors: (group, mauve) of ``points(group, side 'p' | 'q', vec, order...)``, both sides quantised together.

    Rows with a null vector or a null group take no part; a group with one side only has a null score.
    """
    from tripletframe.operators.corpus import mauve_from_clusters

    points = points.where(F.col(vec).isNotNull() & F.col(group).isNotNull())
    if pca_dim:
        points = project(points, *principal_axes(points, pca_dim, vec), vec)
    found = lloyd(points, k, rounds, group, vec, order)
    return mauve_from_clusters(cut_lineage(found.select(group, side, "cluster")), side, "cluster", [group])

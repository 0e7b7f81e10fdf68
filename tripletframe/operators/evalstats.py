"""Evaluation aggregates (A1-A11, A22, A23) over long score tables.

The wide metric frame of the reference (``correct_m`` / ``incorrect_m`` per
metric) is kept *long*: ``(group..., row_id, label, score)`` with label 1 for
the correct side and 0 for the incorrect side. Every statistic is then one
grouped aggregate (partial aggregation on the map side), never a Python loop
over metrics or datasets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripletframe.functions import columns as P
from tripletframe.operators.indexing import buckets_for, dense_index, value_range_bucket, zero_of

GRID_POINTS = 100


def _cnt(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def _f1_from_counts(tp, fp, fn, tn) -> Column:
    """Two-class macro F1 from counts (classes absent from labels and predictions are skipped)."""
    f1_pos = F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)
    f1_neg = F.when(2 * tn + fn + fp > 0, 2 * tn / (2 * tn + fn + fp)).otherwise(0.0)
    has_pos = (tp + fn + fp) > 0
    has_neg = (tn + fp + fn) > 0
    k = F.when(has_pos, 1).otherwise(0) + F.when(has_neg, 1).otherwise(0)
    return F.when(k > 0, (F.when(has_pos, f1_pos).otherwise(0.0) + F.when(has_neg, f1_neg).otherwise(0.0)) / k)


def confusion(label: str = "label", score: str = "score", thr=0.5):
    """tp, fp, fn, tn aggregate expressions for prediction ``score >= thr``."""
    t = thr if isinstance(thr, Column) else F.lit(thr)
    pred = F.col(score) >= t
    lab = F.col(label) == 1
    return (
        _cnt(lab & pred).alias("tp"),
        _cnt(~lab & pred).alias("fp"),
        _cnt(lab & ~pred).alias("fn"),
        _cnt(~lab & ~pred).alias("tn"),
    )


# ------------------------------------------------------------------ A1, A2

def triplet_summary(scored: DataFrame, group_cols: Sequence[str] = (), margin: float = 1.0, thr: float = 0.5) -> DataFrame:
    """A1: loss, mean / population std of pos and neg similarity, mean difference, macro F1, n."""
    pos, neg = F.col("pos_sim"), F.col("neg_sim")
    agg = scored.groupBy(*group_cols).agg(
        F.avg(F.greatest(F.lit(0.0), F.lit(margin) + neg - pos)).alias("loss"),
        F.avg(pos).alias("pos_sim_mean"),
        F.avg(neg).alias("neg_sim_mean"),
        F.stddev_pop(pos).alias("pos_sim_std"),
        F.stddev_pop(neg).alias("neg_sim_std"),
        F.avg(pos - neg).alias("diff_mean"),
        _cnt(pos >= thr).alias("_tp"),
        _cnt(neg >= thr).alias("_fp"),
        F.count(F.lit(1)).alias("n_samples"),
    )
    tp, fp, n = F.col("_tp"), F.col("_fp"), F.col("n_samples")
    return agg.withColumn("f1", _f1_from_counts(tp, fp, n - tp, n - fp)).drop("_tp", "_fp")


def batch_mean_loss(scored: DataFrame, batch_size: int, group_cols: Sequence[str] = (), order_col: str = "row_id",
                    margin: float = 1.0) -> DataFrame:
    """A2: mean over loader batches of the batch-mean hinge loss (short last batch over-weighted).

    Batches are consecutive ``batch_size`` rows in ``order_col`` order; the
    position comes from :func:`dense_index` (no single-task window).
    """
    g = list(group_cols)
    n = scored.count()
    x = scored.withColumn("_ho", F.col(order_col).cast("double"))
    st = x.agg(F.min("_ho").alias("lo"), F.max("_ho").alias("hi")).first()
    x = dense_index(x, g, [order_col], value_range_bucket("_ho", st["lo"] or 0.0, st["hi"] or 0.0, buckets_for(n)), "_pos", None)
    x = x.withColumn("_loss", F.greatest(F.lit(0.0), F.lit(margin) + F.col("neg_sim") - F.col("pos_sim")))
    per_batch = x.groupBy(*g, F.floor(F.col("_pos") / batch_size).alias("_b")).agg(
        F.avg("_loss").alias("_bl"), F.sum("_loss").alias("_s"), F.count(F.lit(1)).alias("_c")
    )
    return per_batch.groupBy(*g).agg(
        F.avg("_bl").alias("batch_mean_loss"),
        (F.sum("_s") / F.sum("_c")).alias("global_mean_loss"),
        F.count(F.lit(1)).alias("n_batches"),
    )


# ------------------------------------------------------------------ A3-A5, A7

def macro_f1(long: DataFrame, group_cols: Sequence[str], thr=0.5, label: str = "label", score: str = "score") -> DataFrame:
    """A3: two-class macro F1 of ``score >= thr`` against ``label`` per group."""
    c = long.groupBy(*group_cols).agg(*confusion(label, score, thr))
    return c.withColumn("f1", _f1_from_counts(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")))


def class_means(long: DataFrame, group_cols: Sequence[str], label: str = "label", score: str = "score") -> DataFrame:
    """Mean score of each label per group, as two columns."""
    return long.groupBy(*group_cols).agg(
        F.avg(F.when(F.col(label) == 1, F.col(score))).alias("correct_mean"),
        F.avg(F.when(F.col(label) == 0, F.col(score))).alias("incorrect_mean"),
    )


def midpoint_threshold_f1(long: DataFrame, group_cols: Sequence[str], label: str = "label", score: str = "score") -> DataFrame:
    """A4: threshold = (mean correct + mean incorrect) / 2 per group, then A3.

    The per-group means are joined back on the group key (one row per group).
    """
    if not group_cols:
        return midpoint_threshold_f1(long.withColumn("_all", zero_of(F.col(score))), ["_all"], label, score).drop("_all")
    means = class_means(long, group_cols, label, score).withColumn(
        "threshold", (F.col("correct_mean") + F.col("incorrect_mean")) / 2
    )
    x = long.join(means.select(*group_cols, "threshold"), list(group_cols))
    c = x.groupBy(*group_cols).agg(*confusion(label, score, F.col("threshold")))
    f = c.withColumn("f1", _f1_from_counts(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")))
    return f.join(means, list(group_cols)).select(
        *group_cols, "correct_mean", "incorrect_mean",
        (F.col("correct_mean") - F.col("incorrect_mean")).alias("diff_mean"), "threshold", "f1",
        (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n_samples"),
    )


def balanced_accuracy(long: DataFrame, group_cols: Sequence[str], thr=0.5, label: str = "label", score: str = "score") -> DataFrame:
    """A5: mean recall over the classes present in the labels."""
    c = long.groupBy(*group_cols).agg(*confusion(label, score, thr))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    r1 = F.when(tp + fn > 0, tp / (tp + fn))
    r0 = F.when(tn + fp > 0, tn / (tn + fp))
    k = F.when(tp + fn > 0, 1).otherwise(0) + F.when(tn + fp > 0, 1).otherwise(0)
    return c.withColumn("bacc", F.when(k > 0, (F.coalesce(r1, F.lit(0.0)) + F.coalesce(r0, F.lit(0.0))) / k))


# ------------------------------------------------------------------ A6

def wasserstein1(long: DataFrame, group_cols: Sequence[str], label: str = "label", score: str = "score",
                 rows_per_bucket: int | None = None) -> DataFrame:
    """1-Wasserstein distance between the score distributions of label 1 and label 0.

    ``W = sum_i |F1(x_i) - F0(x_i)| * (x_{i+1} - x_i)`` over the sorted distinct
    pooled values. Values are first collapsed to (value, count1, count0);
    running counts use value-range buckets per group: a bucket-level prefix sum
    plus a window inside each bucket, so no group is sorted in one task.
    """
    if not group_cols:
        return wasserstein1(long.withColumn("_all", zero_of(F.col(score))), ["_all"], label, score, rows_per_bucket).drop("_all")
    g = list(group_cols)
    v = long.where(F.col(score).isNotNull()).groupBy(*g, F.col(score).alias("_x")).agg(
        _cnt(F.col(label) == 1).alias("_c1"), _cnt(F.col(label) == 0).alias("_c0")
    )
    n_rows = v.count()
    nb = buckets_for(n_rows, rows_per_bucket)
    bounds = v.groupBy(*g).agg(
        F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.sum("_c1").alias("_n1"), F.sum("_c0").alias("_n0")
    )
    v = v.join(bounds, g)
    width = (F.col("_hi") - F.col("_lo")) / nb
    v = v.withColumn(
        "_bk", F.when(width > 0, F.least(F.floor((F.col("_x") - F.col("_lo")) / width), F.lit(nb - 1))).otherwise(0).cast("int")
    )
    bk = v.groupBy(*g, "_bk").agg(F.sum("_c1").alias("_s1"), F.sum("_c0").alias("_s0"), F.min("_x").alias("_vmin"))
    wb = Window.partitionBy(*g).orderBy("_bk")
    prev = wb.rowsBetween(Window.unboundedPreceding, -1)
    bk = bk.select(
        *g, "_bk",
        F.coalesce(F.sum("_s1").over(prev), F.lit(0)).alias("_o1"),
        F.coalesce(F.sum("_s0").over(prev), F.lit(0)).alias("_o0"),
        F.lead("_vmin").over(wb).alias("_nextb"),
    )
    x = v.join(bk, [*g, "_bk"])
    wi = Window.partitionBy(*g, "_bk").orderBy("_x")
    run = wi.rowsBetween(Window.unboundedPreceding, 0)
    x = x.select(
        *g, "_x", "_n1", "_n0",
        (F.col("_o1") + F.sum("_c1").over(run)).alias("_cum1"),
        (F.col("_o0") + F.sum("_c0").over(run)).alias("_cum0"),
        F.coalesce(F.lead("_x").over(wi), F.col("_nextb")).alias("_next"),
    )
    term = F.abs(F.col("_cum1") / F.col("_n1") - F.col("_cum0") / F.col("_n0")) * (F.col("_next") - F.col("_x"))
    ok = F.col("_next").isNotNull() & (F.col("_n1") > 0) & (F.col("_n0") > 0)
    return x.groupBy(*g).agg(F.coalesce(F.sum(F.when(ok, term)), F.lit(0.0)).alias("wasserstein"))


# ------------------------------------------------------------------ A8-A10

def score_table(long: DataFrame, group_cols: Sequence[str] = ("dataset", "metric"), metric_col: str = "metric",
                rescaled: Sequence[str] = P.RESCALED_METRICS) -> DataFrame:
    """Per metric: correct and incorrect mean x100 rounded to 2 dp, difference of the rounded values
    (halved for rescaled metrics) rounded to 2 dp, and the '(c, i)' display string."""
    from decimal import Decimal

    m = class_means(long, group_cols)
    c = F.round(F.col("correct_mean") * 100, 2)
    i = F.round(F.col("incorrect_mean") * 100, 2)
    # the rounded values are exact cents: their (halved) difference is computed in decimal, where a
    # half cent is an exact tie rounded half-up, instead of depending on binary rounding of doubles
    dd = c.cast("decimal(14,2)") - i.cast("decimal(14,2)")
    d = F.when(F.col(metric_col).isin(list(rescaled)), dd * F.lit(Decimal("0.5"))).otherwise(dd)
    return m.select(*group_cols, c.alias("correct"), i.alias("incorrect"), F.round(d, 2).cast("double").alias("difference"),
                    F.format_string("(%.2f, %.2f)", c, i).alias("pair"))


def cross_dataset_table(stats: DataFrame, value_col: str, datasets: Sequence[str], metric_order: Sequence[str],
                        scale: float = 100.0) -> DataFrame:
    """Metric x dataset matrix of ``value_col`` x ``scale`` in a fixed metric order (missing -> null)."""
    order = F.array_position(F.array(*[F.lit(m) for m in metric_order]), F.col("metric"))
    p = stats.groupBy("metric").pivot("dataset", list(datasets)).agg(F.first(F.col(value_col) * scale))
    return p.withColumn("metric_order", order.cast("int"))


def final_table(table: DataFrame, datasets: Sequence[str]) -> DataFrame:
    """A10: (pair, difference) of every dataset side by side, aligned on metric (outer alignment)."""
    return table.groupBy("metric").pivot("dataset", list(datasets)).agg(
        F.first("pair").alias("pair"), F.first("difference").alias("difference")
    )


# ------------------------------------------------------------------ A11

def threshold_curve(wide: DataFrame, group_cols: Sequence[str], correct: str = "correct", incorrect: str = "incorrect",
                    tau: float = 0.5, points: int = GRID_POINTS) -> DataFrame:
    """% of rows with correct - incorrect > t and incorrect < tau and correct > tau, t on linspace(0, 1, points).

    Rows are binned to ``k`` = number of grid points strictly below their
    difference (exact: both neighbours are checked); a reverse cumulative sum
    over <= points+1 bins per group gives the curve. No grid x rows product.
    """
    if not group_cols:
        return threshold_curve(wide.withColumn("_all", zero_of(F.col(correct))), ["_all"], correct, incorrect, tau, points).drop("_all")
    g = list(group_cols)
    step = 1.0 / (points - 1)
    x = wide.dropna(subset=[correct, incorrect])
    tot = x.groupBy(*g).agg(F.count(F.lit(1)).alias("_n"))
    d = F.col(correct) - F.col(incorrect)
    q = x.where((F.col(incorrect) < tau) & (F.col(correct) > tau)).withColumn("_d", d)

    def t(j):
        return F.when(j >= points - 1, F.lit(1.0)).otherwise(j.cast("double") * F.lit(step))

    k0 = F.least(F.greatest(F.ceil(F.col("_d") / F.lit(step)), F.lit(0)), F.lit(points)).cast("int")
    q = q.withColumn("_k0", k0)
    q = q.withColumn("_k1", F.when((F.col("_k0") >= 1) & (F.col("_d") <= t(F.col("_k0") - 1)), F.col("_k0") - 1).otherwise(F.col("_k0")))
    q = q.withColumn("_k", F.when((F.col("_k1") < points) & (F.col("_d") > t(F.col("_k1"))), F.col("_k1") + 1).otherwise(F.col("_k1")))
    hist = q.groupBy(*g, "_k").agg(F.count(F.lit(1)).alias("_c"))
    grid = tot.select(*g, "_n", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("j"))
    # rows with k > j count at grid point j: add each bin at j = k - 1 and sum j..end
    at = hist.where(F.col("_k") >= 1).select(*g, (F.col("_k") - 1).alias("j"), "_c")
    y = grid.join(at, [*g, "j"], "left")  # <= points rows per group on both sides
    w = Window.partitionBy(*g).orderBy(F.col("j").desc()).rowsBetween(Window.unboundedPreceding, 0)
    y = y.withColumn("_cum", F.sum(F.coalesce(F.col("_c"), F.lit(0))).over(w))
    return y.select(*g, F.col("j").cast("int").alias("j"), t(F.col("j")).alias("t"),
                    (F.col("_cum") / F.col("_n") * 100).alias("pct"))


# ------------------------------------------------------------------ A22, A23

def rank_by_difference(scored: DataFrame, k: int | None = None) -> DataFrame:
    """Per-sample results ordered by pos - neg, descending (top-k when k is set)."""
    x = scored.withColumn("difference", F.col("pos_sim") - F.col("neg_sim"))
    x = x.orderBy(F.col("difference").desc(), F.col("row_id"))
    return x.limit(k) if k else x


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows per value combination."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))

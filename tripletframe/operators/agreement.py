"""Agreement with human scores.

Metric scores stay long (one row per sample and metric). Per-sample ranking
of the metrics is a window over at most ``#metrics`` rows; every summary is
a grouped aggregate, and "per dataset plus overall" is one ``rollup``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripletframe.functions import columns as P
from tripletframe.operators.indexing import zero_of

OVERALL = "Overall"
KDE_GRID = 200
KDE_CUT = 3.0


def flatten_triplets(wide: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("dataset", "row_id")) -> DataFrame:
    """A triplet row with correct_m / incorrect_m columns -> two labeled rows with plain metric columns."""
    parts = []
    for side, lab in (("correct", 1), ("incorrect", 0)):
        parts.append(wide.select(*keys, F.lit(lab).alias("label"), *[F.col(f"{side}_{m}").alias(m) for m in metrics]))
    return parts[0].unionByName(parts[1])


def attach_human(human: DataFrame, metrics_long: DataFrame, keys: Sequence[str] = ("dataset", "row_id", "label"),
                 human_col: str = "human_score", clip_metrics: Sequence[str] = ("bleurt",), order_col: str | None = None) -> DataFrame:
    """Dedupe metric rows on the keys (first kept), inner join many-to-one, human/5, clip some metrics to [0, 1].

    ``metrics_long``: (keys..., metric, score). The metric side is reduced to
    one row per (keys, metric) before the join, so the join is many-to-one.
    Which of several rows stays: the first by ``order_col``; without one the smallest score.
    """
    k = list(keys)
    if order_col:
        m = metrics_long.groupBy(*k, "metric").agg(F.min_by("score", order_col).alias("score"))
    else:
        m = metrics_long.groupBy(*k, "metric").agg(F.min("score").alias("score"))
    h = human.withColumn("human", P.norm_score(human_col))
    x = h.join(m, k, "inner")
    return x.withColumn("score", F.when(F.col("metric").isin(list(clip_metrics)), P.clip01("score")).otherwise(F.col("score")))


def ccc_expr(x: Column, y: Column) -> Column:
    """A14 aggregate: 2 cov / (var x + var y + (mean x - mean y)^2), population moments; null for two equal constants."""
    return F.try_divide(2 * F.covar_pop(x, y), F.var_pop(x) + F.var_pop(y) + F.pow(F.avg(x) - F.avg(y), 2))


def ccc(df: DataFrame, x: str, y: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """Concordance correlation coefficient per group."""
    return df.groupBy(*group_cols).agg(ccc_expr(F.col(x), F.col(y)).alias("ccc"))


def ccc_matrix(wide: DataFrame, cols: Sequence[str], group_cols: Sequence[str] = (), scale: float = 100.0) -> DataFrame:
    """CCC x scale for every ordered pair of columns, in one aggregate pass, unpivoted to (a, b, ccc)."""
    aggs = []
    pairs = [(a, b) for a in cols for b in cols]
    for i, (a, b) in enumerate(pairs):
        aggs.append((ccc_expr(F.col(a), F.col(b)) * scale).alias(f"_c{i}"))
    x = wide.groupBy(*group_cols).agg(*aggs)
    stack = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_c{i}").alias("ccc"))
                                for i, (a, b) in enumerate(pairs)]))
    return x.select(*group_cols, stack.alias("_s")).select(*group_cols, "_s.a", "_s.b", "_s.ccc")


def closeness_rank(merged: DataFrame, sample_cols: Sequence[str], digits: int = 9) -> DataFrame:
    """Per sample, rank metrics by |score - human| (ties get the average rank).

    ``avg rank = rank + (ties - 1) / 2``; the window spans the metrics of one sample.
    Differences are rounded to ``digits`` places first so equal values tie in every engine.
    """
    s = list(sample_cols)
    x = merged.withColumn("diff", F.round(F.abs(F.col("score") - F.col("human")), digits))
    w = Window.partitionBy(*s).orderBy("diff")
    ties = F.count(F.lit(1)).over(Window.partitionBy(*s, "diff"))
    return x.withColumn("rank", F.rank().over(w) + (ties - 1) / 2.0)


def rank_stats(ranked: DataFrame, group_cols: Sequence[str] = ("dataset", "metric"), thr: float = 0.0, scale: float = 100.0,
               overall: bool = True) -> DataFrame:
    """R@1, MAE and DCG per metric, per dataset plus 'Overall' (one rollup), x scale."""
    hit = (F.col("diff") <= thr)
    r1 = F.avg(F.when(hit | (F.col("rank") == 1.0), 1.0).otherwise(0.0))
    mae = F.avg("diff")
    dcg = F.avg(F.when(hit, 1.0).otherwise(1.0 / F.log2(F.col("rank") + 1)))
    g = list(group_cols)
    if overall and "dataset" in g:
        rest = [c for c in g if c != "dataset"]
        agg = ranked.rollup(*rest, "dataset").agg(
            (r1 * scale).alias("r_at_1"), (mae * scale).alias("mae"), (dcg * scale).alias("dcg"), F.grouping("dataset").alias("_g"),
            *[F.grouping(c).alias(f"_g_{c}") for c in rest],
        )
        for c in rest:
            agg = agg.where(F.col(f"_g_{c}") == 0).drop(f"_g_{c}")
        return agg.withColumn("dataset", F.when(F.col("_g") == 1, F.lit(OVERALL)).otherwise(F.col("dataset"))).drop("_g")
    return ranked.groupBy(*g).agg((r1 * scale).alias("r_at_1"), (mae * scale).alias("mae"), (dcg * scale).alias("dcg"))


def score_density(df: DataFrame, value_col: str, group_cols: Sequence[str], grid: int = KDE_GRID, cut: float = KDE_CUT) -> DataFrame:
    """Gaussian KDE (Scott bandwidth) on a ``grid``-point support per group: the data behind the density plots.

    Bandwidth ``h = stddev_samp * n^(-1/5)``; support ``[min - cut h, max + cut h]``.
    Equal values are counted first, then each distinct value contributes to the
    ``grid`` points through an explode and a partial aggregate.
    """
    if not group_cols:
        return score_density(df.withColumn("_all", zero_of(F.col(value_col))), value_col, ["_all"], grid, cut).drop("_all")
    g = list(group_cols)
    st = df.groupBy(*g).agg(
        F.count(value_col).alias("_n"), F.stddev_samp(value_col).alias("_sd"), F.min(value_col).alias("_lo"), F.max(value_col).alias("_hi")
    ).withColumn("_bw", F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))).where(F.col("_bw") > 0)
    x = df.where(F.col(value_col).isNotNull()).groupBy(*g, F.col(value_col).alias("_v")).agg(F.count(F.lit(1)).alias("_c")).join(st, g)
    x = x.select("*", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("j"))
    lo = F.col("_lo") - cut * F.col("_bw")
    hi = F.col("_hi") + cut * F.col("_bw")
    xj = lo + (hi - lo) * F.col("j") / F.lit(float(grid - 1))
    z = (xj - F.col("_v")) / F.col("_bw")
    k = F.exp(-0.5 * z * z) / (F.col("_bw") * F.lit(math.sqrt(2 * math.pi)))
    d = x.groupBy(*g, "j").agg(F.first(xj).alias("x"), (F.sum(k * F.col("_c")) / F.first("_n")).alias("density"))
    return d

"""Registered queries for evaluation aggregates and human agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripletframe.functions.vectors import cosine_sql_duck
from tripletframe.operators import agreement as G
from tripletframe.operators import evalstats as A
from tripletframe.operators import scoring as S
from tripletframe.plans.registry import query
from tripletframe.sources.fixtures import METRICS, view

R6 = 6
DATASETS = ["ds0", "ds1", "ds2"]
EVAL_BATCH = 64
HUMAN_THRESHOLD = 0.0  # R@1 / DCG threshold default of the reference
SAMPLE = ["dataset", "row_id", "label", "annotator"]


def _r(df, cols):
    return df.select(*[F.round(c, R6).alias(c) if c in cols else F.col(c) for c in df.columns])


def _scored_triplets(spark, sf):
    x = S.triplet_score(view(spark, sf, "fx_vec_triplets"))
    return x.withColumn("dataset", F.concat(F.lit("ds"), F.pmod("label", F.lit(3)).cast("string")))


_SCORED_SQL = f"""scored as (select row_id, label, 'ds' || cast(label % 3 as varchar) as dataset,
  {cosine_sql_duck('ref', 'pos')} as pos_sim, {cosine_sql_duck('ref', 'neg')} as neg_sim from fx_vec_triplets)"""

_F1_SQL = """case when (case when tp + fn + fp > 0 then 1 else 0 end) + (case when tn + fp + fn > 0 then 1 else 0 end) > 0 then
  ((case when tp + fn + fp > 0 then (case when 2 * tp + fp + fn > 0 then 2.0 * tp / (2 * tp + fp + fn) else 0 end) else 0 end)
  + (case when tn + fp + fn > 0 then (case when 2 * tn + fn + fp > 0 then 2.0 * tn / (2 * tn + fn + fp) else 0 end) else 0 end))
  / ((case when tp + fn + fp > 0 then 1 else 0 end) + (case when tn + fp + fn > 0 then 1 else 0 end)) end"""

_CONF_SQL = """cast(sum(case when label = 1 and score >= {t} then 1 else 0 end) as bigint) as tp,
  cast(sum(case when label <> 1 and score >= {t} then 1 else 0 end) as bigint) as fp,
  cast(sum(case when label = 1 and not (score >= {t}) then 1 else 0 end) as bigint) as fn,
  cast(sum(case when label <> 1 and not (score >= {t}) then 1 else 0 end) as bigint) as tn"""


@query("a1_triplet_summary", f"""with {_SCORED_SQL},
a as (select dataset, avg(greatest(0.0, 1.0 + neg_sim - pos_sim)) as loss, avg(pos_sim) as pos_sim_mean, avg(neg_sim) as neg_sim_mean,
  stddev_pop(pos_sim) as pos_sim_std, stddev_pop(neg_sim) as neg_sim_std, avg(pos_sim - neg_sim) as diff_mean,
  sum(case when pos_sim >= 0.5 then 1 else 0 end) as tp, sum(case when neg_sim >= 0.5 then 1 else 0 end) as fp, count(*) as n_samples
  from scored group by dataset),
b as (select *, n_samples - tp as fn, n_samples - fp as tn from a)
select dataset, round(loss, 6) as loss, round(pos_sim_mean, 6) as pos_sim_mean, round(neg_sim_mean, 6) as neg_sim_mean,
  round(pos_sim_std, 6) as pos_sim_std, round(neg_sim_std, 6) as neg_sim_std, round(diff_mean, 6) as diff_mean, n_samples,
  round({_F1_SQL}, 6) as f1 from b""", views=["fx_vec_triplets"])
def a1_triplet_summary(spark, sf):
    x = A.triplet_summary(_scored_triplets(spark, sf), ["dataset"])
    return _r(x, ["loss", "pos_sim_mean", "neg_sim_mean", "pos_sim_std", "neg_sim_std", "diff_mean", "f1"])


@query("a2_batch_mean_loss", f"""with {_SCORED_SQL},
p as (select dataset, (row_number() over (partition by dataset order by row_id) - 1) // {EVAL_BATCH} as b,
  greatest(0.0, 1.0 + neg_sim - pos_sim) as loss from scored),
pb as (select dataset, b, avg(loss) as bl, sum(loss) as s, count(*) as c from p group by dataset, b)
select dataset, round(avg(bl), 6) as batch_mean_loss, round(sum(s) / sum(c), 6) as global_mean_loss, count(*) as n_batches
from pb group by dataset""", views=["fx_vec_triplets"])
def a2_batch_mean_loss(spark, sf):
    x = A.batch_mean_loss(_scored_triplets(spark, sf), EVAL_BATCH, ["dataset"])
    return _r(x, ["batch_mean_loss", "global_mean_loss"])


@query("a3_macro_f1", f"""with c as (select dataset, metric, {_CONF_SQL.format(t='0.5')} from fx_scores group by dataset, metric)
select dataset, metric, tp, fp, fn, tn, round({_F1_SQL}, 6) as f1 from c""", views=["fx_scores"])
def a3_macro_f1(spark, sf):
    return _r(A.macro_f1(view(spark, sf, "fx_scores"), ["dataset", "metric"]), ["f1"])


@query("a4_midpoint_threshold_f1", f"""with m as (select dataset, metric, avg(score) filter (where label = 1) as correct_mean,
  avg(score) filter (where label = 0) as incorrect_mean from fx_scores group by dataset, metric),
t as (select *, (correct_mean + incorrect_mean) / 2 as threshold from m),
c as (select s.dataset, s.metric, {_CONF_SQL.format(t='t.threshold')} from fx_scores s join t using (dataset, metric)
  group by s.dataset, s.metric)
select dataset, metric, round(correct_mean, 6) as correct_mean, round(incorrect_mean, 6) as incorrect_mean,
  round(correct_mean - incorrect_mean, 6) as diff_mean, round(threshold, 6) as threshold, round({_F1_SQL}, 6) as f1,
  tp + fp + fn + tn as n_samples from c join t using (dataset, metric)""", views=["fx_scores"])
def a4_midpoint_threshold_f1(spark, sf):
    x = A.midpoint_threshold_f1(view(spark, sf, "fx_scores"), ["dataset", "metric"])
    return _r(x, ["correct_mean", "incorrect_mean", "diff_mean", "threshold", "f1"])


@query("a5_balanced_accuracy", f"""with c as (select dataset, metric, {_CONF_SQL.format(t='0.5')} from fx_scores group by dataset, metric)
select dataset, metric, tp, fp, fn, tn, round(case when (case when tp + fn > 0 then 1 else 0 end) + (case when tn + fp > 0 then 1 else 0 end) > 0
  then (coalesce(case when tp + fn > 0 then tp / (tp + fn) end, 0) + coalesce(case when tn + fp > 0 then tn / (tn + fp) end, 0))
  / ((case when tp + fn > 0 then 1 else 0 end) + (case when tn + fp > 0 then 1 else 0 end)) end, 6) as bacc from c""",
       views=["fx_scores"])
def a5_balanced_accuracy(spark, sf):
    return _r(A.balanced_accuracy(view(spark, sf, "fx_scores"), ["dataset", "metric"]), ["bacc"])


@query("a6_wasserstein", """with v as (select dataset, metric, score as x, sum(case when label = 1 then 1 else 0 end) as c1,
  sum(case when label = 0 then 1 else 0 end) as c0 from fx_scores where score is not null group by dataset, metric, score),
t as (select dataset, metric, sum(c1) as n1, sum(c0) as n0 from v group by dataset, metric),
r as (select v.*, sum(c1) over w as cum1, sum(c0) over w as cum0, lead(x) over (partition by dataset, metric order by x) as nx
  from v window w as (partition by dataset, metric order by x rows between unbounded preceding and current row))
select dataset, metric, round(coalesce(sum(abs(cum1 / n1 - cum0 / n0) * (nx - x)) filter (where nx is not null and n1 > 0 and n0 > 0), 0), 6)
  as wasserstein from r join t using (dataset, metric) group by dataset, metric""", views=["fx_scores"])
def a6_wasserstein(spark, sf):
    return _r(A.wasserstein1(view(spark, sf, "fx_scores"), ["dataset", "metric"]), ["wasserstein"])


@query("a7_class_means", """select dataset, metric, round(avg(score) filter (where label = 1), 6) as correct_mean,
  round(avg(score) filter (where label = 0), 6) as incorrect_mean from fx_scores group by dataset, metric""", views=["fx_scores"])
def a7_class_means(spark, sf):
    return _r(A.class_means(view(spark, sf, "fx_scores"), ["dataset", "metric"]), ["correct_mean", "incorrect_mean"])


_SCORE_TABLE_SQL = """st as (select dataset, metric, round(avg(score) filter (where label = 1) * 100, 2) as correct,
  round(avg(score) filter (where label = 0) * 100, 2) as incorrect from fx_scores group by dataset, metric),
st2 as (select dataset, metric, correct, incorrect,
  cast(round(case when metric in ('embsim', 'bleurt', 'simcse', 'learned')
    then (cast(correct as decimal(14, 2)) - cast(incorrect as decimal(14, 2))) * 0.5
    else cast(correct as decimal(14, 2)) - cast(incorrect as decimal(14, 2)) end, 2) as double) as difference,
  printf('(%.2f, %.2f)', correct, incorrect) as pair from st)"""


@query("a8_score_table", f"with {_SCORE_TABLE_SQL} select * from st2", views=["fx_scores"])
def a8_score_table(spark, sf):
    return A.score_table(view(spark, sf, "fx_scores"))


@query("a9_cross_dataset_table", f"""with c as (select dataset, metric, {_CONF_SQL.format(t='0.5')} from fx_scores group by dataset, metric),
f as (select dataset, metric, {_F1_SQL} * 100 as v from c)
select metric, round(max(v) filter (where dataset = 'ds0'), 6) as ds0, round(max(v) filter (where dataset = 'ds1'), 6) as ds1,
  round(max(v) filter (where dataset = 'ds2'), 6) as ds2,
  cast(list_position([{', '.join(repr(m) for m in METRICS)}], metric) as integer) as metric_order from f group by metric""",
       views=["fx_scores"])
def a9_cross_dataset_table(spark, sf):
    f1 = A.macro_f1(view(spark, sf, "fx_scores"), ["dataset", "metric"])
    t = A.cross_dataset_table(f1, "f1", DATASETS, METRICS)
    return _r(t, DATASETS)


@query("a10_final_table", f"""with {_SCORE_TABLE_SQL}
select metric, max(pair) filter (where dataset = 'ds0') as ds0_pair, max(difference) filter (where dataset = 'ds0') as ds0_difference,
  max(pair) filter (where dataset = 'ds1') as ds1_pair, max(difference) filter (where dataset = 'ds1') as ds1_difference,
  max(pair) filter (where dataset = 'ds2') as ds2_pair, max(difference) filter (where dataset = 'ds2') as ds2_difference
from st2 group by metric""", views=["fx_scores"])
def a10_final_table(spark, sf):
    return A.final_table(A.score_table(view(spark, sf, "fx_scores")), DATASETS)


def _wide_scores(spark, sf):
    s = view(spark, sf, "fx_scores")
    return s.groupBy("dataset", "metric", "row_id").agg(
        F.max(F.when(F.col("label") == 1, F.col("score"))).alias("correct"),
        F.max(F.when(F.col("label") == 0, F.col("score"))).alias("incorrect"),
    )


@query("a11_threshold_curve", """with w as (select dataset, metric, row_id, max(score) filter (where label = 1) as correct,
  max(score) filter (where label = 0) as incorrect from fx_scores group by dataset, metric, row_id),
c as (select * from w where correct is not null and incorrect is not null),
g as (select unnest(range(0, 100)) as j),
gt as (select j, case when j >= 99 then 1.0 else j * (1.0::double / 99.0::double) end as t from g)
select c.dataset, c.metric, cast(gt.j as integer) as j, round(gt.t, 6) as t,
  round(count(*) filter (where c.correct - c.incorrect > gt.t and c.incorrect < 0.5 and c.correct > 0.5) / count(*) * 100, 6) as pct
from c cross join gt group by c.dataset, c.metric, gt.j, gt.t""", views=["fx_scores"])
def a11_threshold_curve(spark, sf):
    x = A.threshold_curve(_wide_scores(spark, sf), ["dataset", "metric"])
    return _r(x, ["t", "pct"])


@query("a12_flatten_triplets", "select dataset, row_id, label, " + ", ".join(
    f"max(score) filter (where metric = '{m}') as {m}" for m in METRICS) + " from fx_scores group by dataset, row_id, label",
       views=["fx_scores"])
def a12_flatten_triplets(spark, sf):
    s = view(spark, sf, "fx_scores")
    pivot_cols = [f"{side}_{m}" for side in ("correct", "incorrect") for m in METRICS]
    wide = s.withColumn("_c", F.concat(F.when(F.col("label") == 1, "correct_").otherwise("incorrect_"), "metric")).groupBy(
        "dataset", "row_id").pivot("_c", pivot_cols).agg(F.max("score"))
    return G.flatten_triplets(wide, METRICS)


def _merged(spark, sf):
    return G.attach_human(view(spark, sf, "fx_human"), view(spark, sf, "fx_scores"))


_MERGED_SQL = """mg as (select h.dataset, h.row_id, h.label, h.annotator, h.human_score / 5.0 as human, m.metric,
  case when m.metric in ('bleurt') then greatest(least(m.score, 1.0), 0.0) else m.score end as score
  from fx_human h join fx_scores m on m.dataset = h.dataset and m.row_id = h.row_id and m.label = h.label)"""


@query("a13_attach_human", f"with {_MERGED_SQL} select dataset, row_id, label, annotator, metric, round(score, 6) as score, human from mg",
       views=["fx_human", "fx_scores"])
def a13_attach_human(spark, sf):
    m = _merged(spark, sf)
    return m.select("dataset", "row_id", "label", "annotator", "metric", F.round("score", R6).alias("score"), "human")


@query("a14_ccc", f"""with {_MERGED_SQL}
select dataset, metric, round(2 * covar_pop(score, human) / (var_pop(score) + var_pop(human) + pow(avg(score) - avg(human), 2)), 6) as ccc
from mg group by dataset, metric""", views=["fx_human", "fx_scores"])
def a14_ccc(spark, sf):
    return _r(G.ccc(_merged(spark, sf), "score", "human", ["dataset", "metric"]), ["ccc"])


def _merged_wide(spark, sf):
    m = _merged(spark, sf)
    return m.groupBy(*SAMPLE, "human").pivot("metric", METRICS).agg(F.max("score"))


_CCC_COLS = METRICS + ["human"]


def _ccc_matrix_sql():
    wide_cols = ", ".join(f"max(score) filter (where metric = '{m}') as {m}" for m in METRICS)
    sel = " union all ".join(
        f"select '{a}' as a, '{b}' as b, 100 * 2 * covar_pop({a}, {b}) / (var_pop({a}) + var_pop({b}) + pow(avg({a}) - avg({b}), 2)) as ccc from w"
        for a in _CCC_COLS for b in _CCC_COLS
    )
    return f"""with {_MERGED_SQL},
w as (select dataset, row_id, label, annotator, human, {wide_cols} from mg group by dataset, row_id, label, annotator, human),
u as ({sel})
select a, b, round(ccc, 6) as ccc from u"""


@query("a15_ccc_matrix", _ccc_matrix_sql(), views=["fx_human", "fx_scores"])
def a15_ccc_matrix(spark, sf):
    return _r(G.ccc_matrix(_merged_wide(spark, sf), _CCC_COLS), ["ccc"])


_RANK_SQL = """rk as (select *, round(abs(score - human), 9) as diff from mg),
rk2 as (select *, rank() over (partition by dataset, row_id, label, annotator order by diff)
  + (count(*) over (partition by dataset, row_id, label, annotator, diff) - 1) / 2.0 as rank from rk)"""


def _ranked(spark, sf):
    return G.closeness_rank(_merged(spark, sf), SAMPLE)


@query("a16_closeness_rank", f"""with {_MERGED_SQL}, {_RANK_SQL}
select dataset, row_id, label, annotator, metric, round(diff, 6) as diff, rank from rk2""", views=["fx_human", "fx_scores"])
def a16_closeness_rank(spark, sf):
    r = _ranked(spark, sf)
    return r.select(*SAMPLE, "metric", F.round("diff", R6).alias("diff"), "rank")


_STAT_EXPR = {
    "r_at_1": f"avg(case when diff <= {HUMAN_THRESHOLD} or rank = 1.0 then 1.0 else 0.0 end) * 100",
    "mae": "avg(diff) * 100",
    "dcg": f"avg(case when diff <= {HUMAN_THRESHOLD} then 1.0 else 1.0 / log2(rank + 1) end) * 100",
}


def _stat_query(name, col):
    sql = f"""with {_MERGED_SQL}, {_RANK_SQL}
select dataset, metric, round({_STAT_EXPR[col]}, 6) as {col} from rk2 group by dataset, metric"""

    def fn(spark, sf):
        s = G.rank_stats(_ranked(spark, sf), thr=HUMAN_THRESHOLD, overall=False)
        return s.select("dataset", "metric", F.round(col, R6).alias(col))

    query(name, sql, views=["fx_human", "fx_scores"])(fn)


_stat_query("a17_recall_at_1", "r_at_1")
_stat_query("a18_mean_abs_error", "mae")
_stat_query("a19_avg_dcg", "dcg")


@query("a20_per_dataset_and_overall", f"""with {_MERGED_SQL}, {_RANK_SQL}
select coalesce(dataset, 'Overall') as dataset, metric, round({_STAT_EXPR['r_at_1']}, 6) as r_at_1, round({_STAT_EXPR['mae']}, 6) as mae,
  round({_STAT_EXPR['dcg']}, 6) as dcg from rk2 group by grouping sets ((metric, dataset), (metric))""", views=["fx_human", "fx_scores"])
def a20_per_dataset_and_overall(spark, sf):
    return _r(G.rank_stats(_ranked(spark, sf), thr=HUMAN_THRESHOLD), ["r_at_1", "mae", "dcg"])


@query("a21_score_density", """with st as (select metric, label, count(score) as n, stddev_samp(score) as sd, min(score) as lo, max(score) as hi
  from fx_scores group by metric, label),
b as (select *, sd * pow(n::double, -0.2) as bw from st where sd * pow(n::double, -0.2) > 0),
g as (select b.*, j, (lo - 3.0 * bw) + ((hi + 3.0 * bw) - (lo - 3.0 * bw)) * j / 199.0 as x from b cross join (select unnest(range(0, 200)) as j) u),
d as (select g.metric, g.label, g.j, g.x, sum(exp(-0.5 * ((g.x - s.score) / g.bw) * ((g.x - s.score) / g.bw)) / (g.bw * sqrt(2 * pi()))) / max(g.n) as density
  from g join fx_scores s on s.metric = g.metric and s.label = g.label group by g.metric, g.label, g.j, g.x)
select metric, label, cast(j as integer) as j, round(x, 6) as x, round(density, 6) as density from d""", views=["fx_scores"])
def a21_score_density(spark, sf):
    d = G.score_density(view(spark, sf, "fx_scores"), "score", ["metric", "label"])
    return d.select("metric", "label", F.col("j").cast("int").alias("j"), F.round("x", R6).alias("x"), F.round("density", R6).alias("density"))


@query("a22_rank_by_difference", f"""with {_SCORED_SQL}
select row_id, round(pos_sim, 6) as pos_sim, round(neg_sim, 6) as neg_sim, round(pos_sim - neg_sim, 6) as difference from scored""",
       views=["fx_vec_triplets"])
def a22_rank_by_difference(spark, sf):
    x = A.rank_by_difference(_scored_triplets(spark, sf))
    return _r(x.select("row_id", "pos_sim", "neg_sim", "difference"), ["pos_sim", "neg_sim", "difference"])


@query("a23_value_counts", """select split, label, count(*) as n from fx_labeled group by split, label""", views=["fx_labeled"])
def a23_value_counts(spark, sf):
    return A.value_counts(view(spark, sf, "fx_labeled"), ["split", "label"])

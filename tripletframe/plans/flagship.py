"""Flagship query: labeled documents -> NLI triplets -> embedded -> scored -> summary per split.

labels LEFT JOIN documents (fx_labeled) -> T1 pivot per split -> T2 dedupe ->
token-vector embedding of the three members (E2) -> cosine scores and hinge
(E5) -> loss / mean / std / macro-F1 per split (A1).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tripletframe.functions.keys import hkey_sql
from tripletframe.operators import evalstats as A
from tripletframe.operators import scoring as S
from tripletframe.operators import triplets as T
from tripletframe.plans.registry import query
from tripletframe.plans.scoring_queries import LENGTH, _PAD_SQL, _pad_vector
from tripletframe.plans.triplet_queries import _NLI_PIVOT_SQL
from tripletframe.session import cut_lineage
from tripletframe.sources.fixtures import hashed_vectors, hashed_vectors_sql, text_tokens, text_tokens_sql, view

R6 = 6
SUMMARY = ["loss", "pos_sim_mean", "neg_sim_mean", "pos_sim_std", "neg_sim_std", "diff_mean", "f1"]


def scored_triplets(spark, sf):
    lab = view(spark, sf, "fx_labeled")
    trip = T.dedupe_triplets(T.nli_pivot(lab, group_cols=["split"]).drop("neutral"),
                             keys=("split", "premise", "correct_answer", "incorrect_answer"))
    # the triplet table feeds four branches (three text columns and the final join): write it once
    trip = cut_lineage(trip)
    texts = (trip.select(F.col("premise").alias("text")).union(trip.select(F.col("correct_answer").alias("text")))
             .union(trip.select(F.col("incorrect_answer").alias("text"))).distinct().withColumn("text_id", F.md5("text")))
    tok = text_tokens(texts, "text_id", "text").withColumnRenamed("text_id", "row_id")
    pad = [r["v"] for r in _pad_vector(spark).orderBy("j").collect()]  # the pad token's vector (d values)
    emb = S.embed_texts_arrays(tok, S.vectors_to_arrays(hashed_vectors(tok)), pad, length=LENGTH,
                               texts=texts.select(F.col("text_id").alias("row_id")))
    x = trip
    for col, name in (("premise", "ref"), ("correct_answer", "pos"), ("incorrect_answer", "neg")):
        e = emb.select(F.col("row_id").alias(f"_{name}_id"), F.col("emb").alias(name))
        x = x.withColumn(f"_{name}_id", F.md5(col)).join(e, f"_{name}_id")
    return S.triplet_score(x)


def flagship(spark, sf):
    s = A.triplet_summary(scored_triplets(spark, sf), ["split"])
    return s.select("split", "n_samples", *[F.round(c, R6).alias(c) for c in SUMMARY])


def _flagship_sql():
    pivot = _NLI_PIVOT_SQL.format(g="split,", src="fx_labeled")
    return f"""with t1 as ({pivot}),
txt as (select distinct text, {hkey_sql('text')} as text_id from (select premise as text from t1 union select correct_answer from t1
  union select incorrect_answer from t1)),
tok as ({text_tokens_sql('txt', 'text_id', 'text')}),
vec as ({hashed_vectors_sql('tok')}),
cnt as (select text_id, token, count(*) as k from tok group by text_id, token),
nn as (select text_id, sum(k) as n from cnt group by text_id),
s as (select c.text_id, v.j, sum(c.k * v.v) as s from cnt c join vec v using (token) group by c.text_id, v.j),
pad as ({_PAD_SQL}),
emb as (select s.text_id, s.j, (s.s + greatest({LENGTH} - nn.n, 0) * pad.pv) / greatest(nn.n, {LENGTH}) as e
  from s join nn using (text_id) join pad using (j)),
k as (select split, premise, {hkey_sql('premise')} as rid, {hkey_sql('correct_answer')} as pid, {hkey_sql('incorrect_answer')} as nid from t1),
cp as (select k.split, k.premise, sum(a.e * b.e) as d, sum(a.e * a.e) as na, sum(b.e * b.e) as nb
  from k join emb a on a.text_id = k.rid join emb b on b.text_id = k.pid and b.j = a.j group by k.split, k.premise),
cn as (select k.split, k.premise, sum(a.e * b.e) as d, sum(a.e * a.e) as na, sum(b.e * b.e) as nb
  from k join emb a on a.text_id = k.rid join emb b on b.text_id = k.nid and b.j = a.j group by k.split, k.premise),
sc as (select cp.split, case when cp.na * cp.nb > 0 then cp.d / sqrt(cp.na * cp.nb) else 0 end as pos_sim,
  case when cn.na * cn.nb > 0 then cn.d / sqrt(cn.na * cn.nb) else 0 end as neg_sim from cp join cn using (split, premise)),
a as (select split, avg(greatest(0.0, 1.0 + neg_sim - pos_sim)) as loss, avg(pos_sim) as pos_sim_mean, avg(neg_sim) as neg_sim_mean,
  stddev_pop(pos_sim) as pos_sim_std, stddev_pop(neg_sim) as neg_sim_std, avg(pos_sim - neg_sim) as diff_mean,
  sum(case when pos_sim >= 0.5 then 1 else 0 end) as tp, sum(case when neg_sim >= 0.5 then 1 else 0 end) as fp, count(*) as n_samples
  from sc group by split),
b as (select *, n_samples - tp as fn, n_samples - fp as tn from a)
select split, n_samples, round(loss, 6) as loss, round(pos_sim_mean, 6) as pos_sim_mean, round(neg_sim_mean, 6) as neg_sim_mean,
  round(pos_sim_std, 6) as pos_sim_std, round(neg_sim_std, 6) as neg_sim_std, round(diff_mean, 6) as diff_mean,
  round(case when (case when tp + fn + fp > 0 then 1 else 0 end) + (case when tn + fp + fn > 0 then 1 else 0 end) > 0 then
  ((case when tp + fn + fp > 0 then (case when 2 * tp + fp + fn > 0 then 2.0 * tp / (2 * tp + fp + fn) else 0 end) else 0 end)
  + (case when tn + fp + fn > 0 then (case when 2 * tn + fn + fp > 0 then 2.0 * tn / (2 * tn + fn + fp) else 0 end) else 0 end))
  / ((case when tp + fn + fp > 0 then 1 else 0 end) + (case when tn + fp + fn > 0 then 1 else 0 end)) end, 6) as f1 from b"""


query("flagship_triplet_eval", _flagship_sql(), views=["fx_labeled"])(flagship)

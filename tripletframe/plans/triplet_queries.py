"""Registered queries for triplet construction and negative sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripletframe.functions import columns as P
from tripletframe.functions.keys import hkey_sql
from tripletframe.operators import triplets as T
from tripletframe.plans.registry import query
from tripletframe.plans.sqlgen import negatives_ctes, with_ctes
from tripletframe.sources.fixtures import view

# Batch of the training-set writer; T4's registered query uses a smaller one so
# that the test tables span several batches.
T4_BATCH = 100
RESERVOIR_K = 1000
BALANCED_K = 150

_NLI_PIVOT_SQL = """select {g} premise,
  arg_min(hypothesis, row_id) filter (where label = 0 and hypothesis is not null) as correct_answer,
  arg_min(hypothesis, row_id) filter (where label = 1 and hypothesis is not null) as neutral,
  arg_min(hypothesis, row_id) filter (where label = 2 and hypothesis is not null) as incorrect_answer,
  least(min(row_id) filter (where label = 0 and hypothesis is not null),
        min(row_id) filter (where label = 2 and hypothesis is not null)) as row_id
from {src} where label in (0, 1, 2) and premise is not null group by {g} premise
having correct_answer is not null and incorrect_answer is not null"""


@query("t1_nli_pivot", _NLI_PIVOT_SQL.format(g="split,", src="fx_labeled"), views=["fx_labeled"])
def t1_nli_pivot(spark, sf):
    return T.nli_pivot(view(spark, sf, "fx_labeled"), group_cols=["split"])


@query(
    "t2_dedupe_triplets",
    "with u as ("
    + _NLI_PIVOT_SQL.format(g="", src="(select * from fx_labeled where split = 'train')")
    + "\nunion all\n"
    + _NLI_PIVOT_SQL.format(g="", src="fx_labeled")
    + """)
select premise, correct_answer, incorrect_answer, min(row_id) as row_id
from u group by premise, correct_answer, incorrect_answer""",
    views=["fx_labeled"],
)
def t2_dedupe_triplets(spark, sf):
    lab = view(spark, sf, "fx_labeled")
    u = T.nli_pivot(lab.where("split = 'train'")).unionByName(T.nli_pivot(lab))
    return T.dedupe_triplets(u.drop("neutral"))


def _neg_query(batch=None):
    ctes, rel = negatives_ctes("fx_pairs", "correct_answer", "row_id", "incorrect_answer", batch)
    return with_ctes(ctes, f"select row_id, premise, correct_answer, incorrect_answer from {rel}")


@query("t3_sample_negatives", _neg_query(), views=["fx_pairs"])
def t3_sample_negatives(spark, sf):
    x = view(spark, sf, "fx_pairs").drop("raw_score")
    return T.sample_negatives(x).select("row_id", "premise", "correct_answer", "incorrect_answer")


@query("t4_sample_negatives_batch", _neg_query(T4_BATCH), views=["fx_pairs"])
def t4_sample_negatives_batch(spark, sf):
    x = view(spark, sf, "fx_pairs").drop("raw_score")
    return T.sample_negatives_batch(x, batch_size=T4_BATCH).select("row_id", "premise", "correct_answer", "incorrect_answer")


def _distinct_sql(batch: int | None) -> str:
    """Equal texts side by side in hash order; the partner's number lies outside the text's own rows."""
    group = "split, run" if batch else "split"
    last = f"greatest(1, cast(ceil((gn - 1) / {batch}) as bigint)) - 1" if batch else "0"
    run = f"least(p0 // {batch}, {last})" if batch else "0"
    return f"""with k as (select row_id, split, premise as correct_answer, md5(premise) as tk, {hkey_sql("'neg'", 'row_id')} as hr from fx_labeled),
k1 as (select *, row_number() over (partition by split order by hr, row_id) - 1 as p0, count(*) over (partition by split) as gn from k),
k2 as (select *, {run} as run, {hkey_sql("'neg|text'", 'tk')} as ht from k1),
k3 as (select *, row_number() over (partition by {group} order by ht, tk, hr, row_id) - 1 as p, count(*) over (partition by {group}) as n, count(*) over (partition by {group}, tk) as m from k2),
k4 as (select *, min(p) over (partition by {group}, tk) as s from k3),
k5 as (select *, case when n > m then (s + m + {hkey_sql("'neg|pick'", 'row_id')} % (n - m)) % n end as t from k4)
select a.row_id, a.split, a.correct_answer, b.correct_answer as incorrect_answer from k5 a join k5 b on a.split = b.split and a.run = b.run and a.t = b.p"""


def _distinct(spark, sf, batch=None):
    x = view(spark, sf, "fx_labeled").select("row_id", "split", F.col("premise").alias("correct_answer"))
    return T.sample_negatives(x, group_cols=["split"], batch_size=batch, distinct_text=True).select("row_id", "split", "correct_answer", "incorrect_answer")


@query("t3d_distinct_negatives", _distinct_sql(None), views=["fx_labeled"])
def t3d_distinct_negatives(spark, sf):
    """T3 over texts that repeat often: the negative is another text, drawn in proportion to its rows."""
    return _distinct(spark, sf)


@query("t4d_distinct_negatives_batch", _distinct_sql(T4_BATCH), views=["fx_labeled"])
def t4d_distinct_negatives_batch(spark, sf):
    return _distinct(spark, sf, T4_BATCH)


def _caption_sql():
    hd = hkey_sql("'cap'", "image_id", "caption")
    himg = hkey_sql("'img'", "image_id")
    hr = hkey_sql("'caprow'", "row_id")
    return f"""with rows_ as (select row_id, image_id, caption from fx_captions where caption is not null),
d as (select image_id, caption, row_number() over (partition by image_id order by {hd}, caption) - 1 as k,
  count(*) over (partition by image_id) as m from (select distinct image_id, caption from rows_)),
img as (select image_id, c, row_number() over (order by {himg}, image_id) - 1 as g, count(*) over () as ng
  from (select image_id, count(*) as c from rows_ group by image_id)),
cr as (select row_id, image_id, caption, row_number() over (partition by image_id order by {hr}, row_id) - 1 as r from rows_),
x as (select r.row_id, r.image_id, r.caption, d.k, d.m from rows_ r join d using (image_id, caption) where d.m > 1),
x2 as (select x.*, (x.k + 1 + {hkey_sql("'pos'", 'x.row_id')} % (x.m - 1)) % x.m as pk from x),
x3 as (select x2.row_id, x2.caption, p.caption as correct_answer, i.g, i.ng from x2
  join d p on p.image_id = x2.image_id and p.k = x2.pk join img i on i.image_id = x2.image_id where i.ng > 1),
x4 as (select x3.*, (x3.g + 1 + {hkey_sql("'negimg'", 'x3.row_id')} % (x3.ng - 1)) % x3.ng as og from x3),
x5 as (select x4.*, o.image_id as oimg, {hkey_sql("'negcap'", 'x4.row_id')} % o.c as orr from x4 join img o on o.g = x4.og)
select x5.row_id, x5.caption as premise, x5.correct_answer, cr.caption as incorrect_answer
from x5 join cr on cr.image_id = x5.oimg and cr.r = x5.orr"""


@query("t5_caption_triplets", _caption_sql(), views=["fx_captions"])
def t5_caption_triplets(spark, sf):
    return T.caption_triplets(view(spark, sf, "fx_captions"))


def _image_lists(spark, sf):
    """Caption lists per image (the caption-list corpus), ordered by caption row."""
    c = view(spark, sf, "fx_captions")
    return c.groupBy("image_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("row_id", "caption"))), lambda s: s["caption"]).alias("answer"),
        F.min("row_id").alias("row_id"),
    )


def _t6_sql():
    ctes = [
        "lists as (select image_id, list(caption order by row_id) as answer, min(row_id) as row_id from fx_captions group by image_id)",
        """src as (select row_id, array_to_string(answer[1:len(answer) - 1], ' ') as premise, answer[-1] as correct_answer
  from lists where len(answer) > 1)""",
    ]
    nctes, rel = negatives_ctes("src", "correct_answer", "row_id", "incorrect_answer")
    return with_ctes(ctes + nctes, f"""select row_id, premise, correct_answer, incorrect_answer from {rel}
where premise is not null and correct_answer is not null and incorrect_answer is not null""")


@query("t6_caption_concat_triplets", _t6_sql(), views=["fx_captions"])
def t6_caption_concat_triplets(spark, sf):
    return T.caption_concat_triplets(_image_lists(spark, sf)).select("row_id", "premise", "correct_answer", "incorrect_answer")


@query("t7_answer_list_triplets", """with c as (select q_id,
  list_filter(correct_answers, lambda x: x <> 'I have no comment' and length(x) > 2) as ca,
  list_filter(incorrect_answers, lambda x: x <> 'I have no comment' and length(x) > 2) as ia from fx_answers)
select q_id, ca[-1] as premise, ca[1] as correct_answer, ia[1] as incorrect_answer from c where len(ca) > 1 and len(ia) > 1""",
       views=["fx_answers"])
def t7_answer_list_triplets(spark, sf):
    return T.answer_list_triplets(view(spark, sf, "fx_answers"))


def _t8_sql():
    ctes = [
        """tv as (select row_id * 2 as row_id, premise, correct_answer, split_part(premise, '.', 1) as _first from fx_pairs
  union all select row_id * 2 + 1, correct_answer, premise, split_part(correct_answer, '.', 1) from fx_pairs)""",
        "tv2 as (select * from tv where premise is not null and correct_answer is not null and _first is not null)",
    ]
    nctes, rel = negatives_ctes("tv2", "_first", "row_id", "incorrect_answer")
    return with_ctes(ctes + nctes, f"""select row_id, premise, correct_answer, incorrect_answer from {rel}
where length(premise) > 3 and length(correct_answer) > 3 and length(incorrect_answer) > 3""")


@query("t8_two_view_union", _t8_sql(), views=["fx_pairs"])
def t8_two_view_union(spark, sf):
    p = view(spark, sf, "fx_pairs").select(
        "row_id",
        F.col("premise").alias("summary1"), F.col("correct_answer").alias("sentences1"),
        F.col("correct_answer").alias("summary2"), F.col("premise").alias("sentences2"),
    )
    return T.two_view_union(p).select("row_id", "premise", "correct_answer", "incorrect_answer")


# NLI label id -> fact label name used to present fx_labeled as a fact corpus.
FACT_NAMES = {0: "SUPPORTS", 2: "REFUTES", 1: "NOT_ENOUGH_INFO"}


def _t9_sql():
    ctes = [
        """fact as (select row_id, split, split_part(hypothesis, '.', 1) as claim, hypothesis as evidence,
  case label when 0 then 'SUPPORTS' when 2 then 'REFUTES' when 1 then 'NOT_ENOUGH_INFO' end as evidence_label from fx_labeled)""",
        """sup as (select row_id, split, evidence as premise, claim as correct_answer from fact where evidence_label = 'SUPPORTS')""",
    ]
    nctes, rel = negatives_ctes("sup", "correct_answer", "row_id", "incorrect_answer", group=("split",))
    return with_ctes(ctes + nctes, f"""select row_id, split, premise, correct_answer, incorrect_answer from {rel}
where correct_answer is not null and incorrect_answer is not null""")


@query("t9_fact_triplets", _t9_sql(), views=["fx_labeled"])
def t9_fact_triplets(spark, sf):
    lab = view(spark, sf, "fx_labeled")
    fact = lab.select(
        "row_id", "split", P.head_sentence("hypothesis").alias("claim"), F.col("hypothesis").alias("evidence"),
        P.label_map("label", FACT_NAMES).alias("evidence_label"),
    )
    return T.fact_triplets(fact).select("row_id", "split", "premise", "correct_answer", "incorrect_answer")


@query("t10_balanced_pairs", f"""with pairs as (select row_id, premise as text1, hypothesis as text2,
  case label when 0 then 1 when 2 then 0 end as label from fx_labeled where label in (0, 2))
select row_id, text1, text2, label from (select *, row_number() over (partition by label
  order by {hkey_sql("'bal'", 'row_id')}, row_id) as rk from pairs) where rk <= {BALANCED_K}""", views=["fx_labeled"])
def t10_balanced_pairs(spark, sf):
    lab = view(spark, sf, "fx_labeled").where(F.col("label").isin(0, 2))
    pairs = lab.select("row_id", F.col("premise").alias("text1"), F.col("hypothesis").alias("text2"),
                       F.when(F.col("label") == 0, 1).otherwise(0).alias("label"))
    return T.balanced_pairs(pairs, k=BALANCED_K, strict=False)


@query("t11_reservoir_sample", f"""select row_id, pos, token from fx_tokens
order by {hkey_sql("'res'", "row_id * 100000 + pos")}, row_id * 100000 + pos limit {RESERVOIR_K}""", views=["fx_tokens"])
def t11_reservoir_sample(spark, sf):
    t = view(spark, sf, "fx_tokens").withColumn("tok_id", F.col("row_id") * 100000 + F.col("pos"))
    return T.reservoir_sample(t, k=RESERVOIR_K, key_col="tok_id").select("row_id", "pos", "token")


def _t12_sql():
    ctes = ["src as (select row_id, premise, correct_answer, raw_score as score from fx_pairs)"]
    nctes, rel = negatives_ctes("src", "correct_answer", "row_id", "incorrect_answer", T.DEFAULT_BATCH)
    return with_ctes(ctes + nctes, f"""select row_id, premise, correct_answer, incorrect_answer, score / 5.0 as score from {rel}
where premise is not null and correct_answer is not null and incorrect_answer is not null and score is not null""")


@query("t12_prepare_source", _t12_sql(), views=["fx_pairs"])
def t12_prepare_source(spark, sf):
    return T.prepare_source(view(spark, sf, "fx_pairs"), "pairs", {"raw_score": "score"})

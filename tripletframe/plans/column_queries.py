"""Registered queries for projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripletframe.functions import columns as P
from tripletframe.functions.keys import hkey, hkey_sql
from tripletframe.operators.indexing import buckets_for, dense_index, hash_range_bucket
from tripletframe.operators.token_ids import token_ids
from tripletframe.plans.registry import query
from tripletframe.session import cut_lineage
from tripletframe.sources.fixtures import table, token_lists, view

R6 = 6  # decimals kept in floating outputs compared with the oracle
ENCODE_LENGTH = 512  # model input length of the reference config
PAD_ID = 0
TOKEN_BYTES = 6  # of a text, about, to a token


@query("p1_rename_map", """select row_id, premise as text1, correct_answer as text2, raw_score as score from fx_pairs""",
       views=["fx_pairs"])
def p1_rename_map(spark, sf):
    x = P.rename_map(view(spark, sf, "fx_pairs"), {"premise": "text1", "correct_answer": "text2", "raw_score": "score"})
    return x.select("row_id", "text1", "text2", "score")


@query("p2_map_label", """select row_id, case label when 0 then 'correct_answer' when 1 then 'neutral'
  when 2 then 'incorrect_answer' end as role from fx_labeled where label in (0, 1, 2)""", views=["fx_labeled"])
def p2_map_label(spark, sf):
    from tripletframe.operators.triplets import NLI_ROLES

    return P.map_label(view(spark, sf, "fx_labeled"), "label", NLI_ROLES, "role").select("row_id", "role")


@query("p3_drop_null", """select d.doc_id, l.quality, l.toxic from documents d left join labels l on d.doc_id = l.doc_id
  where l.quality is not null and l.toxic is not null""")
def p3_drop_null(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    j = d.join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", "quality", "toxic")
    return P.drop_null(j, ["quality", "toxic"])


@query("p4_filter_label", """select row_id, premise, split from fx_labeled where label in (0, 2) and label not in (-1)""",
       views=["fx_labeled"])
def p4_filter_label(spark, sf):
    x = P.filter_label(view(spark, sf, "fx_labeled"), "label", keep=[0, 2], drop=[-1])
    return x.select("row_id", "premise", "split")


@query("p5_min_length", """select row_id from fx_pairs where length(premise) > 3 and length(correct_answer) > 3""",
       views=["fx_pairs"])
def p5_min_length(spark, sf):
    return P.min_length(view(spark, sf, "fx_pairs"), ["premise", "correct_answer"], 3).select("row_id")


@query("p6_clean_answer_list", """select q_id,
  len(list_filter(correct_answers, lambda x: x <> 'I have no comment' and length(x) > 2)) as n_correct,
  len(list_filter(incorrect_answers, lambda x: x <> 'I have no comment' and length(x) > 2)) as n_incorrect,
  array_to_string(list_filter(correct_answers, lambda x: x <> 'I have no comment' and length(x) > 2), ' || ') as correct_joined
from fx_answers""", views=["fx_answers"])
def p6_clean_answer_list(spark, sf):
    x = view(spark, sf, "fx_answers")
    c, i = P.clean_answer_list("correct_answers"), P.clean_answer_list("incorrect_answers")
    return x.select("q_id", F.size(c).cast("long").alias("n_correct"), F.size(i).cast("long").alias("n_incorrect"),
                    F.array_join(c, " || ").alias("correct_joined"))


@query("p7_first_last", """select q_id, correct_answers[-1] as last_answer, correct_answers[1] as first_answer
from fx_answers where len(correct_answers) > 0""", views=["fx_answers"])
def p7_first_last(spark, sf):
    x = view(spark, sf, "fx_answers").where(F.size("correct_answers") > 0)
    last, first = P.first_last("correct_answers")
    return x.select("q_id", last.alias("last_answer"), first.alias("first_answer"))


@query("p8_head_sentence", """select doc_id, split_part(text, '.', 1) as head from documents""")
def p8_head_sentence(spark, sf):
    return table(spark, sf, "documents").select("doc_id", P.head_sentence("text").alias("head"))


@query("p9_join_all_but_last", """select q_id, array_to_string(incorrect_answers[1:len(incorrect_answers) - 1], ' ') as joined
from fx_answers where len(incorrect_answers) > 1""", views=["fx_answers"])
def p9_join_all_but_last(spark, sf):
    x = view(spark, sf, "fx_answers").where(F.size("incorrect_answers") > 1)
    return x.select("q_id", P.join_all_but_last("incorrect_answers").alias("joined"))


@query("p10_norm_score", """select row_id, raw_score / 5 as score from fx_pairs""", views=["fx_pairs"])
def p10_norm_score(spark, sf):
    return view(spark, sf, "fx_pairs").select("row_id", P.norm_score("raw_score").alias("score"))


@query("p11_rescale_signed", f"""select dataset, row_id, label, metric,
  round(case when metric in ('embsim', 'bleurt', 'simcse', 'learned') then (score + 1) / 2 else score end, {R6}) as score
from fx_scores""", views=["fx_scores"])
def p11_rescale_signed(spark, sf):
    x = view(spark, sf, "fx_scores")
    return x.select("dataset", "row_id", "label", "metric", F.round(P.rescale_signed("score", "metric"), R6).alias("score"))


@query("p12_clip01", f"""select dataset, row_id, label, metric, round(greatest(least(score * 2 - 0.5, 1.0), 0.0), {R6}) as score
from fx_scores""", views=["fx_scores"])
def p12_clip01(spark, sf):
    x = view(spark, sf, "fx_scores")
    return x.select("dataset", "row_id", "label", "metric", F.round(P.clip01(F.col("score") * 2 - 0.5), R6).alias("score"))


@query("p13_fmt_pair", """select dataset, metric,
  printf('(%.2f, %.2f)', round(avg(score) filter (where label = 1) * 100, 2), round(avg(score) filter (where label = 0) * 100, 2)) as pair
from fx_scores group by dataset, metric""", views=["fx_scores"])
def p13_fmt_pair(spark, sf):
    x = view(spark, sf, "fx_scores").groupBy("dataset", "metric").agg(
        F.avg(F.when(F.col("label") == 1, F.col("score"))).alias("c"), F.avg(F.when(F.col("label") == 0, F.col("score"))).alias("i")
    )
    return x.select("dataset", "metric", P.fmt_pair("c", "i", 100.0).alias("pair"))


def vocabulary(spark, sf, tokens=None):
    """Token -> id table (ids from 1, 0 is the pad id), numbered in hash order without a single-task window.

    ``tokens``: all tokens of ``fx_tokens``, repeated or not, if the caller has them in another form.
    """
    toks = (view(spark, sf, "fx_tokens") if tokens is None else tokens).select("token").distinct().withColumn("_h", hkey("token"))
    toks = cut_lineage(toks)  # counted, ranked and counted by bucket: texts are cut into tokens once for all
    nb = buckets_for(toks.count())
    v = dense_index(toks, [], ["_h", "token"], hash_range_bucket("_h", nb), "id", None)
    return v.select("token", (F.col("id") + 1).cast("int").alias("id"))


@query("p14_encode_pad", f"""with vocab as (
  select token, cast(row_number() over (order by {hkey_sql('token')}, token) as integer) as id
  from (select distinct token from fx_tokens)),
ids as (select t.row_id, list(v.id order by t.pos) as ids from fx_tokens t join vocab v using (token) group by t.row_id)
select row_id, len(ids) as n_tokens,
  array_to_string(list_concat(ids[1:{ENCODE_LENGTH}], list_resize([{PAD_ID}], greatest({ENCODE_LENGTH} - len(ids), 0), {PAD_ID})), ',') as encoded
from ids""", views=["fx_tokens"])
def p14_encode_pad(spark, sf):
    lists = token_lists(spark, sf)
    n_bytes = table(spark, sf, "documents").agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    vocab = vocabulary(spark, sf, lists.select(F.explode(F.array_distinct("tokens")).alias("token")))
    ids = token_ids(lists, vocab, total=n_bytes // TOKEN_BYTES)
    enc = P.encode_pad("ids", ENCODE_LENGTH, PAD_ID)
    return ids.select("row_id", F.size("ids").cast("long").alias("n_tokens"), F.array_join(enc, ",").alias("encoded"))


@query("p15_clean_tokens", """with marked as (
  select row_id, pos, case when pos > 0 then 'Ġ' || token else token end as token from fx_tokens
  union all select distinct row_id, -1 as pos, '<s>' as token from fx_tokens)
select row_id, pos, regexp_replace(token, '##|Ġ|▁', '', 'g') as token from marked
where token not in ('[CLS]', '[SEP]', '[PAD]', '[UNK]', '[MASK]', '<s>', '</s>', '<pad>', '<unk>', '<|endoftext|>')
  and trim(regexp_replace(token, '##|Ġ|▁', '', 'g')) <> ''""", views=["fx_tokens"])
def p15_clean_tokens(spark, sf):
    t = view(spark, sf, "fx_tokens")
    marked = t.select("row_id", "pos", F.when(F.col("pos") > 0, F.concat(F.lit("Ġ"), "token")).otherwise(F.col("token")).alias("token"))
    bos = t.select("row_id").distinct().select("row_id", F.lit(-1).alias("pos"), F.lit("<s>").alias("token"))
    return P.clean_tokens(marked.unionByName(bos))

"""Registered queries for pair scoring."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import functions as F

from tripletframe.functions.keys import hkey, hkey_sql
from tripletframe.functions.vectors import cosine, cosine_sql_duck
from tripletframe.operators import corpus as C
from tripletframe.operators import evalstats as A
from tripletframe.operators import lexical as L
from tripletframe.operators import scoring as S
from tripletframe.operators import triplets as T
from tripletframe.plans.registry import query
from tripletframe.operators import score_all as E
from tripletframe.operators.quantise import mauve
from tripletframe.plans import score_sql as Q
from tripletframe.plans.sqlgen import negatives_ctes
from tripletframe.sources import io
from tripletframe.sources.fixtures import (
    TOKEN_DIM,
    hashed_vectors,
    hashed_vectors_sql,
    table,
    text_tokens,
    text_tokens_sql,
    view,
)

R6 = 6
LENGTH = 512  # model input length (contexual_dim) of the reference config
NUM_SENSES = 16


def _pad_vector(spark):
    """Vector of the pad token by the same hashing rule as every other token."""
    return spark.range(TOKEN_DIM).select(
        F.col("id").cast("int").alias("j"),
        ((F.pmod(hkey(F.lit(S.PAD_TOKEN), "id"), F.lit(2001)) - 1000).cast("double") / 1000).alias("v"),
    )


_PAD_SQL = f"""select cast(range as integer) as j, cast({hkey_sql("'<pad>'", 'range')} % 2001 - 1000 as double) / 1000 as pv
from range({TOKEN_DIM})"""


def _embed_sql(tokens_rel: str, vectors_rel: str, rounded: bool = True) -> str:
    val = f"(s.s + greatest({LENGTH} - nn.n, 0) * pad.pv) / greatest(nn.n, {LENGTH})"
    return f"""with cnt as (select row_id, token, count(*) as k from {tokens_rel} group by row_id, token),
nn as (select row_id, cast(sum(k) as bigint) as n from cnt group by row_id),
s as (select c.row_id, v.j, sum(c.k * v.v) as s from cnt c join {vectors_rel} v using (token) group by c.row_id, v.j),
pad as ({_PAD_SQL}),
ee as (select s.row_id, nn.n, s.j, {val} as e from s join nn using (row_id) join pad using (j))
select row_id, n, j, {"round(e / sqrt(sum(e * e) over (partition by row_id)), " + str(R6) + ")" if rounded else "e"} as e from ee"""


def _unit(e):
    """Embeddings as unit vectors (what cosine consumes; sums of k/1000 over 512 positions are exact
    decimals whose 6-digit rounding would sit on exact halves)."""
    from pyspark.sql import Window

    norm = F.sqrt(F.sum(F.col("e") * F.col("e")).over(Window.partitionBy("row_id")))
    return e.select("row_id", "n", "j", F.round(F.coalesce(F.try_divide(F.col("e"), norm), F.lit(0.0)), R6).alias("e"))


def _embed_all_sql(texts: str, tokens_rel: str, vectors_rel: str) -> str:
    """:func:`_embed_sql` with a row for every text of ``texts(row_id)``: those without tokens are the pad vector."""
    return _embed_sql(tokens_rel, vectors_rel) + f"""
union all select t.row_id, 0, p.j, round(pv / (select sqrt(sum(pv * pv)) from pad), {R6}) from ({texts}) t cross join pad p
where not exists (select 1 from nn where nn.row_id = t.row_id)"""


_DOCS_SQL = _embed_all_sql("select doc_id as row_id from documents", "fx_tokens", "fx_token_vectors")
_ODD_SQL = _embed_all_sql("select row_id from fx_texts", "odd_tokens", "odd_vectors")
_ODD_SQL = f"with odd_tokens as ({text_tokens_sql('fx_texts', 'row_id', 'text')}),\nodd_vectors as ({hashed_vectors_sql('odd_tokens')}),\n" + _ODD_SQL[5:]


def _doc_ids(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"))


def _token_vector(token: str) -> np.ndarray:
    """The vector of a token by the hashing rule of the vector table."""
    digits = (hashlib.md5(f"42|{token}|{j}".encode()).hexdigest()[:15] for j in range(TOKEN_DIM))
    return np.array([(int(d, 16) % 2001 - 1000) / 1000 for d in digits])


@query("e2_embed_texts", _DOCS_SQL, views=["fx_tokens", "fx_token_vectors"])
def e2_embed_texts(spark, sf):
    e = S.embed_texts(view(spark, sf, "fx_tokens"), view(spark, sf, "fx_token_vectors"), length=LENGTH,
                      pad_vector=_pad_vector(spark), texts=_doc_ids(spark, sf))
    return _unit(e)


@query("e2r_embed_every_text", _ODD_SQL, views=["fx_texts"])
def e2r_embed_every_text(spark, sf):
    """E2 over texts of which three in four have no token (empty, null, non-Latin): rows in are rows out."""
    texts = view(spark, sf, "fx_texts")
    tok = text_tokens(texts, "row_id", "text")
    return _unit(S.embed_texts(tok, hashed_vectors(tok), length=LENGTH, pad_vector=_pad_vector(spark), texts=texts.select("row_id")))


def _infer(texts):
    """E3 over (row_id, text): the encoder makes its token vectors itself, so no table passes through the driver."""
    def load():
        return C.BagEncoder(_token_vector, TOKEN_DIM, LENGTH, _token_vector(S.PAD_TOKEN))

    out = C.batch_infer(texts.select("row_id", L.rouge_tokens("text").alias("tokens")), load, lambda model, b: model.predict(b), "row_id long, n long, j int, e double")
    return _unit(out)


@query("e3_batch_infer", _DOCS_SQL, views=["fx_tokens", "fx_token_vectors"])
def e3_batch_infer(spark, sf):
    """The same bag-of-tokens encoder run as a batched numpy model (one model per task)."""
    return _infer(table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "text"))


@query("e3r_batch_infer_every_text", _ODD_SQL, views=["fx_texts"])
def e3r_batch_infer_every_text(spark, sf):
    return _infer(view(spark, sf, "fx_texts"))


@query("e2a_embed_texts_arrays", _DOCS_SQL, views=["fx_tokens", "fx_token_vectors"])
def e2a_embed_texts_arrays(spark, sf):
    """E2 in the array layout used for wide vectors; same values as e2_embed_texts."""
    e = S.embed_texts_arrays(view(spark, sf, "fx_tokens"), S.vectors_to_arrays(view(spark, sf, "fx_token_vectors")), _pad_list(spark),
                             length=LENGTH, texts=_doc_ids(spark, sf))
    long = e.select("row_id", "n", F.posexplode("emb").alias("j", "e")).withColumn("j", F.col("j").cast("int"))
    return _unit(long)


@query("e4_cosine", f"""select row_id, round({cosine_sql_duck('ref', 'pos')}, {R6}) as cos_ref_pos from fx_vec_triplets""",
       views=["fx_vec_triplets"])
def e4_cosine(spark, sf):
    return view(spark, sf, "fx_vec_triplets").select("row_id", F.round(cosine("ref", "pos"), R6).alias("cos_ref_pos"))


_E5_SQL = f"""with s as (select row_id, label, {cosine_sql_duck('ref', 'pos')} as pos_sim, {cosine_sql_duck('ref', 'neg')} as neg_sim
  from fx_vec_triplets)
select row_id, label, round(pos_sim, {R6}) as pos_sim, round(neg_sim, {R6}) as neg_sim, round(pos_sim - neg_sim, {R6}) as difference,
  round(greatest(0.0, 1.0 + neg_sim - pos_sim), {R6}) as loss from s"""


@query("e5_triplet_score", _E5_SQL, views=["fx_vec_triplets"])
def e5_triplet_score(spark, sf):
    x = S.triplet_score(view(spark, sf, "fx_vec_triplets"))
    return x.select("row_id", "label", *[F.round(c, R6).alias(c) for c in ("pos_sim", "neg_sim", "difference", "loss")])


def _pair_texts(spark, sf):
    """fx_pairs as text rows: premise -> 2 * row_id, answer -> 2 * row_id + 1."""
    p = view(spark, sf, "fx_pairs")
    return p.select((F.col("row_id") * 2).alias("text_id"), F.col("premise").alias("text")).unionByName(
        p.select((F.col("row_id") * 2 + 1).alias("text_id"), F.col("correct_answer").alias("text"))
    )


_PAIR_TOKENS_SQL = (
    "ptxt as (select row_id * 2 as text_id, premise as text from fx_pairs union all "
    "select row_id * 2 + 1, correct_answer from fx_pairs),\n"
    f"ptok as ({text_tokens_sql('ptxt', 'text_id', 'text')}),\n"
    f"pvec as ({hashed_vectors_sql('ptok')})"
)


@query("e6_pair_score", f"""with {_PAIR_TOKENS_SQL},
ptok2 as (select text_id as row_id, pos, token from ptok),
emb as ({_embed_sql('ptok2', 'pvec', rounded=False)}),
j as (select a.row_id // 2 as row_id, sum(a.e * b.e) as d, sum(a.e * a.e) as na, sum(b.e * b.e) as nb
  from emb a join emb b on b.row_id = a.row_id + 1 and b.j = a.j where a.row_id % 2 = 0 group by a.row_id)
select row_id, round(case when na * nb > 0 then d / sqrt(na * nb) else 0 end, {R6}) as score from j""", views=["fx_pairs"])
def e6_pair_score(spark, sf):
    txt = _pair_texts(spark, sf)
    tok = text_tokens(txt, "text_id", "text").withColumnRenamed("text_id", "row_id")
    emb = S.embeddings_as_arrays(S.embed_texts(tok, hashed_vectors(tok), length=LENGTH, pad_vector=_pad_vector(spark),
                                              texts=txt.select(F.col("text_id").alias("row_id"))))
    a = emb.where(F.col("row_id") % 2 == 0).select(F.floor(F.col("row_id") / 2).alias("pid"), F.col("emb").alias("a"))
    b = emb.where(F.col("row_id") % 2 == 1).select(F.floor(F.col("row_id") / 2).alias("pid"), F.col("emb").alias("b"))
    x = S.pair_score(a.join(b, "pid"), "a", "b")
    return x.select(F.col("pid").cast("long").alias("row_id"), F.round("score", R6).alias("score"))


@query("e12_emb_sim", f"""select row_id,
  round(list_dot_product(ref::DOUBLE[], pos::DOUBLE[]) / (sqrt(list_dot_product(ref::DOUBLE[], ref::DOUBLE[])) *
    sqrt(list_dot_product(pos::DOUBLE[], pos::DOUBLE[])) + 1e-8), {R6}) as correct_embsim,
  round(list_dot_product(ref::DOUBLE[], neg::DOUBLE[]) / (sqrt(list_dot_product(ref::DOUBLE[], ref::DOUBLE[])) *
    sqrt(list_dot_product(neg::DOUBLE[], neg::DOUBLE[])) + 1e-8), {R6}) as incorrect_embsim
from fx_vec_triplets""", views=["fx_vec_triplets"])
def e12_emb_sim(spark, sf):
    x = S.emb_sim(S.emb_sim(view(spark, sf, "fx_vec_triplets"), "ref", "pos", "correct_embsim"), "ref", "neg", "incorrect_embsim")
    return x.select("row_id", F.round("correct_embsim", R6).alias("correct_embsim"), F.round("incorrect_embsim", R6).alias("incorrect_embsim"))


@query("e13_bertscore", f"""with {_PAIR_TOKENS_SQL},
bag as (select text_id, token, count(*) as k from ptok group by text_id, token),
vv as (select token, list(v order by j) as vec from pvec group by token),
nv as (select token, case when sqrt(list_dot_product(vec, vec)) > 0 then list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec)))
  else list_transform(vec, lambda x: 0.0) end as vec from vv),
b2 as (select bag.text_id, bag.token, bag.k, nv.vec from bag join nv using (token)),
sims as (select c.text_id // 2 as row_id, c.token as ct, c.k as ck, r.token as rt, r.k as rk, list_dot_product(c.vec, r.vec) as sim
  from b2 c join b2 r on r.text_id = c.text_id - 1 where c.text_id % 2 = 1),
pp as (select row_id, sum(ck * m) / sum(ck) as p from (select row_id, ct, ck, max(sim) as m from sims group by row_id, ct, ck) group by row_id),
rr as (select row_id, sum(rk * m) / sum(rk) as r from (select row_id, rt, rk, max(sim) as m from sims group by row_id, rt, rk) group by row_id)
select row_id, round(p, {R6}) as bert_p, round(r, {R6}) as bert_r,
  round(case when p + r <> 0 then 2 * p * r / (p + r) else 0 end, {R6}) as bert_f from pp join rr using (row_id)""", views=["fx_pairs"])
def e13_bertscore(spark, sf):
    txt = _pair_texts(spark, sf)
    tok = text_tokens(txt, "text_id", "text")
    pairs = view(spark, sf, "fx_pairs").select(
        "row_id", (F.col("row_id") * 2 + 1).alias("cand_id"), (F.col("row_id") * 2).alias("ref_id")
    )
    x = S.bertscore(pairs, tok, hashed_vectors(tok), pair_key="row_id")
    return x.select("row_id", *[F.round(c, R6).alias(c) for c in ("bert_p", "bert_r", "bert_f")])


@query("e15_sim_diag", f"""select row_id, round({cosine_sql_duck('ref', 'neg')}, {R6}) as simcse from fx_vec_triplets""",
       views=["fx_vec_triplets"])
def e15_sim_diag(spark, sf):
    x = S.sim_diag(view(spark, sf, "fx_vec_triplets"), "ref", "neg")
    return x.select("row_id", F.round("simcse", R6).alias("simcse"))


# ---------------------------------------------------------------- lexical

def _lex_arrays(spark, sf, use_stemmer=False):
    p = view(spark, sf, "fx_pairs")
    return L.token_arrays(p.withColumnRenamed("row_id", "pair_id"), "pair_id", "correct_answer", "premise", use_stemmer)


_TOKS = "list_filter(string_split(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')"


def _grams_sql(arr: str, n: int) -> str:
    if n == 1:
        return arr
    return (f"case when len({arr}) >= {n} then list_transform(range(0, len({arr}) - {n - 1}), "
            f"lambda i: array_to_string({arr}[i + 1:i + {n}], ' ')) else [] end")


def _rouge_sql(n: int) -> str:
    return f"""with a as (select row_id as pair_id, {_TOKS.format(c='correct_answer')} as g, {_TOKS.format(c='premise')} as r from fx_pairs),
gg as (select pair_id, {_grams_sql('g', n)} as grams, 0 as side from a
  union all select pair_id, {_grams_sql('r', n)} as grams, 1 as side from a),
l as (select pair_id, unnest(grams) as gram, side from gg),
c as (select pair_id, gram, sum(1 - side) as kg, sum(side) as kr from l group by pair_id, gram),
s as (select pair_id, sum(kg) as ng, sum(kr) as nr, sum(least(kg, kr)) as ov from c group by pair_id),
o as (select a.pair_id, coalesce(ng, 0) as ng, coalesce(nr, 0) as nr, coalesce(ov, 0) as ov from a left join s using (pair_id)),
m as (select pair_id, ov / greatest(ng, 1) as p, ov / greatest(nr, 1) as r from o)
select pair_id, round(p, {R6}) as r{n}_p, round(r, {R6}) as r{n}_r,
  round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, {R6}) as r{n}f1 from m"""


def _rouge_query(n):
    def fn(spark, sf):
        x = L.rouge_n(_lex_arrays(spark, sf), n)
        return x.select("pair_id", *[F.round(c, R6).alias(c) for c in (f"r{n}_p", f"r{n}_r", f"r{n}f1")])

    return fn


query("e7_rouge1_f", _rouge_sql(1), views=["fx_pairs"])(_rouge_query(1))
query("e8_rouge2_f", _rouge_sql(2), views=["fx_pairs"])(_rouge_query(2))


_PAIRS_LNG = "lng as (select row_id as pair_id, row_id, raw_score as label, premise as reference, correct_answer as candidate from fx_pairs)"


def _lexical_sql(ctes: list[str], tail: str) -> str:
    return "with " + ",\n".join([_PAIRS_LNG, Q.token_ctes(), *ctes]) + "\n" + tail


@query("e9_rougeL_f", _lexical_sql([Q.rouge_ctes()], f"""select pair_id, round(case when ng > 0 then ov / ng else 0.0 end, {R6}) as rL_p,
  round(case when nr > 0 then ov / nr else 0.0 end, {R6}) as rL_r, round(score, {R6}) as rLf1 from lcs join rLf1 using (pair_id)"""), views=["fx_pairs"])
def e9_rougel_f(spark, sf):
    """ROUGE-L with stemming, as the reference runs it (LCS in an Arrow UDF; the oracle folds rows of a running maximum)."""
    return _round(L.rouge_l(_lex_arrays(spark, sf, use_stemmer=True)), "rL_p", "rL_r", "rLf1")


@query("e10_stem_vocab", f"""with tokens as (select token as word from fx_tokens),
{Q.stem_ctes('tokens')}
select word, stem from stems""", views=["fx_tokens"])
def e10_stem_vocab(spark, sf):
    """Porter stems of every distinct document word (Python once per distinct word)."""
    words = view(spark, sf, "fx_tokens").select(F.col("token").alias("word"))
    return L.stem_vocab(words)


#: Words of five letters or more that begin with the same four and are equally long are taken as synonyms.
_SYNSETS_SQL = "synsets as (select distinct word, left(word, 4) || length(word) as synset from tok where length(word) > 4)"


def _synsets(words):
    d = words.select("word").distinct().where(F.length("word") > 4)
    return d.select("word", F.concat(F.substring("word", 1, 4), F.length("word").cast("string")).alias("synset"))


@query("e11_meteor", _lexical_sql([Q.meteor_ctes()], f"select pair_id, round(score, {R6}) as meteor from meteor"), views=["fx_pairs"])
def e11_meteor(spark, sf):
    return _round(L.meteor(_lex_arrays(spark, sf)), "meteor")


@query("e11s_meteor_synonyms", _lexical_sql([_SYNSETS_SQL, Q.meteor_ctes("synsets")], f"select pair_id, round(score, {R6}) as meteor from meteor"), views=["fx_pairs"])
def e11s_meteor_synonyms(spark, sf):
    """METEOR with its third stage: a (word, synset) table joined to the words."""
    arrays = _lex_arrays(spark, sf)
    words = arrays.select(F.explode(F.concat("g", "r")).alias("word"))
    return _round(L.meteor(arrays, synonyms=_synsets(words)), "meteor")


@query("e7s_rouge_stemmed", _lexical_sql([Q.rouge_ctes()], ",".join([
    "select arr.pair_id",
    *(f"""round(coalesce(ov{n}.ov / greatest(ov{n}.{k}, 1), 0.0), {R6}) as r{n}_{c}""" for n in (1, 2) for k, c in (("ng", "p"), ("nr", "r"))),
    *(f"round(r{n}f1.score, {R6}) as r{n}f1" for n in (1, 2))])
    + " from arr left join ov1 using (pair_id) left join ov2 using (pair_id) join r1f1 using (pair_id) join r2f1 using (pair_id)"), views=["fx_pairs"])
def e7s_rouge_stemmed(spark, sf):
    """ROUGE-1 / ROUGE-2 with the Porter stemmer on (the reference's setting)."""
    arr = _lex_arrays(spark, sf, use_stemmer=True)
    return _round(L.rouge_n(arr, 1).join(L.rouge_n(arr, 2), "pair_id"), "r1_p", "r1_r", "r1f1", "r2_p", "r2_r", "r2f1")


# ---------------------------------------------------------------- E1, E14, E16, E17

#: Shapes of the sense network's matrices by the hashing rule, in units of 1/1000 times the scale.
_SENSE_SHAPES = {"fc": (TOKEN_DIM, 4 * TOKEN_DIM, 0.2), "proj": (4 * TOKEN_DIM, TOKEN_DIM, 0.2), "ffc": (TOKEN_DIM, 4 * TOKEN_DIM, 0.2),
                 "fproj": (4 * TOKEN_DIM, TOKEN_DIM * NUM_SENSES, 0.2), "T": (TOKEN_DIM, TOKEN_DIM, 1.0)}


def _sense_weights() -> dict:
    """Weights that both engines can make: hashed numbers in the network's shapes, plain normalisations, no biases."""
    def cell(name, i, j):
        return (int(hashlib.md5(f"42|{name}|{i}|{j}".encode()).hexdigest()[:15], 16) % 2001 - 1000) / 1000

    w = C.init_sense_weights(TOKEN_DIM, NUM_SENSES)
    for name, (n, m, scale) in _SENSE_SHAPES.items():
        w[name if name == "T" else f"{name}_w"] = np.array([[cell(name, i, j) * scale for j in range(m)] for i in range(n)])
    return w


def _sense_matrix_sql(name: str, columns: str) -> str:
    """Rows of the transposed matrix: one list per column number of ``columns``."""
    n, _, scale = _SENSE_SHAPES[name]
    return f"list_transform({columns}, lambda j: list_transform(range({n}), lambda i: cast({hkey_sql(repr(name), 'i', 'j')} % 2001 - 1000 as double) / 1000 * {scale}))"


def _senses_sql() -> str:
    """The network as list expressions; of the senses the first, the last and (by linearity) their projected mean."""
    ln = lambda v: f"list_transform({v}, lambda p: (p - list_avg({v})) / sqrt(list_avg(list_transform({v}, lambda q: (q - list_avg({v})) * (q - list_avg({v})))) + 1e-5))"
    gelu = lambda v: f"list_transform({v}, lambda x: 0.5 * x * (1 + tanh(sqrt(2 / pi()) * (x + 0.044715 * x * x * x))))"
    times = lambda v, m: f"list_transform({m}, lambda r: list_dot_product({v}, r))"
    add = lambda a, b: f"list_transform(list_zip({a}, {b}), lambda z: z[1] + z[2])"
    d, last = TOKEN_DIM, TOKEN_DIM * (NUM_SENSES - 1)
    mean = f"list_transform(range({d}), lambda j: list_transform(range({4 * d}), lambda i: list_avg(list_transform(range({NUM_SENSES}), lambda s: cast({hkey_sql(repr('fproj'), 'i', f's * {d} + j')} % 2001 - 1000 as double) / 1000 * 0.2))))"
    return f"""with w as materialized (select {_sense_matrix_sql('fc', f'range({4 * d})')} as fc, {_sense_matrix_sql('proj', f'range({d})')} as proj,
  {_sense_matrix_sql('ffc', f'range({4 * d})')} as ffc, {_sense_matrix_sql('fproj', f'range({d})')} as s_first, {_sense_matrix_sql('fproj', f'range({last}, {last + d})')} as s_last,
  {mean} as s_mean, {_sense_matrix_sql('T', f'range({d})')} as t),
x0 as (select token, list(v order by j) as x from fx_token_vectors group by token),
x1 as (select token, x, {ln('x')} as h from x0),
x2 as (select token, {add('h', 'x')} as res from x1),
x3 as (select token, res, {ln('res')} as hs from x2),
x4 as (select token, res, {times('hs', 'w.fc')} as a from x3, w),
x5 as (select token, res, {gelu('a')} as a from x4),
x6 as (select token, {times('a', 'w.proj')} as m, res from x5, w),
x7 as (select token, {add('m', 'res')} as res from x6),
x8 as (select token, {ln('res')} as o from x7),
x9 as (select token, {times('o', 'w.ffc')} as b from x8, w),
x10 as (select token, {gelu('b')} as b from x9),
x11 as (select token, {times('b', 'w.s_first')} as s_first, {times('b', 'w.s_last')} as s_last, {times('b', 'w.s_mean')} as s_mean from x10, w),
senses as (select token, x11.s_first, x11.s_last, {times("x11.s_mean", "w.t")} as g from x11, w)"""


def _sense_table(spark, sf):
    """E1 over the vocabulary, written once under a version of its own."""
    vocab = S.vectors_to_arrays(view(spark, sf, "fx_token_vectors"))
    return C.write_token_table(C.token_senses(vocab, _sense_weights()), io.scratch_path(spark, "tokens"), "hashed-1")


@query("e1_token_senses", _senses_sql() + f"""
select token, {NUM_SENSES} as n_senses, round(s_first[1], {R6}) as sense_first, round(list_sum(s_last), {R6}) as sense_last_sum,
  round(g[1], {R6}) as g_first, round(g[{TOKEN_DIM}], {R6}) as g_last, round(sqrt(list_dot_product(g, g)), {R6}) as g_norm from senses""", views=["fx_token_vectors"])
def e1_token_senses(spark, sf):
    """Sense network over the vocabulary: numbers of every token's senses and of their projected mean."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    t = _sense_table(spark, sf)
    x = t.select("token", F.size("senses").alias("n_senses"), F.element_at(F.element_at("senses", 1), 1).alias("sense_first"), total(F.element_at("senses", -1)).alias("sense_last_sum"),
                 F.element_at("vec", 1).alias("g_first"), F.element_at("vec", -1).alias("g_last"), F.sqrt(total(F.transform("vec", lambda v: v * v))).alias("g_norm"))
    return _round(x, "sense_first", "sense_last_sum", "g_first", "g_last", "g_norm")


@query("e1e_embed_from_senses", _senses_sql() + f""",
cnt as (select row_id, token, count(*) as k from fx_tokens group by all),
nn as (select row_id, cast(sum(k) as bigint) as n from cnt group by row_id),
e as (select row_id, j, sum(k * g[j + 1]) as s from cnt join senses using (token), (select unnest(range({TOKEN_DIM})) as j) group by all)
select row_id, n, cast(j as integer) as j, round(s / n / sqrt(sum(s / n * s / n) over (partition by row_id)), {R6}) as e from e join nn using (row_id)""",
       views=["fx_tokens", "fx_token_vectors"])
def e1e_embed_from_senses(spark, sf):
    """Embeddings of the documents from the written token table of the sense network (plain means)."""
    t = _sense_table(spark, sf)
    e = S.embed_texts_arrays(view(spark, sf, "fx_tokens"), t.select("token", "vec"), [0.0] * TOKEN_DIM, length=1)
    return _unit(e.select("row_id", "n", F.posexplode("emb").alias("j", "e")))


def _triplets_lng() -> list[str]:
    ctes, rel = negatives_ctes("fx_pairs", "correct_answer", "row_id", "incorrect_answer")
    return [*ctes, f"""lng as (select row_id * 2 + 1 as pair_id, row_id, 1 as label, premise as reference, correct_answer as candidate from {rel}
  union all select row_id * 2, row_id, 0, premise, incorrect_answer from {rel})"""]


def _triplet_scores(spark, sf):
    """Every metric of the T3 triplets of fx_pairs, reference against both answers."""
    trip = T.sample_negatives(view(spark, sf, "fx_pairs").drop("raw_score"))
    return E.score_all(trip, vectors=hashed_vectors, pad=_pad_list(spark))


def _pad_list(spark) -> list[float]:
    return [r["v"] for r in _pad_vector(spark).orderBy("j").collect()]  # one vector of the model


def _round(df, *cols):
    return df.withColumns({c: F.round(c, R6) for c in cols})


@query("e17_score_all", Q.score_sql(_triplets_lng(), f"select pair_id, row_id, label, metric, round(score, {R6}) as score from scores"), views=["fx_pairs"])
def e17_score_all(spark, sf):
    return _round(_triplet_scores(spark, sf), "score")


@query("e17p_score_pairs", Q.score_sql([_PAIRS_LNG], f"select pair_id, row_id, label, metric, round(score, {R6}) as score from scores"), views=["fx_pairs"])
def e17p_score_pairs(spark, sf):
    """The pair branch: second text against the first, the learned metric fitted on the pairs' own scores."""
    pairs = view(spark, sf, "fx_pairs").select("row_id", F.col("premise").alias("text1"), F.col("correct_answer").alias("text2"), "raw_score")
    return _round(E.score_all(pairs, kind="pairs", label_col="raw_score", vectors=hashed_vectors, pad=_pad_list(spark)), "score")


@query("e14_learned_pair_score", Q.score_sql(_triplets_lng(), f"""select pair_id, row_id, label, round(score, {R6}) as learned,
  {', '.join(f'round(b[{i + 1}], 4) as w_{c}' for i, c in enumerate(('intercept', *Q.FEATURES)))} from scores, beta where metric = 'learned'"""), views=["fx_pairs"])
def e14_learned_pair_score(spark, sf):
    """Least squares of the label on the metrics E7-E13 of every scored pair, with its coefficients."""
    long = E.cut_lineage(_triplet_scores(spark, sf).where("metric <> 'learned'"))
    cols = list(E.METRICS)
    wide = long.groupBy("pair_id", "row_id", "label").pivot("metric", cols).agg(F.first("score"))
    w = E.fit_linear(wide, cols)
    found = E.predict_linear(wide, cols, w)
    return found.select("pair_id", "row_id", "label", F.round("learned", R6).alias("learned"), *(F.round(F.lit(x), 4).alias(f"w_{c}") for c, x in zip(["intercept", *cols], w)))


@query("a8e_score_table_of_scores", Q.score_sql(_triplets_lng(), """, st as (select metric, round(avg(score) filter (where label = 1) * 100, 2) as correct,
  round(avg(score) filter (where label = 0) * 100, 2) as incorrect from scores group by metric)
select 'pairs' as dataset, metric, correct, incorrect, cast(round((cast(correct as decimal(14, 2)) - cast(incorrect as decimal(14, 2)))
  * case when metric in ('embsim', 'bleurt', 'simcse', 'learned') then 0.5 else 1.0 end, 2) as double) as difference,
  printf('(%.2f, %.2f)', correct, incorrect) as pair from st"""), views=["fx_pairs"])
def a8e_score_table_of_scores(spark, sf):
    """The score table (A8) of the metrics that E17 computed."""
    return A.score_table(_triplet_scores(spark, sf).withColumn("dataset", F.lit("pairs")))


_MAUVE_SQL = """with a as (select 'correct' as cand, label as cluster, 'p' as side from fx_vec_triplets
  union all select 'correct', label, 'q' from fx_vec_triplets
  union all select 'incorrect', (label + 1) % 10, 'p' from fx_vec_triplets
  union all select 'incorrect', label, 'q' from fx_vec_triplets),
h as (select cand, cluster, sum(case when side = 'p' then 1 else 0 end) as cp, sum(case when side = 'q' then 1 else 0 end) as cq
  from a group by cand, cluster),
t as (select cand, sum(cp) as np, sum(cq) as nq from h group by cand),
hp as (select h.cand, h.cluster, cp / np as p, cq / nq as q from h join t using (cand)),
x as (select hp.*, 1e-6 + k * ((1 - 2e-6) / 24) as w, k from hp cross join (select unnest(range(0, 25)) as k) g),
kl as (select cand, k, sum(case when q > 0 then q * ln(q / (w * p + (1 - w) * q)) else 0 end) as kq,
  sum(case when p > 0 then p * ln(p / (w * p + (1 - w) * q)) else 0 end) as kp from x group by cand, k),
pts as (select cand, exp(-5.0 * kq) as x, exp(-5.0 * kp) as y from kl
  union all select cand, 0.0, 1.0 from t union all select cand, 1.0, 0.0 from t),
o as (select cand, x, y, lead(x) over (partition by cand order by x, y desc) as x2, lead(y) over (partition by cand order by x, y desc) as y2 from pts)
select cand, round(sum(case when x2 is not null then (x2 - x) * (y2 + y) / 2 else 0 end), 6) as mauve from o group by cand"""


@query("e16_mauve", _MAUVE_SQL, views=["fx_vec_triplets"])
def e16_mauve(spark, sf):
    """MAUVE of candidate vs reference sides, clusters = the embeddings' label (the oracle-able form)."""
    v = view(spark, sf, "fx_vec_triplets").select("label")
    a = (
        v.select(F.lit("correct").alias("cand"), F.col("label").alias("cluster"), F.lit("p").alias("side"))
        .unionByName(v.select(F.lit("correct").alias("cand"), F.col("label").alias("cluster"), F.lit("q").alias("side")))
        .unionByName(v.select(F.lit("incorrect").alias("cand"), F.pmod(F.col("label") + 1, F.lit(10)).alias("cluster"), F.lit("p").alias("side")))
        .unionByName(v.select(F.lit("incorrect").alias("cand"), F.col("label").alias("cluster"), F.lit("q").alias("side")))
    )
    m = C.mauve_from_clusters(a, group_cols=["cand"])
    return m.select("cand", F.round("mauve", 6).alias("mauve"))


_MAUVE_K, _MAUVE_ROUNDS = 6, 5


def _quantised_mauve_sql() -> str:
    """k-means of both sides in unrolled rounds, then the frontier over its clusters."""
    order = hkey_sql("side", "row_id")
    d = "list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    ctes = ["""vpts as (select 'correct' as cand, 'p' as side, row_id, pos::double[] as v from fx_vec_triplets union all select 'correct', 'q', row_id, ref::double[] from fx_vec_triplets
  union all select 'incorrect', 'p', row_id, neg::double[] from fx_vec_triplets union all select 'incorrect', 'q', row_id, ref::double[] from fx_vec_triplets)""",
            f"c0 as (select cand, row_number() over (partition by cand order by {order}, side, row_id) - 1 as c, v from vpts qualify c < {_MAUVE_K})"]
    for i in range(_MAUVE_ROUNDS + 1):
        ctes.append(f"n{i} as (select p.cand, p.side, p.row_id, p.v, arg_min(c.c, [{d}, c.c]) as cluster from vpts p join c{i} c using (cand) group by all)")
        if i < _MAUVE_ROUNDS:
            ctes.append(f"""m{i} as (select cand, cluster as c, list(m order by j) as v from (
  select cand, cluster, j, avg(v[j]) as m from n{i}, (select unnest(range(1, 1 + (select max(len(v)) from vpts))) as j) group by all) group by all),
c{i + 1} as (select o.cand, o.c, coalesce(m{i}.v, o.v) as v from c{i} o left join m{i} using (cand, c))""")
    frontier = _MAUVE_SQL[_MAUVE_SQL.index("h as ("):]
    return "with " + ",\n".join(ctes) + f",\na as (select cand, cluster, side from n{_MAUVE_ROUNDS}),\n" + frontier


@query("e16q_mauve_of_vectors", _quantised_mauve_sql(), views=["fx_vec_triplets"])
def e16q_mauve_of_vectors(spark, sf):
    """MAUVE from vectors: candidates and references quantised together by k-means, then the divergence frontier."""
    v = view(spark, sf, "fx_vec_triplets")
    part = lambda cand, side, c: v.select(F.lit(cand).alias("cand"), F.lit(side).alias("side"), "row_id", F.col(c).cast("array<double>").alias("vec"))
    points = part("correct", "p", "pos").unionByName(part("correct", "q", "ref")).unionByName(part("incorrect", "p", "neg")).unionByName(part("incorrect", "q", "ref"))
    return _round(mauve(points, _MAUVE_K, _MAUVE_ROUNDS, group="cand", order=("side", "row_id")), "mauve")

"""Registered queries for streaming (W1-W3), training traces (R1-R3) and attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripletframe.functions.keys import hkey, hkey_sql
from tripletframe.functions.vectors import cosine, cosine_sql_duck
from tripletframe.operators import attribution as I
from tripletframe.operators import scoring as S
from tripletframe.operators import training as R
from tripletframe.operators import triplets as T
from tripletframe.plans.registry import query
from tripletframe.plans.sqlgen import negatives_ctes, with_ctes
from tripletframe.plans.triplet_queries import RESERVOIR_K, _neg_query
from tripletframe.session import cut_lineage
from tripletframe.sources import io
from tripletframe.sources.fixtures import hashed_vectors, table, text_tokens, view
from tripletframe.streaming import streams as W

R6 = 6
EVAL_EVERY = 100
STEPS_PER_EPOCH = 500
FIT_STEPS = 10
LENGTH = 512
W2_DELIVERIES, W2_FILE_BYTES = 4, 16 << 20
W3_FILE_ROWS = 1 << 20


# ---------------------------------------------------------------- W1-W3

ARRIVALS = 4


def _arrivals_sql() -> str:
    ctes, rel = negatives_ctes("arrived", "correct_answer", "row_id", "incorrect_answer", T.DEFAULT_BATCH, group=("batch_id",))
    arrived = f"arrived as (select row_id, premise, correct_answer, cast({hkey_sql("'arrive'", 'row_id')} % {ARRIVALS} as integer) as batch_id from fx_pairs)"
    return with_ctes([arrived, *ctes], f"select row_id, premise, correct_answer, incorrect_answer, batch_id from {rel}")


@query("w1_stream_triplets", _arrivals_sql(), views=["fx_pairs"])
def w1_stream_triplets(spark, sf):
    """Pairs arrive in four deliveries; the stream is resumed after each and draws negatives inside the delivery."""
    pairs = view(spark, sf, "fx_pairs").drop("raw_score")
    x = cut_lineage(pairs.withColumn("_d", F.pmod(hkey(F.lit("arrive"), "row_id"), F.lit(ARRIVALS))))
    src, out, ck = (io.scratch_path(spark, n) for n in ("w1src", "w1out", "w1ck"))
    for k in range(ARRIVALS):
        x.where(F.col("_d") == k).drop("_d").write.mode("append").parquet(src)
        W.stream_triplets(spark, src, out, ck, pairs.schema, max_files=None)
    return spark.read.parquet(out).select("row_id", "premise", "correct_answer", "incorrect_answer", F.col("batch_id").cast("int").alias("batch_id"))


@query("w2_stream_sample_k", f"""select row_id, pos, token from fx_tokens
order by {hkey_sql("'res'", "row_id * 100000 + pos")}, row_id * 100000 + pos limit {RESERVOIR_K}""", views=["fx_tokens"])
def w2_stream_sample_k(spark, sf):
    """Streaming bottom-k over token files in four deliveries; after the drain it equals the batch reservoir.

    A file holds the tokens of about W2_FILE_BYTES of text, so a delivery of any size is read by as many tasks as it has files.
    """
    t = view(spark, sf, "fx_tokens").withColumn("tok_id", F.col("row_id") * 100000 + F.col("pos"))
    src, state, ck = (io.scratch_path(spark, n) for n in ("w2src", "w2state", "w2ck"))
    size = table(spark, sf, "documents").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = -(-size // (W2_DELIVERIES * W2_FILE_BYTES)) or 1  # of a delivery
    t.repartition(W2_DELIVERIES * files, "row_id", "pos").write.parquet(src)
    W.stream_sample_k(spark, src, state, ck, t.schema, RESERVOIR_K, "tok_id", max_files=files)
    return W.latest_state(spark, state).select("row_id", "pos", "token")


@query("w3_stream_eval_monitor", """select run, time_bucket(interval '1 day', ts) as window_start, count(*) as n,
  round(avg(pos_sim), 6) as avg_pos_sim, round(avg(neg_sim), 6) as avg_neg_sim from fx_trace group by run, time_bucket(interval '1 day', ts)""",
       views=["fx_trace"])
def w3_stream_eval_monitor(spark, sf):
    """Trace files arrive week by week (in event-time order); daily windows with an 8-day watermark, update mode.

    A week is one micro-batch of files of about W3_FILE_ROWS rows, so the number of batches (each runs a
    task for every state partition) is that of the weeks, whatever the number of rows.
    """
    tr = view(spark, sf, "fx_trace").select("run", "ts", "pos_sim", "neg_sim")
    lo = tr.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("lo")).first()["lo"]
    week = 7 * 24 * 3600 * 1_000_000
    tr = tr.withColumn("_chunk", F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(lo)) / F.lit(week)))
    tr = _persisted(tr)  # every weekly chunk is cut from the same derived trace
    weeks = tr.groupBy("_chunk").agg(F.count(F.lit(1)).alias("c")).agg(F.max("_chunk").alias("m"), F.max("c").alias("c")).first()
    files = -(-weeks["c"] // W3_FILE_ROWS)  # of a week
    src, out, ck = (io.scratch_path(spark, n) for n in ("w3src", "w3out", "w3ck"))
    for k in range(int(weeks["m"] + 1)):  # written one after another: file times follow event time
        tr.where(F.col("_chunk") == k).drop("_chunk").repartition(files).write.mode("append").parquet(src)
    schema = tr.drop("_chunk").schema
    W.stream_eval_monitor(spark, src, out, ck, schema, max_files=files)
    f = W.final_windows(spark, out)
    return f.select("run", "window_start", "n", F.round("avg_pos_sim", R6).alias("avg_pos_sim"), F.round("avg_neg_sim", R6).alias("avg_neg_sim"))


# ---------------------------------------------------------------- R1-R3

@query("r1_eval_trace", f"""select run, cast(ceil(step / {EVAL_EVERY}) as bigint) as interval, count(*) as n_steps,
  round(avg(pos_sim), 6) as pos_sim, round(avg(neg_sim), 6) as neg_sim, round(avg(pos_sim - neg_sim), 6) as diff, max(step) as last_step
from fx_trace group by run, cast(ceil(step / {EVAL_EVERY}) as bigint)""", views=["fx_trace"])
def r1_eval_trace(spark, sf):
    x = R.eval_trace(view(spark, sf, "fx_trace"), EVAL_EVERY)
    return x.select("run", "interval", "n_steps", *[F.round(c, R6).alias(c) for c in ("pos_sim", "neg_sim", "diff")], "last_step")


@query("r1e_eval_points", f"""with t as (select run, step, pos_sim, neg_sim, cast((step - 1) // {STEPS_PER_EPOCH} as bigint) as epoch,
  cast((step - 1) % {STEPS_PER_EPOCH} + 1 as bigint) as step_in_epoch from fx_trace),
r as (select *, sum(cast(round(pos_sim * 1000000) as bigint)) over w as sp, sum(cast(round(neg_sim * 1000000) as bigint)) over w as sn,
  count(*) over w as k from t
  window w as (partition by run, epoch order by step rows between unbounded preceding and current row))
select run, step, epoch, case when step_in_epoch = {STEPS_PER_EPOCH} then 'epoch_end' when step_in_epoch = {STEPS_PER_EPOCH // 2}
  then 'mid_epoch' else 'interval' end as kind, k as steps_seen, floor((2 * sp + k) / (2 * k)) / 1000000 as train_pos_sim,
  floor((2 * sn + k) / (2 * k)) / 1000000 as train_neg_sim
from r where step % {EVAL_EVERY} = 0 or step_in_epoch = {STEPS_PER_EPOCH // 2} or step_in_epoch = {STEPS_PER_EPOCH}
union all select distinct user_id % 4, 0, 0, 'initial', 0, cast(null as double), cast(null as double) from events""",
       views=["fx_trace"])
def r1e_eval_points(spark, sf):
    """Evaluation points of every run, from the one before its first step on."""
    runs = table(spark, sf, "events").select(F.pmod("user_id", F.lit(4)).alias("run"))
    x = R.eval_points(view(spark, sf, "fx_trace"), EVAL_EVERY, STEPS_PER_EPOCH, runs=runs)
    return x.select("run", F.col("step").cast("int").alias("step"), "epoch", "kind", "steps_seen", "train_pos_sim", "train_neg_sim")


@query("r2_best_checkpoint", f"""with d as (select run, step, pos_sim - neg_sim as diff from fx_trace),
b as (select *, max(diff) over (partition by run order by step rows between unbounded preceding and 1 preceding) as prev_best,
  max(step) over (partition by run) as last from d)
select run, step, round(diff, 6) as diff, round(prev_best, 6) as prev_best, diff > greatest(coalesce(prev_best, 0.0), 0.0) as is_best,
  step = last as is_last, (step - 1) % {STEPS_PER_EPOCH} + 1 = {STEPS_PER_EPOCH // 2} as is_half_epoch,
  (step - 1) % {STEPS_PER_EPOCH} + 1 = {STEPS_PER_EPOCH} as is_epoch_end from b""", views=["fx_trace"])
def r2_best_checkpoint(spark, sf):
    x = R.best_checkpoint(view(spark, sf, "fx_trace"), steps_per_epoch=STEPS_PER_EPOCH)
    return x.select("run", "step", F.round("diff", R6).alias("diff"), F.round("prev_best", R6).alias("prev_best"),
                    "is_best", "is_last", "is_half_epoch", "is_epoch_end")


@query("r3_fit_projection")
def r3_fit_projection(spark, sf):
    """Fit the projection on the embedded triplets; the returned trace shows the loss per step."""
    trip = view(spark, sf, "fx_vec_triplets").select(
        *[F.transform(c, lambda x: x.cast("double")).alias(c) for c in ("ref", "pos", "neg")])
    dim = len(trip.select("ref").first()["ref"])
    _, trace = R.fit_projection(trip, dim, steps=FIT_STEPS)
    return spark.createDataFrame(trace, "step int, epoch int, loss double, lr double")


TRAIN_BATCH, TRAIN_EPOCHS, TRAIN_EVAL = 100, 2, 3
_HELD_OUT = ("'held'", "row_id")  # one embedded triplet in five, by hash key


def _training_run(spark, sf, epochs):
    x = view(spark, sf, "fx_vec_triplets").select("row_id", *[F.transform(c, lambda v: v.cast("double")).alias(c) for c in ("ref", "pos", "neg")])
    x = cut_lineage(x)  # split twice, batched every epoch
    held = F.pmod(hkey(F.lit("held"), "row_id"), F.lit(5)) == 0
    dim = len(x.select("ref").first()["ref"])
    return R.train_projection(x.where(~held), x.where(held), dim, TRAIN_BATCH, epochs, TRAIN_EVAL)


def _hinge_sql(rel: str) -> str:
    pos, neg = (cosine_sql_duck("ref", c) for c in ("pos", "neg"))
    return f"round(avg(greatest(0.0, 1.0 + n - p)), {R6}) as loss, round(avg(p), {R6}) as pos_sim, round(avg(n), {R6}) as neg_sim from (select {pos} as p, {neg} as n from {rel})"


@query("r3t_training_start", f"""with held as (select * from fx_vec_triplets where {hkey_sql(*_HELD_OUT)} % 5 = 0),
drawn as (select *, row_number() over (order by {hkey_sql("'seq'", "0", 'row_id')}, row_id) - 1 as seq from fx_vec_triplets where {hkey_sql(*_HELD_OUT)} % 5 <> 0),
first as (select * from drawn where seq < {TRAIN_BATCH})
select 'initial' as kind, 0 as step, {_hinge_sql('held')} union all select 'first_step', 1, {_hinge_sql('first')}""", views=["fx_vec_triplets"])
def r3t_training_start(spark, sf):
    """Evaluation before the first step and the loss of the first batch of a training run (the start matrix is the identity)."""
    _, steps, points = _training_run(spark, sf, 1)
    rows = [{"kind": "initial", **points[0]}, {"kind": "first_step", **steps[0]}]
    out = spark.createDataFrame([(r["kind"], r["step"], r["loss"], r["pos_sim"], r["neg_sim"]) for r in rows], "kind string, step int, loss double, pos_sim double, neg_sim double")
    return out.withColumns({c: F.round(c, R6) for c in ("loss", "pos_sim", "neg_sim")})


@query("r3b_best_of_training")
def r3b_best_of_training(spark, sf):
    """Evaluation points of a training run with the best ones marked (R2)."""
    _, _, points = _training_run(spark, sf, TRAIN_EPOCHS)
    trace = spark.createDataFrame([(0, p["step"], p["epoch"], p["kind"], p["loss"], p["pos_sim"], p["neg_sim"]) for p in points],
                                  "run int, step int, epoch int, kind string, loss double, pos_sim double, neg_sim double")
    return R.best_checkpoint(trace).select("run", "step", "epoch", "kind", "loss", "pos_sim", "neg_sim", "diff", "is_best", "is_last")


# ---------------------------------------------------------------- I1-I5

_DIR_SQL = ", ".join(
    f"{{'direction': '{d}', 'input_text': {i}, 'target_text': {t}, 'expected': {lab}}}" for d, i, t, lab in I.DIRECTIONS)


@query("i4_four_directions", f"""with tr as ({_neg_query()}),
u as (select row_id, unnest([{_DIR_SQL}]) as d from tr)
select row_id, d.direction as direction, d.input_text as input_text, d.target_text as target_text, d.expected as expected from u""",
       views=["fx_pairs"])
def i4_four_directions(spark, sf):
    trip = T.sample_negatives(view(spark, sf, "fx_pairs").drop("raw_score"))
    return I.four_directions(trip)


def _text_embeddings(spark, texts):
    """E2 over distinct texts keyed by text hash -> (text_id, emb array)."""
    t = cut_lineage(texts.select("text").distinct().withColumn("text_id", F.md5("text")))  # tokens, vectors and counts are made from it
    tok = text_tokens(t, "text_id", "text")
    vec = hashed_vectors(tok, extra_tokens=("<pad>", I.BASELINE_TOKEN))
    pad = vec.where(F.col("token") == "<pad>").select("j", "v")
    e = S.embeddings_as_arrays(S.embed_texts(tok.withColumnRenamed("text_id", "row_id"), vec, length=LENGTH, pad_vector=pad,
                                            texts=t.select(F.col("text_id").alias("row_id"))))
    return t, tok, vec, e.withColumnRenamed("row_id", "text_id")


def _directions_with_sim(spark, sf):
    trip = cut_lineage(T.sample_negatives(view(spark, sf, "fx_pairs").drop("raw_score")))  # a row's three texts once, not in each direction
    d = I.four_directions(trip)
    texts = trip.select(F.explode(F.array("premise", "correct_answer", "incorrect_answer")).alias("text"))
    t, tok, vec, emb = _text_embeddings(spark, texts)
    x = d.select("row_id", "direction", "expected", F.md5("input_text").alias("in_id"), F.md5("target_text").alias("tgt_id"))
    x = x.join(emb.select(F.col("text_id").alias("in_id"), F.col("emb").alias("e_in")), "in_id")
    x = x.join(emb.select(F.col("text_id").alias("tgt_id"), F.col("emb").alias("e_tgt")), "tgt_id")
    x = x.withColumn("sim", cosine("e_in", "e_tgt")).withColumn("baseline", I.choose_baseline(F.col("sim")))
    return x, tok, vec


def _persisted(df):
    from pyspark import StorageLevel

    return df.persist(StorageLevel.MEMORY_AND_DISK)


def _i2_sql():
    from tripletframe.plans.scoring_queries import _PAD_SQL
    from tripletframe.sources.fixtures import hashed_vectors_sql, text_tokens_sql

    return f"""with tr as ({_neg_query()}),
u as (select row_id, unnest([{_DIR_SQL}]) as d from tr),
dd as (select row_id, d.direction as direction, d.input_text as input_text, d.target_text as target_text from u),
txt as (select distinct text, {hkey_sql('text')} as text_id from (select input_text as text from dd union select target_text from dd)),
tok as ({text_tokens_sql('txt', 'text_id', 'text')}),
vec as ({hashed_vectors_sql('tok')}),
cnt as (select text_id, token, count(*) as k from tok group by text_id, token),
nn as (select text_id, sum(k) as n from cnt group by text_id),
s as (select c.text_id, v.j, sum(c.k * v.v) as s from cnt c join vec v using (token) group by c.text_id, v.j),
pad as ({_PAD_SQL}),
emb as (select s.text_id, s.j, (s.s + greatest({LENGTH} - nn.n, 0) * pad.pv) / greatest(nn.n, {LENGTH}) as e
  from s join nn using (text_id) join pad using (j)),
pr as (select dd.row_id, dd.direction, {hkey_sql('dd.input_text')} as in_id, {hkey_sql('dd.target_text')} as tgt_id from dd),
c as (select pr.row_id, pr.direction, sum(a.e * b.e) as d, sum(a.e * a.e) as na, sum(b.e * b.e) as nb
  from pr join emb a on a.text_id = pr.in_id join emb b on b.text_id = pr.tgt_id and b.j = a.j group by pr.row_id, pr.direction),
f as (select row_id, direction, case when na * nb > 0 then d / sqrt(na * nb) else 0 end as sim from c)
select row_id, direction, round(sim, 6) as sim, case when sim > 0 then 'zero' else 'reference' end as baseline from f"""


@query("i2_choose_baseline", _i2_sql(), views=["fx_pairs"])
def i2_choose_baseline(spark, sf):
    x, _, _ = _directions_with_sim(spark, sf)
    return x.select("row_id", "direction", F.round("sim", R6).alias("sim"), "baseline")


def _attributions(spark, sf):
    x, tok, vec = _directions_with_sim(spark, sf)
    # pairs and vectors each feed several branches of the attribution plan: write them once
    x = cut_lineage(x.drop("e_in", "e_tgt"))
    vec = cut_lineage(S.vectors_to_arrays(vec))
    dirs = {d: i for i, (d, *_) in enumerate(I.DIRECTIONS)}
    idx = F.create_map(*[a for d, i in dirs.items() for a in (F.lit(d), F.lit(i))])
    pairs = x.select((F.col("row_id") * 4 + idx[F.col("direction")]).alias("pair_id"), "row_id", "direction", "in_id", "tgt_id", "baseline", "sim")
    att, totals = I.token_attribution(pairs.select("pair_id", "row_id", "in_id", "tgt_id", "baseline"), tok, vec, length=LENGTH, near="row_id")
    return pairs, att, totals


@query("i1_token_attribution")
def i1_token_attribution(spark, sf):
    """Per-pair totals of the integrated-gradients attribution (delta = completeness error)."""
    pairs, _, totals = _attributions(spark, sf)
    return totals.join(pairs.select("pair_id", "row_id", "direction", "baseline"), "pair_id")


def _i1_sql() -> str:
    head, _ = _i2_sql().rsplit("select row_id, direction, round(sim, 6) as sim", 1)
    return head + f"select row_id, direction, case when sim > 0 then 'zero' else 'reference' end as baseline, round(sim, {R6}) as cos_x, true as complete from f"


@query("i1c_attribution_completeness", _i1_sql(), views=["fx_pairs"])
def i1c_attribution_completeness(spark, sf):
    """Attributions of every pair add up to the similarity gained over the baseline (to 0.001)."""
    pairs, _, totals = _attributions(spark, sf)
    x = totals.join(pairs.select("pair_id", "row_id", "direction", "baseline"), "pair_id")
    return x.select("row_id", "direction", "baseline", F.round("cos_x", R6).alias("cos_x"), (F.abs("delta") < 1e-3).alias("complete"))


@query("i3_normalise_importance", f"""with w as (select row_id, pos, token,
  cast({hkey_sql('token', '0')} % 2001 - 1000 as double) / 1000 as attr from fx_tokens)
select row_id, pos, round(case when sqrt(sum(attr * attr) over (partition by row_id)) > 0
  then attr / sqrt(sum(attr * attr) over (partition by row_id)) else attr end, 6) as weight from w""", views=["fx_tokens"])
def i3_normalise_importance(spark, sf):
    """Token weights (here the first vector component of each token) normalised per text."""
    t = view(spark, sf, "fx_tokens").withColumn("attr", (F.pmod(hkey("token", F.lit(0)), F.lit(2001)) - 1000).cast("double") / 1000)
    x = I.normalise_importance(t, ["row_id"])
    return x.select("row_id", "pos", F.round("weight", R6).alias("weight"))


@query("i5_attribution_summary")
def i5_attribution_summary(spark, sf):
    """One record per metric: mean similarity and total attribution of each direction (x100, 2 dp)."""
    pairs, _, totals = _attributions(spark, sf)
    per = totals.join(pairs.select("pair_id", "direction"), "pair_id").select(
        F.lit("embsim").alias("metric"), "direction", F.col("cos_x").alias("sim"), F.col("total").alias("attr"))
    return I.attribution_summary(per)


def _i5s_sql():
    body = _i2_sql()
    head, tail = body.rsplit("select row_id, direction, round(sim, 6) as sim", 1)
    dirs = [d for d, *_ in I.DIRECTIONS]
    cols = ", ".join(f"round(avg(sim) filter (where direction = '{d}') * 100, 2) as {d}_sim" for d in dirs)
    return head + f"select 'embsim' as metric, {cols} from f"


@query("i5s_similarity_summary", _i5s_sql(), views=["fx_pairs"])
def i5s_similarity_summary(spark, sf):
    """The similarity half of I5: one record per metric, mean similarity x100 (2 dp) per direction."""
    x, _, _ = _directions_with_sim(spark, sf)
    dirs = [d for d, *_ in I.DIRECTIONS]
    per = x.select(F.lit("embsim").alias("metric"), "direction", "sim")
    p = per.groupBy("metric").pivot("direction", dirs).agg(F.round(F.avg("sim") * 100, 2))
    return p.select("metric", *[F.col(d).alias(f"{d}_sim") for d in dirs])

"""Registered queries for mixing, ordering and curriculum."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tripletframe.functions.keys import hkey_sql
from tripletframe.operators import mixing as M
from tripletframe.operators import triplets as T
from tripletframe.plans.registry import query
from tripletframe.plans.triplet_queries import _NLI_PIVOT_SQL, _neg_query
from tripletframe.sources.fixtures import view

CAP = 25                  # rows per source kept by the sampler query
LOADER_BATCH = 16         # interleaved loader batch in the queries (sources hold ~50 rows at sf0.01)
EPOCH_BATCH = 64          # training batch of the reference config
MAX_SAMPLES = 1_000_000   # rows seen per epoch in the reference config
STEPS_PER_EPOCH = 500
N_EPOCHS = 15             # reference config
DRAW_LEVEL = 1
RESUME_AT = (0, 3)


def _registry(spark, sf):
    return view(spark, sf, "fx_sources").select("source", "difficulty").distinct()


@query("m1_sample_per_source", f"""select row_id, source from (select row_id, source, row_number() over (partition by source
  order by {hkey_sql("'cap'", 'row_id')}, row_id) as rk from fx_sources) where rk <= {CAP}""", views=["fx_sources"])
def m1_sample_per_source(spark, sf):
    return M.sample_per_source(view(spark, sf, "fx_sources"), cap=CAP).select("row_id", "source")


@query("m2_mix_sources", f"""select 'pairs' as source_dataset, premise, correct_answer, incorrect_answer, cast(null as double) as score
  from ({_neg_query()})
union all select 'answers', premise, correct_answer, incorrect_answer, null from (with c as (select q_id,
  list_filter(correct_answers, lambda x: x <> 'I have no comment' and length(x) > 2) as ca,
  list_filter(incorrect_answers, lambda x: x <> 'I have no comment' and length(x) > 2) as ia from fx_answers)
  select ca[-1] as premise, ca[1] as correct_answer, ia[1] as incorrect_answer from c where len(ca) > 1 and len(ia) > 1)
union all select 'nli', premise, correct_answer, incorrect_answer, null from ({_NLI_PIVOT_SQL.format(g='', src='fx_labeled')})""",
       views=["fx_pairs", "fx_answers", "fx_labeled"])
def m2_mix_sources(spark, sf):
    cols = ["premise", "correct_answer", "incorrect_answer"]
    pairs = T.sample_negatives(view(spark, sf, "fx_pairs").drop("raw_score")).select(*cols)
    answers = T.answer_list_triplets(view(spark, sf, "fx_answers")).select(*cols)
    nli = T.nli_pivot(view(spark, sf, "fx_labeled")).select(*cols)
    mixed = M.mix_sources({"pairs": pairs, "answers": answers, "nli": nli})
    return mixed.withColumn("score", F.lit(None).cast("double"))


@query("m3_source_index", """select source, row_id, row_number() over (partition by source order by row_id) - 1 as pos,
  count(*) over (partition by source) as n from fx_sources""", views=["fx_sources"])
def m3_source_index(spark, sf):
    return M.source_index(view(spark, sf, "fx_sources"))


def _interleave_sql(batch, strategy="round_robin", epoch=0):
    order = f"{hkey_sql(chr(39) + 'interleave' + chr(39), 'source')}, source" if strategy == "random" else "source"
    return f"""with so as (select source, row_number() over (order by {order}) - 1 as source_ord
  from (select distinct source from fx_sources)),
r as (select row_id, source, row_number() over (partition by source
  order by {hkey_sql("'epoch'", str(epoch), 'row_id')}, row_id) - 1 as r from fx_sources),
x as (select r.row_id, r.source, r.r // {batch} as b, r.r - (r.r // {batch}) * {batch} as pos_in_batch, so.source_ord
  from r join so using (source))
select row_id, source, b, source_ord, pos_in_batch, dense_rank() over (order by b, source_ord) - 1 as batch_seq from x"""


@query("m5_interleave_round_robin", _interleave_sql(LOADER_BATCH), views=["fx_sources"])
def m5_interleave_round_robin(spark, sf):
    return M.interleave(view(spark, sf, "fx_sources").select("row_id", "source"), LOADER_BATCH)


@query("m6_interleave_random", _interleave_sql(LOADER_BATCH, "random"), views=["fx_sources"])
def m6_interleave_random(spark, sf):
    return M.interleave(view(spark, sf, "fx_sources").select("row_id", "source"), LOADER_BATCH, strategy="random")


@query("m7_shuffle_within", _interleave_sql(LOADER_BATCH, epoch=1), views=["fx_sources"])
def m7_shuffle_within(spark, sf):
    return M.interleave(view(spark, sf, "fx_sources").select("row_id", "source"), LOADER_BATCH, epoch=1)


@query("m4_fetch_positions", "with il as (" + _interleave_sql(LOADER_BATCH) + """)
select il.batch_seq, il.pos_in_batch, il.row_id, f.text from il join fx_sources f using (row_id)""", views=["fx_sources"])
def m4_fetch_positions(spark, sf):
    il = M.interleave(view(spark, sf, "fx_sources").select("row_id", "source"), LOADER_BATCH)
    rows = view(spark, sf, "fx_sources").select("row_id", "text")
    return M.fetch_positions(il.select("batch_seq", "pos_in_batch", "row_id"), rows)


@query("m8_batch_count", f"""select cast(sum(ceil(n / {LOADER_BATCH}.0)) as bigint) as n_batches, count(*) as n_sources
from (select source, count(*) as n from fx_sources group by source)""", views=["fx_sources"])
def m8_batch_count(spark, sf):
    return M.batch_count(view(spark, sf, "fx_sources"), LOADER_BATCH)


def _epoch_sql(batch, epoch=0):
    return f"""with s as (select row_id, source, row_number() over (order by {hkey_sql("'seq'", str(epoch), 'row_id')}, row_id) - 1 as seq
  from fx_sources)
select row_id, source, seq, {epoch} as epoch, seq // {batch} as batch from s
where seq // {batch} < (select count(*) from fx_sources) // {batch}"""


@query("m9_epoch_batches", _epoch_sql(EPOCH_BATCH), views=["fx_sources"])
def m9_epoch_batches(spark, sf):
    return M.epoch_batches(view(spark, sf, "fx_sources").select("row_id", "source"), EPOCH_BATCH)


@query("m10_cap_samples", f"""select row_id, source from (select row_id, source, row_number() over (order by row_id) as rn
from fx_sources) where rn <= {MAX_SAMPLES}""", views=["fx_sources"])
def m10_cap_samples(spark, sf):
    return M.cap_samples(view(spark, sf, "fx_sources").select("row_id", "source"), MAX_SAMPLES)


_LEVELS_SQL = """select r.source, r.difficulty, l.level, n.n_rows from (select distinct source, difficulty from fx_sources) r
join (select difficulty, dense_rank() over (order by difficulty) as level from (select distinct difficulty from fx_sources)) l
using (difficulty) left join (select source, count(*) as n_rows from fx_sources group by source) n using (source)"""


@query("m11_curriculum_levels", f"select source, difficulty, cast(level as integer) as level, n_rows from ({_LEVELS_SQL})",
       views=["fx_sources"])
def m11_curriculum_levels(spark, sf):
    out = M.curriculum_levels(_registry(spark, sf), view(spark, sf, "fx_sources"))
    return out.select("source", "difficulty", F.col("level").cast("int").alias("level"), "n_rows")


def _n_levels(spark, sf):
    return _registry(spark, sf).select("difficulty").distinct().count()


@query("m12_assign_levels", f"""with t as (select run, step, cast((step - 1) // {STEPS_PER_EPOCH} as bigint) as epoch from fx_trace),
nl as (select count(distinct difficulty) as l from fx_sources)
select run, step, epoch, cast(max(least(cast(floor(epoch / {N_EPOCHS}.0 * nl.l) as integer) + 1, nl.l)) over
  (partition by run order by step rows between unbounded preceding and current row) as integer) as level from t, nl""",
       views=["fx_trace", "fx_sources"])
def m12_assign_levels(spark, sf):
    tr = view(spark, sf, "fx_trace").select("run", "step", F.floor((F.col("step") - 1) / STEPS_PER_EPOCH).cast("long").alias("epoch"))
    out = M.assign_levels(tr, N_EPOCHS, _n_levels(spark, sf))
    return out.select("run", "step", "epoch", F.col("level").cast("int").alias("level"))


@query("m12o_open_sources", f"""with t as (select run, step, cast((step - 1) // {STEPS_PER_EPOCH} as bigint) as epoch from fx_trace),
nl as (select count(distinct difficulty) as l from fx_sources),
a as (select run, epoch, step, cast(max(least(cast(floor(epoch / {N_EPOCHS}.0 * nl.l) as integer) + 1, nl.l)) over
  (partition by run order by step rows between unbounded preceding and current row) as integer) as level from t, nl)
select a.run, a.epoch, a.step, a.level, l.source, cast(l.level as integer) as source_level from a join ({_LEVELS_SQL}) l on l.level <= a.level""",
       views=["fx_trace", "fx_sources"])
def m12o_open_sources(spark, sf):
    """The sources open at every step of the curriculum."""
    tr = view(spark, sf, "fx_trace").select("run", "step", F.floor((F.col("step") - 1) / STEPS_PER_EPOCH).cast("long").alias("epoch"))
    out = M.open_sources(M.assign_levels(tr, N_EPOCHS, _n_levels(spark, sf)), M.curriculum_levels(_registry(spark, sf)))
    return out.select("run", "epoch", "step", F.col("level").cast("int").alias("level"), "source", "source_level")


@query("m13_advance_on_score", """with nl as (select count(distinct difficulty) as l from fx_sources)
select run, step, cast(least(1 + sum(case when pos_sim > 0.8 then 1 else 0 end) over (partition by run order by step
  rows between unbounded preceding and current row), nl.l) as integer) as level from fx_trace, nl""",
       views=["fx_trace", "fx_sources"])
def m13_advance_on_score(spark, sf):
    tr = view(spark, sf, "fx_trace").select("run", "step", "pos_sim")
    return M.advance_on_score(tr, "pos_sim", _n_levels(spark, sf)).select("run", "step", "level")


def _draw_sql():
    return f"""with lv as (select source from ({_LEVELS_SQL}) where level = {DRAW_LEVEL}),
idx as (select source, row_id, row_number() over (partition by source order by row_id) - 1 as pos,
  count(*) over (partition by source) as n from fx_sources where source in (select source from lv)),
per as (select source, n, row_number() over (order by source) as cw from (select distinct source, n from idx)),
d as (select range as draw_id from range((select count(*) from idx))),
pick as (select d.draw_id, p.source, p.n from d join per p
  on p.cw = {hkey_sql("'draw'", str(DRAW_LEVEL), 'd.draw_id')} % (select count(*) from per) + 1)
select pick.draw_id, pick.source, idx.row_id, {DRAW_LEVEL} as level from pick join idx
  on idx.source = pick.source and idx.pos = {hkey_sql("'draw|row'", str(DRAW_LEVEL), 'pick.draw_id')} % pick.n"""


def _draws(spark, sf):
    levels = M.curriculum_levels(_registry(spark, sf))
    return M.curriculum_draw(view(spark, sf, "fx_sources").select("row_id", "source"), levels, DRAW_LEVEL)


@query("m14_curriculum_draw", _draw_sql(), views=["fx_sources"])
def m14_curriculum_draw(spark, sf):
    return _draws(spark, sf)


@query("m15_sampling_stats", "with dr as (" + _draw_sql() + """)
select source, level, count(*) as n_draws, round(count(*) * 100.0 / sum(count(*)) over (), 6) as pct from dr group by source, level""",
       views=["fx_sources"])
def m15_sampling_stats(spark, sf):
    return M.sampling_stats(_draws(spark, sf))


@query("m16_curriculum_state", "with dr as (" + _draw_sql() + f""")
select {DRAW_LEVEL} as current_level, cast(0.0 as double) as level_progress, count(*) as total_samples, cast(count(distinct source) as integer) as n_sources from dr""", views=["fx_sources"])
def m16_curriculum_state(spark, sf):
    """Save the state derived from the draws, read it back with defaults."""
    from tripletframe.session import checkpoint_dir

    path = f"{checkpoint_dir(spark)}/curriculum_state_{uuid.uuid4().hex}"
    state = M.curriculum_state(_draws(spark, sf), DRAW_LEVEL, 0.0)
    M.save_state(state, path)
    return M.load_state(spark, path).select("current_level", "level_progress", "total_samples",
                                            F.size("sample_counts").alias("n_sources"))


@query("m17_resume_after", "with eb as (" + _epoch_sql(EPOCH_BATCH) + f""")
select row_id, source, seq, epoch, batch from eb where epoch > {RESUME_AT[0]} or (epoch = {RESUME_AT[0]} and batch > {RESUME_AT[1]})""",
       views=["fx_sources"])
def m17_resume_after(spark, sf):
    eb = M.epoch_batches(view(spark, sf, "fx_sources").select("row_id", "source"), EPOCH_BATCH)
    return M.resume_after(eb, *RESUME_AT)


@query("m18_collate", "with il as (" + _interleave_sql(LOADER_BATCH) + """)
select batch_seq, count(*) as size, string_agg(cast(row_id as varchar), ',' order by pos_in_batch) as row_ids
from il group by batch_seq""", views=["fx_sources"])
def m18_collate(spark, sf):
    il = M.interleave(view(spark, sf, "fx_sources").select("row_id", "source"), LOADER_BATCH)
    c = M.collate(il)
    return c.select("batch_seq", "size", F.array_join(F.transform("rows", lambda r: r["row_id"].cast("string")), ",").alias("row_ids"))

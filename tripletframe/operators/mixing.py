"""Mixing, ordering and curriculum (M1-M18) as DataFrame operators.

The reference keeps a per-source list of row positions and walks it with
Python cursors, reading one row group per row. Here the order of a training
epoch is *data*: every row gets (source, position, batch, sequence number)
from hash keys and closed-form arithmetic, and batches are fetched with joins.
Per-source tables (counts, weights, levels) hold one row per source and are
the only things collected to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripletframe.functions.keys import HASH_BITS, hkey
from tripletframe.operators.indexing import (
    bucketed_running,
    buckets_for,
    dense_index,
    exact_cap,
    hash_range_bucket,
    value_range_bucket,
)

DEFAULT_CAP = 100_000
PERFORMANCE_STEP = 0.8


# ------------------------------------------------------------------ M1-M4

def sample_per_source(df: DataFrame, cap: int = DEFAULT_CAP, source_col: str = "source", key_col: str = "row_id",
                      salt: str = "cap") -> DataFrame:
    """M1: exactly min(cap, n_source) hash-random rows per source (see :func:`exact_cap`)."""
    x = df.withColumn("_hcap", hkey(F.lit(salt), key_col))
    return exact_cap(x, [source_col], "_hcap", cap, key_col).drop("_hcap")


def mix_sources(sources: Mapping[str, DataFrame], source_col: str = "source_dataset") -> DataFrame:
    """M2: tag every table with its source name and union them (missing columns -> null)."""
    out = None
    for name, df in sources.items():
        t = df.withColumn(source_col, F.lit(name))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def source_index(df: DataFrame, source_col: str = "source", key_col: str = "row_id") -> DataFrame:
    """M3: long index (source, row_id, pos, n) with pos = rank of row_id inside the source."""
    st = df.agg(F.count(F.lit(1)).alias("c"), F.min(key_col).alias("lo"), F.max(key_col).alias("hi")).first()
    nb = buckets_for(int(st["c"] or 0))
    bkt = value_range_bucket(key_col, float(st["lo"] or 0), float(st["hi"] or 0), nb)
    return dense_index(df.select(source_col, key_col), [source_col], [key_col], bkt, "pos", "n")


def fetch_positions(index_slice: DataFrame, rows: DataFrame, key_col: str = "row_id") -> DataFrame:
    """M4: rows for a set of stored positions: one equi-join on the row key (batch look-up)."""
    return index_slice.join(rows, key_col)


# ------------------------------------------------------------------ M5-M9

def _source_table(df: DataFrame, source_col: str, batch_size: int, strategy: str, seed_salt: str):
    """One row per source: order and batch count (collected: bounded by the number of sources)."""
    counts = df.groupBy(source_col).agg(F.count(F.lit(1)).alias("n"))
    if strategy == "random":
        counts = counts.withColumn("_o", hkey(F.lit(seed_salt), source_col))
    else:
        counts = counts.withColumn("_o", F.lit(0))
    rows = counts.orderBy("_o", source_col).collect()
    return [(r[source_col], i, int(math.ceil(r["n"] / batch_size))) for i, r in enumerate(rows)]


def interleave(
    df: DataFrame,
    batch_size: int,
    strategy: str = "round_robin",
    epoch: int = 0,
    shuffle_within: bool = True,
    source_col: str = "source",
    key_col: str = "row_id",
) -> DataFrame:
    """M5/M6/M7: round-robin (or hash-permuted) batches of ``batch_size`` from one source at a time.

    Rows are ranked inside their source (hash order of (epoch, row) when
    ``shuffle_within``, else by key) and cut into batches ``b = rank div B``.
    The loader visits sources in order and emits batch ``b`` of every
    non-exhausted source in cycle ``b``, so the global sequence number is
    ``sum_s' min(nb_s', b) + #{s' before s with nb_s' > b}``: a closed form over
    the per-source table, evaluated per row without any global window.
    """
    src = _source_table(df, source_col, batch_size, strategy, "interleave")
    order_map = F.create_map(*[x for s, o, _ in src for x in (F.lit(s), F.lit(o))])
    table = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(nb).alias("nb")) for _, o, nb in src])
    x = df.withColumn("_h", hkey(F.lit("epoch"), F.lit(epoch), key_col) if shuffle_within else F.col(key_col).cast("long"))
    n = sum(nb for _, _, nb in src) * batch_size
    if shuffle_within:
        bkt = hash_range_bucket("_h", buckets_for(n))
    else:
        st = df.agg(F.min(key_col).alias("lo"), F.max(key_col).alias("hi")).first()
        bkt = value_range_bucket("_h", float(st["lo"] or 0), float(st["hi"] or 0), buckets_for(n))
    x = dense_index(x, [source_col], ["_h", key_col], bkt, "_r", None)
    x = x.withColumn("b", F.floor(F.col("_r") / batch_size).cast("long")).withColumn("source_ord", order_map[F.col(source_col)].cast("long"))
    seq = F.aggregate(
        table,
        F.lit(0).cast("long"),
        lambda acc, s: acc
        + F.least(s["nb"].cast("long"), F.col("b"))
        + F.when((s["o"] < F.col("source_ord")) & (s["nb"] > F.col("b")), 1).otherwise(0),
    )
    return x.withColumn("batch_seq", seq).withColumn("pos_in_batch", (F.col("_r") - F.col("b") * batch_size).cast("long")).drop("_h", "_r")


def batch_count(df: DataFrame, batch_size: int, source_col: str = "source") -> DataFrame:
    """M8: number of loader batches = sum over sources of ceil(n / B)."""
    c = df.groupBy(source_col).agg(F.count(F.lit(1)).alias("n"))
    return c.agg(F.sum(F.ceil(F.col("n") / batch_size)).cast("long").alias("n_batches"), F.count(F.lit(1)).alias("n_sources"))


def epoch_batches(df: DataFrame, batch_size: int, epoch: int = 0, drop_last: bool = True, key_col: str = "row_id",
                  salt: str = "seq") -> DataFrame:
    """M9: global hash shuffle per epoch, fixed batches, short tail dropped.

    The dense global position comes from hash-range buckets + prefix offsets.
    """
    n = df.count()
    x = df.withColumn("_h", hkey(F.lit(salt), F.lit(epoch), key_col))
    x = dense_index(x, [], ["_h", key_col], hash_range_bucket("_h", buckets_for(n)), "seq", None).drop("_h")
    x = x.withColumn("epoch", F.lit(epoch)).withColumn("batch", F.floor(F.col("seq") / batch_size).cast("long"))
    if drop_last:
        x = x.where(F.col("batch") < n // batch_size)
    return x


def cap_samples(df: DataFrame, n: int, key_col: str = "row_id") -> DataFrame:
    """Only the first ``n`` rows in key order (position from :func:`dense_index`)."""
    st = df.agg(F.count(F.lit(1)).alias("c"), F.min(key_col).alias("lo"), F.max(key_col).alias("hi")).first()
    bkt = value_range_bucket(key_col, float(st["lo"] or 0), float(st["hi"] or 0), buckets_for(int(st["c"] or 0)))
    x = dense_index(df, [], [key_col], bkt, "_pos", None)
    return x.where(F.col("_pos") < n).drop("_pos")


# ------------------------------------------------------------------ M11-M16

def curriculum_levels(registry: DataFrame, rows: DataFrame | None = None, source_col: str = "source") -> DataFrame:
    """Sources grouped by integer difficulty ascending; level = dense rank of the difficulty.

    ``registry``: (source, difficulty). Dense ranking fixes gaps in the
    difficulty values (the reference would skip a level). Rows per level when
    ``rows`` (source, ...) is given.
    """
    reg = registry.select(source_col, F.col("difficulty").cast("int").alias("difficulty")).distinct()
    diffs = reg.select("difficulty").distinct()  # a handful of values
    lv = diffs.withColumn("level", F.dense_rank().over(Window.orderBy("difficulty")))
    out = reg.join(F.broadcast(lv), "difficulty")
    if rows is not None:
        n = rows.groupBy(source_col).agg(F.count(F.lit(1)).alias("n_rows"))
        out = out.join(n, source_col, "left")
    return out


def level_for_progress(progress: Column, n_levels: int) -> Column:
    """min(floor(progress * levels) + 1, levels)."""
    return F.least(F.floor(progress * F.lit(n_levels)).cast("int") + 1, F.lit(n_levels))


def assign_levels(steps: DataFrame, n_epochs: int, n_levels: int, group_cols: Sequence[str] = ("run",),
                  epoch_col: str = "epoch", step_col: str = "step") -> DataFrame:
    """Level of every (epoch, step) row from epoch progress; never decreasing (running max)."""
    g = list(group_cols)
    x = steps.withColumn("_lv", level_for_progress(F.col(epoch_col) / F.lit(float(n_epochs)), n_levels))
    st = x.agg(F.min(step_col).alias("lo"), F.max(step_col).alias("hi"), F.count(F.lit(1)).alias("c")).first()
    bkt = value_range_bucket(step_col, float(st["lo"] or 0), float(st["hi"] or 0), buckets_for(int(st["c"] or 0)))
    return bucketed_running(x, g, [step_col], bkt, {"level": ("max", F.col("_lv"))}).drop("_lv")


def open_sources(assigned: DataFrame, levels: DataFrame, source_col: str = "source", level_col: str = "level") -> DataFrame:
    """Every row of ``assigned`` (its ``level``) with each source open at it: those of that level and all below.

    ``levels``: (source, level) of :func:`curriculum_levels`. A source of level s is listed for each level
    from s to the last, so the range condition becomes one equi-join on the level; the listing has
    sources x levels rows. Result: the columns of ``assigned``, then source and source_level. A row whose
    level opens nothing (below the first level, null) has no source.
    """
    reg = levels.select(F.col(source_col).alias("source"), F.col(level_col).cast("int").alias("source_level")).distinct()
    last = reg.agg(F.max("source_level")).first()[0] or 0
    listed = reg.where(F.col("source_level") <= last).withColumn("_at", F.explode(F.sequence("source_level", F.lit(last))))
    at = F.when(F.col(level_col).isNotNull(), F.least(F.col(level_col), F.lit(last)))  # beyond the last level all sources are open
    return assigned.withColumn("_at", at).join(listed, "_at").drop("_at")


def advance_on_score(trace: DataFrame, perf_col: str, max_level: int, group_cols: Sequence[str] = ("run",),
                     step_col: str = "step", threshold: float = PERFORMANCE_STEP) -> DataFrame:
    """+1 level at each evaluation with performance > threshold, capped at max_level."""
    st = trace.agg(F.min(step_col).alias("lo"), F.max(step_col).alias("hi"), F.count(F.lit(1)).alias("c")).first()
    bkt = value_range_bucket(step_col, float(st["lo"] or 0), float(st["hi"] or 0), buckets_for(int(st["c"] or 0)))
    x = bucketed_running(trace, list(group_cols), [step_col], bkt,
                         {"_ups": ("sum", F.when(F.col(perf_col) > threshold, 1).otherwise(0))})
    return x.withColumn("level", F.least(F.lit(1) + F.col("_ups"), F.lit(max_level)).cast("int")).drop("_ups")


def curriculum_draw(rows: DataFrame, levels: DataFrame, level: int, n_draws: int | None = None,
                    source_col: str = "source", key_col: str = "row_id", weight_col: str | None = None,
                    salt: str = "draw") -> DataFrame:
    """``n_draws`` draws with replacement at ``level``: a source by cumulative integer weight, then a uniform row.

    ``n_draws`` defaults to the number of rows at the level (the epoch length).
    The per-source table (weights, row counts) has one row per source and is
    evaluated as a literal array; rows are fetched by (source, position).
    """
    lv = levels.where(F.col("level") == level)
    idx = source_index(rows.join(lv.select(source_col), source_col), source_col, key_col)
    per = idx.groupBy(source_col).agg(F.max("n").alias("n"))
    if weight_col:
        per = per.join(lv.select(source_col, weight_col), source_col)
    srcs = sorted((r[source_col], int(r["n"]), int(r[weight_col]) if weight_col else 1) for r in per.collect())
    total_w = sum(w for _, _, w in srcs)
    if n_draws is None:
        n_draws = sum(n for _, n, _ in srcs)
    cum, acc = [], 0
    for s, n, w in srcs:
        acc += w
        cum.append(F.struct(F.lit(acc).alias("cw"), F.lit(s).alias("s"), F.lit(n).alias("n")))
    spark = rows.sparkSession
    d = spark.range(n_draws).withColumnRenamed("id", "draw_id")
    u = F.pmod(hkey(F.lit(salt), F.lit(level), "draw_id"), F.lit(total_w))
    pick = F.filter(F.array(*cum), lambda x: u < x["cw"])[0]
    d = d.withColumn("_p", pick).select("draw_id", F.col("_p.s").alias(source_col), F.col("_p.n").alias("_n"))
    d = d.withColumn("pos", F.pmod(hkey(F.lit(salt + "|row"), F.lit(level), "draw_id"), F.col("_n")))
    out = d.join(idx.select(source_col, "pos", key_col), [source_col, "pos"])
    return out.select("draw_id", source_col, key_col, F.lit(level).alias("level"))


def sampling_stats(draws: DataFrame, source_col: str = "source") -> DataFrame:
    """Draws and percentage per source (with its level)."""
    c = draws.groupBy(source_col, "level").agg(F.count(F.lit(1)).alias("n_draws"))
    # the grouped table has one row per source, so a window over all of it is small
    return c.withColumn("pct", F.round(F.col("n_draws") * 100.0 / F.sum("n_draws").over(Window.partitionBy()), 6))


STATE_SCHEMA = T.StructType(
    [
        T.StructField("current_level", T.IntegerType()),
        T.StructField("level_progress", T.DoubleType()),
        T.StructField("sample_counts", T.MapType(T.StringType(), T.LongType())),
        T.StructField("total_samples", T.LongType()),
    ]
)


def curriculum_state(draws: DataFrame, level: int, progress: float, source_col: str = "source") -> DataFrame:
    """One-row state; counts come from the draws table (not from loader workers)."""
    c = draws.groupBy(source_col).agg(F.count(F.lit(1)).alias("n"))
    return c.agg(
        F.lit(level).cast("int").alias("current_level"),
        F.lit(float(progress)).alias("level_progress"),
        F.map_from_entries(F.collect_list(F.struct(source_col, "n"))).alias("sample_counts"),
        F.sum("n").cast("long").alias("total_samples"),
    )


def save_state(state: DataFrame, path: str) -> None:
    state.coalesce(1).write.mode("overwrite").json(path)


def load_state(spark, path: str) -> DataFrame:
    """M16 restore: missing keys get defaults (1, 0.0, {}, 0)."""
    s = spark.read.schema(STATE_SCHEMA).json(path)
    return s.select(
        F.coalesce("current_level", F.lit(1)).alias("current_level"),
        F.coalesce("level_progress", F.lit(0.0)).alias("level_progress"),
        F.coalesce("sample_counts", F.create_map().cast("map<string,bigint>")).alias("sample_counts"),
        F.coalesce("total_samples", F.lit(0).cast("long")).alias("total_samples"),
    )


def resume_after(batches: DataFrame, epoch: int, step: int, epoch_col: str = "epoch", step_col: str = "batch") -> DataFrame:
    """Batches strictly after (epoch, step)."""
    e, s = F.col(epoch_col), F.col(step_col)
    return batches.where((e > epoch) | ((e == epoch) & (s > step)))


def collate(batches: DataFrame, batch_col: str = "batch_seq", order_col: str = "pos_in_batch",
            fields: Sequence[str] = ("row_id",)) -> DataFrame:
    """One record per batch with its rows in order (a batch is bounded by the batch size)."""
    return batches.groupBy(batch_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(order_col, *fields))), lambda s: F.struct(*[s[f] for f in fields])).alias("rows"),
        F.count(F.lit(1)).alias("size"),
    )


def hash_unit(h: Column) -> Column:
    """A 60-bit hash as a double in [0, 1)."""
    return h.cast("double") / F.lit(float(1 << HASH_BITS))

"""Triplet construction and negative sampling.

Every random choice of the reference is replaced by a hash key of the row's
own key (see :mod:`tripletframe.functions.keys`), so the result does not depend
on partitioning, and DuckDB can reproduce it.

Negatives are drawn by an *indexed derangement*: rows are numbered in their
group and row ``i`` takes the answer of row ``(i + 1 + h mod (n-1)) mod n`` of
the group or of its run of ``batch_size`` numbers: uniform over the other rows
and never itself, found with one equi-join on (group, index), never a cross join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripletframe.functions import columns as P
from tripletframe.functions.keys import hkey
from tripletframe.operators.indexing import bucketed_running, buckets_for, buckets_of, dense_index, derangement_partner, hash_range_bucket
from tripletframe.session import cut_lineage

TRIPLET_COLS = ("premise", "correct_answer", "incorrect_answer")
# NLI label ids and role names of the reference.
NLI_ROLES = {0: "correct_answer", 1: "neutral", 2: "incorrect_answer"}
# Fact-verification label names and their codes.
FACT_LABELS = {"SUPPORTS": 1, "REFUTES": 0, "NOT_ENOUGH_INFO": -1}
DEFAULT_BATCH = 100_000


# ------------------------------------------------------------------ T1, T2

def nli_pivot(
    df: DataFrame,
    premise: str = "premise",
    hypothesis: str = "hypothesis",
    label: str = "label",
    mapping: Mapping = NLI_ROLES,
    order_col: str = "row_id",
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """One row per premise with the first hypothesis of each role.

    ``min_by`` keeps the hash aggregate partial (map-side combine), so a premise
    holding a large share of the rows costs one partial row per map task.
    Rows with an unmapped label or null premise vanish; a premise needs both a
    correct and an incorrect answer; neutral stays optional.
    """
    x = df.withColumn("_role", P.label_map(label, mapping)).where(
        F.col("_role").isNotNull() & F.col(premise).isNotNull()
    )

    def first(role):
        ordk = F.when((F.col("_role") == role) & F.col(hypothesis).isNotNull(), F.col(order_col))
        return F.min_by(F.col(hypothesis), ordk), F.min(ordk)

    c, c_o = first("correct_answer")
    n, _ = first("neutral")
    i, i_o = first("incorrect_answer")
    out = x.groupBy(*group_cols, F.col(premise).alias("premise")).agg(
        c.alias("correct_answer"),
        n.alias("neutral"),
        i.alias("incorrect_answer"),
        F.least(c_o, i_o).alias(order_col),
    )
    return out.where(F.col("correct_answer").isNotNull() & F.col("incorrect_answer").isNotNull())


def dedupe_triplets(df: DataFrame, keys: Sequence[str] = TRIPLET_COLS, order_col: str = "row_id") -> DataFrame:
    """Distinct on the key texts, keeping the first row (smallest order_col)."""
    others = [c for c in df.columns if c not in keys and c != order_col]
    aggs = [F.min(order_col).alias(order_col)]
    if others:
        aggs.append(F.min_by(F.struct(*others), F.col(order_col)).alias("_rest"))
    out = df.groupBy(*keys).agg(*aggs)
    return out.select(*keys, order_col, "_rest.*") if others else out


# ------------------------------------------------------------------ T3, T4

def sample_negatives(
    df: DataFrame,
    answer_col: str = "correct_answer",
    key_col: str = "row_id",
    out_col: str = "incorrect_answer",
    batch_size: int | None = None,
    group_cols: Sequence[str] = (),
    salt: str = "neg",
    rows_per_bucket: int | None = None,
    distinct_text: bool = False,
) -> DataFrame:
    """For every row the answer of a uniformly chosen *other* row of its group or batch.

    The rows of a group (e.g. split) are numbered in hash order by range buckets,
    so no window task ranks more than about ``rows_per_bucket`` rows, nor sorts many more
    than ``BYTES_PER_BUCKET`` bytes of texts, at any size.
    Without ``batch_size`` the partner is any other row of the group (T3); with it
    (2 or more), any other row of the same run of ``batch_size`` numbers (T4). A
    last run of one row joins the run before, so only a group of one row has no
    negative; such rows are dropped.

    With ``distinct_text`` the negative's text is never the row's own (see
    :func:`distinct_partners`); ``key_col`` must then be unique. Rows whose group or
    batch holds one text only are dropped.
    """
    if batch_size is not None and batch_size < 2:
        raise ValueError("a batch needs two rows or more")
    g = list(group_cols)
    if distinct_text:
        return _distinct_negatives(df, answer_col, key_col, out_col, batch_size, g, salt, rows_per_bucket)
    x = df.withColumn("_h", hkey(F.lit(salt), key_col))
    x = dense_index(x, g, ["_h", key_col], hash_range_bucket("_h", buckets_of(df, rows_per_bucket)), "_p", "_gn")
    p, n, lo = F.col("_p"), F.col("_gn"), F.lit(0)
    if batch_size is not None:
        last = F.greatest(F.lit(1), F.ceil((n - 1) / F.lit(batch_size))) - 1
        batch = F.least(F.floor(p / F.lit(batch_size)), last)
        lo = batch * F.lit(batch_size)
        n = F.when(batch == last, n - lo).otherwise(F.lit(batch_size))
    x = x.withColumn("_t", lo + derangement_partner(p - lo, n, hkey(F.lit(salt + "|pick"), key_col)))
    right = x.select(*g, F.col("_p").alias("_t"), F.col(answer_col).alias(out_col))
    left = x.drop(out_col) if out_col in x.columns else x
    return left.join(right, [*g, "_t"]).drop("_h", "_gn", "_p", "_t")


def _runs(keys: DataFrame, g: list[str], key_col: str, batch_size: int, salt: str, buckets: int) -> DataFrame:
    """Add ``_run``: the row's run of ``batch_size`` numbers in hash order (a last run of one row joins the one before)."""
    x = dense_index(keys.withColumn("_h", hkey(F.lit(salt), key_col)), g, ["_h", key_col], hash_range_bucket("_h", buckets), "_p", "_gn")
    last = F.greatest(F.lit(1), F.ceil((F.col("_gn") - 1) / F.lit(batch_size))) - 1
    return x.withColumn("_run", F.least(F.floor(F.col("_p") / F.lit(batch_size)), last)).drop("_h", "_p", "_gn")


def distinct_partners(keys: DataFrame, group_cols: Sequence[str], key_col: str, text_col: str, salt: str, buckets: int) -> DataFrame:
    """(group, key, ``_other``): for every row the key of a uniformly chosen row of its group with another text.

    Equal texts lie side by side in a numbering of the group: a text starts after the rows of all texts with smaller
    hashes (a running sum over distinct texts) and its rows follow in hash order. A row of a text that starts at S
    and has m of the n rows takes the number (S + m + h mod (n - m)) mod n, which lies outside the text's own rows: one
    equi-join on the number, nothing is drawn again. A text that a third of all rows share is spread
    over the hash buckets of its rows. Groups with one text give no rows.
    """
    g = list(group_cols)
    x = keys.withColumn("_hr", hkey(F.lit(salt), key_col))
    texts = x.groupBy(*g, text_col).agg(F.count(F.lit(1)).alias("_m")).withColumn("_ht", hkey(F.lit(salt + "|text"), text_col))
    sizes = texts.groupBy(*g).agg(F.sum("_m").alias("_n")) if g else None
    texts = bucketed_running(texts, g, ["_ht", text_col], hash_range_bucket("_ht", buckets), {"_s": ("sum", F.col("_m"))}, inclusive=False).drop("_ht")
    x = dense_index(x, [*g, text_col], ["_hr", key_col], hash_range_bucket("_hr", buckets), "_r", None)
    x = x.join(texts, [*g, text_col])
    x = x.join(sizes, g) if g else x.withColumn("_n", F.lit(keys.count()).cast("long"))
    n, m, start = F.col("_n"), F.col("_m"), F.col("_s")
    to = F.when(n > m, F.pmod(start + m + F.pmod(hkey(F.lit(salt + "|pick"), key_col), n - m), n))
    x = cut_lineage(x.select(*g, key_col, (start + F.col("_r")).alias("_p"), to.alias("_t")))  # both sides of the join read it
    return x.where("_t is not null").select(*g, key_col, "_t").join(x.select(*g, F.col("_p").alias("_t"), F.col(key_col).alias("_other")), [*g, "_t"]).drop("_t")


def _distinct_negatives(df, answer_col, key_col, out_col, batch_size, g, salt, rows_per_bucket) -> DataFrame:
    """Keys and text digests are numbered; the texts join last, by key. A row with a null answer neither gives nor gets a negative."""
    keys = cut_lineage(df.where(F.col(answer_col).isNotNull()).select(*g, key_col, F.md5(F.col(answer_col).cast("binary")).alias("_text")))
    buckets = buckets_for(keys.count(), rows_per_bucket)
    if batch_size is not None:
        keys = cut_lineage(_runs(keys, g, key_col, batch_size, salt, buckets))
    pick = distinct_partners(keys, [*g, "_run"] if batch_size is not None else g, key_col, "_text", salt, buckets).select(key_col, "_other")
    found = pick.join(df.select(F.col(key_col).alias("_other"), F.col(answer_col).alias(out_col)), "_other").drop("_other")
    return df.drop(out_col).join(found, key_col)


def sample_negatives_batch(df: DataFrame, batch_size: int = DEFAULT_BATCH, **kw) -> DataFrame:
    """T4: in-batch negatives; rows whose negative is null are dropped."""
    out = sample_negatives(df, batch_size=batch_size, **kw)
    return out.where(F.col(kw.get("out_col", "incorrect_answer")).isNotNull())


# ------------------------------------------------------------------ T5

def caption_triplets(df: DataFrame, image_col: str = "image_id", caption_col: str = "caption", key_col: str = "row_id",
                     rows_per_bucket: int | None = None) -> DataFrame:
    """T5: per caption a different-text caption of the same image and a caption of another image.

    * positive: the distinct captions of an image are numbered in hash order and
      the derangement picks another *distinct text* (no pairs within an image
      are formed); an image with one distinct text gives no row.
    * negative: images are numbered, the derangement picks another image
      (uniform over images), a second hash picks one of its caption rows
      (uniform over that image's captions, duplicates counted).

    Captions are numbered and drawn by their digests; the texts join last.
    """
    texts = df.select(key_col, image_col, caption_col).where(F.col(caption_col).isNotNull()).withColumn("_d", F.unhex(F.sha2(caption_col, 256)))
    rows = cut_lineage(texts.select(key_col, image_col, "_d", hkey(F.lit("cap"), image_col, caption_col).alias("_hd")))
    nbk = buckets_for(rows.count(), rows_per_bucket)

    distinct = dense_index(rows.select(image_col, "_d", "_hd").distinct(), [image_col], ["_hd", "_d"], hash_range_bucket("_hd", nbk), "_k", "_m")

    images = rows.groupBy(image_col).agg(F.count(F.lit(1)).alias("_c")).withColumn("_himg", hkey(F.lit("img"), image_col))
    images = dense_index(images, [], ["_himg", image_col], hash_range_bucket("_himg", nbk), "_g", "_ng").drop("_himg")

    caprows = rows.withColumn("_hr", hkey(F.lit("caprow"), key_col))
    caprows = dense_index(caprows, [image_col], ["_hr", key_col], hash_range_bucket("_hr", nbk), "_r", None)

    x = rows.drop("_hd").join(distinct.select(image_col, "_d", "_k", "_m"), [image_col, "_d"])
    x = x.withColumn("_pk", derangement_partner("_k", "_m", hkey(F.lit("pos"), key_col))).where(F.col("_pk").isNotNull())
    x = x.join(distinct.select(image_col, F.col("_k").alias("_pk"), F.col("_d").alias("_pos")), [image_col, "_pk"])

    x = x.join(images.select(image_col, "_g", "_ng"), image_col)
    x = x.withColumn("_og", derangement_partner("_g", "_ng", hkey(F.lit("negimg"), key_col))).where(F.col("_og").isNotNull())
    other = images.select(F.col(image_col).alias("_oimg"), F.col("_g").alias("_og"), F.col("_c").alias("_oc"))
    x = x.join(other, "_og")
    x = x.withColumn("_or", F.pmod(hkey(F.lit("negcap"), key_col), F.col("_oc")))
    x = x.join(caprows.select(F.col(image_col).alias("_oimg"), F.col("_r").alias("_or"), F.col("_d").alias("_neg")), ["_oimg", "_or"])
    x = x.select(key_col, image_col, "_d", "_pos", "_oimg", "_neg")

    # the texts last: one copy of each image's distinct captions, asked for by (image, digest)
    known = texts.select(F.col(image_col).alias("_ti"), F.col("_d").alias("_td"), F.col(caption_col).alias("_text")).repartition("_ti", "_td").distinct()
    for image, digest, out in ((image_col, "_d", "premise"), (image_col, "_pos", "correct_answer"), ("_oimg", "_neg", "incorrect_answer")):
        x = x.join(known.withColumnRenamed("_text", out), (F.col(image) == F.col("_ti")) & (F.col(digest) == F.col("_td"))).drop("_ti", "_td")
    return x.select(key_col, *TRIPLET_COLS)


# ------------------------------------------------------------------ T6-T9

def caption_concat_triplets(df: DataFrame, answers_col: str = "answer", key_col: str = "row_id", **kw) -> DataFrame:
    """All-but-last captions -> premise, last -> correct, negative = another row's correct."""
    x = df.where(F.size(answers_col) > 1).select(
        key_col,
        P.join_all_but_last(answers_col).alias("premise"),
        F.element_at(answers_col, -1).alias("correct_answer"),
    )
    return sample_negatives(x, **kw).dropna(subset=list(TRIPLET_COLS))


def answer_list_triplets(
    df: DataFrame,
    correct_col: str = "correct_answers",
    incorrect_col: str = "incorrect_answers",
    stop: str = P.STOP_ANSWER,
    correct_stop: str | None = None,
) -> DataFrame:
    """Clean both answer lists (P6), keep rows with > 1 left in each, last correct -> premise.

    ``correct_stop`` reproduces the reference's doubled stop string for the
    correct list when set; by default both lists use ``stop``.
    """
    x = df.withColumn("_c", P.clean_answer_list(correct_col, correct_stop or stop)).withColumn(
        "_i", P.clean_answer_list(incorrect_col, stop)
    )
    x = x.where((F.size("_c") > 1) & (F.size("_i") > 1))
    prem, first = P.first_last("_c")
    return x.select(
        *[c for c in df.columns if c not in (correct_col, incorrect_col)],
        prem.alias("premise"),
        first.alias("correct_answer"),
        F.element_at("_i", 1).alias("incorrect_answer"),
    )


def two_view_union(df: DataFrame, key_col: str = "row_id", views=(("summary1", "sentences1"), ("summary2", "sentences2")), **kw):
    """Unpivot two (summary, sentences) views, negative = another row's first summary sentence, then P5."""
    parts = []
    for v, (s, t) in enumerate(views):
        parts.append(
            df.select(
                (F.col(key_col) * len(views) + v).alias(key_col),
                F.col(s).alias("premise"),
                F.col(t).alias("correct_answer"),
                P.head_sentence(s).alias("_first"),
            )
        )
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    u = u.dropna(subset=["premise", "correct_answer", "_first"])
    x = sample_negatives(u, answer_col="_first", key_col=key_col, **kw).drop("_first")
    return P.min_length(x.dropna(subset=list(TRIPLET_COLS)), list(TRIPLET_COLS), 3)


def fact_triplets(
    df: DataFrame,
    claim: str = "claim",
    evidence: str = "evidence",
    label: str = "evidence_label",
    key_col: str = "row_id",
    split_col: str = "split",
    **kw,
) -> DataFrame:
    """Supports-only evidence -> premise, claim -> correct, negative = another claim of the split."""
    x = P.map_label(df, label, FACT_LABELS, "_lab")
    x = P.filter_label(x, "_lab", keep=[1])
    x = P.rename_map(x.select(key_col, split_col, evidence, claim), {evidence: "premise", claim: "correct_answer"})
    x = sample_negatives(x, group_cols=[split_col], **kw)
    return x.dropna(subset=["correct_answer", "incorrect_answer"])


# ------------------------------------------------------------------ T10, T11

def balanced_pairs(df: DataFrame, label_col: str = "label", k: int = 150, key_col: str = "row_id", salt: str = "bal",
                   strict: bool = True) -> DataFrame:
    """K hash-random rows per class; a class of fewer rows is an error, or kept whole when not ``strict``.

    ``row_number() <= k`` over a class is planned with a partial per-partition
    limit before the shuffle (WindowGroupLimit), so a large class ships only k
    rows per map task.
    """
    if strict:
        short = df.groupBy(label_col).count().where(F.col("count") < k).limit(5).collect()
        if short:
            raise ValueError(f"classes with fewer than {k} rows: " + ", ".join(f"{r[0]} ({r[1]})" for r in short))
    x = df.withColumn("_h", hkey(F.lit(salt), key_col))
    w = Window.partitionBy(label_col).orderBy("_h", key_col)
    return x.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= k).drop("_rk", "_h")


def reservoir_sample(df: DataFrame, k: int = 1000, key_col: str = "row_id", salt: str = "res") -> DataFrame:
    """Uniform k-subset = the k smallest hash keys (per-partition top-k, then merge)."""
    x = df.withColumn("_h", hkey(F.lit(salt), key_col))
    return x.orderBy("_h", key_col).limit(k).drop("_h")


# ------------------------------------------------------------------ T12

def prepare_source(
    df: DataFrame,
    kind: str,
    columns: Mapping[str, str] | None = None,
    batch_size: int = DEFAULT_BATCH,
    key_col: str = "row_id",
    score_col: str = "score",
    score_top: float = 5.0,
) -> DataFrame:
    """Registry-driven preparation of one source into the triplet table.

    * ``triplets``: renamed, own negatives kept;
    * ``pairs``: renamed, in-batch negatives (T4);
    * ``pkl`` / ``prepared``: passed through;
    * a ``score`` column (after renaming) is normalised 0..5 -> 0..1 (P10).
    """
    x = P.rename_map(df, columns or {})
    if kind == "pairs":
        x = sample_negatives_batch(x, batch_size=batch_size, key_col=key_col)
    elif kind not in ("triplets", "pkl", "prepared"):
        raise ValueError(f"unknown source type {kind!r}")
    cols = [key_col, *TRIPLET_COLS]
    if score_col in x.columns:
        x = x.withColumn(score_col, P.norm_score(score_col, score_top))
        cols.append(score_col)
    return x.select(*cols).dropna(subset=list(TRIPLET_COLS) + ([score_col] if score_col in cols else []))


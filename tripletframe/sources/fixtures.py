"""Test views built from the driver tables, in Spark and in DuckDB SQL.

The reference's corpora (NLI sets, captions, answer lists, scored pairs...)
are not available offline; each view below gives the same *shape* from the
driver tables, always over the whole tables and whole texts. Each view has a
Spark builder ``fx_<name>(spark, sf_dir)`` and a DuckDB text in ``FX_SQL``;
:func:`with_views` prepends the needed DuckDB views as CTEs to an oracle query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripletframe.functions.keys import hkey, hkey_sql
from tripletframe.operators.indexing import buckets_for, dense_index, value_range_bucket

# Metric names of the wide score table, in the reference's order.
METRICS = ["r1f1", "r2f1", "rLf1", "meteor", "embsim", "bert", "bleurt", "simcse", "learned"]
TOKEN_DIM = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokens_expr(text_col: str = "text"):
    """Lower-case ASCII word tokens of a whole text (regex tokeniser)."""
    return F.filter(
        F.split(F.lower(F.col(text_col)), "[^a-z0-9]+"),
        lambda x: x != "",
    )


def _ordered_index(df: DataFrame, group: list[str], order: list[str], key: str, idx_col: str, n_col: str = "n"):
    """dense_index with range buckets of a numeric key (bounds from one small aggregate)."""
    st = df.agg(F.count(F.lit(1)).alias("c"), F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    nb = buckets_for(int(st["c"] or 0))
    lo, hi = float(st["lo"] or 0), float(st["hi"] or 0)
    return dense_index(df, group, order, value_range_bucket(key, lo, hi, nb), idx_col=idx_col, n_col=n_col)


# ---------------------------------------------------------------- Spark views

def fx_labeled(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic", F.lit(1).alias("_hit"))
    j = d.join(lab, "doc_id", "left")
    label = (
        F.when(F.col("_hit").isNull(), -1)
        .when(F.col("toxic") == 1, 1)
        .when(F.col("quality") == 1, 0)
        .otherwise(2)
    )
    return j.select(
        F.col("doc_id").alias("row_id"),
        F.concat("source", F.lit("/"), "lang").alias("premise"),
        F.col("text").alias("hypothesis"),
        label.cast("int").alias("label"),
        F.when(F.pmod(hkey("doc_id"), F.lit(10)) < 8, "train").otherwise("validation").alias("split"),
    )


def fx_pairs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    a = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("premise"))
    b = c.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("correct_answer")
    )
    j = a.join(b, ["conv_id", "turn"])
    return j.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"),
        "premise",
        "correct_answer",
        (F.pmod(hkey("conv_id", "turn"), F.lit(51)).cast("double") / 10).alias("raw_score"),
    )


def fx_captions(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("row_id"),
        F.concat("source", F.lit("/"), F.expr("CAST(doc_id DIV 200 AS STRING)")).alias("image_id"),
        F.col("text").alias("caption"),
    )


def fx_answers(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")

    def ordered(role):
        return F.transform(
            F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))),
            lambda x: x["text"],
        )

    return c.groupBy(F.col("conv_id").alias("q_id")).agg(
        ordered("assistant").alias("correct_answers"), ordered("user").alias("incorrect_answers")
    )


def fx_sources(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("row_id"),
        "source",
        (F.pmod(F.substring("source", 4, 100).cast("int"), F.lit(5)) + 1).alias("difficulty"),
        "text",
    )


def fx_vec_triplets(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    v = _ordered_index(e, ["label"], ["vec_id"], "vec_id", "i")
    sizes = v.select(F.col("label").alias("qlabel"), F.col("n").alias("qn")).distinct()
    a = (
        v.where("n > 1")
        .withColumn("pi", F.pmod(F.col("i") + 1, F.col("n")))
        .withColumn("qlabel", F.pmod(F.col("label") + 1, F.lit(10)))
        .join(sizes, "qlabel")
        .withColumn("qi", F.pmod(F.col("i"), F.col("qn")))
    )
    p = v.select("label", F.col("i").alias("pi"), F.col("embedding").alias("pos"))
    q = v.select(F.col("label").alias("qlabel"), F.col("i").alias("qi"), F.col("embedding").alias("neg"))
    j = a.join(p, ["label", "pi"]).join(q, ["qlabel", "qi"])
    return j.select(F.col("vec_id").alias("row_id"), "label", F.col("embedding").alias("ref"), "pos", "neg")


def fx_scores(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("elabel"))
    x = e.select(
        "vec_id",
        "elabel",
        F.explode(F.array(F.lit(0), F.lit(1))).alias("label"),
    ).select("*", F.explode(F.array(*[F.lit(m) for m in METRICS])).alias("metric"))
    return x.select(
        F.concat(F.lit("ds"), F.pmod("elabel", F.lit(3)).cast("string")).alias("dataset"),
        F.col("vec_id").alias("row_id"),
        "label",
        "metric",
        (F.pmod(hkey("metric", "vec_id", "label"), F.lit(1000)).cast("double") / 999 * 0.7 + 0.3 * F.col("label")).alias(
            "score"
        ),
    )


def fx_human(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    keys = e.select(
        F.concat(F.lit("ds"), F.pmod("label", F.lit(3)).cast("string")).alias("dataset"),
        F.col("vec_id").alias("row_id"),
        F.explode(F.array(F.lit(0), F.lit(1))).alias("label"),
    )
    x = keys.select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("annotator"))
    x = x.where(F.pmod(hkey("row_id", "annotator"), F.lit(3)) <= F.col("annotator"))
    return x.select(
        "dataset",
        "row_id",
        "label",
        "annotator",
        F.pmod(hkey("row_id", "label", "annotator"), F.lit(6)).cast("int").alias("human_score"),
    )


def fx_trace(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(
        "event_id", "ts", (F.col("user_id") % 4).alias("run"), F.unix_micros(F.col("ts").cast("timestamp")).alias("_us")
    )
    ix = _ordered_index(ev, ["run"], ["ts", "event_id"], "_us", "step0", n_col=None)
    return ix.select(
        "run",
        (F.col("step0") + 1).cast("int").alias("step"),
        "ts",
        (F.pmod(hkey("event_id"), F.lit(1000)).cast("double") / 1000).alias("pos_sim"),
        (F.pmod(hkey("event_id", F.lit("n")), F.lit(1000)).cast("double") / 1000).alias("neg_sim"),
    )


def fx_tokens(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("row_id"), F.posexplode(_tokens_expr("text")).alias("pos", "token"))


def token_lists(spark, sf_dir):
    """(row_id, tokens): the rows of fx_tokens as one list a document, in their order (null or empty for documents without tokens)."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("row_id"), _tokens_expr("text").alias("tokens"))


def fx_token_vectors(spark, sf_dir):
    toks = fx_tokens(spark, sf_dir).select("token").distinct()
    x = toks.select("token", F.explode(F.sequence(F.lit(0), F.lit(TOKEN_DIM - 1))).alias("j"))
    return x.select(
        "token",
        F.col("j").cast("int").alias("j"),
        ((F.pmod(hkey("token", "j"), F.lit(2001)) - 1000).cast("double") / 1000).alias("v"),
    )


def fx_texts(spark, sf_dir):
    """Documents, and for each an empty, a null and a non-Latin text: rows without any token."""
    d = table(spark, sf_dir, "documents")
    odd = F.concat(F.lit("\u65e5\u672c \u2014 \u00e9\u00df "), F.regexp_replace("lang", "[^\u00e0-\u00ff]", "\u6587"))
    kinds = F.array(F.struct(F.lit(0).alias("k"), F.col("text").alias("t")), F.struct(F.lit(1).alias("k"), F.lit("").alias("t")),
                    F.struct(F.lit(2).alias("k"), F.lit(None).cast("string").alias("t")), F.struct(F.lit(3).alias("k"), odd.alias("t")))
    return d.select("doc_id", F.inline(kinds)).select((F.col("doc_id") * 4 + F.col("k")).alias("row_id"), F.col("t").alias("text"))


VIEWS = {
    "fx_texts": fx_texts,
    "fx_labeled": fx_labeled,
    "fx_pairs": fx_pairs,
    "fx_captions": fx_captions,
    "fx_answers": fx_answers,
    "fx_sources": fx_sources,
    "fx_vec_triplets": fx_vec_triplets,
    "fx_scores": fx_scores,
    "fx_human": fx_human,
    "fx_trace": fx_trace,
    "fx_tokens": fx_tokens,
    "fx_token_vectors": fx_token_vectors,
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return VIEWS[name](spark, sf_dir)


# ---------------------------------------------------------------- DuckDB views

_metric_list = ", ".join(f"'{m}'" for m in METRICS)

FX_SQL: dict[str, tuple[str, tuple[str, ...]]] = {
    "fx_labeled": (
        f"""select d.doc_id as row_id, d.source || '/' || d.lang as premise, d.text as hypothesis,
  cast(case when l.doc_id is null then -1 when l.toxic = 1 then 1 when l.quality = 1 then 0 else 2 end as integer) as label,
  case when {hkey_sql('d.doc_id')} % 10 < 8 then 'train' else 'validation' end as split
from documents d left join labels l on d.doc_id = l.doc_id""",
        (),
    ),
    "fx_pairs": (
        f"""select a.conv_id * 1000 + a.turn as row_id, a.text as premise, b.text as correct_answer,
  cast({hkey_sql('a.conv_id', 'a.turn')} % 51 as double) / 10 as raw_score
from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1
where a.role = 'user' and b.role = 'assistant'""",
        (),
    ),
    "fx_captions": (
        """select doc_id as row_id, source || '/' || cast(doc_id // 200 as varchar) as image_id, text as caption
from documents""",
        (),
    ),
    "fx_answers": (
        """select conv_id as q_id,
  coalesce(list(text order by turn) filter (where role = 'assistant'), []) as correct_answers,
  coalesce(list(text order by turn) filter (where role = 'user'), []) as incorrect_answers
from conversations group by conv_id""",
        (),
    ),
    "fx_sources": (
        """select doc_id as row_id, source, cast(substr(source, 4) as integer) % 5 + 1 as difficulty, text
from documents""",
        (),
    ),
    "fx_vec_base": (
        """select vec_id, embedding, label, row_number() over (partition by label order by vec_id) - 1 as i,
  count(*) over (partition by label) as n from embeddings""",
        (),
    ),
    "fx_vec_triplets": (
        """select a.vec_id as row_id, a.label, a.embedding as ref, p.embedding as pos, q.embedding as neg
from fx_vec_base a join fx_vec_base p on p.label = a.label and p.i = (a.i + 1) % a.n
join fx_vec_base q on q.label = (a.label + 1) % 10 and q.i = a.i % q.n
where a.n > 1""",
        ("fx_vec_base",),
    ),
    "fx_scores": (
        f"""select 'ds' || cast(e.label % 3 as varchar) as dataset, e.vec_id as row_id, l.label, m.metric,
  cast({hkey_sql('m.metric', 'e.vec_id', 'l.label')} % 1000 as double) / 999 * 0.7 + 0.3 * l.label as score
from embeddings e cross join (select unnest([0, 1]) as label) l
cross join (select unnest([{_metric_list}]) as metric) m""",
        (),
    ),
    "fx_human": (
        f"""select s.dataset, s.row_id, s.label, cast(a.annotator as integer) as annotator,
  cast({hkey_sql('s.row_id', 's.label', 'a.annotator')} % 6 as integer) as human_score
from (select distinct dataset, row_id, label from fx_scores) s
cross join (select unnest(range(0, 3)) as annotator) a
where {hkey_sql('s.row_id', 'a.annotator')} % 3 <= a.annotator""",
        ("fx_scores",),
    ),
    "fx_trace": (
        f"""select user_id % 4 as run,
  cast(row_number() over (partition by user_id % 4 order by ts, event_id) as integer) as step, ts,
  cast({hkey_sql('event_id')} % 1000 as double) / 1000 as pos_sim,
  cast({hkey_sql('event_id', "'n'")} % 1000 as double) / 1000 as neg_sim
from events""",
        (),
    ),
    "fx_texts": (
        """select doc_id * 4 as row_id, text from documents union all select doc_id * 4 + 1, '' from documents
union all select doc_id * 4 + 2, null from documents
union all select doc_id * 4 + 3, '\u65e5\u672c \u2014 \u00e9\u00df ' || regexp_replace(lang, '[^\u00e0-\u00ff]', '\u6587', 'g') from documents""",
        (),
    ),
    "fx_tokens": (
        """select row_id, cast(unnest(range(len(t))) as integer) as pos, unnest(t) as token
from (select doc_id as row_id,
  list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') as t
  from documents)""",
        (),
    ),
    "fx_token_vectors": (
        f"""select t.token, cast(j.j as integer) as j,
  cast({hkey_sql('t.token', 'j.j')} % 2001 - 1000 as double) / 1000 as v
from (select distinct token from fx_tokens) t cross join (select unnest(range(0, {TOKEN_DIM})) as j) j""",
        ("fx_tokens",),
    ),
}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the DuckDB CTEs for ``names`` (dependencies first)."""
    order: list[str] = []

    def add(n):
        if n in order:
            return
        for dep in FX_SQL[n][1]:
            add(dep)
        order.append(n)

    for n in names:
        add(n)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} as (\n{FX_SQL[n][0]}\n)" for n in order)
    body = sql.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {ctes},\n{body[15:]}"
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"


# ---------------------------------------------------------------- derived token tables

def text_tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, token) of whole texts with the fixture tokeniser."""
    return df.select(F.col(key), F.posexplode(_tokens_expr(text)).alias("pos", "token"))


def hashed_vectors(tokens: DataFrame, extra_tokens: tuple[str, ...] = ()) -> DataFrame:
    """Long (token, j, v) hashed vectors for the distinct tokens of ``tokens`` (same rule as fx_token_vectors)."""
    toks = tokens.select("token").distinct()
    if extra_tokens:
        spark = tokens.sparkSession
        toks = toks.unionByName(spark.createDataFrame([(t,) for t in extra_tokens], "token string")).distinct()
    x = toks.select("token", F.explode(F.sequence(F.lit(0), F.lit(TOKEN_DIM - 1))).alias("j"))
    return x.select(
        "token",
        F.col("j").cast("int").alias("j"),
        ((F.pmod(hkey("token", "j"), F.lit(2001)) - 1000).cast("double") / 1000).alias("v"),
    )


def hashed_vector_arrays(tokens: DataFrame, extra_tokens: tuple[str, ...] = ()) -> DataFrame:
    """(token, vec array<double>) by the same rule as :func:`hashed_vectors`, built per token without a regroup."""
    toks = tokens.select("token").distinct()
    if extra_tokens:
        spark = tokens.sparkSession
        toks = toks.unionByName(spark.createDataFrame([(t,) for t in extra_tokens], "token string")).distinct()
    vec = F.transform(F.sequence(F.lit(0), F.lit(TOKEN_DIM - 1)),
                      lambda j: (F.pmod(hkey("token", j), F.lit(2001)) - 1000).cast("double") / 1000)
    return toks.select("token", vec.alias("vec"))


def text_tokens_sql(src: str, key: str, text: str) -> str:
    """DuckDB (key, pos, token) of a text column."""
    return f"""select {key}, cast(unnest(range(len(t))) as integer) as pos, unnest(t) as token
from (select {key}, list_filter(string_split(regexp_replace(lower({text}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') as t
  from {src})"""


def hashed_vectors_sql(tokens_rel: str) -> str:
    return f"""select t.token, cast(j.j as integer) as j, cast({hkey_sql('t.token', 'j.j')} % 2001 - 1000 as double) / 1000 as v
from (select distinct token from {tokens_rel}) t cross join (select unnest(range(0, {TOKEN_DIM})) as j) j"""

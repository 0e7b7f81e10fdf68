"""Lexical pair metrics (E7-E11): ROUGE-1/2/L, Porter stems, METEOR.

ROUGE-N is computed in long form: n-grams of both texts are exploded and
counted per (pair, n-gram) in one partial aggregate, then the clipped overlap
``sum(min(k_gen, k_ref))`` is summed per pair. METEOR's greedy alignment is a
rank match per stage (windows within a pair). Only the LCS of ROUGE-L needs
Python per pair, in an Arrow UDF over token arrays.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripletframe.functions.porter import stem as porter_stem

# METEOR parameters of the reference's metric library.
METEOR_ALPHA, METEOR_BETA, METEOR_GAMMA = 0.9, 3.0, 0.5
# Tokens that one task of METEOR aligns.
TASK_TOKENS = 1 << 17
STEM_MIN_LEN = 3  # words longer than this are stemmed (ROUGE tokenizer rule)


def rouge_tokens(text) -> Column:
    """Lower-case ``[a-z0-9]+`` tokens of a whole text."""
    t = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.regexp_replace(F.lower(t), "[^a-z0-9]+", " "), " "), lambda x: x != "")


def ngrams(arr, n: int) -> Column:
    a = F.col(arr) if isinstance(arr, str) else arr
    if n == 1:
        return a
    grams = F.transform(F.sequence(F.lit(0), F.size(a) - n), lambda i: F.array_join(F.slice(a, i + 1, n), " "))
    return F.when(F.size(a) >= n, grams).otherwise(F.array().cast("array<string>"))


def _prf(ov: Column, ng: Column, nr: Column):
    p = ov / F.greatest(ng, F.lit(1))
    r = ov / F.greatest(nr, F.lit(1))
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return p, r, f


# ------------------------------------------------------------------ E10

@F.pandas_udf(T.StringType())
def _stem_udf(words: pd.Series) -> pd.Series:
    return words.map(porter_stem)


def _stem_of(word: Column, root: Column) -> Column:
    return F.when(F.length(word) > STEM_MIN_LEN, root).otherwise(word)


def stem_table(words: DataFrame, word_col: str = "word") -> DataFrame:
    """(word, stem, root) of the distinct words: root is the Porter stem, stem the same for words longer than 3 letters (ROUGE's rule)."""
    d = words.select(word_col).distinct().withColumn("root", _stem_udf(word_col))
    return d.select(word_col, _stem_of(F.col(word_col), F.col("root")).alias("stem"), "root")


@lru_cache(1 << 17)  # words that a worker keeps between batches
def _root(word: str) -> str:
    return porter_stem(word)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _roots_udf(words: pa.Array) -> pa.Array:
    """Porter stems of lists of words: those of the distinct words of the batch, put back in place."""
    flat = words.flatten().dictionary_encode()
    roots = pa.array([_root(w) for w in flat.dictionary.to_pylist()], pa.string()).take(flat.indices)
    ends = np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), roots, mask=words.is_null())


def n_tokens(texts: DataFrame, cols: Sequence[str]) -> int:
    """Tokens of all texts of ``cols``."""
    n = sum((F.coalesce(F.array_size(rouge_tokens(c)), F.lit(0)).cast("long") for c in cols), F.lit(0).cast("long"))
    return texts.agg(F.sum(n)).first()[0] or 0


def dealt_tokens(texts: DataFrame, key: str, sides: Sequence[str], total: int) -> DataFrame:
    """(key, side, pos, word, stem, root) of the texts ``sides`` (side: their number), rows of null keys left out.

    Whole texts are dealt by ``key`` to tasks of about TASK_TOKENS of the ``total`` tokens and become rows after that, so
    windows and sums by ``key`` follow without a shuffle of tokens. Roots travel beside their words, empty where equal.
    """
    x = texts.where(F.col(key).isNotNull()).select(key, *(rouge_tokens(c).alias(f"w{i}") for i, c in enumerate(sides)))
    x = x.select(key, *(c for i in range(len(sides)) for c in (f"w{i}", _roots_udf(f"w{i}").alias(f"r{i}"))))
    other = lambda i: F.zip_with(f"w{i}", f"r{i}", lambda w, r: F.when(w == r, "").otherwise(r))
    x = x.select(key, *(F.array_join(c, " ").alias(f"{n}{i}") for i in range(len(sides)) for n, c in (("w", f"w{i}"), ("r", other(i)))))
    x = x.repartition(max(2, -(-total // TASK_TOKENS)), key)
    x = x.select(key, F.inline(F.array(*(F.struct(F.lit(i).alias("side"), F.col(f"w{i}").alias("w"), F.col(f"r{i}").alias("r")) for i in range(len(sides))))))
    x = x.select(key, "side", F.posexplode(F.arrays_zip(F.split("w", " ").alias("w"), F.split("r", " ").alias("r"))).alias("pos", "t")).where("t.w <> ''")
    x = x.select(key, "side", "pos", F.col("t.w").alias("word"), F.when(F.col("t.r") == "", F.col("t.w")).otherwise(F.col("t.r")).alias("root"))
    return x.select(key, "side", "pos", "word", _stem_of(F.col("word"), F.col("root")).alias("stem"), "root")


def stem_vocab(words: DataFrame, word_col: str = "word") -> DataFrame:
    """(word, stem) for the distinct words (Porter, words longer than 3 letters)."""
    return stem_table(words, word_col).select(word_col, "stem")


def stemmed_arrays(texts: DataFrame, key_cols, text_col: str, out: str) -> DataFrame:
    """Token arrays with every word replaced by its stem (stems computed once per distinct word)."""
    keys = list(key_cols)
    toks = texts.select(*keys, F.posexplode(rouge_tokens(text_col)).alias("pos", "word"))
    vocab = stem_vocab(toks, "word")
    j = toks.join(vocab, "word")
    empty = F.when(F.col(text_col).isNotNull(), F.array().cast("array<string>"))  # a null text stays null
    arr = j.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "stem"))), lambda s: s["stem"]).alias(out))
    return texts.select(*keys, empty.alias("_none")).join(arr, keys, "left").withColumn(out, F.coalesce(out, "_none")).drop("_none")


def token_arrays(pairs: DataFrame, key: str, gen: str, ref: str, use_stemmer: bool) -> DataFrame:
    """(key, g, r) token arrays of both texts, optionally stemmed."""
    if not use_stemmer:
        return pairs.select(key, rouge_tokens(gen).alias("g"), rouge_tokens(ref).alias("r"))
    g = stemmed_arrays(pairs.select(key, gen), [key], gen, "g")
    r = stemmed_arrays(pairs.select(key, ref), [key], ref, "r")
    return g.join(r, key)


# ------------------------------------------------------------------ E7, E8

def rouge_n(arrays: DataFrame, n: int, key: str = "pair_id", prefix: str | None = None) -> DataFrame:
    """ROUGE-N precision / recall / F1 per pair from token arrays (g = prediction, r = reference); null for a null text."""
    prefix = prefix or f"r{n}"
    none = F.array().cast("array<struct<gram:string,side:int>>")
    of = lambda c, side: F.coalesce(F.transform(ngrams(c, n), lambda x: F.struct(x.alias("gram"), F.lit(side).alias("side"))), none)
    long = arrays.select(key, F.inline(F.concat(of("g", 0), of("r", 1))))  # one explode, not a union: arrays dealt by key stay so
    c = long.groupBy(key, "gram").agg(
        F.sum(1 - F.col("side")).alias("kg"), F.sum("side").alias("kr")
    )
    s = c.groupBy(key).agg(F.sum("kg").alias("ng"), F.sum("kr").alias("nr"), F.sum(F.least("kg", "kr")).alias("ov"))
    both = (F.col("g").isNotNull() & F.col("r").isNotNull()).alias("_both")
    out = arrays.select(key, both).join(s, key, "left").na.fill(0, ["ng", "nr", "ov"])
    p, r, f = (F.when(F.col("_both"), x) for x in _prf(F.col("ov"), F.col("ng"), F.col("nr")))
    return out.select(key, p.alias(f"{prefix}_p"), r.alias(f"{prefix}_r"), f.alias(f"{prefix}f1"))


# ------------------------------------------------------------------ E9

def lcs_length(a, b) -> int:
    """Length of the longest common subsequence (bit-parallel, Python big ints)."""
    if len(a) == 0 or len(b) == 0:
        return 0
    masks: dict = defaultdict(int)
    for i, x in enumerate(a):
        masks[x] |= 1 << i
    full = (1 << len(a)) - 1
    s = full
    for y in b:
        m = masks.get(y, 0)
        u = s & m
        s = ((s + u) | (s - u)) & full
    return len(a) - bin(s).count("1")


_PRF = T.StructType([T.StructField("p", T.DoubleType()), T.StructField("r", T.DoubleType()), T.StructField("f", T.DoubleType())])


@F.pandas_udf(_PRF)
def _rouge_l_udf(g: pd.Series, r: pd.Series) -> pd.DataFrame:
    rows = []
    for a, b in zip(g, r):
        if a is None or b is None:
            rows.append((None, None, None))
            continue
        a, b = list(a), list(b)
        lcs = lcs_length(a, b)
        p = lcs / len(a) if a else 0.0
        rr = lcs / len(b) if b else 0.0
        rows.append((p, rr, 2 * p * rr / (p + rr) if p + rr > 0 else 0.0))
    return pd.DataFrame(rows, columns=["p", "r", "f"])


def rouge_l(arrays: DataFrame, key: str = "pair_id") -> DataFrame:
    """LCS-based precision / recall / F1 per pair; null for a null text."""
    x = arrays.select(key, _rouge_l_udf("g", "r").alias("_l"))
    return x.select(key, F.col("_l.p").alias("rL_p"), F.col("_l.r").alias("rL_r"), F.col("_l.f").alias("rLf1"))


# ------------------------------------------------------------------ E11

def _matched(tokens: DataFrame, key: str, term: str, free: Column) -> Column:
    """Rank of a matched occurrence (null: none): the k-th last free occurrence of a term on one side goes with the k-th last on the other."""
    both, mine = Window.partitionBy(key, term), Window.partitionBy(key, term, "side").orderBy(F.col("pos").desc())
    n = [F.sum(F.when(free & (F.col("side") == side), 1).otherwise(0)).over(both) for side in (0, 1)]
    rank = F.sum(F.when(free, 1).otherwise(0)).over(mine.rowsBetween(Window.unboundedPreceding, 0))
    return F.when(free & (rank <= F.least(*n)), rank)


def meteor_of_tokens(tokens: DataFrame, synonyms: DataFrame | None = None, key: str = "pair_id",
                     alpha: float = METEOR_ALPHA, beta: float = METEOR_BETA, gamma: float = METEOR_GAMMA, dealt: bool = False) -> DataFrame:
    """(key, meteor) of the pairs with a match, from ``tokens(key, side, pos, word, root)``; side 0 is the hypothesis, 1 the reference.

    Words match exactly, then by stem, then by ``synonyms(word, synset)``: one row a word, a synset
    may be named by one of its words. All windows follow the one shuffle by ``key``; no Python runs.
    ``dealt``: the tokens come from :func:`dealt_tokens`, and without synonyms are not shuffled again.
    """
    x = tokens.select(key, "side", "pos", "word", "root")
    stages = [("word", F.col("word")), ("root", F.col("root"))]
    if synonyms is not None:
        sy = synonyms.select(F.col("word").alias("_w"), "synset")
        x = x.join(sy, F.col("word") == F.col("_w"), "left").drop("_w")
        stages.append(("synset", F.coalesce("synset", "word")))
    if synonyms is not None or not dealt:
        x = x.repartition(max(2, -(-x.count() // TASK_TOKENS)), key)  # a task holds ten sorts of its tokens
    free, hit = F.lit(True), []
    for i, (_, term) in enumerate(stages):
        x = x.withColumn(f"_t{i}", term)
        x = x.withColumn(f"_m{i}", _matched(x, key, f"_t{i}", free))
        hit.append(F.when(F.col(f"_m{i}").isNotNull(), F.struct(F.lit(i).alias("stage"), F.col(f"_t{i}").alias("term"), F.col(f"_m{i}").alias("k"))))
        free = free & F.col(f"_m{i}").isNull()
    of_side = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    whole = Window.partitionBy(key)
    x = x.withColumns({"_nh": F.count(F.when(F.col("side") == 0, 1)).over(whole), "_nr": F.count(F.when(F.col("side") == 1, 1)).over(whole), "_hit": F.coalesce(*hit)})
    pairs = x.where(F.col("_hit").isNotNull()).groupBy(key, "_hit").agg(of_side(0, "pos").alias("i"), of_side(1, "pos").alias("j"), F.first("_nh").alias("nh"), F.first("_nr").alias("nr"))
    order = Window.partitionBy(key).orderBy("i")
    follows = (F.col("i") == F.lag("i").over(order) + 1) & (F.col("j") == F.lag("j").over(order) + 1)
    a = pairs.withColumn("_new", F.when(follows, 0).otherwise(1)).groupBy(key).agg(F.count("*").alias("m"), F.sum("_new").alias("chunks"), F.first("nh").alias("nh"), F.first("nr").alias("nr"))
    p, r = F.col("m") / F.col("nh"), F.col("m") / F.col("nr")
    fmean = p * r / (F.lit(alpha) * p + F.lit(1 - alpha) * r)
    return a.select(key, ((1 - F.lit(gamma) * F.pow(F.col("chunks") / F.col("m"), F.lit(beta))) * fmean).alias("meteor"))


def meteor(arrays: DataFrame, key: str = "pair_id", synonyms: DataFrame | None = None) -> DataFrame:
    """METEOR per pair from (unstemmed) token arrays; null for a null text, 0 without a match."""
    long = arrays.select(key, F.lit(0).alias("side"), F.posexplode("g").alias("pos", "word")).unionByName(
        arrays.select(key, F.lit(1).alias("side"), F.posexplode("r").alias("pos", "word")))
    found = meteor_of_tokens(long.join(stem_table(long).select("word", "root"), "word"), synonyms, key)
    both = F.col("g").isNotNull() & F.col("r").isNotNull()
    return arrays.select(key, both.alias("_both")).join(found, key, "left").select(key, F.when(F.col("_both"), F.coalesce("meteor", F.lit(0.0))).alias("meteor"))

"""Every pair metric at once.

Triplets (reference against the correct and the incorrect answer) or pairs
(second text against the first) become one long table of (reference,
candidate) rows. No token is written or shuffled as a row: whole texts and their
stems are dealt by pair once, and become the token rows (with a ``side`` column)
of n-grams, subsequences and alignments where they lie; the vector metrics deal
compressed blocks of pairs into slices, each of which asks a word-vector table
for its distinct words once. The learned metric is a least squares fit over the
others whose normal equations are one aggregate.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripletframe.operators import lexical as L
from tripletframe.operators import scoring as S
from tripletframe.operators.triplets import TRIPLET_COLS
from tripletframe.session import cut_lineage

#: Positions of the padded encoder of ``simcse``.
LENGTH = 512


@dataclass(frozen=True)
class Scored:
    """What the metrics read: texts (pair_id, reference, candidate), pairs (pair_id, known: both texts not null), tokens (pair_id, side, pos, word, stem, root), arrays of stems, and tables.

    Tokens and arrays are dealt by pair; they and the metrics on them follow one shuffle of whole texts.
    """

    texts: DataFrame
    total: int
    pairs: DataFrame
    tokens: DataFrame
    arrays: DataFrame
    vectors: DataFrame | Callable[[DataFrame], DataFrame] | None
    pad: Sequence[float] | None
    synonyms: DataFrame | None

    @cached_property
    def vector_scores(self) -> DataFrame:
        """(pair_id, embsim, simcse, bert), one row a pair_id: the cosines of both sides' mean vectors over ``max(words, length)`` positions, and the word matching; written."""
        vectors = self.vectors
        if callable(vectors):
            words = F.explode(F.concat(*(F.coalesce(L.rouge_tokens(c), F.array().cast("array<string>")) for c in ("candidate", "reference"))))
            vectors = vectors(self.texts.select(words.alias("token")))
        joined = [F.array_join(L.rouge_tokens(c), " ").alias(to) for c, to in (("candidate", "a"), ("reference", "b"))]
        x = S.pair_bags(self.texts.select("pair_id", *joined), S.vectors_to_arrays(vectors), self.total)
        for name, length, measure in (("embsim", 1, S.emb_sim), ("simcse", LENGTH, S.sim_diag)):
            x = measure(S.pair_embeddings(x, self.pad, length), "a", "b", name)
        return cut_lineage(x.select("pair_id", "embsim", "simcse", F.col("bert_f").alias("bert")))


def prepare(long: DataFrame, vectors: Callable[[DataFrame], DataFrame] | DataFrame | None = None, pad: Sequence[float] | None = None,
            synonyms: DataFrame | None = None) -> Scored:
    """Cut and stem both sides of ``long(pair_id, reference, candidate)``, read from where they were written.

    ``vectors``: long (token, j, v), or a function that makes it from the words (token).
    """
    sides = ("candidate", "reference")
    total = L.n_tokens(long, sides)
    tokens = L.dealt_tokens(long, "pair_id", sides, total)
    known = F.col("reference").isNotNull() & F.col("candidate").isNotNull()
    pairs = long.select("pair_id", known.alias("known"))
    ordered = F.array_sort(F.collect_list(F.struct("side", "pos", "stem")))
    both = tokens.groupBy("pair_id").agg(ordered.alias("t"))
    half = lambda side: F.transform(F.filter("t", lambda x: x["side"] == side), lambda x: x["stem"])
    none = F.array().cast("array<string>")
    arrays = pairs.join(both, "pair_id", "left").select("pair_id", *(F.when(F.col("known"), F.coalesce(half(i), none)).alias(c) for i, c in ((0, "g"), (1, "r"))))
    return Scored(long.select("pair_id", *sides), total, pairs, tokens, arrays, vectors, pad, synonyms)


def _bert(x: Scored) -> DataFrame:
    return x.pairs.join(x.vector_scores, "pair_id", "left").select("pair_id", F.coalesce("bert", F.lit(0.0)).alias("score"))


def _meteor(x: Scored) -> DataFrame:
    found = L.meteor_of_tokens(x.tokens, x.synonyms, dealt=True)
    return x.pairs.join(found, "pair_id", "left").select("pair_id", F.coalesce("meteor", F.lit(0.0)).alias("score"))


#: Metric name -> (pair_id, score); the names are those of the score tables.
METRICS: dict[str, Callable[[Scored], DataFrame]] = {
    "r1f1": lambda x: L.rouge_n(x.arrays, 1).select("pair_id", F.col("r1f1").alias("score")),
    "r2f1": lambda x: L.rouge_n(x.arrays, 2).select("pair_id", F.col("r2f1").alias("score")),
    "rLf1": lambda x: L.rouge_l(x.arrays).select("pair_id", F.col("rLf1").alias("score")),
    "meteor": _meteor,
    "embsim": lambda x: x.vector_scores.select("pair_id", F.col("embsim").alias("score")),
    "bert": _bert,
    "simcse": lambda x: x.vector_scores.select("pair_id", F.col("simcse").alias("score")),
}
LEARNED = "learned"


def fit_linear(features: DataFrame, cols: Sequence[str], label_col: str = "label") -> list[float]:
    """Least squares of ``label_col`` on an intercept and ``cols``: [intercept, weight of each column].

    X'X and X'y are sums of products, one aggregate with map-side partial sums; the solve is on that
    (columns + 1)-square matrix (smallest-norm solution if columns are dependent). Rows with a null
    feature or label take no part.
    """
    known = features.select(*(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols, 1)), F.col(label_col).cast("double").alias("y")).dropna().withColumn("x0", F.lit(1.0))
    n = len(cols) + 1
    sums = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i in range(n) for j in range(i, n)] + [F.sum(F.col(f"x{i}") * F.col("y")) for i in range(n)]
    got = [float(v) if v is not None else 0.0 for v in known.agg(*sums).first()]
    xx = np.zeros((n, n))
    xx[np.triu_indices(n)] = got[: -n]
    xx = np.triu(xx) + np.triu(xx, 1).T
    return np.linalg.lstsq(xx, np.array(got[-n:]), rcond=1e-13)[0].tolist()


def predict_linear(features: DataFrame, cols: Sequence[str], weights: Sequence[float], out: str = LEARNED) -> DataFrame:
    """Add ``out``: intercept and weighted columns; null where a feature is null."""
    score = F.lit(float(weights[0]))
    for c, w in zip(cols, weights[1:]):
        score = score + F.lit(float(w)) * F.col(c)
    return features.withColumn(out, score)


def score_pairs(long: DataFrame, metrics: Sequence[str] | None = None, vectors=None, pad: Sequence[float] | None = None, synonyms: DataFrame | None = None,
                label_col: str = "label", weights: Sequence[float] | None = None) -> DataFrame:
    """Scores of ``long(pair_id long, reference, candidate, label, ...)``: one row per pair and metric (pair_id, metric, score).

    ``learned`` is fitted on all other named metrics against ``label_col``, or uses given ``weights``. A pair with
    a null text has null scores; one without words scores 0 on the lexical metrics. ``pair_id`` is unique. ``long`` is
    read by several jobs: it should come from written data.
    """
    names = list(metrics or [*METRICS, LEARNED])
    unknown = set(names) - {*METRICS, LEARNED}
    if unknown:
        raise ValueError(f"unknown metrics: {sorted(unknown)}")
    x = prepare(long, vectors, pad, synonyms)
    out = None
    for name in names:
        if name == LEARNED:
            continue
        one = METRICS[name](x).join(x.pairs, "pair_id").select("pair_id", F.lit(name).alias("metric"), F.when(F.col("known"), F.col("score")).alias("score"))
        out = one if out is None else out.unionByName(one)
    if LEARNED not in names:
        return out
    cols = [n for n in names if n != LEARNED]
    out = cut_lineage(out)  # read by the fit, the prediction and the result
    wide = out.groupBy("pair_id").pivot("metric", cols).agg(F.first("score"))
    if weights is None:
        weights = fit_linear(wide.join(long.select("pair_id", F.col(label_col).alias("_label")), "pair_id"), cols, "_label")
    learned = predict_linear(wide, cols, weights).select("pair_id", F.lit(LEARNED).alias("metric"), F.col(LEARNED).alias("score"))
    return out.unionByName(learned)


def score_all(df: DataFrame, metrics: Sequence[str] | None = None, kind: str = "triplets", key_col: str = "row_id", label_col: str = "label", **tables) -> DataFrame:
    """All ``metrics`` of triplets (reference with both answers) or pairs (second text with the first).

    ``kind='triplets'``: ``df(key_col, premise, correct_answer, incorrect_answer)``; labels 1 and 0.
    ``kind='pairs'``: ``df(key_col, text1, text2, label_col)``. ``tables``: vectors, pad, synonyms, weights of :func:`score_pairs`.
    Result: pair_id, row_id, label, metric, score.
    """
    if kind == "triplets":
        df = cut_lineage(df.select(key_col, *TRIPLET_COLS))  # three texts a row; the two pairs are made of them wherever they are read
        long = S.unpivot_triplets(df, key_col).select((F.col(key_col) * 2 + F.col("label")).alias("pair_id"), F.col(key_col).alias("row_id"), "label", "reference", "candidate")
    elif kind == "pairs":
        long = cut_lineage(df.select(key_col, label_col, "text1", "text2")).select(F.col(key_col).alias("pair_id"), F.col(key_col).alias("row_id"), F.col(label_col).alias("label"), F.col("text1").alias("reference"), F.col("text2").alias("candidate"))
    else:
        raise ValueError("kind is 'triplets' or 'pairs'")
    return score_pairs(long, metrics, **tables).join(long.select("pair_id", "row_id", "label"), "pair_id").select("pair_id", "row_id", "label", "metric", "score")

"""Token attribution of a cosine similarity.

Integrated gradients are taken with respect to the token vectors. The
sentence embedding is the mean of the vectors at ``P = max(n, L)`` positions,
so along the straight path from the baseline sequence to the input the
embedding moves linearly, ``E(a) = E(x') + a (E(x) - E(x'))``, and the
attribution of position ``p`` is ``(v_p - b_p) . G / P`` with ``G`` the mean
path gradient of ``cos(E, e_target)``. Spark deals the pairs into bounded slices
and joins each slice's texts and distinct tokens to it; sums, ``G`` and the
dot products of a slice are numpy over its arrays. Completeness: the attributions sum to ``cos(x) - cos(x')`` up
to the quadrature error of the midpoint rule.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

N_STEPS = 50
# Tokens of the inputs and targets of a slice of pairs, and of the smallest slices a small input is cut into.
SLICE_TOKENS, SMALL_SLICE = 1 << 18, 1 << 15
BASELINE_TOKEN = "<unk>"  # stands for token id 0 of the vocabulary
# The four attribution directions and the label each expects.
DIRECTIONS = [("ref_corr", "premise", "correct_answer", 1), ("corr_ref", "correct_answer", "premise", 1),
              ("ref_incorr", "premise", "incorrect_answer", 0), ("incorr_ref", "incorrect_answer", "premise", 0)]


def four_directions(triplets: DataFrame, key_col: str = "row_id") -> DataFrame:
    """I4: every triplet -> 4 (input, target) rows with the expected label."""
    arr = F.array(*[F.struct(F.lit(d).alias("direction"), F.col(i).alias("input_text"), F.col(t).alias("target_text"),
                             F.lit(lab).alias("expected")) for d, i, t, lab in DIRECTIONS])
    return triplets.select(key_col, F.explode(arr).alias("_d")).select(key_col, "_d.*")


def choose_baseline(sim: Column, cut: float = 0.0) -> Column:
    """I2: 'zero' (token id 0 everywhere) when similarity > cut, else 'reference' (the target's tokens)."""
    return F.when(sim > cut, F.lit("zero")).otherwise(F.lit("reference"))


def path_gradients(ex: np.ndarray, eb: np.ndarray, et: np.ndarray, n_steps: int = N_STEPS) -> np.ndarray:
    """Per row: mean over midpoints a_k = (k + 1/2) / n of d cos(e, et) / de at e = eb + a_k (ex - eb)."""
    nt = np.linalg.norm(et, axis=1, keepdims=True)
    g = np.zeros_like(ex)
    for k in range(n_steps):
        e = eb + (k + 0.5) / n_steps * (ex - eb)
        ne = np.linalg.norm(e, axis=1, keepdims=True)
        some = (ne > 0) & (nt > 0)
        ne, n = np.where(some, ne, 1.0), np.where(some, nt, 1.0)
        c = (e * et).sum(axis=1, keepdims=True) / (ne * n)
        g += np.where(some, et / (ne * n) - c * e / (ne * ne), 0.0)
    return g / n_steps


def path_gradient(ex: np.ndarray, eb: np.ndarray, et: np.ndarray, n_steps: int = N_STEPS) -> np.ndarray:
    """:func:`path_gradients` of one row."""
    return path_gradients(ex[None], eb[None], et[None], n_steps)[0]


def _cosines(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(u, axis=1) * np.linalg.norm(v, axis=1)
    return np.where(n > 0, (u * v).sum(axis=1) / np.where(n > 0, n, 1.0), 0.0)


def _sums(code: np.ndarray, values: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """Rows ``values[place]`` summed by code 0..n-1, a dimension at a time."""
    return np.stack([np.bincount(code, v[place], n) for v in values.T], axis=1) if n else np.zeros((0, values.shape[1]))


def _tokens(rows: pa.Table) -> tuple[pa.Table, pd.DataFrame, pa.Array]:
    """The pairs of a slice, the tokens of its texts (text: number of the text, pos, at) and their strings."""
    is_pair = rows.column("pair")
    texts = rows.filter(pc.invert(is_pair))
    pos, token = (texts.column(c).combine_chunks() for c in ("pos", "tokens"))
    count = pc.list_value_length(pos).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = token.flatten()
    t = pd.DataFrame({"text": np.repeat(np.arange(len(count)), count), "pos": pos.flatten().to_numpy(zero_copy_only=False), "at": np.arange(len(flat))})
    return rows.filter(is_pair).append_column("in", _code(rows, is_pair, "in_id", texts)).append_column("tgt", _code(rows, is_pair, "tgt_id", texts)), t, flat


def _code(rows: pa.Table, is_pair: pa.ChunkedArray, name: str, texts: pa.Table) -> pa.Array:
    """Number of each pair's text among the slice's texts, -1 for a null one or one without tokens."""
    found = pc.index_in(rows.filter(is_pair).column(name).combine_chunks(), value_set=texts.column("text_id").combine_chunks(), skip_nulls=True)
    return found.fill_null(-1)


def _attribute(rows: pa.Table, told: pa.Table, pad: np.ndarray, base: np.ndarray, length: int, n_steps: int):
    """Attributions of the pairs of a slice.

    Returns the pairs, per pair (cos_x, cos_base, total, attribution of the pads)
    and the token rows: number of a pair, position, place of the token, attribution, and
    the strings of the tokens. Rows of one pair_id share their sums, as one pair of several inputs.
    """
    pairs, tok, strings = _tokens(rows)
    m, d = told.num_rows, len(pad)
    values = np.concatenate([told.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(m, d), base[None], pad[None]])
    words = told.column("word").combine_chunks()
    names = pc.unique(words)
    tok["w"] = pc.index_in(strings, value_set=names, skip_nulls=True).fill_null(-1).to_numpy(zero_copy_only=False)
    vec = pd.DataFrame({"w": pc.index_in(words, value_set=names).to_numpy(zero_copy_only=False), "v": np.arange(m)})
    known = tok[tok.w >= 0].merge(vec, on="w")
    placed = tok[tok.pos.notna()]
    n_of = np.append(np.bincount(tok.text, minlength=rows.num_rows), 0)  # the last one: no text

    ids = pairs.column("pair_id").combine_chunks().dictionary_encode()
    pid, k = ids.indices.fill_null(len(ids.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64), len(ids.dictionary) + 1
    a, b = (pairs.column(c).to_numpy().astype(np.int64) for c in ("in", "tgt"))
    kind = pairs.column("baseline")
    zero, ref = (pc.fill_null(pc.equal(kind, x), False).to_numpy() for x in ("zero", "reference"))
    n_in, n_tgt = n_of[a], n_of[b]
    total_pos = np.maximum(n_in, length)
    p = pd.DataFrame({"row": np.arange(len(pid)), "pid": pid, "text": a, "tgt": b, "zero": zero, "n_in": n_in, "P": total_pos})

    # input token positions with the baseline token at the same position
    r = p[p.pid < k - 1].merge(known[["text", "pos", "at", "v"]], on="text")
    r = r.merge(placed[["text", "pos", "w"]].rename(columns={"text": "tgt", "w": "w_tgt"}), on=["tgt", "pos"], how="left")
    r["w"] = r.w_tgt.fillna(-1).astype(np.int64)
    r = r.merge(vec.rename(columns={"v": "v_tgt"}), on="w", how="left")
    v = r.v.to_numpy()
    v_base = np.where(r.zero.to_numpy(), m, r.v_tgt.fillna(m + 1).to_numpy()).astype(np.int64)
    sx, sb = _sums(r.pid.to_numpy(), values, v, k), _sums(r.pid.to_numpy(), values, v_base, k)
    # reference baseline: target tokens that sit on the input's pad positions (n_in <= pos < P)
    x = p[ref & (pid < k - 1)].merge(known[["text", "pos", "v"]].rename(columns={"text": "tgt"}), on="tgt")
    x = x[(x.pos >= x.n_in) & (x.pos < x.P)]
    s_extra, c_extra = _sums(x.pid.to_numpy(), values, x.v.to_numpy(), k), np.bincount(x.pid, minlength=k)
    # target embedding: its own tokens and pads up to L
    st = np.concatenate([_sums(known.text.to_numpy(), values, known.v.to_numpy(), rows.num_rows), np.zeros((1, d))])

    n_pad = (total_pos - n_in).astype(np.float64)[:, None]
    sb_pad = np.where(zero[:, None], base * n_pad, s_extra[pid] + pad * (n_pad - c_extra[pid][:, None]))
    pt = np.maximum(n_tgt, length).astype(np.float64)[:, None]
    e_x, e_b = (sx[pid] + pad * n_pad) / total_pos[:, None], (sb[pid] + sb_pad) / total_pos[:, None]
    e_t = (st[b] + pad * (pt - n_tgt[:, None])) / pt
    g = path_gradients(e_x, e_b, e_t, n_steps)
    pad_attr = ((pad * n_pad - sb_pad) * g).sum(axis=1) / total_pos

    r = pd.DataFrame({"pid": r.pid, "pos": r.pos, "at": r["at"], "P": r.P, "v": v, "v_base": v_base}).merge(p[["pid", "row"]], on="pid")
    attr, of, v, v_base = np.zeros(len(r)), r.row.to_numpy(), r.v.to_numpy(), r.v_base.to_numpy()
    for j in range(d):
        attr += (values[v, j] - values[v_base, j]) * g[of, j]
    attr /= r.P.to_numpy()
    total = np.bincount(r.pid, attr, k) + np.bincount(pid, pad_attr, k)
    return pairs, (_cosines(e_x, e_t), _cosines(e_b, e_t), total[pid], pad_attr), (of, r.pos.to_numpy(), r["at"].to_numpy(), attr), strings


def token_attribution(
    pairs: DataFrame,
    tokens: DataFrame,
    vectors: DataFrame,
    length: int = 512,
    pad_token: str = "<pad>",
    base_token: str = BASELINE_TOKEN,
    n_steps: int = N_STEPS,
    near: str = "pair_id",
) -> tuple[DataFrame, DataFrame]:
    """Per-token attributions (plus one aggregated pad row) and per-pair totals.

    ``pairs``: (pair_id, in_id, tgt_id, baseline) with baseline 'zero' | 'reference';
    ``tokens``: (text_id, pos, token); ``vectors``: (token, vec array<double>)
    including the pad and baseline tokens. ``pairs`` is read more than once.

    Pairs are dealt into slices of about SLICE_TOKENS tokens by their column ``near``
    (rows of one pair_id share it; pairs that share texts should). A slice gets each of its texts
    once, packed, and asks for each of its distinct tokens once: neither a row nor a
    vector per pair and token is shuffled.

    Only real token positions become rows. The ``P - n`` pad positions of the
    input all hold the pad vector, so their attribution is one closed-form term
    ``(P - n) v_pad - sum of the baseline over those positions``. A pair whose input
    has no token has that row alone.
    Returns (positions: pair_id, pos, token, attr [pos -1 = pads];
    totals: pair_id, cos_x, cos_base, total, delta).
    """
    vec = vectors.select("token", "vec")
    consts = {r["token"]: r["vec"] for r in vec.where(F.col("token").isin(pad_token, base_token)).collect()}  # two d-vectors
    pad, base = (np.array(consts[t], np.float64) for t in (pad_token, base_token))

    uses = pairs.select(F.explode(F.array("in_id", "tgt_id")).alias("text_id")).groupBy("text_id").agg(F.count(F.lit(1)).alias("k"))
    sizes = tokens.groupBy("text_id").agg(F.count(F.lit(1)).alias("n"))
    total = uses.join(sizes, "text_id").agg(F.coalesce(F.sum(F.col("k") * F.col("n")), F.lit(0))).first()[0]
    slices = max(1, -(-total // SLICE_TOKENS), min(pairs.sparkSession.sparkContext.defaultParallelism, total // SMALL_SLICE))

    p = pairs.withColumn("slice", F.pmod(F.xxhash64(near), F.lit(slices)))
    asked = p.select("slice", F.explode(F.array("in_id", "tgt_id")).alias("text_id")).distinct()
    packed = tokens.groupBy("text_id").agg(F.collect_list(F.struct("pos", "token")).alias("t"))
    x = asked.join(packed, "text_id").select("slice", F.lit(False).alias("pair"), "text_id", F.col("t.pos").alias("pos"), F.col("t.token").alias("tokens"))
    x = x.unionByName(p.select("slice", F.lit(True).alias("pair"), "pair_id", "in_id", "tgt_id", "baseline"), allowMissingColumns=True)
    x = x.repartition(min(slices, 10_000), "slice")

    def ask(rows: pa.Table) -> pa.Table:
        words = pc.unique(rows.column("tokens").combine_chunks().flatten()).drop_null()
        return pa.table({"asker": pa.array(np.full(len(words), rows.column("slice")[0].as_py()), pa.int64()), "word": words})

    told = x.groupBy("slice").applyInArrow(ask, "asker long, word string").join(vec, F.col("word") == vec["token"]).drop("token")
    key, pos = (df.schema[c].dataType.simpleString() for df, c in ((pairs, "pair_id"), (tokens, "pos")))
    pos_type = to_arrow_type(tokens.schema["pos"].dataType)

    def positions(_, rows: pa.Table, told: pa.Table) -> pa.Table:
        pairs, (_, _, _, pads), (of, pos, at, attr), strings = _attribute(rows, told, pad, base, length, n_steps)
        ids, n = pairs.column("pair_id").combine_chunks(), len(pads)
        return pa.table({
            "pair_id": ids.take(pa.array(np.concatenate([of, np.arange(n)]))),
            "pos": pa.array(np.concatenate([pos, np.full(n, -1)]), pos_type, from_pandas=True, safe=False),
            "token": pa.concat_arrays([strings.take(pa.array(at)), pa.array([pad_token] * n, strings.type)]),
            "attr": np.concatenate([attr, pads])})

    def sums(_, rows: pa.Table, told: pa.Table) -> pa.Table:
        pairs, (cos_x, cos_base, total, _), _, _ = _attribute(rows, told, pad, base, length, n_steps)
        out = pa.table({"pair_id": pairs.column("pair_id"), "total": total, "cos_x": cos_x, "cos_base": cos_base})
        return out.filter(pc.is_valid(out.column("pair_id")))

    both = lambda: x.groupBy("slice").cogroup(told.groupBy("asker"))
    att = both().applyInArrow(positions, f"pair_id {key}, pos {pos}, token string, attr double")
    totals = both().applyInArrow(sums, f"pair_id {key}, total double, cos_x double, cos_base double")
    return att, totals.withColumn("delta", F.col("total") - (F.col("cos_x") - F.col("cos_base")))


def normalise_importance(weights: DataFrame, key_cols: Sequence[str], weight_col: str = "attr") -> DataFrame:
    """Token weights divided by the pair's L2 norm when it is > 0 (window over one pair's tokens)."""
    k = list(key_cols)
    norm = F.sqrt(F.sum(F.col(weight_col) * F.col(weight_col)).over(Window.partitionBy(*k)))
    return weights.withColumn("weight", F.when(norm > 0, F.col(weight_col) / norm).otherwise(F.col(weight_col)))


def display_scores(totals: DataFrame, sim_col: str, total_col: str, cut: float = 0.0) -> DataFrame:
    """Similarity and total attribution x100 rounded to 2 dp; predicted class by the same cut."""
    return totals.withColumn("sim_x100", F.round(F.col(sim_col) * 100, 2)).withColumn(
        "attr_x100", F.round(F.col(total_col) * 100, 2)).withColumn("predicted", (F.col(sim_col) > cut).cast("int"))


def attribution_summary(per_pair: DataFrame, metric_col: str = "metric") -> DataFrame:
    """One record per metric with the mean similarity and attribution of each direction (x100, 2 dp)."""
    dirs = [d for d, *_ in DIRECTIONS]
    agg = per_pair.groupBy(metric_col).pivot("direction", dirs).agg(
        F.round(F.avg("sim") * 100, 2).alias("sim"), F.round(F.avg("attr") * 100, 2).alias("attr"))
    return agg

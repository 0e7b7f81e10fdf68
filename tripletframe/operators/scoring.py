"""Pair scoring with vector metrics.

The learned encoder of the reference is a bag of tokens: no layer mixes
positions, so a text's embedding is the mean over ``L`` positions of a fixed
per-token vector ``g(token)`` (pads included). Scoring a corpus therefore is

    tokens -> slices of texts -> each slice's distinct tokens join their vectors -> sums / L

with no model call per row. The vector table has a row a token of the vocabulary,
which grows with the data: it is joined by shuffles, never broadcast whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripletframe.functions.vectors import cosine

# Tokens of a slice of texts whose vectors are summed at once, and of the smallest slices a small input is cut into.
SLICE_TOKENS, SMALL_SLICE = 1 << 21, 1 << 16
# Tokens of a slice of pairs that are matched at once (of a smaller one, SMALL_SLICE), and keys of a slice held in full.
PAIR_SLICE_TOKENS, SLICE_KEYS = 1 << 23, 1 << 11
# Largest vector table (bytes) that E13 ships to every executor; above it a shuffle join is used.
BROADCAST_LIMIT_BYTES = 256 * 1024 * 1024
PAD_TOKEN = "<pad>"


def vectors_to_arrays(long_vectors: DataFrame, key: str = "token") -> DataFrame:
    """(key, j, v) -> (key, vec array<double>) ordered by j (bounded by the dimension)."""
    return long_vectors.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda s: s["v"].cast("double")).alias("vec")
    )


# ------------------------------------------------------------------ E2

def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of tokens of one key as one row: their bytes and sizes (-1: null); a run of texts as its number of rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        code = batch.column("key").dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        mark, token = batch.column("mark").to_numpy(zero_copy_only=False), batch.column("token").cast(pa.large_binary())
        size = pc.fill_null(pc.binary_length(token), -1).to_numpy(zero_copy_only=False).astype("<i4")
        data = b"".join(x for x in token.drop_null().to_pylist())
        end = np.cumsum(np.maximum(size, 0), dtype=np.int64)
        first = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (mark[1:] != mark[:-1])))
        runs = list(zip(first.tolist(), [*first[1:].tolist(), len(code)]))
        start = np.append(0, end)
        yield pa.RecordBatch.from_arrays([
            batch.column("slice").take(pa.array(first)), batch.column("key").take(pa.array(first)), pa.array([y - x if mark[x] else 0 for x, y in runs], pa.int64()),
            pa.array([b"" if mark[x] else data[start[x] : start[y]] for x, y in runs], pa.binary()), pa.array([b"" if mark[x] else size[x:y].tobytes() for x, y in runs], pa.binary())],
            names=["slice", "key", "rows", "words", "sizes"])


def _unpacked(rows: pa.Table) -> tuple[pa.Array, np.ndarray]:
    """The tokens of packed runs, and how many each run has."""
    sizes = rows.column("sizes").to_pylist()
    size = np.frombuffer(b"".join(sizes), "<i4")
    data = b"".join(rows.column("words").to_pylist())
    ends = np.append(0, np.cumsum(np.maximum(size, 0), dtype=np.int64))
    known = pa.py_buffer(np.packbits(size >= 0, bitorder="little").tobytes())
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(ends.tobytes()), pa.py_buffer(data), known), np.array([len(x) // 4 for x in sizes], np.int64)


def _bag_sums(tokens: DataFrame, vectors: DataFrame, key_col: str, texts: DataFrame | None) -> DataFrame:
    """Sums of the token vectors of every key: (key_col, n, known, rows, js, s).

    ``vectors``: (token, js array<int>, vec array<double>), js[i] the dimension of vec[i]; without a column js all
    vectors are whole. ``n`` counts the key's tokens, ``known`` those with a vector, ``rows`` its rows in ``texts``.

    Keys are dealt into slices of about SLICE_TOKENS tokens, a run of a key's tokens packed into one row. A slice asks
    for each of its distinct tokens once, so the vectors that travel are slices x distinct tokens, not
    texts x distinct tokens, and no table goes through the driver.
    """
    spark = tokens.sparkSession
    dense = "js" not in vectors.columns
    x = tokens.select(F.col(key_col).alias("key"), "token", F.lit(False).alias("mark"))
    if texts is not None:  # a row of its own for every text: those without tokens are found in their slice, not by a join
        x = x.unionByName(texts.select(F.col(key_col).alias("key"), F.lit(None).cast("string").alias("token"), F.lit(True).alias("mark")))
    kind = x.schema["key"].dataType.simpleString()
    total = x.count()
    slices = max(1, -(-total // SLICE_TOKENS), min(spark.sparkContext.defaultParallelism, total // SMALL_SLICE))
    x = x.withColumn("slice", F.pmod(F.xxhash64("key"), F.lit(slices))).mapInArrow(_packed, f"slice long, key {kind}, rows long, words binary, sizes binary")
    x = x.repartition(min(slices, 10_000), "slice")

    def ask(rows: pa.Table) -> pa.Table:
        words = pc.unique(_unpacked(rows)[0]).drop_null().cast(pa.string())
        return pa.table({"asker": pa.array(np.full(len(words), rows.column("slice")[0].as_py()), pa.int64()), "word": words})

    told = x.groupBy("slice").applyInArrow(ask, "asker long, word string").join(vectors.where("vec is not null"), F.col("word") == vectors["token"]).drop("token")

    def add(_, rows: pa.Table, told: pa.Table) -> pa.Table:
        keys = rows.column("key").combine_chunks().dictionary_encode(null_encoding="encode")
        run, k = keys.indices.to_numpy(zero_copy_only=False), len(keys.dictionary)
        token, count = _unpacked(rows)
        code = np.repeat(run, count)
        place = pc.index_in(token, value_set=told.column("word").combine_chunks().cast(pa.large_string())).fill_null(-1).to_numpy(zero_copy_only=False)
        hit = place >= 0
        c, place = code[hit], place[hit]
        values = told.column("vec").combine_chunks()
        size = pc.list_value_length(values).to_numpy(zero_copy_only=False)
        of, values = np.repeat(np.arange(len(size)), size), values.flatten().to_numpy(zero_copy_only=False)
        j = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) if dense else told.column("js").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        js = np.unique(j)
        sums, there = np.zeros((k, len(js))), np.zeros((k, len(js)), bool)
        for i, of_j in enumerate(js):
            one, has, at = np.zeros(len(size)), np.zeros(len(size), bool), j == of_j
            np.add.at(one, of[at], values[at])
            has[of[at]] = True
            sums[:, i] = np.bincount(c, one[place], k)
            there[:, i] = np.bincount(c, has[place], k) > 0
        ends = np.append(0, np.cumsum(there.sum(axis=1))).astype(np.int32)
        list_of = lambda v: pa.ListArray.from_arrays(pa.array(ends), pa.array(v))
        own = rows.column("key").combine_chunks().take(pa.array(np.unique(run, return_index=True)[1]))
        texts_of = np.bincount(run, rows.column("rows").to_numpy(), k).astype(np.int64)
        return pa.table({key_col: own, "n": np.bincount(code, minlength=k), "known": np.bincount(c, minlength=k), "rows": texts_of,
                         "js": list_of(np.broadcast_to(js.astype(np.int32), there.shape)[there]), "s": list_of(sums[there])})

    return x.groupBy("slice").cogroup(told.groupBy("asker")).applyInArrow(add, f"`{key_col}` {kind}, n long, known long, rows long, js array<int>, s array<double>")


def embed_texts(
    tokens: DataFrame,
    vectors: DataFrame,
    key_col: str = "row_id",
    length: int = 512,
    pad_token: str = PAD_TOKEN,
    pad_vector: DataFrame | None = None,
    texts: DataFrame | None = None,
) -> DataFrame:
    """Mean of token vectors over max(n, length) positions, pads included.

    ``tokens``: (key, pos, token) of whole texts; ``vectors``: long (token, j, v).
    ``embed = (sum_tok k * g(tok) + max(length - n, 0) * g(pad)) / max(n, length)``;
    for n <= length this is the padded mean of the reference; longer texts are
    embedded whole rather than cut at ``length``.
    ``texts`` names all keys: those without any token row get the pad vector
    with n = 0 (without it they are absent from the result).
    Returns (key, n, j, e) in long form, one row per key and dimension; the
    sums are those of :func:`_bag_sums`.
    """
    pairs = vectors.groupBy("token").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("p"))
    vec = pairs.select("token", F.transform("p", lambda s: s["j"].cast("int")).alias("js"), F.transform("p", lambda s: s["v"].cast("double")).alias("vec"))
    pad = pad_vector if pad_vector is not None else vectors.where(F.col("token") == pad_token)
    one = [(int(r["j"]), float(r["v"])) for r in pad.select("j", "v").collect()]  # one vector: d rows
    row = "array<struct<j:int,e:double>>"
    bare = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(v).alias("e")) for j, v in one]).cast(row)
    of_j = F.create_map(*[F.lit(x) for pair in one for x in pair]).cast("map<int,double>")

    def value(p):
        pads = F.greatest(F.lit(length) - F.col("n"), F.lit(0)) * F.coalesce(of_j[p["js"]], F.lit(0.0))
        return F.struct(p["js"].alias("j"), ((p["s"] + pads) / F.greatest(F.col("n"), F.lit(length)).cast("double")).alias("e"))

    x = _bag_sums(tokens, vec, key_col, texts)
    own = F.when(F.col("known") > 0, 1).otherwise(0)
    empty = F.when((F.col("n") == 0) | F.col(key_col).isNull(), F.col("rows")).otherwise(0)
    x = x.withColumn("_c", own + empty).where("_c > 0").withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_c"))))
    first = (F.col("known") > 0) & (F.col("_i") == 1)
    cells = F.when(first, F.transform(F.arrays_zip("js", "s"), value).cast(row)).otherwise(bare)
    x = x.select(key_col, F.when(first, F.col("n")).otherwise(0).cast("long").alias("_n"), cells.alias("_cells"))
    return x.select(key_col, F.col("_n").alias("n"), F.inline("_cells"))


def _padded_mean(s: str, known: str, pad: Column, length: int) -> Column:
    """Mean over ``max(known, length)`` positions, the missing ones pads, from the sums ``s`` of the ``known`` tokens' vectors."""
    n = F.col(known)
    return F.zip_with(s, pad, lambda a, p: (a + F.greatest(F.lit(length) - n, F.lit(0)) * p) / F.greatest(n, F.lit(length)))


def embed_texts_arrays(
    tokens: DataFrame,
    vector_arrays: DataFrame,
    pad_vec: Sequence[float],
    key_col: str = "row_id",
    length: int = 512,
    texts: DataFrame | None = None,
) -> DataFrame:
    """E2 in array layout for wide vectors (d in the hundreds).

    ``texts`` names all keys: those without any token row get the all-pad
    embedding with n = 0 (without it they are absent from the result).

    Same value as :func:`embed_texts`; only tokens with a vector count.
    ``vector_arrays``: (token, vec array<double>), a row a token; returns (key, n, emb).
    """
    x = _bag_sums(tokens, vector_arrays.select("token", "vec"), key_col, texts)
    pad = F.array(*[F.lit(float(v)) for v in pad_vec])
    e = _padded_mean("s", "known", pad, length)
    if texts is None:
        return x.where("known > 0").select(key_col, F.col("known").alias("n"), e.alias("emb"))
    found = (F.col("known") > 0) & F.col(key_col).isNotNull()
    x = x.where("rows > 0").withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return x.select(key_col, F.when(found, F.col("known")).otherwise(0).cast("long").alias("n"), F.when(found, e).otherwise(pad).alias("emb"))


def embeddings_as_arrays(emb_long: DataFrame, key_col: str = "row_id") -> DataFrame:
    """(key, j, e) -> (key, emb array<double>) (collect bounded by the dimension)."""
    return emb_long.groupBy(key_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("j", "e"))), lambda s: s["e"]).alias("emb")
    )


# ------------------------------------------------------------------ E5, E6, E12, E15

def triplet_score(df: DataFrame, ref: str = "ref", pos: str = "pos", neg: str = "neg", margin: float = 1.0) -> DataFrame:
    """E5: pos_sim, neg_sim, difference and hinge loss max(0, margin + neg - pos) per triplet."""
    x = df.withColumn("pos_sim", cosine(ref, pos)).withColumn("neg_sim", cosine(ref, neg))
    return x.withColumn("difference", F.col("pos_sim") - F.col("neg_sim")).withColumn(
        "loss", F.greatest(F.lit(0.0), F.lit(margin) + F.col("neg_sim") - F.col("pos_sim"))
    )


def pair_score(df: DataFrame, a: str, b: str, out: str = "score") -> DataFrame:
    """Cosine of two embedding arrays per row."""
    return df.withColumn(out, cosine(a, b))


def emb_sim(df: DataFrame, a: str, b: str, out: str = "embsim", eps: float = 1e-8) -> DataFrame:
    """Cosine with eps added to the denominator (sentence-vector metric)."""
    return df.withColumn(out, cosine(a, b, eps=eps, mode="add"))


def sim_diag(df: DataFrame, a: str, b: str, out: str = "simcse") -> DataFrame:
    """The diagonal of the N x M similarity matrix = row-wise cosine (no N x M product)."""
    return df.withColumn(out, cosine(a, b, mode="zero"))


# ------------------------------------------------------------------ E13

_BS_SCHEMA = T.StructType(
    [T.StructField("bert_p", T.DoubleType()), T.StructField("bert_r", T.DoubleType()), T.StructField("bert_f", T.DoubleType())]
)


# Similarities of one pair held at once in E13.
MATCH_CELLS = 1 << 22


def _greedy_match(ca, wa, cb, wb):
    if ca is None or cb is None:
        return 0.0, 0.0, 0.0
    a = np.asarray(list(ca), dtype=np.float64).reshape(len(ca), -1)
    b = np.asarray(list(cb), dtype=np.float64).reshape(len(cb), -1)
    wa = np.asarray(wa, dtype=np.float64)
    wb = np.asarray(wb, dtype=np.float64)
    na = np.linalg.norm(a, axis=1, keepdims=True)
    nb = np.linalg.norm(b, axis=1, keepdims=True)
    a = np.divide(a, na, out=np.zeros_like(a), where=na > 0)
    b = np.divide(b, nb, out=np.zeros_like(b), where=nb > 0)
    return _prf_of_matches(a, wa, b, wb)


def _prf_of_matches(a, wa, b, wb):
    """Weighted best-match means of unit vectors, a block of rows of ``a`` at a time."""
    rows, cols = np.empty(len(a)), np.full(len(b), -np.inf)
    step = max(1, MATCH_CELLS // len(b))
    for s in range(0, len(a), step):
        sim = a[s : s + step] @ b.T
        rows[s : s + step] = sim.max(axis=1)
        np.maximum(cols, sim.max(axis=0), out=cols)
    p, r = float((rows * wa).sum() / wa.sum()), float((cols * wb).sum() / wb.sum())
    return p, r, 2 * p * r / (p + r) if p + r != 0 else 0.0


@F.pandas_udf(_BS_SCHEMA)
def _bertscore_udf(va: pd.Series, wa: pd.Series, vb: pd.Series, wb: pd.Series) -> pd.DataFrame:
    out = [_greedy_match(a, x, b, y) for a, x, b, y in zip(va, wa, vb, wb)]
    return pd.DataFrame(out, columns=["bert_p", "bert_r", "bert_f"])


def _bertscore_by_ids(pairs, counts, vec, d, pair_key, cand_key, ref_key):
    """Bags of (token id, count) per text; vectors gathered inside the UDF from a broadcast matrix."""
    spark = pairs.sparkSession
    rows = vec.select("token", "vec").collect()  # the model's table, bounded by the caller's size check
    tids = spark.createDataFrame([(r["token"], i) for i, r in enumerate(rows)], "token string, tid int")
    mat = np.asarray([r["vec"] for r in rows], dtype=np.float64).reshape(len(rows), d)
    norms = np.linalg.norm(mat, axis=1, keepdims=True)
    bm = spark.sparkContext.broadcast(np.divide(mat, norms, out=np.zeros_like(mat), where=norms > 0))

    @F.pandas_udf(_BS_SCHEMA)
    def score(ia: pd.Series, wa: pd.Series, ib: pd.Series, wb: pd.Series) -> pd.DataFrame:
        m = bm.value
        out = []
        for a, x, b, y in zip(ia, wa, ib, wb):
            if a is None or b is None:
                out.append((0.0, 0.0, 0.0))
                continue
            va, vb = m[np.asarray(a, dtype=np.int64)], m[np.asarray(b, dtype=np.int64)]
            out.append(_prf_of_matches(va, np.asarray(x, dtype=np.float64), vb, np.asarray(y, dtype=np.float64)))
        return pd.DataFrame(out, columns=["bert_p", "bert_r", "bert_f"])

    bag = counts.join(F.broadcast(tids), "token").groupBy("text_id").agg(
        F.array_sort(F.collect_list(F.struct("tid", "k"))).alias("bag"))
    bag = bag.select("text_id", F.transform("bag", lambda s: s["tid"]).alias("i"), F.transform("bag", lambda s: s["k"]).alias("w"))
    ca = bag.select(F.col("text_id").alias(cand_key), F.col("i").alias("ia"), F.col("w").alias("wa"))
    rb = bag.select(F.col("text_id").alias(ref_key), F.col("i").alias("ib"), F.col("w").alias("wb"))
    x = pairs.join(ca, cand_key, "left").join(rb, ref_key, "left")
    return x.withColumn("_bs", score("ia", "wa", "ib", "wb"))


def bertscore(
    pairs: DataFrame,
    tokens: DataFrame,
    vectors: DataFrame,
    pair_key: str = "pair_id",
    cand_key: str = "cand_id",
    ref_key: str = "ref_id",
    limit: int = BROADCAST_LIMIT_BYTES,
) -> DataFrame:
    """Greedy max-cosine token matching (precision, recall, F1; no idf, no rescaling).

    Each text is reduced to its distinct tokens with counts and the per-pair
    ``A @ B.T`` maximum runs vectorised in an Arrow UDF: no (token, token)
    rows are materialised. When the vector table fits the broadcast limit,
    texts travel as (token id, count) lists and the UDF gathers normalised
    vectors from a broadcast matrix (small rows for long texts and wide
    vectors); otherwise the vectors are joined in and travel with the bag.
    ``pairs``: (pair_key, cand_key, ref_key); ``tokens``: (text_id, token).
    A pair with a text without tokens scores 0.
    """
    vec = vectors_to_arrays(vectors).persist()
    counts = tokens.groupBy("text_id", "token").agg(F.count(F.lit(1)).alias("k"))
    first = vec.select("vec").first()
    d = len(first["vec"]) if first else 0
    if d and vec.count() * (8 * d + 48) <= limit:
        x = _bertscore_by_ids(pairs, counts, vec, d, pair_key, cand_key, ref_key)
        vec.unpersist()
        return x.select(*pairs.columns, "_bs.bert_p", "_bs.bert_r", "_bs.bert_f")
    bag = counts.join(vec, "token").groupBy("text_id").agg(
        F.array_sort(F.collect_list(F.struct("token", "k", "vec"))).alias("bag")
    )
    bag = bag.select("text_id", F.transform("bag", lambda s: s["vec"]).alias("v"), F.transform("bag", lambda s: s["k"]).alias("w"))
    ca = bag.select(F.col("text_id").alias(cand_key), F.col("v").alias("va"), F.col("w").alias("wa"))
    rb = bag.select(F.col("text_id").alias(ref_key), F.col("v").alias("vb"), F.col("w").alias("wb"))
    x = pairs.join(ca, cand_key, "left").join(rb, ref_key, "left")
    x = x.withColumn("_bs", _bertscore_udf("va", "wa", "vb", "wb"))
    return x.select(*pairs.columns, "_bs.bert_p", "_bs.bert_r", "_bs.bert_f")


# ------------------------------------------------------------------ E2 and E13 of pairs

def _sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one slice in a batch as one block of compressed bytes."""
    for batch in batches:
        slices = batch.column("slice").to_numpy()
        for s in np.unique(slices):
            rows = batch.select(["key", "a", "b"]).take(pa.array(np.flatnonzero(slices == s)))
            to = pa.BufferOutputStream()
            with pa.ipc.new_stream(to, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(rows)
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([to.getvalue().to_pybytes()], pa.binary())], names=["slice", "block"])


def _rows_of(blocks: pa.Table) -> pa.Table:
    return pa.concat_tables(pa.ipc.open_stream(b).read_all() for b in blocks.column("block").to_pylist())


def _words_of(texts: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """Words of texts joined by spaces, and how many each text has (a null or empty text: none)."""
    texts = texts.cast(pa.large_string()).combine_chunks()
    lists = pc.split_pattern(pc.if_else(pc.equal(texts, ""), pa.scalar(None, pa.large_string()), texts), " ")
    return lists.flatten(), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)


def _bags_of(of: np.ndarray, place: np.ndarray, vec: np.ndarray, size: np.ndarray, k: int):
    """Of each of ``k`` keys: its known tokens, the sums of their vectors, and its distinct tokens with counts (those of key i from start[i])."""
    hit = place >= 0
    of, place = of[hit], place[hit]
    sums = np.stack([np.bincount(of, vec[place, j], k) for j in range(vec.shape[1])], axis=1) if vec.shape[1] else np.zeros((k, 0))
    width = np.zeros(k, np.int64)
    np.maximum.at(width, of, size[place])
    cells, count = np.unique(of.astype(np.int64) * max(1, len(vec)) + place, return_counts=True)
    start = np.searchsorted(cells, np.arange(k + 1, dtype=np.int64) * max(1, len(vec)))
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(width)), pa.int32()), pa.array(sums[np.arange(vec.shape[1]) < width[:, None]], pa.float64()))
    return pa.array(np.bincount(of, minlength=k), pa.int64()), lists, cells % max(1, len(vec)), count.astype(np.float64), start


def pair_bags(pairs: DataFrame, vectors: DataFrame, total: int, key: str = "pair_id") -> DataFrame:
    """E2's sums and E13's matching of both texts of every pair: (key, known_a, sums_a, known_b, sums_b, bert_p, bert_r, bert_f).

    ``pairs``: (key long, a, b), words joined by spaces, ``total`` of them; ``vectors``: (token, vec). Rows of one key are
    put together, rows of a null key left out. Both metrics read one deal of the pairs: slices of about PAIR_SLICE_TOKENS
    tokens, of which each asks for the vector of each of its words once. Keys 2i and 2i + 1 share a slice: a text that
    both have is compressed away.
    """
    spark = pairs.sparkSession
    slices = max(1, -(-total // PAIR_SLICE_TOKENS), min(spark.sparkContext.defaultParallelism, total // SMALL_SLICE))
    x = pairs.where(F.col(key).isNotNull()).select(F.pmod(F.xxhash64(F.shiftright(key, 1)), F.lit(slices)).alias("slice"), F.col(key).cast("long").alias("key"), "a", "b")
    x = x.mapInArrow(_sides, "slice long, block binary").repartition(min(slices, 10_000), "slice")

    def ask(blocks: pa.Table) -> pa.Table:
        rows = _rows_of(blocks)
        words = pc.unique(pa.concat_arrays([_words_of(rows.column(c))[0] for c in "ab"])).cast(pa.string())
        return pa.table({"asker": pa.array(np.full(len(words), blocks.column("slice")[0].as_py()), pa.int64()), "word": words})

    told = x.groupBy("slice").applyInArrow(ask, "asker long, word string").join(vectors.where("vec is not null"), F.col("word") == vectors["token"]).drop("token")

    def match(_, blocks: pa.Table, told: pa.Table):
        rows = _rows_of(blocks)
        known, values = told.column("word").combine_chunks().cast(pa.large_string()), told.column("vec").combine_chunks()
        size = pc.list_value_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
        vec = np.zeros((len(size), int(size.max(initial=0))))
        vec[np.arange(vec.shape[1]) < size[:, None]] = values.flatten().to_numpy(zero_copy_only=False)
        norm = np.linalg.norm(vec, axis=1, keepdims=True)
        unit = np.divide(vec, norm, out=np.zeros_like(vec), where=norm > 0)
        found = []
        keys = rows.column("key").to_numpy()
        order = np.argsort(keys, kind="stable")
        own, first = np.unique(keys[order], return_index=True)
        for at in range(0, len(own), SLICE_KEYS):
            k = len(own[at : at + SLICE_KEYS])
            ends = np.append(first, len(keys))[at : at + k + 1]
            some, of_row = rows.take(pa.array(order[ends[0] : ends[-1]])), np.repeat(np.arange(k), np.diff(ends))
            sides = []
            for c in "ab":
                words, n = _words_of(some.column(c))
                place = pc.index_in(words, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
                sides.append(_bags_of(np.repeat(of_row, n), place, vec, size, k))
            (na, sa, wa, ca, ia), (nb, sb, wb, cb, ib) = sides
            prf = np.zeros((k, 3))
            for i in np.flatnonzero((np.diff(ia) > 0) & (np.diff(ib) > 0)):
                a, b = slice(ia[i], ia[i + 1]), slice(ib[i], ib[i + 1])
                prf[i] = _prf_of_matches(unit[wa[a]], ca[a], unit[wb[b]], cb[b])
            found.append(pa.table([pa.array(own[at : at + k], pa.int64()), na, sa, nb, sb, *map(pa.array, prf.T)], names=names))
        return pa.concat_tables(found)

    names = [key, "known_a", "sums_a", "known_b", "sums_b", "bert_p", "bert_r", "bert_f"]
    kinds = ["long", "long", "array<double>", "long", "array<double>", *["double"] * 3]
    return x.groupBy("slice").cogroup(told.groupBy("asker")).applyInArrow(match, ", ".join(f"`{n}` {t}" for n, t in zip(names, kinds)))


def pair_embeddings(bags: DataFrame, pad_vec: Sequence[float], length: int) -> DataFrame:
    """:func:`pair_bags` with the texts' E2 embeddings ``a`` and ``b`` over ``max(known, length)`` positions (the pad vector without known words)."""
    pad = F.array(*[F.lit(float(v)) for v in pad_vec])
    return bags.withColumns({c: F.when(F.col(f"known_{c}") > 0, _padded_mean(f"sums_{c}", f"known_{c}", pad, length)).otherwise(pad) for c in "ab"})


# ------------------------------------------------------------------ E17

def unpivot_triplets(df: DataFrame, key_col: str = "row_id", ref: str = "premise",
                     sides: Sequence[tuple[str, int]] = (("correct_answer", 1), ("incorrect_answer", 0))) -> DataFrame:
    """E17 step 1: triplet -> two (reference, candidate, label) rows, scored once in long form (``df`` is read once)."""
    both = F.array(*(F.struct(F.col(ref).alias("reference"), F.col(c).alias("candidate"), F.lit(lab).alias("label")) for c, lab in sides))
    return df.select(key_col, F.inline(both))

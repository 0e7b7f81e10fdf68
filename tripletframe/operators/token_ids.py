"""Ids of token lists by a vocabulary that grows with the data."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tokens of a slice of rows, and of the smallest slices a small input is cut into.
SLICE_TOKENS, SMALL_SLICE = 1 << 20, 1 << 16


def token_ids(lists: DataFrame, vocabulary: DataFrame, key_col: str = "row_id", total: int | None = None) -> DataFrame:
    """``lists(key, tokens)``, ``vocabulary(token, id int)`` -> (key_col, ids array<int>) in the order of the tokens.

    Rows are dealt into slices of about SLICE_TOKENS tokens by their key; a slice asks for
    each of its distinct tokens once, so neither the tokens nor the ids of a text
    are shuffled, sorted or collected one by one. Tokens outside the vocabulary are left out. Rows of
    one key (null too) are one result: their tokens by place, then by id. Keys without any have none.
    ``total``: about how many tokens there are, if known without making the lists; it only sets the number of slices.
    """
    if total is None:
        total = lists.agg(F.coalesce(F.sum(F.greatest(F.size("tokens"), F.lit(0))), F.lit(0))).first()[0]
    slices = max(1, -(-total // SLICE_TOKENS), min(lists.sparkSession.sparkContext.defaultParallelism, total // SMALL_SLICE))
    kind = lists.schema[key_col].dataType.simpleString()
    x = lists.select(F.col(key_col).alias("key"), "tokens", F.pmod(F.xxhash64(key_col), F.lit(slices)).alias("slice")).repartition(min(slices, 10_000), "slice")

    def ask(rows: pa.Table) -> pa.Table:
        words = pc.unique(rows.column("tokens").combine_chunks().flatten()).drop_null()
        return pa.table({"asker": pa.array(np.full(len(words), rows.column("slice")[0].as_py()), pa.int64()), "word": words})

    told = x.groupBy("slice").applyInArrow(ask, "asker long, word string").join(vocabulary, F.col("word") == vocabulary["token"]).drop("token")

    def encode(_, rows: pa.Table, told: pa.Table) -> pa.Table:
        keys = rows.column("key").combine_chunks().dictionary_encode(null_encoding="encode")
        lists = rows.column("tokens").combine_chunks()
        size = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        place = pc.index_in(lists.flatten(), value_set=told.column("word").combine_chunks(), skip_nulls=True).fill_null(-1).to_numpy(zero_copy_only=False)
        hit = place >= 0
        ids = told.column("id").combine_chunks().to_numpy(zero_copy_only=False).astype(np.int32)[place[hit]]
        of = np.repeat(keys.indices.to_numpy(zero_copy_only=False), size)[hit]
        k = len(keys.dictionary)
        if k < len(size):  # several rows of one key
            at = (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))[hit]
            order = np.lexsort((ids, at, of))
            ids, of = ids[order], of[order]
        n = np.bincount(of, minlength=k)
        out = pa.table({key_col: keys.dictionary, "ids": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(ids, pa.int32()))})
        return out.filter(pa.array(n > 0))

    return x.groupBy("slice").cogroup(told.groupBy("asker")).applyInArrow(encode, f"`{key_col}` {kind}, ids array<int>")

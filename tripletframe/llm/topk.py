"""Exact top-k inner products over integer vectors, longest vectors first.

Candidates are cut into groups by length, longest first, and inside a group
sorted by descending length and cut into blocks. Queries travel in packed
blocks (a stated query set against all rows, in blocks). For a query block the
best scores found in the globally longest vectors (a bounded head) give starting
thresholds; a block goes only to the groups whose longest vector can still reach
one of them. A group then walks its blocks: one whose length bound
|q| * max|x| lies below every query's threshold ends the walk; otherwise the
vectors, rotated by the SVD of the data, are multiplied over the leading
dimensions only, and Cauchy-Schwarz on the rest bounds the score. What may
still reach the threshold is multiplied in full, in exact integers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripletframe.llm.common import stash

#: Rows of a candidate group, of a block inside it, of a query block, and of the head that sets thresholds.
GROUP_ROWS, BLOCK_ROWS, QUERY_ROWS, HEAD_ROWS = 16384, 512, 1024, 4096
#: Query blocks that meet a candidate group in one task; further blocks meet a copy of it in another.
LOT_BLOCKS = 64
#: Steps of the table (length of the longest vector from a group on) that tells how many groups a query block must see.
STEPS = 256
#: Squared length up to which every partial sum of an inner product is exact in float64; beyond it scores are taken in whole numbers.
EXACT = float(1 << 53)
#: Rows that the rotation is fitted on (it only changes how early pruning works, never the result).
ROTATION_ROWS = 4096


def integer_vectors(table: DataFrame, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, v: floor(scale * x) of every component; vectors null, or with null or non-finite components, are left out, and so are rows without id.

    An empty vector stays empty. What goes beyond 64 bits becomes the nearest long.
    """
    x = F.transform(vector, lambda e: e.cast("double"))
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    edge = float(1 << 63)
    whole = F.transform(x, lambda e: F.least(F.greatest(F.floor(F.least(F.greatest(e * scale, F.lit(-edge)), F.lit(edge))), F.lit(1 - (1 << 63))), F.lit((1 << 63) - 1)))
    return (table.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).where(F.coalesce(fine, F.lit(False)))
            .select(F.col(key).cast("long").alias("vec_id"), whole.alias("v")))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def rank(query: np.ndarray, score: np.ndarray, vec: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best (highest score, then smallest id) of each query."""
    order = np.lexsort((vec, -score, query))
    q = query[order]
    first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return order[place < k]


def _whole(query: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products row by row in whole numbers of any size, those beyond 64 bits as the nearest long (but for -2**63)."""
    edge = (1 << 63) - 1
    return np.array([max(-edge, min(edge, sum(int(a) * int(b) for a, b in zip(q, c)))) for q, c in zip(query.tolist(), x.tolist())], np.int64)


def _reachable(least: np.ndarray) -> np.ndarray:
    """Thresholds of float64 scores with those that lie beyond 64 bits drawn in: what is cut to the nearest long ties there."""
    edge = float(1 << 63) * (1 - 1e-9)
    return np.where(least <= -edge, -np.inf, np.minimum(least, edge))


def search(queries: np.ndarray, query_rows: np.ndarray, threshold: np.ndarray, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, rotation: np.ndarray, k: int,
           longest: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact best k of a candidate group for each query that can still reach its threshold: query, id, score.

    ``rows`` and ``query_rows`` number the rows: a query doesn't meet its own. ``longest`` is the length of the longest vector of all.
    """
    length = np.sqrt((x * x).sum(axis=1))
    order = np.lexsort((ids, -length))
    x, ids, rows, length = x[order], ids[order], rows[order], length[order]
    lead = max(1, x.shape[1] // 4)
    qr, xr = queries @ rotation, x @ rotation
    q_rest, x_rest = np.sqrt((qr[:, lead:] ** 2).sum(axis=1)), np.sqrt((xr[:, lead:] ** 2).sum(axis=1))
    q_len = np.sqrt((queries * queries).sum(axis=1))
    large = longest**2 >= EXACT
    rounding = 1e-9 * q_len * longest if large else np.zeros(len(queries))  # of a score taken in float64
    need = _reachable(threshold - rounding)
    top = np.full((len(queries), k), -np.inf)
    out = ([], [], [])
    for a in range(0, len(x), BLOCK_ROWS):
        b = slice(a, a + BLOCK_ROWS)
        slack = 1e-9 * (q_len * length[a]) + 1e-6  # rounding of the bounds
        live = np.flatnonzero(q_len * length[a] + slack >= need)
        if not len(live):
            break  # shorter vectors follow
        bound = qr[live, :lead] @ xr[b, :lead].T + q_rest[live][:, None] * x_rest[b] + slack[live][:, None]
        qi, xi = np.nonzero((bound >= need[live][:, None]) & (query_rows[live][:, None] != rows[b]))
        if not len(qi):
            continue
        asked = live[qi]
        dots = np.concatenate([np.einsum("ij,ij->i", queries[asked[i : i + 65536]], x[b][xi[i : i + 65536]]) for i in range(0, len(asked), 65536)])
        keep = np.flatnonzero(dots >= need[asked])
        asked, xi, dots = asked[keep], xi[keep], dots[keep]
        out[0].append(asked)
        out[1].append(ids[b][xi])
        out[2].append(_whole(queries[asked], x[b][xi]) if large else dots.astype(np.int64))
        best = rank(asked, dots, ids[b][xi], k)
        r, s = asked[best], dots[best]
        first = np.flatnonzero(np.append(True, r[1:] != r[:-1])) if len(r) else np.zeros(0, np.int64)
        new = np.full((len(queries), k), -np.inf)
        new[r, np.arange(len(r)) - np.repeat(first, np.diff(np.append(first, len(r))))] = s
        top = -np.sort(-np.concatenate([top, new], axis=1), axis=1)[:, :k]
        need = np.maximum(need, _reachable(top[:, -1] - rounding))
    asked, vec, score = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)
    pick = rank(asked, score, vec, k)
    return asked[pick], vec[pick], score[pick]


def top_inner_products(vectors: DataFrame, k: int = 5, query_step: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``vectors(vec_id, v array<long>)`` whose id is divisible by
    ``query_step`` the k highest inner products with the other rows (all, if fewer), ties to the smaller id.

    A query leaves out its own row only: rows that share its id are candidates,
    and of rows that share an id each is a query of its own, with ranks from 1.
    Vectors of different lengths count as ending in zeros, an empty one scores 0
    everywhere. Scores beyond 64 bits become the nearest long. Rows without id
    or vector are left out. An empty table gives no rows, and so does a table
    with one vector; other columns are not read.
    """
    result = "query_id long, rank int, vec_id long, score long"
    spark = vectors.sparkSession
    vectors = vectors.where("vec_id is not null and v is not null").select("vec_id", "v")
    n, width, n_queries = vectors.agg(F.count("*"), F.max(F.size("v")), F.count_if(F.col("vec_id") % query_step == 0)).first()
    if not n_queries or n < 2:
        return spark.createDataFrame([], result)
    width = max(1, width)
    padded = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v")))
    n2 = F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))
    # equal lengths are cut by the row's number, so that no group is hot
    rows = stash(vectors.select("vec_id", padded.alias("v")).withColumn("n2", n2).withColumn("row", F.monotonically_increasing_id())
                 .repartitionByRange(-(-n // GROUP_ROWS), F.desc("n2"), "row").withColumn("grp", F.spark_partition_id().cast("long")), "vectors")
    n_groups = rows.agg(F.max("grp")).first()[0] + 1
    stride = -(-n_groups // STEPS)
    steps = rows.groupBy(F.floor(F.col("grp") / stride).alias("step")).agg(F.max("n2").alias("n2")).collect()  # bounded: STEPS rows
    from_step = np.zeros(-(-n_groups // stride))
    for step, top in steps:
        from_step[step] = np.sqrt(top)
    from_step = np.maximum.accumulate(from_step[::-1])[::-1]
    longest = float(from_step[0])
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v", "row").limit(ROTATION_ROWS).select("v").toArrow()
    rotation = np.linalg.svd(_matrix(sample.column("v"), width), full_matrices=True)[2].T
    head = rows.orderBy(F.desc("n2"), "vec_id", "v", "row").limit(HEAD_ROWS).select("row", "v").toArrow()
    head_x, head_rows = _matrix(head.column("v"), width), head.column("row").to_numpy()
    n_blocks = -(-n_queries // QUERY_ROWS)
    n_lots = -(-n_blocks // LOT_BLOCKS)

    def starting(block: pa.Table) -> pa.Table:
        """A query block with the k-th best scores that the head gives, and the number of groups that can hold better ones."""
        q, own = _matrix(block.column("v"), width), block.column("row").to_numpy()
        score = q @ head_x.T
        score[own[:, None] == head_rows[None, :]] = -np.inf
        kth = -np.sort(-score, axis=1)[:, k - 1] if score.shape[1] >= k else np.full(len(q), -np.inf)
        q_len = np.sqrt((q * q).sum(axis=1))
        reach = q_len[:, None] * from_step * (1 + 1e-8) + 1e-6 >= _reachable(kth - 1e-8 * q_len * longest)[:, None]
        groups = min(n_groups, int(reach.any(axis=0).sum()) * stride)  # the steps fall, so those that reach come first
        pack = lambda a, t: pa.array([np.ascontiguousarray(a.astype(t)).tobytes()], pa.binary())
        return pa.table({"lot": pa.array([block.column("block")[0].as_py() // LOT_BLOCKS]), "queries": pack(q, np.float64), "ids": pack(block.column("vec_id").to_numpy(), np.int64),
                         "rows": pack(own, np.int64), "least": pack(kth, np.float64), "groups": pa.array([groups])})

    def meet(key, group: pa.Table, blocks: pa.Table) -> pa.Table:
        out = ([], [], [], [])
        if group.num_rows and blocks.num_rows:
            x, ids, own = _matrix(group.column("v"), width), group.column("vec_id").to_numpy(), group.column("row").to_numpy()
            for at in range(blocks.num_rows):
                q, i, n, t = (np.frombuffer(blocks.column(c)[at].as_py(), kind) for c, kind in (("queries", np.float64), ("ids", np.int64), ("rows", np.int64), ("least", np.float64)))
                r, v, s = search(q.reshape(-1, width), n, t, x, ids, own, rotation, k, longest)
                for c, a in zip(out, (n[r], i[r], v, s)):
                    c.append(a)
        return pa.table({c: pa.array(np.concatenate(a) if a else np.zeros(0, np.int64), pa.int64()) for c, a in zip(("query", "query_id", "vec_id", "score"), out)})

    queries = rows.where(F.col("vec_id") % query_step == 0).select("vec_id", "v", "row", F.pmod(F.xxhash64("row"), F.lit(n_blocks)).alias("block"))
    blocks = queries.groupBy("block").applyInArrow(starting, "lot long, queries binary, ids binary, rows binary, least binary, groups long")
    sent = blocks.where("groups > 0").withColumn("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))).drop("groups")
    groups = rows.select("grp", "vec_id", "v", "row").withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_lots - 1).cast("long"))))
    found = groups.groupBy("grp", "lot").cogroup(sent.groupBy("grp", "lot")).applyInArrow(meet, "query long, query_id long, vec_id long, score long")

    def best(batches):
        """Keep the k best of each query among the rows of a task's batches (rows sorted by query)."""
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            last = pdf["query"].iloc[-1] if len(pdf) else None
            done, rest = pdf[pdf["query"] != last], pdf[pdf["query"] == last]
            rest = rest.iloc[rank(rest["query"].to_numpy(), rest["score"].to_numpy(), rest["vec_id"].to_numpy(), k)]
            yield ranked(done)
        if rest is not None:
            yield ranked(rest)

    def ranked(pdf):
        pdf = pdf.iloc[rank(pdf["query"].to_numpy(), pdf["score"].to_numpy(), pdf["vec_id"].to_numpy(), k)]
        return pdf.assign(rank=pdf.groupby("query").cumcount().astype("int32") + 1)[["query_id", "rank", "vec_id", "score"]]

    return found.repartition("query").sortWithinPartitions("query").mapInPandas(best, result)

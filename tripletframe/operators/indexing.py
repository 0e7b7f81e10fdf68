"""Row indices, derangements and exact per-group cuts without single-task windows.

Spark has no row order. Everything that the reference does by list position
(``i``-th row, "another row", "first n rows") is expressed here with explicit
keys so that it partitions:

* :func:`dense_index` numbers the rows of each group 0..n-1 in a given order.
  Rows are first cut into *range buckets* of the order key, ranked inside a
  bucket, and shifted by the rows of all earlier buckets (a prefix sum over a
  table of ``groups x buckets`` rows). A hot group is therefore spread over all
  buckets instead of landing in one window task.
* :func:`derangement_partner` picks for row ``i`` of an ``n``-row group the
  index ``(i + 1 + h mod (n-1)) mod n``: uniform over the other ``n-1`` rows,
  never itself, and keyed by the row's own hash.
* :func:`exact_cap` keeps the ``cap`` smallest-hash rows of every group. Rows
  are counted per (group, hash bucket); whole buckets below the cut pass
  without ranking, only the one boundary bucket of each group is ranked.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripletframe.functions.keys import HASH_BITS

# Rows one window task should rank at most (target size of a bucket).
ROWS_PER_BUCKET = 1_000_000
# Bytes it should sort at most: rows that carry whole texts fill a task long before their number does.
BYTES_PER_BUCKET = 32 << 20


def buckets_for(n_rows: int, rows_per_bucket: int | None = None) -> int:
    """Power-of-two bucket count so that a bucket holds about rows_per_bucket rows (default ROWS_PER_BUCKET)."""
    rows_per_bucket = ROWS_PER_BUCKET if rows_per_bucket is None else rows_per_bucket
    need = max(1, math.ceil(n_rows / max(1, rows_per_bucket)))
    return 1 << max(0, math.ceil(math.log2(need)))


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row's values: texts and nested values by their length, others 8 each."""
    long = (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)
    size = F.lit(8 * len(df.columns)).cast("long")
    for f in df.schema.fields:
        if isinstance(f.dataType, long):
            c = F.col(f"`{f.name}`")
            plain = isinstance(f.dataType, (T.StringType, T.BinaryType))
            size = size + F.coalesce(F.octet_length(c if plain else c.cast("string")), F.lit(0))
    return size


def buckets_of(df: DataFrame, rows_per_bucket: int | None = None) -> int:
    """Power-of-two bucket count so that a bucket of whole rows of ``df`` keeps to the rows and the bytes of one task."""
    st = df.agg(F.count(F.lit(1)).alias("c"), F.sum(row_bytes(df)).alias("b")).first()
    return max(buckets_for(st["c"], rows_per_bucket), buckets_for(st["b"] or 0, BYTES_PER_BUCKET))


def zero_of(c: Column) -> Column:
    """0 computed from a column: constant in value but not foldable, so a join on it stays an equi-join."""
    return F.xxhash64(c).bitwiseAND(F.lit(0)).cast("int")


def hash_range_bucket(h: Column | str, n_buckets: int) -> Column:
    """Monotone bucket of a 60-bit hash: its top log2(n_buckets) bits."""
    if isinstance(h, str):
        h = F.col(h)
    bits = max(0, int(math.log2(n_buckets)))
    if bits == 0:
        return zero_of(h)
    return F.shiftright(h, HASH_BITS - bits).cast("int")


def value_range_bucket(x: Column | str, lo: float, hi: float, n_buckets: int) -> Column:
    """Monotone bucket of a numeric key with known bounds [lo, hi]."""
    if isinstance(x, str):
        x = F.col(x)
    if n_buckets <= 1 or hi <= lo:
        return zero_of(x)
    width = (hi - lo) / n_buckets
    return F.least(F.floor((x.cast("double") - F.lit(float(lo))) / F.lit(width)), F.lit(n_buckets - 1)).cast("int")


def dense_index(
    df: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[Column | str],
    bucket: Column,
    idx_col: str = "idx",
    n_col: str | None = "n",
) -> DataFrame:
    """Add ``idx_col`` (0-based position inside ``group_cols`` by ``order_cols``).

    ``bucket`` must be non-decreasing in ``order_cols`` (see the two
    ``*_range_bucket`` helpers). Optional ``n_col`` carries the group size.
    The result equals ``row_number() over (partition by group order by order) - 1``.
    """
    g = list(group_cols)
    b = df.withColumn("__bkt", bucket)
    # groups x buckets rows: the offsets table is small by construction
    ranked = b.withColumn("__r", F.row_number().over(Window.partitionBy(*g, "__bkt").orderBy(*order_cols)))
    counts = b.groupBy(*g, "__bkt").agg(F.count(F.lit(1)).alias("__c"))
    wg = Window.partitionBy(*g).orderBy("__bkt")
    offsets = counts.select(
        *g,
        "__bkt",
        F.coalesce(F.sum("__c").over(wg.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"),
        *([F.sum("__c").over(Window.partitionBy(*g)).alias(n_col)] if n_col else []),
    )
    out = ranked.join(offsets, on=[*g, "__bkt"], how="inner")
    return out.withColumn(idx_col, (F.col("__off") + F.col("__r") - 1).cast("long")).drop("__bkt", "__r", "__off")


def derangement_partner(idx: Column | str, n: Column | str, h: Column | str) -> Column:
    """Index of a uniformly chosen *other* row: (i + 1 + h mod (n-1)) mod n; null when n < 2."""
    i, nn, hh = (F.col(c) if isinstance(c, str) else c for c in (idx, n, h))
    return F.when(nn > 1, F.pmod(i + 1 + F.pmod(hh, nn - 1), nn)).cast("long")


def exact_cap(
    df: DataFrame,
    group_cols: Sequence[str],
    h_col: str,
    cap: int,
    tiebreak: str,
    bits: int = 12,
) -> DataFrame:
    """Keep the ``cap`` rows with the smallest (h, tiebreak) in every group.

    Exact for any group size: per-(group, top-``bits`` hash bucket) counts
    decide which buckets lie wholly below the cut; only the straddling bucket
    is ranked. Equals ``row_number() over (partition by g order by h, tiebreak) <= cap``.
    """
    g = list(group_cols)
    b = df.withColumn("_bkt", F.shiftright(F.col(h_col), HASH_BITS - bits).cast("int"))
    counts = b.groupBy(*g, "_bkt").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*g).orderBy("_bkt")
    cuts = counts.select(
        *g,
        "_bkt",
        F.coalesce(F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        "_c",
    ).where(F.col("_before") < cap)
    kept = b.join(cuts, on=[*g, "_bkt"], how="inner")
    whole = kept.where(F.col("_before") + F.col("_c") <= cap)
    edge = kept.where(F.col("_before") + F.col("_c") > cap)
    edge = edge.withColumn(
        "_r", F.row_number().over(Window.partitionBy(*g, "_bkt").orderBy(h_col, tiebreak))
    ).where(F.col("_before") + F.col("_r") <= cap).drop("_r")
    return whole.unionByName(edge).drop("_bkt", "_before", "_c")


def bucketed_running(
    df: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[Column | str],
    bucket: Column,
    aggs: dict[str, tuple[str, Column]],
    inclusive: bool = True,
) -> DataFrame:
    """Running ``sum`` / ``max`` per group in ``order_cols`` order without a single-task window.

    ``aggs`` maps an output name to (``'sum'`` | ``'max'``, value expression).
    Buckets (non-decreasing in the order) give per-bucket totals whose
    exclusive prefix is added to a window running inside each bucket.
    ``inclusive=False`` gives the value over strictly preceding rows.
    """
    g = list(group_cols)
    b = df.withColumn("__bkt", bucket)
    for name, (_, expr) in aggs.items():
        b = b.withColumn(f"__v_{name}", expr)
    tot = b.groupBy(*g, "__bkt").agg(
        *[(F.sum if kind == "sum" else F.max)(f"__v_{name}").alias(f"__t_{name}") for name, (kind, _) in aggs.items()]
    )
    wb = Window.partitionBy(*g).orderBy("__bkt").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.select(
        *g, "__bkt",
        *[(F.sum if kind == "sum" else F.max)(f"__t_{name}").over(wb).alias(f"__o_{name}") for name, (kind, _) in aggs.items()],
    )
    wi = Window.partitionBy(*g, "__bkt").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    x = b.join(tot, [*g, "__bkt"])
    for name, (kind, _) in aggs.items():
        fn = F.sum if kind == "sum" else F.max
        run = fn(f"__v_{name}").over(wi)
        off = F.col(f"__o_{name}")
        if kind == "sum":
            val = F.coalesce(off, F.lit(0)) + F.coalesce(run, F.lit(0))
        else:
            val = F.greatest(off, run)  # greatest skips nulls
        x = x.withColumn(name, val)
    drop = ["__bkt"] + [f"__{p}_{n}" for n in aggs for p in ("v", "o")]
    return x.drop(*drop)

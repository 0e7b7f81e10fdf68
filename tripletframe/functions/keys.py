"""Hash keys: deterministic, seed-keyed integers that replace process-global RNG.

``h(k1, k2, ...) = int(first 15 hex digits of md5("<seed>|k1|k2..."), 16)``
is a non-negative 60-bit integer. Spark and DuckDB compute the same value, so
every sampler built on it is reproducible and oracle-comparable, and the value
depends only on the row's own keys (not on partitioning or arrival order).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 42
HASH_BITS = 60


def _part(c) -> Column:
    if isinstance(c, str):
        c = F.col(c)
    return c.cast("string")


def hkey(*parts, seed: int = SEED) -> Column:
    """60-bit hash key of the given columns (names, Columns or literals via F.lit)."""
    pieces = [F.lit(str(seed))]
    for p in parts:
        pieces += [F.lit("|"), _part(p)]
    return F.conv(F.substring(F.md5(F.concat(*pieces)), 1, 15), 16, 10).cast("bigint")


def hkey_sql(*parts: str, seed: int = SEED) -> str:
    """DuckDB text of :func:`hkey`; each part is a SQL expression."""
    body = f"'{seed}'" + "".join(f" || '|' || CAST({p} AS VARCHAR)" for p in parts)
    return f"(('0x' || substr(md5({body}), 1, 15))::BIGINT)"


def hkey_spark_sql(*parts: str, seed: int = SEED) -> str:
    """Spark SQL text of :func:`hkey` (for selectExpr / spark.sql)."""
    body = ", ".join([f"'{seed}'"] + [f"'|', CAST({p} AS STRING)" for p in parts])
    return f"CAST(conv(substr(md5(concat({body})), 1, 15), 16, 10) AS BIGINT)"

"""Array-vector expressions (E4) that stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(arr) -> Column:
    """array<float> -> array<double> (arithmetic in double, as the oracle does)."""
    return F.transform(_c(arr), lambda x: x.cast("double"))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine(a, b, eps: float = 0.0, mode: str = "zero") -> Column:
    """Cosine similarity of two numeric arrays.

    ``mode='zero'``: a zero vector gives 0; ``mode='add'``: eps is added to the
    denominator (EmbSim); ``mode='clamp'``: each norm is clamped below at eps.
    """
    d = dot(a, b)
    na, nb = norm(a), norm(b)
    if mode == "add":
        return d / (na * nb + F.lit(eps))
    if mode == "clamp":
        return d / (F.greatest(na, F.lit(eps)) * F.greatest(nb, F.lit(eps)))
    den = na * nb
    return F.when(den > 0, d / den).otherwise(F.lit(0.0))


def cosine_sql_duck(a: str, b: str) -> str:
    """DuckDB text of :func:`cosine` (zero mode) for the oracle."""
    da = f"list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"
    na = f"sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[]))"
    nb = f"sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[]))"
    return f"(case when {na} * {nb} > 0 then {da} / ({na} * {nb}) else 0.0 end)"

"""Vector column functions (F16, F17): higher-order array expressions that
stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def vec_add(*cols) -> Column:
    """F16: element-wise sum of equally long arrays."""
    acc = _c(cols[0])
    for c in cols[1:]:
        acc = F.zip_with(acc, _c(c), lambda x, y: x + y)
    return acc


def vec_concat(*cols) -> Column:
    """F16: concatenation s‖r‖o."""
    return F.concat(*[_c(c) for c in cols])


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a, b) -> Column:
    """1 − cosine distance; null when a norm is zero."""
    den = norm(a) * norm(b)
    return F.when(den > 0, dot(a, b) / den)


def unit(a) -> Column:
    """The vector divided by its norm, which is bound once and not computed
    anew for each element; null for a zero vector."""
    def divided(n):
        return F.when(n > 0, F.transform(_c(a), lambda x: x.cast("double") / n))
    return F.transform(F.array(norm(a)), divided)[0]


def vec_mean_scalar(a) -> Column:
    """A7 inner step: mean of one vector's elements."""
    return F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x.cast("double")) / F.size(_c(a))

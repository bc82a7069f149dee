"""Vector algebra on ``array<double>`` columns.

With a known width ``d`` a sum is unrolled, which keeps it inside generated code; use that on
plain columns. Functions that return vectors bind their arguments and norms once per row with
``let``, so nothing is worked out again for every coordinate.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = str | Column


def _c(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(values: list[ColumnLike], body: Callable[..., Column]) -> Column:
    """``body`` over ``values``, each evaluated once per row."""
    packed = F.struct(*[_c(v).alias(f"v{i}") for i, v in enumerate(values)])
    return F.transform(F.array(packed), lambda s: body(*[s[f"v{i}"] for i in range(len(values))]))[0]


def total(terms: list[Column]) -> Column:
    """A balanced sum, so wide vectors do not build deep expression trees."""
    if len(terms) == 1:
        return terms[0]
    half = len(terms) // 2
    return total(terms[:half]) + total(terms[half:])


def vec_dot(x: ColumnLike, y: ColumnLike, d: int | None = None) -> Column:
    x, y = _c(x), _c(y)
    if d:
        return total([x[i] * y[i] for i in range(d)])
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def vec_norm_sq(x: ColumnLike, d: int | None = None) -> Column:
    x = _c(x)
    if d:
        return total([x[i] * x[i] for i in range(d)])
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)


def vec_norm(x: ColumnLike, d: int | None = None) -> Column:
    return F.sqrt(vec_norm_sq(x, d))


def vec_add(x: ColumnLike, y: ColumnLike) -> Column:
    return F.zip_with(_c(x), _c(y), lambda a, b: a + b)


def vec_scale(x: ColumnLike, k: ColumnLike | float) -> Column:
    if isinstance(k, (int, float)):
        return F.transform(_c(x), lambda a: a * F.lit(float(k)))
    return let([x, k], lambda x, k: F.transform(x, lambda a: a * k))


def combine(x: ColumnLike, y: ColumnLike, a: ColumnLike, b: ColumnLike) -> Column:
    """``a x + b y``."""
    return let([x, y, a, b], lambda x, y, a, b: F.zip_with(x, y, lambda p, q: a * p + b * q))


def l2_normalize(x: ColumnLike) -> Column:
    """Unit vector; a zero vector stays as it is."""
    return let([x], lambda x: let(
        [vec_norm(x)], lambda n: F.when(n > 0, F.transform(x, lambda a: a / n)).otherwise(x)))


def clip_by_norm(x: ColumnLike, max_norm: float = 1.0) -> Column:
    """Scale down to ``max_norm`` when longer."""
    return let([x], lambda x: let(
        [vec_norm(x)],
        lambda n: F.when(n > max_norm, F.transform(x, lambda a: a * F.lit(max_norm) / n)).otherwise(x)))


def euclidean_sq(x: ColumnLike, y: ColumnLike, d: int | None = None) -> Column:
    x, y = _c(x), _c(y)
    if d:
        return total([(x[i] - y[i]) * (x[i] - y[i]) for i in range(d)])
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)


def euclidean_sq_expanded(x2: Column, y2: Column, xy: Column) -> Column:
    """``|x|^2 + |y|^2 - 2 x.y`` from norms computed once per vector."""
    return F.greatest(x2 + y2 - F.lit(2.0) * xy, F.lit(0.0))

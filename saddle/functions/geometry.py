"""Distances, coordinate changes and Riemannian update steps as column expressions.

Hyperboloid points carry the time coordinate first: ``<u,v>_L = u.v - 2 u0 v0``.
"""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from saddle.functions.uniform import uniform
from saddle.functions.vectors import (
    ColumnLike,
    _c,
    clip_by_norm,
    combine,
    euclidean_sq,
    let,
    vec_dot,
    vec_norm,
    vec_norm_sq,
    vec_scale,
)

INF = float("inf")


def _acosh_from_one(excess: Column) -> Column:
    """acosh(1 + e) for e >= 0, stable for small e."""
    e = F.greatest(excess, F.lit(0.0))
    return F.log1p(e + F.sqrt(e * (e + F.lit(2.0))))


def poincare_from_parts(dist_sq: Column, x2: Column, y2: Column) -> Column:
    """Ball distance from the squared gap and squared norms; infinite on or past the boundary."""
    room = (F.lit(1.0) - x2) * (F.lit(1.0) - y2)
    inside = (x2 < 1.0) & (y2 < 1.0)
    far = F.when(dist_sq == 0, F.lit(0.0)).otherwise(F.lit(INF))
    return F.when(inside, _acosh_from_one(F.try_divide(F.lit(2.0) * dist_sq, room))).otherwise(far)


def poincare_distance(x: ColumnLike, y: ColumnLike, d: int | None = None) -> Column:
    return poincare_from_parts(euclidean_sq(x, y, d), vec_norm_sq(x, d), vec_norm_sq(y, d))


def minkowski_dot(u: ColumnLike, v: ColumnLike, d: int | None = None) -> Column:
    u, v = _c(u), _c(v)
    return vec_dot(u, v, d) - F.lit(2.0) * u[0] * v[0]


def lorentz_from_dot(dot: Column, margin: float = 0.0) -> Column:
    return F.acosh(F.greatest(-dot, F.lit(1.0 + margin)))


def minkowski_distance(u: ColumnLike, v: ColumnLike, margin: float = 0.0, d: int | None = None) -> Column:
    """acosh of the negated Minkowski product, clamped at ``1 + margin``."""
    return lorentz_from_dot(minkowski_dot(u, v, d), margin)


def polar_inner(r1: ColumnLike, t1: ColumnLike, r2: ColumnLike, t2: ColumnLike) -> Column:
    return _c(r1) * _c(r2) * F.cos(_c(t1) - _c(t2))


def polar_to_poincare(r: ColumnLike, theta: ColumnLike) -> Column:
    """Native polar coordinates to the unit disc."""
    radius = F.tanh(_c(r) / F.lit(2.0))
    return F.array(radius * F.cos(_c(theta)), radius * F.sin(_c(theta)))


def polar_to_cartesian(r: ColumnLike, theta: ColumnLike) -> Column:
    return F.array(_c(r) * F.cos(_c(theta)), _c(r) * F.sin(_c(theta)))


def cartesian_to_polar(x: ColumnLike, y: ColumnLike) -> Column:
    """``[r, theta]`` with theta in (-pi, pi], 0 at the origin."""
    x, y = _c(x), _c(y)
    return F.array(F.sqrt(x * x + y * y), F.atan2(y, x))


def poincare_to_hyperboloid(p: ColumnLike) -> Column:
    return let([p], lambda p: let([vec_norm_sq(p)], lambda s: F.concat(
        F.array(F.try_divide(F.lit(1.0) + s, F.lit(1.0) - s)),
        F.transform(p, lambda a: F.try_divide(F.lit(2.0) * a, F.lit(1.0) - s)))))


def hyperboloid_to_poincare(u: ColumnLike) -> Column:
    return let([u], lambda u: let(
        [u[0] + F.lit(1.0)], lambda k: F.transform(_space(u), lambda a: a / k)))


def _space(u: Column) -> Column:
    return F.slice(u, F.lit(2), F.size(u) - 1)


def lift_to_hyperboloid(space: ColumnLike) -> Column:
    """Prepend the time coordinate that puts the point on the hyperboloid."""
    return let([space], lambda s: F.concat(F.array(F.sqrt(F.lit(1.0) + vec_norm_sq(s))), s))


def project_to_hyperboloid(u: ColumnLike) -> Column:
    """Keep the spatial part and recompute the time coordinate."""
    return let([u], lambda u: lift_to_hyperboloid(_space(u)))


def project_to_ball(x: ColumnLike, eps: float = 1e-5) -> Column:
    """Pull points on or past the boundary to norm ``1 - eps``."""
    return let([x], lambda x: let(
        [vec_norm(x)], lambda n: F.when(n >= 1.0, F.transform(x, lambda a: a * F.lit(1.0 - eps) / n)).otherwise(x)))


def tangent_projection(x: ColumnLike, g: ColumnLike) -> Column:
    return let([x, g], lambda x, g: combine(g, x, F.lit(1.0), minkowski_dot(x, g)))


def _finite(v: Column) -> Column:
    return ~(F.isnan(v) | (F.abs(v) == F.lit(INF)))


def exp_map(x: ColumnLike, v: ColumnLike) -> Column:
    """Follow the tangent ``v`` from ``x``; stays put for null or unusable steps, then reprojects."""

    def move(x, v, norm):
        step = F.zip_with(x, v, lambda a, b: F.cosh(norm) * a + F.sinh(norm) * F.try_divide(b, norm))
        safe = let([step], lambda m: F.zip_with(m, x, lambda p, a: F.when(_finite(p), p).otherwise(a)))
        return F.when(norm > 0, project_to_hyperboloid(safe)).otherwise(x)

    return let([x, v], lambda x, v: let(
        [F.sqrt(F.greatest(minkowski_dot(v, v), F.lit(0.0)))], lambda norm: move(x, v, norm)))


def metric_transform(g: ColumnLike) -> Column:
    """Raise the index with diag(-1, 1, ..): negate the first coordinate."""
    return F.transform(_c(g), lambda v, i: F.when(i == 0, -v).otherwise(v))


def poincare_grad_scale(x: ColumnLike, g: ColumnLike) -> Column:
    """The Riemannian gradient of the ball: ``(1 - |x|^2)^2 / 4`` times the Euclidean one."""
    room = F.lit(1.0) - vec_norm_sq(x)
    return let([g, room], lambda g, room: F.transform(g, lambda a: a * room * room / F.lit(4.0)))


def polar_theta_grad_scale(g: ColumnLike, r: ColumnLike, hyperbolic: bool = False) -> Column:
    """The angular gradient over ``r`` (flat) or ``sinh r`` (hyperbolic); null at the origin."""
    return F.try_divide(_c(g), F.sinh(_c(r)) if hyperbolic else _c(r))


def remove_nan_grad(g: ColumnLike, epsilon: float = 0.001) -> Column:
    return F.transform(_c(g), lambda v: F.when(v.isNotNull() & _finite(v), v).otherwise(F.lit(epsilon)))


def arctanh(x: ColumnLike) -> Column:
    return F.lit(0.5) * F.log(F.try_divide(F.lit(1.0) + _c(x), F.lit(1.0) - _c(x)))


def sigmoid(x: ColumnLike) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))


def sigmoid_xent(logit: ColumnLike, label: ColumnLike | float) -> Column:
    """Cross entropy of a logit against a 0/1 label, without overflow."""
    logit = _c(logit)
    label = F.lit(float(label)) if isinstance(label, (int, float)) else _c(label)
    return F.greatest(logit, F.lit(0.0)) - logit * label + F.log1p(F.exp(-F.abs(logit)))


def rsgd_lorentz(x: ColumnLike, g: ColumnLike, lr: float | Column, max_norm: float = 1.0) -> Column:
    """One Riemannian step: clip, raise, project to the tangent space, follow the geodesic."""
    lr = F.lit(lr) if isinstance(lr, (int, float)) else lr
    clipped = clip_by_norm(g, max_norm)
    return exp_map(x, vec_scale(tangent_projection(x, metric_transform(clipped)), -lr))


# -- start vectors -------------------------------------------------------------------------

def _uniforms(seed, id_col: ColumnLike, d: int) -> list[Column]:
    return [uniform(seed, _c(id_col), F.lit(i)) for i in range(1, d + 1)]


def init_uniform(seed, id_col: ColumnLike, d: int, width: float | None = None) -> Column:
    """Coordinates uniform on ``(-w, w)``; ``w = 0.5 / d`` unless given."""
    w = 0.5 / d if width is None else width
    return F.transform(F.sequence(F.lit(1), F.lit(d)), lambda i: (uniform(seed, _c(id_col), i) * F.lit(2.0) - F.lit(1.0)) * F.lit(w))


def init_poincare_disc(seed, id_col: ColumnLike) -> Column:
    """``[r, theta]`` uniform on the unit disc."""
    a, b = _uniforms(seed, id_col, 2)
    return F.array(F.sqrt(a), F.lit(2 * math.pi) * b)


def init_hyperboloid(seed, id_col: ColumnLike, d: int, width: float | None = None) -> Column:
    return lift_to_hyperboloid(init_uniform(seed, id_col, d, width))


def init_polar(seed, id_col: ColumnLike, width: float = 0.25, displacement: float = 1.0) -> Column:
    """``[r, theta]`` near one spot: radius in ``displacement + (0, 2w)``.

    With a displacement the angle spans ``asin(w / (w + displacement))``, roughly a box of side
    ``w``; without one it spans ``pi / 10``.
    """
    a, b = _uniforms(seed, id_col, 2)
    span = math.asin(width / (width + displacement)) if displacement else math.pi / 10.0
    return F.array(F.lit(2.0 * width) * a + F.lit(displacement), F.lit(span) * b)

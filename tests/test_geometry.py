"""Exact small cases and laws of the vector and manifold functions."""
import math
import random

import pytest
from pyspark.sql import functions as F

from saddle.functions import geometry as g
from saddle.functions import vectors as v


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<double>' if isinstance(x, list) else 'double'}" for k, x in values.items())
    return rows(spark, [tuple(values.values())], schema).select(column.alias("out")).first()["out"]


def mink(u, w):
    return sum(a * b for a, b in zip(u, w)) - 2 * u[0] * w[0]


@pytest.mark.parametrize("x,y,want", [
    ([1.0, 0.0], [1.0, 0.0], -1), ([1.0, 0.0], [10.0, 0.0], -10), ([1.0, 0.0, 1.0], [1.0, 1.0, 1.0], 0),
    ([1.0, 1.0, 1.0], [0.0, 0.0, 1.0], 1), ([1.0, 0.0, 1.0], [2.0, 1.0, 1.0], -1), ([1.0, 1.0, 1.0], [2.0, 0.0, 1.0], -1),
    ([1.0, 0.0], [3.0, 4.0], -3), ([1.0, 0.0], [5.0, 6.0], -5), ([0.0, 1.0], [3.0, 4.0], 4), ([0.0, 1.0], [5.0, 6.0], 6)])
def test_minkowski_dot(spark, x, y, want):
    assert one(spark, g.minkowski_dot("x", "y"), x=x, y=y) == want
    assert one(spark, g.minkowski_dot("x", "y", len(x)), x=x, y=y) == want


@pytest.mark.parametrize("t,want", [([1.0, 0.0], [0.0, 0.0]), ([0.0, 1.0], [0.0, 1.0]), ([0.0, -1.0], [0.0, -1.0]),
                                    ([1.0, 1.0], [0.0, 1.0])])
def test_tangent_projection(spark, t, want):
    once = one(spark, g.tangent_projection("x", "t"), x=[1.0, 0.0], t=t)
    assert once == want
    assert one(spark, g.tangent_projection("x", "t"), x=[1.0, 0.0], t=once) == want


def test_exp_map(spark):
    base = [1.0, 0.0]
    up, down = (one(spark, g.exp_map("x", "t"), x=base, t=[0.0, s]) for s in (1.0, -1.0))
    far = one(spark, g.exp_map("x", "t"), x=base, t=[0.0, 2.0])
    for p in (up, down, far):
        assert mink(p, p) == pytest.approx(-1)
    assert up == pytest.approx([math.cosh(1), math.sinh(1)]) and down[1] == pytest.approx(-up[1]) and far[1] > up[1]
    for still in ([0.0, 0.0], [1.0, 0.0]):
        assert one(spark, g.exp_map("x", "t"), x=base, t=still) == base
    # an overflowing step leaves the point where it was
    assert one(spark, g.exp_map("x", "t"), x=base, t=[0.0, 1e6]) == base


@pytest.mark.parametrize("u", [[1.0, 1.0, 1.0], [2.0, -1.0, 2.0], [3.0, 2.0, 3.0], [4.0, 0.0, 4.0]])
def test_project_to_hyperboloid(spark, u):
    p = one(spark, g.project_to_hyperboloid("u"), u=u)
    assert mink(p, p) == pytest.approx(-1) and p[1:] == u[1:]


def test_metric_transform(spark):
    for gr in ([1.0, 1.0], [2.0, -1.0], [3.0, 2.0], [4.0, 0.0]):
        assert one(spark, g.metric_transform("g"), g=gr) == [-gr[0], gr[1]]


def test_ball_and_hyperboloid_agree(spark):
    rng = random.Random(3)
    pts = [[rng.uniform(-0.5, 0.5) for _ in range(3)] for _ in range(60)]
    df = rows(spark, [(pts[i], pts[i + 1]) for i in range(59)], "x array<double>, y array<double>")
    hx, hy = g.poincare_to_hyperboloid("x"), g.poincare_to_hyperboloid("y")
    out = df.select("x", g.hyperboloid_to_poincare(hx).alias("back"), g.poincare_distance("x", "y", 3).alias("ball"),
                    g.minkowski_distance(hx, hy).alias("sheet"), hx.alias("h")).collect()
    for r in out:
        assert r["back"] == pytest.approx(r["x"], abs=1e-9)
        assert r["ball"] == pytest.approx(r["sheet"], abs=1e-7) and r["ball"] > 0
        assert mink(r["h"], r["h"]) == pytest.approx(-1)


def test_poincare_distance_edges(spark):
    x = [[0.2, 0.0], [0.3, 0.0], [0.0, 0.0], [1.0, 0.0], [1.0, 0.0]]
    y = [[0.1, 0.1], [0.2, 0.4], [0.0, 0.0], [0.0, 0.0], [0.5, 0.0]]
    got = [r[0] for r in rows(spark, list(zip(x, y)), "x array<double>, y array<double>").select(g.poincare_distance("x", "y")).collect()]
    for a, b, d in list(zip(x, y, got))[:2]:
        n = lambda p: sum(c * c for c in p)
        gap = sum((p - q) ** 2 for p, q in zip(a, b))
        assert d == pytest.approx(math.acosh(1 + 2 * gap / ((1 - n(a)) * (1 - n(b)))))
    assert got[2] == 0 and got[3] == got[4] == math.inf


def test_squared_euclidean(spark):
    want = [[1, 16], [4, 17], [9, 20]]
    for i, x in enumerate(([2.0, 0.0], [3.0, 0.0], [4.0, 0.0])):
        for j, y in enumerate(([1.0, 0.0], [2.0, 4.0])):
            expanded = v.euclidean_sq_expanded(v.vec_norm_sq("x"), v.vec_norm_sq("y"), v.vec_dot("x", "y"))
            assert one(spark, v.euclidean_sq("x", "y"), x=x, y=y) == want[i][j] == one(spark, expanded, x=x, y=y)


def test_guards(spark):
    assert one(spark, g.remove_nan_grad("g"), g=[float("nan"), math.inf, 2.0]) == [0.001, 0.001, 2.0]
    inside = one(spark, g.project_to_ball("x"), x=[3.0, -4.0])
    assert math.hypot(*inside) == pytest.approx(1 - 1e-5) and inside[1] < 0
    assert one(spark, g.project_to_ball("x"), x=[0.3, -0.4]) == [0.3, -0.4]
    assert one(spark, v.l2_normalize("x"), x=[0.0, 0.0]) == [0.0, 0.0]
    assert one(spark, v.clip_by_norm("x", 1.0), x=[3.0, 4.0]) == pytest.approx([0.6, 0.8])
    assert one(spark, g.cartesian_to_polar("a", "b"), a=0.0, b=0.0) == [0.0, 0.0]
    assert one(spark, g.polar_theta_grad_scale("a", "b"), a=1.0, b=0.0) is None
    assert one(spark, g.sigmoid_xent("a", 1.0), a=-1000.0) == 1000.0
    assert one(spark, g.arctanh("a"), a=0.5) == pytest.approx(math.atanh(0.5))


def test_start_vectors_lie_where_they_should(spark):
    ids = spark.range(200)
    out = ids.select(g.init_hyperboloid("s", "id", 3).alias("h"), g.init_uniform("s", "id", 4).alias("u"),
                     g.init_poincare_disc("s", "id").alias("d"), g.init_polar("s", "id").alias("p")).collect()
    for r in out:
        assert mink(r["h"], r["h"]) == pytest.approx(-1)
        assert all(abs(c) <= 0.125 for c in r["u"])
        assert 0 <= r["d"][0] < 1 and 0 <= r["d"][1] < 2 * math.pi
        assert 1.0 <= r["p"][0] < 1.5
    again = ids.repartition(7).select(F.sum(g.init_uniform("s", "id", 4)[0])).first()[0]
    assert again == pytest.approx(sum(r["u"][0] for r in out))

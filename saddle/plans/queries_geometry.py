"""Vector and geometry functions over the embeddings table and derived coordinates."""
from __future__ import annotations

from pyspark.sql import functions as F

from saddle.functions import geometry as g
from saddle.functions import vectors as v
from saddle.functions.uniform import uniform_sql
from saddle.operators.corpus import make_batches
from saddle.operators.negatives import negative_samples, noise_distribution
from saddle.operators.vectors import pairwise_block
from saddle.plans.negatives_sql import batches_sql, negatives_sql
from saddle.plans.registry import query, r, rs, vec_rows, vec_rows_sql
from saddle.plans.tables import (
    EDGES, PRODUCT_VOCAB, VIEWS, WIDTH, product_vocab, start_sql, start_vectors, table, uniform_array_sql, vector_pairs,
    vector_pairs_sql, view_edges, views,
)
from saddle.skew import lookup_join
from saddle.storage import materialise

D = WIDTH


def _scalar(name, column, expression, scale=1.0, digits=6):
    """A function of neighbouring vectors giving one number per id."""

    @query(name, f"WITH {vector_pairs_sql(scale)} SELECT id, {rs(expression, digits)} AS value FROM vpairs")
    def _run(spark, sf):
        return vector_pairs(spark, sf, scale).select("id", r(column(), digits).alias("value"))


def _vector(name, column, expression, scale=1.0, digits=6):
    """A function of neighbouring vectors giving a vector per id."""

    @query(name, f"WITH {vector_pairs_sql(scale)}, outv AS (SELECT id, {expression} AS w FROM vpairs) {vec_rows_sql('outv', ['id'], 'w', digits)}")
    def _run(spark, sf):
        return vec_rows(vector_pairs(spark, sf, scale).select("id", column().alias("w")), ["id"], "w", digits)


_DOT = "list_dot_product(x, y)"
_NX = "list_dot_product(x, x)"
_NY = "list_dot_product(y, y)"
_GAP = "list_sum(list_transform(list_zip(x, y), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
_MDOT = f"({_DOT} - 2 * x[1] * y[1])"

# -- basics --------------------------------------------------------------------------------
_scalar("vec_dot", lambda: v.vec_dot("x", "y", D), _DOT)
_scalar("vec_norm", lambda: v.vec_norm("x", D), f"sqrt({_NX})")
_vector("vec_add", lambda: v.vec_add("x", "y"), "list_transform(list_zip(x, y), lambda p: p[1] + p[2])")
_vector("vec_scale", lambda: v.vec_scale("x", 2.5), "list_transform(x, lambda a: a * 2.5)")
_vector("l2_normalize", lambda: v.l2_normalize(v.vec_add("x", "y")),
        "list_transform(list_zip(x, y), lambda p: (p[1] + p[2]) / "
        "sqrt(list_sum(list_transform(list_zip(x, y), lambda q: (q[1] + q[2]) * (q[1] + q[2])))))")
_vector("clip_by_norm", lambda: v.clip_by_norm(v.vec_scale("x", F.when(F.col("id") % 2 == 0, 3.0).otherwise(0.5)), 1.0),
        f"CASE WHEN id % 2 = 0 THEN list_transform(x, lambda a: a * 3.0 / (3.0 * sqrt({_NX}))) ELSE list_transform(x, lambda a: a * 0.5) END")

# -- distances -----------------------------------------------------------------------------
_scalar("poincare_distance", lambda: g.poincare_distance("x", "y", D),
        f"CASE WHEN {_NX} < 1 AND {_NY} < 1 THEN acosh(1 + 2 * {_GAP} / ((1 - {_NX}) * (1 - {_NY}))) ELSE 'inf'::DOUBLE END", 0.5)
_scalar("minkowski_dot", lambda: g.minkowski_dot("x", "y", D), _MDOT)


def _hyper_sql(name):
    s = f"list_dot_product({name}, {name})"
    return f"list_concat([sqrt(1 + {s})], {name})"


def _lorentz(spark, sf):
    return vector_pairs(spark, sf).select("id", g.lift_to_hyperboloid("x").alias("x"), g.lift_to_hyperboloid("y").alias("y"))


_LORENTZ = f"{vector_pairs_sql()}, lp AS (SELECT id, {_hyper_sql('x')} AS x, {_hyper_sql('y')} AS y FROM vpairs)"


@query("minkowski_distance", f"WITH {_LORENTZ} SELECT id, {rs(f'acosh(greatest(-{_MDOT}, 1.0))')} AS value, "
       f"{rs(f'acosh(greatest(-{_MDOT}, 2.5))')} AS with_margin FROM lp")
def _minkowski_distance(spark, sf):
    p = _lorentz(spark, sf)
    return p.select("id", r(g.minkowski_distance("x", "y", 0.0, D + 1)).alias("value"),
                    r(g.minkowski_distance("x", "y", 1.5, D + 1)).alias("with_margin"))


# -- all pairs inside a batch: the batch's products against its shared negatives --------------

_BLOCK = (f"{VIEWS}, {EDGES}, {PRODUCT_VOCAB}, {start_sql(2, 0.5)}, {batches_sql(256)}, {negatives_sql(5)}, "
          "blk AS (SELECT DISTINCT b.batch_id, b.y AS a, n.id AS c, p.w_in AS x, q.w_out AS y FROM batches b "
          "JOIN negatives n ON b.batch_id = n.batch_id JOIN state p ON p.id = b.y JOIN state q ON q.id = n.id)")


def _block(spark, sf):
    # written once each: every later step reads the small result
    seen = materialise(views(spark, sf))
    state = materialise(start_vectors(spark, sf, 2, 0.5, seen))
    edges = view_edges(spark, sf, seen).select(F.col("src").alias("x"), F.col("dst").alias("y"))
    batches = materialise(make_batches(edges, 256, ["x", "y"]))
    negatives = materialise(negative_samples(batches, noise_distribution(product_vocab(spark, sf, seen), id_col="token"), 5))
    members = batches.select("batch_id", F.col("y").alias("id")).distinct()
    left = lookup_join(members, state, "id").select("batch_id", "id", F.col("w_in").alias("v"))
    right = lookup_join(negatives, state, "id").select("batch_id", "id", F.col("w_out").alias("v"))
    return pairwise_block(left, right)


def _pairwise(name, column, expression):
    @query(name, f"WITH {_BLOCK} SELECT batch_id, a, c, {rs(expression)} AS value FROM blk")
    def _run(spark, sf):
        return _block(spark, sf).select("batch_id", F.col("x").alias("a"), F.col("y").alias("c"), r(column()).alias("value"))


def _expanded():
    return v.euclidean_sq_expanded(v.vec_norm_sq("vx", 2), v.vec_norm_sq("vy", 2), v.vec_dot("vx", "vy", 2))


_pairwise("euclidean_sq_pairwise", _expanded, f"greatest({_NX} + {_NY} - 2 * {_DOT}, 0.0)")
_pairwise("poincare_distance_pairwise",
          lambda: g.poincare_from_parts(_expanded(), v.vec_norm_sq("vx", 2), v.vec_norm_sq("vy", 2)),
          f"acosh(greatest(1 + 2 * ({_NX} + {_NY} - 2 * {_DOT}) / ((1 - {_NX}) * (1 - {_NY})), 1.0))")
_pairwise("minkowski_dot_pairwise", lambda: g.minkowski_dot("vx", "vy", 2), _MDOT)
_LIFT = "({0}[1] * {1}[1] + {0}[2] * {1}[2] - sqrt(1 + list_dot_product({0}, {0})) * sqrt(1 + list_dot_product({1}, {1})))".format("x", "y")
_pairwise("minkowski_distance_pairwise",
          lambda: g.minkowski_distance(g.lift_to_hyperboloid("vx"), g.lift_to_hyperboloid("vy")),
          f"acosh(greatest(-{_LIFT}, 1.0))")
_pairwise("polar_inner_pairwise",
          lambda: g.polar_inner(F.col("vx")[0], F.col("vx")[1], F.col("vy")[0], F.col("vy")[1]),
          "x[1] * y[1] * cos(x[2] - y[2])")

# -- coordinates ---------------------------------------------------------------------------
_scalar("polar_inner", lambda: g.polar_inner(F.col("x")[0], F.col("x")[1], F.col("y")[0], F.col("y")[1]),
        "x[1] * y[1] * cos(x[2] - y[2])")
_vector("polar_to_poincare", lambda: g.polar_to_poincare(F.col("x")[0], F.col("x")[1]),
        "[tanh(x[1] / 2) * cos(x[2]), tanh(x[1] / 2) * sin(x[2])]")
_vector("cartesian_to_polar", lambda: g.cartesian_to_polar(F.col("x")[0], F.col("x")[1]),
        "[sqrt(x[1] * x[1] + x[2] * x[2]), atan2(x[2], x[1])]")
_vector("poincare_to_hyperboloid", lambda: g.poincare_to_hyperboloid("x"),
        f"list_concat([(1 + {_NX}) / (1 - {_NX})], list_transform(x, lambda a: 2 * a / (1 - {_NX})))", 0.5)
_vector("hyperboloid_to_poincare", lambda: g.hyperboloid_to_poincare(g.lift_to_hyperboloid("x")),
        f"list_transform(x, lambda a: a / (sqrt(1 + {_NX}) + 1))")
_vector("project_to_hyperboloid", lambda: g.project_to_hyperboloid("x"),
        "list_concat([sqrt(1 + list_dot_product(x[2:], x[2:]))], x[2:])")
_vector("project_to_ball", lambda: g.project_to_ball(v.vec_scale("x", F.when(F.col("id") % 2 == 0, 2.0).otherwise(0.25)), 1e-5),
        f"CASE WHEN id % 2 = 0 THEN list_transform(x, lambda a: a * 2.0 * 0.99999 / (2.0 * sqrt({_NX}))) "
        "ELSE list_transform(x, lambda a: a * 0.25) END")

# -- Riemannian steps ----------------------------------------------------------------------


def _lorentz_vector(name, column, expression):
    @query(name, f"WITH {_LORENTZ}, outv AS (SELECT id, {expression} AS w FROM lp) {vec_rows_sql('outv', ['id'], 'w')}")
    def _run(spark, sf):
        return vec_rows(_lorentz(spark, sf).select("id", column().alias("w")), ["id"], "w")


_lorentz_vector("tangent_projection", lambda: g.tangent_projection("x", "y"),
                f"list_transform(list_zip(x, y), lambda p: p[2] + {_MDOT} * p[1])")
_TAN = f"{_LORENTZ}, tp AS (SELECT id, x, list_transform(list_zip(x, y), lambda p: 0.1 * (p[2] + {_MDOT} * p[1])) AS t FROM lp), "\
       "tn AS (SELECT *, sqrt(greatest(list_dot_product(t, t) - 2 * t[1] * t[1], 0.0)) AS n FROM tp), "\
       "mv AS (SELECT id, list_transform(list_zip(x, t), lambda p: cosh(n) * p[1] + sinh(n) * p[2] / n) AS m FROM tn), "\
       "outv AS (SELECT id, list_concat([sqrt(1 + list_dot_product(m[2:], m[2:]))], m[2:]) AS w FROM mv)"


@query("exp_map", f"WITH {_TAN} {vec_rows_sql('outv', ['id'], 'w')}")
def _exp_map(spark, sf):
    p = _lorentz(spark, sf)
    tangent = v.vec_scale(g.tangent_projection("x", "y"), 0.1)
    moved = p.withColumn("t", tangent).select("id", g.exp_map("x", "t").alias("w"))
    return vec_rows(moved, ["id"], "w")


_vector("metric_transform", lambda: g.metric_transform("x"), "list_concat([-x[1]], x[2:])")
_vector("poincare_grad_scale", lambda: g.poincare_grad_scale("x", "y"),
        f"list_transform(y, lambda a: a * (1 - {_NX}) * (1 - {_NX}) / 4)", 0.5)


@query("polar_theta_grad_scale", f"WITH {vector_pairs_sql()} SELECT id, {rs('x[1] / sqrt(list_dot_product(y, y))')} AS flat, "
       f"{rs('x[1] / sinh(sqrt(list_dot_product(y, y)))')} AS hyperbolic FROM vpairs")
def _theta(spark, sf):
    radius = v.vec_norm("y", D)
    return vector_pairs(spark, sf).select(
        "id", r(g.polar_theta_grad_scale(F.col("x")[0], radius)).alias("flat"),
        r(g.polar_theta_grad_scale(F.col("x")[0], radius, True)).alias("hyperbolic"))


_vector("remove_nan_grad",
        lambda: g.remove_nan_grad(F.transform("x", lambda a, i: F.when(i == 3, F.lit(float("nan"))).when(i == 5, F.lit(g.INF)).otherwise(a))),
        "list_concat(x[1:3], [0.001], x[5:5], [0.001], x[7:])")
_scalar("arctanh", lambda: g.arctanh(F.col("x")[0]), "0.5 * ln((1 + x[1]) / (1 - x[1]))")
_scalar("sinh", lambda: F.sinh(F.col("x")[0] * 4), "sinh(x[1] * 4)")
_scalar("sigmoid", lambda: g.sigmoid(F.col("x")[0] * 8), "1 / (1 + exp(-x[1] * 8))")
_scalar("sigmoid_xent", lambda: g.sigmoid_xent(v.vec_dot("x", "y", D) * 5, F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.0)),
        f"greatest(5 * {_DOT}, 0) - 5 * {_DOT} * (CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END) + ln(1 + exp(-abs(5 * {_DOT})))")

# -- start vectors -------------------------------------------------------------------------
_IDS = "ids AS (SELECT p_partkey AS id FROM part)"


def _init(name, column, expression):
    @query(name, f"WITH {_IDS}, outv AS (SELECT id, {expression} AS w FROM ids) {vec_rows_sql('outv', ['id'], 'w')}")
    def _run(spark, sf):
        ids = table(spark, sf, "part").select(F.col("p_partkey").alias("id"))
        return vec_rows(ids.select("id", column().alias("w")), ["id"], "w")


_init("init_uniform", lambda: g.init_uniform(7, "id", 4), uniform_array_sql("7", "id", 4, 0.125))
_init("init_poincare_disc", lambda: g.init_poincare_disc(7, "id"),
      f"[sqrt({uniform_sql(7, 'id', '1')}), 2 * pi() * {uniform_sql(7, 'id', '2')}]")
_U4 = uniform_array_sql("7", "id", 4, 0.125)
_init("init_hyperboloid", lambda: g.init_hyperboloid(7, "id", 4), f"list_concat([sqrt(1 + list_dot_product({_U4}, {_U4}))], {_U4})")
_init("init_polar", lambda: g.init_polar(7, "id"),
      f"[0.5 * {uniform_sql(7, 'id', '1')} + 1.0, asin(0.25 / 1.25) * {uniform_sql(7, 'id', '2')}]")

"""Loss, gradients, trainers, classifiers and sweeps."""
from __future__ import annotations

from pyspark.sql import functions as F

from saddle.operators import cells, nce
from saddle.operators.corpus import make_batches, skipgram_pairs, view_cooccurrence, view_followers
from saddle.operators.negatives import negative_samples, noise_distribution
from saddle.operators.sentences import random_walks, walk_tokens
from saddle.functions.uniform import uniform_sql
from saddle.plans import evaluation as ev
from saddle.plans import sweeps, training as tr
from saddle.plans.negatives_sql import batches_sql, negatives_sql
from saddle.plans.registry import query, r, rs, vec_rows, vec_rows_sql
from saddle.plans.tables import (
    CUSTOMER_SENTENCES, EDGES, GRAPH, OFFSET, PRODUCT_VOCAB, VIEWS, product_sentences, product_vocab, scratch, start_sql, start_vectors, table,
    vectors, view_graph, views,
)
from saddle.plans.training_sql import final_sql, log_sql, training_sql
from saddle.plans.walks_sql import walks_sql
from saddle.storage import materialise

# -- one step, checked against SQL ---------------------------------------------------------
BATCH = 512
_PAIRS = ("(SELECT DISTINCT token AS x, y FROM (SELECT token, lead(token) OVER (PARTITION BY sentence_id ORDER BY pos) AS y FROM sent) "
          "WHERE y IS NOT NULL AND y <> token)")
_ROWS = f"""{VIEWS}, {CUSTOMER_SENTENCES}, {PRODUCT_VOCAB}, {start_sql(2, 0.5)}, {batches_sql(BATCH, _PAIRS)}, {negatives_sql(5)},
 rws AS (SELECT batch_id, x, y AS t, 1.0 AS label FROM batches UNION ALL
   SELECT b.batch_id, x, n.id, 0.0 FROM batches b JOIN negatives n ON b.batch_id = n.batch_id),
 vec AS (SELECT batch_id, x, t, label, p.w_in AS u, q.w_out AS v, q.b AS b FROM rws JOIN state p ON p.id = x JOIN state q ON q.id = t)"""
# the Poincare gradient through d(dist)/dx = (d gamma / dx) / sqrt(gamma^2 - 1), written out from the quotient rule
_GRADS = f"""{_ROWS}, part AS (SELECT *, list_dot_product(u, u) AS uu, list_dot_product(v, v) AS vv,
   (u[1] - v[1]) ** 2 + (u[2] - v[2]) ** 2 AS dd FROM vec),
 gam AS (SELECT *, 1 + 2 * dd / ((1 - uu) * (1 - vv)) AS gamma FROM part),
 err AS (SELECT *, -acosh(gamma) + b AS logit, sqrt(gamma * gamma - 1) AS root FROM gam),
 sg AS (SELECT *, 1 / (1 + exp(-logit)) - label AS e FROM err),
 g AS (SELECT *,
   -e * (4 * (u[1] - v[1]) / ((1 - uu) * (1 - vv)) + 4 * dd * u[1] / ((1 - uu) ** 2 * (1 - vv))) / root AS gu1,
   -e * (4 * (u[2] - v[2]) / ((1 - uu) * (1 - vv)) + 4 * dd * u[2] / ((1 - uu) ** 2 * (1 - vv))) / root AS gu2,
   -e * (4 * (v[1] - u[1]) / ((1 - uu) * (1 - vv)) + 4 * dd * v[1] / ((1 - vv) ** 2 * (1 - uu))) / root AS gv1,
   -e * (4 * (v[2] - u[2]) / ((1 - uu) * (1 - vv)) + 4 * dd * v[2] / ((1 - vv) ** 2 * (1 - uu))) / root AS gv2 FROM sg),
 sides AS (SELECT batch_id, x AS id, gu1 AS a1, gu2 AS a2, 0.0 AS c1, 0.0 AS c2, 0.0 AS cb FROM g UNION ALL
   SELECT batch_id, t, 0.0, 0.0, gv1, gv2, e FROM g)"""


def _step(spark, sf):
    # written once each: every later step reads the small result
    seen = materialise(views(spark, sf))
    batches = materialise(make_batches(product_pairs(spark, sf, seen), BATCH, ["x", "y"]))
    state = materialise(start_vectors(spark, sf, 2, 0.5, seen))
    negatives = negative_samples(batches, noise_distribution(product_vocab(spark, sf, seen), id_col="token"), 5)
    return batches, materialise(negatives), state


def product_pairs(spark, sf, seen=None):
    """Distinct products that follow each other in a customer's views."""
    return view_followers(views(spark, sf) if seen is None else seen, 1).where("y <> x").select("x", "y").distinct()


_XENT = "greatest(logit, 0) - logit * label + ln(1 + exp(-abs(logit)))"


@query("nce_loss", f"WITH {_GRADS} SELECT batch_id, {rs(f'sum({_XENT}) / {BATCH}')} AS loss FROM sg GROUP BY batch_id")
def _loss(spark, sf):
    return nce.nce_loss(nce.nce_rows(*_step(spark, sf)), nce.Logit("poincare"), BATCH).withColumn("loss", r("loss"))


@query("nce_gradients", f"WITH {_GRADS} SELECT batch_id, id, {rs(f'sum(a1) / {BATCH}')} AS gi1, {rs(f'sum(a2) / {BATCH}')} AS gi2, "
       f"{rs(f'sum(c1) / {BATCH}')} AS go1, {rs(f'sum(c2) / {BATCH}')} AS go2, {rs(f'sum(cb) / {BATCH}')} AS gb FROM sides GROUP BY 1, 2")
def _gradients(spark, sf):
    out = cells.batch_gradients(*_step(spark, sf), nce.Logit("poincare"), BATCH)
    return out.select("batch_id", "id", r(F.col("g_in")[0]).alias("gi1"), r(F.col("g_in")[1]).alias("gi2"),
                      r(F.col("g_out")[0]).alias("go1"), r(F.col("g_out")[1]).alias("go2"), r("g_b").alias("gb"))


# -- trainers ------------------------------------------------------------------------------
SHORT = dict(epochs=1, rounds=2, learning_rate=0.5, window=2)


def _pairs(spark, sf, window=2):
    return view_cooccurrence(views(spark, sf), window)


def _training(params):
    return (f"WITH {VIEWS}, {CUSTOMER_SENTENCES}, co AS (SELECT a.token AS x, b.token AS y, count(*) AS n FROM sent a JOIN sent b "
            f"ON a.sentence_id = b.sentence_id AND abs(a.pos - b.pos) <= {params.window} WHERE a.token <> b.token GROUP BY 1, 2), {training_sql(params, 'co')}")


def _trainer(name, geometry):
    params = tr.Params(geometry=geometry, **SHORT)

    @query(name, f"{_training(params)} {final_sql(params)}")
    def _run(spark, sf):
        run = tr.train(lambda: _pairs(spark, sf), params)
        return run.vectors().select("id", r(F.col("v")[0]).alias("v1"), r(F.col("v")[1]).alias("v2"))


_trainer("train_euclidean", "euclidean")
_trainer("train_polar", "polar")
_trainer("train_polar_hyperbolic", "polar_hyperbolic")
_trainer("train_poincare", "poincare")
_trainer("train_lorentz", "lorentz")


# fixed values: the window and epochs of the published runs
_FULL = tr.Params(geometry="poincare", window=5, epochs=5, rounds=2, learning_rate=0.2)


@query("train_poincare_full", f"{_training(_FULL)} {final_sql(_FULL)}")
def _full(spark, sf):
    """A whole training: window 5, five epochs of two rounds."""
    run = tr.train(lambda: _pairs(spark, sf, _FULL.window), _FULL)
    return run.vectors().select("id", r(F.col("v")[0]).alias("v1"), r(F.col("v")[1]).alias("v2"))


# fixed values: walks, window and epochs of the reference (src/python/graph.py:105,136)
_FLAT = tr.Params(geometry="euclidean", size=4, window=5, epochs=5, rounds=2, learning_rate=0.5)
NUM_WALKS, WALK_LENGTH = 10, 80
_DEEPWALK = f"""{walks_sql(f'{VIEWS}, {EDGES}, {OFFSET}, {GRAPH}', NUM_WALKS, WALK_LENGTH, '0-walk')},
 wt AS (SELECT start || ':' || walk_no AS s, unnest(path) AS token, generate_subscripts(path, 1) AS pos FROM walks),
 co AS (SELECT a.token AS x, b.token AS y, count(*) AS n FROM wt a JOIN wt b ON a.s = b.s AND abs(a.pos - b.pos) <= {_FLAT.window}
   WHERE a.token <> b.token GROUP BY 1, 2),
 {training_sql(_FLAT, 'co')}, outv AS (SELECT id, w_in AS v FROM st{_FLAT.epochs * _FLAT.rounds}) {vec_rows_sql('outv', ['id'], 'v')}"""


@query("train_deepwalk", _DEEPWALK)
def _deepwalk(spark, sf):
    """A whole DeepWalk: ten walks of 80 vertices from every vertex, window 5, five epochs of two rounds."""
    run = tr.train_deepwalk(view_graph(spark, sf), _FLAT, NUM_WALKS, WALK_LENGTH)
    return vec_rows(run.vectors(), ["id"], "v")


def _types(spark, sf):
    """Product classes by type."""
    p = table(spark, sf, "part")
    kinds = F.array(*[F.lit(k) for k in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")])
    return p.select(F.col("p_partkey").alias("id"), (F.array_position(kinds, F.col("p_type")) - 1).cast("int").alias("y"))


@query("train_warm_start")
def _warm(spark, sf):
    pairs = materialise(_pairs(spark, sf))
    first = tr.train(pairs, tr.Params(**SHORT))
    second = tr.train(pairs, tr.Params(**{**SHORT, "seed": "1"}), init=first.state)
    labels = _types(spark, sf)
    return ev.transfer(sweeps.labelled(first, labels), sweeps.labelled(second, labels), ev.CLASSIFIERS["logistic_multinomial"])


@query("training_stats", f"{_training(tr.Params(**SHORT))} {log_sql(tr.Params(**SHORT))}")
def _stats(spark, sf):
    stats = tr.train(lambda: _pairs(spark, sf), tr.Params(**SHORT)).stats(spark)
    return stats.select("epoch", "step", r("lr").alias("lr"), r("loss").alias("loss"), r("pairs").alias("pairs"))


@query("save_state", f"{_training(tr.Params(**SHORT))} SELECT id, {rs('w_in[1]')} AS v1, true AS same FROM st2")
def _save(spark, sf):
    """Two rounds saved, the last one redone from the save: both end in the same state."""
    pairs, params = materialise(_pairs(spark, sf)), tr.Params(**SHORT)
    folder = scratch(spark, "states")
    whole = tr.train(pairs, params, save_to=folder)
    early, done = tr.saved_state(spark, folder, 1)
    again = tr.train(pairs, params, init=early, start_step=done)
    gap = whole.state.join(again.state.select("id", F.col("w_in").alias("again")), "id")
    return gap.select("id", r(F.col("w_in")[0]).alias("v1"), (F.abs(F.col("w_in")[0] - F.col("again")[0]) < 1e-9).alias("same"))


_PER_PAIR = tr.Params(geometry="lorentz", per_pair=True, **SHORT)


@query("train_per_pair_negatives", f"{_training(_PER_PAIR)} {final_sql(_PER_PAIR)}")
def _per_pair(spark, sf):
    """Every pair draws its own negatives; its own label is skipped."""
    run = tr.train(lambda: _pairs(spark, sf), _PER_PAIR)
    return run.vectors().select("id", r(F.col("v")[0]).alias("v1"), r(F.col("v")[1]).alias("v2"))


_MIXED = tr.Params(geometry="poincare", **{**SHORT, "rounds": 4})
_ROUND = 1024
_MIXED_SQL = f"""{walks_sql(f'{VIEWS}, {EDGES}, {OFFSET}, {GRAPH}', 2, 10, '0-walk')},
 wt AS (SELECT start || ':' || walk_no AS s, unnest(path) AS token, generate_subscripts(path, 1) AS pos FROM walks),
 wp AS (SELECT a.token AS x, b.token AS y FROM wt a JOIN wt b ON a.s = b.s AND abs(a.pos - b.pos) <= 2 WHERE a.token <> b.token),
 fe AS (SELECT src AS x, dst AS y, row_number() OVER (ORDER BY {uniform_sql('batch', 'src', 'dst')}, src, dst) - 1 AS spot FROM graph),
 fw AS (SELECT x, y, row_number() OVER (ORDER BY {uniform_sql('batch', 'x', 'y')}, x, y) - 1 AS spot FROM wp),
 co AS (SELECT CAST(place // {_ROUND} AS INTEGER) AS round, x, y, count(*) AS n FROM (
   SELECT place, x, y FROM range({2 * _ROUND}) AS r(place) JOIN fe ON spot = place % (SELECT count(*) FROM fe) UNION ALL
   SELECT place + {2 * _ROUND}, x, y FROM range({2 * _ROUND}) AS r(place) JOIN fw ON spot = place % (SELECT count(*) FROM fw)) GROUP BY ALL),
 {training_sql(_MIXED, 'co', scheduled=True)} {final_sql(_MIXED)}"""


@query("train_mixed_schedule", _MIXED_SQL)
def _mixed(spark, sf):
    """Two rounds on edges, then two on pairs of walks over the same graph."""
    graph = materialise(view_graph(spark, sf))
    walks = materialise(random_walks(graph, 2, 10, "0-walk"))
    pairs = skipgram_pairs(walk_tokens(walks), 2).select("x", "y")
    run = tr.train_mixed(graph.select(F.col("src").alias("x"), F.col("dst").alias("y")), pairs, _MIXED, _ROUND)
    return run.vectors().select("id", r(F.col("v")[0]).alias("v1"), r(F.col("v")[1]).alias("v2"))


# -- sweeps --------------------------------------------------------------------------------
# fixed values: the settings compared
BATCHES, WINDOWS, SIZES = [1, 2, 4, 8, 16, 32, 64, 128], list(range(1, 10)), [2, 4, 8, 16, 32, 64, 128]


def _rounded(scores):
    return scores.select(*[r(f.name).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in scores.schema])


@query("sweep_batch_size")
def _sweep_batch(spark, sf):
    return _rounded(sweeps.sweep_batch_size(lambda: _pairs(spark, sf), _types(spark, sf), tr.Params(**SHORT), BATCHES))


@query("sweep_window")
def _sweep_window(spark, sf):
    return _rounded(sweeps.sweep_window(materialise(product_sentences(spark, sf)), _types(spark, sf), tr.Params(**SHORT), WINDOWS))


@query("sweep_size")
def _sweep_size(spark, sf):
    return _rounded(sweeps.sweep_size(lambda: _pairs(spark, sf), _types(spark, sf), tr.Params(**SHORT), SIZES))


@query("sweep_deepwalk_grid")
def _sweep_grid(spark, sf):
    classes = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 5).cast("int").alias("y"))
    return _rounded(sweeps.sweep_deepwalk_grid(view_graph(spark, sf), classes, tr.Params(**SHORT), [2, 8, 32], [1, 2, 4], [5, 10, 20]))


@query("repeat_embeddings")
def _repeat(spark, sf):
    """Ten starts with five negatives and ten with eight."""
    pairs, labels = materialise(_pairs(spark, sf)), _types(spark, sf)
    seeds = [str(i) for i in range(10)]
    parts = [sweeps.repeat_embeddings(pairs, labels, tr.Params(negatives=k, **SHORT), seeds).withColumn("negatives", F.lit(k)) for k in (5, 8)]
    return _rounded(parts[0].unionByName(parts[1]))

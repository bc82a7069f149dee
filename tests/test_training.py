"""Gradients against finite differences, and the training loop's promises."""
import math
from pathlib import Path
from urllib.parse import urlparse

import duckdb
import pytest
from pyspark.sql import functions as F

from saddle.operators import nce
from saddle.operators.corpus import cooccurrence
from saddle.plans import training as tr
from saddle.plans.tables import product_sentences
from saddle.plans.training_sql import training_sql
from saddle.storage import materialise, shared_folder


def point(geometry, a, b):
    if geometry == "lorentz":
        return [math.sqrt(1 + a * a + b * b), a, b]
    return [a, b]


@pytest.mark.parametrize("geometry", nce.GEOMETRIES)
@pytest.mark.parametrize("label", [0.0, 1.0])
def test_gradients_match_differences(spark, geometry, label):
    logit = nce.Logit(geometry, 2)
    x, y, b, h, w = point(geometry, 0.31, 0.22), point(geometry, -0.15, 0.4), 0.1, 1e-6, 3.0
    cases = [(x, y, b)]
    for i in range(len(x)):
        for s in (h, -h):
            cases.append(([c + s * (j == i) for j, c in enumerate(x)], y, b))
    for i in range(len(y)):
        for s in (h, -h):
            cases.append((x, [c + s * (j == i) for j, c in enumerate(y)], b))
    cases += [(x, y, b + h), (x, y, b - h)]
    rows = spark.createDataFrame([(k, 2 * k, 2 * k + 1, u, v, c, label, w) for k, (u, v, c) in enumerate(cases)],
                                 "k int, x bigint, t bigint, vx array<double>, vy array<double>, b double, label double, w double")
    loss = {r["k"]: r["xent"] for r in nce.scored(rows, logit).select("k", "xent").collect()}
    slopes = [(loss[k] - loss[k + 1]) / (2 * h) for k in range(1, len(cases), 2)]
    got = {r["id"]: r for r in nce.summed_gradients(rows.where("k = 0"), logit).collect()}
    d = len(x)
    assert list(got[0]["g_in"]) == pytest.approx(slopes[:d], abs=1e-5)
    assert list(got[1]["g_out"]) == pytest.approx(slopes[d:2 * d], abs=1e-5)
    assert got[1]["g_b"] == pytest.approx(slopes[2 * d], abs=1e-5)


def test_equal_points_give_finite_gradients(spark):
    for geometry in ("poincare", "lorentz"):
        p = point(geometry, 0.0, 0.3)
        rows = spark.createDataFrame([(1, 2, p, p, 0.0, 1.0, 1.0)],
                                     "x bigint, t bigint, vx array<double>, vy array<double>, b double, label double, w double")
        for r in nce.summed_gradients(rows, nce.Logit(geometry)).collect():
            assert all(math.isfinite(c) for c in (*r["g_in"], *r["g_out"], r["g_b"]))


@pytest.mark.parametrize("geometry", ["euclidean", "poincare", "lorentz"])
def test_blocks_of_coordinates_give_the_same_sums(spark, monkeypatch, geometry):
    """A remainder in the last block, a vertex on both sides and vertices on one side only."""
    def vector(k):
        v = [math.sin(k + i) / 7 for i in range(5)]
        return [math.sqrt(1 + sum(a * a for a in v)), *v] if geometry == "lorentz" else v

    rows = spark.createDataFrame([(k % 3, 1, (5 * k) % 4 + 2 * (k % 2), vector(k % 3), vector(9 + k), 0.1 * k, float(k % 2), 1.0 + k) for k in range(12)],
                                 "run int, x bigint, t bigint, vx array<double>, vy array<double>, b double, label double, w double")
    logit = nce.Logit(geometry, 5)
    whole = {(r["run"], r["id"]): r for r in nce.summed_gradients(rows, logit, ["run"]).collect()}
    monkeypatch.setattr(nce, "BLOCK", 2)
    cut = {(r["run"], r["id"]): r for r in nce.summed_gradients(rows, logit, ["run"]).collect()}
    assert cut.keys() == whole.keys() and len(cut) > 6
    for key, r in cut.items():
        for c in r.asDict():
            assert r[c] == pytest.approx(whole[key][c], abs=1e-12), (key, c)


@pytest.mark.parametrize("geometry", ["euclidean", "poincare", "lorentz"])
def test_wide_vectors_against_sql(spark, geometry):
    params = tr.Params(geometry=geometry, size=20, epochs=1, rounds=2, learning_rate=0.5)
    rows = [(x, (x * k + k) % 40, k) for x in range(40) for k in (1, 2, 3) if x != (x * k + k) % 40]
    run = tr.train(spark.createDataFrame(rows, "x bigint, y bigint, n bigint"), params)
    con = duckdb.connect()
    con.execute("CREATE TABLE given (x BIGINT, y BIGINT, n BIGINT)")
    con.executemany("INSERT INTO given VALUES (?, ?, ?)", rows)
    want = {i: (w_in, w_out) for i, w_in, w_out in con.execute(f"WITH {training_sql(params, 'given')} SELECT id, w_in, w_out FROM st2").fetchall()}
    got = {r["id"]: r for r in run.state.collect()}
    assert got.keys() == want.keys()
    start = {r["id"]: r["w_in"] for r in tr.initial_state(run.state.selectExpr("0 AS run", "id"), [params]).collect()}
    assert any(list(start[i]) != pytest.approx(list(r["w_in"]), abs=1e-6) for i, r in got.items())
    for i, r in got.items():
        assert len(r["w_in"]) == params.logit.width
        assert list(r["w_in"]) == pytest.approx(list(want[i][0]), abs=1e-9) and list(r["w_out"]) == pytest.approx(list(want[i][1]), abs=1e-9)


@pytest.fixture(scope="module")
def pairs(spark, small):
    return materialise(cooccurrence(product_sentences(spark, small), 2))


@pytest.mark.parametrize("geometry", nce.GEOMETRIES)
def test_loss_falls_on_the_manifold(spark, pairs, geometry):
    run = tr.train(pairs, tr.Params(geometry=geometry, epochs=2, rounds=2, learning_rate=0.5))
    assert run.log[-1]["loss"] < run.log[0]["loss"]
    rows = run.state.collect()
    assert all(math.isfinite(c) for r in rows for c in (*r["w_in"], *r["w_out"], r["b"]))
    for r in rows:
        for p in (r["w_in"], r["w_out"]):
            if geometry == "lorentz":
                assert -p[0] ** 2 + sum(c * c for c in p[1:]) == pytest.approx(-1)
            if geometry == "poincare":
                assert sum(c * c for c in p) < 1
            if geometry.startswith("polar"):
                assert p[0] > 0
    assert all(sum(c * c for c in r["v"]) < 1 for r in run.vectors().collect()) or geometry in ("euclidean", "polar")


def test_partitioning_and_joins_do_not_change_the_result(spark, pairs):
    params = tr.Params(epochs=1, rounds=2)
    a = tr.train(pairs, params).state
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        b = tr.train(pairs.repartition(5), params).state
        gap = a.join(b.select("id", F.col("w_in").alias("o")), "id").agg(
            F.count("*").alias("n"), F.max(F.abs(F.col("w_in")[0] - F.col("o")[0])).alias("gap")).first()
        assert gap["n"] == a.count() and gap["gap"] < 1e-9
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_a_step_of_a_walk_moves_no_edges(spark, tmp_path):
    """Edges stored by (vertex, neighbour number) meet walks without an exchange of their own."""
    from saddle.storage import bucketed

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        steps = bucketed(spark.range(1000).selectExpr("id % 50 AS cur", "id div 50 AS pick", "id AS next"), "cur", "pick")
        walks = spark.range(200).selectExpr("id % 50 AS cur", "id % 20 AS pick", "id AS start")
        joined = walks.join(steps, ["cur", "pick"])
        assert joined.count() == 200
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_only_the_last_state_stays(spark, pairs, tmp_path):
    """Neither tables nor files of earlier rounds, pairs and negatives are left; saved states are."""
    def left():
        return {t.name for t in spark.catalog.listTables() if t.name.startswith("saddle_")}, {p.name for p in Path(urlparse(shared_folder(spark)).path).glob("saddle_*")}

    tables, folders = left()
    run = tr.train(pairs, tr.Params(epochs=1, rounds=3))
    now_tables, now_folders = left()
    assert len(now_tables - tables) == 1 and now_tables - tables == now_folders - folders
    assert run.state.where("w_in IS NOT NULL").count() > 0
    tr.train(pairs, tr.Params(epochs=1, rounds=2), save_to=str(tmp_path / "kept"))
    assert left()[1] == now_folders and tr.saved_state(spark, str(tmp_path / "kept"), 1)[0].count() == run.state.count()


def test_resume_goes_on_where_it_stopped(spark, pairs, tmp_path):
    params = tr.Params(epochs=1, rounds=3)
    whole = tr.train(pairs, params, save_to=str(tmp_path / "a")).state
    state, done = tr.saved_state(spark, str(tmp_path / "a"), 1)
    rest = tr.train(pairs, params, init=state, start_step=done)
    assert len(rest.log) == 2
    gap = whole.join(rest.state.select("id", F.col("w_out").alias("o")), "id").agg(F.max(F.abs(F.col("w_out")[1] - F.col("o")[1]))).first()[0]
    assert gap < 1e-9


def test_warm_start_keeps_given_vectors(spark):
    ids = spark.range(4).withColumn("run", F.lit(0))
    init = spark.createDataFrame([(0, 1, [9.0, 9.0], [8.0, 8.0], 7.0)], "run int, id bigint, w_in array<double>, w_out array<double>, b double")
    out = {r["id"]: r for r in tr.warm_state(ids, [tr.Params(geometry="euclidean")], init).collect()}
    assert out[1]["w_in"] == [9.0, 9.0] and out[1]["b"] == 7.0 and abs(out[2]["w_in"][0]) <= 0.25


def test_classes_of_a_planted_graph_are_found(spark):
    """Two groups joined by few edges: the embedding alone tells them apart."""
    import random

    from saddle.operators.graph import edges_symmetrize
    from saddle.operators.sentences import random_walks, walk_tokens
    from saddle.plans import evaluation as ev

    rng = random.Random(0)
    rows = set()
    for i in range(40):
        for _ in range(6):
            j = rng.randrange(20) + (20 if i >= 20 else 0)
            if i != j:
                rows.add((min(i, j), max(i, j)))
    rows |= {(0, 20), (5, 30)}
    edges = edges_symmetrize(spark.createDataFrame(sorted(rows), "src bigint, dst bigint"))
    walks = materialise(random_walks(edges, 10, 10))
    run = tr.train_tokens(walk_tokens(walks), tr.Params(geometry="poincare", window=3, epochs=20, rounds=1, batch_size=1,
                                                        sets=64, learning_rate=4.0))
    data = run.vectors().withColumn("y", (F.col("id") >= 20).cast("int"))
    score = ev.cross_validate(ev.stratified_kfold(data, "y", "id", 2), ev.Linear(c=100.0), 2, "m")
    assert score.where("fold < 2").agg(F.avg("macro")).first()[0] > 0.75


def test_deepwalk_query_runs_the_whole_job(spark, tmp_path, monkeypatch):
    """Ten walks of 80 vertices from every vertex, window 5 and five epochs, as the reference has it."""
    from datetime import datetime

    from saddle.plans import catalog

    class Stop(Exception):
        pass

    seen = {}

    def caught(tokens, params, **kw):
        seen.update(params=params, walks=tokens.groupBy("sentence_id").count().collect(), starts=tokens.where("pos = 0").groupBy("token").count().collect())
        raise Stop

    orders = spark.createDataFrame([(1, 1), (2, 2)], "o_orderkey bigint, o_custkey bigint")
    lines = spark.createDataFrame([(o, p, datetime(2024, 1, o + p)) for o in (1, 2) for p in (1, 2)], "l_orderkey bigint, l_partkey bigint, l_shipdate timestamp_ntz")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(tr, "train_tokens", caught)
    with pytest.raises(Stop):
        catalog.QUERIES["train_deepwalk"](spark, str(tmp_path))
    assert len(seen["walks"]) == 4 * 10 and {r["count"] for r in seen["walks"]} == {80} and {r["count"] for r in seen["starts"]} == {10}
    assert (seen["params"].window, seen["params"].epochs, seen["params"].geometry) == (5, 5, "euclidean")

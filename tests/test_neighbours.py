"""Exact nearest neighbours for a table of queries, in several blocks of both sides."""
import numpy as np
import pytest

from oracle import compare, connect
from saddle.operators import neighbours
from saddle.plans import catalog


def small_blocks(monkeypatch):
    for name, value in (("BLOCK", 16), ("QUERIES", 7), ("RINGS", 5), ("ROWS_PER_PIVOT", 20)):
        monkeypatch.setattr(neighbours, name, value)


@pytest.mark.parametrize("metric", ["cosine", "poincare", "lorentz"])
def test_nearest_takes_a_table_of_queries(spark, monkeypatch, metric):
    small_blocks(monkeypatch)
    rng = np.random.default_rng(3)
    points = (rng.normal(size=(12, 4)).repeat(34, axis=0)[:400] * 0.3 + rng.normal(size=(400, 4)) * 0.05).round(2)
    points[40] = points[41] = points[300]  # ties
    points[50] = 0
    if metric == "poincare":
        points[60] = [2.0, 0, 0, 0]  # no point of the ball
    if metric == "lorentz":
        points = np.concatenate([np.sqrt(1 + (points ** 2).sum(1))[:, None], points], axis=1)
    emb = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id bigint, v array<double>").repartition(5)
    asked = emb.where("id % 20 = 0").select("id").unionByName(spark.createDataFrame([(20,), (999,)], "id bigint"))
    got = {}
    for row in neighbours.nearest(emb, asked, 5, metric).orderBy("query", "rank").collect():
        got.setdefault(row["query"], []).append((row["id"], row["score"]))
    assert sorted(got) == list(range(0, 400, 20))
    for q, found in got.items():
        cost = neighbours.COSTS[metric][0](points[q:q + 1], points)[0]
        want = sorted((c for i, c in enumerate(cost) if i != q))[:5]
        scores = [-s if metric == "cosine" else s for _, s in found]
        assert len({i for i, _ in found}) == 5 and q not in {i for i, _ in found}
        assert np.allclose(scores, want) and np.allclose([cost[i] for i, _ in found], want)


def test_compared_rows_do_not_grow_with_the_square(spark, monkeypatch):
    """In clusters the triangle inequality leaves a query a few blocks, however large the table is."""
    small_blocks(monkeypatch)
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    each = []
    for n in (500, 2000):
        centres = rng.normal(size=(n // 50, 8))
        points = centres.repeat(50, axis=0) + rng.normal(size=(n, 8)) * 0.01
        emb = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id bigint, v array<double>")
        index = neighbours.Index(emb, "cosine")
        bounded = emb.where("id % 20 = 0").select(F.col("id").alias("query"), F.col("v").alias("own"), F.lit(0.05).alias("reach"))
        each.append(neighbours.blocks_to_read(index, bounded).count() / bounded.count())
    assert each[1] < 1.5 * each[0] and each[1] < 0.2 * 2000 / 16


def test_few_rows(spark):
    one = spark.createDataFrame([(1, [1.0, 0.0])], "id bigint, v array<double>")
    assert neighbours.nearest(one, one.select("id"), 3).count() == 0
    two = one.unionByName(spark.createDataFrame([(2, [0.0, 1.0])], "id bigint, v array<double>"))
    assert [(r["query"], r["id"]) for r in neighbours.nearest(two, two.select("id"), 3).orderBy("query").collect()] == [(1, 2), (2, 1)]
    assert neighbours.nearest(one.limit(0), one.limit(0).select("id"), 3).count() == 0


@pytest.mark.parametrize("name", ["most_similar", "knn_poincare", "knn_lorentz"])
def test_every_twentieth_id_is_answered(spark, small, name):
    con = connect(small)
    assert compare(spark, con, small, name, catalog.QUERIES[name], catalog.ORACLES[name]) is None
    asked = {i for (i,) in con.execute("SELECT vec_id FROM embeddings WHERE vec_id % 20 = 0").fetchall()}
    assert len(asked) > 10 and {r["query"] for r in catalog.QUERIES[name](spark, small).select("query").distinct().collect()} == asked

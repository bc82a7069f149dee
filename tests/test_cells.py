"""Gradient sums over a grid of cells against the sums of joined rows."""
import math

import pytest
from pyspark.sql import functions as F

from saddle.operators import cells, nce


def vector(geometry, size, k):
    v = [0.4 * math.sin(3 * k + i) / size for i in range(size)]
    return [math.sqrt(1 + sum(a * a for a in v)), *v] if geometry == "lorentz" else v


@pytest.mark.parametrize("geometry,size,blocks", [*[(g, 2, 3) for g in nce.GEOMETRIES], ("poincare", 18, 2), ("lorentz", 18, 1)])
def test_cells_give_the_sums_of_joined_rows(spark, geometry, size, blocks):
    """Two runs, equal points, rows that come twice, rows of null and of unknown vertices, a vertex without rows."""
    made = [(run, i, vector(geometry, size, i + 50 * run), vector(geometry, size, i if i == 3 else i + 100), 0.1 * i) for run in (0, 1) for i in range(20)]
    state = spark.createDataFrame([*made, (0, None, vector(geometry, size, 9), vector(geometry, size, 9), 0.0)],
                                  "run int, id bigint, w_in array<double>, w_out array<double>, b double")
    seen = [(run, (7 * k) % 19, (5 * k + k // 19) % 19, 1.0 + k % 4, float(k % 2)) for run in (0, 1) for k in range(60 + run)]
    rows = spark.createDataFrame([*seen, seen[5], (0, 3, 3, 2.0, 1.0), (0, None, 1, 1.0, 1.0), (0, 1, None, 1.0, 0.0), (1, 99, 1, 1.0, 1.0), (1, 1, 99, 1.0, 0.0)],
                                 "run int, x bigint, t bigint, w double, label double")
    logit = nce.Logit(geometry, size)
    joined = rows.join(state.select("run", F.col("id").alias("x"), F.col("w_in").alias("vx")), ["run", "x"]).join(
        state.select("run", F.col("id").alias("t"), F.col("w_out").alias("vy"), "b"), ["run", "t"])
    want = {(r["run"], r["id"]): r for r in nce.summed_gradients(joined, logit, ["run"]).collect()}
    got = {(r["run"], r["id"]): r for r in cells.summed_in_cells(rows, state, logit, blocks).collect()}
    assert got.keys() == want.keys() and len(got) > 30
    for key, r in got.items():
        for c in want[key].asDict():
            assert r[c] == pytest.approx(want[key][c], rel=1e-9, abs=1e-9), (key, c)


def test_the_grid_follows_the_rows():
    """Cells keep their size however many rows there are, and few rows are not cut."""
    assert cells.blocks_for(10, 1) == 1 and cells.blocks_for(10 ** 6, 1) == 5 and cells.blocks_for(10 ** 6, 12) == 2
    for rows in (10 ** 8, 10 ** 9, 10 ** 10):
        assert rows / cells.blocks_for(rows, 1) ** 2 <= cells.CELL_ROWS


@pytest.mark.parametrize("geometry,size", [*[(g, 2) for g in nce.GEOMETRIES], ("lorentz", 18)])
def test_batches_are_summed_where_their_rows_are_made(spark, monkeypatch, geometry, size):
    """Pairs that come twice, equal points, vertices without a vector on either side, a batch without negatives and one of negatives only."""
    monkeypatch.setattr(cells, "BATCHED", 16)
    state = spark.createDataFrame([(i, vector(geometry, size, i), vector(geometry, size, i if i == 3 else i + 100), 0.1 * i) for i in range(20)],
                                  "id bigint, w_in array<double>, w_out array<double>, b double")
    pairs = [(k // 8, (7 * k) % 19, (5 * k + 1) % 20) for k in range(60)]
    batches = spark.createDataFrame([*pairs, pairs[3], (1, 3, 3), (2, 99, 1), (2, 1, 99)], "batch_id bigint, x bigint, y bigint")
    negatives = spark.createDataFrame([(b, (3 * b + 4 * i) % 20) for b in (0, 1, 2, 5, 6, 7, 90) for i in range(3)] + [(1, 99)], "batch_id bigint, id bigint")
    logit = nce.Logit(geometry, size)
    key = lambda df: {(r["batch_id"], r["id"]): r for r in df.collect()}
    want = key(nce.nce_gradients(nce.nce_rows(batches, negatives, state), logit, 8))
    summed = cells.batch_gradients(batches, negatives, state, logit, 8)
    got = key(summed)
    assert got.keys() == want.keys() and len(got) > 60 and "Aggregate" not in summed._jdf.queryExecution().optimizedPlan().toString()
    for at, r in got.items():
        for c in ("g_in", "g_out", "g_b"):
            assert r[c] == pytest.approx(want[at][c], rel=1e-9, abs=1e-9), (at, c)


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_packed_rows_are_dealt_whole(spark, monkeypatch, kind):
    """Every row comes back with its nulls and repeats, and rows of a key are in one partition."""
    monkeypatch.setattr(cells, "PACKED", 64)
    rows = spark.range(3000).selectExpr("0 AS run", f"CAST(IF(id % 50 = 7, NULL, id % 37) AS {kind}) AS x", "id % 11 AS y", "id AS n")
    dealt = cells.dealt_packed(rows, 5, "run", "x")
    assert dealt.rdd.getNumPartitions() == 5 and dealt.schema == rows.schema
    assert sorted(map(str, dealt.collect())) == sorted(map(str, rows.collect()))
    assert dealt.select("x", F.spark_partition_id().alias("part")).distinct().count() == rows.select("x").distinct().count()
    assert cells.dealt_packed(rows.where("false"), 5, "run", "x").count() == 0


def test_runs_with_own_starts_deal_their_pairs_once(spark, monkeypatch):
    """Pairs that all runs train on travel once, however many runs there are."""
    from saddle.plans import training

    asked, real = [], training.dealt_packed
    monkeypatch.setattr(training, "dealt_packed", lambda rows, *rest: (asked.append(rows.count()), real(rows, *rest))[1])
    pairs = spark.range(60).selectExpr("id % 6 AS x", "id % 10 AS y", "1L AS n").groupBy("x", "y").agg(F.sum("n").alias("n"))
    runs = [training.Params(epochs=1, rounds=2, negatives=2, seed=str(i)) for i in range(3)]
    together = training.train_many(pairs, runs)
    assert asked == [pairs.count()]
    for run, params in zip(together, runs):
        assert [r["loss"] for r in run.log] == pytest.approx([r["loss"] for r in training.train(pairs, params).log])

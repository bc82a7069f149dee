"""Runs trained side by side, negatives of single pairs, sweeps, and classifiers against slow forms."""
import hashlib
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from saddle.operators import linear, negatives
from saddle.operators.corpus import cooccurrence
from saddle.plans import evaluation as ev
from saddle.plans import sweeps
from saddle.plans import training as tr
from saddle.plans.tables import product_sentences, table
from saddle.storage import materialise

SHORT = tr.Params(epochs=1, rounds=2, learning_rate=0.5, window=2)


@pytest.fixture(scope="module")
def tokens(spark, small):
    return materialise(product_sentences(spark, small).where("sentence_id % 3 = 0"))


@pytest.fixture(scope="module")
def labels(spark, small):
    return materialise(table(spark, small, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 3).cast("int").alias("y")))


def gap(a, b):
    both = a.alias("a").join(b.alias("b"), "id").agg(F.count("*").alias("n"), *[
        F.max(F.aggregate(F.zip_with(f"a.{c}", f"b.{c}", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda p, q: F.greatest(p, q))).alias(c) for c in ("w_in", "w_out")]).first()
    assert both["n"] == a.count() == b.count() > 0
    return max(both["w_in"], both["w_out"])


@pytest.mark.parametrize("per_pair", [False, True])
def test_runs_side_by_side_are_the_single_runs(spark, tokens, per_pair):
    base = replace(SHORT, geometry="lorentz", per_pair=per_pair)
    runs = [base, replace(base, seed="7"), replace(base, batch_size=4), replace(base, window=1, sets=3)]
    each = [cooccurrence(tokens, p.window) for p in runs]
    together = tr.train_many(sweeps._stack([p.withColumn("run", F.lit(i)) for i, p in enumerate(each)]), runs)
    for one, pairs, params in zip(together, each, runs):
        alone = tr.train(pairs, params)
        assert gap(one.state, alone.state) < 1e-9
        assert [x["loss"] for x in one.log] == pytest.approx([x["loss"] for x in alone.log])
    with pytest.raises(ValueError, match="only"):
        tr.train_many(each[0].withColumn("run", F.lit(0)), [base, replace(base, learning_rate=9.0)])


def test_a_schedule_trains_each_round_on_its_own_pairs(spark):
    """Half of the rounds read the first source, half the second, each wrapping around."""
    first = spark.createDataFrame([(0, 1), (1, 0), (2, 0), (0, 2)], "x bigint, y bigint")
    second = spark.createDataFrame([(10, 11), (11, 10), (12, 10)], "x bigint, y bigint")
    params = replace(SHORT, geometry="euclidean", rounds=4, batch_size=2)
    run = tr.train_mixed(first, second, params, 6)
    assert [x["pairs"] for x in run.log] == [6.0] * 4
    # an input vector moves only where its vertex is a centre: the first source's two rounds and the second's two
    rows = tr.mixed_schedule(first, second, 6, 4, ["x", "y"])
    assert {(r["batch_id"], r["source"]) for r in rows.collect()} == {(0, "edge"), (1, "edge"), (2, "walk"), (3, "walk")}
    assert {r["id"] for r in run.state.collect()} == {0, 1, 2, 10, 11, 12}


def uniform(*keys):
    return int(hashlib.md5("|".join(map(str, keys)).encode()).hexdigest()[:13], 16) / (1 << 52)


def test_counted_negatives_against_single_draws(spark, monkeypatch):
    vocab = spark.createDataFrame([(i, (i + 1) ** 2) for i in range(12)], "idx bigint, freq bigint")
    noise = negatives.noise_distribution(vocab)
    line = [(r["lo"], r["hi"], r["id"]) for r in noise.collect()]
    total = max(hi for _, hi, _ in line)
    rows = [(1, 2, 3), (1, 11, 700), (5, 11, 1), (5, 0, 2)]
    want = Counter()
    for x, y, n in rows:
        for k in range(4 * n):
            at = int(uniform("neg", x, y, k) * float(total))
            found = next(i for lo, hi, i in line if lo <= at < hi)
            if found != y:
                want[x, found] += 1
    pairs = spark.createDataFrame(rows, "x bigint, y bigint, n bigint")
    for draws in (1024, 16):
        monkeypatch.setattr(negatives, "DRAWS", draws)
        got = negatives.counted_negatives(pairs, noise, 4, ["x", "y"], "x", "y").collect()
        assert {(r["x"], r["id"]): r["w"] for r in got} == dict(want)


def test_lines_of_several_runs(spark):
    """Each run draws from its own line, also one with fewer ids than draws."""
    vocab = spark.createDataFrame([(0, i, i + 1) for i in range(6)] + [(1, i, 1) for i in range(100, 102)], "run int, idx bigint, freq bigint")
    batches = spark.createDataFrame([(r, b) for r in (0, 1) for b in range(40)], "run int, batch_id bigint")
    got = negatives.negative_samples(batches, negatives.noise_lines(vocab, "run"), 4, by="run").collect()
    one = negatives.negative_samples(batches.where("run = 0").drop("run"), negatives.noise_distribution(vocab.where("run = 0")), 4).collect()
    assert {(r["batch_id"], r["rank"], r["id"]) for r in got if r["run"] == 0} == {(r["batch_id"], r["rank"], r["id"]) for r in one}
    other = Counter(r["batch_id"] for r in got if r["run"] == 1)
    assert other == {b: 2 for b in range(40)} and {r["id"] for r in got if r["run"] == 1} == {100, 101}


def test_sweeps_at_small_settings(spark, small, tokens, labels):
    pairs = materialise(cooccurrence(tokens, 2))
    batch = sweeps.sweep_batch_size(pairs, labels, SHORT, [2, 64], 2).collect()
    assert sorted(r["batch_size"] for r in batch) == [2, 64]
    for r in batch:
        assert r["loss"] == pytest.approx(tr.train(pairs, replace(SHORT, batch_size=r["batch_size"])).log[-1]["loss"])
    window = sweeps.sweep_window(tokens, labels, SHORT, [1, 3], 2).collect()
    size = sweeps.sweep_size(pairs, labels, SHORT, [2, 24], 2).collect()
    again = sweeps.repeat_embeddings(pairs, labels, SHORT, ["a", "b"], 2).collect()
    assert {r["window"] for r in window} == {1, 3} and {r["size"] for r in size} == {2, 24} and {r["seed"] for r in again} == {"a", "b"}
    edges = pairs.select(F.col("x").alias("src"), F.col("y").alias("dst"))
    grid = sweeps.sweep_deepwalk_grid(edges, labels, SHORT, [2, 4], [1, 2], [4], 2).collect()
    assert {(r["size"], r["n_walks"], r["walk_length"]) for r in grid} == {(s, n, 4) for s in (2, 4) for n in (1, 2)}
    for r in [*batch, *window, *size, *again, *grid]:
        assert 0 <= r["mean"] <= 1 and 0 <= r["train"] <= 1 and r["sde"] >= 0 and r["loss"] > 0


# -- classifiers ---------------------------------------------------------------------------

def slow_fit(x, y, classes, spec):
    """The steps of one fit, written out."""
    n, d = x.shape
    u, top = np.ones(d) / np.sqrt(d), 0.0
    for _ in range(spec.power):
        u = x.T @ (x @ u)
        top = np.linalg.norm(u)
        u /= top
    by = 1 / np.concatenate([[spec.curvature * 2 * n], np.full(d, spec.curvature * 2 * 1.2 * top + (0 if spec.l1 else 1 / spec.c))])
    rows, truth = np.concatenate([np.ones((n, 1)), x], axis=1), np.eye(classes)[y]
    w = z = np.zeros((classes, d + 1))
    for t in range(spec.steps):
        s = rows @ z.T
        p = np.exp(s) / np.exp(s).sum(axis=1, keepdims=True) if spec.multinomial else 1 / (1 + np.exp(-s))
        slope = (p - truth).T @ rows
        if not spec.l1:
            slope[:, 1:] += z[:, 1:] / spec.c
        new = z - by * slope
        if spec.l1:
            new[:, 1:] = np.sign(new[:, 1:]) * np.maximum(np.abs(new[:, 1:]) - by[1:] / spec.c, 0)
        z, w = new + t / (t + 3) * (new - w), new
    return w


def macro_f1(y, pred):
    out = []
    for c in set(y) | set(pred):
        tp, wrong = ((y == c) & (pred == c)).sum(), ((y == c) != (pred == c)).sum()
        out.append(2 * tp / (2 * tp + wrong))
    return np.mean(out)


@pytest.mark.parametrize("spec", [ev.Linear(c=1.0), ev.Linear(c=0.2, l1=True), ev.Linear(c=2.0, multinomial=True)])
def test_fits_together_are_the_fits_alone(spark, spec):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 240)
    x = rng.normal(size=(240, 5)) + np.eye(5)[y] * 2
    data = spark.createDataFrame([(i, v.tolist(), int(c), i % 3) for i, (v, c) in enumerate(zip(x, y))], "id bigint, v array<double>, y int, fold int").repartition(7)
    rows = linear.Rows(ev.numbered({"a": data, "b": data.withColumn("v", F.slice("v", 1, 3))}).join(data.select("id", "fold"), "id").select(
        "ds", "id", "v", "labels", *ev.fold_marks(3)), 3)
    (found,) = linear.fit(rows, [spec])
    fold = np.arange(240) % 3
    for ds, own in ((0, x), (1, x[:, :3])):
        for j in range(4):
            train = fold != j
            assert np.allclose(found[ds][j], slow_fit(own[train], y[train], 3, spec), atol=1e-9)
    if spec.l1:
        assert (found[0][..., 1:] == 0).any()


def test_fits_reach_the_optimum_of_scaled_rows(spark):
    """At the end no direction goes down: the penalised loss has no slope left to speak of."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4))
    y = (x[:, 0] + rng.normal(size=300) > 0).astype(int)
    w = slow_fit(x, y, 2, ev.Linear(c=1.0))[1]
    p = 1 / (1 + np.exp(-(w[0] + x @ w[1:])))
    assert np.abs(np.concatenate([[(p - y).sum()], x.T @ (p - y) + w[1:]])).max() < 0.05


def test_transfer_scores_what_a_hand_made_one_scores(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 120)
    first, second = (rng.normal(size=(120, 3)) + y[:, None] * s for s in (1.0, 0.6))
    spec = ev.CLASSIFIERS["logistic_multinomial"]
    tables = [spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y))], "id bigint, v array<double>, y int") for x in (first, second)]
    w = slow_fit(first, y, 2, spec)
    pred = (w[:, 0] + second @ w[:, 1:].T).argmax(axis=1)
    assert ev.transfer(*tables, spec).first()["macro"] == pytest.approx(macro_f1(y, pred))


def test_warm_start_goes_on_from_given_vectors(spark, tokens, labels):
    pairs = materialise(cooccurrence(tokens, 2))
    cold = tr.train(pairs, SHORT)
    warm = tr.train(pairs, replace(SHORT, seed="1"), init=cold.state)
    fresh = tr.train(pairs, replace(SHORT, seed="1"))
    assert warm.log[0]["loss"] < fresh.log[0]["loss"]


def test_forest_finds_planted_classes(spark):
    """Well apart classes are found, however the rows are dealt."""
    rng = np.random.default_rng(3)
    y = rng.integers(0, 3, 300)
    x = rng.normal(size=(300, 4)) * 0.1 + np.eye(4)[y] * 5
    data = spark.createDataFrame([(i, v.tolist(), int(c), i % 2) for i, (v, c) in enumerate(zip(x, y))], "id bigint, v array<double>, y int, fold int")
    spec = ev.Forest(depth=4, trees=30, features="all")
    for parts in (1, 6):
        got = {r["id"]: (r["pred"], r["p"]) for r in ev.cross_val_predict(data.repartition(parts), spec, 2).collect()}
        assert np.mean([got[i][0] == c for i, c in enumerate(y.tolist())]) > 0.97 and len(got) == 300
